"""Standard normal distribution function and its inverse as columns, from Spark built-ins only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 160  # enough for |x| <= 8 in double precision
TAIL = 8.0


def normal_cdf(x: Column) -> Column:
    """0.5 + density(x) * (x + x^3/3 + x^5/(3*5) + ...); beyond eight deviations it is 0 or 1 to double precision."""
    square = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(x.cast("double").alias("term"), x.cast("double").alias("total")),
        lambda s, k: F.struct(
            (s["term"] * square / (k * 2 + 1)).alias("term"), (s["total"] + s["term"] * square / (k * 2 + 1)).alias("total")
        ),
    )["total"]
    inside = F.lit(0.5) + F.exp(-square / 2.0) / math.sqrt(2 * math.pi) * series
    return F.when(x > TAIL, 1.0).when(x < -TAIL, 0.0).otherwise(inside)


def normal_ppf(p: Column) -> Column:
    """Inverse by halving the interval sixty times; NULL outside (0, 1)."""
    bounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(-TAIL).alias("lo"), F.lit(TAIL).alias("hi")),
        lambda s, _: F.when(
            normal_cdf((s["lo"] + s["hi"]) / 2.0) < p, F.struct(((s["lo"] + s["hi"]) / 2.0).alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2.0).alias("hi"))),
    )
    return F.when((p > 0) & (p < 1), (bounds["lo"] + bounds["hi"]) / 2.0)
