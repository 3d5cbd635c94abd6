"""Tables that change as a whole.

A commit writes its rows as Parquet under a folder of its own and then one small file, the next *version*, which names every folder that belongs to
the tables now. Readers take the newest version. Losing executors repeats tasks; a driver lost before the version is there leaves the old tables, and
what it wrote is never looked at. Notes (which stream batch, which request) are in the same file, so data and notes change together.

One writer at a time: a second one that commits the same version fails. A version holds a row for each partition and table, not for each row of data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_VERSION = "kind string, name string, part string, value string"


@dataclass
class Change:
    """New rows of a table. ``touched`` holds the partitions (columns ``by``) that they replace beside those that they lie in; without it, all."""

    rows: DataFrame
    by: Sequence[str] = ()
    touched: DataFrame | None = None
    order: Sequence[str] = ()


@dataclass
class Version:
    number: int = 0
    parts: list[tuple[str, str, str]] = field(default_factory=list)  # table, partition, folder
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


def _partition(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in by])) if by else F.lit("{}")


class Store:
    """The tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_VERSION}, version int").parquet(f"{self.root}/versions")
        except AnalysisException:
            return None  # nothing was ever committed

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an earlier one."""
        rows = self._versions()
        if rows is None:
            return Version()
        number = rows.agg(F.max("version")).first()[0] if number is None else number
        out = Version(number or 0)
        for r in rows.where(F.col("version") == out.number).collect():  # a row for each partition and note
            if r["kind"] == "part":
                out.parts.append((r["name"], r["part"], r["value"]))
            else:
                (out.schemas if r["kind"] == "schema" else out.notes)[r["name"]] = r["value"]
        return out

    def note(self, name: str) -> str | None:
        return self.version().notes.get(name)

    def has(self, name: str) -> bool:
        return name in self.version().schemas

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """The rows of a table in the newest version (or an earlier one)."""
        v = self.version(number)
        schema = StructType.fromJson(json.loads(v.schemas[name]))
        paths = [path for table, _, path in v.parts if table == name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.select(*schema.fieldNames())

    def commit(self, changes: dict[str, Change], notes: dict[str, str] | None = None) -> int:
        """Write the changes and swap the version; returns its number."""
        now = self.version()
        run = f"run={now.number + 1}-{uuid.uuid4().hex[:12]}"
        for name, change in changes.items():
            path, by = f"{self.root}/{name}/{run}", list(change.by)
            order = [*by, *change.order]
            rows = change.rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else change.rows
            rows.write.partitionBy(*by).parquet(path)
            schema = change.rows.schema
            folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
            found = self.spark.read.schema(schema).parquet(path).select(_partition(by).alias("part"), folder.alias("path")).distinct().collect()
            new = [(name, r["part"], r["path"]) for r in found]
            gone = {p for _, p, _ in new}
            if change.touched is not None:
                gone |= {r[0] for r in change.touched.select(_partition(by)).distinct().collect()}
            now.parts = [p for p in now.parts if p[0] != name or (change.touched is not None and p[1] not in gone)] + new
            now.schemas[name] = schema.json()
        now.notes |= notes or {}
        self._point(now)
        return now.number + 1

    def _point(self, now: Version) -> None:
        """One file: the tables change when it is there."""
        rows = [("part", *p) for p in now.parts] + [("schema", n, None, s) for n, s in now.schemas.items()] + [("note", n, None, v) for n, v in now.notes.items()]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.parquet(f"{self.root}/versions/version={now.number + 1}")

    def retire(self, keep: int = 1) -> int:
        """Empty the folders that none of the last ``keep`` versions names; returns how many. Readers of older versions must be done."""
        rows = self._versions()
        if rows is None:
            return 0
        last = self.version().number
        run = F.regexp_extract("value", "^(.*/run=[^/]*)", 1)
        parts = rows.where("kind = 'part'").groupBy(run.alias("folder")).agg(F.max("version").alias("seen"))
        stale = [r["folder"] for r in parts.where(F.col("seen") <= last - keep).toLocalIterator()]
        for folder in stale:
            self.spark.createDataFrame([], "retired boolean").write.mode("overwrite").parquet(folder)
        for number in [r[0] for r in rows.where(F.col("version") <= last - keep).select("version").distinct().toLocalIterator()]:
            self.spark.createDataFrame([], _VERSION).write.mode("overwrite").parquet(f"{self.root}/versions/version={number}")
        return len(stale)


def batch_done(store: Store, batch: tuple[str, int] | None) -> bool:
    """Whether this batch (stream, number) or a later one of its stream is in the tables."""
    if batch is None:
        return False
    seen = store.note(f"batch:{batch[0]}")
    return seen is not None and int(seen) >= batch[1]


def batch_note(batch: tuple[str, int] | None) -> dict[str, str]:
    return {} if batch is None else {f"batch:{batch[0]}": str(batch[1])}
