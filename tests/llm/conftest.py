import random

import pytest

WORDS = "the of and in on river stone light paper window garden summer winter train house small large quick slow under over again never always".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text): nulls, empty, white space, repeated rows, one id with two texts, copies, near copies, shared passages, very long texts."""
    r = random.Random(3)
    passage, other = sentence(r, 70), sentence(r, 64)
    rows = [(None, sentence(r, 60)), (None, None), (1, None), (2, ""), (3, " \t\n\x0b  "), (4, "a"), (5, "Two words"), (6, "one two three"),
            (7, "\n\nsame line\nsame line\n\nother\n"), (8, "été ñandú 日本 😀 " * 30), (9, sentence(r, 300)), (9, sentence(r, 90))]
    rows += [(10 + i, sentence(r, 40) + " " + passage + " " + sentence(r, 20 + i)) for i in range(6)]
    rows += [(20 + i, passage) for i in range(5)] + [(25, passage), (25, passage), (None, passage)]
    base = sentence(r, 200).split()
    for i in range(6):
        w = list(base)
        w[30 * i] = "changed"
        rows.append((30 + i, " ".join(w)))
    rows += [(40, other + "\n" + passage), (41, (other + "\n") * 4), (42, "  double  spaces " + other + "  "), (43, sentence(r, 30_000))]
    rows += [(44, "x" * 5000), (45, "x" * 49), (46, "x" * 50), (47, "<|endoftext|> the end's  \n of"), (48, " ".join([passage[:260]] * 3)), (49, sentence(r, 12).upper())]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows as documents, with columns whose names the operators use inside."""
    extra = "lang string, source string, n_chars bigint, block int, bucket int, data string, score double, h string, p string, words string, n_words int, fp int, bad string, root int, rate string"
    values = [(d, t, ["en", "de", None][i % 3], "s", len(t or ""), 1, 2, "x", None, "h", "p", "w", 3, 4, "b", 5, "r") for i, (d, t) in enumerate(messy_rows)]
    return spark.createDataFrame(values, "doc_id bigint, text string, " + extra).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark, messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def marks(spark, messy_rows):
    ids = sorted({d for d, _ in messy_rows if d is not None})
    return spark.createDataFrame([(d, i % 2, 0) for i, d in enumerate(ids)] + [(None, 1, 0), (ids[0], None, None)], "doc_id bigint, quality int, toxic int")


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
