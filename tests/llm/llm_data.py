"""Small awkward inputs for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

_SYLLABLES = ["the", "an", "on", "er", "in", "re", "tion", "ed", "é", "ü", "ça", "th", "st", "ou"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies."""
    rng = random.Random(3)
    base = sentence(rng, 120)
    rows = [(i, sentence(rng, rng.randint(1, 90)), "en", f"s{i % 5}", 1) for i in range(60)]
    rows += [(100 + i, base, "en", "hot", 1) for i in range(40)]  # exact copies
    rows += [(200 + i, base + " " + sentence(rng, 1), "en", "hot", 1) for i in range(15)]  # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t ", "en", None, 4),
             (None, "a text without an id", "en", "s2", 1), (None, None, None, None, None),
             (303, sentence(rng, 30_000), "de", "s3", 1), (304, "x" * 50_000, "de", "lone", 1),
             (305, "word", "en", "lone", 1), (306, "İstanbul ΣΑΣ don't á ́c  中文字 \x1cfoo\x85bar\xa0baz", "en", "s1", 1)]
    rows += [(7, "the same id, another text", "fr", "s1", 1)]  # a tie on the id
    rows += [(400, "a repeated row of eleven words or so, to be read twice", "en", "s4", 9)] * 3
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOCS)


def clashing(df):
    """``df`` with extra columns named like what operators add."""
    from pyspark.sql import functions as F
    for name in ("found", "quality", "row_key", "mix_key", "mix_spans", "strict_host", "h", "fp", "id", "host", "size",
                 "rank", "block", "row", "number"):
        df = df.withColumn(name, F.lit(name))
    return df


