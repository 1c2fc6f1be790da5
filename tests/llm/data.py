"""Small tables with every awkward row."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    ("kept", T.StringType()), ("key", T.StringType()), ("score", T.StringType()), ("node", T.StringType()), ("n_words", T.StringType()), ("spans", T.StringType()))])

LONG = " ".join(f"word{i} of{i % 97} text" for i in range(40_000))


def awkward(spark, texts=None):
    """NULLs, empty and very long texts, repeated rows and ids, columns with clashing names."""
    rows = texts or [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a short text"), (5, "a short text"), (6, "a short text"), (None, "no id here"), (None, None), (5, "other text, same id"), (7, "x" * 70_000), (8, "É ß 漢字 \U0001f600   end")]
    return spark.createDataFrame([(i, t, None, None if i == 2 else "src", len(t or ""), "k", "k", "s", "n", "w", "p") for i, t in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
