"""Line deduplication across documents: lines as hashes with positions, documents counted by hash, texts put together again.

1. Every text is split at line ends; a line's key is the line without white space at its ends, A-Z lower-cased.
   Lines whose key is long enough become rows of (document, position, 16-byte digest of the key); no text is shuffled.
2. Distinct documents and the smallest id are counted for each digest, pre-aggregated before the shuffle.
3. Lines of keys that are in too many documents go, but for those of the smallest id. Positions come back as one
   list for each row and the rest of its lines is joined in order.

A digest that is in a third of all documents is one row after step 2; the join of step 3 has only equal keys, so
adaptive execution splits it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import SPACES, row_key, stored

#: Code points from which a key counts, and documents from which its lines go.
LEAST_KEY, LEAST_DOCS = 10, 2


def line_key(line: Column) -> Column:
    """The line as it is compared."""
    return F.translate(F.trim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_key: int = LEAST_KEY, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(__key, gone): the positions (from 1) of the lines that go, for each row that loses any; ``__key`` is its ``row_key``."""
    own = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))
    keyed = F.transform(_lines(F.col(text)), lambda x, i: F.struct((i + 1).alias("at"), line_key(x).alias("key")))
    long = F.transform(F.filter(keyed, lambda x: F.char_length(x["key"]) >= least_key), lambda x: F.struct(x["at"].alias("at"), F.unhex(F.md5(x["key"])).alias("hash")))
    lines = df.select(row_key(doc_id, text).alias("__key"), own.alias("__doc"), F.explode(long).alias("line")).select("__key", "__doc", "line.*")
    common = lines.groupBy("hash").agg(F.count_distinct("__doc").alias("docs"), F.min("__doc").alias("first")).filter(F.col("docs") >= least_docs)
    common = stored(common.drop("docs"), "common-lines")  # written, so that the join can split a hot line
    return lines.join(common, "hash").filter(F.col("__doc") != F.col("first")).groupBy("__key").agg(F.collect_set("at").alias("gone"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_key: int = LEAST_KEY, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All columns of ``df`` with the text that is left, and ``n_lines`` and ``n_dropped`` (which replace columns of these names).

    Lines whose key has at least ``least_key`` code points and is in at least ``least_docs`` documents stay in the
    document of the smallest id that holds it, as often as they are there, and go elsewhere. A NULL or empty text is one
    empty line, which never goes; a text that loses all its lines is empty. Rows that share an id are one document to the
    count, so rows that repeat keep the same lines; a NULL id is an id after all others. No rows give no rows.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), row_key(doc_id, text).alias("__key"))
    gone = dropped_lines(df, doc_id, text, least_key, least_docs)
    lines = _lines(F.col("__row")[text])
    places = F.sequence(F.lit(1), F.size(lines))
    left = F.when(F.col("gone").isNull(), places).otherwise(F.array_except(places, F.col("gone")))
    joined = rows.join(gone, "__key", "left").select("__row", lines.alias("__lines"), left.alias("__left"))
    kept = F.array_join(F.transform("__left", lambda i: F.element_at("__lines", i)), "\n")
    return joined.select(
        *(kept.alias(c) if c == text else F.col("__row")[c].alias(c) for c in names),
        F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__left")).cast("long").alias("n_dropped"))
