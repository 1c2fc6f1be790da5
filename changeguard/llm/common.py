"""Row identity, written intermediate tables and session preparation shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeguard.session import scratch_dir, ship_package

#: The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
#: Arrow batches hold at most this much, so a run of very long texts does not pile up in a worker.
BATCH_BYTES = str(16 << 20)


def prepare(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> None:
    """Make this package importable in Python workers and bound their batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)


def row_key(doc_id: str = "doc_id", text: str = "text", *more: str) -> Column:
    """16 bytes that name a row by its id, its whole text and more columns.

    It is the same after a recomputation on another executor and never NULL.
    Rows that repeat both share it, and get the same results.
    """
    return F.unhex(F.md5(F.concat_ws(
        "\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in (doc_id, *more)), F.coalesce(F.col(text), F.lit("\x02")))))


#: Spark setting: a query's shuffle files go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here and survives lost executors.

    The shuffle files behind it are of no more use and are given free.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Up to this many rows (of a few numbers) are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 50_000


def join_hint(df: DataFrame) -> str:
    """The hint for a written table of numbers as the side of a join, by its rows.

    Spark goes by the files' size, and for columns and exploded lists by default sizes; in the driver's memory
    packed numbers and exploded lists take many times that.
    """
    return "broadcast" if df.count() <= BROADCAST_ROWS else "merge"


def words_of(text: Column) -> Column:
    """Array of the runs of characters that are not white space; empty for no text."""
    body = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(body, r"[ \t\n\x0B\f\r]+"), "")
