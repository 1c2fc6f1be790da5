"""Incremental backfill that resumes where it stopped, and batch runs of streams."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from changeguard.operators.backfill import fill_pending
from changeguard.sources.logs import stream_log


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there now into Parquet files and read them."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def backfill_stream(
    spark: SparkSession, src: str, dst: str, checkpoint: str, exprs: Mapping[str, str | Column], schema,
    glob: str | None = None, files_per_trigger: int = 1000, prepare=None,
) -> DataFrame:
    """Fill pending columns of all files below ``src`` that were not yet done.

    Micro-batch N overwrites ``dst/table/batch_id=N`` and its progress row, so a
    batch that runs twice changes nothing; a restart goes on after the last
    finished batch. ``prepare`` maps the source frame first. Returns the progress
    log: batch_id, rows, filled, still_null.
    """
    stream = stream_log(spark, src, schema, glob, files_per_trigger)
    if prepare:
        stream = prepare(stream)
    targets = list(exprs)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        was = reduce(or_, [F.col(c).isNull() for c in targets])
        rows = batch.withColumn("_was", was)
        filled = fill_pending(rows, exprs)
        still = reduce(or_, [F.col(c).isNull() for c in targets])
        watched = filled.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_was") & ~still).alias("filled"),
            F.count_if(still).alias("still_null"),
        )
        watched.drop("_was").write.mode("overwrite").parquet(f"{dst}/table/batch_id={batch_id}")
        got = seen.get
        batch.sparkSession.createDataFrame(
            [(got["rows"], got["filled"], got["still_null"])], "rows long, filled long, still_null long"
        ).write.mode("overwrite").parquet(f"{dst}/progress/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{dst}/progress")
