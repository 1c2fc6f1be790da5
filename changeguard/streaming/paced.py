"""A backfill that advances by key and takes its pace from a stream of health samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from changeguard.operators.backfill import fill_pending
from changeguard.operators.ordered import scan
from changeguard.plans.plan import ThrottleConfig
from changeguard.sources.commits import Folder
from changeguard.streaming.ordered import rocksdb_state, throttle_stream_ordered

GRAIN = 100_000
#: What a sample grants: the batch size of the controller, nothing while the breaker is open.
GRANT = "CASE WHEN tripped THEN 0 ELSE batch_size END"
_DONE = "_done"


def key_cuts(df: DataFrame, key: str, grain: int = GRAIN, keep: str | None = None) -> DataFrame:
    """Cuts of a key into ranges of about ``grain`` rows: grain, last_key, row_count.

    Rows of one key stay together: they belong to the grain in which the first of them falls, so a key with more rows
    than a grain leaves the numbers after it out. Keys are counted before they are put in order, so a hot one is one row;
    the counts are written to ``keep``, where given, so that ``df`` is read once.
    """
    keys = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("last_key")).agg(F.count("*").alias("_n"))
    if keep:
        keys.write.mode("overwrite").parquet(keep)
        keys = df.sparkSession.read.schema(keys.schema).parquet(keep)
    ranked = scan(keys, [], ["last_key"], running={"_upto": F.col("_n")})
    grains = ranked.groupBy(F.floor((F.col("_upto") - F.col("_n")) / grain).cast("long").alias("grain"))
    return grains.agg(F.max("last_key").alias("last_key"), F.sum("_n").alias("row_count"))


def _cuts(df: DataFrame, key: str, grain: int, path: str) -> DataFrame:
    """The cuts, made once: those of a run that was stopped are made again, those of a whole one are kept."""
    folder, name = Folder(df.sparkSession, path), f"cuts-{grain}"
    if not folder.exists(f"{name}{_DONE}"):
        key_cuts(df, key, grain, f"{path}/keys-{grain}").write.mode("overwrite").parquet(f"{path}/{name}")
        folder.put(f"{name}{_DONE}", b"")
    return df.sparkSession.read.parquet(f"{path}/{name}")


def paced_backfill(
    df: DataFrame, key: str, exprs: Mapping[str, str | Column], samples: DataFrame, target, dst: str, checkpoint: str,
    cfg: ThrottleConfig | None = None, by: str = "target", ts: str = "ts", tie: str = "id", delay: str = "1 minute",
    grain: int = GRAIN, grant: str = GRANT,
) -> DataFrame:
    """Fill pending columns of a table in the order of its key, as fast as the health of ``target`` allows.

    ``samples`` is a stream of health samples. Every sample of the target grants as many rows as the pacing controller
    says (``grant``, an expression over its batch_size, throttle_ms and tripped), in time order whatever order samples come in
    within ``delay``. A micro-batch fills the key range of the rows granted so far, rounded up to whole ``grain``s and
    whole keys, which it reads by a condition on the key; the table is never read as a whole but once, to cut it. NULL keys
    go with the first range that is filled.

    Below ``dst``: ``table/batch_id=N`` the rows of a micro-batch, ``samples/batch_id=N`` the samples with the rows granted before
    and after each, ``progress/batch_id=N`` its range. Batch N overwrites its own, so one that runs twice
    changes nothing, and a restart goes on from the key of the last. ``df`` must not change in between, but for the
    same rows being filled. Returns the progress: batch_id, granted, from_key, upto_key, rows.
    """
    spark = df.sparkSession
    cuts = _cuts(df, key, grain, dst)
    kind = df.schema[key].dataType.simpleString()
    progress = f"granted long, from_key {kind}, upto_key {kind}, rows long"

    def write(trace: DataFrame, batch_id: int) -> None:
        trace = trace.persist()  # read several times; the state behind it is not to be gone through again
        try:
            advance(trace, batch_id)
        finally:
            trace.unpersist()

    def advance(trace: DataFrame, batch_id: int) -> None:
        before = (0, None)
        if batch_id:
            last = spark.read.schema(progress).parquet(f"{dst}/progress/batch_id={batch_id - 1}").first()
            before = (last["granted"], last["upto_key"])
        granted = scan(trace.withColumn("_g", F.expr(grant).cast("long")), [], [ts, tie], running={"_upto": F.col("_g")})
        upto = F.lit(before[0]) + F.col("_upto")
        granted.withColumn("granted_before", upto - F.col("_g")).withColumn("granted_after", upto).drop("_g", "_upto").write.mode("overwrite").parquet(f"{dst}/samples/batch_id={batch_id}")
        after = spark.read.parquet(f"{dst}/samples/batch_id={batch_id}").agg(F.max("granted_after")).first()[0]
        after = before[0] if after is None else after
        grains = F.col("grain").between(-(-before[0] // grain), -(-after // grain) - 1)
        end = cuts.filter(grains).agg(F.max("last_key")).first()[0]
        rows = 0
        first = before[0] == 0 and after > 0
        if end is not None or first:
            inside = F.lit(False) if end is None else F.col(key) <= F.lit(end)
            if before[1] is not None:
                inside = inside & (F.col(key) > F.lit(before[1]))
            seen = Observation()
            part = fill_pending(df.filter(inside | F.col(key).isNull() if first else inside), exprs)
            part.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{dst}/table/batch_id={batch_id}")
            rows = seen.get["rows"]
        spark.createDataFrame([(after, before[1], before[1] if end is None else end, rows)], progress).coalesce(1).write.mode("overwrite").parquet(f"{dst}/progress/batch_id={batch_id}")

    paced = throttle_stream_ordered(samples.filter(F.col(by) == F.lit(target)), cfg, by, ts, tie, delay)
    with rocksdb_state(spark):
        query = paced.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(f"{progress}, batch_id long").parquet(f"{dst}/progress")
