"""Pending rows, batches, shards and progress of a backfill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import as_expr
from changeguard.operators.ordered import scan

# Shard defaults and bounds.
SHARD_COUNT = 16
SHARD_BATCH = 10_000
SHARD_MIN, SHARD_MAX = 1, 64


def pending(df: DataFrame, column: str, key: str = "id", after=None) -> DataFrame:
    """Rows still to be filled, behind the cursor if one is given."""
    rows = df.filter(F.col(column).isNull())
    return rows if after is None else rows.filter(F.col(key) > F.lit(after))


def pending_any(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(or_, [F.col(c).isNull() for c in columns]))


def fill_pending(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """Fill only what is NULL. Running it again changes nothing."""
    return df.withColumns({
        c: F.when(F.col(c).isNull(), as_expr(e).cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c, e in exprs.items()
    })


def in_batch(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the batch."""
    return df.join(ids.select(key), key, "left_semi")


def next_batch(df: DataFrame, column: str, key: str = "id", after=None, n: int = 5000) -> DataFrame:
    """The n lowest pending keys; the cursor after it is their maximum."""
    return pending(df, column, key, after).select(key).orderBy(key).limit(n)


def plan_batches(df: DataFrame, column: str, key: str = "id", size: int = 5000, tie: Sequence[str] = ()) -> DataFrame:
    """All batches at once: number, first and last key, rows, running total."""
    todo = pending(df, column, key).select(key, *tie)
    ranked = scan(todo, [], [key, *tie], number="_rn")
    batch = F.floor((F.col("_rn") - 1) / size) + 1
    return (
        ranked.groupBy(batch.cast("long").alias("batch_number"))
        .agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("row_count"))
        .withColumn("running_rows", (F.col("batch_number") - 1) * size + F.col("row_count"))
    )


def key_bounds(df: DataFrame, key: str = "id") -> DataFrame:
    """Lowest and highest key (0 if there is none) and emptiness."""
    return df.agg(
        F.coalesce(F.min(key), F.lit(0)).alias("min_key"),
        F.coalesce(F.max(key), F.lit(0)).alias("max_key"),
        (F.count(key) == 0).alias("is_empty"),
    )


def backfill_status(df: DataFrame, column: str, key: str = "id", after=None, done: int | None = None) -> DataFrame:
    """Remaining, done, total and percent. ``done`` rows come from a checkpoint;
    without one the filled rows are counted."""
    left = F.col(column).isNull()
    if after is not None:
        left = left & (F.col(key) > F.lit(after))
    finished = F.lit(done).cast("long") if done is not None else F.count_if(F.col(column).isNotNull())
    counts = df.agg(F.count_if(left).alias("remaining"), finished.alias("done"))
    total = F.col("remaining") + F.col("done")
    return counts.select(
        "remaining", "done", total.alias("total"),
        F.when(total > 0, F.col("done") * 100.0 / total).otherwise(0.0).alias("pct"),
    )


#: What checkpoint documents hold; anything else in them is ignored.
CHECKPOINT = "last_id bigint, rows_done bigint, batch_num int, canary_pct int, slo_breach string, cutover_parity double"


def read_checkpoints(events: DataFrame, detail: str = "detail") -> DataFrame:
    """Per change the newest value of each field of its checkpoint documents
    (``id`` orders the events). A document that is no JSON has no fields."""
    docs = events.withColumn("_d", F.from_json(detail, CHECKPOINT))
    names = [part.split()[0] for part in CHECKPOINT.split(", ")]
    return docs.groupBy("migration_id").agg(*[
        F.max_by(F.col(f"_d.{n}"), F.when(F.col(f"_d.{n}").isNotNull(), F.col("id"))).alias(n) for n in names])


def status_from_checkpoints(df: DataFrame, column: str, events: DataFrame, migration_id: str, key: str = "id") -> DataFrame:
    """``backfill_status`` of one change from where its newest checkpoint says it is."""
    point = read_checkpoints(events.filter(F.col("migration_id").cast("string") == migration_id)).first()
    if point is None:
        return backfill_status(df, column, key)
    return backfill_status(df, column, key, point["last_id"], point["rows_done"])


def shard_ranges(n: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(shard, first key, last key); the last shard takes the rest."""
    width = max((hi - lo + 1) // n, 1)
    starts = [lo + i * width for i in range(n)]
    return [(i, s, hi if i == n - 1 else s + width - 1) for i, s in enumerate(starts)]


def assign_shards(df: DataFrame, key: str = "id", n: int = SHARD_COUNT, name: str = "shard") -> DataFrame:
    """Tag rows with their shard. Reads the key bounds, then is plain arithmetic."""
    b = key_bounds(df, key).first()
    width = max((b["max_key"] - b["min_key"] + 1) // n, 1)
    at = F.floor((F.col(key) - F.lit(b["min_key"])) / F.lit(width))
    return df.withColumn(name, F.least(at, F.lit(n - 1)).cast("int"))


def shard_report(df: DataFrame, key: str = "id", n: int = SHARD_COUNT, status: Column | None = None) -> DataFrame:
    """Rows and, with a pending condition, unfinished rows per shard."""
    left = F.count_if(status) if status is not None else F.lit(0).cast("long")
    return assign_shards(df, key, n).groupBy("shard").agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"),
        F.count("*").alias("row_count"), left.alias("pending_rows"),
    )


def optimal_shards(stats: DataFrame, rows: str, target_secs: str, batch_secs: str, name: str = "shards") -> DataFrame:
    """Shards so that each finishes in the target time, one row per table."""
    batches = F.floor(F.col(rows) / SHARD_BATCH)
    per_shard = F.greatest(F.floor(F.col(target_secs) / F.col(batch_secs)), F.lit(1))
    wanted = F.floor(batches / per_shard)
    return stats.withColumn(name, F.greatest(F.lit(SHARD_MIN), F.least(F.lit(SHARD_MAX), wanted)).cast("int"))
