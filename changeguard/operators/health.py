"""Database health from snapshots: replication, connections, locks, load score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import age_seconds, health_score
from changeguard.operators.bounded import if_small, merge_groups
from changeguard.operators.ordered import rolling

# Limits of the preflight gate.
MAX_LOCK_QUEUE = 5
MAX_LAG_MS = 30_000

# The columns that identify a lock object.
LOCK_OBJECT = (
    "locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid", "objsubid",
)


def replication_status(replicas: DataFrame, by: Sequence[str] = (), name: str = "replica", lag: str = "lag_ms") -> DataFrame:
    """Replica count, largest lag (0 if none) and the replica that has it."""
    worst = F.max_by(name, F.struct(F.coalesce(F.col(lag), F.lit(float("-inf"))), F.col(name)))
    return replicas.groupBy(*by).agg(
        F.count("*").alias("replica_count"), F.coalesce(F.max(lag), F.lit(0.0)).alias("max_lag_ms"),
        F.coalesce(worst.cast("string"), F.lit("none")).alias("worst_replica"),
    )


def connection_usage(activity: DataFrame, max_conns: int, by: Sequence[str] = ()) -> DataFrame:
    counts = activity.groupBy(*by).agg(
        F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "idle").alias("idle"),
    )
    return counts.withColumns({
        "max_conns": F.lit(max_conns).cast("long"),
        "used_pct": F.col("active") * 100.0 / F.lit(float(max_conns)) if max_conns > 0 else F.lit(None).cast("double"),
    })


def activity_breakdown(activity: DataFrame, dims: Sequence[str | Sequence[str]]) -> DataFrame:
    """Connections per value of each dimension, one pass; NULL values are left out.

    A dimension may be a set of columns: its name and values are joined by `` / ``,
    a NULL within it shows as ``-``, and only rows with NULL in all of them are left out.
    """
    def pair(d):
        if isinstance(d, str):
            return F.lit(d), F.col(d).cast("string")
        shown = F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in d])
        return F.lit(" / ".join(d)), F.when(F.coalesce(*[F.col(c).cast("string") for c in d]).isNotNull(), shown)

    pairs = F.explode(F.array(*[F.struct(n.alias("dimension"), v.alias("value")) for n, v in map(pair, dims)]))
    return (
        activity.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull())
        .groupBy("dimension", "value").agg(F.count("*").alias("n"))
    )


def lock_queue(activity: DataFrame, by: Sequence[str] = (), exclude: str | None = None) -> DataFrame:
    """Waiting statements and the one that has waited longest."""
    waits = (F.col("state") == "active") & (F.col("wait_event_type") == "Lock")
    if exclude:
        waits = waits & ~F.col("query").contains(exclude)
    waits = F.coalesce(waits, F.lit(False))
    first = F.min_by(F.struct("pid", "query"), F.when(waits, F.struct("query_start", "pid")))
    return activity.groupBy(*by).agg(F.count_if(waits).alias("waiting_queries"), first.alias("_o")).select(
        *by, "waiting_queries", F.col("_o.pid").alias("oldest_pid"), F.col("_o.query").alias("oldest_query")
    )


def preflight(queue: DataFrame, replication: DataFrame, by: Sequence[str] = (), max_queue: int = MAX_LOCK_QUEUE, max_lag_ms: float = MAX_LAG_MS) -> DataFrame:
    """Start gate per group: blocked by the lock queue first, then by lag."""
    q, lag = F.coalesce("waiting_queries", F.lit(0)), F.coalesce("max_lag_ms", F.lit(0.0))
    both = merge_groups(by, queue.select(*by, "waiting_queries"), replication.select(*by, "max_lag_ms"))
    why = F.when(q > max_queue, "lock_queue").when(lag > max_lag_ms, "replication_lag")
    return both.select(
        *by, q.alias("waiting_queries"), lag.alias("max_lag_ms"), why.isNotNull().alias("blocked"), why.alias("reason")
    )


def score_health(samples: DataFrame, name: str = "score") -> DataFrame:
    return samples.withColumn(name, health_score("active_conns", "max_conns", "max_lag_ms", "waiting_queries", "dead_tuples"))


def rolling_health(samples: DataFrame, by: Sequence[str] = ("target",), order: Sequence[str] = ("ts", "id"), n: int = 100) -> DataFrame:
    """Mean and lowest score and number of samples over the last n samples."""
    return rolling(score_health(samples), by, order, n, {
        "mean_score": F.avg("score"), "min_score": F.min("score"), "sample_count": F.count("*"),
    })


def long_running(activity: DataFrame, as_of, secs: float, start: str = "query_start", state: str | None = "active", exclude: Sequence[str] = ()) -> DataFrame:
    """Work that started more than ``secs`` before ``as_of``, with its age."""
    rows = activity.withColumn("age_s", age_seconds(start, as_of)).filter(F.col("age_s") > secs)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    for text in exclude:
        rows = rows.filter(~F.col("query").contains(text))
    return rows


def lock_blocking(locks: DataFrame, activity: DataFrame) -> DataFrame:
    """Who waits for a lock that others hold or want: one row per waiting request
    with the number of other requests on the same object and one other pid
    among those with a row in ``activity`` (the lowest, or the highest if the
    waiting process itself is the lowest; NULL if none has one).

    Counting per object keeps the size linear when one object has a third of all
    requests; ``blocking_pairs`` lists the pairs of one waiting process.
    """
    per_pid = locks.groupBy(*LOCK_OBJECT, "pid").agg(F.count("*").alias("_mine"))
    seen = activity.select("pid").distinct().withColumn("_seen", F.lit(True))
    known = F.when(F.col("_seen"), F.col("pid"))
    objects = per_pid.join(seen, "pid", "left").groupBy(*LOCK_OBJECT).agg(
        F.sum("_mine").alias("_all"), F.min(known).alias("_low"), F.max(known).alias("_high"),
    )
    waiting = locks.filter(~F.col("granted")).select(*LOCK_OBJECT, "pid")
    waiting = _null_safe(waiting, objects, LOCK_OBJECT)
    waiting = _null_safe(waiting, per_pid, [*LOCK_OBJECT, "pid"])
    others = F.col("_all") - F.col("_mine")
    other = F.when(F.col("_low") != F.col("pid"), F.col("_low")).when(F.col("_high") != F.col("pid"), F.col("_high"))
    rows = waiting.filter(others > 0).select(
        F.col("pid").alias("blocked_pid"), others.alias("blocking_requests"), other.alias("blocking_pid"),
        "locktype", "relation",
    )
    a = activity.select("pid", "query")
    return (
        rows.join(a.toDF("blocked_pid", "blocked_query"), "blocked_pid", "left")
        .join(a.toDF("blocking_pid", "blocking_query"), "blocking_pid", "left")
    )


def blocking_pairs(locks: DataFrame, activity: DataFrame, pid: int) -> DataFrame:
    """All requests of other processes on the objects one process waits for."""
    mine = locks.filter((F.col("pid") == pid) & ~F.col("granted"))
    others = locks.filter(F.col("pid") != pid)
    small = if_small(mine.select(*LOCK_OBJECT))
    objects = F.broadcast(small) if small is not None else mine.select(*LOCK_OBJECT)
    pairs = _null_safe(others.select(*LOCK_OBJECT, "pid"), objects, LOCK_OBJECT)
    a = activity.select("pid", "query")
    return (
        pairs.select(F.lit(pid).cast("long").alias("blocked_pid"), F.col("pid").alias("blocking_pid"), "locktype", "relation")
        .join(a.toDF("blocked_pid", "blocked_query"), "blocked_pid")
        .join(a.toDF("blocking_pid", "blocking_query"), "blocking_pid")
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL; the left keys are kept."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for c in keys:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        on = same if on is None else on & same
    return left.join(r, on).drop(*[f"_r_{c}" for c in keys])
