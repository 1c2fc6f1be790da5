"""Sequential folds per key that stay parallel inside a hot key.

A key with few rows is folded in one call. A larger one is cut into ordered
blocks: every block is summarised to its effect on any earlier state, the
effects are chained per key (one small row per block), and every block is
replayed from its own start state.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import micros
from changeguard.functions.controllers import Bucket, Pacing
from changeguard.operators.health import score_health
from changeguard.operators.lifecycle import last_n
from changeguard.operators.ordered import choose_cut
from changeguard.plans.plan import ThrottleConfig
from changeguard.session import group_row_limit

FOLD_ROWS = 500_000
BUCKET_ROWS = 100_000


def ordered_fold(
    df: DataFrame, by: Sequence[str], order: Sequence[str], controller, value: str,
    replay: Callable[[object, list, object], dict], columns: str,
) -> DataFrame:
    """``df`` plus the columns (a DDL string) that ``replay`` returns.

    ``replay(controller, values, state)`` gets the ordered values of a run and
    the state before it.
    """
    by, order = list(by), list(order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [columns])
    # A run is held in Python memory, so its blocks are smaller than window blocks.
    limit = min(FOLD_ROWS, group_row_limit(df.sparkSession))
    cut = choose_cut(df, by, order, limit)

    def run(rows: pd.DataFrame, state) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.assign(**replay(controller, rows[value].tolist(), state))

    # Small keys share a call: a bucket of keys costs one Python call, not one per key. Keys that would fill a
    # bucket alone have one of their own.
    names = df.columns

    def run_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[names].sort_values([*by, *order], kind="stable", ignore_index=True)
        key_of = rows.groupby(by, dropna=False, sort=False).ngroup().tolist()
        values, made, start = rows[value].tolist(), {}, 0
        for end in range(1, len(values) + 1):
            if end == len(values) or key_of[end] != key_of[start]:
                for name, part in replay(controller, values[start:end], controller.start()).items():
                    made.setdefault(name, []).extend(part)
                start = end
        return rows.assign(**made)

    def in_buckets(part: DataFrame) -> DataFrame:
        hashed = F.xxhash64(*by)
        sizes = part.groupBy(hashed.alias("_own")).agg(F.count("*").alias("_n"))
        rows = sizes.agg(F.sum("_n")).first()[0] or 0
        buckets = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / BUCKET_ROWS))
        # A large key's hash names its bucket, the others share the numbers from 0.
        large = sizes.filter(F.col("_n") > BUCKET_ROWS).select("_own")
        shared = part.withColumn("_hash", hashed).join(large, F.col("_hash") == F.col("_own"), "left").withColumn("_bucket", F.pmod("_hash", F.lit(buckets))).drop("_hash")
        return shared.groupBy("_bucket", "_own").applyInPandas(run_bucket, schema)

    if not cut:
        return in_buckets(df)

    tagged = cut.tag(df)
    rows = tagged.filter("_hot")
    key_ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def summarise(run_rows: pd.DataFrame) -> pd.DataFrame:
        values = run_rows.sort_values(order, kind="stable")[value].tolist()
        head = run_rows.iloc[:1][[*by, "_blk"]]
        return head.assign(effect=pickle.dumps(controller.summarise(values)))

    def chain(effects: pd.DataFrame) -> pd.DataFrame:
        effects, state, starts = effects.sort_values("_blk"), controller.start(), []
        for effect in effects["effect"]:
            starts.append(pickle.dumps(state))
            state = controller.jump(state, pickle.loads(effect))
        return effects[[*by, "_blk"]].assign(state=starts)

    effects = rows.select(*dict.fromkeys([*by, "_blk", *order, value])).groupBy(*by, "_blk").applyInPandas(
        summarise, f"{key_ddl}, _blk long, effect binary")
    starts = effects.groupBy(*by).applyInPandas(chain, f"{key_ddl}, _blk long, state binary")

    def finish(run_rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return run(run_rows[names], pickle.loads(start["state"].iloc[0]))

    keys = [*by, "_blk"]
    hot = rows.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(finish, schema)
    return hot.unionByName(in_buckets(tagged.filter(~F.col("_hot")).select(*names)))


def replay_pacing(pacing: Pacing, scores: list, s) -> dict:
    out = {"batch_size": [], "throttle_ms": [], "tripped": [], "trip_count": []}
    for score in scores:
        pacing.step(s, score)
        for name, v in zip(out, (s.batch, s.pause, s.open, s.trips), strict=True):
            out[name].append(v)
    return out


def replay_bucket(bucket: Bucket, times: list, s) -> dict:
    return {"allowed": [bucket.step(s, at) for at in times]}


def throttle_trace(samples: DataFrame, cfg: ThrottleConfig | None = None, by: str = "target", order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Batch size, pause and breaker after each health sample of a target."""
    scored = score_health(samples).select(by, *order, "score")
    return ordered_fold(
        scored, [by], order, Pacing(cfg or ThrottleConfig()), "score", replay_pacing,
        "batch_size int, throttle_ms int, tripped boolean, trip_count int",
    )


def breaker_episodes(trace: DataFrame, by: str = "target", ts: str = "ts") -> DataFrame:
    """Each time the breaker was open: tripped at, recovered at (NULL if still
    open), seconds open. The trip counter names the episode, so this is one
    aggregate."""
    ends = trace.filter(F.col("trip_count") > 0).groupBy(by, F.col("trip_count").alias("episode")).agg(
        F.min(F.when(F.col("tripped"), F.col(ts))).alias("tripped_at"),
        F.min(F.when(~F.col("tripped"), F.col(ts))).alias("recovered_at"),
    )
    return ends.withColumn("open_s", (micros("recovered_at") - micros("tripped_at")) / 1e6)


def current_pace(trace: DataFrame, by: str = "target", order: Sequence[str] = ("ts", "id")) -> DataFrame:
    return last_n(trace, [by], order, 1)


def rate_limit(
    log: DataFrame, by: str = "client_id", ts: str = "ts", tie: str = "request_id",
    tokens: int = 10, seconds: int = 1, burst: int = 20, idle_seconds: float | None = None,
) -> DataFrame:
    """Whether a token bucket per client admits each request."""
    rows = log.select(by, ts, tie, micros(ts).alias("_us"))
    bucket = Bucket(tokens, seconds, burst, idle_seconds)
    return ordered_fold(rows, [by], ["_us", tie], bucket, "_us", replay_bucket, "allowed boolean").drop("_us")
