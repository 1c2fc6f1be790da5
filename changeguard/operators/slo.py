"""Latency and error objectives over request logs, and staged rollouts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeguard.functions.columns import as_column, key_bucket, micros, ratio, slo_breach
from changeguard.operators.bounded import merge_groups
from changeguard.operators.rank import Nested, interpolated, nearest_rank, order_statistics
from changeguard.plans.plan import CANARY_STEPS, Slo

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def latency_report(log: DataFrame, latency: str, is_error: Column, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: successes, errors, throughput per second, mean, p50, p95, p99, max.

    Latencies are those of successes. Percentiles are nearest rank with index
    min(int(p * n), n - 1).
    """
    good = ~F.coalesce(is_error, F.lit(False))
    ok_latency = F.when(good, F.col(latency))
    base = log.groupBy(*by).agg(
        F.count(ok_latency).alias("n"), F.count_if(is_error).alias("errors"),
        ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("elapsed_s"),
        F.avg(ok_latency).alias("mean"), F.max(ok_latency).alias("max"),
    )
    ranks = order_statistics(
        log.select(*by, ok_latency.alias("_lat")), by, "_lat", {k: nearest_rank(p) for k, p in QUANTILES.items()}
    ).drop("n")
    both = merge_groups(by, base, ranks)
    rate = F.when(F.col("elapsed_s") > 0, F.col("n") / F.col("elapsed_s"))
    return both.select(*by, "n", "errors", "elapsed_s", rate.alias("throughput"), "mean", *QUANTILES, "max")


def p_cont(log: DataFrame, latency: str, q: float = 0.99, by: Sequence[str] = (), name: str = "p") -> DataFrame:
    """Exact interpolated percentile. For a trailing window filter the log first."""
    return interpolated(log, by, latency, q, name)


def p_approx(log: DataFrame, latency: str, q: float = 0.99, by: Sequence[str] = (), name: str = "p", accuracy: int = 10_000) -> DataFrame:
    """One-pass percentile with bounded memory and a rank error of 1/accuracy."""
    return log.groupBy(*by).agg(F.count(latency).alias("n"), F.percentile_approx(latency, q, accuracy).alias(name))


def trailing(log: DataFrame, ts: str, as_of: Column, seconds: int) -> DataFrame:
    """Rows of the last ``seconds`` before ``as_of``; later rows are left out."""
    t = F.col(ts)
    return log.filter((t > as_of - F.make_dt_interval(secs=F.lit(seconds))) & (t <= as_of))


def error_rate(log: DataFrame, is_error: Column, by: Sequence[str] = ()) -> DataFrame:
    counts = log.groupBy(*by).agg(F.count_if(is_error).alias("errors"), F.count("*").alias("total"))
    return counts.withColumn("error_rate", ratio("errors", "total", 0.0))


def slo_gate(obs: DataFrame, slo: Slo, p99: str = "p99_ms", err: str = "err_pct") -> DataFrame:
    """Adds ``slo_breached`` and ``reason``."""
    breached, why = slo_breach(p99, err, slo.max_p99_latency_ms, slo.max_error_rate_pct)
    return obs.withColumns({"slo_breached": breached, "reason": why})


def lag_gate(df: DataFrame, slo: Slo, lag: str = "max_lag_ms") -> DataFrame:
    """Replication lag against the latency limit: above it no start, above twice
    wait before a step, above three times fail."""
    x, limit = F.coalesce(as_column(lag), F.lit(0)), slo.max_p99_latency_ms
    step = F.when(x > 3 * limit, "fail").when(x > 2 * limit, "wait").otherwise("proceed")
    return df.withColumns({"start_blocked": x > limit, "step_action": step})


def cohort_step(bucket: str | Column, steps: Sequence[int]) -> Column:
    """The first step whose cohort contains the bucket; NULL if none does. Cohorts
    are nested: a key in the 5 % cohort is also in the 25 % one."""
    b = as_column(bucket)
    return reduce(lambda tail, s: F.when(b < 100 * s, s).otherwise(tail), sorted(set(steps), reverse=True), F.lit(None).cast("int"))


def canary_run(
    log: DataFrame,
    key: str,
    latency: str,
    is_error: Column,
    slo: Slo,
    steps: Sequence[int] = CANARY_STEPS,
    on_failure: str = "rollback",
    salt: str = "",
) -> DataFrame:
    """One row per traffic step: requests, errors, p99, breach, outcome, decision.

    The first breach stops the run; later steps are ``not_run``. A cohort
    without requests is ``no_data``, which holds the rollout.
    """
    ordered = sorted(set(steps))
    # The hash is a column of its own, so that it is computed once per row.
    hashed = log.select(key_bucket(key, salt).alias("_b"), F.col(latency).alias("_lat"), F.coalesce(is_error, F.lit(False)).alias("_err"))
    if ordered[-1] < 100:
        hashed = hashed.filter(F.col("_b") < 100 * ordered[-1])
    rows = hashed.select(cohort_step("_b", ordered).alias("_first"), "_lat", "_err")
    cohorts = Nested("_first", "step", lambda first: F.filter(F.array(*[F.lit(s) for s in ordered]), lambda s: s >= first))
    counts = (
        cohorts.spread(rows.groupBy("_first").agg(F.count("*").alias("n"), F.count_if("_err").alias("errors")))
        .groupBy("step").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    )
    tails = order_statistics(rows, [], "_lat", {"p99_ms": nearest_rank(0.99)}, nested=cohorts).drop("n")
    plan = log.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in ordered])).alias("step"))
    seen = merge_groups(["step"], plan, counts, tails).withColumn("n", F.coalesce("n", F.lit(0)))
    seen = slo_gate(seen.withColumn("err_pct", F.col("errors") * 100.0 / F.col("n")), slo)

    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # at most 100 steps
    stopped = F.coalesce(F.max("slo_breached").over(w), F.lit(False))
    outcome = (
        F.when(F.col("_stopped"), "not_run").when(F.col("n") == 0, "no_data")
        .when(F.col("slo_breached"), "breach").otherwise("healthy")
    )
    whole = Window.partitionBy()
    decision = (
        F.when(F.max(F.col("outcome") == "breach").over(whole), on_failure)
        .when(F.max(F.col("outcome") == "no_data").over(whole), "hold").otherwise("promote")
    )
    shown = {c: F.when(~F.col("_stopped"), F.col(c)) for c in ("n", "errors", "p99_ms", "err_pct", "slo_breached", "reason")}
    return (
        seen.withColumn("_stopped", stopped).withColumn("outcome", outcome)
        .withColumn("decision", decision)
        .select("step", F.col("step").alias("traffic_pct"), *[e.alias(c) for c, e in shown.items()], "outcome", "decision")
    )
