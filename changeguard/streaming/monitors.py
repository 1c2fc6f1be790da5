"""Windowed monitors over streams. All take and return streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import as_expr, differs, ratio
from changeguard.operators.slo import slo_gate
from changeguard.plans.plan import PARITY_THRESHOLD, Slo


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as TIMESTAMP with a watermark; late rows beyond it are dropped
    and counted in the query progress."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _bounds(df: DataFrame, by: Sequence[str], rest: Sequence) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *rest)


def slo_stream(
    stream: DataFrame, ts: str, latency: str, is_error: Column, slo: Slo, window: str = "1 minute",
    delay: str = "1 minute", by: Sequence[str] = (), accuracy: int = 10_000,
) -> DataFrame:
    """p99, error percent and breach per tumbling window. The percentile is a
    sketch of bounded size, so a window may hold any number of requests."""
    counts = timed(stream, ts, delay).groupBy(F.window(ts, window), *by).agg(
        F.count("*").alias("n"), F.count_if(is_error).alias("errors"),
        F.percentile_approx(latency, 0.99, accuracy).alias("p99_ms"),
    )
    return slo_gate(_bounds(counts, by, ["n", "errors", "p99_ms", (F.col("errors") * 100.0 / F.col("n")).alias("err_pct")]), slo)


def rate_stream(
    stream: DataFrame, ts: str, amount: Column | None = None, window: str = "10 minutes", slide: str = "1 minute",
    delay: str = "1 minute", by: Sequence[str] = (), seconds: float | None = None,
) -> DataFrame:
    """Sum of amounts (rows by default) per sliding window and per second."""
    grown = F.sum(amount) if amount is not None else F.count("*")
    counts = timed(stream, ts, delay).groupBy(F.window(ts, window, slide), *by).agg(grown.alias("increase"))
    width = (F.unix_micros("window_end") - F.unix_micros("window_start")) / 1e6 if seconds is None else F.lit(float(seconds))
    return _bounds(counts, by, ["increase"]).withColumn("rate", F.col("increase") / width)


def heartbeat_sessions(stream: DataFrame, ts: str, by: Sequence[str], gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Runs of heartbeats; a row appears once the service has been silent for the gap."""
    runs = timed(stream, ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("beats"))
    return runs.select(
        *by, F.col("session_window.start").alias("first_beat"), F.col("session_window.end").alias("silent_at"), "beats"
    )


def drift_stream(
    stream: DataFrame, ts: str, column: str, expr: str | Column, window: str = "1 minute", delay: str = "1 minute",
    limit: float = PARITY_THRESHOLD,
) -> DataFrame:
    """Drift report per window with a low-parity flag."""
    counts = timed(stream, ts, delay).groupBy(F.window(ts, window)).agg(
        F.count("*").alias("total"), F.count_if(F.col(column).isNull()).alias("nulls"),
        F.count_if(differs(column, as_expr(expr))).alias("drifted"),
    )
    parity = ratio(F.col("total") - F.col("drifted"), "total", 1.0)
    return _bounds(counts, [], ["total", "nulls", "drifted", parity.alias("parity")]).withColumn(
        "low_parity", F.col("parity") < limit)


def dedup_stream(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 minute") -> DataFrame:
    """The first of several submissions with the same key within the delay."""
    return timed(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def dropped_rows(query) -> int:
    """Rows a running or finished query has dropped as too late, from its recent progress."""
    return sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
