"""Percentiles of trailing windows from stored panes: the log is read once, every window is merged from small sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import micros

#: Size of a sketch; its rank error is below RANK_ERROR of the rows with 99 % confidence, also after merging.
SKETCH_K, RANK_ERROR = 800, 0.01


def percentile_panes(log: DataFrame, ts: str, latency: str, seconds: int = 60, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """One row per group and pane: ``pane`` (its number since the epoch), ``n`` and the ``sketch`` of the latencies.

    Rows without a latency do not count. Panes of later rows can be appended; a pane may have several rows.
    """
    rows = log.filter(F.col(latency).isNotNull() & F.col(ts).isNotNull())
    pane = F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")
    return rows.groupBy(*by, pane.alias("pane")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"))


def _merged(panes: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    return panes.groupBy(*by, "pane").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def _moved(panes: DataFrame, by: Sequence[str], steps: int) -> DataFrame:
    return panes.select(*by, (F.col("pane") + steps).alias("pane"), "n", "sketch")


def trailing_percentiles(panes: DataFrame, width: int, q: float = 0.99, by: Sequence[str] = (), seconds: int = 60, name: str = "p99", k: int = SKETCH_K) -> DataFrame:
    """Per group and pane that has rows: ``window_end``, ``n`` and the percentile of the trailing ``width`` panes.

    The value's rank is within ``RANK_ERROR`` of the wanted one. Runs of 1, 2, 4, ... panes are merged from two halves each and
    a window from the runs of its binary digits, so a pane is merged about 2 log2(width) times, not ``width`` times.
    """
    by = list(by)
    ends = panes.select(*by, "pane").distinct()
    run, size, covered, window = _merged(panes, by, k), 1, 0, None
    while True:
        # ``run`` holds for each end the trailing ``size`` panes; the window takes it behind the panes it has already.
        if width & size:
            part = _moved(run, by, covered)
            window = part if window is None else window.unionByName(part)
            covered += size
        if covered == width:
            break
        run = _merged(run.unionByName(_moved(run, by, size)), by, k)
        size *= 2
    merged = _merged(window, by, k).withColumnRenamed("pane", "_pane")
    # Runs reach beyond panes that have rows; NULL groups match.
    same = F.col("_pane") == F.col("pane")
    for c in by:
        merged = merged.withColumnRenamed(c, f"_{c}")
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    found = ends.join(merged, same)
    return found.select(*by, F.timestamp_micros((F.col("pane") + 1) * (seconds * 1_000_000)).alias("window_end"), "n",
                        F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name))
