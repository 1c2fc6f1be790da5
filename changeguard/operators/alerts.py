"""Alert rules over state events and metric samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import age_seconds, micros
from changeguard.operators.lifecycle import current_state
from changeguard.operators.metrics import increase
from changeguard.plans.plan import PARITY_THRESHOLD, ROLLED_BACK

# How long a condition must hold, in seconds.
STUCK_S = 600
ROLLBACK_WINDOW_S = 600
PARITY_S = 60
SILENT_S = 60


def _alert(rule: str, severity: str, subject: Column, since: Column, detail: Column) -> list[Column]:
    return [
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"),
        since.alias("since"), detail.cast("string").alias("detail"),
    ]


def stuck(events: DataFrame, as_of: Column, secs: float = STUCK_S) -> DataFrame:
    """Unfinished and not Pending in the same state for at least ``secs``.

    Checkpoints (a move to the same state) do not restart the clock.
    """
    moves = events.filter(~F.col("from_state").eqNullSafe(F.col("to_state")))
    now = current_state(moves).filter(~F.col("terminal") & (F.col("state") != "Pending"))
    held = now.filter(age_seconds("updated_at", as_of) >= secs)
    return held.select(*_alert("stuck", "warning", F.col("migration_id"), F.col("updated_at"), F.col("state")))


def rolled_back(events: DataFrame, as_of: Column, secs: float = ROLLBACK_WINDOW_S) -> DataFrame:
    age = age_seconds("created_at", as_of)
    hits = events.filter((F.col("to_state") == ROLLED_BACK) & (age >= 0) & (age <= secs))
    seen = hits.groupBy("migration_id").agg(F.max("created_at").alias("at"), F.count("*").alias("n"))
    return seen.select(*_alert("rolled_back", "critical", F.col("migration_id"), F.col("at"), F.col("n")))


def counted_rollbacks(counters: DataFrame, as_of: Column, secs: float = ROLLBACK_WINDOW_S, tie: str = "id") -> DataFrame:
    """Rollback counters (``series``, ``ts``, ``value``) that grew within the last
    ``secs``. Resets count as growth from zero; a change that an operator ended
    without the counter raises nothing."""
    age = age_seconds("ts", as_of)
    grown = increase(counters.filter((age >= 0) & (age <= secs)), secs, ["series"], tie=tie)
    last = grown.groupBy("series").agg(F.max("ts").alias("at"), F.max_by("increase", F.struct("ts", tie)).alias("n"))
    return last.filter(F.col("n") > 0).select(*_alert("rolled_back", "critical", F.col("series"), F.col("at"), F.col("n")))


def low_parity(samples: DataFrame, as_of: Column, secs: float = PARITY_S, limit: float = PARITY_THRESHOLD) -> DataFrame:
    """Series (``series``, ``ts``, ``value``) below the limit for at least ``secs`` without a break."""
    last_good = samples.groupBy("series").agg(F.max(F.when(F.col("value") >= limit, F.col("ts"))).alias("_good"))
    bad = samples.join(last_good, "series").filter(
        (F.col("value") < limit) & (F.col("_good").isNull() | (F.col("ts") > F.col("_good"))))
    run = bad.groupBy("series").agg(F.min("ts").alias("since"), F.max_by("value", "ts").alias("now"))
    return run.filter(age_seconds("since", as_of) >= secs).select(
        *_alert("low_parity", "critical", F.col("series"), F.col("since"), F.format_string("%.4f", "now")))


def silent(samples: DataFrame, as_of: Column, secs: float = SILENT_S) -> DataFrame:
    """Series without a sample for at least ``secs``."""
    last = samples.groupBy("series").agg(F.max("ts").alias("last"))
    return last.filter(age_seconds("last", as_of) >= secs).select(
        *_alert("silent", "critical", F.col("series"), F.col("last"),
                F.floor((micros(as_of) - micros("last")) / 1e6).cast("long")))


def alerts(events: DataFrame, samples: DataFrame, as_of: Column, parity_limit: float = PARITY_THRESHOLD, counters: DataFrame | None = None) -> DataFrame:
    """All rules at one moment, one row per alert. Rollbacks are read from their
    counter if it is given, else from the events."""
    undone = rolled_back(events, as_of) if counters is None else counted_rollbacks(counters, as_of)
    rules = [
        stuck(events, as_of), undone, low_parity(samples, as_of, limit=parity_limit), silent(samples, as_of),
    ]
    return reduce(DataFrame.unionByName, rules)
