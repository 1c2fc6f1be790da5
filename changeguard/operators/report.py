"""Outcomes, costs and the overview of finished changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.operators.bounded import merge_groups
from changeguard.plans.plan import ROLLED_BACK

# What the same change costs by hand.
ENGINEERS, DAYS_LOW, DAYS_HIGH, HOURS_PER_DAY = 2, 3, 5, 8
RATE = 100.0


def classify_outcome(state: DataFrame, throttle: DataFrame) -> DataFrame:
    """``throttle`` has migration_id and throttle_events."""
    both = state.join(throttle.select("migration_id", "throttle_events"), "migration_id", "left")
    events = F.coalesce("throttle_events", F.lit(0))
    outcome = F.when(F.col("state") == ROLLED_BACK, "rolled_back").when(
        (F.col("state") == "Done") & (events > 0), "throttled").otherwise("success")
    return both.withColumns({"throttle_events": events, "outcome": outcome})


def cost_report(runs: DataFrame, hours: str = "hours", rate: float = RATE) -> DataFrame:
    """Per run the hours and cost of manual work, and what was saved at least."""
    low, high = ENGINEERS * DAYS_LOW * HOURS_PER_DAY, ENGINEERS * DAYS_HIGH * HOURS_PER_DAY
    saved = F.greatest(F.lit(float(low)) - F.col(hours), F.lit(0.0))
    return runs.withColumns({
        "manual_cost_low": F.lit(low * rate), "manual_cost_high": F.lit(high * rate),
        "hours_saved": saved, "cost_saved": saved * rate,
    })


def check_outcomes(results: DataFrame, expected: DataFrame, on: str = "scenario") -> DataFrame:
    """All reasons why a result misses its expectation: ``data_loss`` if rows are
    missing and no loss is allowed, ``downtime`` if it took too long."""
    both = results.join(expected, on)
    reasons = F.array_compact(F.array(
        F.when(~F.col("loss_allowed") & (F.col("final_rows") < F.col("expected_rows")), "data_loss"),
        F.when(F.col("duration_s") > F.col("max_downtime_s"), "downtime"),
    ))
    return both.select(
        *results.columns, F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed")
    )


def health_overview(state: DataFrame, drift: DataFrame, throttle: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per change: outcome, parity in percent, rows verified, drift,
    throttle events, rows and throughput."""
    by = ["migration_id"]
    parts: Mapping[str, DataFrame] = {
        "drift": drift.select(*by, F.col("total").alias("rows_verified"), F.col("drifted").alias("drift_detected"),
                              (F.col("parity") * 100).alias("parity_pct")),
        "runs": runs.select(*by, "rows", "rows_per_s"),
    }
    base = classify_outcome(state, throttle).select(*by, "state", "outcome", "throttle_events")
    return merge_groups(by, base, *parts.values()).filter(F.col("state").isNotNull())
