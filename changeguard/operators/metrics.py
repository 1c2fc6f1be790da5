"""Lookups, increases and rates over metric samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import micros
from changeguard.operators.ordered import choose_cut, scan


def _match(labels: Mapping[str, str]) -> Column:
    ok = F.lit(True)
    for k, v in labels.items():
        ok = ok & F.col("labels")[k].eqNullSafe(F.lit(v))
    return ok


def metric_latest(samples: DataFrame, name: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Value of the last matching sample, 0 if there is none."""
    hit = samples.filter((F.col("name") == name) & _match(labels or {}))
    return hit.agg(F.coalesce(F.max_by("value", "seq"), F.lit(0.0)).alias("value"))


def metric_sum(samples: DataFrame, name: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    hit = samples.filter((F.col("name") == name) & _match(labels or {}))
    return hit.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


# Names of the metrics a change reports.
GAUGES = {
    "backfill_total": "migrate_backfill_rows_total",
    "backfill_done": "migrate_backfill_rows_done",
    "parity": "migrate_verify_parity",
    "canary_pct": "migrate_canary_step_pct",
    "cutover_parity": "migrate_cutover_parity",
}
STATE_METRIC = "migrate_state_info"
TRANSITIONS = "migrate_state_transitions_total"
ROLLBACKS = "migrate_rollbacks_total"


def migration_metrics(samples: DataFrame) -> DataFrame:
    """One row per (migration_id, plan_id): latest gauges, percent filled, active
    state, and the rollbacks of the whole plan."""
    undone = samples.filter(F.col("name") == ROLLBACKS).groupBy(F.col("labels")["plan_id"].alias("plan_id")).agg(F.sum("value").alias("rollbacks"))
    rows = samples.withColumns({
        "migration_id": F.col("labels")["migration_id"], "plan_id": F.col("labels")["plan_id"],
    }).filter(F.col("migration_id").isNotNull())

    def last(metric):
        return F.coalesce(F.max_by("value", F.when(F.col("name") == metric, F.col("seq"))), F.lit(0.0))

    active = F.min_by(F.col("labels")["state"], F.when((F.col("name") == STATE_METRIC) & (F.col("value") == 1), F.col("seq")))
    wide = rows.groupBy("migration_id", "plan_id").agg(
        *[last(m).alias(c) for c, m in GAUGES.items()], F.coalesce(active, F.lit("")).alias("state"),
    )
    pct = F.when(F.col("backfill_total") > 0, F.col("backfill_done") / F.col("backfill_total") * 100).otherwise(0.0)
    return wide.withColumn("backfill_pct", pct).join(undone, "plan_id", "left").withColumn("rollbacks", F.coalesce("rollbacks", F.lit(0.0)))


def transition_counts(samples: DataFrame) -> DataFrame:
    """Transitions into each state per plan."""
    return samples.filter(F.col("name") == TRANSITIONS).groupBy(
        F.col("labels")["plan_id"].alias("plan_id"), F.coalesce(F.col("labels")["to_state"], F.lit("")).alias("state")
    ).agg(F.sum("value").alias("transitions"))


def increase(samples: DataFrame, secs: float, by: Sequence[str], ts: str = "ts", value: str = "value", tie: str = "id", name: str = "increase") -> DataFrame:
    """Growth of a counter over the trailing ``secs``, resets taken into account.

    For each sample the growth since the first sample in [ts - secs, ts]. A drop
    is a reset and counts with its new value. A cumulative count is looked up at
    the window start by an ordered pass, so dense windows cost nothing extra.
    """
    by, width = list(by), int(secs * 1_000_000)
    rows = samples.withColumn("_us", micros(ts))
    cut = choose_cut(rows, by, ["_us", tie])
    rows = scan(rows, by, ["_us", tie], lag={"_prev": F.col(value)}, cut=cut)
    grown = F.when(F.col("_prev").isNull(), 0).when(F.col(value) < F.col("_prev"), F.col(value)).otherwise(F.col(value) - F.col("_prev"))
    rows = scan(rows.withColumn("_grown", grown.cast(samples.schema[value].dataType)), by, ["_us", tie], running={"_cum": F.col("_grown")}, cut=cut)
    names = samples.columns
    data = rows.select(*by, F.col("_us").alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.col("_cum").alias("_mark"))
    ask = rows.select(
        *by, (F.col("_us") - width).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
        F.struct(*names, "_cum").alias("_row"),
    )
    line = ask.unionByName(data, allowMissingColumns=True)
    found = scan(line, by, ["_at", "_side", "_tie"], fill_next={"_base": F.col("_mark")})
    return found.filter(F.col("_side") == 0).select("_row.*", (F.col("_row._cum") - F.col("_base")).alias(name)).drop("_cum")


def rate(samples: DataFrame, secs: float, by: Sequence[str], **kw) -> DataFrame:
    """Increase per second of the window."""
    name = kw.pop("name", "rate")
    rows = increase(samples, secs, by, name="_inc", **kw)
    return rows.withColumn(name, F.col("_inc") / F.lit(float(secs))).drop("_inc")
