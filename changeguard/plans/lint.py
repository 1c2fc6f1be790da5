"""Check a catalog of plan documents in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import is_identifier
from changeguard.plans.plan import ON_FAILURE, STRATEGY

PLAN_SCHEMA = (
    "id string, version int, `table` string, strategy string, expand array<string>, "
    "backfill struct<column: string, batch_size: int, throttle_ms: int, source_expr: string>, "
    "verify struct<mode: string, parity_threshold: double, sample_rate: double>, "
    "canary struct<steps: array<int>, bake_seconds: int>, "
    "slo struct<max_p99_latency_ms: int, max_error_rate_pct: double, min_parity: double>, "
    "contract array<string>, rollback array<string>, on_failure string, "
    "add_columns array<struct<name: string, type: string, expression: string, nullable: boolean, indexed: boolean>>, "
    "drop_columns array<string>"
)


def lint_plans(plans: DataFrame, text: str = "plan", key: str = "id") -> DataFrame:
    """One row per violation: key and rule. ``text`` holds the plan as JSON."""
    doc = plans.select(F.col(key).alias("_key"), F.from_json(text, PLAN_SCHEMA).alias("p"))

    def empty(c):
        return F.coalesce(F.trim(c), F.lit("")) == ""

    def none_in(c):
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    p = F.col("p")
    column = p["backfill"]["column"]
    rules = {
        "unreadable": p.isNull() | (F.coalesce(*[p[c] for c in ("id", "table", "strategy", "on_failure")]).isNull()
                                    & p["version"].isNull()),
        "id_missing": empty(p["id"]),
        "version_not_positive": F.coalesce(p["version"], F.lit(0)) <= 0,
        "table_missing": empty(p["table"]),
        "table_not_identifier": ~empty(p["table"]) & ~is_identifier(p["table"]),
        "column_not_identifier": ~empty(column) & ~is_identifier(column),
        "expression_missing": ~empty(column) & empty(p["backfill"]["source_expr"]),
        "strategy_unsupported": ~empty(p["strategy"]) & (p["strategy"] != STRATEGY),
        "nothing_to_expand": none_in(p["expand"]) & none_in(p["add_columns"]) & none_in(p["drop_columns"]),
        "step_out_of_range": F.coalesce(F.exists(p["canary"]["steps"], lambda s: (s <= 0) | (s > 100)), F.lit(False)),
        "on_failure_invalid": ~empty(p["on_failure"]) & ~p["on_failure"].isin(*ON_FAILURE),
    }
    found = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    only_unreadable = F.when(F.array_contains(found, "unreadable"), F.array(F.lit("unreadable"))).otherwise(found)
    return doc.select(F.col("_key").alias(key), F.explode(only_unreadable).alias("rule"))
