"""Backfill runs: progress, throughput, stalls, and their DDL statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import age_seconds, as_column, micros, shorten
from changeguard.operators.bounded import merge_groups
from changeguard.operators.lifecycle import asof
from changeguard.operators.ordered import choose_cut, scan
from changeguard.operators.rank import nearest_rank, order_statistics

# Retries and their waits.
RETRY_BASE_S = 1.0
RETRY_ATTEMPTS = 3
STATEMENT_CHARS = 100


def progress_curve(log: DataFrame, total: str | None = None, key: str = "migration_id", order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Each batch with rows so far, percent of all rows, gap to the batch before
    in seconds and rows per second in that gap. ``total`` names a column with the
    planned rows; without it the rows of the log are the whole."""
    whole = {} if total else {"_total": F.col("rows_affected").cast("long")}
    rows = scan(log, [key], order, running={"rows_so_far": F.col("rows_affected").cast("long")},
                lag={"_before": F.col(order[0])}, total=whole)
    total = total or "_total"
    gap = (micros(order[0]) - micros("_before")) / 1e6
    return rows.withColumn("gap_s", gap).select(
        *log.columns, "rows_so_far",
        F.when(F.col(total) > 0, F.col("rows_so_far") * 100.0 / F.col(total)).otherwise(0.0).alias("pct"),
        "gap_s", F.when(F.col("gap_s") > 0, F.col("rows_affected") / F.col("gap_s")).alias("rows_per_s"),
    )


def stalled_batches(log: DataFrame, as_of, secs: float = 300) -> DataFrame:
    """Started, not completed, and older than ``secs``."""
    return log.filter(F.col("completed_at").isNull() & (age_seconds("started_at", as_of) > secs))


def attach_health(batches: DataFrame, health: DataFrame, key: str, take: dict[str, str], ts: str = "created_at") -> DataFrame:
    """Batches with the latest health sample at or before them."""
    return asof(batches, health, key, ts, "ts", take, "id", "id")


def run_summary(
    batches: DataFrame, by: Sequence[str] = ("stage",), rows: str = "rows_affected", ms: str = "duration_ms",
    ts: str = "created_at", failed: Column | None = None, lag_ms: str | None = None,
) -> DataFrame:
    """Rows, batches, rows per second of batch time, mean, p99 and longest batch,
    errors and largest lag per stage. Failed batches count only as errors."""
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    good_ms, good_rows = F.when(~bad, F.col(ms)), F.when(~bad, F.col(rows))
    base = batches.groupBy(*by).agg(
        F.coalesce(F.sum(good_rows.cast("long")), F.lit(0)).alias("rows"), F.count(good_ms).alias("batches"),
        ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("elapsed_s"),
        F.avg(good_ms).alias("mean_ms"), F.max(good_ms).alias("max_ms"), F.count_if(bad).alias("errors"),
        (F.max(lag_ms) if lag_ms else F.lit(None).cast("double")).alias("max_lag_ms"),
    )
    tail = order_statistics(batches.select(*by, good_ms.alias("_ms")), by, "_ms", {"p99_ms": nearest_rank(0.99)}).drop("n")
    rate = F.when(F.col("elapsed_s") > 0, F.col("rows") / F.col("elapsed_s"))
    return merge_groups(by, base, tail).select(
        *by, "rows", "batches", "elapsed_s", rate.alias("rows_per_s"), "mean_ms", "p99_ms", "max_ms", "errors", "max_lag_ms"
    )


def classify_ddl(log: DataFrame, statement: str = "statement") -> DataFrame:
    """Adds ``is_concurrent``, ``kind`` (destructive / additive / other) and a shortened text."""
    up = F.upper(as_column(statement))
    kind = F.when(up.rlike(r"\bDROP\b|\bTRUNCATE\b|\bDELETE\b"), "destructive").when(
        up.rlike(r"\bADD\b|\bCREATE\b"), "additive").otherwise("other")
    return log.withColumns({
        "is_concurrent": up.contains("CONCURRENTLY"), "kind": kind, "short_statement": shorten(statement, STATEMENT_CHARS),
    })


def ddl_summary(log: DataFrame, by: Sequence[str] = ("migration_id", "statement")) -> DataFrame:
    """Attempts, failures, total and longest duration, and whether the last
    attempt succeeded after failures."""
    last = F.max_by("success", F.struct("started_at", "id"))
    return log.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.count_if(~F.col("success")).alias("failures"),
        F.sum("duration_ms").cast("long").alias("total_ms"), F.max("duration_ms").alias("max_ms"), last.alias("last_success"),
    ).withColumn("recovered", F.col("last_success") & (F.col("failures") > 0))


def retry_sequences(log: DataFrame, by: Sequence[str] = ("migration_id", "statement")) -> DataFrame:
    """Attempts of a statement until it succeeds: number, wait before it, the
    wait that exponential backoff asks for, and how the sequence ended."""
    order = ["started_at", "id"]
    cut = choose_cut(log, by, order)
    rows = scan(
        log, by, order, number="_rn", lag={"_ok_before": F.col("success"), "_ended": F.col("completed_at")},
        lead={"_next": F.col("id")}, cut=cut,
    )
    opens = (F.col("_rn") == 1) | F.coalesce(F.col("_ok_before"), F.lit(False))
    closes = F.col("success") | F.col("_next").isNull()
    rows = scan(
        rows.withColumns({"_opens": opens, "_closes": closes}), by, order,
        fill={"_start": F.when(F.col("_opens"), F.col("_rn"))},
        fill_next={"final_success": F.when(F.col("_closes"), F.col("success"))}, cut=cut,
    )
    attempt = F.col("_rn") - F.col("_start") + 1
    retry = attempt > 1
    return rows.select(
        *log.columns, attempt.alias("attempt"),
        F.when(retry, (micros("started_at") - micros("_ended")) / 1e6).alias("wait_s"),
        F.when(retry, RETRY_BASE_S * F.pow(F.lit(2.0), attempt - 2)).alias("expected_wait_s"),
        "final_success",
    )
