"""Append-only operational logs, audit lines, reports and streaming reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.sources.commits import CommitLog, is_commit_log

STATE_EVENT = "id long, migration_id string, from_state string, to_state string, detail string, created_at timestamp"
DDL_LOG = (
    "id long, migration_id string, statement string, started_at timestamp, completed_at timestamp, "
    "duration_ms int, success boolean, error_message string, lock_wait_ms int, created_at timestamp"
)
BACKFILL_LOG = (
    "id long, migration_id string, batch_number int, rows_affected int, throttle_ms int, "
    "db_cpu_pct double, db_rep_lag_ms double, db_conns_pct double, created_at timestamp"
)
CANARY_LOG = (
    "id long, migration_id string, step int, traffic_pct int, p99_ms double, err_pct double, "
    "slo_breached boolean, observed_at timestamp"
)
AUDIT_ENTRY = (
    "timestamp timestamp, user string, role string, action string, resource string, resource_id string, "
    "details string, success boolean, error string, ip_address string"
)
LOG_SCHEMAS = {"state": STATE_EVENT, "ddl": DDL_LOG, "backfill": BACKFILL_LOG, "canary": CANARY_LOG}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Bring a frame to a log schema: order, types, missing columns as NULL."""
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def append_log(df: DataFrame, path: str, kind: str, partition_by: str | None = None) -> None:
    """Append rows to one of the logs in ``LOG_SCHEMAS``."""
    writer = conform(df, LOG_SCHEMAS[kind]).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append state events and checkpoint records."""
    append_log(df, path, "state")


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A log in Parquet files or in numbered commits."""
    if is_commit_log(spark, path):
        return CommitLog(spark, path, LOG_SCHEMAS[kind]).read()
    return spark.read.schema(LOG_SCHEMAS[kind]).parquet(path)


def append_all(log: DataFrame, *more: DataFrame) -> DataFrame:
    """One log followed by others; columns are matched by name."""
    for other in more:
        log = log.unionByName(other, allowMissingColumns=True)
    return log


def stream_log(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a folder of Parquet files."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries from log lines; text around the JSON object is ignored."""
    body = F.regexp_extract("value", r"(\{.*\})", 1)
    return (
        spark.read.text(path)
        .select(F.from_json(body, AUDIT_ENTRY).alias("e"))
        .select("e.*")
        .filter(F.col("action").isNotNull())
    )


def audit_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("user", "role", "action", "success").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")
    )


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
