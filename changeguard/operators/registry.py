"""Services taking part in a change: readiness, liveness, schema versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import age_seconds
from changeguard.operators.ordered import scan

LIST_ROWS = 10_000


def chunked_list(df: DataFrame, by: Sequence[str], value: str, name: str, limit: int = LIST_ROWS) -> DataFrame:
    """All values of each group in sorted arrays of at most ``limit``: one row per
    group and ``chunk``, counted from 0, so that no value is lost and no array grows
    with its group."""
    numbered = scan(df.select(*by, F.col(value).alias("_v")), by, ["_v"], number="_n")
    return numbered.groupBy(*by, F.floor((F.col("_n") - 1) / limit).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list("_v")).alias(name))


def registry_from_heartbeats(beats: DataFrame) -> DataFrame:
    """Current row per service: version and compatibility of the latest heartbeat."""
    at = F.struct("recorded_at", "id")
    return beats.groupBy("migration_id", "service_name").agg(
        F.max_by("schema_version", at).alias("schema_version"), F.max_by("compatible", at).alias("compatible"),
        F.min("recorded_at").alias("registered_at"), F.max("recorded_at").alias("last_heartbeat"),
    )


def service_readiness(reg: DataFrame, by: str = "migration_id") -> DataFrame:
    """``all_ready`` needs at least one service."""
    counts = reg.groupBy(by).agg(F.count("*").alias("total"), F.count_if("compatible").alias("ready"))
    return counts.withColumns({
        "not_ready": F.col("total") - F.col("ready"),
        "all_ready": (F.col("total") == F.col("ready")) & (F.col("total") > 0),
    })


def dead_services(reg: DataFrame, as_of, secs: float) -> DataFrame:
    """Services whose last heartbeat is older than ``secs``, one row each."""
    return reg.withColumn("silent_s", age_seconds("last_heartbeat", as_of)).filter(F.col("silent_s") > secs)


def liveness(reg: DataFrame, as_of, secs: float, by: str = "migration_id", list_limit: int = LIST_ROWS) -> DataFrame:
    """Per change: services, dead ones, alive, and the sorted names of the dead.

    A change has one row per ``list_limit`` dead services, numbered by ``chunk``;
    the counts are those of the whole change in each.
    """
    late = age_seconds("last_heartbeat", as_of) > secs
    counts = reg.groupBy(by).agg(F.count("*").alias("services"), F.count_if(late).alias("dead"))
    names = chunked_list(dead_services(reg, as_of, secs), [by], "service_name", "dead_services", list_limit)
    none = F.array().cast("array<string>")
    return counts.join(names, by, "left").select(
        by, F.coalesce("chunk", F.lit(0)).alias("chunk"), "services", "dead", (F.col("dead") == 0).alias("alive"),
        F.coalesce("dead_services", none).alias("dead_services"),
    )


def service_versions(reg: DataFrame, by: str = "migration_id", list_limit: int = LIST_ROWS) -> DataFrame:
    """Map service -> version per change, one row per ``list_limit`` services in
    the order of their names, numbered by ``chunk``."""
    numbered = scan(reg.select(by, "service_name", "schema_version"), [by], ["service_name"], number="_n")
    chunk = F.floor((F.col("_n") - 1) / list_limit).cast("int").alias("chunk")
    pairs = numbered.groupBy(by, chunk).agg(F.collect_list(F.struct("service_name", "schema_version")).alias("_l"))
    return pairs.select(by, "chunk", F.map_from_entries("_l").alias("versions"))


def versions_in_use(reg: DataFrame, by: str = "migration_id") -> DataFrame:
    return reg.groupBy(by, "schema_version").agg(F.count("*").alias("services"))


def upsert(cur: DataFrame, upd: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``upd`` replace rows with the same key; columns in ``keep`` stay as
    they were once set. Keys are unique on both sides."""
    c, u = cur.alias("c"), upd.alias("u")
    on = None
    for k in key:
        same = F.col(f"c.{k}") == F.col(f"u.{k}")
        on = same if on is None else on & same
    touched = F.col(f"u.{key[0]}").isNotNull()

    def pick(name):
        old, new = F.col(f"c.{name}"), F.col(f"u.{name}")
        if name in key:
            return F.coalesce(old, new)
        return F.coalesce(old, new) if name in keep else F.when(touched, new).otherwise(old)

    return c.join(u, on, "full_outer").select(*[pick(n).alias(n) for n in cur.columns])
