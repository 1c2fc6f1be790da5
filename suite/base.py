"""Registry of checked queries, and the input frames derived from the test tables.

Each frame exists twice: as a Spark DataFrame and as SQL for the comparison
engine. Damage that the operators must find (NULLs, drifted values, missing and
repeated rows) is put in by rules on the key, since the tables have none. All
frames use every row of their table and grow with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeguard.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Frames of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SHARED:
            text, tables = SHARED[name]
            return self.spark.sql(text, **{t: self.table(t) for t in tables})
        if name in SPARK_FRAMES:
            return SPARK_FRAMES[name](self)
        raise AttributeError(name)


def check(sql: str | None = None, frames: str = "", name: str | None = None):
    """Register a query; ``frames`` are the derived inputs its SQL refers to."""

    def add(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Inputs(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            parts = [f"{n} AS ({duck_frame(n)})" for n in frames.split()]
            body = sql.strip()
            if parts and body.startswith("WITH "):
                parts.append(body[5:])
                ORACLES[key] = "WITH RECURSIVE " + ", ".join(parts)
            else:
                ORACLES[key] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body
        return fn

    return add


def duck_frame(name: str) -> str:
    if name in SHARED:
        text, tables = SHARED[name]
        for t in tables:
            text = text.replace("{" + t + "}", t)
        return text.replace("{{", "{").replace("}}", "}")
    return DUCK_FRAMES[name]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating point columns at a fixed number of digits."""
    return df.select(*[
        F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


SIZE_CLASS = "CASE WHEN weight < 10 THEN 'light' WHEN weight < 30 THEN 'standard' ELSE 'freight' END"

# Frames whose SQL runs in both engines.
SHARED: dict[str, tuple[str, tuple[str, ...]]] = {
    "drift_target": ("""
        SELECT p_partkey AS id, p_size AS weight, p_brand AS brand,
               concat('legacy-tier-', cast(p_partkey % 3 AS string)) AS legacy_shipping,
               CASE WHEN p_partkey % 97 = 5 THEN NULL WHEN p_partkey % 89 = 7 THEN 'wrong'
                    WHEN p_size < 10 THEN 'light' WHEN p_size < 30 THEN 'standard' ELSE 'freight' END AS shipping_class
        FROM {part}""", ("part",)),
    "backfill_target": ("""
        SELECT o_orderkey AS id, o_totalprice AS amount,
               CASE WHEN o_orderkey % 3 = 0 THEN 'preset' END AS tier,
               CASE WHEN o_orderkey % 4 = 0 THEN 'kept' END AS band,
               CASE WHEN o_orderkey % 7 = 0 THEN 'pending' ELSE 'processed' END AS status
        FROM {orders}""", ("orders",)),
    "backfill_fresh": ("""
        SELECT o_orderkey AS id, o_totalprice AS amount,
               CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END END AS tier,
               CASE WHEN o_orderkey % 7 = 0 THEN 'pending' ELSE 'processed' END AS status,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('b', cast(o_orderkey % 10 AS string)) END AS band
        FROM {orders}""", ("orders",)),
    "orders_dst": ("""
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 103 = 4 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 107 = 5 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM {orders} WHERE o_orderkey % 101 <> 3
        UNION ALL
        SELECT o_orderkey + 10000000, o_custkey + 10000000, o_totalprice, o_orderpriority
        FROM {orders} WHERE o_orderkey % 1009 = 0""", ("orders",)),
    "requests": ("""
        SELECT event_id AS request_id, ts, user_id AS client_id, event_type AS route, value AS duration_ms,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code
        FROM {events}""", ("events",)),
    "health_samples": ("""
        SELECT user_id % 10 AS target, event_id AS id, ts, 100 AS max_conns,
               CASE WHEN hour(ts) < 4 THEN 100 ELSE event_id % 60 END AS active_conns,
               CASE WHEN hour(ts) < 4 THEN cast(5000 AS double) ELSE value END AS max_lag_ms,
               CASE WHEN hour(ts) < 4 THEN 20 ELSE event_id % 4 END AS waiting_queries,
               CASE WHEN hour(ts) < 4 THEN 2000000 ELSE (event_id * 137) % 300000 END AS dead_tuples
        FROM {events}""", ("events",)),
    "batch_log": ("""
        SELECT user_id AS migration_id, event_id AS id, event_type AS stage,
               cast(floor(value * 10) AS bigint) AS rows_affected, event_id % 50 AS throttle_ms,
               value AS duration_ms, event_type = 'error' AS failed, ts AS created_at
        FROM {events}""", ("events",)),
    "batch_runs": ("""
        SELECT event_id AS id, user_id AS migration_id, ts AS started_at,
               CASE WHEN event_type <> 'error' THEN ts END AS completed_at
        FROM {events}""", ("events",)),
    "heartbeats": ("""
        SELECT event_id AS id, user_id % 5 AS migration_id, concat('svc-', cast(user_id AS string)) AS service_name,
               user_id % 3 AS schema_version, user_id % 4 <> 0 AS compatible, ts AS recorded_at
        FROM {events}""", ("events",)),
    "activity": ("""
        SELECT event_id AS pid, user_id % 8 AS host,
               CASE WHEN event_type IN ('click', 'error') THEN 'active' WHEN event_type = 'view' THEN 'idle'
                    ELSE 'idle in transaction' END AS state,
               concat('app-', cast(user_id % 20 AS string)) AS application_name,
               CASE WHEN event_type = 'error' THEN 'Lock' WHEN event_type = 'view' THEN 'Client' END AS wait_event_type,
               concat('query ', cast(event_id % 100 AS string)) AS query, ts AS query_start
        FROM {events}""", ("events",)),
    "locks": ("""
        SELECT user_id AS pid, CASE WHEN event_id % 2 = 0 THEN 'relation' ELSE 'tuple' END AS locktype,
               cast(1 AS bigint) AS database, CASE WHEN user_id % 17 <> 0 THEN event_id % 90 END AS relation,
               CASE WHEN event_id % 2 = 1 THEN event_id % 3 END AS page, cast(NULL AS bigint) AS tuple,
               cast(NULL AS string) AS virtualxid, cast(NULL AS bigint) AS transactionid, cast(NULL AS bigint) AS classid,
               cast(NULL AS bigint) AS objid, cast(NULL AS bigint) AS objsubid, event_type <> 'error' AS granted
        FROM {events}""", ("events",)),
    "lock_activity": ("SELECT user_id AS pid, max(props) AS query FROM {events} GROUP BY user_id", ("events",)),
    "replicas": ("""
        SELECT s_name AS replica, s_nationkey AS site, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS lag_ms
        FROM {supplier}""", ("supplier",)),
    "counters": ("""
        SELECT user_id AS series, event_id AS id, ts, event_id % 1000 AS value FROM {events}""", ("events",)),
    "parity_samples": ("""
        SELECT concat('plan-', cast(user_id AS string)) AS series, ts,
               CASE WHEN value > 40 THEN cast(1 AS double) ELSE cast(0.99 AS double) END AS value
        FROM {events}""", ("events",)),
    "plan_docs": ("""
        SELECT p_partkey AS id, CASE WHEN p_partkey % 41 = 0 THEN 'not json' ELSE concat(
            '{{"id": "', CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END,
            '", "version": ', cast(p_partkey % 7 AS string),
            ', "table": "', CASE WHEN p_partkey % 13 = 0 THEN '1bad' WHEN p_partkey % 17 = 0 THEN '' ELSE 'part' END,
            '", "strategy": "', CASE WHEN p_partkey % 19 = 0 THEN 'big-bang' ELSE 'expand-contract' END,
            '", "expand": [', CASE WHEN p_partkey % 23 = 0 THEN '' ELSE '"add"' END,
            '], "backfill": {{"column": "', CASE WHEN p_partkey % 5 = 0 THEN 'size class' ELSE 'size_class' END,
            '", "source_expr": "', CASE WHEN p_partkey % 29 = 0 THEN '' ELSE 'p_size' END,
            '"}}, "canary": {{"steps": [1, ', cast(p_partkey % 120 AS string),
            ']}}, "on_failure": "', CASE WHEN p_partkey % 31 = 0 THEN 'retry' ELSE 'pause' END, '"}}') END AS plan
        FROM {part}""", ("part",)),
    "scenario_results": ("""
        SELECT c_custkey AS run_id, c_nationkey AS scenario, abs(c_acctbal) / 100 AS duration_s,
               10000 - c_custkey % 3 AS final_rows
        FROM {customer}""", ("customer",)),
    "scenario_limits": ("""
        SELECT n_nationkey AS scenario, cast(10 + n_nationkey * 2 AS double) AS max_downtime_s,
               n_regionkey = 0 AS loss_allowed, cast(10000 AS bigint) AS expected_rows
        FROM {nation}""", ("nation",)),
    "runs": ("SELECT o_orderkey AS run_id, o_totalprice / 10000 AS hours FROM {orders}", ("orders",)),
    "table_stats": ("""
        SELECT c_custkey AS table_id, cast(floor(abs(c_acctbal) * 10000) AS bigint) AS row_count,
               cast(60 + c_custkey % 600 AS double) AS target_s, cast(0.5 + c_custkey % 9 AS double) AS batch_s
        FROM {customer}""", ("customer",)),
    "migrations": ("""
        SELECT o_orderkey AS migration_id, concat('plan-', cast(o_custkey AS string)) AS plan_id,
               cast(o_orderkey % 10 AS int) AS version, o_orderdate AS created_at
        FROM {orders}""", ("orders",)),
    "submissions": ("""
        SELECT o_orderkey + 50000000 AS migration_id, concat('plan-', cast(o_custkey AS string)) AS plan_id,
               cast((o_orderkey + o_custkey) % 12 AS int) AS version, o_orderdate AS created_at
        FROM {orders}""", ("orders",)),
    "audit_rows": ("""
        SELECT event_id, ts, concat('user', cast(user_id % 30 AS string)) AS user_name, CASE WHEN user_id % 3 = 0 THEN 'admin' ELSE 'operator' END AS role,
               event_type AS action, event_id % 4 <> 0 AS success
        FROM {events}""", ("events",)),
}

PATHS = {
    "full": ["Pending", "Expanding", "Backfilling", "Verifying", "Canary", "Cutover", "Contracting", "Done"],
    "back": ["Pending", "Expanding", "Backfilling", "Backfilling", "Verifying", "Canary", "RollingBack", "RolledBack"],
    "stuck": ["Pending", "Expanding", "Backfilling", "Backfilling", "Backfilling"],
    "abort": ["Pending", "Expanding", "Backfilling", "RolledBack"],
}


def _path(text: Callable[[list[str]], str]) -> str:
    return (
        f"CASE WHEN o_orderkey % 5 = 0 THEN {text(PATHS['back'])} WHEN o_orderkey % 7 = 0 THEN {text(PATHS['stuck'])} "
        f"WHEN o_orderkey % 13 = 4 THEN {text(PATHS['abort'])} ELSE {text(PATHS['full'])} END"
    )


def _quoted(states: list[str]) -> str:
    return ", ".join(f"'{s}'" for s in states)


def _state_log(i: Inputs) -> DataFrame:
    path = F.expr(_path(lambda p: f"array({_quoted(p)})"))
    rows = i.table("orders").select("o_orderkey", "o_orderdate", path.alias("path"))
    rows = rows.select("*", F.posexplode("path").alias("at", "to_state"))
    pos = F.col("at") + 1
    event = F.col("o_orderkey") * 10 + pos
    before = F.when(event % 211 == 0, "Cutover").when(F.col("at") > 0, F.get("path", F.col("at") - 1))
    return rows.select(
        F.col("o_orderkey").alias("migration_id"), event.alias("id"), before.alias("from_state"), "to_state",
        F.expr("timestampadd(MINUTE, cast((at + 1) * (1 + o_orderkey % 9) AS int), o_orderdate)").alias("created_at"),
    )


def _ddl_log(i: Inputs) -> DataFrame:
    return i.spark.sql(
        DDL_SQL.format(
            started="timestampadd(SECOND, cast(o_orderkey % 3600 AS int), o_orderdate)",
            ended="timestampadd(MILLISECOND, cast(1000 * (o_orderkey % 3600) + o_orderkey % 5000 AS int), o_orderdate)",
            orders="{orders}",
        ), orders=i.table("orders"))


DDL_SQL = """
    SELECT o_orderkey AS id, o_custkey AS migration_id,
           concat(CASE WHEN o_orderkey % 4 = 0 THEN 'ALTER TABLE orders ADD COLUMN c'
                       WHEN o_orderkey % 4 = 1 THEN 'create index concurrently idx_on_a_rather_long_index_name_that_goes_on_and_on_for_more_than_one_hundred_characters_c'
                       WHEN o_orderkey % 4 = 2 THEN 'ALTER TABLE orders DROP COLUMN c' ELSE 'ANALYZE t' END,
                  cast(o_orderkey % 2 AS varchar(9))) AS statement,
           {started} AS started_at, {ended} AS completed_at, o_orderkey % 5000 AS duration_ms,
           o_orderkey % 3 <> 0 AS success
    FROM {orders}"""

SPARK_FRAMES: dict[str, Callable[[Inputs], DataFrame]] = {"state_log": _state_log, "ddl_log": _ddl_log}

DUCK_FRAMES: dict[str, str] = {
    "state_log": f"""
        SELECT o_orderkey AS migration_id, o_orderkey * 10 + pos AS id,
               CASE WHEN (o_orderkey * 10 + pos) % 211 = 0 THEN 'Cutover' WHEN pos > 1 THEN path[pos - 1] END AS from_state,
               path[pos] AS to_state, o_orderdate + to_minutes(cast(pos * (1 + o_orderkey % 9) AS bigint)) AS created_at
        FROM (SELECT *, unnest(range(1, len(path) + 1)) AS pos
              FROM (SELECT o_orderkey, o_orderdate, {_path(lambda p: f"[{_quoted(p)}]")} AS path FROM orders))""",
    "ddl_log": DDL_SQL.format(
        started="o_orderdate + to_seconds(o_orderkey % 3600)",
        ended="o_orderdate + to_milliseconds(1000 * (o_orderkey % 3600) + o_orderkey % 5000)", orders="orders"),
    "registry": """
        SELECT migration_id, service_name, arg_max(schema_version, id) AS schema_version,
               arg_max(compatible, id) AS compatible, min(recorded_at) AS registered_at, max(recorded_at) AS last_heartbeat
        FROM heartbeats GROUP BY ALL""",
    "current_state": """
        SELECT migration_id, arg_max(to_state, id) AS state, max(created_at) AS updated_at,
               arg_max(to_state, id) IN ('Done', 'RolledBack') AS terminal
        FROM state_log GROUP BY migration_id""",
    "drift_rows": f"SELECT *, shipping_class IS DISTINCT FROM ({SIZE_CLASS}) AS drifted FROM drift_target",
    "scored": """
        SELECT *, (1.0::double - active_conns::double / max_conns::double) * 0.3::double
               + (CASE WHEN max_lag_ms > 0 THEN greatest(0.0::double, 1.0::double - max_lag_ms / 1000.0::double) ELSE 1.0::double END) * 0.3::double
               + (CASE WHEN waiting_queries > 0 THEN greatest(0.0::double, 1.0::double - waiting_queries::double / 10.0::double) ELSE 1.0::double END) * 0.2::double
               + (CASE WHEN dead_tuples > 1000000 THEN 0.5::double WHEN dead_tuples > 100000 THEN 0.75::double ELSE 1.0::double END) * 0.2::double AS score
        FROM health_samples""",
}


def current_state_frame(i: Inputs) -> DataFrame:
    from changeguard.operators.lifecycle import current_state

    return current_state(i.state_log)


def registry_frame(i: Inputs) -> DataFrame:
    from changeguard.operators.registry import registry_from_heartbeats

    return registry_from_heartbeats(i.heartbeats)


def latest(df: DataFrame, ts: str):
    """The newest time in a frame, as a literal: the clock of age rules."""
    return F.lit(df.agg(F.max(ts).cast("timestamp")).first()[0])


SPARK_FRAMES["current_state"] = current_state_frame
SPARK_FRAMES["registry"] = registry_frame
