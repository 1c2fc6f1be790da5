"""Queries over operational logs: lifecycle, runs, registry, metrics, alerts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeguard.functions.columns import micros
from changeguard.operators import alerts as al
from changeguard.operators import lifecycle as lc
from changeguard.operators import metrics as mt
from changeguard.operators import registry as rg
from changeguard.operators import report, runs
from changeguard.operators.parity import drift_scan
from changeguard.plans.lint import lint_plans
from changeguard.plans.plan import FLOW
from changeguard.session import scratch_dir
from changeguard.sources.keyed import KeyedTable
from changeguard.sources.logs import append_all, append_log, audit_summary, read_audit, read_log
from changeguard.sources.metrics_text import read_metric_samples
from suite.base import check, latest, rounded

STATE = "state_log current_state"


@check("SELECT state, count(*) AS n, count(*) FILTER (WHERE terminal) AS terminal, max(updated_at) AS last_update FROM current_state GROUP BY state", STATE)
def current_state(i):
    return i.current_state.groupBy("state").agg(
        F.count("*").alias("n"), F.count_if("terminal").alias("terminal"), F.max("updated_at").alias("last_update"))


@check("SELECT m.migration_id, plan_id, version, state, terminal FROM migrations m JOIN current_state s ON s.migration_id = m.migration_id", f"migrations {STATE}")
def migration_summary(i):
    return lc.migration_summary(i.migrations, i.current_state).select("migration_id", "plan_id", "version", "state", "terminal")


@check("SELECT state, count(*) AS n FROM current_state GROUP BY state", STATE)
def state_counts(i):
    return lc.state_counts(i.current_state)


@check("""SELECT done, rolled_back, active, round(done * 100.0 / (done + rolled_back))::bigint AS success_rate FROM
    (SELECT count(*) FILTER (WHERE state = 'Done') AS done, count(*) FILTER (WHERE state = 'RolledBack') AS rolled_back,
            count(*) FILTER (WHERE NOT terminal) AS active FROM current_state)""", STATE)
def success_rate(i):
    return lc.success_rate(i.current_state)


@check("""SELECT migration_id, state, round(coalesce(list_position([%s], state), 0) * 100.0 / 8)::bigint AS progress_pct FROM current_state"""
       % ", ".join(f"'{s}'" for s in FLOW), STATE)
def flow_progress(i):
    return lc.flow_progress(i.current_state).select("migration_id", "state", "progress_pct")


@check("""SELECT migration_id, to_state AS state, created_at AS enter_at, lead(created_at) OVER w AS leave_at,
    round((epoch_us(lead(created_at) OVER w) - epoch_us(created_at)) / 1e6::double, 6) AS dwell_s FROM state_log
    WINDOW w AS (PARTITION BY migration_id ORDER BY created_at, id)""", "state_log")
def state_intervals(i):
    return rounded(lc.state_intervals(i.state_log))


@check("""SELECT b.migration_id, b.id, e.to_state AS state FROM
    (SELECT l_orderkey AS migration_id, l_partkey AS id, o_orderdate + to_minutes(l_linenumber * 7) AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey) b
    ASOF LEFT JOIN state_log e ON e.migration_id = b.migration_id AND e.created_at <= b.at""", "state_log")
def state_at_time(i):
    log = i.table("lineitem").join(i.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_orderkey").alias("migration_id"), F.col("l_partkey").alias("id"),
        F.expr("timestampadd(MINUTE, l_linenumber * 7, o_orderdate)").alias("at"))
    return lc.state_at(log, i.state_log, "at").select("migration_id", "id", "state")


EDGES = ", ".join(f"('{a}', '{b}')" for a, b in [
    *zip(FLOW, FLOW[1:], strict=False), ("Canary", "RollingBack"), ("Cutover", "RollingBack"), ("RollingBack", "RolledBack")])


@check(f"""SELECT * FROM (SELECT migration_id, id, from_state, to_state, previous_state,
    CASE WHEN rn > 1 AND from_state IS DISTINCT FROM previous_state THEN 'chain_broken'
         WHEN (rn = 1 AND from_state IS NULL) OR from_state = to_state THEN NULL
         WHEN (from_state, to_state) IN ({EDGES}) THEN NULL ELSE 'not_allowed' END AS reason
    FROM (SELECT *, lag(to_state) OVER w AS previous_state, row_number() OVER w AS rn FROM state_log WINDOW w AS (PARTITION BY migration_id ORDER BY created_at, id)))
    WHERE reason IS NOT NULL""", "state_log")
def invalid_transitions(i):
    return lc.invalid_transitions(i.state_log)


@check("""SELECT migration_id, id, to_state FROM (SELECT *, row_number() OVER (PARTITION BY migration_id ORDER BY created_at DESC, id DESC) AS rn FROM state_log) WHERE rn <= 3""", "state_log")
def last_n_per_key(i):
    return lc.last_n(i.state_log, ["migration_id"], ["created_at", "id"], 3).select("migration_id", "id", "to_state")


@check("""SELECT service_name, id, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY recorded_at DESC, id DESC) AS rn FROM heartbeats) WHERE rn = 1""", "heartbeats")
def latest_per_key(i):
    return lc.latest_by(i.heartbeats, ["service_name"], ["recorded_at", "id"]).select("service_name", "id", "recorded_at")


@check("SELECT migration_id, state, updated_at FROM current_state", STATE)
def newest_first(i):
    return lc.recent(i.current_state, "updated_at", "migration_id").select("migration_id", "state", "updated_at")


@check("SELECT migration_id, state FROM current_state ORDER BY updated_at, migration_id LIMIT 20 OFFSET 60", STATE)
def page_of_twenty(i):
    return lc.page(i.current_state, ["updated_at", "migration_id"], 3).select("migration_id", "state")


@check("SELECT migration_id, state FROM current_state ORDER BY updated_at, migration_id LIMIT 20 OFFSET 12000", STATE)
def page_far_back(i):
    return lc.page(i.current_state, ["updated_at", "migration_id"], 600).select("migration_id", "state")


@check("SELECT ceil(count(*) / 20.0)::bigint AS pages FROM current_state", STATE)
def page_count(i):
    return lc.page_count(i.current_state)


@check("SELECT migration_id, state, updated_at FROM current_state WHERE NOT terminal", STATE)
def resumable_work(i):
    return lc.resumable(i.current_state).select("migration_id", "state", "updated_at")


@check("""SELECT m.migration_id, plan_id, state FROM migrations m JOIN current_state s ON s.migration_id = m.migration_id
    WHERE lower(plan_id) LIKE '%17%' OR lower(state) LIKE '%17%' OR m.migration_id::varchar LIKE '%17%'""", f"migrations {STATE}")
def search_text(i):
    rows = lc.migration_summary(i.migrations, i.current_state)
    return lc.search(rows, ["plan_id", "state", "migration_id"], "17").select("migration_id", "plan_id", "state")


@check("""SELECT migration_id, plan_id, version FROM migrations UNION ALL
    SELECT migration_id, plan_id, version FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, version ORDER BY created_at, migration_id) AS rn FROM submissions) s
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM migrations m WHERE m.plan_id = s.plan_id AND m.version = s.version)""", "migrations submissions")
def idempotent_submit(i):
    return lc.submit_new(i.migrations, i.submissions, order=("created_at", "migration_id")).select("migration_id", "plan_id", "version")


PURGE_IDS = "SELECT o_orderkey AS migration_id FROM orders WHERE o_orderstatus = 'F'"


def _purge_ids(i):
    return i.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("migration_id"))


@check(f"""SELECT migration_id, id FROM state_log WHERE migration_id NOT IN
    (SELECT migration_id FROM current_state WHERE terminal AND migration_id IN ({PURGE_IDS}))""", STATE)
def purge_finished(i):
    return lc.purge({"events": i.state_log}, _purge_ids(i), i.current_state)["events"].select("migration_id", "id")


@check(f"SELECT migration_id FROM ({PURGE_IDS}) WHERE migration_id IN (SELECT migration_id FROM current_state WHERE NOT terminal)", STATE)
def purge_refused(i):
    return lc.refused_ids(_purge_ids(i), i.current_state)


@check("""SELECT migration_id, service_name, CASE WHEN u.service_name IS NULL THEN c.schema_version ELSE u.schema_version END AS schema_version,
    coalesce(c.registered_at, u.registered_at) AS registered_at, coalesce(u.last_heartbeat, c.last_heartbeat) AS last_heartbeat
    FROM (SELECT * FROM registry WHERE schema_version <> 1) c FULL OUTER JOIN
      (SELECT migration_id, service_name, max(schema_version) + 10 AS schema_version, max(recorded_at) AS registered_at, max(recorded_at) AS last_heartbeat
       FROM heartbeats WHERE compatible GROUP BY ALL) u USING (migration_id, service_name)""", "heartbeats registry")
def upsert_registry(i):
    cur = i.registry.filter("schema_version <> 1").drop("compatible")
    upd = i.heartbeats.filter("compatible").groupBy("migration_id", "service_name").agg(
        (F.max("schema_version") + 10).alias("schema_version"), F.max("recorded_at").alias("registered_at"), F.max("recorded_at").alias("last_heartbeat"))
    return rg.upsert(cur, upd, ["migration_id", "service_name"], keep=["registered_at"])


@check("""WITH upd AS (SELECT * FROM (SELECT l_orderkey AS id, l_extendedprice AS amount, 'U' AS status, l_shipdate::varchar AS first_seen,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS rn
      FROM lineitem WHERE l_orderkey % 37 = 0 OR l_orderkey % 5 = 0) WHERE rn = 1),
    cur AS (SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status, o_orderdate::varchar AS first_seen FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT id, CASE WHEN u.id IS NULL THEN c.amount ELSE u.amount END AS amount, coalesce(u.status, c.status) AS status, coalesce(c.first_seen, u.first_seen) AS first_seen
    FROM cur c FULL JOIN upd u USING (id) WHERE NOT (coalesce(u.status, c.status) = 'F' AND coalesce(u.amount, c.amount) < 100000) AND id % 11 <> 4""")
def stored_upsert_and_purge(i):
    """A stored table: repeated update keys, kept columns, keys deleted, rows purged."""
    o, lines = i.table("orders"), i.table("lineitem")
    table = KeyedTable(i.spark, scratch_dir(i.spark, "keyed"), ["id"], "id long, amount double, status string, first_seen string")
    table.create(o.filter("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS id", "o_totalprice AS amount", "o_orderstatus AS status", "cast(o_orderdate AS string) AS first_seen"), 32)
    table.upsert(lines.filter("l_orderkey % 37 = 0 OR l_orderkey % 5 = 0").selectExpr(
        "l_orderkey AS id", "l_extendedprice AS amount", "'U' AS status", "cast(l_shipdate AS string) AS first_seen", "l_linenumber", "l_partkey", "l_suppkey"),
        keep=["first_seen"], order=["l_linenumber", "l_partkey", "l_suppkey", "amount", "first_seen"])
    table.delete(o.filter("o_orderkey % 11 = 4").select(F.col("o_orderkey").alias("id")))
    table.purge("status = 'F' AND amount < 100000")
    return table.read()


@check("""SELECT migration_id, count(*) AS total, count(*) FILTER (WHERE compatible) AS ready, count(*) FILTER (WHERE NOT compatible) AS not_ready,
    count(*) = count(*) FILTER (WHERE compatible) AS all_ready FROM registry GROUP BY migration_id""", "heartbeats registry")
def service_readiness(i):
    return rg.service_readiness(i.registry)


LATE = "epoch_us((SELECT max(recorded_at) FROM heartbeats)) - epoch_us(last_heartbeat) > 36000::bigint * 1000000"


@check(f"""SELECT c.migration_id, coalesce(chunk, 0)::int AS chunk, services, dead, dead = 0 AS alive, coalesce(names, '') AS dead_services FROM
    (SELECT migration_id, count(*) AS services, count(*) FILTER (WHERE {LATE}) AS dead FROM registry GROUP BY migration_id) c LEFT JOIN
    (SELECT migration_id, (rn - 1) // 3 AS chunk, string_agg(service_name, ',' ORDER BY service_name) AS names FROM
      (SELECT *, row_number() OVER (PARTITION BY migration_id ORDER BY service_name) AS rn FROM registry WHERE {LATE}) GROUP BY ALL) n USING (migration_id)""", "heartbeats registry")
def service_liveness(i):
    """Names in chunks of three."""
    reg = i.registry
    return rg.liveness(reg, latest(i.heartbeats, "recorded_at"), 36000, list_limit=3).withColumn("dead_services", F.array_join("dead_services", ","))


@check(f"SELECT migration_id, service_name, last_heartbeat FROM registry WHERE {LATE}", "heartbeats registry")
def dead_services(i):
    return rg.dead_services(i.registry, latest(i.heartbeats, "recorded_at"), 36000).select("migration_id", "service_name", "last_heartbeat")


@check("""SELECT migration_id, ((rn - 1) // 7)::int AS chunk, string_agg(service_name || '=' || schema_version, ',' ORDER BY service_name) AS versions FROM
    (SELECT *, row_number() OVER (PARTITION BY migration_id ORDER BY service_name) AS rn FROM registry) GROUP BY ALL""", "heartbeats registry")
def service_versions(i):
    """Maps of seven services."""
    by_name = F.array_sort(F.map_keys("versions"))
    text = F.array_join(F.transform(by_name, lambda k: F.concat_ws("=", k, F.element_at("versions", k).cast("string"))), ",")
    return rg.service_versions(i.registry, list_limit=7).select("migration_id", "chunk", text.alias("versions"))


@check("SELECT migration_id, schema_version, count(*) AS services FROM registry GROUP BY ALL", "heartbeats registry")
def versions_in_use(i):
    return rg.versions_in_use(i.registry)


@check("""SELECT migration_id, id, rows_so_far, round(CASE WHEN total > 0 THEN rows_so_far * 100.0::double / total ELSE 0 END, 6) AS pct, round(gap, 6) AS gap_s,
    round(CASE WHEN gap > 0 THEN rows_affected / gap END, 6) AS rows_per_s FROM (SELECT *,
      cast(sum(rows_affected) OVER (PARTITION BY migration_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS bigint) AS rows_so_far,
      sum(rows_affected) OVER (PARTITION BY migration_id) AS total,
      (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY migration_id ORDER BY created_at, id))) / 1e6::double AS gap FROM batch_log)""", "batch_log")
def progress_curve(i):
    return rounded(runs.progress_curve(i.batch_log).select("migration_id", "id", "rows_so_far", "pct", "gap_s", "rows_per_s"))


@check("SELECT id, migration_id, started_at FROM batch_runs WHERE completed_at IS NULL AND started_at < (SELECT max(started_at) FROM batch_runs) - INTERVAL 300 SECOND", "batch_runs")
def stalled_batches(i):
    b = i.batch_runs
    return runs.stalled_batches(b, latest(b, "started_at")).select("id", "migration_id", "started_at")


@check("""SELECT b.target, b.id, h.id::varchar AS sample_id, round(h.score, 6) AS score FROM
    (SELECT o_orderkey % 10 AS target, o_orderkey AS id, (SELECT min(ts) FROM events) + to_minutes(o_orderkey % 40000) AS created_at FROM orders) b
    ASOF LEFT JOIN scored h ON h.target = b.target AND h.ts <= b.created_at""", "health_samples scored")
def attach_health(i):
    from changeguard.operators.health import score_health

    start = F.lit(i.table("events").agg(F.min("ts").cast("timestamp")).first()[0])
    batches = i.table("orders").select(
        (F.col("o_orderkey") % 10).alias("target"), F.col("o_orderkey").alias("id"), start.alias("_s"),
    ).select("target", "id", F.expr("timestampadd(MINUTE, cast(id % 40000 AS int), _s)").alias("created_at"))
    health = score_health(i.health_samples).withColumn("ts", F.col("ts").cast("timestamp"))
    out = runs.attach_health(batches, health, "target", {"sample_id": "id", "score": "score"})
    return rounded(out.select("target", "id", F.col("sample_id").cast("string").alias("sample_id"), "score"))


@check("""SELECT stage, coalesce(sum(rows_affected) FILTER (WHERE NOT failed), 0)::bigint AS rows, count(*) FILTER (WHERE NOT failed) AS batches,
    round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6::double, 6) AS elapsed_s,
    round(coalesce(sum(rows_affected) FILTER (WHERE NOT failed), 0) / ((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6::double), 6) AS rows_per_s,
    round(avg(duration_ms) FILTER (WHERE NOT failed), 6) AS mean_ms, any_value(p99) AS p99_ms, max(duration_ms) FILTER (WHERE NOT failed) AS max_ms,
    count(*) FILTER (WHERE failed) AS errors, max(throttle_ms)::double AS max_lag_ms
    FROM (SELECT migration_id % 3 AS stage, * EXCLUDE (stage) FROM batch_log)
    JOIN (SELECT stage AS st, max(CASE WHEN rn - 1 = least(floor(0.99::double * n)::bigint, n - 1) THEN duration_ms END) AS p99 FROM
       (SELECT migration_id % 3 AS stage, duration_ms, row_number() OVER (PARTITION BY migration_id % 3 ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY migration_id % 3) AS n
        FROM batch_log WHERE NOT failed) GROUP BY stage) ON st = stage GROUP BY stage""", "batch_log")
def run_summary(i):
    b = i.batch_log.withColumn("stage", F.col("migration_id") % 3).withColumn("throttle_ms", F.col("throttle_ms").cast("double"))
    return rounded(runs.run_summary(b, failed=F.col("failed"), lag_ms="throttle_ms"))


@check(r"""SELECT id, contains(upper(statement), 'CONCURRENTLY') AS is_concurrent,
    CASE WHEN regexp_matches(upper(statement), '\bDROP\b|\bTRUNCATE\b|\bDELETE\b') THEN 'destructive' WHEN regexp_matches(upper(statement), '\bADD\b|\bCREATE\b') THEN 'additive' ELSE 'other' END AS kind,
    CASE WHEN length(statement) > 100 THEN substr(statement, 1, 100) || '...' ELSE statement END AS short_statement FROM ddl_log""", "ddl_log")
def classify_ddl(i):
    return runs.classify_ddl(i.ddl_log).select("id", "is_concurrent", "kind", "short_statement")


@check("""SELECT migration_id, statement, count(*) AS attempts, count(*) FILTER (WHERE NOT success) AS failures, sum(duration_ms)::bigint AS total_ms, max(duration_ms) AS max_ms,
    last(success ORDER BY started_at, id) AS last_success, last(success ORDER BY started_at, id) AND count(*) FILTER (WHERE NOT success) > 0 AS recovered
    FROM ddl_log GROUP BY migration_id, statement""", "ddl_log")
def ddl_summary(i):
    return runs.ddl_summary(i.ddl_log)


@check("""WITH a AS (SELECT *, lag(success) OVER w AS ok_before, lag(completed_at) OVER w AS ended FROM ddl_log WINDOW w AS (PARTITION BY migration_id, statement ORDER BY started_at, id)),
    b AS (SELECT *, sum(CASE WHEN ok_before IS NULL OR ok_before THEN 1 ELSE 0 END) OVER (PARTITION BY migration_id, statement ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS seq FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY migration_id, statement, seq ORDER BY started_at, id) AS attempt, bool_or(success) OVER (PARTITION BY migration_id, statement, seq) AS final_success FROM b)
    SELECT id, attempt, CASE WHEN attempt > 1 THEN round((epoch_us(started_at) - epoch_us(ended)) / 1e6::double, 6) END AS wait_s,
      CASE WHEN attempt > 1 THEN pow(2.0::double, attempt - 2) END AS expected_wait_s, final_success FROM c""", "ddl_log")
def retry_sequences(i):
    return rounded(runs.retry_sequences(i.ddl_log).select("id", "attempt", "wait_s", "expected_wait_s", "final_success"))


def _samples(i):
    """Exposition text written by Spark from the events, then read back."""
    path = scratch_dir(i.spark, "metrics")
    ev = i.table("events")
    metric = F.when(F.col("event_id") % 4 == 0, "jobs_done").otherwise("requests_total")
    labels = F.concat(F.lit('{user="'), F.col("user_id").cast("string"), F.lit('",type="'), F.col("event_type"), F.lit(', {x}"} '))
    value = F.when(F.col("event_id") % 50 == 7, "n/a").otherwise(F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 60 == 11, "# HELP jobs").otherwise(F.concat(metric, labels, value))
    ev.select(line.alias("value")).write.text(path)
    return read_metric_samples(i.spark, path)


KEPT = """(SELECT CASE WHEN event_id % 4 = 0 THEN 'jobs_done' ELSE 'requests_total' END AS name, user_id::varchar AS usr, event_type || ', {x}' AS typ, event_id::double AS value
    FROM events WHERE event_id % 60 <> 11 AND event_id % 50 <> 7)"""


@check(f"SELECT name, usr AS user, typ AS type, count(*) AS n, sum(value) AS value_sum FROM {KEPT} GROUP BY ALL")
def metric_text_samples(i):
    s = _samples(i)
    return s.groupBy("name", F.col("labels")["user"].alias("user"), F.col("labels")["type"].alias("type")).agg(
        F.count("*").alias("n"), F.sum("value").alias("value_sum"))


@check(f"SELECT coalesce(sum(value), 0) AS value FROM {KEPT} WHERE name = 'jobs_done' AND typ = 'click, {{x}}'")
def metric_sum_filtered(i):
    return mt.metric_sum(_samples(i), "jobs_done", {"type": "click, {x}"})


@check(f"SELECT max(value) AS value FROM {KEPT} WHERE name = 'requests_total' AND usr = '8'")
def metric_latest_filtered(i):
    """The file is in event order and the value is the event id, so the last is the largest."""
    return mt.metric_latest(_samples(i), "requests_total", {"user": "8"})


@check("""SELECT migration_id, plan_id, total AS backfill_total, done AS backfill_done, 0.0::double AS parity, 0.0::double AS canary_pct, 0.0::double AS cutover_parity,
    CASE WHEN total > 0 THEN round(done / total * 100, 6) ELSE 0 END::double AS backfill_pct, state,
    round(coalesce(rollbacks, 0), 6)::double AS rollbacks FROM (
    SELECT user_id::varchar AS migration_id, 'p' || (user_id % 7) AS plan_id,
      coalesce(arg_max(value, event_id) FILTER (WHERE event_type = 'view'), 0)::double AS total,
      coalesce(arg_max(value, event_id) FILTER (WHERE event_type = 'click'), 0)::double AS done,
      coalesce(arg_min('s' || (event_id % 3), event_id) FILTER (WHERE event_type = 'signup'), '') AS state FROM events GROUP BY user_id)
    LEFT JOIN (SELECT 'p' || (user_id % 7) AS plan_id, sum(value) AS rollbacks FROM events WHERE event_type = 'error' GROUP BY 1) USING (plan_id)""")
def migration_metrics(i):
    ev = i.table("events")
    name = F.when(F.col("event_type") == "view", mt.GAUGES["backfill_total"]).when(
        F.col("event_type") == "click", mt.GAUGES["backfill_done"]).when(F.col("event_type") == "signup", mt.STATE_METRIC).when(
        F.col("event_type") == "error", mt.ROLLBACKS).otherwise("other")
    labels = F.create_map(
        F.lit("migration_id"), F.col("user_id").cast("string"), F.lit("plan_id"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")),
        F.lit("state"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")))
    value = F.when(F.col("event_type") == "signup", 1.0).otherwise(F.col("value"))
    return rounded(mt.migration_metrics(ev.select(name.alias("name"), labels.alias("labels"), value.alias("value"), F.col("event_id").alias("seq"))))


@check("SELECT 'p' || (user_id % 7) AS plan_id, event_type AS state, count(*)::double AS transitions FROM events GROUP BY ALL")
def transition_counts(i):
    labels = F.create_map(F.lit("plan_id"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")), F.lit("to_state"), F.col("event_type"))
    return mt.transition_counts(i.table("events").select(F.lit(mt.TRANSITIONS).alias("name"), labels.alias("labels"), F.lit(1.0).alias("value")))


GROWN = """WITH d AS (SELECT *, epoch_us(ts) AS us, lag(value) OVER (PARTITION BY series ORDER BY ts, id) AS prev FROM counters),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) OVER (PARTITION BY series ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS cum FROM d),
    r AS (SELECT series, id, (cum - min(cum) OVER (PARTITION BY series ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW))::bigint AS inc FROM g)"""


@check(GROWN + " SELECT series, id, inc AS increase FROM r", "counters")
def counter_increase(i):
    return mt.increase(i.counters, 172_800, ["series"]).select("series", "id", "increase")


@check(GROWN + " SELECT series, id, round(inc / 172800.0::double, 6) AS rate FROM r", "counters")
def counter_rate(i):
    return rounded(mt.rate(i.counters, 172_800, ["series"]).select("series", "id", "rate"))


@check("""WITH near AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, id) AS prev FROM counters WHERE ts >= (SELECT max(ts) FROM counters) - INTERVAL 2 DAY)
    SELECT 'rolled_back' AS rule, 'critical' AS severity, series::varchar AS subject, max(ts) AS since,
      sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)::bigint::varchar AS detail
    FROM near GROUP BY series HAVING sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) > 0""", "counters")
def rollback_counter_alerts(i):
    counters = i.counters.withColumn("ts", F.col("ts").cast("timestamp"))
    return al.counted_rollbacks(counters, latest(counters, "ts"), 172_800)


@check("""WITH clock AS (SELECT max(ts) AS now FROM parity_samples), ev AS (
      SELECT e.* REPLACE ((SELECT now FROM clock) - ((SELECT max(created_at) FROM state_log) - created_at) AS created_at) FROM state_log e),
    cur AS (SELECT migration_id, arg_max(to_state, id) AS state, max(created_at) AS entered FROM ev WHERE from_state IS DISTINCT FROM to_state GROUP BY migration_id),
    good AS (SELECT series, max(ts) FILTER (WHERE value >= 0.999) AS g FROM parity_samples GROUP BY series)
    SELECT 'stuck' AS rule, 'warning' AS severity, migration_id::varchar AS subject, entered AS since, state AS detail FROM cur, clock WHERE state NOT IN ('Done', 'RolledBack', 'Pending') AND now - entered >= INTERVAL 600 SECOND
    UNION ALL SELECT 'rolled_back', 'critical', migration_id::varchar, max(created_at), count(*)::varchar FROM ev, clock WHERE to_state = 'RolledBack' AND created_at <= now AND now - created_at <= INTERVAL 600 SECOND GROUP BY migration_id
    UNION ALL SELECT 'low_parity', 'critical', series, min(ts), printf('%.4f', arg_max(value, ts)) FROM parity_samples JOIN good USING (series), clock WHERE value < 0.999 AND (g IS NULL OR ts > g) GROUP BY series, now HAVING now - min(ts) >= INTERVAL 60 SECOND
    UNION ALL SELECT 'silent', 'critical', series, max(ts), (epoch_us(now) - epoch_us(max(ts))) // 1000000 FROM parity_samples, clock GROUP BY series, now HAVING now - max(ts) >= INTERVAL 60 SECOND""", "state_log parity_samples")
def alert_rules(i):
    samples = i.parity_samples.withColumn("ts", F.col("ts").cast("timestamp"))
    now = samples.agg(F.max("ts")).first()[0]
    ends = i.state_log.agg(F.max("created_at").cast("timestamp")).first()[0]
    moved = i.state_log.withColumn("created_at", F.timestamp_micros(
        micros("created_at") + (micros(F.lit(now)) - micros(F.lit(ends)))))
    return al.alerts(moved, samples, F.lit(now))


@check("""SELECT id, unnest(CASE WHEN plan = 'not json' THEN ['unreadable'] ELSE list_filter([
      CASE WHEN id % 11 = 0 THEN 'id_missing' END, CASE WHEN id % 7 = 0 THEN 'version_not_positive' END,
      CASE WHEN id % 13 <> 0 AND id % 17 = 0 THEN 'table_missing' END, CASE WHEN id % 13 = 0 THEN 'table_not_identifier' END,
      CASE WHEN id % 5 = 0 THEN 'column_not_identifier' END, CASE WHEN id % 29 = 0 THEN 'expression_missing' END,
      CASE WHEN id % 19 = 0 THEN 'strategy_unsupported' END, CASE WHEN id % 23 = 0 THEN 'nothing_to_expand' END,
      CASE WHEN id % 120 = 0 OR id % 120 > 100 THEN 'step_out_of_range' END, CASE WHEN id % 31 = 0 THEN 'on_failure_invalid' END], lambda x: x IS NOT NULL) END) AS rule FROM plan_docs""", "plan_docs")
def lint_plan_catalog(i):
    return lint_plans(i.plan_docs)


@check("""SELECT s.migration_id, state, CASE WHEN state = 'RolledBack' THEN 'rolled_back' WHEN state = 'Done' AND coalesce(n, 0) > 0 THEN 'throttled' ELSE 'success' END AS outcome, coalesce(n, 0) AS throttle_events
    FROM current_state s LEFT JOIN (SELECT l_orderkey AS migration_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t ON t.migration_id = s.migration_id""", STATE)
def classify_outcome(i):
    return report.classify_outcome(i.current_state, _throttle(i)).select("migration_id", "state", "outcome", "throttle_events")


def _throttle(i):
    return i.table("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("migration_id")).agg(F.count("*").alias("throttle_events"))


@check("""SELECT run_id, round(hours, 6) AS hours, 4800.0::double AS manual_cost_low, 8000.0::double AS manual_cost_high, round(greatest(48.0::double - hours, 0), 6) AS hours_saved,
    round(greatest(48.0::double - hours, 0) * 100, 6) AS cost_saved FROM runs""", "runs")
def cost_report(i):
    return rounded(report.cost_report(i.runs))


@check("""SELECT run_id, scenario, round(duration_s, 6) AS duration_s, final_rows, concat_ws(',', CASE WHEN NOT loss_allowed AND final_rows < expected_rows THEN 'data_loss' END, CASE WHEN duration_s > max_downtime_s THEN 'downtime' END) AS reasons,
    (loss_allowed OR final_rows >= expected_rows) AND duration_s <= max_downtime_s AS passed FROM scenario_results JOIN scenario_limits USING (scenario)""", "scenario_results scenario_limits")
def check_outcomes(i):
    return rounded(report.check_outcomes(i.scenario_results, i.scenario_limits))


@check("""SELECT migration_id, state, outcome, throttle_events, rows_verified, drift_detected, round(parity_pct, 6) AS parity_pct, rows, rows_per_s FROM (
    SELECT s.migration_id, state, CASE WHEN state = 'RolledBack' THEN 'rolled_back' WHEN state = 'Done' AND coalesce(n, 0) > 0 THEN 'throttled' ELSE 'success' END AS outcome,
      coalesce(n, 0) AS throttle_events, total::double AS rows_verified, drifted::double AS drift_detected, (total - drifted)::double / total * 100 AS parity_pct, rows, rows_per_s
    FROM current_state s LEFT JOIN (SELECT l_orderkey AS migration_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t ON t.migration_id = s.migration_id
    LEFT JOIN (SELECT l_orderkey AS migration_id, count(*) AS total, count(*) FILTER (WHERE l_linenumber > 4 IS DISTINCT FROM (l_quantity > 25)) AS drifted, sum(l_linenumber)::double AS rows, max(l_quantity) AS rows_per_s FROM lineitem GROUP BY 1) d ON d.migration_id = s.migration_id)""", STATE)
def health_overview(i):
    li = i.table("lineitem").withColumns({"migration_id": F.col("l_orderkey"), "late": F.col("l_linenumber") > 4})
    drift = drift_scan(li, "late", "l_quantity > 25", ["migration_id"])
    work = li.groupBy("migration_id").agg(F.sum("l_linenumber").cast("double").alias("rows"), F.max("l_quantity").alias("rows_per_s"))
    out = report.health_overview(i.current_state, drift, _throttle(i), work)
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in ("rows_verified", "drift_detected")}))


@check("""SELECT user_name AS user, role, action, success, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM audit_rows GROUP BY ALL""", "audit_rows")
def audit_summary_from_lines(i):
    path = scratch_dir(i.spark, "audit")
    rows = i.audit_rows
    entry = F.to_json(F.struct(F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_name").alias("user"), "role", "action", "success"),
                      {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    rows.select(F.concat(F.lit("INFO audit mutation json="), entry)).write.text(path)
    return audit_summary(read_audit(i.spark, path))


@check("""SELECT kind, count(*) AS n, min(created_at) AS first_at FROM (
    SELECT 'batch' AS kind, created_at FROM batch_log UNION ALL SELECT 'state', created_at FROM state_log) GROUP BY kind""", "batch_log state_log")
def append_logs(i):
    batch = i.batch_log.select(F.lit("batch").alias("kind"), F.col("created_at").cast("timestamp").alias("created_at"), "stage")
    state = i.state_log.select(F.lit("state").alias("kind"), F.col("created_at").cast("timestamp").alias("created_at"))
    return append_all(batch, state).groupBy("kind").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"))


@check("""SELECT migration_id::varchar AS migration_id, count(*) AS n, sum(rows_affected)::bigint AS row_total, max(throttle_ms)::int AS throttle_ms, count(*) FILTER (WHERE stage = 'click') AS clicks
    FROM batch_log GROUP BY migration_id""", "batch_log")
def append_backfill_log(i):
    """Two appends to a partitioned progress log, read back."""
    path = scratch_dir(i.spark, "backfill-log")
    log = i.batch_log.withColumn("batch_number", F.col("stage").isin("click").cast("int"))
    append_log(log.filter("batch_number = 1"), path, "backfill", "batch_number")
    append_log(log.filter("batch_number = 0"), path, "backfill", "batch_number")
    return read_log(i.spark, path, "backfill").groupBy("migration_id").agg(
        F.count("*").alias("n"), F.sum("rows_affected").alias("row_total"), F.max("throttle_ms").alias("throttle_ms"),
        F.sum("batch_number").alias("clicks"))


@check("""WITH c AS (SELECT row_number() OVER (ORDER BY client_id) AS id, client_id, max(duration_ms) AS p99_ms, count(*) FILTER (WHERE status_code >= 500) AS errors FROM requests GROUP BY client_id)
    SELECT p99_ms > 230 AS slo_breached, count(*) AS n, max(p99_ms) AS p99_ms, sum(errors)::double AS errors FROM c GROUP BY 1""", "requests")
def append_canary_log(i):
    path = scratch_dir(i.spark, "canary-log")
    obs = i.requests.groupBy("client_id").agg(F.max("duration_ms").alias("p99_ms"), F.count_if(F.col("status_code") >= 500).alias("err_pct"))
    append_log(obs.withColumns({"migration_id": F.col("client_id"), "slo_breached": F.col("p99_ms") > 230}), path, "canary")
    return read_log(i.spark, path, "canary").groupBy("slo_breached").agg(
        F.count("*").alias("n"), F.max("p99_ms").alias("p99_ms"), F.sum("err_pct").alias("errors"))
