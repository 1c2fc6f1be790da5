"""Stream queries: run over everything that is there, then read back.

Windows that the watermark has not closed at the end are not emitted, so the SQL
cuts there too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from changeguard.operators.registry import registry_from_heartbeats
from changeguard.operators.schema_change import ChangeError
from changeguard.plans.job import RequestLog, run_change
from changeguard.plans.plan import ColumnSpec, Plan, Slo
from changeguard.session import scratch_dir
from changeguard.sources.logs import read_log, stream_log
from changeguard.streaming import monitors, stateful
from changeguard.streaming.backfill import backfill_stream, run_available
from changeguard.streaming.late import late_rows, late_rows_to
from changeguard.streaming.ordered import attach_latest_stream, increase_stream, rate_limit_stream_ordered, rocksdb_state, throttle_stream_ordered
from changeguard.streaming.paced import paced_backfill
from suite.base import SIZE_CLASS, check, rounded
from suite.objectives import PACE, _with_walk
from suite.tables import BAND, TIER


def events_stream(i):
    return stream_log(i.spark, i.dir, i.table("events").schema, glob="events.parquet")


def finished(i, stream, name, mode="append"):
    return run_available(stream, scratch_dir(i.spark, name), scratch_dir(i.spark, f"{name}-checkpoint"), mode)


LAST = "(SELECT max(ts) FROM events)"


@check(f"""SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n, errors, p99_ms, round(err_pct, 6) AS err_pct, p99_ms > 250 OR err_pct > 22 AS slo_breached,
    CASE WHEN p99_ms > 250 THEN 'p99 ' || round_even(p99_ms, 0)::bigint || 'ms > 250ms' WHEN err_pct > 22 THEN printf('error-rate %.2f%% > 22.00%%', err_pct) END AS reason FROM
    (SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, quantile_disc(value, 0.99) AS p99_ms,
      count(*) FILTER (WHERE event_type = 'error') * 100.0::double / count(*) AS err_pct FROM events GROUP BY 1)
    WHERE window_start + INTERVAL 1 DAY <= {LAST} - INTERVAL 10 MINUTE""")
def slo_stream(i):
    limits = Slo(max_p99_latency_ms=250, max_error_rate_pct=22.0)
    s = monitors.slo_stream(events_stream(i), "ts", "value", F.col("event_type") == "error", limits, "1 day", "10 minutes")
    return rounded(finished(i, s, "slo"))


@check(f"""SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, event_type, count(*) AS increase, round(count(*) / 172800.0::double, 6) AS rate
    FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start FROM events)
    WHERE window_start + INTERVAL 2 DAY <= {LAST} - INTERVAL 10 MINUTE GROUP BY window_start, event_type""")
def rate_stream(i):
    s = monitors.rate_stream(events_stream(i), "ts", window="2 days", slide="1 day", delay="10 minutes", by=["event_type"])
    return rounded(finished(i, s, "rate"))


@check(f"""SELECT user_id, min(ts) AS first_beat, max(ts) + INTERVAL 10 HOUR AS silent_at, count(*) AS beats FROM
    (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 10 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
     FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events))
    GROUP BY user_id, run HAVING max(ts) + INTERVAL 10 HOUR <= {LAST} - INTERVAL 10 MINUTE""")
def heartbeat_sessions(i):
    return finished(i, monitors.heartbeat_sessions(events_stream(i), "ts", ["user_id"], "10 hours", "10 minutes"), "sessions")


@check(f"""SELECT user_id, max(ts) AS last_heartbeat, count(*) AS beats FROM
    (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 10 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
     FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before, max(ts) OVER (PARTITION BY user_id) AS newest FROM events))
    GROUP BY user_id, run, newest HAVING max(ts) < newest OR epoch_ms(max(ts)) + 36000000 < epoch_ms({LAST})""")
def liveness_stream(i):
    return finished(i, stateful.liveness_stream(events_stream(i), "ts", "user_id", 36_000), "liveness")


@check(_with_walk("SELECT target, id, b::int AS batch_size, p::int AS throttle_ms, o AS tripped, trips::int AS trip_count FROM walk WHERE rn > 0"),
       "health_samples scored")
def throttle_stream(i):
    samples = events_stream(i).selectExpr(
        "user_id % 10 AS target", "event_id AS id", "ts", "100 AS max_conns",
        "CASE WHEN hour(ts) < 4 THEN 100 ELSE event_id % 60 END AS active_conns",
        "CASE WHEN hour(ts) < 4 THEN 5000.0D ELSE value END AS max_lag_ms",
        "CASE WHEN hour(ts) < 4 THEN 20 ELSE event_id % 4 END AS waiting_queries",
        "CASE WHEN hour(ts) < 4 THEN 2000000 ELSE (event_id * 137) % 300000 END AS dead_tuples")
    out = finished(i, stateful.throttle_stream(samples, PACE), "throttle")
    return out.select("target", "id", "batch_size", "throttle_ms", "tripped", "trip_count")


@check("""WITH line AS (SELECT user_id AS client_id, event_id AS request_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (SELECT client_id, request_id, us, rn, 2 * 28800000000 AS level, true AS allowed FROM line WHERE rn = 1
      UNION ALL SELECT client_id, request_id, us, rn, CASE WHEN full_now >= 28800000000 THEN full_now - 28800000000 ELSE full_now END, full_now >= 28800000000
      FROM (SELECT l.*, least(3 * 28800000000, w.level + (l.us - w.us)) AS full_now FROM walk w JOIN line l ON l.client_id = w.client_id AND l.rn = w.rn + 1))
    SELECT client_id, request_id, allowed FROM walk""", "requests")
def rate_limit_stream(i):
    log = events_stream(i).selectExpr("user_id AS client_id", "event_id AS request_id", "ts")
    out = finished(i, stateful.rate_limit_stream(log, tokens=1, seconds=28_800, burst=3, idle_seconds=86_400), "limit")
    return out.select("client_id", "request_id", "allowed")


def shuffled_files(i, rows, files=6, late_days=2, late=None):
    """A stream over ``rows`` with one file per micro-batch: a row comes up to ``late_days`` after its time, in any order."""
    path = scratch_dir(i.spark, "shuffled")
    came = F.unix_micros(F.col("ts").cast("timestamp")) + (F.pmod(F.xxhash64("id"), F.lit(late_days * 86_400_000_000)) if late is None else late)
    rows = rows.withColumn("came", came)
    first, last = rows.agg(F.min("came"), F.max("came")).first()
    step = (last - first) // files + 1
    for n in range(files):  # one after the other: the order of the files is that of their times
        rows.filter((F.col("came") >= first + n * step) & (F.col("came") < first + (n + 1) * step)).drop("came").repartition(1).sort("id").write.mode("append").parquet(path)
    return stream_log(i.spark, path, rows.drop("came").schema, files_per_trigger=1)


#: What the watermark has passed at the end, where rows come up to two days late.
PASSED = f"(epoch_ms({LAST}) - 2 * 86400000) * 1000"


@check(_with_walk(f"SELECT target, id, b::int AS batch_size, p::int AS throttle_ms, o AS tripped, trips::int AS trip_count FROM walk WHERE rn > 0 AND epoch_us(ts) <= {PASSED}"),
       "health_samples scored")
def throttle_stream_out_of_order(i):
    """Samples come up to two days late, in six micro-batches: the trace is that of the batch form."""
    with rocksdb_state(i.spark):
        out = finished(i, throttle_stream_ordered(shuffled_files(i, i.health_samples), PACE, delay="2 days"), "throttle-ordered")
    return out.select("target", "id", "batch_size", "throttle_ms", "tripped", "trip_count")


@check(f"""WITH line AS (SELECT user_id AS client_id, event_id AS request_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (SELECT client_id, request_id, us, rn, 2 * 28800000000 AS level, true AS allowed FROM line WHERE rn = 1
      UNION ALL SELECT client_id, request_id, us, rn, CASE WHEN full_now >= 28800000000 THEN full_now - 28800000000 ELSE full_now END, full_now >= 28800000000
      FROM (SELECT l.*, least(3 * 28800000000, w.level + (l.us - w.us)) AS full_now FROM walk w JOIN line l ON l.client_id = w.client_id AND l.rn = w.rn + 1))
    SELECT client_id, request_id, allowed FROM walk WHERE us <= {PASSED}""", "requests")
def rate_limit_stream_out_of_order(i):
    """Requests come up to two days late, in six micro-batches; idle clients are forgotten on the way."""
    log = shuffled_files(i, i.table("events").selectExpr("user_id AS client_id", "event_id AS id", "ts"))
    limited = rate_limit_stream_ordered(log, tie="id", tokens=1, seconds=28_800, burst=3, idle_seconds=86_400, delay="2 days")
    with rocksdb_state(i.spark):
        out = finished(i, limited, "limit-ordered")
    return out.select("client_id", F.col("id").alias("request_id"), "allowed")


@check(f"""WITH w AS (SELECT *, unnest(list_transform([0, 1, 2], lambda k: date_trunc('day', ts) - k * INTERVAL 1 DAY)) AS window_start FROM counters),
    d AS (SELECT *, lag(value) OVER (PARTITION BY series, window_start ORDER BY ts, id) AS prev FROM w)
    SELECT window_start, window_start + INTERVAL 3 DAY AS window_end, series, count(*) AS samples,
           round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)::double, 6) AS increase
    FROM d GROUP BY series, window_start HAVING epoch_us(window_start) + 3 * 86400000000 <= {PASSED}""", "counters")
def increase_stream_out_of_order(i):
    """Counters that reset, samples up to two days late: the growth in each window of three days is that of the sorted samples."""
    samples = shuffled_files(i, i.counters)
    with rocksdb_state(i.spark):
        out = finished(i, increase_stream(samples, "series", window_seconds=3 * 86_400, slide_seconds=86_400, delay="2 days"), "increase")
    return rounded(out.drop("rate"))


@check("""WITH runs AS (SELECT *, sum(CASE WHEN to_state IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY migration_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, lag(to_state) OVER (PARTITION BY migration_id ORDER BY id) AS p FROM state_log)),
    last AS (SELECT migration_id, arg_max(to_state, id) AS state, arg_max(first_at, id) AS since FROM
      (SELECT *, min(created_at) OVER (PARTITION BY migration_id, run) AS first_at FROM runs) GROUP BY migration_id)
    SELECT migration_id, state, since, false AS stuck FROM last
    UNION ALL SELECT migration_id, state, since, true FROM last WHERE state NOT IN ('Done', 'RolledBack', 'Pending')
      AND epoch_ms(since) + 600000 < (SELECT epoch_ms(max(created_at)) FROM state_log)""", "state_log")
def state_stream(i):
    path = scratch_dir(i.spark, "state-log")
    log = i.state_log
    log.write.parquet(path)
    return finished(i, stateful.state_stream(stream_log(i.spark, path, log.schema)), "state").drop("newest_at")


@check("SELECT migration_id, state FROM current_state", "state_log current_state")
def state_stream_out_of_order(i):
    """One file per micro-batch, each with events of all times: late events never turn a state back."""
    path = scratch_dir(i.spark, "state-log")
    log = i.state_log
    log.repartitionByRange(5, F.xxhash64("id")).write.parquet(path)
    seen = stateful.state_stream(stream_log(i.spark, path, log.schema, files_per_trigger=1), delay="36500 days")
    rows = finished(i, seen, "state").filter("not stuck")
    return rows.groupBy("migration_id").agg(F.max_by("state", "newest_at").alias("state"))


FLAG = "CASE WHEN value < 50 THEN 'low' ELSE 'high' END"
STORED = f"CASE WHEN event_id % 97 = 5 THEN NULL WHEN event_id % 89 = 7 THEN 'wrong' ELSE {FLAG} END"


@check(f"""SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, total, nulls, drifted, round((total - drifted)::double / total, 6) AS parity, (total - drifted)::double / total < 0.98 AS low_parity FROM
    (SELECT date_trunc('day', ts) AS window_start, count(*) AS total, count(*) FILTER (WHERE stored IS NULL) AS nulls, count(*) FILTER (WHERE stored IS DISTINCT FROM flag) AS drifted
     FROM (SELECT ts, {STORED} AS stored, {FLAG} AS flag FROM events) GROUP BY 1) WHERE window_start + INTERVAL 1 DAY <= {LAST} - INTERVAL 10 MINUTE""")
def drift_stream(i):
    s = events_stream(i).withColumn("stored", F.expr(STORED))
    return rounded(finished(i, monitors.drift_stream(s, "ts", "stored", FLAG, "1 day", "10 minutes", 0.98), "drift"))


@check("SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(i):
    return finished(i, monitors.dedup_stream(events_stream(i), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "dedup")


def _target(df):
    return df.selectExpr(
        "o_orderkey AS id", "o_totalprice AS amount", "CASE WHEN o_orderkey % 3 = 0 THEN 'preset' END AS tier",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'kept' END AS band")


def _backfill(i, folder):
    out = scratch_dir(i.spark, folder)
    log = backfill_stream(
        i.spark, i.dir, out, scratch_dir(i.spark, f"{folder}-checkpoint"), {"tier": TIER, "band": BAND}, i.table("orders").schema,
        glob="orders.parquet", prepare=_target)
    return out, log


@check(f"""SELECT id, CASE WHEN tier IS NULL THEN {TIER} ELSE tier END AS tier,
           CASE WHEN band IS NULL THEN {BAND} ELSE band END AS band FROM backfill_target""", "backfill_target")
def backfill_stream_table(i):
    out, _ = _backfill(i, "filled")
    return i.spark.read.parquet(f"{out}/table").select("id", "tier", "band")


@check("""SELECT count(*) AS rows, count(*) FILTER (WHERE tier IS NULL OR band IS NULL) AS filled, 0::bigint AS still_null FROM backfill_target""", "backfill_target")
def backfill_stream_progress(i):
    _, log = _backfill(i, "progress")
    return log.agg(*[F.sum(c).alias(c) for c in ("rows", "filled", "still_null")])


PLAN = dict(id="3", version=1, table="backfill_target", drop=("status",),
            add=(ColumnSpec("tier", "string", TIER), ColumnSpec("band", "string", BAND)))


def _requests(i):
    return RequestLog(i.requests, "client_id", "duration_ms", F.col("status_code") >= 500)


@check(f"""SELECT id, amount, CASE WHEN tier IS NULL THEN {TIER} ELSE tier END AS tier,
           CASE WHEN band IS NULL THEN {BAND} ELSE band END AS band FROM backfill_fresh""", "backfill_fresh")
def change_job_done(i):
    plan = Plan(**PLAN, slo=Slo(max_p99_latency_ms=400, max_error_rate_pct=40.0), steps=(25, 100))
    registry = registry_from_heartbeats(i.heartbeats).withColumn("compatible", F.lit(True))
    out = run_change(i.backfill_fresh, plan, _requests(i), scratch_dir(i.spark, "change"), registry=registry)
    return out.table


def _events(*moves):
    return " UNION ALL ".join(f"SELECT {n}::bigint AS id, '{a}' AS from_state, '{b}' AS to_state" for n, (a, b) in enumerate(zip(moves, moves[1:], strict=False), 1))


P99_SQL = """SELECT max(CASE WHEN rn - 1 = least(floor(0.99::double * n)::bigint, n - 1) THEN duration_ms END) FROM
    (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS rn, count(*) OVER () AS n FROM requests
     WHERE ('0x' || substr(md5('3' || cast(client_id AS varchar)), 1, 8))::bigint % 10000 < 2500)"""


@check(f"""SELECT e.*, CASE WHEN to_state = 'RollingBack' THEN 'breach at 25%: p99 ' || round_even(({P99_SQL}), 0)::bigint || 'ms > 50ms' END AS reason,
    (SELECT count(*) FROM backfill_fresh WHERE tier IS NOT NULL) AS tiers_kept FROM
    ({_events('Pending', 'Expanding', 'Backfilling', 'Verifying', 'Canary', 'RollingBack', 'RolledBack')}) e""", "backfill_fresh requests")
def change_job_rolled_back(i):
    """The canary breaches; the columns that were there before the change keep their values."""
    plan = Plan(**PLAN, slo=Slo(max_p99_latency_ms=50), steps=(25, 100))
    out = run_change(i.backfill_fresh, plan, _requests(i), scratch_dir(i.spark, "change"))
    kept = out.table.filter("tier is not null").count()
    return out.events.select("id", "from_state", "to_state", F.get_json_object("detail", "$.reason").alias("reason"), F.lit(kept).cast("long").alias("tiers_kept"))


@check("""SELECT 4::bigint AS ranges, count(*) AS rows, 'Done' AS state, 0::bigint AS nulls, 3::bigint AS checkpoints, 2::bigint AS done_at_stop FROM backfill_fresh""", "backfill_fresh")
def change_job_resumed(i):
    """Stopped within the backfill and finished later; finished ranges are not done again."""
    plan, target, path = Plan(**PLAN, batch_size=1), i.backfill_fresh, scratch_dir(i.spark, "change")
    range_rows = -(-target.count() // 4)
    run_change(target, plan, None, path, max_steps=4, range_rows=range_rows)
    stopped = read_log(i.spark, f"{path}/backfill-log", "backfill").count()
    out = run_change(target, plan, None, path, range_rows=range_rows)
    nulls = out.table.filter("tier is null or band is null").count()
    points = out.events.filter("from_state = to_state").count()
    log = read_log(i.spark, f"{path}/backfill-log", "backfill")
    return log.agg(F.count_distinct("batch_number").alias("ranges"), F.sum("rows_affected").alias("rows")).select(
        "*", F.lit(out.state).alias("state"), *[F.lit(x).cast("long").alias(n) for n, x in (("nulls", nulls), ("checkpoints", points), ("done_at_stop", stopped))])


EXAMPLE = {
    "id": "part-size-class", "version": 42, "table": "part", "strategy": "expand-contract",
    "expand": ["ALTER TABLE part ADD COLUMN IF NOT EXISTS size_class text", "CREATE INDEX CONCURRENTLY IF NOT EXISTS idx_size ON part (size_class)"],
    "backfill": {"column": "size_class", "batch_size": 5000, "throttle_ms": 20, "source_expr": SIZE_CLASS},
    "verify": {"mode": "shadow-read", "parity_threshold": 0.999, "sample_rate": 0.05},
    "contract": ["ALTER TABLE part DROP COLUMN IF EXISTS legacy_shipping"], "rollback": ["ALTER TABLE part DROP COLUMN IF EXISTS size_class"],
}


@check(f"SELECT id, weight, brand, shipping_class, {SIZE_CLASS} AS size_class FROM drift_target", "drift_target")
def change_job_example_plan(i):
    """A plan document with raw statements: the contract drops the legacy column."""
    return run_change(i.drift_target, Plan.from_dict(EXAMPLE), None, scratch_dir(i.spark, "change")).table


@check(f"""SELECT e.*, (SELECT max(lag_ms) FROM replicas) > 50 AS blocked FROM ({_events('Pending', 'Expanding', 'Backfilling', 'Verifying', 'Canary')}) e""", "replicas")
def change_job_lag_blocked(i):
    """Replication lag above the latency limit: the canary does not start, and the change waits there."""
    plan, path = Plan(**PLAN, slo=Slo(max_p99_latency_ms=50)), scratch_dir(i.spark, "change")
    try:
        run_change(i.backfill_fresh, plan, _requests(i), path, lag=i.replicas.select(F.col("lag_ms").alias("max_lag_ms")))
        blocked = False
    except ChangeError as e:
        blocked = "replication lag" in str(e)
    return read_log(i.spark, f"{path}/events", "state").select("id", "from_state", "to_state", F.lit(blocked).alias("blocked"))


@check("""SELECT * FROM (SELECT 1::bigint AS id, 'Pending' AS from_state, 'Expanding' AS to_state, count(*) AS target_rows FROM backfill_fresh
    UNION ALL SELECT 2, 'Expanding', 'Backfilling', count(*) FROM backfill_fresh UNION ALL SELECT 3, 'Backfilling', 'Verifying', count(*) FROM backfill_fresh
    UNION ALL SELECT 4, 'Verifying', 'Canary', count(*) FROM backfill_fresh UNION ALL SELECT 5, 'Canary', 'Cutover', count(*) FROM backfill_fresh
    UNION ALL SELECT 6, 'Cutover', 'RollingBack', count(*) FROM backfill_fresh UNION ALL SELECT 7, 'RollingBack', 'RolledBack', count(*) FROM backfill_fresh)""", "backfill_fresh")
def change_job_cutover_blocked(i):
    """Some services are not ready, so the cutover is refused and undone."""
    plan = Plan(**PLAN, slo=Slo(max_p99_latency_ms=400), steps=(25, 100))
    target = i.backfill_fresh
    out = run_change(target, plan, _requests(i), scratch_dir(i.spark, "change"), registry=registry_from_heartbeats(i.heartbeats))
    rows = target.count()
    return out.events.select("id", "from_state", "to_state", F.lit(rows).cast("long").alias("target_rows"))


GRANTS = f"""SELECT id, b::int AS batch_size, o AS tripped, sum(n) OVER (ORDER BY ts, id)::bigint - n AS granted_before, sum(n) OVER (ORDER BY ts, id)::bigint AS granted_after
    FROM (SELECT id, ts, b, o, CASE WHEN o THEN 0 ELSE b // 100 END::bigint AS n FROM walk WHERE rn > 0 AND target = 3 AND epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 2 * 86400000000 FROM health_samples WHERE target = 3))"""


def _paced(i, folder):
    out = scratch_dir(i.spark, folder)
    lines = i.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") == 1, "first").alias("place"))
    samples = shuffled_files(i, i.health_samples, files=4)
    paced_backfill(lines, "l_orderkey", {"place": "concat('line ', l_linenumber)"}, samples, 3, out, scratch_dir(i.spark, f"{folder}-checkpoint"), PACE,
                   delay="2 days", grain=200, grant="CASE WHEN tripped THEN 0 ELSE batch_size div 100 END")
    return out


@check(_with_walk(GRANTS), "health_samples scored")
def paced_backfill_samples(i):
    """What each health sample grants, over four micro-batches whose samples come up to two days late."""
    return i.spark.read.parquet(f"{_paced(i, 'paced')}/samples").select("id", "batch_size", "tripped", "granted_before", "granted_after")


@check(_with_walk(f""", granted AS ({GRANTS})
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'first' ELSE 'line ' || l_linenumber END AS place
    FROM (SELECT *, rank() OVER (ORDER BY l_orderkey) - 1 AS before FROM lineitem) WHERE before // 200 < (SELECT ceil(max(granted_after) / 200) FROM granted)"""), "health_samples scored")
def paced_backfill_table(i):
    """The rows up to the key that the samples allow, each once."""
    return i.spark.read.parquet(f"{_paced(i, 'paced-table')}/table").select("l_orderkey", "l_linenumber", "l_partkey", "place")


_LATE_BATCHES = "SELECT o_orderkey % 10 AS target, o_orderkey AS id, (SELECT min(ts) FROM events) + to_minutes(o_orderkey % 40000) AS ts FROM orders"


@check(f"""SELECT b.target, b.id, h.id AS sample_id, h.dead_tuples FROM ({_LATE_BATCHES}) b ASOF LEFT JOIN health_samples h ON h.target = b.target AND h.ts <= b.ts
    WHERE epoch_us(b.ts) <= (SELECT least((SELECT max(epoch_us(ts)) FROM ({_LATE_BATCHES})), (SELECT max(epoch_us(ts)) FROM events)) // 1000 * 1000 - 2 * 86400000000)""", "health_samples")
def attach_health_stream(i):
    """Batches and health samples as two streams, both up to two days late: the as-of join of the batch form."""
    start = F.lit(i.table("events").agg(F.min("ts").cast("timestamp")).first()[0])
    batches = i.table("orders").select((F.col("o_orderkey") % 10).alias("target"), F.col("o_orderkey").alias("id"), start.alias("_s")).select(
        "target", "id", F.expr("timestampadd(MINUTE, cast(id % 40000 AS int), _s)").alias("ts"))
    with rocksdb_state(i.spark):
        out = finished(i, attach_latest_stream(
            shuffled_files(i, batches), shuffled_files(i, i.health_samples), "target", {"sample_id": "id", "dead_tuples": "dead_tuples"}, "ts", delay="2 days", marks_delay="2 days"), "attached")
    return out.select("target", "id", "sample_id", "dead_tuples")


@check("""WITH came AS (SELECT epoch_us(ts) AS us, epoch_us(ts) + (event_id * 7919 % 172800) * 1000000 AS came FROM events),
    dealt AS (SELECT us, (came - lo) // step AS batch FROM came, (SELECT min(came) AS lo, (max(came) - min(came)) // 6 + 1 AS step FROM came)),
    marks AS (SELECT batch, max(max(us)) OVER (ORDER BY batch) // 1000 * 1000 - 21600000000 AS mark FROM dealt GROUP BY batch)
    SELECT d.batch::bigint AS batch_id, count(*) AS dropped FROM dealt d JOIN marks m ON m.batch = d.batch - 2 WHERE us <= mark GROUP BY d.batch""")
def late_row_account(i):
    """Rows come up to two days late where six hours are allowed; a batch drops what the watermark of the batch before it had passed."""
    rows = i.table("events").select(F.col("event_id").alias("id"), "ts")
    stream = shuffled_files(i, rows, late=F.col("id") * 7919 % 172_800 * 1_000_000)
    account = scratch_dir(i.spark, "late")
    with late_rows_to(i.spark, account):
        finished(i, monitors.dedup_stream(stream, "ts", ["id"], "6 hours"), "late-rows")
    return late_rows(i.spark, account).select("batch_id", "dropped")
