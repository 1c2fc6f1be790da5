"""Queries over request logs and health samples: objectives, rollouts, pacing, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeguard.operators import fold, health, panes, slo
from changeguard.plans.plan import Slo, ThrottleConfig
from suite.base import check, latest, rounded



def is_error():
    return F.col("status_code") >= 500


def _nearest(p):
    return f"max(CASE WHEN rn - 1 = least(floor({p} * n)::bigint, n - 1) THEN duration_ms END)"


@check(f"""SELECT route, n, errors, round(elapsed_s, 6) AS elapsed_s, round(n / elapsed_s, 6) AS throughput, round(mean, 6) AS mean, p50, p95, p99, max FROM
    (SELECT client_id % 2 = 0 AS route, count(*) FILTER (WHERE status_code < 500) AS n, count(*) FILTER (WHERE status_code >= 500) AS errors,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double AS elapsed_s, avg(duration_ms) FILTER (WHERE status_code < 500) AS mean,
      max(duration_ms) FILTER (WHERE status_code < 500) AS max FROM requests GROUP BY 1)
    JOIN (SELECT route, {_nearest('0.5::double')} AS p50, {_nearest('0.95::double')} AS p95, {_nearest('0.99::double')} AS p99 FROM
      (SELECT client_id % 2 = 0 AS route, duration_ms, row_number() OVER (PARTITION BY client_id % 2 = 0 ORDER BY duration_ms) AS rn,
              count(*) OVER (PARTITION BY client_id % 2 = 0) AS n FROM requests WHERE status_code < 500) GROUP BY route) USING (route)""", "requests")
def latency_report(i):
    log = i.requests.withColumn("route", F.col("client_id") % 2 == 0)
    return rounded(slo.latency_report(log, "duration_ms", is_error(), "ts", ["route"]))


@check("SELECT route, count(duration_ms) AS n, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM requests GROUP BY route", "requests")
def p99_interpolated(i):
    return rounded(slo.p_cont(i.requests, "duration_ms", 0.99, ["route"], "p99"))


@check("""SELECT count(duration_ms) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM requests
    WHERE ts > (SELECT max(ts) FROM requests) - INTERVAL 5 DAY""", "requests")
def p95_trailing_window(i):
    log = i.requests.withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(slo.p_cont(slo.trailing(log, "ts", latest(log, "ts"), 5 * 86400), "duration_ms", 0.95, [], "p95"))


@check("""WITH p AS (SELECT route, epoch_us(ts) // 21600000000 AS pane, count(duration_ms) AS n FROM requests WHERE duration_ms IS NOT NULL GROUP BY ALL)
    SELECT a.route, make_timestamp((a.pane + 1) * 21600000000) AS window_end, CAST(sum(b.n) AS BIGINT) AS n, true AS near
    FROM p AS a JOIN p AS b ON a.route = b.route AND b.pane BETWEEN a.pane - 10 AND a.pane GROUP BY a.route, a.pane""", "requests")
def p99_of_every_window(i):
    """Eleven panes of six hours in every window, the log sketched once: each p99 has a rank within the stated error of the wanted one."""
    parts = panes.percentile_panes(i.requests, "ts", "duration_ms", 21_600, ["route"])
    found = panes.trailing_percentiles(parts, 11, 0.99, ["route"], 21_600)
    seen = i.requests.filter("duration_ms is not null").select("route", "duration_ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).alias("pane"))
    held = seen.select("route", "duration_ms", F.explode(F.sequence(F.col("pane") + 1, F.col("pane") + 11)).alias("end"))
    ranks = held.withColumn("window_end", F.timestamp_micros(F.col("end") * 21_600_000_000)).join(found, ["route", "window_end"]).groupBy("route", "window_end", "n").agg(
        F.count_if(F.col("duration_ms") < F.col("p99")).alias("below"), F.count_if(F.col("duration_ms") <= F.col("p99")).alias("upto"))
    off = panes.RANK_ERROR * F.col("n") + 1
    return ranks.select("route", "window_end", "n", ((F.col("below") <= 0.99 * F.col("n") + off) & (F.col("upto") >= 0.99 * F.col("n") - off)).alias("near"))


@check("SELECT route, count(duration_ms) AS n, true AS near FROM requests GROUP BY route", "requests")
def p99_sketch(i):
    """No engine has the same sketch: its rank must be within 1/accuracy of the wanted one."""
    found = slo.p_approx(i.requests, "duration_ms", 0.99, ["route"], "p99")
    ranks = i.requests.join(found, "route").groupBy("route", "n").agg(
        F.count_if(F.col("duration_ms") < F.col("p99")).alias("below"), F.count_if(F.col("duration_ms") <= F.col("p99")).alias("upto"))
    off = F.col("n") / 10_000 + 1
    return ranks.select("route", "n", ((F.col("below") <= 0.99 * F.col("n") + off) & (F.col("upto") >= 0.99 * F.col("n") - off)).alias("near"))


@check("""SELECT client_id, count(*) FILTER (WHERE status_code >= 500) AS errors, count(*) AS total,
    round(count(*) FILTER (WHERE status_code >= 500)::double / count(*), 6) AS error_rate FROM requests GROUP BY client_id""", "requests")
def error_rate(i):
    return rounded(slo.error_rate(i.requests, is_error(), ["client_id"]))


GATE = Slo(max_p99_latency_ms=230, max_error_rate_pct=20.0)


@check("""SELECT client_id, p99_ms, round(err_pct, 6) AS err_pct, p99_ms > 230 OR err_pct > 20 AS slo_breached,
    CASE WHEN p99_ms > 230 THEN 'p99 ' || round_even(p99_ms, 0)::bigint || 'ms > 230ms'
         WHEN err_pct > 20 THEN printf('error-rate %.2f%% > 20.00%%', err_pct) END AS reason
    FROM (SELECT client_id, max(duration_ms) AS p99_ms, count(*) FILTER (WHERE status_code >= 500) * 100.0::double / count(*) AS err_pct FROM requests GROUP BY 1)""", "requests")
def slo_gate(i):
    obs = i.requests.groupBy("client_id").agg(
        F.max("duration_ms").alias("p99_ms"), (F.count_if(is_error()) * 100.0 / F.count("*")).alias("err_pct"))
    return rounded(slo.slo_gate(obs, GATE))


def _canary_sql(max_p99, max_err, fail, client="client_id"):
    bucket = f"('0x' || substr(md5('v1' || coalesce(cast({client} AS varchar), '')), 1, 8))::bigint % 10000"
    return f"""WITH r AS (SELECT step, duration_ms, status_code >= 500 AS err,
          row_number() OVER (PARTITION BY step ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY step) AS c
        FROM requests, (SELECT unnest([1, 5, 25, 100]) AS step) WHERE {bucket} < 100 * step),
      o AS (SELECT step, count(duration_ms) AS n, count(*) FILTER (WHERE err) AS errors,
          max(CASE WHEN rn - 1 = least(floor(0.99::double * c)::bigint, c - 1) THEN duration_ms END) AS p99_ms
        FROM (SELECT unnest([1, 5, 25, 100]) AS step) LEFT JOIN r USING (step) GROUP BY step),
      g AS (SELECT *, errors * 100.0::double / nullif(n, 0) AS err_pct,
          coalesce(p99_ms > {max_p99}, false) OR coalesce(errors * 100.0::double / nullif(n, 0) > {max_err}, false) AS breach FROM o),
      s AS (SELECT *, coalesce(bool_or(breach) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM g),
      f AS (SELECT *, CASE WHEN stopped THEN 'not_run' WHEN n = 0 THEN 'no_data' WHEN breach THEN 'breach' ELSE 'healthy' END AS outcome FROM s)
      SELECT step, step AS traffic_pct, CASE WHEN NOT stopped THEN n END::double AS n,
        CASE WHEN NOT stopped AND n > 0 THEN errors END::double AS errors, CASE WHEN NOT stopped THEN p99_ms END AS p99_ms,
        CASE WHEN NOT stopped THEN round(err_pct, 6) END AS err_pct, CASE WHEN NOT stopped THEN breach END AS slo_breached,
        CASE WHEN stopped THEN NULL WHEN p99_ms > {max_p99} THEN 'p99 ' || round_even(p99_ms, 0)::bigint || 'ms > {max_p99}ms'
          WHEN err_pct > {max_err} THEN printf('error-rate %.2f%% > {max_err:.2f}%%', err_pct) END AS reason, outcome,
        CASE WHEN (SELECT bool_or(outcome = 'breach') FROM f) THEN '{fail}' WHEN (SELECT bool_or(outcome = 'no_data') FROM f) THEN 'hold' ELSE 'promote' END AS decision
      FROM f"""


def _counted(run):
    """Counts of steps that did not run are NULL; as doubles both engines show them alike."""
    return rounded(run.withColumns({c: F.col(c).cast("double") for c in ("n", "errors")}))


@check(_canary_sql(300, 30.0, "rollback"), "requests")
def canary_run(i):
    limits = Slo(max_p99_latency_ms=300, max_error_rate_pct=30.0)
    return _counted(slo.canary_run(i.requests, "client_id", "duration_ms", is_error(), limits, salt="v1"))


@check(_canary_sql(300, 30.0, "rollback", "CASE WHEN client_id % 3 > 0 THEN client_id END"), "requests")
def canary_run_null_clients(i):
    """A third of the clients is unknown; their requests are judged as well."""
    limits = Slo(max_p99_latency_ms=300, max_error_rate_pct=30.0)
    log = i.requests.withColumn("client_id", F.expr("CASE WHEN client_id % 3 > 0 THEN client_id END"))
    return _counted(slo.canary_run(log, "client_id", "duration_ms", is_error(), limits, salt="v1"))


@check(_canary_sql(100, 30.0, "pause"), "requests")
def canary_run_breach(i):
    limits = Slo(max_p99_latency_ms=100, max_error_rate_pct=30.0)
    return _counted(slo.canary_run(i.requests, "client_id", "duration_ms", is_error(), limits, on_failure="pause", salt="v1"))


@check("""SELECT id, max_lag_ms, max_lag_ms > 100 AS start_blocked,
    CASE WHEN max_lag_ms > 300 THEN 'fail' WHEN max_lag_ms > 200 THEN 'wait' ELSE 'proceed' END AS step_action FROM health_samples""", "health_samples")
def lag_gate(i):
    return slo.lag_gate(i.health_samples.select("id", "max_lag_ms"), Slo(max_p99_latency_ms=100))


@check("""SELECT site, count(*) AS replica_count, coalesce(max(lag_ms), 0) AS max_lag_ms,
    coalesce(first(replica ORDER BY coalesce(lag_ms, '-inf'::double) DESC, replica DESC), 'none') AS worst_replica FROM replicas GROUP BY site""", "replicas")
def replication_status(i):
    return health.replication_status(i.replicas, ["site"])


@check("""SELECT host, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'idle') AS idle,
    2000::bigint AS max_conns, round(count(*) FILTER (WHERE state = 'active') * 100.0::double / 2000, 6) AS used_pct FROM activity GROUP BY host""", "activity")
def connection_usage(i):
    return rounded(health.connection_usage(i.activity, 2000, ["host"]))


@check("""SELECT 'state' AS dimension, state AS value, count(*) AS n FROM activity GROUP BY state
    UNION ALL SELECT 'application_name', application_name, count(*) FROM activity GROUP BY application_name
    UNION ALL SELECT 'wait_event_type', wait_event_type, count(*) FROM activity WHERE wait_event_type IS NOT NULL GROUP BY wait_event_type
    UNION ALL SELECT 'wait_event_type / state', coalesce(wait_event_type, '-') || ' / ' || state, count(*) FROM activity GROUP BY wait_event_type, state""", "activity")
def activity_breakdown(i):
    return health.activity_breakdown(i.activity, ["state", "application_name", "wait_event_type", ["wait_event_type", "state"]])


WAITING = "state = 'active' AND wait_event_type = 'Lock' AND query NOT LIKE '%query 13%'"


@check(f"""SELECT host, count(*) FILTER (WHERE {WAITING}) AS waiting_queries,
    first(pid ORDER BY query_start, pid) FILTER (WHERE {WAITING}) AS oldest_pid,
    first(query ORDER BY query_start, pid) FILTER (WHERE {WAITING}) AS oldest_query FROM activity GROUP BY host""", "activity")
def lock_queue(i):
    return health.lock_queue(i.activity, ["host"], "query 13")


@check("""SELECT target, waiting_queries, max_lag_ms, waiting_queries > 5 OR max_lag_ms > 30000 AS blocked,
    CASE WHEN waiting_queries > 5 THEN 'lock_queue' WHEN max_lag_ms > 30000 THEN 'replication_lag' END AS reason FROM
    (SELECT user_id % 40 AS target, count(*) FILTER (WHERE event_type = 'error' AND value > 150) AS waiting_queries, max(value) * 100 AS max_lag_ms FROM events GROUP BY 1)""")
def preflight_gate(i):
    rows = i.table("events").withColumn("target", F.col("user_id") % 40).groupBy("target")
    queue = rows.agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("waiting_queries"))
    return health.preflight(queue, rows.agg((F.max("value") * 100).alias("max_lag_ms")), ["target"])


@check("SELECT id, round(score, 6) AS score FROM scored", "health_samples scored")
def health_score(i):
    return rounded(health.score_health(i.health_samples).select("id", "score"))


@check("""SELECT target, id, round(sum(score) OVER w, 6) AS score_sum, round(min(score) OVER w, 6) AS min_score, count(*) OVER w AS sample_count
    FROM scored WINDOW w AS (PARTITION BY target ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""", "health_samples scored")
def rolling_health(i):
    total = (F.col("mean_score") * F.col("sample_count")).alias("score_sum")
    return rounded(health.rolling_health(i.health_samples).select("target", "id", total, "min_score", "sample_count"))


@check("""SELECT pid, query, query_start, round((epoch_us((SELECT max(query_start) FROM activity)) - epoch_us(query_start)) / 1e6::double, 6) AS age_s
    FROM activity WHERE state = 'active' AND query_start < (SELECT max(query_start) FROM activity) - INTERVAL 600 SECOND AND query NOT LIKE '%query 7%'""", "activity")
def long_running(i):
    a = i.activity
    return rounded(health.long_running(a, latest(a, "query_start"), 600, exclude=["query 7"]).select("pid", "query", "query_start", "age_s"))


SAME_LOCK = " AND ".join(f"b.{c} IS NOT DISTINCT FROM w.{c}" for c in health.LOCK_OBJECT)


@check(f"""SELECT x.pid AS blocked_pid, x.blocking_requests, x.blocking_pid, x.locktype, x.relation::varchar AS relation, p.query AS blocked_query, q.query AS blocking_query FROM
    (SELECT w.rid, w.pid, w.locktype, w.relation, count(*) AS blocking_requests,
        CASE WHEN w.pid = least(min(b.pid), w.pid) THEN max(b.pid) ELSE min(b.pid) END AS blocking_pid
     FROM (SELECT *, row_number() OVER () AS rid FROM locks) w JOIN locks b ON {SAME_LOCK} AND b.pid <> w.pid
     WHERE NOT w.granted GROUP BY w.rid, w.pid, w.locktype, w.relation) x
    JOIN lock_activity p ON p.pid = x.pid JOIN lock_activity q ON q.pid = x.blocking_pid""", "locks lock_activity")
def lock_blocking(i):
    return health.lock_blocking(i.locks, i.lock_activity).withColumn("relation", F.col("relation").cast("string"))


@check(f"""SELECT x.pid AS blocked_pid, x.blocking_requests, x.blocking_pid, x.locktype, x.relation::varchar AS relation, p.query AS blocked_query, q.query AS blocking_query FROM
    (SELECT w.rid, w.pid, w.locktype, w.relation, count(*) AS blocking_requests,
        CASE WHEN w.pid = least(min(b.pid) FILTER (WHERE b.pid % 3 > 0), CASE WHEN w.pid % 3 > 0 THEN w.pid END)
             THEN max(b.pid) FILTER (WHERE b.pid % 3 > 0) ELSE min(b.pid) FILTER (WHERE b.pid % 3 > 0) END AS blocking_pid
     FROM (SELECT *, row_number() OVER () AS rid FROM locks) w JOIN locks b ON {SAME_LOCK} AND b.pid <> w.pid
     WHERE NOT w.granted GROUP BY w.rid, w.pid, w.locktype, w.relation) x
    LEFT JOIN (SELECT * FROM lock_activity WHERE pid % 3 > 0) p ON p.pid = x.pid LEFT JOIN lock_activity q ON q.pid = x.blocking_pid""", "locks lock_activity")
def lock_blocking_partial_activity(i):
    """A third of the processes has no activity row; no blocked request gets lost."""
    return health.lock_blocking(i.locks, i.lock_activity.filter("pid % 3 > 0")).withColumn("relation", F.col("relation").cast("string"))


@check(f"""SELECT w.pid AS blocked_pid, b.pid AS blocking_pid, w.locktype, w.relation::varchar AS relation, p.query AS blocked_query, q.query AS blocking_query
    FROM locks w JOIN locks b ON {SAME_LOCK} AND b.pid <> w.pid JOIN lock_activity p ON p.pid = w.pid JOIN lock_activity q ON q.pid = b.pid
    WHERE NOT w.granted AND w.pid = 8""", "locks lock_activity")
def blocking_pairs_of_one(i):
    return health.blocking_pairs(i.locks, i.lock_activity, 8).withColumn("relation", F.col("relation").cast("string"))


PACE = ThrottleConfig(trip_below=0.3)
PACE_SQL = """,
    line AS (SELECT target, id, ts, score, row_number() OVER (PARTITION BY target ORDER BY ts, id) AS rn FROM scored),
    walk AS (
      SELECT target, 0::bigint AS rn, NULL::bigint AS id, NULL::timestamp AS ts, NULL::double AS score, 5000 AS b, 20 AS p, false AS o, 0 AS good, 0 AS bad, 0 AS trips, false AS adapt
      FROM (SELECT DISTINCT target FROM line)
      UNION ALL
      SELECT target, rn, id, ts, score,
        CASE WHEN recovers THEN 5000 WHEN NOT adapts THEN b WHEN score > 0.8 THEN least(b * 15 // 10, 50000) WHEN score < 0.3 THEN greatest(b * 5 // 10, 100) WHEN score < 0.5 THEN greatest(b * 8 // 10, 100) ELSE b END,
        CASE WHEN recovers THEN 20 WHEN NOT adapts THEN p WHEN score > 0.8 THEN greatest(p - 5, 0) WHEN score < 0.3 THEN least(p + 50, 5000) WHEN score < 0.5 THEN least(p + 20, 5000) ELSE p END,
        CASE WHEN recovers THEN false WHEN trips_now THEN true ELSE o END,
        CASE WHEN o AND score > 0.3 AND NOT recovers THEN good + 1 ELSE 0 END,
        CASE WHEN NOT o AND score < 0.3 AND NOT trips_now THEN bad + 1 ELSE 0 END,
        trips + trips_now::int, adapts
      FROM (SELECT l.target, l.rn, l.id, l.ts, l.score, w.b, w.p, w.o, w.good, w.bad, w.trips,
              w.o AND l.score > 0.3 AND w.good >= 2 AS recovers, NOT w.o AND l.score < 0.3 AND w.bad >= 2 AS trips_now,
              NOT w.o AND NOT (l.score < 0.3 AND w.bad >= 2) AS adapts
            FROM walk w JOIN line l ON l.target = w.target AND l.rn = w.rn + 1))
    """


def _with_walk(tail):
    return "WITH _unused AS (SELECT 1)" + PACE_SQL + tail


@check(_with_walk("""SELECT target, id, round(score, 6) AS score, b::int AS batch_size, p::int AS throttle_ms, o AS tripped, trips::int AS trip_count FROM walk WHERE rn > 0"""),
       "health_samples scored")
def throttle_trace(i):
    return rounded(fold.throttle_trace(i.health_samples, PACE).drop("ts"))


@check(_with_walk("""SELECT target, trips::int AS episode, min(ts) FILTER (WHERE o) AS tripped_at, min(ts) FILTER (WHERE NOT o) AS recovered_at,
    round((epoch_us(min(ts) FILTER (WHERE NOT o)) - epoch_us(min(ts) FILTER (WHERE o))) / 1e6::double, 6) AS open_s FROM walk WHERE trips > 0 GROUP BY target, trips"""),
       "health_samples scored")
def breaker_episodes(i):
    return rounded(fold.breaker_episodes(fold.throttle_trace(i.health_samples, PACE)))


@check("""WITH line AS (SELECT client_id, request_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_id ORDER BY ts, request_id) AS rn FROM requests),
    walk AS (SELECT client_id, request_id, us, rn, 2 * 28800000000 AS level, true AS allowed FROM line WHERE rn = 1
      UNION ALL SELECT client_id, request_id, us, rn, CASE WHEN full_now >= 28800000000 THEN full_now - 28800000000 ELSE full_now END, full_now >= 28800000000
      FROM (SELECT l.*, least(3 * 28800000000, w.level + (l.us - w.us)) AS full_now FROM walk w JOIN line l ON l.client_id = w.client_id AND l.rn = w.rn + 1))
    SELECT client_id, request_id, allowed FROM walk""", "requests")
def token_bucket(i):
    return fold.rate_limit(i.requests, tokens=1, seconds=28800, burst=3).drop("ts")
