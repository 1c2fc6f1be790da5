"""Literal cases of the column rules, gates and reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from changeguard.functions.columns import clean_identifier, grade, index_name, is_identifier, shorten, slo_breach
from changeguard.operators import backfill, health, integrity, lifecycle, metrics, parity, reconcile, registry, report, runs, schema_change, slo
from changeguard.plans.plan import CANARY_STEPS, ColumnSpec, Plan, PlanError, Slo


def one(spark, ddl, *values):
    return spark.createDataFrame([values], ddl)


@pytest.mark.parametrize("values, low, high", [
    ((None, None, None, None, None), 0.5, 0.5), ((5, 100, 10.0, 0, 0), 0.982, 0.982), ((90, 100, 10.0, 0, 0), 0.727, 0.727),
    ((5, 100, 5000.0, 0, 0), 0.685, 0.685), ((100, 100, 5000.0, 20, 2_000_000), 0.1, 0.1), ((0, 0, 0.0, 0, 100_001), 0.95, 0.95),
])
def test_health_score(spark, values, low, high):
    df = one(spark, "active_conns int, max_conns int, max_lag_ms double, waiting_queries int, dead_tuples long", *values)
    score = health.score_health(df).first().score
    assert low - 1e-9 <= score <= high + 1e-9


@pytest.mark.parametrize("p99, err, limits, want", [
    (101.0, 0.0, (50, 1.0), (True, "p99 101ms > 50ms")), (50.0, 1.0, (50, 1.0), (False, None)), (101.0, 9.0, (0, 0.0), (False, None)),
    (10.0, 2.5, (50, 1.0), (True, "error-rate 2.50% > 1.00%")), (60.0, 2.5, (50, 1.0), (True, "p99 60ms > 50ms")), (None, None, (50, 1.0), (False, None)),
])
def test_slo_breach(spark, p99, err, limits, want):
    b, why = slo_breach("p", "e", *limits)
    assert one(spark, "p double, e double", p99, err).select(b, why).first()[:] == want


def test_text_helpers(spark):
    df = one(spark, "a string, b string, c string", " table; DROP", "ok-123_", "x" * 101)
    r = df.select(clean_identifier("a"), clean_identifier("b"), shorten("c", 100), F.length(index_name("c", "b")), is_identifier("b"), is_identifier(F.lit("_a1"))).first()
    assert r[:] == ("tableDROP", "ok123_", "x" * 100 + "...", 63, False, True)


def test_grades_at_the_limits(spark):
    df = spark.createDataFrame([(0.999,), (0.99,), (0.9899,)], "v double")
    assert [r[0] for r in df.select(grade("v", 0.999, 0.99)).collect()] == ["ok", "warn", "danger"]


def test_parity_of_nothing_is_one(spark):
    empty = spark.createDataFrame([], "id long, a string, b string")
    assert parity.drift_scan(empty, "a", "b").first()[:] == (0, 0, 0, 1.0)
    assert parity.sampled_parity(empty, "a", "b").first()[:] == (0, 0, 1.0)


def test_parity_counts_null_against_value_and_null_against_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x"), (3, "x", "x"), (4, "y", "x")], "id long, a string, b string")
    assert parity.drift_scan(df, "a", "b").first()[:] == (4, 2, 2, 0.5)


@pytest.mark.parametrize("rate", [0.0, -1.0, 1.0, 2.0])
def test_sample_rate_out_of_range_is_everything(spark, rate):
    df = spark.range(50).selectExpr("id", "'x' AS a", "'x' AS b")
    assert parity.sampled_parity(df, "a", "b", rate=rate).first().sampled == 50


@pytest.mark.parametrize("nulls, value, passed", [(1, 1.0, False), (0, 0.999, True), (0, 0.9989, False)])
def test_parity_gate(spark, nulls, value, passed):
    r = parity.parity_gate(one(spark, "nulls long, parity double", nulls, value), 0.99, 0.999).first()
    assert r.passed is passed and (r.reason is None) is passed


def test_shards():
    assert [b - a + 1 for _, a, b in backfill.shard_ranges(4, 1, 10)] == [2, 2, 2, 4]


def test_shards_cover_the_key_range(spark):
    df = spark.range(5, 1005)
    got = backfill.shard_report(df, "id", 7).agg(F.sum("row_count"), F.count("*")).first()
    assert got[:] == (1000, 7)
    ranges = {s: (a, b) for s, a, b in backfill.shard_ranges(7, 5, 1004)}
    for r in backfill.shard_report(df, "id", 7).collect():
        assert ranges[r["shard"]] == (r.first_key, r.last_key)


@pytest.mark.parametrize("rows, target, batch, want", [(0, 60.0, 1.0, 1), (10**9, 60.0, 1.0, 64), (10**6, 10.0, 2.0, 20), (10**6, 1.0, 5.0, 64)])
def test_optimal_shards(spark, rows, target, batch, want):
    df = one(spark, "r long, t double, b double", rows, target, batch)
    assert backfill.optimal_shards(df, "r", "t", "b").first().shards == want


def test_batches_partition_the_pending_rows(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'x' END AS c")
    got = backfill.plan_batches(df, "c", "id", 100).orderBy("batch_number").collect()
    assert [r.row_count for r in got] == [100] * 6 + [66]
    assert got[-1].running_rows == 666 and all(a.last_key < b.first_key for a, b in zip(got, got[1:], strict=False))


def test_fill_is_idempotent_and_keeps_values(spark):
    df = spark.createDataFrame([(1, None), (2, "kept")], "id long, c string")
    once = backfill.fill_pending(df, {"c": "concat('v', id)"})
    assert sorted(r[:] for r in once.collect()) == [(1, "v1"), (2, "kept")]
    assert sorted(backfill.fill_pending(once, {"c": "'other'"}).collect()) == sorted(once.collect())


def test_expand_keeps_an_existing_column(spark):
    out = schema_change.expand(one(spark, "id long, A string", 1, "x"), [ColumnSpec("a", "int"), ColumnSpec("b", "decimal(10,2)")])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("id", "bigint"), ("A", "string"), ("b", "decimal(10,2)")]


def test_contract(spark):
    df = spark.createDataFrame([(1, "x", "l"), (2, None, "l")], "id long, c string, legacy string")
    with pytest.raises(schema_change.ChangeError, match="c \\(1\\)"):
        schema_change.contract(df, ["legacy"], ["c"])
    out = schema_change.contract(df.filter("c IS NOT NULL"), ["legacy"], ["c"])
    assert out.columns == ["id", "c"] and not out.schema["c"].nullable
    with pytest.raises(Exception, match="NULL in column c"):
        schema_change.contract(df, [], ["c"], check=False).collect()
    with pytest.raises(schema_change.ChangeError, match="no such column"):
        schema_change.contract(df, [], ["zz"])


def test_verify_rollback(spark):
    assert schema_change.verify_rollback(one(spark, "id long, X int", 1, 2), ["x", "y"]) == ["x"]


def test_schema_diff(spark):
    a, b = one(spark, "id long, c string, d int", 1, "x", 1), one(spark, "id long, c int, e int", 1, 1, 1)
    got = {r.column_name: r.change for r in schema_change.schema_diff(a, b).collect()}
    assert got == {"c": "retyped", "d": "dropped", "e": "added"}


def test_reconcile_with_itself_is_clean(spark):
    df = spark.createDataFrame([(1, "a", None), (None, "b", 2.0)], "id long, c string, v double")
    assert {r.status for r in reconcile.reconcile(df, df, ["id"], ["c", "v"]).collect()} == {"same"}


def test_reconcile_counts_repeated_keys_once(spark):
    src = spark.createDataFrame([(1, "a")] * 3 + [(2, "b"), (3, "c")], "id long, c string")
    dst = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "id long, c string")
    got = {r.id: r[1:] for r in reconcile.reconcile(src, dst, ["id"], ["c"]).collect()}
    assert got == {1: ("duplicate", 0, 0), 2: ("changed", 1, 1), 3: ("missing", 0, 0), 4: ("extra", 0, 0)}


@pytest.mark.parametrize("algo", ["crc32", "md5", "xxhash64"])
def test_checksum_ignores_order_and_sees_nulls(spark, algo):
    data = [(i, f"r{i}" if i % 3 else None, i / 7) for i in range(200)]
    ddl = "id long, c string, v double"
    a = reconcile.table_checksum(spark.createDataFrame(data, ddl), algo=algo).first()
    assert a == reconcile.table_checksum(spark.createDataFrame(data[::-1], ddl).repartition(3), algo=algo).first()
    data[3] = (3, "", 3 / 7)
    assert a.checksum != reconcile.table_checksum(spark.createDataFrame(data, ddl), algo=algo).first().checksum


def test_orphans_skip_null_child_keys_and_null_parents(spark):
    child = spark.createDataFrame([(1,), (None,), (9,)], "fk long")
    parent = spark.createDataFrame([(1,), (None,)], "pk long")
    assert [r[0] for r in integrity.orphans(child, parent, "fk", "pk").collect()] == [9]


def test_row_diff_counts_copies(spark):
    a = spark.createDataFrame([(1, None)] * 3 + [(2, "x")], "id long, c string")
    b = spark.createDataFrame([(1, None), (3, "y")], "id long, c string")
    assert sorted(r[:] for r in reconcile.row_diff(a, b).collect()) == [(1, None, "only_in_a", 2), (2, "x", "only_in_a", 1), (3, "y", "only_in_b", 1)]


def requests(spark, slow_from=10_000):
    """Clients 0..999, ten requests each, slow if their cohort bucket is at least ``slow_from``."""
    from changeguard.functions.columns import key_bucket

    return spark.range(10_000).select(
        (F.col("id") % 1000).alias("client"), F.when(key_bucket(F.col("id") % 1000) >= slow_from, 101.0).otherwise(30.0).alias("ms"),
        F.lit(False).alias("err"))


def test_canary_breach_at_25_stops_the_rest(spark):
    run = slo.canary_run(requests(spark, 600), "client", "ms", F.col("err"), Slo(50, 1.0))
    got = {r.step: (r.outcome, r.reason) for r in run.collect()}
    assert got == {1: ("healthy", None), 5: ("healthy", None), 25: ("breach", "p99 101ms > 50ms"), 100: ("not_run", None)}
    assert {r.decision for r in run.collect()} == {"rollback"}


def test_canary_healthy_and_without_data(spark):
    run = slo.canary_run(requests(spark), "client", "ms", F.col("err"), Slo(50, 1.0))
    assert {(r.outcome, r.decision) for r in run.collect()} == {("healthy", "promote")}
    none = slo.canary_run(requests(spark).filter("client < 0"), "client", "ms", F.col("err"), Slo(50, 1.0))
    assert {(r.outcome, r.decision) for r in none.collect()} == {("no_data", "hold")}


def test_error_rate_breach(spark):
    log = spark.range(200).selectExpr("id AS client", "10.0D AS ms", "id % 20 = 0 AS err")
    run = slo.canary_run(log, "client", "ms", F.col("err"), Slo(0, 4.0), steps=[100], on_failure="pause").first()
    assert (run.reason, run.decision) == ("error-rate 5.00% > 4.00%", "pause")


@pytest.mark.parametrize("lag, want", [(100.0, (False, "proceed")), (101.0, (True, "proceed")), (201.0, (True, "wait")), (301.0, (True, "fail")), (None, (False, "proceed"))])
def test_lag_gate(spark, lag, want):
    assert slo.lag_gate(one(spark, "max_lag_ms double", lag), Slo(100)).first()[1:] == want


def test_replication_without_replicas_and_with_unknown_lag(spark):
    none = spark.createDataFrame([], "replica string, lag_ms double")
    assert health.replication_status(none).first()[:] == (0, 0.0, "none")
    some = spark.createDataFrame([("a", None), ("b", 5.0)], "replica string, lag_ms double")
    assert health.replication_status(some).first()[:] == (2, 5.0, "b")


@pytest.mark.parametrize("queue, lag, want", [(5, 30_000.0, (False, None)), (6, 0.0, (True, "lock_queue")), (0, 30_001.0, (True, "replication_lag"))])
def test_preflight(spark, queue, lag, want):
    r = health.preflight(one(spark, "waiting_queries long", queue), one(spark, "max_lag_ms double", lag)).first()
    assert (r.blocked, r.reason) == want


def test_lock_blocking_matches_the_pairs(spark):
    ddl = ", ".join(f"{c} string" for c in health.LOCK_OBJECT) + ", pid long, granted boolean"
    def lock(obj, pid, granted):
        return ("relation", "1", obj, *[None] * 7, pid, granted)
    locks = spark.createDataFrame([lock("t", 1, True), lock("t", 2, False), lock("t", 3, False), lock(None, 4, False), lock(None, 5, True), lock("u", 6, False)], ddl)
    act = spark.createDataFrame([(i, f"q{i}") for i in range(1, 7)], "pid long, query string")
    got = {r.blocked_pid: (r.blocking_requests, r.blocking_pid) for r in health.lock_blocking(locks, act).collect()}
    assert got == {2: (2, 1), 3: (2, 1), 4: (1, 5)}
    for pid, (n, _) in got.items():
        assert health.blocking_pairs(locks, act, pid).count() == n


def test_readiness_and_versions(spark):
    reg = spark.createDataFrame([("m", "a", 1, True), ("m", "b", 2, False), ("n", "a", 1, True)], "migration_id string, service_name string, schema_version int, compatible boolean")
    assert {r.migration_id: r.all_ready for r in registry.service_readiness(reg).collect()} == {"m": False, "n": True}
    assert {r.migration_id: r.versions for r in registry.service_versions(reg).collect()} == {"m": {"a": 1, "b": 2}, "n": {"a": 1}}
    assert {r.migration_id: r.versions for r in registry.service_versions(reg, list_limit=1).filter("chunk = 0").collect()} == {"m": {"a": 1}, "n": {"a": 1}}
    assert registry.service_versions(reg, list_limit=1).filter("chunk = 1").first().versions == {"b": 2}


def test_liveness_lists(spark):
    base = dt.datetime(2024, 1, 1)
    reg = spark.createDataFrame([("m", "b", base), ("m", "a", base), ("m", "c", base + dt.timedelta(seconds=60)), ("n", "z", base + dt.timedelta(seconds=30))],
                                "migration_id string, service_name string, last_heartbeat timestamp")
    as_of = F.lit(base + dt.timedelta(seconds=60))
    got = {r.migration_id: (r.dead, r.alive, r.dead_services) for r in registry.liveness(reg, as_of, 30).collect()}
    assert got == {"m": (2, False, ["a", "b"]), "n": (0, True, [])}
    cut = {(r.migration_id, r.chunk): r.dead_services for r in registry.liveness(reg, as_of, 30, list_limit=1).collect()}
    assert cut == {("m", 0): ["a"], ("m", 1): ["b"], ("n", 0): []} and registry.dead_services(reg, as_of, 30).count() == 2


def test_success_rate_without_finished_changes(spark):
    df = spark.createDataFrame([("m", "Canary")], "migration_id string, state string")
    assert lifecycle.success_rate(df).first().success_rate == 0


def test_progress_of_states(spark):
    df = spark.createDataFrame([("Pending",), ("Canary",), ("Done",), ("RollingBack",)], "state string")
    assert [r.progress_pct for r in lifecycle.flow_progress(df).collect()] == [13, 63, 100, 0]


def test_counter_reset_and_window(spark):
    rows = [(1, 0, 10), (2, 100, 15), (3, 200, 3), (4, 900, 4)]
    df = spark.createDataFrame(rows, "id long, t long, value long").select("id", F.lit("s").alias("series"), F.timestamp_seconds("t").alias("ts"), "value")
    got = {r.id: r["increase"] for r in metrics.increase(df, 600, ["series"]).collect()}
    assert got == {1: 0, 2: 5, 3: 8, 4: 0}


def test_retry_sequence(spark):
    base = dt.datetime(2024, 1, 1)
    def row(i, start, end, ok):
        return (i, "m", "s", base + dt.timedelta(seconds=start), base + dt.timedelta(seconds=end), ok)
    log = spark.createDataFrame([row(1, 0, 1, False), row(2, 2, 3, False), row(3, 5, 6, True), row(4, 50, 51, False)],
                                "id long, migration_id string, statement string, started_at timestamp, completed_at timestamp, success boolean")
    got = [r[:] for r in runs.retry_sequences(log).orderBy("id").select("attempt", "wait_s", "expected_wait_s", "final_success").collect()]
    assert got == [(1, None, None, True), (2, 1.0, 1.0, True), (3, 2.0, 2.0, True), (1, None, None, False)]


def test_outcomes(spark):
    got = spark.createDataFrame([("a", 20.0, 10_000), ("b", 45.0, 9_999), ("c", 15.0, 9_999), ("d", 1.0, 1)], "scenario string, duration_s double, final_rows long")
    want = spark.createDataFrame([("a", 10.0, False, 10_000), ("b", 5.0, False, 10_000), ("c", 15.0, False, 10_000), ("d", 1.0, True, 10_000)], "scenario string, max_downtime_s double, loss_allowed boolean, expected_rows long")
    assert {r.scenario: r.reasons for r in report.check_outcomes(got, want).collect()} == {"a": "downtime", "b": "data_loss,downtime", "c": "data_loss", "d": ""}


def test_cost(spark):
    r = report.cost_report(one(spark, "hours double", 8.0)).first()
    assert (r.manual_cost_low, r.manual_cost_high, r.hours_saved, r.cost_saved) == (4800.0, 8000.0, 40.0, 4000.0)


def test_plan_defaults_and_errors():
    doc = {"id": "p", "version": 1, "table": "t", "backfill": {"column": "c", "source_expr": "1"}}
    plan = Plan.from_dict(doc)
    assert (plan.steps, plan.on_failure, plan.parity_threshold, plan.exprs) == (CANARY_STEPS, "rollback", 0.999, {"c": "1"})
    for change in ({"canary": {"steps": [0]}}, {"version": 0}, {"table": "1t"}, {"on_failure": "retry"}, {"strategy": "x"}, {"id": ""}, {"backfill": {"column": "c"}}):
        with pytest.raises(PlanError):
            Plan.from_dict({**doc, **change})


def test_plan_from_yaml():
    pytest.importorskip("yaml")
    plan = Plan.from_yaml("""
id: add-class
version: 2
table: items
add_columns:
  - {name: size_class, type: string, expression: "'x'"}
  - {name: note, type: string, nullable: true}
drop_columns: [legacy]
slo: {max_p99_latency_ms: 50, max_error_rate_pct: 1.0, min_parity: 0.9999}
""")
    assert plan.required == ["size_class"] and plan.min_parity == 0.9999 and plan.drop == ("legacy",)


def test_not_null_of_every_type(spark):
    df = spark.sql("select cast(1.5 as decimal(12,2)) a, cast(0.5 as decimal(2,2)) b, timestamp_ntz'2024-01-01 00:00:00' c, x'01' d, true e, date'2024-01-01' f union all select null, null, null, null, null, null")
    full = df.filter("a is not null")
    out = schema_change.contract(full, (), df.columns)
    assert not any(f.nullable for f in out.schema) and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in full.collect()]
    with pytest.raises(schema_change.ChangeError, match="not supported"):
        schema_change.contract(spark.sql("select array(1) a"), (), ["a"])


def test_lock_representative_has_activity(spark):
    ddl = "locktype string, database long, relation long, page long, tuple long, virtualxid string, transactionid long, classid long, objid long, objsubid long, pid long, granted boolean"
    locks = spark.createDataFrame([("r", 1, 7, None, None, None, None, None, None, None, p, p == 1) for p in (1, 5, 9)], ddl)
    act = spark.createDataFrame([(5, "q5"), (9, "q9")], "pid long, query string")
    got = {r.blocked_pid: (r.blocking_requests, r.blocking_pid, r.blocking_query) for r in health.lock_blocking(locks, act).collect()}
    assert got == {5: (2, 9, "q9"), 9: (2, 5, "q5")}
    none = health.lock_blocking(locks, act.filter("pid = 5")).collect()
    assert {(r.blocked_pid, r.blocking_pid, r.blocked_query) for r in none} == {(5, None, "q5"), (9, 5, None)}


def test_as_of_join_with_text_ids_and_null_keys(spark):
    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    events = spark.createDataFrame([("m", "e-b", "Canary", t(5)), ("m", "e-a", "Backfilling", t(5)), ("m", "e-c", "Pending", t(1)), (None, "e-d", "Done", t(1))],
                                   "migration_id string, id string, to_state string, created_at timestamp")
    log = spark.createDataFrame([("m", "x", t(5)), ("m", "y", t(3)), (None, "z", t(9)), ("m", "w", t(0))], "migration_id string, id string, at timestamp")
    assert {r.id: r.state for r in lifecycle.state_at(log, events, "at").collect()} == {"x": "Canary", "y": "Pending", "z": None, "w": None}


def test_order_of_reports(spark):
    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    rows = [(f"m{i}", "Canary", t(i * 7 % 20), i % 4 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "migration_id string, state string, updated_at timestamp, terminal boolean").repartition(5)
    newest = [r.updated_at for r in lifecycle.recent(df, "updated_at", "migration_id").collect()]
    assert newest == sorted(newest, reverse=True)
    waiting = [(r.updated_at, r.migration_id) for r in lifecycle.resumable(df).collect()]
    assert waiting == sorted(waiting) and len(waiting) == 15
