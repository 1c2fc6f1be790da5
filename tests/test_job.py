"""The gated change: finish, resume, roll back, refuse."""

import pytest
from pyspark.sql import functions as F

from changeguard.operators.schema_change import ChangeError
from changeguard.plans.job import RequestLog, run_change
from changeguard.plans.plan import ColumnSpec, Plan, PlanError, Slo

EXPR = "CASE WHEN weight < 10 THEN 'light' ELSE 'heavy' END"


@pytest.fixture
def items(spark):
    return spark.range(200).selectExpr("id", "id % 20 AS weight", "concat('old', id % 3) AS legacy")


def plan(**kw):
    return Plan(**{**dict(id="p1", version=1, table="items", add=(ColumnSpec("class", "string", EXPR),), drop=("legacy",), slo=Slo(50, 1.0)), **kw})


def log(spark, ms=30.0):
    return RequestLog(spark.range(5000).select((F.col("id") % 2000).alias("client"), F.lit(ms).alias("ms")), "client", "ms", F.lit(False))


def states(result):
    return [r.to_state for r in result.events.orderBy("id").collect()]


def test_finishes(spark, items, tmp_path):
    r = run_change(items, plan(), log(spark), str(tmp_path))
    assert r.state == "Done" and r.table.columns == ["id", "weight", "class"]
    assert r.table.filter(f"class <> {EXPR}").count() == 0
    assert states(r) == ["Expanding", "Backfilling", "Verifying", "Canary", "Cutover", "Contracting", "Done"]


def test_resumes_after_every_stop(spark, items, tmp_path):
    seen = []
    for _ in range(7):
        r = run_change(items, plan(), log(spark), str(tmp_path), max_steps=1)
        seen.append(r.state)
    assert seen[-1] == "Done" and states(r) == seen
    again = run_change(items, plan(), log(spark), str(tmp_path))
    assert again.state == "Done" and len(states(again)) == 7


def test_canary_breach_rolls_back(spark, items, tmp_path):
    r = run_change(items, plan(), log(spark, 101.0), str(tmp_path))
    assert r.state == "RolledBack" and r.table.columns == ["id", "weight", "legacy"]
    assert states(r)[-2:] == ["RollingBack", "RolledBack"]
    assert "p99 101ms > 50ms" in r.events.filter("to_state = 'RollingBack'").first().detail


def test_canary_breach_pauses(spark, items, tmp_path):
    with pytest.raises(ChangeError, match="breach at 1%"):
        run_change(items, plan(on_failure="pause"), log(spark, 101.0), str(tmp_path))
    r = run_change(items, plan(on_failure="pause"), log(spark), str(tmp_path))
    assert r.state == "Done", "goes on from the canary once it is healthy"


def test_rollback_resumes(spark, items, tmp_path):
    r = run_change(items, plan(), log(spark, 101.0), str(tmp_path), max_steps=5)
    assert r.state == "RollingBack"
    assert run_change(items, plan(), log(spark, 101.0), str(tmp_path)).state == "RolledBack"


def test_cutover_refuses_drift(spark, items, tmp_path):
    run_change(items, plan(), log(spark), str(tmp_path), max_steps=5)
    broken = spark.read.parquet(f"{tmp_path}/filled/range-000001").withColumn("class", F.lit(None).cast("string")).collect()
    spark.createDataFrame(broken, "id long, weight long, legacy string, class string").write.mode("overwrite").parquet(f"{tmp_path}/filled/range-000001")
    r = run_change(items, plan(), log(spark), str(tmp_path))
    assert r.state == "RolledBack" and "legacy" in r.table.columns
    assert "NULL" in r.events.filter("to_state = 'RollingBack'").first().detail


def test_cutover_waits_for_services(spark, items, tmp_path):
    reg = spark.createDataFrame([("p1", "a", True), ("p1", "b", False)], "migration_id string, service_name string, compatible boolean")
    assert run_change(items, plan(), log(spark), str(tmp_path / "a"), registry=reg).state == "RolledBack"
    assert run_change(items, plan(), log(spark), str(tmp_path / "b"), registry=reg.filter("compatible")).state == "Done"
    assert run_change(items, plan(), log(spark), str(tmp_path / "c"), registry=reg.filter("false")).state == "Done"


def test_verify_refuses_nulls(spark, items, tmp_path):
    holes = plan(add=(ColumnSpec("class", "string", "CASE WHEN weight < 10 THEN 'light' END"),))
    with pytest.raises(ChangeError, match="100 rows still NULL"):
        run_change(items, holes, log(spark), str(tmp_path))


def test_backfill_goes_on_from_its_last_range(spark, items, tmp_path):
    small = dict(range_rows=50)
    p = plan(batch_size=1)
    run_change(items, p, log(spark), str(tmp_path), max_steps=4, **small)
    first = {f: f.stat().st_mtime_ns for f in tmp_path.glob("filled/*/*.parquet")}
    r = run_change(items, p, log(spark), str(tmp_path), **small)
    assert r.state == "Done" and r.table.count() == 200 and r.table.filter(f"class <> {EXPR}").count() == 0
    assert len(list(tmp_path.glob("filled/*"))) == 4 and all(f.stat().st_mtime_ns == t for f, t in first.items())
    assert states(r).count("Backfilling") == 4
    notes = [e.detail for e in r.events.filter("to_state = 'Backfilling' and from_state = 'Backfilling'").orderBy("id").collect()]
    assert '"batch_num": 3' in notes[-1] and '"rows_done": 150' in notes[-1]
    canary = spark.read.parquet(str(tmp_path / "canary-log"))
    assert [x.step for x in canary.orderBy("step").collect()] == [1, 5, 25, 100]


def test_backfill_of_text_keys(spark, items, tmp_path):
    texts = items.withColumn("id", F.concat(F.lit("k"), "id")).union(items.selectExpr("cast(null as string)", "weight", "legacy").limit(1))
    r = run_change(texts, plan(batch_size=1), log(spark), str(tmp_path), range_rows=60)
    assert r.state == "Done" and r.table.count() == 201


def test_columns_that_were_there_survive_a_rollback(spark, items, tmp_path):
    r = run_change(items.withColumn("class", F.expr(EXPR)), plan(), log(spark, 101.0), str(tmp_path))
    assert r.state == "RolledBack" and r.table.filter(f"class = {EXPR}").count() == 200


def test_services_of_other_changes_do_not_block(spark, items, tmp_path):
    reg = spark.createDataFrame([("p1", "a", True), ("p2", "b", False)], "migration_id string, service_name string, compatible boolean")
    assert run_change(items, plan(), log(spark), str(tmp_path), registry=reg).state == "Done"


def test_lag_holds_the_canary(spark, items, tmp_path):
    lag = lambda ms: spark.createDataFrame([(ms,)], "max_lag_ms double")
    with pytest.raises(ChangeError, match="replication lag"):
        run_change(items, plan(), log(spark), str(tmp_path), lag=lag(51.0))
    assert run_change(items, plan(), log(spark), str(tmp_path), lag=lag(50.0)).state == "Done"


def test_an_unreadable_log_is_no_new_start(spark, items, tmp_path):
    run_change(items, plan(), log(spark), str(tmp_path), max_steps=2)
    for f in (tmp_path / "events").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|magic|footer"):
        run_change(items, plan(), log(spark), str(tmp_path))


def test_raw_statements():
    doc = {"id": "a", "version": 1, "table": "t", "expand": ["alter table public.t add column if not exists n numeric(10, 2) not null, add column b timestamptz;", "create index i on t (n)"],
           "contract": ['ALTER TABLE "t" DROP COLUMN IF EXISTS old CASCADE']}
    p = Plan.from_dict(doc)
    assert [(c.name, c.type, c.nullable) for c in p.add] == [("n", "decimal(10, 2)", False), ("b", "timestamp", True)] and p.drop == ("old",)
    for bad in ({"contract": ["DELETE FROM t"]}, {"expand": ["ALTER TABLE t RENAME TO u"]}, {"contract": ["ALTER TABLE other DROP COLUMN x"]},
                {"expand": ["ALTER TABLE t DROP COLUMN x"]}, {"rollback": ["ALTER TABLE t DROP COLUMN x"]}, {"expand": ["ALTER TABLE t ADD COLUMN x point"]}):
        with pytest.raises(PlanError):
            Plan.from_dict({**doc, **bad})
