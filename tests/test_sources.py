"""Logs, metric text, audit lines and reports."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from changeguard.operators import metrics
from changeguard.session import scratch_dir
from changeguard.sources.logs import append_log, audit_summary, read_audit, read_log
from changeguard.sources.metrics_text import read_metric_samples
from changeguard.sources.tables import describe_schema, load_table

TEXT = """# HELP jobs
# TYPE jobs counter

up 1
jobs{plan_id="a,b",note="x}y"} 2.5
jobs{plan_id="c"} 1e3 1700000000
bad{x="1"} NaN
bad{x="1"} word
jobs{plan_id="c",plan_id="d"} 7
inf_metric +Inf
jobs{plan_id="c"} 4
"""


@pytest.fixture
def samples(spark, tmp_path):
    (tmp_path / "m.txt").write_text(TEXT)
    return read_metric_samples(spark, str(tmp_path / "m.txt"))


def test_metric_text(samples):
    got = [(r.name, r.labels, r.value) for r in samples.orderBy("seq").collect()]
    assert got == [
        ("up", {}, 1.0), ("jobs", {"plan_id": "a,b", "note": "x}y"}, 2.5), ("jobs", {"plan_id": "c"}, 1000.0),
        ("jobs", {"plan_id": "d"}, 7.0), ("jobs", {"plan_id": "c"}, 4.0),
    ]


def test_metric_lookups(samples):
    assert metrics.metric_latest(samples, "jobs", {"plan_id": "c"}).first().value == 4.0
    assert metrics.metric_sum(samples, "jobs", {"plan_id": "c"}).first().value == 1004.0
    assert metrics.metric_latest(samples, "nothing").first().value == 0.0


def test_audit_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        'INFO x json={"timestamp":"2024-01-01T00:00:00Z","user":"u","role":"admin","action":"abort","resource":"m","success":true}\n'
        "noise without an object\n"
        '{"timestamp":"2024-01-01T00:00:05Z","user":"u","role":"admin","action":"abort","resource":"m","success":true,"error":""}\n')
    r = audit_summary(read_audit(spark, str(tmp_path / "a.log"))).collect()
    assert len(r) == 1 and r[0].n == 2


@pytest.mark.parametrize("kind", ["state", "ddl", "backfill", "canary"])
def test_logs_append_and_fill_missing_columns(spark, kind):
    path = scratch_dir(spark, kind)
    rows = spark.range(3).withColumn("migration_id", F.lit("m"))
    append_log(rows, path, kind)
    append_log(rows, path, kind)
    assert read_log(spark, path, kind).count() == 6


def test_load_and_describe(spark, tmp_path):
    spark.range(3).selectExpr("id", "'x' AS c").write.parquet(str(tmp_path / "t"))
    df = load_table(spark, str(tmp_path / "t"))
    assert [r[:3] for r in describe_schema(df).collect()] == [(1, "id", "bigint"), (2, "c", "string")]


def test_pending_filter_reaches_the_file_scan(spark, tmp_path):
    from changeguard.operators.backfill import pending

    spark.range(100).selectExpr("id", "CASE WHEN id > 50 THEN 'x' END AS c", "'wide' AS other").write.parquet(str(tmp_path / "t"))
    plan = pending(spark.read.parquet(str(tmp_path / "t")), "c", "id", 5).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(c)" in plan and "GreaterThan(id,5)" in plan and "other" not in plan


class FakeSession:
    """Only what scratch_dir reads: the settings and the master."""

    def __init__(self, master, **settings):
        self.conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
        self.sparkContext = SimpleNamespace(master=master)


def test_scratch_follows_the_session():
    shared = FakeSession("spark://x", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert scratch_dir(shared, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(FakeSession("spark://x"), "x")
