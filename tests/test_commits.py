"""Numbered commits: one writer, whole or not at all, few files; and the job that is built on them."""

import pytest
from pyspark.sql import functions as F

from changeguard.plans import job
from changeguard.plans.job import ChangeJob, run_change
from changeguard.sources import commits
from changeguard.sources.commits import CommitLog, ConcurrentWriter, Folder
from changeguard.sources.logs import read_log
from tests.test_job import EXPR, items, log, plan, states  # noqa: F401

SCHEMA = "id long, detail string, created_at timestamp"


def test_two_writers_of_one_number(spark, tmp_path):
    a, b = (CommitLog(spark, str(tmp_path), SCHEMA) for _ in range(2))
    a.claim()
    a.commit([{"id": 1, "detail": "a"}])
    assert b.claim()["id"] == 1
    with pytest.raises(ConcurrentWriter):
        a.commit([{"id": 2, "detail": "a"}])
    b.commit([{"id": 2, "detail": "b"}, {"id": 3}])
    assert sorted((r.id, r.detail) for r in b.read().collect()) == [(1, "a"), (2, "b"), (3, None)]
    assert a.last() == (4, {"id": 3, "detail": None, "created_at": None})


def test_many_events_are_few_files(spark, tmp_path):
    events = CommitLog(spark, str(tmp_path), SCHEMA)
    for n in range(1, 1001):
        events.commit([{"id": n}])
    assert len(list(tmp_path.glob("*.parquet"))) <= commits.COMPACT_EVERY
    assert events.last()[1]["id"] == 1000 and CommitLog(spark, str(tmp_path), SCHEMA).last()[0] == 1000
    assert events.read().agg(F.count("id"), F.count_distinct("id"), F.max("id")).first()[:] == (1000, 1000, 1000)
    events.commit([{"id": 1001}])
    assert events.read().count() == 1001 == spark.read.schema(SCHEMA).parquet(str(tmp_path)).count()


def test_a_file_written_in_part_is_none(spark, tmp_path):
    events = CommitLog(spark, str(tmp_path), SCHEMA)
    events.commit([{"id": 1}])
    (tmp_path / ".0123.tmp").write_bytes(b"half")
    assert events.read().count() == 1 and events.last()[0] == 1
    assert not Folder(spark, str(tmp_path)).put(commits.commit_name(1), b"other") and events.read().count() == 1
    assert CommitLog(spark, str(tmp_path / "none"), SCHEMA).last() == (0, None) and CommitLog(spark, str(tmp_path / "none"), SCHEMA).read().count() == 0


def test_of_two_jobs_one_is_refused(spark, items, tmp_path):  # noqa: F811
    first = ChangeJob(items, plan(), log(spark), str(tmp_path))
    first.run(max_steps=2)
    second = ChangeJob(items, plan(), log(spark), str(tmp_path))
    second.run(max_steps=1)
    with pytest.raises(ConcurrentWriter):
        first._log(3, "Backfilling", "Verifying", {})
    r = run_change(items, plan(), log(spark), str(tmp_path))
    assert r.state == "Done" and len(states(r)) == 7


def test_stop_between_data_and_event(spark, items, tmp_path, monkeypatch):  # noqa: F811
    """Each step is stopped after its data is in place and before its event: the next run takes the data over."""
    def stop(self, *_):
        raise KeyboardInterrupt

    p, size = plan(batch_size=1), dict(range_rows=50)
    for _ in range(30):
        monkeypatch.setattr(ChangeJob, "_log", stop)
        try:
            r = run_change(items, p, log(spark), str(tmp_path), **size)
            break
        except KeyboardInterrupt:
            monkeypatch.undo()
            written = {f: f.stat().st_mtime_ns for f in [*tmp_path.glob("filled/*/*.parquet"), *tmp_path.glob("dealt/*/*.parquet"), *tmp_path.glob("final/*.parquet")]}
            run_change(items, p, log(spark), str(tmp_path), max_steps=1, **size)
            assert all(f.stat().st_mtime_ns == t for f, t in written.items())
    assert r.state == "Done" and r.table.count() == 200 and r.table.filter(f"class <> {EXPR}").count() == 0
    batches = read_log(spark, f"{tmp_path}/backfill-log", "backfill")
    assert batches.agg(F.count("*"), F.sum("rows_affected")).first()[:] == (4, 200)


@pytest.mark.parametrize("ranges", [2, 8])
def test_the_source_is_read_as_often_for_many_ranges(spark, tmp_path, ranges):
    """Rows that leave the source's scan, counted: the same for two ranges and for eight."""
    source = tmp_path / "source"
    spark.range(800).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "id % 20 AS weight", "'x' AS legacy").write.parquet(str(source))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    table = spark.read.parquet(str(source))
    run = ChangeJob(table.mapInArrow(counted, table.schema), plan(batch_size=1), None, str(tmp_path / "run"), range_rows=800 // ranges)
    run.run(max_steps=2)
    run.run()
    assert 800 <= read.value <= 3 * 800, "counted, cut and dealt"
    out = spark.read.parquet(run.final_path)
    assert out.count() == 800 and out.filter(f"class <> {EXPR}").count() == 0
    assert job.read_log(spark, run.backfill_path, "backfill").agg(F.sum("rows_affected")).first()[0] == 800
