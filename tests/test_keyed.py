"""Stored tables of unique keys: only touched buckets are rewritten, a change is there whole or not at all."""

import pytest
from pyspark.sql import functions as F

from changeguard.sources.commits import ConcurrentWriter
from changeguard.sources.keyed import KeyedTable, RepeatedKeys
from tests.conftest import as_set

SCHEMA = "a long, b string, seen string, v int"


def files(table):
    return {(f.split("/data/")[1]) for f in table.read().inputFiles()}


@pytest.fixture
def stored(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["a", "b"], SCHEMA)
    table.create(spark.range(200).selectExpr("CASE WHEN id = 0 THEN NULL ELSE id div 2 END AS a", "CASE WHEN id % 2 = 0 THEN NULL ELSE 'x' END AS b", "'old' AS seen", "cast(id AS int) AS v"), 16)
    return table


def test_upsert_rewrites_touched_buckets(spark, stored):
    before, was = files(stored), as_set(stored.read())
    rows = [(None, None, "new", -1, 1), (3, "x", "new", -2, 1), (3, "x", "new", -3, 2), (3, "x", "new", -9, 0), (500, None, None, -4, 1), (500, None, "new", -5, 0)]
    n = stored.upsert(spark.createDataFrame(rows, f"{SCHEMA}, at int"), keep=["seen"], order=["at"])
    want = {r for r in was if r[:2] not in {(None, None), (3, "x")}} | {(None, None, "old", -1), (3, "x", "old", -3), (500, None, None, -4)}
    assert as_set(stored.read()) == want and stored.read().count() == len(want)
    assert 1 <= n <= 3 and len(before - files(stored)) <= n and len(before & files(stored)) >= len(before) - n
    assert stored.lookup(None, None).first()[:] == (None, None, "old", -1) and stored.lookup(3, "x").first().v == -3 and stored.lookup(77_777, "x").isEmpty()
    assert len(stored.lookup(3, "x").inputFiles()) == 1
    assert stored.upsert(spark.createDataFrame([], f"{SCHEMA}, at int"), order=["at"]) == 0


def test_delete_and_purge(spark, stored):
    before = files(stored)
    assert stored.delete(spark.createDataFrame([(None, None), (4, "x"), (4, "x"), (9999, "y")], "a long, b string")) <= 2
    assert stored.read().count() == 198 and len(before & files(stored)) >= len(before) - 2
    before = files(stored)
    assert stored.purge("v = 20 OR v > cast(NULL AS int)") == 1 and stored.read().count() == 197 and len(before - files(stored)) == 1
    assert stored.purge("v < -1") == 0
    stored.purge(F.lit(True))
    assert stored.read().count() == 0
    assert stored.upsert(spark.createDataFrame([(1, "x", "s", 1)], SCHEMA)) == 1 and stored.read().count() == 1


def test_writers_and_stops(spark, stored, tmp_path, monkeypatch):
    was = as_set(stored.read())
    rows = spark.createDataFrame([(3, "x", "new", -2)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(stored.log, "commit", lambda rows: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            stored.upsert(rows)
    assert as_set(stored.read()) == was
    second = KeyedTable(spark, str(tmp_path), ["a", "b"], SCHEMA)
    second.upsert(rows)
    with pytest.raises(ConcurrentWriter):
        stored.upsert(rows)
    assert second.lookup(3, "x").first().v == -2 and as_set(stored.read()) == as_set(second.read())
    with pytest.raises(ValueError):
        second.create(rows)
    with pytest.raises(RepeatedKeys):
        KeyedTable(spark, str(tmp_path / "other"), ["a"], SCHEMA).create(rows.union(rows))
    assert KeyedTable(spark, str(tmp_path / "none"), ["a"], SCHEMA).read().count() == 0
