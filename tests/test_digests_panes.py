"""Digest trees and sketched windows."""

import random

import pytest
from pyspark.sql import functions as F

from changeguard.operators import digests, panes
from changeguard.operators.reconcile import reconcile
from tests.conftest import as_set, rows


@pytest.mark.parametrize(("key", "most"), [("id", 100), ("id", 1), ("name", 100)])
def test_same_rows_as_a_whole_comparison(spark, key, most, monkeypatch):
    monkeypatch.setattr(digests, "MOST_RUNS", most)
    rng = random.Random(2)
    left = [(i, f"k{i}", rng.randrange(50), None if i % 7 == 0 else i / 3) for i in range(500)] + [(None, None, 1, 1.0), (3, "k3", 5, 5.0)]
    right = [r for r in left if r[0] is None or r[0] % 90 != 4] + [(900, "k900", 1, 1.0)]
    right = [(a, b, c + (a == 250), None if a == 251 else d) for a, b, c, d in right]
    src, dst = (spark.createDataFrame(x, "id long, name string, n int, d double") for x in (left, right))
    want = reconcile(src, dst, [key], ["n", "d"]).filter("status <> 'same'")
    got = digests.reconcile_ranges(src, dst, key, ["n", "d"], leaves=64)
    # A repeated key that both sides hold alike is in no differing range of its own.
    assert as_set(got) <= as_set(want) and as_set(want.filter("status <> 'duplicate'")) <= as_set(got)
    assert digests.reconcile_ranges(src, src, key, ["n", "d"], leaves=64).count() == 0
    assert digests.reconcile_ranges(src.limit(0), dst, key, ["n", "d"]).count() == want.limit(0).count() + dst.select(key).distinct().count()


def test_only_damaged_ranges_are_read_again(spark, tmp_path):
    """Rows that the second pass reads: in proportion to the damage, not to the table."""
    table = spark.range(20_000).selectExpr("id", "id % 13 AS n")
    for name, frame in (("a", table), ("b", table.withColumn("n", F.expr("CASE WHEN id IN (777, 778) THEN -1 ELSE n END")))):
        frame.write.parquet(str(tmp_path / name))
    src, dst = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    bounds = digests.key_ranges(src, "id", 100)
    found = sorted(r.leaf for r in digests.differing_leaves(*(digests.leaf_digests(x, "id", ["n"], bounds, 100) for x in (src, dst))).collect())
    again = digests._condition("id", bounds, found, 100)
    hits = sum(x.filter(again).mapInArrow(counted, x.schema).count() for x in (src, dst))
    assert len(found) <= 2 and hits == read.value <= 2 * 20_000 * 3 / 100
    assert "PushedFilters: [Or" in src.filter(again)._jdf.queryExecution().toString() or "GreaterThan(id" in src.filter(again)._jdf.queryExecution().toString()
    assert rows(digests.reconcile_ranges(src, dst, "id", ["n"], 100)) == [(777, "changed", 1, 0), (778, "changed", 1, 0)]


def test_digests_roll_up(spark):
    table = spark.range(1000).selectExpr("id", "id % 13 AS n")
    bounds = digests.key_ranges(table, "id", 256)
    leaves = digests.leaf_digests(table, "id", ["n"], bounds, 256)
    top = digests.rolled_up(leaves, 2)
    assert top.count() == 1 and top.first().rows == 1000
    assert as_set(digests.rolled_up(digests.rolled_up(leaves))) == as_set(top)
    other = digests.rolled_up(digests.leaf_digests(table.withColumn("n", F.expr("n + int(id = 500)")), "id", ["n"], bounds, 256))
    assert digests.differing_leaves(digests.rolled_up(leaves), other).count() == 1


@pytest.mark.parametrize("width", [1, 2, 5, 8])
def test_windows_of_panes(spark, width):
    """Few rows, so sketches are exact; gaps, NULL groups and NULL latencies."""
    rng = random.Random(width)
    data = [(rng.choice(["a", None]), t, rng.randrange(1000)) for t in sorted(rng.sample(range(0, 4000), 300))] + [("a", 9000, 5), ("a", 9001, None), ("b", None, 5)]
    log = spark.createDataFrame(data, "route string, t long, ms int").withColumn("ts", F.timestamp_seconds("t"))
    got = panes.trailing_percentiles(panes.percentile_panes(log, "ts", "ms", 60, ["route"]), width, 0.5, ["route"], 60, "p50")
    want = set()
    for route, pane in {(r, t // 60) for r, t, ms in data if t is not None and ms is not None}:
        held = sorted(ms for r, t, ms in data if r == route and t is not None and ms is not None and pane - width < t // 60 <= pane)
        want.add((route, (pane + 1) * 60, len(held), tuple(held)))
    seen = {(r.route, int(r.end), r.n): r.p50 for r in got.withColumn("end", F.unix_seconds("window_end")).collect()}
    assert len(seen) == len(want) == got.count()
    for route, end, n, held in want:
        at = seen[route, end, n]
        assert sum(x < at for x in held) <= n / 2 + 1 and sum(x <= at for x in held) >= n / 2 - 1


def test_stored_panes_are_appended(spark):
    log = spark.range(5000).selectExpr("timestamp_seconds(id) AS ts", "cast(id % 997 AS double) AS ms")
    first, second = (panes.percentile_panes(log.filter(x), "ts", "ms") for x in ("id < 2500", "id >= 2500"))
    both = panes.trailing_percentiles(first.unionByName(second), 10)
    whole = panes.trailing_percentiles(panes.percentile_panes(log, "ts", "ms"), 10)
    assert as_set(both.select("window_end", "n")) == as_set(whole.select("window_end", "n"))
