"""Ordered computations give the same rows with and without split groups."""

import pytest
from pyspark.sql import functions as F

from changeguard.operators.ordered import choose_cut, rolling, scan
from changeguard.operators.rank import Nested, interpolated, nearest_rank, order_statistics
from tests.conftest import as_set

BIG = 1_000_000


def everything(df, by=("key",)):
    return scan(
        df, list(by), ["ts", "event_id"], number="n", lag={"before": F.col("value"), "rare_before": F.col("rare")},
        lead={"after": F.col("event_id")}, running={"total": (F.col("value") * 100).cast("long")},
        total={"all": F.col("event_id"), "rares": F.when(F.col("rare") > 40, 1)},
        fill={"last_rare": F.col("rare")}, fill_next={"next_rare": F.col("rare")},
    )


@pytest.mark.parametrize("limit", [20, 100])
def test_split_groups_equal_plain_windows(events, group_limit, limit):
    group_limit(BIG)
    plain = as_set(everything(events))
    group_limit(limit)
    assert as_set(everything(events)) == plain


def test_blocks_are_small_although_key_and_time_are_hot(events, group_limit):
    group_limit(100)
    cut = choose_cut(events, ["key"], ["ts", "event_id"])
    assert [r.key for r in cut.hot.collect()] == [-1], "only the hot key is cut"
    assert cut.splits[0].hot, "the hot moment is found"
    biggest = cut.tag(events).groupBy("key", "_blk").count().agg(F.max("count")).first()[0]
    assert biggest <= 200


def test_many_hot_keys_cut_all_groups(events, group_limit, monkeypatch):
    import changeguard.operators.ordered as ordered

    group_limit(BIG)
    plain = as_set(everything(events))
    group_limit(5)
    monkeypatch.setattr(ordered, "if_small", lambda df: None)
    assert choose_cut(events, ["key"], ["ts", "event_id"]).hot is None
    assert as_set(everything(events)) == plain


def test_whole_table_as_one_group_is_never_one_window_partition(events):
    out = scan(events, [], ["ts", "event_id"], number="n")
    assert out.agg(F.max("n"), F.countDistinct("n")).first()[:] == (1000, 1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1], "rows are spread over blocks"


def test_null_order_values_and_null_keys(spark, group_limit):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate([(None, 1), (None, None), (None, 2), ("a", 5), ("a", None)] * 20)], "k string, t int, i long")
    group_limit(BIG)
    plain = as_set(scan(df, ["k"], ["t", "i"], number="n", lag={"p": F.col("i")}))
    group_limit(7)
    assert as_set(scan(df, ["k"], ["t", "i"], number="n", lag={"p": F.col("i")})) == plain


def test_text_keys_are_numbered(events):
    named = events.withColumn("name", F.concat(F.lit("k"), F.col("event_id")))
    got = scan(named, [], ["name"], number="n").orderBy("n").select("name").limit(3).collect()
    assert [r.name for r in got] == sorted(f"k{i}" for i in range(1000))[:3]


def test_rolling_frame(events, group_limit):
    aggs = {"low": F.min("value"), "n": F.count("value")}
    group_limit(BIG)
    plain = as_set(rolling(events, ["key"], ["ts", "event_id"], 25, aggs))
    group_limit(60)
    assert as_set(rolling(events, ["key"], ["ts", "event_id"], 25, aggs)) == plain


@pytest.mark.parametrize("limit", [BIG, 50])
def test_order_statistics_match_sorting(events, group_limit, limit):
    group_limit(limit)
    got = {r.key: r for r in order_statistics(events, ["key"], "value", {"p50": nearest_rank(0.5), "p99": nearest_rank(0.99)}).collect()}
    by_key = {}
    for r in events.collect():
        by_key.setdefault(r.key, []).append(r.value)
    assert set(got) == set(by_key)
    for k, v in by_key.items():
        v.sort()
        assert (got[k].n, got[k].p50, got[k].p99) == (len(v), v[min(int(0.5 * len(v)), len(v) - 1)], v[min(int(0.99 * len(v)), len(v) - 1)])


def test_order_statistics_with_one_value_everywhere(spark):
    df = spark.range(500).select(F.lit(3.0).alias("v"))
    assert order_statistics(df, [], "v", {"p": nearest_rank(0.99)}).first()[:] == (500, 3.0)


def test_order_statistics_large_list_of_groups_is_joined(events, monkeypatch):
    import changeguard.operators.rank as rank

    want = as_set(order_statistics(events, ["key"], "value", {"p": nearest_rank(0.9)}))
    monkeypatch.setattr(rank, "if_small", lambda df: None)
    assert as_set(order_statistics(events, ["key"], "value", {"p": nearest_rank(0.9)})) == want


def test_nearest_rank_of_hundred(spark):
    r = order_statistics(spark.range(100), [], "id", {"p50": nearest_rank(0.5), "p99": nearest_rank(0.99)}).first()
    assert (r.p50, r.p99) == (50, 99)


def test_interpolated_of_hundred(spark):
    assert interpolated(spark.range(100), [], "id", 0.99, "p").first().p == pytest.approx(98.01)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert order_statistics(empty, ["k"], "v", {"p": nearest_rank(0.5)}).count() == 0
    assert scan(empty, [], ["v"], number="n").count() == 0


@pytest.mark.parametrize("limit", [BIG, 50])
def test_nested_groups(events, group_limit, limit):
    """Even ids count for groups 1 and 2, odd ids for group 2 only."""
    group_limit(limit)
    df = events.withColumn("first", F.when(F.col("event_id") % 2 == 0, 1).otherwise(2))
    widen = Nested("first", "g", lambda c: F.when(c == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    got = {r.g: (r.n, r.p) for r in order_statistics(df, [], "value", {"p": nearest_rank(0.9)}, nested=widen).collect()}
    for g, part in ((1, "event_id % 2 = 0"), (2, "true")):
        v = sorted(r.value for r in events.filter(part).collect())
        assert got[g] == (len(v), v[int(0.9 * len(v))])


@pytest.mark.parametrize("first", ["flag", "blob", "empty", "rare"])
def test_first_order_column_of_any_kind_is_cut(spark, events, group_limit, first):
    """A boolean, binary, all-NULL or mostly NULL column first: still blocks, and the same numbers."""
    df = events.select("event_id", (F.col("event_id") % 3 == 0).alias("flag"), F.unhex(F.hex(F.col("event_id") % 5)).alias("blob"),
                       F.lit(None).cast("double").alias("empty"), "rare")
    group_limit(100)
    got = scan(df, [], [first, "event_id"], number="n", running={"s": F.col("event_id")})
    cut = choose_cut(df, [], [first, "event_id"])
    assert cut is not None and cut.tag(df).groupBy("_blk").count().agg(F.max("count")).first()[0] <= 400
    want = sorted(((r[first] is not None, bytes(r[first]) if isinstance(r[first], bytearray) else r[first] or 0, r.event_id) for r in df.collect()), key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
    order = [r.event_id for r in got.orderBy("n").collect()]
    assert order == [w[2] for w in want]
