"""Pacing and token bucket: literal cases, and runs chained from summaries."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeguard.functions.controllers import Bucket, Pacing
from changeguard.operators.fold import breaker_episodes, rate_limit, throttle_trace
from changeguard.plans.plan import ThrottleConfig
from tests.conftest import as_set

CFG = ThrottleConfig(trip_below=0.3)


def play(controller, values):
    s = controller.start()
    for v in values:
        controller.step(s, v)
    return s


def test_breaker_trips_after_three_and_recovers_after_three():
    p, s = Pacing(CFG), Pacing(CFG).start()
    for score in (0.05, 0.05):
        p.step(s, score)
    assert (s.open, s.batch, s.pause) == (False, 1250, 120)
    p.step(s, 0.05)
    assert (s.open, s.trips, s.batch) == (True, 1, 1250)
    for score in (0.9, 0.9):
        p.step(s, score)
    assert s.open
    p.step(s, 0.9)
    assert (s.open, s.batch, s.pause) == (False, 5000, 20)


def test_default_threshold_is_hardly_reached():
    assert play(Pacing(ThrottleConfig()), [0.1] * 10).trips == 0


@pytest.mark.parametrize("score, batch, pause", [(0.81, 7500, 15), (0.8, 5000, 20), (0.5, 5000, 20), (0.49, 4000, 40), (0.3, 4000, 40), (0.29, 2500, 70)])
def test_zones(score, batch, pause):
    s = play(Pacing(ThrottleConfig(trip_below=0.1)), [score])
    assert (s.batch, s.pause) == (batch, pause)


def test_clamps():
    s = play(Pacing(CFG), [0.9] * 30)
    assert (s.batch, s.pause) == (50_000, 0)
    s = play(Pacing(ThrottleConfig(trip_below=0.0)), [0.2] * 200)
    assert (s.batch, s.pause) == (100, 5000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.05, 0.25, 0.31, 0.4, 0.6, 0.85, 0.95]), min_size=1, max_size=60), st.integers(1, 7))
def test_pacing_chained_from_summaries(scores, parts):
    p = Pacing(CFG)
    s = p.start()
    for i in range(0, len(scores), parts):
        s = p.jump(s, p.summarise(scores[i:i + parts]))
    assert s == play(p, scores)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3_000_000), min_size=1, max_size=80), st.integers(1, 9), st.sampled_from([None, 2.0]))
def test_bucket_chained_from_summaries(gaps, parts, idle):
    b = Bucket(tokens=2, seconds=3, burst=4, idle_seconds=idle)
    times, t = [], 0
    for g in gaps:
        t += g
        times.append(t)
    s = b.start()
    for i in range(0, len(times), parts):
        effect = b.summarise(times[i:i + parts])
        assert len(effect[2]) <= 2 * (4 + 2), "few pieces"
        s = b.jump(s, effect)
    assert s == play(b, times)


def test_bucket_pieces_stay_few_in_long_runs():
    rng = random.Random(1)
    b, times, t = Bucket(10, 1, 20), [], 0
    for _ in range(3000):
        t += rng.randrange(0, 150_000)
        times.append(t)
    assert len(b.summarise(times)[2]) <= 2 * 22


def test_twenty_one_requests_at_once():
    b = Bucket()
    s = b.start()
    assert [b.step(s, 0) for _ in range(21)] == [True] * 20 + [False]
    assert b.step(s, 100_000) and not b.step(s, 100_000)


def samples(spark, n=900):
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 1 ELSE id % 5 + 2 END AS target", "id", "timestamp_seconds(id) AS ts", "100 AS max_conns",
        "CASE WHEN (id div 30) % 4 = 0 THEN 100 ELSE id % 60 END AS active_conns",
        "CASE WHEN (id div 30) % 4 = 0 THEN 5000.0D ELSE cast(id % 300 AS double) END AS max_lag_ms",
        "CASE WHEN (id div 30) % 4 = 0 THEN 20 ELSE id % 4 END AS waiting_queries", "(id * 137) % 300000 AS dead_tuples")


def test_hot_target_is_folded_in_blocks(spark, group_limit):
    group_limit(1_000_000)
    plain = as_set(throttle_trace(samples(spark), CFG))
    group_limit(200)
    split = throttle_trace(samples(spark), CFG)
    assert as_set(split) == plain
    assert max(r[-1] for r in plain) > 2
    assert breaker_episodes(split).filter("open_s > 0").count() > 2


def test_hot_client_is_limited_in_blocks(spark, group_limit):
    log = spark.range(1500).select(
        F.col("id").alias("request_id"), F.expr("timestamp_millis(id * 37 + (id * 7919) % 30)").alias("ts"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 20).alias("client_id"))
    group_limit(1_000_000)
    plain = as_set(rate_limit(log))
    group_limit(200)
    assert as_set(rate_limit(log)) == plain
    assert 0 < sum(1 for r in plain if not r[-1]) < 1500


def test_null_key_and_order_of_equal_times(spark):
    log = spark.createDataFrame([(i, None, 0) for i in range(3)], "request_id long, client_id string, t long").select(
        "request_id", "client_id", F.timestamp_seconds("t").alias("ts"))
    got = rate_limit(log, burst=2).orderBy("request_id").collect()
    assert [r.allowed for r in got] == [True, True, False]


def test_effect_of_a_quiet_run_is_small():
    import pickle

    from changeguard.functions.controllers import Pacing
    from changeguard.plans.plan import ThrottleConfig

    pacing = Pacing(ThrottleConfig(trip_below=0.3))
    for scores in ([0.6] * 1000, [0.9] * 3, [0.4, 0.6] * 5):
        effect = pacing.summarise(scores)
        packed = pickle.dumps(effect)
        assert len(packed) < 10_000 or scores[0] != 0.6
        state, other = pacing.start(), pacing.start()
        assert pacing.jump(state, effect) == pacing.jump(other, pickle.loads(packed))
