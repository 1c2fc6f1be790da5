"""Streams: several micro-batches, late rows, restarts."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from changeguard.operators.fold import rate_limit, throttle_trace
from changeguard.plans.plan import Slo, ThrottleConfig
from changeguard.sources.logs import stream_log
from changeguard.streaming import monitors, ordered, stateful
from changeguard.streaming.backfill import backfill_stream, run_available
from tests.conftest import as_set
from tests.test_controllers import samples

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, tmp_path):
    """Write one file per batch and stream them in that order."""
    def make(batches, ddl):
        src = tmp_path / "src"
        for i, rows in enumerate(batches):
            frame = rows if hasattr(rows, "write") else spark.createDataFrame(rows, ddl)
            frame.coalesce(1).write.mode("append").parquet(str(src / f"b={i}"))
            time.sleep(0.05)  # files are read by modification time
        schema = spark.read.parquet(str(src / "b=0")).schema
        return stream_log(spark, f"{src}/*", schema, files_per_trigger=1)

    return make


@pytest.fixture
def finish(tmp_path):
    def run(stream):
        return run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    return run


def test_late_rows_are_dropped(spark, feed, finish):
    rows = [[(1, at(10), 5.0), (2, at(200), 6.0)], [(5, at(210), 6.0)], [(3, at(20), 7.0)], [(4, at(400), 1.0)]]
    s = feed(rows, "id long, ts timestamp, ms double")
    out = finish(monitors.slo_stream(s, "ts", "ms", F.lit(False), Slo(4), "1 minute", "30 seconds"))
    got = {r.window_start: (r.n, r.slo_breached) for r in out.collect()}
    assert got == {at(0): (1, True), at(180): (2, True)}


def test_late_rows_are_counted(spark, feed, tmp_path):
    rows = [[(1, at(10)), (2, at(200))], [(5, at(210))], [(3, at(20))], [(4, at(400))]]
    s = feed(rows, "id long, ts timestamp")
    query = (
        monitors.rate_stream(s, "ts", window="1 minute", slide="1 minute", delay="30 seconds").writeStream.format("noop")
        .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert monitors.dropped_rows(query) == 1


def test_throttle_stream_equals_batch(spark, feed, finish):
    cfg = ThrottleConfig(trip_below=0.3)
    all_rows = samples(spark, 300)
    s = feed([all_rows.filter(f"id >= {a} AND id < {a + 100}") for a in (0, 100, 200)], None)
    out = finish(stateful.throttle_stream(s, cfg)).select("target", "id", "batch_size", "throttle_ms", "tripped", "trip_count")
    want = throttle_trace(all_rows, cfg).select(*out.columns)
    assert as_set(out) == as_set(want)


def test_rate_limit_stream_equals_batch(spark, feed, finish):
    log = spark.range(600).select(F.col("id").alias("request_id"), (F.col("id") % 3).alias("client_id"), F.expr("timestamp_millis(1700000000000 + id * 20)").alias("ts"))
    s = feed([log.filter("request_id < 300"), log.filter("request_id >= 300")], None)
    out = finish(stateful.rate_limit_stream(s)).select("client_id", "request_id", "allowed")
    assert as_set(out) == as_set(rate_limit(log).select(*out.columns))


def test_liveness_stream_reports_each_silence_once(spark, feed, finish):
    s = feed([[("a", at(0)), ("b", at(0))], [("b", at(50))], [("b", at(100)), ("a", at(101))]], "svc string, ts timestamp")
    got = sorted(r[:] for r in finish(stateful.liveness_stream(s, "ts", "svc", 30)).collect())
    assert got == [("a", at(0), 1), ("b", at(0), 1), ("b", at(50), 1)]


def test_state_stream_flags_stuck(spark, feed, finish):
    ddl = "id long, migration_id string, to_state string, created_at timestamp"
    s = feed([[(1, "m", "Canary", at(0)), (2, "n", "Done", at(0))], [(3, "m", "Canary", at(300))], [(4, "x", "Pending", at(700))]], ddl)
    got = as_set(finish(stateful.state_stream(s, 600)).drop("newest_at"))
    assert ("m", "Canary", at(0), True) in got and not any(r[3] for r in got if r[0] != "m")


def test_changes_share_state_by_bucket(spark, feed, tmp_path):
    """More changes than buckets, the newest events first and a NULL key: no state row and no call for each change."""
    rows = spark.range(9000).select(
        F.col("id") * 10 + 1, F.when(F.col("id") > 0, F.col("id") + 2**60).alias("migration_id"), F.lit("Done").alias("to_state"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 50).alias("created_at")).toDF("id", "migration_id", "to_state", "created_at")
    before = rows.withColumns({"id": F.col("id") - 1, "to_state": F.lit("Canary"), "created_at": F.col("created_at") - F.expr("interval 9 seconds")})
    stuck = [(1, 7, "Canary", at(0)), (2, 8, "Pending", at(3000))]
    s = feed([rows.filter("id % 3 = 0").union(before.filter("id % 3 = 0")), rows.filter("id % 3 > 0"), before.filter("id % 3 > 0"),
              spark.createDataFrame(stuck, rows.schema)], None)
    query = stateful.state_stream(s, 600, "30 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "o"))
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= stateful.BUCKETS + 1
    got = spark.read.parquet(str(tmp_path / "o"))
    newest = got.filter("not stuck").groupBy("migration_id").agg(F.max_by(F.struct("state", "since"), "newest_at").alias("x")).select("migration_id", "x.*")
    want = as_set(rows.select("migration_id", "to_state", "created_at")) | {(7, "Canary", at(0)), (8, "Pending", at(3000))}
    assert as_set(newest) == want and [tuple(r)[:2] for r in got.filter("stuck").collect()] == [(7, "Canary")]


def test_dedup_stream(spark, feed, finish):
    s = feed([[("a", at(0))], [("a", at(10)), ("b", at(11))]], "k string, ts timestamp")
    assert sorted(r.k for r in finish(monitors.dedup_stream(s, "ts", ["k"], "1 minute")).collect()) == ["a", "b"]


def test_backfill_stream_resumes_and_repeats_safely(spark, tmp_path):
    src, dst, ck = (str(tmp_path / n) for n in ("src", "dst", "ck"))
    schema = "id long, c string"
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'kept' END AS c").coalesce(1)
    rows(0, 10).write.parquet(src)
    first = backfill_stream(spark, src, dst, ck, {"c": "concat('v', id)"}, schema).agg(F.sum("rows"), F.sum("filled")).first()
    assert first[:] == (10, 5)
    rows(10, 16).write.mode("append").parquet(src)
    log = backfill_stream(spark, src, dst, ck, {"c": "concat('v', id)"}, schema)
    assert sorted(r[:3] for r in log.collect()) == [(6, 3, 0), (10, 5, 0)]
    backfill_stream(spark, src, dst, ck, {"c": "concat('v', id)"}, schema)
    table = spark.read.parquet(f"{dst}/table")
    assert table.count() == 16 and table.filter("c IS NULL").count() == 0 and table.select("id").distinct().count() == 16


def grown_by_hand(samples, window, slide, passed):
    """(start, increase, samples) of each window of (seconds, value) that ends by ``passed``."""
    out = {}
    for t, _ in samples:
        for k in range(window // slide):
            start = (t // slide - k) * slide
            inside = [v for s, v in sorted(samples) if start <= s < start + window]
            if start + window <= passed:
                out[start] = (sum(b if b < a else b - a for a, b in zip(inside, inside[1:], strict=False)), len(inside))
    return out


def test_counter_windows_with_resets_at_edges_and_silence(spark, feed, finish):
    """Resets on both sides of pane edges, a silence longer than a window, any order of arrival."""
    rng = random.Random(8)
    samples = {"a": [(t, (t * 7) % 50) for t in range(0, 300, 5)] + [(t, t % 40) for t in range(3000, 3200, 9)],
               "b": [(59, 10), (60, 4), (119, 9), (120, 0), (121, 3), (10_000, 5)]}
    rows = [(k, n, at(t), float(v)) for k, xs in samples.items() for n, (t, v) in enumerate(xs)] + [("end", 0, at(30_000), 1.0)]
    rng.shuffle(rows)
    rows = sorted(rows, key=lambda r: (r[0] == "end", rng.random()))
    stream = feed([rows[:40], rows[40:70], rows[70:]], "k string, id long, ts timestamp, value double")
    with ordered.rocksdb_state(spark):
        got = finish(ordered.increase_stream(stream, "k", window_seconds=180, slide_seconds=60, delay="8 hours"))
    base = int(BASE.replace(tzinfo=dt.UTC).timestamp())
    seen = {(r.k, int(r.window_start.replace(tzinfo=dt.UTC).timestamp()) - base): (r.increase, r.samples) for r in got.collect()}
    assert seen == {(k, s): v for k, xs in samples.items() for s, v in grown_by_hand(xs, 180, 60, 30_000 - 8 * 3600).items()}


def test_controllers_in_time_order_whatever_comes_first(spark, feed, finish):
    """The later half first: the trace and the admissions of the batch forms, up to the watermark."""
    rows = [(k, n, at(n * 3 + k)) for k in range(3) for n in range(40)]
    late_first = sorted(rows, key=lambda r: (r[1] < 20, r[1] * 7 % 20))
    stream = feed([late_first[:50], late_first[50:90], [*late_first[90:], (9, 0, at(10_000))]], "client_id long, request_id long, ts timestamp")
    with ordered.rocksdb_state(spark):
        got = finish(ordered.rate_limit_stream_ordered(stream, tokens=1, seconds=10, burst=2, idle_seconds=600, delay="30 minutes"))
    want = rate_limit(spark.createDataFrame(rows, "client_id long, request_id long, ts timestamp"), tokens=1, seconds=10, burst=2)
    names = ("client_id", "request_id", "allowed")
    assert as_set(got.select(*names)) == as_set(want.select(*names)) and got.count() == 120


def test_ordered_state_goes_on_after_a_restart(spark, feed, tmp_path):
    """Waiting rows and the controller's state survive a stop between two files."""
    cfg = ThrottleConfig()
    health = samples(spark, 60).filter("id > 0")  # a time of zero is behind any watermark
    first, second = health.filter("id % 2 = 0"), health.filter("id % 2 = 1")
    stream = feed([first], None)
    schema, src = health.schema, tmp_path / "src"
    out, point = str(tmp_path / "o"), str(tmp_path / "p")
    with ordered.rocksdb_state(spark):
        run_available(ordered.throttle_stream_ordered(stream, cfg, delay="1 day"), out, point)
        second.coalesce(1).write.mode("append").parquet(str(src / "b=1"))
        end = health.filter("id = 1").withColumns({"id": F.lit(-1).cast(schema["id"].dataType), "target": F.lit(99).cast(schema["target"].dataType), "ts": F.col("ts") + F.expr("interval 40 days")})
        end.coalesce(1).write.mode("append").parquet(str(src / "b=2"))
        got = run_available(ordered.throttle_stream_ordered(stream, cfg, delay="1 day"), out, point)
    names = ("target", "id", "batch_size", "throttle_ms", "tripped", "trip_count")
    assert as_set(got.select(*names)) == as_set(throttle_trace(health, cfg).select(*names))


@pytest.mark.parametrize("kind", ["increase", "rate"])
def test_ordered_keys_share_state_by_bucket(spark, feed, tmp_path, kind):
    """More keys than buckets, one of them NULL, rows in any order: neither a key nor a waiting row is a state row of its own."""
    rows = spark.range(24_000).select(
        F.when(F.col("id") % 6000 > 0, F.col("id") % 6000 + 2**60).alias("k"), "id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7 % 1000).alias("ts"), (F.col("id") * 31 % 97).alias("value"))
    end = spark.createDataFrame([(5, -1, at(90_000), 1)], "k long, id long, ts timestamp, value long")
    stream = feed([rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), end], None)
    if kind == "increase":
        made = ordered.increase_stream(stream, "k", window_seconds=1200, slide_seconds=600, delay="1 hour")
        steps = rows.withColumn("w", F.explode(F.expr("transform(array(0, 1), n -> (unix_seconds(ts) div 600 - n) * 600)")))
        last = F.lag("value").over(Window.partitionBy("k", "w").orderBy("ts", "id"))
        grown = steps.withColumn("g", F.coalesce(F.when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last), F.lit(0)).cast("double"))
        want = as_set(grown.groupBy("k", F.timestamp_seconds("w").alias("window_start")).agg(F.sum("g").alias("increase"), F.count("*").alias("samples")))
        names = ("k", "window_start", "increase", "samples")
    else:
        made = ordered.rate_limit_stream_ordered(stream, by="k", tie="id", tokens=1, seconds=300, burst=2, idle_seconds=None, delay="1 hour")
        names = ("k", "id", "allowed")
        text = rows.select(F.col("k").cast("string"), "id", "ts")
        want = as_set(rate_limit(text, by="k", tie="id", tokens=1, seconds=300, burst=2).select(F.col("k").cast("long"), *names[1:]))
    with ordered.rocksdb_state(spark):
        query = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "o"))
        query.awaitTermination()
    assert as_set(spark.read.parquet(str(tmp_path / "o")).select(*names)) == want
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 6 * (stateful.BUCKETS + 1)
