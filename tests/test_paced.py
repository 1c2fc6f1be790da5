"""The backfill that health samples pace, and health samples attached to a stream."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.operators.lifecycle import asof
from changeguard.plans.plan import ThrottleConfig
from changeguard.streaming import ordered, paced
from changeguard.streaming.backfill import run_available
from changeguard.streaming.ordered import attach_latest_stream, rocksdb_state
from changeguard.streaming.paced import key_cuts, paced_backfill
from tests.conftest import as_set
from tests.test_controllers import samples
from tests.test_streams import BASE, feed  # noqa: F401

CFG = ThrottleConfig(trip_below=0.3)


def test_cuts_hold_whole_keys(spark, group_limit):
    group_limit(500)
    table = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id END AS k")
    got = key_cuts(table, "k", 100).collect()
    keys = sorted(r.k for r in table.filter("k is not null").collect())
    want = {}
    for n, k in enumerate(keys):
        if n == 0 or keys[n - 1] != k:
            grain = n // 100
        want.setdefault(grain, []).append(k)
    assert {r.grain: (r.last_key, r.row_count) for r in got} == {g: (max(ks), len(ks)) for g, ks in want.items()}


@pytest.fixture
def health(spark, tmp_path):
    """A folder of samples of one target and a stream of it; every call adds a file."""
    schema = None

    def add(rows):
        nonlocal schema
        frame = rows.coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "health"))
        schema = frame.schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "health"))

    return add


def table(spark):
    return spark.range(20_000).selectExpr("CASE WHEN id < 50 THEN NULL WHEN id % 4 = 0 THEN 900 ELSE id END AS id", "id AS row", "CASE WHEN id % 2 = 0 THEN 'kept' END AS c")


def run(spark, stream, tmp_path):
    return paced_backfill(table(spark), "id", {"c": "concat('v', row)"}, stream, 1, str(tmp_path / "dst"), str(tmp_path / "ck"), CFG, grain=100, grant="CASE WHEN tripped THEN 0 ELSE batch_size div 100 END")


def test_a_restart_goes_on_from_the_key(spark, health, tmp_path):
    line = samples(spark, 100).withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).filter("target = 1")
    cut = line.agg(F.expr("percentile_approx(id, 0.5)")).first()[0]
    first = run(spark, health(line.filter(F.col("id") <= cut)), tmp_path).collect()
    done = spark.read.parquet(str(tmp_path / "dst/table"))
    rows = done.count()
    assert 0 < rows < 20_000 and sum(r.rows for r in first) == rows
    log = run(spark, health(line.filter(F.col("id") > cut)), tmp_path).orderBy("batch_id").collect()
    assert [tuple(r) for r in log[: len(first)]] == sorted((tuple(r) for r in first), key=lambda r: r[-1])
    assert all(a.upto_key == b.from_key and a.granted <= b.granted for a, b in zip(log, log[1:], strict=False))
    done = spark.read.parquet(str(tmp_path / "dst/table"))
    assert done.count() > rows and done.select("row").distinct().count() == done.count() and done.filter("c IS NULL").count() == 0
    assert done.filter("id IS NULL").count() == 50  # with the first range
    ids = [r.id for r in done.filter("id is not null").select("id").collect()]
    every = [r.id for r in table(spark).filter("id is not null").collect()]
    assert sorted(ids) == sorted(k for k in every if k <= max(ids))  # up to one key, all rows of each
    assert done.filter("row % 2 = 0 and c <> 'kept'").count() == 0
    again = run(spark, health(line.limit(0)), tmp_path)
    assert again.agg(F.sum("rows")).first()[0] == done.count()


def test_nothing_granted_fills_nothing(spark, health, tmp_path):
    line = samples(spark, 5).withColumn("target", F.lit(2))
    log = run(spark, health(line), tmp_path)  # samples of another target
    assert log.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] == 0


def test_the_state_of_a_batch_is_gone_through_once(spark, health, tmp_path, monkeypatch):
    seen, trace = spark.sparkContext.accumulator(0), paced.throttle_stream_ordered

    def counted(*args):
        out = trace(*args)

        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return out.mapInPandas(count, out.schema)

    monkeypatch.setattr(paced, "throttle_stream_ordered", counted)
    run(spark, health(samples(spark, 60).withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).filter("target = 1")), tmp_path)
    assert 0 < seen.value == spark.read.parquet(str(tmp_path / "dst/samples")).count()


class Held:
    """State of one key in memory, as a processor sees it."""

    def __init__(self):
        self.kept = {}

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Value()

    def updateValue(self, key, value):
        self.kept[key] = value

    def getValue(self, key):
        return self.kept[key]

    def removeKey(self, key):
        del self.kept[key]

    def registerTimer(self, at):
        self.timer = at

    def deleteTimer(self, at):
        assert at == self.timer


class Value:
    now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value

    def clear(self):
        self.now = None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_hot_key_is_attached_in_turns(monkeypatch):
    """20,000 rows of one key fall due at once: a turn takes a few pieces of them, and the marks are the last ones."""
    monkeypatch.setattr(ordered, "FLUSH", 1000)
    monkeypatch.setattr(ordered, "PIECE", 100)
    rng, turns = random.Random(4), []
    rows = [(1, rng.randrange(10**9), n % 2, n, f"b{n}") for n in range(20_000)]
    names = ["k", "at_us", "side", "tie", "body"]
    held = Held()
    step = ordered.LastMark("k", T.StructType().add("k", "long").add("at_us", "long").add("side", "integer").add("tie", "long").add("body", "string"), None)
    step.init(held)
    turn = step._turn
    monkeypatch.setattr(step, "_turn", lambda states, some, passed: (turns.append(0 if some is None else len(some)), turn(states, some, passed))[1])
    for a in range(0, len(rows), 500):
        step.handleInputRows((0,), iter([pd.DataFrame(rows[a : a + 500], columns=names)]), Clock(0))
    got = []
    for ms in (600_000, 2_000_000):
        got += [r for out in step.handleExpiredTimer((0,), Clock(ms), None) for r in out.itertuples(index=False, name=None)]
    want, mark = [], None
    for k, _, side, _, body in sorted(rows, key=lambda r: r[1:4]):
        if side == 0:
            mark = body
        else:
            want.append((k, body, mark))
    assert got == want and not held.kept
    assert sum(turns) == 20_000 and max(turns) <= 6000


def test_attached_marks_equal_the_batch_form(spark, tmp_path):
    at = lambda s: BASE + dt.timedelta(seconds=s, microseconds=7)
    marks = [(k, n, at(n * 13 % 400), n % 5 or None) for n in range(60) for k in (1, 2)] + [(None, 900, at(5), 1), (1, 901, at(26), 8)]
    rows = [(k, n, at(n * 7 % 400), f"r{n}" if n % 3 else None) for n in range(80) for k in (1, 2, 3, None)]
    m = spark.createDataFrame(marks, "k long, id long, ts timestamp, v int")
    r = spark.createDataFrame(rows, "k long, id long, ts timestamp, t string")
    end = [(9, 999, at(5000), None)]
    streams = []
    for name, frame in (("m", m), ("r", r)):
        parts = [frame.filter(F.pmod(F.xxhash64("id", "k"), F.lit(3)) == n) for n in range(3)]
        for part in [*parts, spark.createDataFrame(end, frame.schema)]:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.05)  # files are read by modification time
        streams.append(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    take = {"mark": "id", "v": "v"}
    with rocksdb_state(spark):
        out = run_available(attach_latest_stream(streams[1], streams[0], "k", take, "ts", delay="500 seconds", marks_delay="500 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
        near = run_available(attach_latest_stream(streams[1], streams[0], "k", take, "ts", delay="500 seconds", marks_delay="500 seconds", within_seconds=4), str(tmp_path / "near"), str(tmp_path / "ck2"))
    want = as_set(asof(r, m.withColumnRenamed("id", "mark"), "k", "ts", "ts", {"mark": "mark", "v": "v", "at": "ts"}, "id", "mark").select("k", "id", "ts", "t", "mark", "v", "at"))
    assert as_set(out) == {w[:6] for w in want} and out.count() == len(rows)
    assert as_set(near) == {(*w[:4], *((None, None) if w[6] is None or (w[2] - w[6]).total_seconds() > 4 else w[4:6])) for w in want}
