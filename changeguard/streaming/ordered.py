"""Controllers over streams whose rows come in any order: keyed state that waits for the watermark.

Rows of a key are kept until the watermark has passed them and are then replayed in (time, id) order, so the result is
that of the batch form however rows are dealt to micro-batches. State lives in RocksDB, by buckets of keys: waiting rows
are packed there in pieces by time and read once, when they are due.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import astuple
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from changeguard.functions.controllers import Bucket, BucketState, PaceState, Pacing
from changeguard.operators.fold import replay_bucket, replay_pacing
from changeguard.operators.health import score_health
from changeguard.plans.plan import ThrottleConfig
from changeguard.streaming.monitors import timed
from changeguard.streaming.stateful import NULLS, bucket_of, packed, unpacked

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which the streams of this module need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: Rows of a bucket that are sorted and cut into pieces at once, and the rows of a piece.
FLUSH, PIECE = 100_000, 12_500


class DueRows(StatefulProcessor):
    """Rows of a bucket of keys wait until the watermark has passed them and go to ``advance`` in the order of ``order`` per key.

    They wait as packed pieces, each a range of time, so a row is no call and no state row of its own. When rows are due,
    the pieces are read in the order of their times and done in turns: of a hot key only pieces that overlap in time are
    in memory at once. One timer per bucket: at its first waiting row, or where a key wants to be asked again, whichever is sooner.
    """

    def __init__(self, by: str, order: list[str], pending: T.StructType):
        self.by, self.order, self.names = by, order, pending.fieldNames()

    def advance(self, key, now: tuple | None, columns: dict, a: int, b: int, passed: int) -> tuple[tuple | None, object, int | None]:
        """(state, what ``frame`` takes, milliseconds to be asked at) of a key after its rows ``a`` to ``b`` of the columns, up to ``passed`` microseconds; no state forgets the key."""
        raise NotImplementedError

    def frame(self, rows: pd.DataFrame, made: list) -> pd.DataFrame:
        """Result rows from the sorted rows of all keys and what ``advance`` made of each."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "part long", "body binary")
        self.index = handle.getValueState("index", "parts array<bigint>, firsts array<bigint>, due long")
        self.states = handle.getValueState("states", "body binary")

    def _save(self, index: dict, wake: int | None, due: int | None) -> None:
        """Keep the index of pieces {part: first time} and one timer, at ``wake``; ``due`` is the one that is set."""
        if wake != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if wake is not None:
                self.handle.registerTimer(wake)
        if wake is None:
            self.index.clear()
        else:
            self.index.update((list(index), list(index.values()), wake))

    def _put(self, index: dict, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("at_us", kind="stable", ignore_index=True)
        for a in range(0, len(rows), PIECE):
            piece, part = rows[a : a + PIECE], max(index, default=-1) + 1
            index[part] = int(piece["at_us"].iloc[0])
            self.pieces.updateValue((part,), (packed(piece),))

    def _load(self) -> tuple[dict, int | None]:
        if not self.index.exists():
            return {}, None
        parts, firsts, due = self.index.get()
        return dict(zip(parts, firsts, strict=True)), due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (index, due), buffer, held = self._load(), [], 0
        for part in rows:
            buffer.append(part[self.names].astype({"at_us": np.int64}))
            held += len(part)
            if held >= FLUSH:
                self._put(index, pd.concat(buffer, ignore_index=True))
                buffer, held = [], 0
        if held:
            self._put(index, pd.concat(buffer, ignore_index=True))
        at = max(-(-min(index.values()) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        self._save(index, at if due is None else min(at, due), due)
        return iter([])

    def _turn(self, states: dict, rows: pd.DataFrame | None, passed: int) -> tuple[pd.DataFrame | None, int | None]:
        runs, columns = [], {}
        if rows is not None and len(rows):
            code, keys = pd.factorize(rows[self.by], use_na_sentinel=False)
            rows = rows.assign(_k=code).sort_values(["_k", *self.order], kind="stable", ignore_index=True)
            ends = np.flatnonzero(np.diff(rows["_k"].to_numpy(), append=-1)) + 1
            columns = {c: rows[c].tolist() for c in self.names if c != self.by}
            runs = [(None if pd.isna(k) else k, int(a), int(b)) for k, a, b in zip(keys.tolist(), [0, *ends[:-1]], ends, strict=True)]
        seen = {k for k, _, _ in runs}
        made, wakes = [], []
        for key, a, b in [*runs, *((k, 0, 0) for k in list(states) if k not in seen)]:
            now, part, again = self.advance(key, states.get(key), columns, a, b, passed)
            if now is None:
                states.pop(key, None)
            else:
                states[key] = now
            if part is not None:
                made.append(part)
            if again is not None:
                wakes.append(again)
        return self.frame(rows, made) if made else None, min(wakes, default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index, _ = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        states = pickle.loads(bytes(self.states.get()[0])) if self.states.exists() else {}
        line = sorted((first, part) for part, first in index.items() if first <= passed * 1000)
        waiting, fresh, again = [], 0, None
        for n, (_, part) in enumerate(line, 1):
            waiting.append(unpacked(bytes(self.pieces.getValue((part,))[0])))
            self.pieces.removeKey((part,))
            del index[part]
            fresh += len(waiting[-1])
            if n < len(line) and fresh >= FLUSH:  # what is before the next piece is whole
                rows, upto = pd.concat(waiting, ignore_index=True), line[n][0] - 1
                ready = rows["at_us"].to_numpy() <= upto
                out, _ = self._turn(states, rows[ready], upto)
                waiting, fresh = [rows[~ready]], 0
                if out is not None and len(out):
                    yield self._named(key, out)
        rows = pd.concat(waiting, ignore_index=True) if waiting else None
        if rows is not None:
            ready = rows["at_us"].to_numpy() <= passed * 1000
            if not ready.all():
                self._put(index, rows[~ready])
            rows = rows[ready]
        out, again = self._turn(states, rows, passed * 1000)
        if states:
            self.states.update((pickle.dumps(states),))
        elif self.states.exists():
            self.states.clear()
        wakes = ([] if again is None else [again]) + [-(-first // 1000) for first in index.values()]
        self._save(index, max(min(wakes), passed + 1) if wakes else None, None)  # the timer that woke us is gone
        if out is not None and len(out):
            yield self._named(key, out)

    def _named(self, key, out: pd.DataFrame) -> pd.DataFrame:
        return out.assign(**{self.by: None}) if key[0] == NULLS else out

    def close(self) -> None:
        pass


class OrderedReplay(DueRows):
    """Replays a controller; a key is forgotten after ``idle`` microseconds without a row, or never."""

    def __init__(self, by, tie, pending, value: str, controller, replay: Callable, state: type, idle: int | None):
        super().__init__(by, list(dict.fromkeys(["at_us", tie])), pending)
        self.value, self.controller, self.replay, self.state, self.idle = value, controller, replay, state, idle

    def advance(self, key, now, columns, a, b, passed):
        now = self.controller.start() if now is None else self.state(*now)
        made = self.replay(self.controller, columns[self.value][a:b], now) if a < b else None
        if self.idle is None:
            return astuple(now), made, None
        if now.seen is None or now.seen + self.idle < passed:
            return None, made, None
        return astuple(now), made, (now.seen + self.idle) // 1000 + 1

    def frame(self, rows, made):
        return rows[self.names].assign(**{c: list(chain.from_iterable(m[c] for m in made)) for c in made[0]})


def growth(before: float, after: float) -> float:
    """What a counter grew by from one sample to the next; a drop is a reset and counts with its new value."""
    return after if after < before else after - before


class PaneIncrease(DueRows):
    """Increase of a counter in sliding windows, from panes of one slide.

    A pane is (start, first sample, last sample, growth within). Panes of a window are joined by the growth from the
    last sample of one to the first of the next, so a reset at a pane's edge counts once. Only the panes that an open window
    has are kept; a counter that is silent for a whole window is forgotten.
    """

    def __init__(self, by, tie, pending, value: str, window: int, slide: int):
        super().__init__(by, ["at_us", tie], pending)
        self.value, self.window, self.slide = value, window, slide

    def advance(self, key, now, columns, a, b, passed):
        starts, firsts, lasts, within, samples = ([list(x) for x in now[:5]] if now else [[] for _ in range(5)])
        end = now[5] if now else None  # the next window end to report
        for at, value in zip(columns["at_us"][a:b], columns[self.value][a:b], strict=True) if a < b else ():
            start = at // self.slide * self.slide
            if starts and starts[-1] == start:
                within[-1] += growth(lasts[-1], value)
                lasts[-1] = value
                samples[-1] += 1
                continue
            if end is None:
                end = start + self.slide
            for x, v in ((starts, start), (firsts, value), (lasts, value), (within, 0.0), (samples, 1)):
                x.append(v)
        out = []
        while starts and end <= passed:
            if end - self.window > starts[-1]:  # silent for a whole window
                break
            inside = [k for k, s in enumerate(starts) if end - self.window <= s < end]
            if not inside:  # the next pane begins later: go on where it ends
                end = next(s for s in starts if s >= end) + self.slide
                continue
            grown = sum(within[k] for k in inside) + sum(growth(lasts[a], firsts[b]) for a, b in zip(inside, inside[1:], strict=False))
            out.append((key, end - self.window, end, grown, sum(samples[k] for k in inside)))
            end += self.slide
            while starts and starts[0] < end - self.window:
                for x in (starts, firsts, lasts, within, samples):
                    del x[0]
        if not starts or end - self.window > starts[-1]:
            return None, out or None, None
        return (starts, firsts, lasts, within, samples, end), out or None, -(-end // 1000)

    def frame(self, rows, made):
        return pd.DataFrame(list(chain.from_iterable(made)), columns=[self.by, "start_us", "end_us", "increase", "samples"])


class LastMark(DueRows):
    """Gives each row the last mark of its key at or before its time; a mark older than ``within`` microseconds is forgotten."""

    def __init__(self, by: str, pending: T.StructType, within: int | None):
        super().__init__(by, ["at_us", "side", "tie"], pending)
        self.within = within

    def advance(self, key, now, columns, a, b, passed):
        marks = []
        for at, side, body in zip(*(columns[c][a:b] for c in ("at_us", "side", "body")), strict=True) if a < b else ():
            if side == 0:
                now = (body, at)
            else:
                marks.append(now[0] if now and (self.within is None or at - now[1] <= self.within) else None)
        if now is None or self.within is None:
            return now, marks, None
        end = now[1] + self.within
        return (None, marks, None) if end < passed else (now, marks, end // 1000 + 1)

    def frame(self, rows, made):
        if rows is None or not len(rows):
            return None
        return rows.loc[rows["side"] == 1, [self.by, "body"]].assign(mark=pd.Series(list(chain.from_iterable(made)), dtype=object).to_numpy())


def _pending(rows: DataFrame, *held: str) -> T.StructType:
    return T.StructType([f for c in dict.fromkeys(held) for f in rows.schema.fields if f.name == c])


def _by_bucket(rows: DataFrame, by: str):
    """``rows`` grouped by buckets of the key: small keys share state and Python calls. A NULL whole number is 0 on the way, as pandas makes those beside it fractions."""
    kind = rows.schema[by].dataType
    key = F.coalesce(F.col(by), F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.col(by)
    return rows.withColumns({"_bucket": bucket_of(by), by: key}).groupBy("_bucket")


def _replayed(rows: DataFrame, by: str, tie: str, value: str, controller, replay, state: type, columns: str, idle: int | None = None) -> DataFrame:
    """``rows`` (by, ts with watermark, at_us, tie, value) with the columns of ``replay``; ``value`` may be ``at_us``."""
    pending = _pending(rows, by, "at_us", tie, value)
    out = T.StructType(pending.fields + T._parse_datatype_string(columns).fields)
    return _by_bucket(rows, by).transformWithStateInPandas(OrderedReplay(by, tie, pending, value, controller, replay, state, idle), out, "append", "EventTime")


def throttle_stream_ordered(samples: DataFrame, cfg: ThrottleConfig | None = None, by: str = "target", ts: str = "ts", tie: str = "id", delay: str = "1 minute") -> DataFrame:
    """The pacing controller over health samples that may come up to ``delay`` late, in time order per target.

    The rows of ``operators.fold.throttle_trace`` whose time the watermark has passed. Samples later than that are dropped
    and counted in the query's progress. Start it inside ``rocksdb_state``.
    """
    scored = timed(score_health(samples), ts, delay).select(by, ts, F.unix_micros(ts).alias("at_us"), tie, "score")
    done = _replayed(scored, by, tie, "score", Pacing(cfg or ThrottleConfig()), replay_pacing, PaceState,
                     "batch_size int, throttle_ms int, tripped boolean, trip_count int")
    return done.withColumn(ts, F.timestamp_micros("at_us")).drop("at_us")


def rate_limit_stream_ordered(
    requests: DataFrame, by: str = "client_id", ts: str = "ts", tie: str = "request_id", tokens: int = 10,
    seconds: int = 1, burst: int = 20, idle_seconds: float | None = 60, delay: str = "1 minute",
) -> DataFrame:
    """The token bucket per client over requests that may come up to ``delay`` late, in time order.

    The rows of ``operators.fold.rate_limit`` whose time the watermark has passed. A client idle for
    ``idle_seconds`` of event time is forgotten, which its full bucket makes no difference to. Start it inside ``rocksdb_state``.
    """
    bucket = Bucket(tokens, seconds, burst, idle_seconds)
    rows = timed(requests, ts, delay).select(by, ts, tie, F.unix_micros(ts).alias("at_us"))
    done = _replayed(rows, by, tie, "at_us", bucket, replay_bucket, BucketState, "allowed boolean",
                     None if idle_seconds is None else int(idle_seconds * 1_000_000))
    return done.withColumn(ts, F.timestamp_micros("at_us")).drop("at_us")


def increase_stream(
    samples: DataFrame, by: str, ts: str = "ts", value: str = "value", tie: str = "id",
    window_seconds: int = 600, slide_seconds: int = 60, delay: str = "1 minute",
) -> DataFrame:
    """Increase of each counter per sliding window, resets taken into account: window_start, window_end, key, increase, rate, samples.

    The growth from the first to the last sample in the window, whatever order samples come in within ``delay``; a
    drop is a reset and counts with its new value. The rule of ``operators.metrics.increase``. A window without
    samples has no row. The window is a multiple of the slide. Start it inside ``rocksdb_state``.
    """
    if window_seconds % slide_seconds:
        raise ValueError("the window is no multiple of the slide")
    rows = timed(samples, ts, delay).select(F.col(by), ts, F.unix_micros(ts).alias("at_us"), tie, F.col(value).cast("double").alias("counter")).filter("counter is not null")
    pending = _pending(rows, by, "at_us", tie, "counter")
    out = T.StructType([rows.schema[by], *T._parse_datatype_string("start_us long, end_us long, increase double, samples long").fields])
    panes = _by_bucket(rows, by).transformWithStateInPandas(
        PaneIncrease(by, tie, pending, "counter", window_seconds * 1_000_000, slide_seconds * 1_000_000), out, "append", "EventTime")
    return panes.select(
        F.timestamp_micros("start_us").alias("window_start"), F.timestamp_micros("end_us").alias("window_end"), by, "increase",
        (F.col("increase") / F.lit(float(window_seconds))).alias("rate"), "samples")


#: Rows wait as text; times keep their microseconds.
_AS_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def attach_latest_stream(
    rows: DataFrame, marks: DataFrame, by: str, take: dict[str, str], ts: str = "created_at", marks_ts: str = "ts", tie: str = "id", marks_tie: str = "id",
    delay: str = "1 minute", marks_delay: str = "1 minute", within_seconds: float | None = None,
) -> DataFrame:
    """Stream ``rows`` with columns of the latest of ``marks`` of their key at or before their time, each stream in any order within its delay.

    The rows of ``operators.lifecycle.asof`` whose time both watermarks have passed. ``take`` maps new names to columns of
    ``marks``; among marks of one time the largest ``marks_tie`` counts, both ties are whole numbers. Where
    ``within_seconds`` is given, older marks do not count. State is the rows that wait and one mark per key, which
    with a bound is forgotten after it. Nothing is multiplied: a row is never paired with more than one mark.
    Rows without a time are left out; a NULL key matches nothing. Start it inside ``rocksdb_state``.
    """
    names, shapes = rows.columns, {c: rows.schema[c] for c in rows.columns}
    mark = F.struct(*[F.col(src).alias(new) for new, src in take.items()])
    left, right = timed(rows, ts, delay), timed(marks.filter(F.col(by).isNotNull()), marks_ts, marks_delay)
    row_type = T.StructType([shapes[c] for c in names])
    mark_type = right.select(mark.alias("m")).schema["m"].dataType

    def side(df: DataFrame, number: int, at: str, order: str, body) -> DataFrame:
        return df.filter(F.col(at).isNotNull()).select(
            F.col(by), F.col(at).alias("_ts"), F.unix_micros(at).alias("at_us"), F.lit(number).alias("side"), F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("tie"),
            F.to_json(body, {**_AS_TEXT, "ignoreNullFields": "false"}).alias("body"))

    line = side(right, 0, marks_ts, marks_tie, mark).unionByName(side(left, 1, ts, tie, F.struct(*names)))
    pending = _pending(line, by, "at_us", "side", "tie", "body")
    out = T.StructType([line.schema[by], *T._parse_datatype_string("body string, mark string").fields])
    done = _by_bucket(line, by).transformWithStateInPandas(
        LastMark(by, pending, None if within_seconds is None else int(within_seconds * 1_000_000)), out, "append", "EventTime")
    parsed = done.select(F.from_json("body", row_type, _AS_TEXT).alias("_row"), F.from_json("mark", mark_type, _AS_TEXT).alias("_last"))
    return parsed.select("_row.*", *[F.col(f"_last.{n}").alias(n) for n in take])
