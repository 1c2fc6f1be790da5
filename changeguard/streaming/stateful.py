"""Keyed state over streams: liveness, pacing, token buckets, current state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from changeguard.functions.columns import micros
from changeguard.functions.controllers import Bucket, BucketState, PaceState, Pacing
from changeguard.operators.fold import replay_bucket, replay_pacing
from changeguard.operators.health import score_health
from changeguard.plans.plan import TERMINAL, ThrottleConfig
from changeguard.streaming.monitors import timed

EVENT_TIME = GroupStateTimeout.EventTimeTimeout
#: Buckets that keys share state in. It names the state, so a checkpoint keeps to it.
BUCKETS = 1024
#: The bucket of the NULL key.
NULLS = -1
NEVER = np.iinfo(np.int64).max


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key in this micro-batch, in order."""
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return rows if len(rows) == 1 else rows.sort_values(order, kind="stable")


def _times(batches: Iterator[pd.DataFrame]) -> list[int]:
    """The sorted times of one key in this micro-batch; only they are held."""
    times = np.concatenate([b["_us"].to_numpy(dtype=np.int64) for b in batches])
    times.sort()
    return times.tolist()


def liveness_stream(stream: DataFrame, ts: str, by: str, secs: float = 30, delay: str = "0 seconds") -> DataFrame:
    """One row each time a key has been silent for more than ``secs`` of event
    time: key, last heartbeat before the silence, heartbeats since the silence
    before. A silence is reported when the watermark passes it or, if sooner, by
    the heartbeat that ends it, so micro-batches do not change the result."""
    schema = dict(stream.dtypes)
    wait = int(secs * 1_000_000)

    def step(key, batches, state: GroupState):
        found = []
        if state.hasTimedOut:
            found.append(state.get)
            state.remove()
        else:
            last, beats = state.get if state.exists else (None, 0)
            for at in _times(batches):
                if last is not None and at - last > wait:
                    found.append((last, beats))
                    beats = 0
                last, beats = at if last is None else max(last, at), beats + 1
            state.update((last, beats))
            state.setTimeoutTimestamp(max((last + wait) // 1000, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame({by: key[0], "last_us": [f[0] for f in found], "beats": [f[1] for f in found]})

    timed_rows = timed(stream, ts, delay).select(by, ts, F.unix_micros(ts).alias("_us"))
    return timed_rows.groupBy(by).applyInPandasWithState(
        step, f"`{by}` {schema[by]}, last_us long, beats long", "last_us long, beats long", "append", EVENT_TIME
    ).select(by, F.timestamp_micros("last_us").alias("last_heartbeat"), "beats")


def throttle_stream(samples: DataFrame, cfg: ThrottleConfig | None = None, by: str = "target", ts: str = "ts", tie: str = "id") -> DataFrame:
    """The pacing controller with its state kept between micro-batches."""
    pacing = Pacing(cfg or ThrottleConfig())
    types = dict(samples.dtypes)
    extra = "batch_size int, throttle_ms int, tripped boolean, trip_count int"

    def step(key, batches, state: GroupState):
        rows = _rows(batches, ["_us", tie])
        now = PaceState(*state.get) if state.exists else pacing.start()
        columns = replay_pacing(pacing, rows["score"].tolist(), now)
        state.update((now.batch, now.pause, now.open, now.streak, now.trips))
        yield pd.DataFrame({by: key[0], "_us": rows["_us"], tie: rows[tie], "score": rows["score"], **{
            k: pd.Series(v, index=rows.index) for k, v in columns.items()}})

    scored = score_health(samples).select(by, micros(ts).alias("_us"), tie, "score")
    return scored.groupBy(by).applyInPandasWithState(
        step, f"`{by}` {types[by]}, _us long, `{tie}` {types[tie]}, score double, {extra}",
        "batch int, pause int, open boolean, streak int, trips int", "append", GroupStateTimeout.NoTimeout,
    ).withColumn(ts, F.timestamp_micros("_us")).drop("_us")


def rate_limit_stream(
    requests: DataFrame, by: str = "client_id", ts: str = "ts", tie: str = "request_id", tokens: int = 10,
    seconds: int = 1, burst: int = 20, idle_seconds: float = 60, delay: str = "0 seconds",
) -> DataFrame:
    """Token bucket per client. A client idle for ``idle_seconds`` is forgotten
    and starts with a full bucket."""
    bucket = Bucket(tokens, seconds, burst, idle_seconds)
    types = dict(requests.dtypes)
    wait = int(idle_seconds * 1000)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _rows(batches, ["_us", tie])
        now = BucketState(*state.get) if state.exists else bucket.start()
        columns = replay_bucket(bucket, rows["_us"].tolist(), now)
        state.update((now.level, now.seen))
        state.setTimeoutTimestamp(max(now.seen // 1000 + wait + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({by: key[0], tie: rows[tie], "_us": rows["_us"], **{
            k: pd.Series(v, index=rows.index) for k, v in columns.items()}})

    rows = timed(requests, ts, delay).select(by, ts, tie, F.unix_micros(ts).alias("_us"))
    return rows.groupBy(by).applyInPandasWithState(
        step, f"`{by}` {types[by]}, `{tie}` {types[tie]}, _us long, allowed boolean",
        "level long, seen long", "append", EVENT_TIME,
    ).withColumn(ts, F.timestamp_micros("_us")).drop("_us")


def bucket_of(key: str):
    """Number of the bucket a key is in; NULL has one of its own, so that whole numbers of the others stay whole in pandas."""
    return F.when(F.col(key).isNull(), F.lit(NULLS).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(body).read_pandas()


_HELD = ["migration_id", "to_state", "since", "_us", "id", "due"]


def _newest_states(held: pd.DataFrame | None, new: pd.DataFrame | None, passed: int, wait: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(held, rows to emit) of a bucket of changes after the events ``new`` of a micro-batch, at the watermark ``passed`` in ms.

    ``held`` has one row per change: its newest event (``_us``, id, to_state), the start of that state and when it is due.
    """
    parts = [p for p in (held, new) if p is not None and len(p)]
    if not parts:
        return pd.DataFrame(columns=_HELD), pd.DataFrame()
    line = pd.concat([p[[c for c in _HELD if c in p]] for p in parts], ignore_index=True)
    n = len(line) if new is None else len(line) - len(new)
    key, keys = pd.factorize(line["migration_id"], use_na_sentinel=False)  # those held come first, one row each
    state, states = pd.factorize(line["to_state"], use_na_sentinel=False)
    rank = pd.factorize(line["id"], sort=True)[0]
    rank[rank < 0] = len(line)
    us = line["_us"].to_numpy().astype(np.int64)
    touched = np.zeros(len(keys), bool)
    touched[key[n:]] = True
    old = np.minimum(key, n - 1) if n else key
    live = (np.arange(len(line)) < n) | (key >= n) | (us > us[old]) | ((us == us[old]) & (rank > rank[old]))
    at = np.flatnonzero(live)
    at = at[np.lexsort((rank[at], us[at], at >= n, key[at]))]
    first = np.diff(key[at], prepend=-1) != 0
    again = ~first & (at >= n) & (np.roll(at, 1) >= n) & (np.roll(us[at], 1) == us[at]) & (np.roll(rank[at], 1) == rank[at])
    at = at[~again]
    first = np.diff(key[at], prepend=-1) != 0
    is_null = pd.isna(states)[state[at]] if len(states) else np.zeros(0, bool)
    moved = np.where(first, (at >= n) & ~is_null, state[at] != np.roll(state[at], 1))
    since = np.where(moved, us[at], 0)
    if n:
        since[first & (at < n)] = held["since"].to_numpy()
    last = np.flatnonzero(np.append(first[1:], True))
    since = since[np.maximum.accumulate(np.where(first | moved, np.arange(len(at)), 0))[last]]
    end = at[last]  # the newest event of each change, in the order of ``keys``
    name = pd.Series(np.asarray(states, dtype=object)[state[end]], dtype=object)
    done, waits = name.isin(TERMINAL).to_numpy(), (name != "Pending").to_numpy()
    due = np.full(len(keys), NEVER)
    if n:
        due[:n] = held["due"].to_numpy()
    fresh = np.maximum(np.where(done, us[end] // 1000 + 1, since // 1000 + wait), passed + 1)
    due = np.where(touched, np.where(done | waits, fresh, NEVER), due)
    ripe = ~touched & (due < passed)
    due[ripe] = NEVER
    now = pd.DataFrame({"migration_id": keys, "to_state": name, "since": since, "_us": us[end], "id": line["id"].to_numpy()[end], "due": due})
    said = touched | (ripe & ~done)
    out = now.loc[said, ["migration_id", "to_state", "since", "_us"]].assign(stuck=ripe[said])
    return now[~(ripe & done)], out


def state_stream(events: DataFrame, secs: float = 600, delay: str = "0 seconds") -> DataFrame:
    """Current state per change. A row per change and micro-batch with its newest
    state, and a row with ``stuck`` set when an unfinished change, not Pending,
    has held its state for ``secs``.

    The newest event is the one with the largest (created_at, id) of all
    micro-batches so far: events that come late do not turn a state back. A
    finished change is forgotten once the watermark has passed its last event.
    Changes share state and Python calls by bucket, so one costs bytes and not a call.
    """
    wait = int(secs * 1000)
    key_type = dict(events.dtypes)["migration_id"]

    def step(key, batches, state: GroupState):
        held = unpacked(bytes(state.get[0])) if state.exists else None
        new = None if state.hasTimedOut else pd.concat([b[["migration_id", "to_state", "_us", "id"]] for b in batches], ignore_index=True)
        held, out = _newest_states(held, new, state.getCurrentWatermarkMs(), wait)
        if len(held):
            state.update((packed(held),))
            due = int(held["due"].min())
            if due < NEVER:
                state.setTimeoutTimestamp(due)
        else:
            state.remove()
        if len(out):
            yield out.set_axis(["migration_id", "state", "since_us", "newest_us", "stuck"], axis=1)

    rows = timed(events, "created_at", delay).select(
        "migration_id", "id", "to_state", "created_at", F.unix_micros("created_at").alias("_us"), bucket_of("migration_id").alias("_bucket"))
    return rows.groupBy("_bucket").applyInPandasWithState(
        step, f"migration_id {key_type}, state string, since_us long, newest_us long, stuck boolean", "held binary", "append", EVENT_TIME,
    ).select("migration_id", "state", F.timestamp_micros("since_us").alias("since"), F.timestamp_micros("newest_us").alias("newest_at"), "stuck")
