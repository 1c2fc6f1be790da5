"""The two sequential controllers: adaptive pacing and token bucket.

``step`` methods advance one row. ``Pacing.summarise`` and ``Bucket.summarise``
describe what a run of rows does to *any* state before it, so that runs can be
summarised in parallel and chained afterwards.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from changeguard.plans.plan import ThrottleConfig

# Score zones, their batch factors in tenths and pauses in ms, and
# how many equal verdicts in a row trip or reset the breaker.
GOOD, POOR, BAD = 0.8, 0.5, 0.3
FASTER, SLOWER, SLOWEST = (15, -5), (8, 20), (5, 50)
STREAK = 3


@dataclass
class PaceState:
    batch: int
    pause: int
    open: bool = False
    streak: int = 0  # bad verdicts while closed, good ones while open
    trips: int = 0


class StepMap:
    """A monotone integer function on [lo, hi] as constant pieces.

    What is passed between tasks are the differences of neighbouring pieces,
    compressed: they repeat, so even a map that leaves all values apart is small.
    """

    def __init__(self, lo: int, hi: int):
        self.cuts = np.arange(lo, hi + 1)
        self.values = self.cuts.copy()

    def __getstate__(self):
        packed = [(int(x[0]), zlib.compress(np.diff(x).astype(np.int32).tobytes())) for x in (self.cuts, self.values)]
        return {"packed": packed}

    def __setstate__(self, state):
        self.cuts, self.values = (
            first + np.concatenate(([0], np.cumsum(np.frombuffer(zlib.decompress(rest), dtype=np.int32), dtype=np.int64)))
            for first, rest in state["packed"])

    def then(self, f) -> None:
        v = f(self.values)
        keep = np.ones(len(v), dtype=bool)
        keep[1:] = v[1:] != v[:-1]
        self.cuts, self.values = self.cuts[keep], v[keep]

    def constant(self, value: int) -> None:
        self.cuts, self.values = self.cuts[:1], np.array([value])

    def __call__(self, x: int) -> int:
        return int(self.values[np.searchsorted(self.cuts, x, side="right") - 1])


class Pacing:
    """Batch size and pause from a health score, with a breaker."""

    def __init__(self, cfg: ThrottleConfig):
        self.cfg = cfg

    def start(self) -> PaceState:
        return PaceState(self.cfg.batch, self.cfg.pause_ms)

    def _verdict(self, s: PaceState, score: float) -> str:
        """Move the breaker; says whether to adapt, hold or reset the pace."""
        if s.open:
            s.streak = s.streak + 1 if score > self.cfg.recover_above else 0
            if s.streak < STREAK:
                return "hold"
            s.open, s.streak = False, 0
            return "reset"
        s.streak = s.streak + 1 if score < self.cfg.trip_below else 0
        if s.streak < STREAK:
            return "adapt"
        s.open, s.streak, s.trips = True, 0, s.trips + 1
        return "hold"

    @staticmethod
    def _zone(score: float):
        if score > GOOD:
            return FASTER
        if score < BAD:
            return SLOWEST
        return SLOWER if score < POOR else None

    def _batch(self, b, tenths: int):
        scaled = b * tenths // 10
        return np.minimum(scaled, self.cfg.batch_max) if tenths > 10 else np.maximum(scaled, self.cfg.batch_min)

    def _pause(self, p: int, ms: int) -> int:
        return min(p + ms, self.cfg.pause_max) if ms > 0 else max(p + ms, self.cfg.pause_min)

    def step(self, s: PaceState, score: float) -> None:
        verdict = self._verdict(s, score)
        if verdict == "reset":
            s.batch, s.pause = self.cfg.batch, self.cfg.pause_ms
        elif verdict == "adapt" and (zone := self._zone(score)):
            s.batch, s.pause = int(self._batch(s.batch, zone[0])), self._pause(s.pause, zone[1])

    def summarise(self, scores) -> dict:
        """For each breaker state before the run: the breaker after it, trips in
        it, and the effect on batch and pause."""
        c = self.cfg
        lo, hi = min(c.batch, c.batch_min), max(c.batch, c.batch_max)
        p_lo, p_hi = min(c.pause_ms, c.pause_min), max(c.pause_ms, c.pause_max)
        effect = {}
        for is_open in (False, True):
            for streak in range(STREAK):
                s = PaceState(0, 0, is_open, streak)
                batch, ends = StepMap(lo, hi), (p_lo, p_hi)
                shift = 0
                for score in scores:
                    verdict = self._verdict(s, score)
                    if verdict == "reset":
                        batch.constant(c.batch)
                        ends, shift = (c.pause_ms, c.pause_ms), 0
                    elif verdict == "adapt" and (zone := self._zone(score)):
                        batch.then(lambda v, z=zone: self._batch(v, z[0]))
                        ends = tuple(self._pause(e, zone[1]) for e in ends)
                        shift += zone[1]
                effect[is_open, streak] = (s.open, s.streak, s.trips, batch, ends, shift)
        return effect

    def jump(self, s: PaceState, effect: dict, _rows=None) -> PaceState:
        """The state after a summarised run. Pauses move by ``shift`` between the
        images of the two ends of their range."""
        is_open, streak, trips, batch, (low, high), shift = effect[s.open, s.streak]
        return PaceState(batch(s.batch), min(max(s.pause + shift, low), high), is_open, streak, s.trips + trips)


@dataclass
class BucketState:
    level: int
    seen: int | None = None  # time of the last request in microseconds


class Bucket:
    """``tokens`` per ``seconds`` up to ``burst``, in whole units: one token is
    ``seconds`` * 1e6 units and each microsecond refills ``tokens`` units."""

    def __init__(self, tokens: int = 10, seconds: int = 1, burst: int = 20, idle_seconds: float | None = None):
        self.rate, self.token = int(tokens), int(seconds) * 1_000_000
        self.full = int(burst) * self.token
        self.idle = None if idle_seconds is None else int(idle_seconds * 1_000_000)

    def start(self) -> BucketState:
        return BucketState(self.full)

    def _refill(self, level: int, gap: int) -> int:
        if self.idle is not None and gap > self.idle:
            return self.full
        return min(self.full, level + gap * self.rate)

    def step(self, s: BucketState, at: int) -> bool:
        if s.seen is not None:
            s.level = self._refill(s.level, at - s.seen)
        s.seen = at
        if s.level < self.token:
            return False
        s.level -= self.token
        return True

    def summarise(self, times) -> tuple:
        """Pieces (from, to, shift or None, constant): the level after the run as
        a function of the level at its first request. Two starts differ by at
        most ``burst`` + 1 admitted requests, so there are few pieces."""
        pieces = [(0, self.full, 0, None)]
        before = times[0]
        for at in times:
            gap, before = at - before, at
            reset = self.idle is not None and gap > self.idle
            pieces = self._spend(self._clip(pieces, self.full if reset else gap * self.rate))
        return int(times[0]), int(times[-1]), pieces

    def _clip(self, pieces, add: int):
        out = []
        for a, b, shift, const in pieces:
            if shift is None:
                out.append((a, b, None, min(self.full, const + add)))
                continue
            edge = self.full - add - shift  # from here on the bucket is full
            if a < edge:
                out.append((a, min(b, edge - 1), shift + add, None))
            if b >= edge:
                out.append((max(a, edge), b, None, self.full))
        return out

    def _spend(self, pieces):
        out = []
        for a, b, shift, const in pieces:
            if shift is None:
                new = [(a, b, None, const - self.token if const >= self.token else const)]
            else:
                edge = self.token - shift  # from here on a token is there
                new = [(a, min(b, edge - 1), shift, None)] if a < edge else []
                if b >= edge:
                    new.append((max(a, edge), b, shift - self.token, None))
            for p in new:
                if out and out[-1][2:] == p[2:]:
                    p = (out.pop()[0], *p[1:])
                out.append(p)
        return out

    def jump(self, s: BucketState, effect: tuple, _rows=None) -> BucketState:
        first, last, pieces = effect
        x = s.level if s.seen is None else self._refill(s.level, first - s.seen)
        for a, b, shift, const in pieces:
            if a <= x <= b:
                return BucketState(const if shift is None else x + shift, last)
        raise ValueError(f"level {x} outside 0..{self.full}")
