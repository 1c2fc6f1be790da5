"""Removal of every byte within a long string that occurs elsewhere.

Repeats of at least ``LENGTH`` bytes are found by induction from sampled suffixes, all state in shuffled or written
tables, so a corpus of any size passes through bounded memory:

1. Sample. Among the ``SPAN`` first positions of each window of ``LENGTH`` bytes the one with the smallest hash of its
   next 8 bytes is the window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors,
   and neighbouring windows share theirs: about one suffix in ``SPAN / 2`` is kept.
2. Name. A suffix tuple is (name of the anchor's next ``CORE`` bytes, name of the run: all bytes of the windows of one
   anchor). Every window of an anchor holds its core. Cores that occur once are dropped: their windows occur once.
   Equal run names make whole runs repeats. Sorting the tuples is Spark's external sort.
3. Induce. Only runs with a shared core and no equal run are left, the ends of maximal repeats. They meet, with one
   run of each other name of the core, in a stream sorted by core. The lengths of the common prefix right of two
   anchors and of the common suffix left of them give all windows the two runs share. Where more than ``FEW``
   different runs share a core, every window is named by its bytes instead, and names that occur twice are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import prepare, row_key, stored

LENGTH = 400
SPAN = 256
#: Bytes of a text that are scanned at once.
BLOCK = 1 << 21
#: Different runs of one core that are compared in pairs.
FEW = 32

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _order(raw: np.ndarray) -> np.ndarray:
    """For each position a 32-bit hash of the next 8 bytes, in the high half of 64 bits."""
    x = raw.astype(np.uint64)
    two = x[:-1] | (x[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    h = (eight ^ (eight >> np.uint64(29))) * _MIX
    return ((h ^ (h >> np.uint64(32))) * _MIX) & np.uint64(0xFFFFFFFF00000000)


def runs(data: bytes, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of every run of windows with one anchor.

    Ties go to the leftmost position, so the choice depends on the window's bytes only.
    """
    total = len(data) - length + 1
    if total <= 0:
        return (np.zeros(0, np.int64),) * 3
    raw, parts = np.frombuffer(data, dtype=np.uint8), []
    for at in range(0, total, BLOCK):
        n = min(BLOCK, total - at)
        low = _order(raw[at : at + n + span + 6])
        low = low | np.arange(len(low), dtype=np.uint64)
        step = 1
        while step < span:  # the smallest of twice as many positions
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        parts.append((low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
    anchors = np.concatenate(parts)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    return first, np.append(first[1:], total) - 1, anchors[first]


def _suffixes(length: int, span: int):
    core = length - span + 1

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None or len(data) < length:
                    continue
                first, last, anchor = runs(data, length, span)
                for begin in range(0, len(first), 100_000):  # a long text gives several batches
                    some = slice(begin, begin + 100_000)
                    cores = [xxhash.xxh3_64_intdigest(data[a : a + core]) for a in anchor[some].tolist()]
                    names = [xxhash.xxh3_128_digest(data[a : b + length]) for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(cores), pa.binary()), pa.array(np.array(cores, np.uint64).view(np.int64)), pa.array(names, pa.binary()),
                         *(pa.array(x[some].astype(np.int32)) for x in (first, last, anchor))], names=["key", "core", "run", "first", "last", "anchor"])

    return run


def _slices(length: int):
    def run(batches):
        for batch in batches:
            for key, data, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for begin in range(0, len(wanted), 1000):
                    some = wanted[begin : begin + 1000]
                    columns = {n: [w[n] for w in some] for n in ("core", "m", "n", "first", "last", "anchor")}
                    bodies = [data[w["first"] : w["last"] + length] for w in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(some), pa.binary()), *(pa.array(columns[n], pa.int64()) for n in ("core", "m", "n")),
                         *(pa.array(columns[n], pa.int32()) for n in ("first", "last", "anchor")), pa.array(bodies, pa.binary())],
                        names=["key", *columns, "body"])

    return run


def _common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def _shared_windows(group: list[tuple], length: int) -> list[tuple]:
    """(key, a, b) of the windows that two different runs of one core share, for runs without an equal one."""
    out = []
    parts = [(body[: anchor - first][::-1], body[anchor - first :]) for _, _, first, _, anchor, body in group]
    for i in range(1, len(group)):
        for j in range(i):
            if group[i][1] > 1 and group[j][1] > 1:
                continue
            left, right = (_common_prefix(parts[i][s], parts[j][s]) for s in (0, 1))
            # A window that starts x bytes left of the anchor needs x common bytes there and the rest on the right.
            least = max(length - right, *(g[4] - g[3] for g in (group[i], group[j])))
            if least <= left:
                out += [(g[0], g[4] - left, g[4] - least + length) for g in (group[i], group[j]) if g[1] == 1]
    return out


def _compare(length: int):
    """Rows come sorted by core; a group may reach over batches and has at most ``FEW`` rows."""
    def run(batches):
        group, core = [], None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != core:
                    out += _shared_windows(group, length)
                    group, core = [], row[0]
                if not group or (group[-1][0], group[-1][2]) != (row[1], row[3]):  # repeated rows of a document
                    group.append(row[1:])
            yield _intervals(out)
        yield _intervals(_shared_windows(group, length))

    return run


def _intervals(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "a", "b"])


def _windows(length: int):
    def run(batches):
        for batch in batches:
            for key, n, first, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = len(body) - length + 1
                names = [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * count, pa.binary()), pa.array([n == 1] * count), pa.array(np.arange(first, first + count, dtype=np.int32)), pa.array(names, pa.binary())],
                    names=["key", "end", "at", "name"])

    return run


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open intervals joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _rest(batches):
    for batch in batches:
        size, removed, count, digest, bodies = [], [], [], [], []
        for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = data or b""
            gone = merged([(s["a"], s["b"]) for s in spans or []])
            edges = [0, *(x for s in gone for x in s), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            size.append(len(data))
            removed.append(len(data) - len(left))
            count.append(len(gone))
            digest.append(hashlib.sha256(left).hexdigest())
            bodies.append(left)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(bodies, pa.binary())],
            names=["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])


def repeated_spans(source: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(key, a, b): byte ranges of the texts of ``source`` (key, body) that are covered by repeated strings."""
    suffixes = stored(source.mapInArrow(_suffixes(length, span), "key binary, core bigint, run binary, first int, last int, anchor int"), "suffixes")
    # Written, so that the join has two shuffled sides and a hot core's suffixes can be split over tasks.
    shared = stored(suffixes.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "shared-cores")
    live = stored(suffixes.join(shared, "core", "left_semi"), "shared-suffixes")
    names = live.groupBy("core", "run").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "anchor")).alias("one"))
    names = stored(names, "runs")
    whole = live.join(names.filter("n > 1").select("core", "run"), ["core", "run"], "left_semi")
    # Ends of repeats, and one run of each other name that shares a core with such an end.
    ends = names.groupBy("core").agg(F.count_if(F.col("n") == 1).alias("ends"), F.count("*").alias("m")).filter("ends > 0 and m > 1").select("core", "m")
    asked = names.join(ends, "core").select("one.key", F.struct("core", "m", "n", "one.first", "one.last", "one.anchor").alias("run"))
    asked = asked.groupBy("key").agg(F.collect_set("run").alias("runs"))  # at most the runs of one text
    pieces = stored(source.filter(F.length("body") >= length).select("key", "body").join(asked, "key").mapInArrow(
        _slices(length), "key binary, core bigint, m bigint, n bigint, first int, last int, anchor int, body binary"), "run-bytes")
    few = pieces.filter(F.col("m") <= FEW).select("core", "key", "n", "first", "last", "anchor", "body")
    few = few.repartition("core").sortWithinPartitions("core", "key", "first").mapInArrow(_compare(length), "key binary, a int, b int")
    windows = stored(pieces.filter(F.col("m") > FEW).select("key", "n", "first", "body").mapInArrow(
        _windows(length), "key binary, end boolean, at int, name binary"), "windows")
    twice = windows.groupBy("name").agg(F.min(F.struct("key", "at")).alias("x"), F.max(F.struct("key", "at")).alias("y")).filter("x != y").select("name")
    twice = stored(twice, "repeated-windows")  # written as above: a string that is in all copies is split over tasks
    many = windows.filter("end").join(twice, "name", "left_semi").select("key", F.col("at").alias("a"), (F.col("at") + length).alias("b"))
    return whole.select("key", F.col("first").alias("a"), (F.col("last") + length).alias("b")).union(few).union(many)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, span: int = SPAN, bodies: bool = False) -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, n_spans, kept_sha256 (and ``rest``, the bytes left).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this or another text;
    strings are judged on the input. A NULL text is empty; texts under ``length`` bytes stay; rows that repeat id and
    text repeat each other, so all their bytes go if there are enough; no rows give none.
    """
    if length < span + 8:
        raise ValueError("length must exceed the span of anchors by 8 bytes at least")
    prepare(df.sparkSession)
    source = df.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("body"))
    found = repeated_spans(source.select("key", "body"), length, span).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    found = stored(found, "spans")
    joined = source.join(found, "key", "left").select("__id", "body", "spans")
    out = joined.mapInArrow(_rest, joined.select("__id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("rest", "binary"))
    return out.select(F.col("__id").alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["rest"] if bodies else []))
