"""Hard negatives of anchors by rotated one-bit codes, with exact integer scores for what the codes cannot decide.

1. Each vector is rotated (random signs, then a Hadamard transform) and replaced by its signs; the inner product of the
   vector with that unit code vector, its alignment, is stored. What the code leaves is coded again after another
   rotation, ``LEVELS`` times; the length of what is left in the end is stored too.
2. An anchor's rotated components are rounded to ``PLANES`` bits, so its inner product with a code is a sum of popcounts.
   Alignments times these products estimate a score. By Cauchy and Schwarz the error is at most the length of the
   anchor across the last code times the length of what was left, plus the rounding: an interval that always holds.
3. Rows whose interval misses the wanted scores, or lies below as many certain ones as are wanted, go. The rest is
   scored in whole numbers. So the result is exact, and the codes only say what need not be scored.

Rows and anchors meet in blocks: a block of anchors is dealt to every group of row blocks, a task keeps the best for
each of its anchors, and a window keeps the best of all tasks. Nothing is collected, and no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeguard.llm.common import prepare, stored

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative is hard.
LOW, HIGH = 30, 90
SCALE = 256
#: Rotated one-bit codes for each vector, and bits of a rounded anchor component.
LEVELS, PLANES = 6, 6
#: Bytes of vectors in a block of rows and of anchors, anchors compared at once, and pairs of blocks in a task of a large job.
ROW_BYTES, ANCHOR_BYTES, AT_ONCE, CELLS = 1 << 19, 1 << 18, 128, 16
#: Components beyond this are taken as not finite: their scores would not fit a long.
LARGEST = float(1 << 18)
_EXACT = float(1 << 53)
_SEED = 20240311


def _signs(level: int, width: int) -> np.ndarray:
    return np.where(np.random.default_rng((_SEED, level, width)).random(width) < 0.5, -1.0, 1.0)


def rotate(x: np.ndarray, level: int) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) under the rotation of a level: random signs, then a Hadamard transform."""
    width = x.shape[1]
    y = x * _signs(level, width)
    half = 1
    while half < width:
        y = y.reshape(len(x), -1, 2, half)
        y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), width)
        half *= 2
    return y / np.sqrt(width)


def _back(y: np.ndarray, level: int) -> np.ndarray:
    """The inverse of ``rotate``: the transform is symmetric, the signs come last."""
    ones = np.ones(y.shape[1])
    half, x = 1, y
    while half < len(ones):
        x = x.reshape(len(y), -1, 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(y), len(ones))
        half *= 2
    return x / np.sqrt(len(ones)) * _signs(level, len(ones))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes (level, row, word), alignments (level, row), length of what is left) of the rows of ``x``."""
    width = x.shape[1]
    left, codes, aligned = x.astype(np.float64), [], []
    for level in range(LEVELS):
        turned = rotate(left, level)
        up = turned >= 0
        code = np.where(up, 1.0, -1.0) / np.sqrt(width)
        along = np.einsum("ij,ij->i", turned, code)
        left = _back(turned - along[:, None] * code, level)
        codes.append(_words(up))
        aligned.append(along)
    return np.stack(codes), np.stack(aligned), np.sqrt(np.einsum("ij,ij->i", left, left))


def _weighted_ups(rounded: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of the rounded components of each anchor where a code is up, by popcounts of its bit planes."""
    shape = len(rounded), len(codes)
    total = np.zeros(shape, dtype=np.uint32 if codes.shape[1] > 15 else np.uint16)
    both, ups, part = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty_like(total)
    for plane in range(PLANES):
        bits = _words((rounded >> plane) & 1 == 1)
        for word in range(bits.shape[1]):
            np.bitwise_and(bits[:, word, None], codes[None, :, word], out=both)
            np.bitwise_count(both, out=ups)
            np.multiply(ups, total.dtype.type(1 << plane), out=part)
            total += part
    return total


def intervals(anchors: np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), each (anchor, row): bounds that hold for every inner product."""
    width = anchors.shape[1]
    root = np.sqrt(width)
    square = np.einsum("ij,ij->i", anchors, anchors)
    size = np.sqrt(square)
    estimate, slack = np.zeros((len(anchors), len(rest))), np.zeros((len(anchors), len(rest)))
    for level in range(LEVELS):
        turned = rotate(anchors, level)
        least = turned.min(axis=1, initial=0.0)
        step = np.maximum((turned.max(axis=1, initial=0.0) - least) / ((1 << PLANES) - 1), 1e-300)
        rounded = np.rint((turned - least[:, None]) / step[:, None]).astype(np.int64)
        near = least[:, None] + rounded * step[:, None]
        off = np.abs(turned - near).sum(axis=1) / root
        ups = np.bitwise_count(codes[level]).sum(axis=1, dtype=np.int64)
        total = _weighted_ups(rounded, codes[level])
        along = ((2.0 * step / root)[:, None] * total) + ((2.0 * least / root)[:, None] * ups[None, :] - (near.sum(axis=1) / root)[:, None])
        estimate += along * aligned[level]
        slack += off[:, None] * np.abs(aligned[level])
    # The length of the anchor across the last code, from the smallest product that rounding leaves possible.
    nearest = np.maximum(np.abs(along) - off[:, None], 0.0)
    across = np.sqrt(np.maximum(square[:, None] - nearest * nearest, 0.0))
    slack += across * rest + 1e-9 * (size[:, None] * np.sqrt((aligned * aligned).sum(axis=0) + rest * rest) + 1.0)
    return estimate - slack, estimate + slack


def _packed(batches, width: int, most: int):
    """Blocks of rows with their codes."""
    ids, labels, vectors, keys = [], [], [], []

    def block():
        x = np.zeros((len(ids), width), dtype=np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        codes, aligned, rest = encode(x)
        return pa.RecordBatch.from_pydict({
            "first": [keys[0]], "n": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()], "labels": [np.array(labels, np.int64).tobytes()],
            "vectors": [x.astype(np.int32).tobytes()], "codes": [codes.tobytes()], "aligned": [aligned.tobytes()], "rest": [rest.tobytes()]})

    for batch in batches:
        flat = batch.column(2)
        for i, (vec_id, label, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            ids.append(vec_id)
            labels.append(label)
            keys.append(key)
            vectors.append(flat[i].values.to_numpy(zero_copy_only=False))
            if len(ids) == most:
                yield block()
                ids, labels, vectors, keys = [], [], [], []
    if ids:
        yield block()


_BLOCK = "first binary, n long, ids binary, labels binary, vectors binary, codes binary, aligned binary, rest binary"


class _Rows:
    """One block of rows as arrays."""

    def __init__(self, n, ids, labels, vectors, codes, aligned, rest):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(n, -1)
        self.codes = np.frombuffer(codes, np.uint64).reshape(LEVELS, n, -1)
        self.aligned, self.rest = np.frombuffer(aligned, np.float64).reshape(LEVELS, n), np.frombuffer(rest, np.float64)
        self._derive()

    def _derive(self):
        self.most = float(np.abs(self.vectors).max(initial=0)) * self.vectors.shape[1]
        self.floats, self.whole = self.vectors.astype(np.float64), None

    def take(self, which: np.ndarray) -> _Rows:
        """The block of some of the rows."""
        part = object.__new__(_Rows)
        part.ids, part.labels, part.vectors, part.codes = self.ids[which], self.labels[which], self.vectors[which], self.codes[:, which]
        part.aligned, part.rest = self.aligned[:, which], self.rest[which]
        part._derive()
        return part

    def scores(self, anchor: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whole-number inner products with the rows ``found``."""
        if self.most * float(np.abs(anchor).max(initial=0)) < _EXACT:  # sums of floats are exact here
            rows, anchor = self.floats, anchor.astype(np.float64)
        else:
            self.whole = self.vectors.astype(np.int64) if self.whole is None else self.whole
            rows = self.whole
        # Where most rows are wanted, copying them costs more than scoring the others.
        return ((rows @ anchor)[found] if 4 * len(found) > len(rows) else rows[found] @ anchor).astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class _Best:
    """The best rows of one anchor so far: higher scores first, ties by smaller id."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        """Scores below this cannot enter any more."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def _bounds(x: np.ndarray, rows: _Rows):
    """(number of the anchor, its low and high bounds for all rows), some anchors at once."""
    for begin in range(0, len(x), AT_ONCE):
        low, high = intervals(x[begin : begin + AT_ONCE].astype(np.float64), rows.codes, rows.aligned, rows.rest)
        yield from zip(range(begin, begin + len(low)), low, high, strict=True)


def _search(asked: list[tuple[_Best, float, float]], low, high, wanted: np.ndarray, anchor: np.ndarray, rows: _Rows) -> None:
    """For each (best so far, bottom, top): enter the ``wanted`` rows with scores from bottom to top that can be among the best."""
    low, high, at = low[wanted], high[wanted], np.flatnonzero(wanted)
    open_ = []
    for best, bottom, top in asked:
        sure = low[(low >= bottom) & (high <= top)]
        floor = max(bottom, best.floor(), _kth(sure, best.k))
        open_.append((best, floor, top, (high >= floor) & (low <= top)))
    union = np.logical_or.reduce([x[3] for x in open_])
    found = np.flatnonzero(union)
    if not len(found):
        return
    scores, ids = rows.scores(anchor, at[found]), rows.ids[at[found]]
    for best, floor, top, _ in open_:  # a row that only another question left open is scored too, and may as well enter
        fit = np.flatnonzero((scores >= floor) & (scores <= top))
        if len(fit):
            best.add(ids[fit], scores[fit])


def _meet(width: int, task):
    """Batches of (anchor block, row block) to the results of ``task``, which is told where an anchor block ends."""
    def run(batches):
        held, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != row["block"]:
                    if state is not None:
                        yield from task.result(state)
                    held, state = row["block"], task.begin(row, width)
                task.meet(state, _Rows(*(row[c] for c in ("n", "ids", "labels", "vectors", "codes", "aligned", "rest"))))
        if state is not None:
            yield from task.result(state)

    return run


class _Positives:
    """The first rows of the anchor's label, without rows of its id."""

    schema = "akey binary, other long, score long"

    def __init__(self, k: int):
        self.k = k

    def begin(self, row, width):
        x = np.frombuffer(row["a_vectors"], np.int32).reshape(-1, width).astype(np.int64)
        return {"keys": row["a_keys"], "x": x, "ids": np.frombuffer(row["a_ids"], np.int64), "labels": np.frombuffer(row["a_labels"], np.int64), "best": [_Best(self.k) for _ in x]}

    def meet(self, s, rows):
        for label in np.intersect1d(s["labels"], rows.labels):
            own, same = np.flatnonzero(s["labels"] == label), rows.take(rows.labels == label)
            for k, low, high in _bounds(s["x"][own], same):
                a = own[k]
                _search([(s["best"][a], -np.inf, np.inf)], low, high, same.ids != s["ids"][a], s["x"][a], same)

    def result(self, s):
        n = [len(b.ids) for b in s["best"]]
        if sum(n):
            keys = [s["keys"][i * 16 : i * 16 + 16] for i, k in enumerate(n) for _ in range(k)]
            yield pa.RecordBatch.from_pydict({"akey": keys, "other": np.concatenate([b.ids for b in s["best"]]), "score": np.concatenate([b.scores for b in s["best"]])})


class _Negatives:
    """For each score of a positive, the first rows of other labels within the two shares of it."""

    schema = "akey binary, asked long, other long, score long"

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def begin(self, row, width):
        x = np.frombuffer(row["a_vectors"], np.int32).reshape(-1, width).astype(np.int64)
        asked = [sorted(set(q or [])) for q in row["a_asked"]]
        return {"keys": row["a_keys"], "x": x, "labels": np.frombuffer(row["a_labels"], np.int64), "asked": asked, "best": [[_Best(self.k) for _ in q] for q in asked]}

    def meet(self, s, rows):
        for a, low, high in _bounds(s["x"], rows):
            limits = ((best, -(-self.low * score // 100), self.high * score // 100) for score, best in zip(s["asked"][a], s["best"][a], strict=True))
            asked = [x for x in limits if x[1] <= x[2]]
            if asked:
                _search(asked, low, high, rows.labels != s["labels"][a], s["x"][a], rows)

    def result(self, s):
        out = [(s["keys"][a * 16 : a * 16 + 16], score, b) for a, (asked, best) in enumerate(zip(s["asked"], s["best"], strict=True)) for score, b in zip(asked, best, strict=True) if len(b.ids)]
        if out:
            yield pa.RecordBatch.from_pydict({
                "akey": [k for k, _, b in out for _ in b.ids], "asked": np.array([q for _, q, b in out for _ in b.ids], np.int64),
                "other": np.concatenate([b.ids for _, _, b in out]), "score": np.concatenate([b.scores for _, _, b in out])})


def _joined(blocks: DataFrame, anchors: DataFrame, width: int, task) -> DataFrame:
    """``task`` over all pairs of an anchor block and a row block.

    Row blocks have a slot by hash; a cell is an anchor block and a slot, with one copy of the anchor block. Cells are
    dealt to a fixed number of tasks, as their work is far larger than their bytes.
    """
    spark = blocks.sparkSession
    last = anchors.agg(F.max("block").alias("m")).first()["m"]
    if last is None:
        return spark.createDataFrame([], task.schema)
    slots = blocks.count()
    cells = slots * (last + 1)
    tasks = min(cells, max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells // CELLS))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    rows = blocks.withColumn("slot", F.pmod(F.xxhash64("first"), F.lit(slots))).drop("first").withColumn("block", up_to(last))
    asked = anchors.withColumn("slot", up_to(slots - 1))
    met = rows.repartition(tasks, "block", "slot").join(asked.repartition(tasks, "block", "slot").hint("merge"), ["block", "slot"])
    return met.sortWithinPartitions("block").mapInArrow(_meet(width, task), task.schema)


def _anchor_blocks(anchors: DataFrame, most: int, *more: str) -> DataFrame:
    """Blocks of at most ``most`` anchors: their keys, ids, labels and vectors packed in the order of the keys."""
    counted = anchors.count()
    parts = max(1, -(-counted // most))
    dealt = anchors.repartition(parts, "akey").select("akey", "vec_id", "label", "parts", *more)
    schema = "block_key binary, a_keys binary, a_ids binary, a_labels binary, a_vectors binary" + "".join(f", a_{c} array<array<bigint>>" for c in more)

    def pack(batches):
        rows = []

        def block():
            return pa.RecordBatch.from_pydict({
                "block_key": [rows[0]["akey"]], "a_keys": [b"".join(r["akey"] for r in rows)], "a_ids": [np.array([r["vec_id"] for r in rows], np.int64).tobytes()],
                "a_labels": [np.array([r["label"] for r in rows], np.int64).tobytes()], "a_vectors": [np.array([r["parts"] for r in rows], np.int32).tobytes()],
                **{f"a_{c}": pa.array([[r[c] or [] for r in rows]], pa.list_(pa.list_(pa.int64()))) for c in more}})

        for batch in batches:
            for r in batch.to_pylist():
                rows.append(r)
                if len(rows) == most:
                    yield block()
                    rows = []
        if rows:
            yield block()

    packed = stored(dealt.mapInArrow(pack, schema), "anchor-blocks")
    # Blocks are few (``most`` anchors each); their numbers come from the order of their first keys.
    ranks = packed.select("block_key").withColumn("block", F.row_number().over(W.orderBy("block_key")).cast("long") - 1)
    return packed.join(ranks, "block_key").drop("block_key")


def mine(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of anchors and positives.

    Components are floored after multiplication by 256, scores are whole-number inner products, higher first, ties by
    smaller id. Anchors are rows whose id is divisible by ``every``. An anchor's positives are its first ``positives``
    other rows of its label; for each, the first ``negatives`` rows of other labels with a score from ``low`` to ``high``
    percent of the positive's are returned with their rank. A positive of negative score has none.

    Rows with a NULL id, label or vector, or a component that is NULL, not finite or beyond 2^18, take no part.
    Shorter vectors go on with zeros; an empty vector scores 0 with all. Other rows are rows of another id: rows that
    repeat count as often as they are there, a repeated anchor asks once. No rows give no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("int"))
    fine = F.forall(F.col(vector).cast("array<double>"), lambda x: F.coalesce((x >= -LARGEST) & (x <= LARGEST), F.lit(False)))
    rows = df.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("parts"))
    width = rows.agg(F.max(F.size("parts")).alias("n")).first()["n"] or 1
    width = 1 << (width - 1).bit_length()
    padded = F.concat("parts", F.array_repeat(F.lit(0), F.lit(width) - F.size("parts")))
    keyed = rows.withColumn("akey", F.unhex(F.md5(F.concat_ws(",", "vec_id", "label", F.col("parts").cast("array<string>")))))
    most_rows, most_anchors = max(1, ROW_BYTES // (4 * width)), max(1, ANCHOR_BYTES // (4 * width))
    blocks = stored(keyed.select("vec_id", "label", "parts", "akey").mapInArrow(lambda b: _packed(b, width, most_rows), _BLOCK), "coded")
    anchors = stored(keyed.filter(F.col("vec_id") % every == 0).select("akey", "vec_id", "label", padded.alias("parts")).dropDuplicates(["akey"]), "anchors")

    best = W.partitionBy("akey").orderBy(F.col("score").desc(), "other")
    first = _joined(blocks, _anchor_blocks(anchors, most_anchors), width, _Positives(positives))
    near = stored(first.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).drop("place"), "positives")

    asked = anchors.join(near.groupBy("akey").agg(F.collect_set("score").alias("asked")), "akey")
    found = _joined(blocks, _anchor_blocks(asked, most_anchors, "asked"), width, _Negatives(negatives, low, high))
    each = W.partitionBy("akey", "asked").orderBy(F.col("score").desc(), "other")
    hard = found.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= negatives)
    pairs = near.join(anchors.select("akey", "vec_id"), "akey").select("akey", F.col("vec_id").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(hard, (pairs["akey"] == hard["akey"]) & (pairs["positive_score"] == hard["asked"])).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", wrong_every: int = 7, labels: int = 10, **limits) -> DataFrame:
    """``mine`` where rows whose id is divisible by ``wrong_every`` first take the next of the ``labels`` labels."""
    moved = F.when(F.col(vec_id) % wrong_every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    return mine(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), moved.alias("label")), "vec_id", "vector", "label", **limits)
