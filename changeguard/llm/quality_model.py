"""A quality classifier on supervised subword embeddings: hashed words and character n-grams, averaged per text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import prepare
from changeguard.llm.wordhash import mixed

#: Labelled rows that the model is fitted on; a bound on what reaches the driver, as are their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 32 << 20
BUCKETS_LOG2, WIDTH = 18, 16
NGRAMS = (3, 4, 5)
EPOCHS, RATE, SEED = 5, 0.5, 7
#: Characters hashed at once.
PIECE = 1 << 18

_RNG = np.random.default_rng(5)
_CHAR = _RNG.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint32)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Bucket of every feature of a whole text: words, words that repeat the word before, n-grams inside ``<word>``.

    Case and punctuation are kept. Long texts are hashed piece by piece, cut before a white space; the result does
    not depend on the cuts but for words longer than a piece.
    """
    out = []
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = cut if cut > at else end
        out.append(_piece_features(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _piece_features(text: str) -> np.ndarray:
    chars = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    white = np.isin(chars, _WHITE)
    edge = np.flatnonzero(np.diff(~white, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64)
    code = np.where(white, np.uint64(3), _CHAR[chars & 0xFFF] + chars.astype(np.uint64))
    found = []
    # n-grams with the word's borders as characters, none across words
    total = np.zeros(len(code), np.uint64)
    powers = np.multiply.accumulate(np.array([1] + [_P] * (max(NGRAMS) - 1), np.uint64))
    inner = np.concatenate(([0], np.cumsum(white)))
    for n in range(1, max(NGRAMS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        total = total[:size] + code[n - 1 :] * powers[n - 1]
        if n in NGRAMS:
            crosses = inner[n - 1 : n - 1 + size] - inner[1 : size + 1]
            found.append(_buckets(total[crosses == 0] + np.uint64(n)))
    lengths = ends - starts
    inside = ~white
    place = np.arange(int(inside.sum())) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    powers = np.full(int(lengths.max()), _P, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    words = np.add.reduceat(code[inside] * powers[place], np.concatenate(([0], np.cumsum(lengths)[:-1]))) + lengths.astype(np.uint64)
    found.append(_buckets(words + np.uint64(77)))
    again = int(np.count_nonzero(words[1:] == words[:-1]))
    found.append(np.full(again * len(NGRAMS), _buckets(np.array([99], np.uint64))[0]))
    return np.concatenate(found)


@dataclass
class Model:
    """Embeddings of buckets, output weights and bias of the two classes."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """Each bucket's share of (class 1 - class 0); averaging commutes with the linear output."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the softmax loss, one text a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKETS_LOG2, WIDTH))
    weights, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    rows = []
    for t in texts:
        f = features(t)
        ids, counts = np.unique(f, return_counts=True)
        rows.append((ids.astype(np.int32), (counts / max(len(f), 1)).astype(np.float32)))
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ids, share = rows[i]
            hidden = share @ embeddings[ids] if len(ids) else np.zeros(WIDTH)
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            now = rate * (1 - done / steps)
            back = weights @ p
            weights -= now * np.outer(hidden, p)
            bias -= now * p
            if len(ids):
                # a feature's vector moves by its share; scaled so that long texts learn as fast as short ones
                embeddings[ids] -= (now * len(ids) * share / (1 + len(ids) * share))[:, None] * back
            done += 1
    return Model(embeddings, weights, bias)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a NULL id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, label): a repeatable sample of at most ``rows`` labelled documents that are not held out."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).cast("int").alias("__y"), F.max(label).cast("int").alias("__y2"))
    chosen = known.filter("__y = __y2").select("__id", "__y", F.xxhash64("__id").alias("__o")).orderBy("__o", "__id").limit(rows)
    # At most ``rows`` pairs of numbers: broadcast by a proven bound.
    return docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t")).join(F.broadcast(chosen), "__id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on a bounded sample of whole texts, in the order of a hash, within ``SAMPLE_BYTES``.

    Without a label the model is flat and says 0.5 for every text.
    """
    sample = training_rows(docs, labels, rows, doc_id, text, label)
    sized = sample.select("__o", "__id", "__y", F.octet_length("__t").alias("__b"), "__t")
    texts, ys, size = [], [], 0
    for r in sized.orderBy("__o", "__id", "__t").toLocalIterator():
        size += r["__b"]
        if size > SAMPLE_BYTES:
            break
        texts.append(r["__t"])
        ys.append(r["__y"])
    return train(texts, np.array(ys, dtype=np.int64))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, held_out, score (probability of label 1), predicted.

    Whole texts are scored and nothing but the text counts. A NULL text is an empty one and gets the score of the
    bias; rows that repeat get the same score; no rows give none.
    """
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast((model.bucket_scores(), float(model.bias[1] - model.bias[0])))
    source = docs.select(F.col(doc_id).alias("__id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("__t"))

    def run(batches):
        table, bias = shipped.value
        for batch in batches:
            scores = []
            for t in batch.column(2).to_pylist():
                f = features(t)
                scores.append(float(1 / (1 + np.exp(-((table[f].mean() if len(f) else 0.0) + bias)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["__id", "held_out", "score"])

    out = source.mapInArrow(run, source.select("__id", "held_out").schema.add("score", "double"))
    return out.select(F.col("__id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    return score(docs, fit(docs, labels, doc_id=doc_id, text=text, label=label), doc_id, text)
