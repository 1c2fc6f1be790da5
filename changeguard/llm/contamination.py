"""Benchmark decontamination: a BM25 inverted index of the test items, asked with every training passage.

The index is cut into blocks of bounded bytes; each is broadcast and asked with all passages, so a benchmark of any
size is searched whole. A passage is asked as in block-max WAND, many passages at a time: posting lists that cannot
reach the threshold together are left out of the search (non-essential), the maxima of the other lists over blocks of
items bound a passage's score, and only blocks whose bound reaches the threshold are scored exactly. Nothing above the
threshold is missed. Retrieved items are verified on shingles of the whole document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from changeguard.llm.common import prepare, row_key, stored
from changeguard.llm.wordhash import SHINGLE, shingle_hashes, word_hashes

#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.6
#: Share of an item's shingles that a document must hold.
OVERLAP = 0.8
#: Share of an item's own score that its non-essential terms may have.
SILENT = 0.3
#: Value of ``parts``: question and answer by their shingles only, which SQL can say too.
SHINGLES = "shingles"
#: Words from which a question alone, without its answer, is a leak.
TELLING = 8
K1, B = 1.2, 0.75
#: Words of an item that are searched as one; passages step by as many and are twice as long.
STEP = 64
ITEMS_PER_BLOCK = 8
#: Bytes of item texts in one broadcast index.
INDEX_BYTES = 4 << 20
_ROWS = 256

#: Words are runs of ASCII letters and digits and of all bytes of other characters.
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SEPARATORS[_a:_b] = False


def answer_start(text: str) -> int:
    """Where the answer of an item begins: its last sentence, or the end if it is one sentence."""
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)|\n", text.rstrip())]
    return ends[-1] if ends else len(text)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.lower().encode() for t in texts], None, SEPARATORS)


@dataclass
class Item:
    item_id: object
    shingles: np.ndarray
    question: int  # so many shingles end before the answer
    size: int  # words of a shingle
    words: np.ndarray
    head: int  # words of the question


@dataclass
class Index:
    """Segments of items (items of up to ``STEP`` words are one) as postings over blocks of segments."""

    items: list[Item]
    owner: np.ndarray  # item of each segment
    terms: np.ndarray  # sorted word hashes
    essential: np.ndarray
    block_at: np.ndarray  # of each term, its range in the two arrays below
    blocks: np.ndarray
    block_max: np.ndarray
    silent: np.ndarray  # of each block, the largest share of non-essential terms
    segment_terms: list[np.ndarray]
    segment_weights: list[np.ndarray]


@dataclass
class Spread:
    """What the weights need of all items: segments that hold each term (sorted), segments, their mean length."""

    terms: np.ndarray
    counts: np.ndarray
    segments: int
    mean: float


def _segments(words: np.ndarray) -> list[np.ndarray]:
    return [words[begin : begin + STEP] for begin in range(0, len(words), STEP)]


def build_index(rows: list[tuple[object, str]], parts: bool = False, weighed: Spread | None = None) -> Index:
    """The index of some items, weighed by the ``Spread`` of all items (None: these are all).

    With ``parts`` questions are segments of their own beside those of the whole items.
    """
    items, owner, segments, whole = [], [], [], []
    for item_id, text in rows:
        words, at = _words([text])
        if not len(words):
            continue
        n = int(at[1])
        size = min(SHINGLE, n)
        shingles, _ = shingle_hashes(words, at, size)
        head = int(_words([text[: answer_start(text)]])[1][1])
        items.append(Item(item_id, shingles, max(0, min(len(shingles), head - size + 1)), size, words, head))
        for part, is_whole in ((words, True), *([(words[:head], False)] if parts and head < n else [])):
            for segment in _segments(part):
                owner.append(len(items) - 1)
                segments.append(segment)
                whole.append(is_whole)
    if not segments:
        empty = np.zeros(0)
        return Index([], empty.astype(int), empty.astype(np.uint64), empty.astype(bool), np.zeros(1, int), empty.astype(int), empty, empty, [], [])
    counted = [np.unique(s, return_counts=True) for s in segments]
    terms, spread = np.unique(np.concatenate([t for t, _ in counted]), return_counts=True)
    if weighed is None:
        own = [s for s, w in zip(segments, whole, strict=True) if w]
        weighed = Spread(*np.unique(np.concatenate([np.unique(s) for s in own]), return_counts=True), len(own), np.mean([len(s) for s in own]))
    held = weighed.counts[np.searchsorted(weighed.terms, terms)]
    idf = np.log1p((weighed.segments - held + 0.5) / (held + 0.5))
    mean = weighed.mean
    ids, weights = [], []
    for (t, tf), s in zip(counted, segments, strict=True):
        i = np.searchsorted(terms, t)
        w = idf[i] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / mean))
        ids.append(i)
        weights.append(w / w.sum())
    # Non-essential: the most widespread terms, as long as no segment owes them more than SILENT.
    quiet, owed = np.zeros(len(terms), dtype=bool), np.zeros(len(segments))
    holders = [[] for _ in terms]
    for n, (i, w) in enumerate(zip(ids, weights, strict=True)):
        for k, x in zip(i, w, strict=True):
            holders[k].append((n, x))
    for k in np.argsort(-spread, kind="stable"):
        n = np.array([h[0] for h in holders[k]])
        x = np.array([h[1] for h in holders[k]])
        if (owed[n] + x <= SILENT).all():
            quiet[k] = True
            owed[n] += x
    n_blocks = -(-len(segments) // ITEMS_PER_BLOCK)
    at, blocks, maxima = [0], [], []
    for k in range(len(terms)):
        best: dict[int, float] = {}
        for n, x in holders[k]:
            best[n // ITEMS_PER_BLOCK] = max(best.get(n // ITEMS_PER_BLOCK, 0.0), x)
        blocks += best.keys()
        maxima += best.values()
        at.append(len(blocks))
    silent = np.array([owed[b * ITEMS_PER_BLOCK : (b + 1) * ITEMS_PER_BLOCK].max() for b in range(n_blocks)])
    return Index(items, np.array(owner), terms, ~quiet, np.array(at), np.array(blocks), np.array(maxima), silent, ids, weights)


def retrieve(index: Index, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
    """(text, item, best score) of every item that a passage of a text reaches with ``THRESHOLD`` or more."""
    if not len(index.terms) or not len(words):
        return []
    found = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[found] == words
    n_passages = np.maximum(1, -(-np.diff(offsets) // STEP))
    first = np.concatenate(([0], np.cumsum(n_passages)))
    at = np.flatnonzero(known & index.essential[found])
    text = np.searchsorted(offsets, at, side="right") - 1
    step = (at - offsets[text]) // STEP
    term = found[at]
    # a word is in the passage that starts at its step and, but for the first step, in the one before
    passage = np.concatenate((first[text] + step, (first[text] + step - 1)[step > 0]))
    term = np.concatenate((term, term[step > 0]))
    many = index.block_at[term + 1] - index.block_at[term]
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.block_at[term], many)
    n_blocks = len(index.silent)
    key = np.repeat(passage, many) * n_blocks + index.blocks[place]
    cells, inverse = np.unique(key, return_inverse=True) if n_blocks * first[-1] > 1 << 24 else (None, key)
    bound = np.bincount(inverse, weights=index.block_max[place], minlength=0 if cells is not None else n_blocks * int(first[-1]))
    block_of = (np.arange(len(bound)) if cells is None else cells) % n_blocks
    alive = np.flatnonzero(bound + index.silent[block_of] >= THRESHOLD - 1e-9)
    best: dict[tuple[int, int], float] = {}
    for cell in (alive if cells is None else cells[alive]).tolist():
        p, block = divmod(cell, n_blocks)
        t = int(np.searchsorted(first, p, side="right") - 1)
        begin = offsets[t] + (p - first[t]) * STEP
        inside = slice(begin, min(begin + 2 * STEP, offsets[t + 1]))
        held = np.zeros(len(index.terms), dtype=bool)
        held[found[inside][known[inside]]] = True
        for segment in range(block * ITEMS_PER_BLOCK, min((block + 1) * ITEMS_PER_BLOCK, len(index.owner))):
            score = float(index.segment_weights[segment][held[index.segment_terms[segment]]].sum())
            if score >= THRESHOLD - 1e-9:
                pair = (t, int(index.owner[segment]))
                best[pair] = max(best.get(pair, 0.0), score)
    return [(*k, v) for k, v in sorted(best.items())]


def _in_order(part: np.ndarray, own: np.ndarray) -> bool:
    """Whether a place of a document has the part's words in order, but for a share of 1 - ``OVERLAP`` of edits."""
    place = np.arange(len(own) + 1)
    row = np.zeros(len(own) + 1, dtype=np.int64)  # edits from the words so far to what ends at each place
    for n, word in enumerate(part, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (own != word))
        new[0] = n
        row = np.minimum.accumulate(new - place) + place
    return bool(row.min() <= (1 - OVERLAP) * len(part) + 1e-9)


def _holds(part: np.ndarray, own: np.ndarray, edits: bool) -> bool:
    """Whether a document holds a question or an answer: by its own shingles or, with ``edits``, up to ``STEP`` words in order."""
    size = min(SHINGLE, len(part))
    if len(own) < size:
        return False
    there = np.isin(shingle_hashes(part, np.array([0, len(part)]), size)[0], shingle_hashes(own, np.array([0, len(own)]), size)[0])
    return bool(there.sum() >= OVERLAP * len(there) - 1e-9) or (edits and len(part) <= STEP and _in_order(part, own))


def _holds_parts(item: Item, own: np.ndarray, edits: bool) -> bool:
    """Question and answer, each by its own limit; the question alone if it is long enough to be no chance."""
    question, answer = item.words[: item.head], item.words[item.head :]
    return len(question) > 0 and _holds(question, own, edits) and (len(question) >= TELLING or (len(answer) > 0 and _holds(answer, own, edits)))


def _search(shipped, parts: bool | str, id_type: pa.DataType):
    def run(batches):
        index = shipped.value
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for begin in range(0, len(bodies), _ROWS):
                words, offsets = _words([x or "" for x in bodies[begin : begin + _ROWS]])
                held: dict[tuple[int, int], np.ndarray] = {}
                for t, i, score in retrieve(index, words, offsets):
                    item = index.items[i]
                    own = words[offsets[t] : offsets[t + 1]]
                    if (t, item.size) not in held:
                        held[t, item.size] = shingle_hashes(own, np.array([0, len(own)]), item.size)[0]
                    there = np.isin(item.shingles, held[t, item.size])
                    if there.sum() >= OVERLAP * len(there) - 1e-9 or (parts and _holds_parts(item, own, parts != SHINGLES)):
                        out.append((ids[begin + t], item.item_id, score, int(there[: item.question].sum()), item.question,
                                    int(there[item.question :].sum()), len(there) - item.question))
            kinds = (batch.schema.field(0).type, id_type, pa.float64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=_NAMES)

    return run


_NAMES = ["__id", "item_id", "score", "question_shared", "question_shingles", "answer_shared", "answer_shingles"]


def _spread_of(batches):
    for batch in batches:
        found = [(int(t), 1, len(s)) if n == 0 else (int(t), 1, 0)
                 for x in batch.column(0).to_pylist() for s in _segments(_words([x])[0]) for n, t in enumerate(np.unique(s).view(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["term", "n", "size"])


def _spread(items: DataFrame) -> tuple[DataFrame, int, float]:
    """(segments that hold each term; segments; their mean length) over all items."""
    posts = stored(items.select("text").mapInArrow(_spread_of, "term long, n long, size long"), "item-terms")
    total = posts.filter("size > 0").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    return stored(posts.groupBy("term").agg(F.sum("n").alias("n")), "item-spread"), total["n"], total["mean"] or 0.0


def _spread_for(own: DataFrame, spread: tuple[DataFrame, int, float]) -> Spread:
    """The spread of the terms of one block."""
    terms = own.select("text").mapInArrow(_spread_of, "term long, n long, size long").select("term").distinct()
    rows = spread[0].join(terms, "term", "left_semi").collect()
    hashes = np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Spread(hashes[order], np.array([r["n"] for r in rows], dtype=np.int64)[order], *spread[1:])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: bool | str = False) -> DataFrame:
    """(id, item_id) of every document that holds a test item, with the shingles of question and answer that it holds.

    A document holds an item if at least ``OVERLAP`` of the item's shingles, question and answer together, are in it;
    an item of fewer than five words is one shingle. With ``parts`` it also holds an item if it holds question and answer
    each by its own limit, wherever they are, or a question of ``TELLING`` words or more alone; a part is held by
    its own shingles or, unless ``parts`` is ``SHINGLES``, by its words in order. Ids of items are of any type. ``score`` is the best passage's share of the item's own BM25
    score. NULL texts and items without words hold and match nothing; repeated documents give repeated rows, repeated
    items one row each; empty tables give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__body"))
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    item_type = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // INDEX_BYTES))
    schema = source.select("__id").schema
    for name, kind in zip(_NAMES[1:], (item_type, *map(T._parse_datatype_string, ("double", *["integer"] * 4))), strict=True):
        schema = schema.add(name, kind)
    spread = _spread(items) if blocks > 1 else None
    found = []
    for n in range(blocks):  # each block holds about INDEX_BYTES of items, whatever the size of the benchmark
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if blocks > 1 else items
        index = build_index(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])),
                            parts, _spread_for(own, spread) if spread else None)
        found.append(source.mapInArrow(_search(spark.sparkContext.broadcast(index), parts, to_arrow_type(item_type)), schema))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.col("__id").alias(doc_id), *_NAMES[1:])


def without_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: bool = False) -> DataFrame:
    """The columns and rows of ``docs`` that hold no test item."""
    keyed = docs.withColumn("__key", row_key(doc_id, text))
    found = stored(contaminated(keyed.select("__key", F.col(text).alias("__text")), benchmark, "__key", "__text", parts).select("__key").distinct(), "contaminated")
    return keyed.join(found, "__key", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
