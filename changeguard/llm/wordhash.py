"""Hashes of words and word shingles of many texts at once, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, so a word never
needs decoding. A text is hashed in pieces cut at white space, so the working
memory is a few times ``PIECE`` however long the text is (a single longer word
is taken whole).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
SHINGLE = 5

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE_BYTES = b" \t\n\x0b\x0c\r"


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _cut(data: bytes, at: int) -> int:
    """The end of a piece from ``at``: at white space, or where the word ends."""
    end = at + PIECE
    if end >= len(data):
        return len(data)
    found = max(data.rfind(bytes([w]), at, end) for w in WHITE_BYTES)
    if found > at:
        return found
    later = [p for w in WHITE_BYTES if (p := data.find(bytes([w]), end)) >= 0]
    return min(later, default=len(data))


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Joined texts of about ``PIECE`` bytes, with the number of each part's text and its start."""
    parts, owners, size = [], [], 0
    for n, data in enumerate(texts):
        at = 0
        while True:
            end = _cut(data, at)
            part = data if (at, end) == (0, len(data)) else data[at:end]
            parts.append(part)
            owners.append((n, size))
            size += len(part) + 1
            if size >= PIECE:
                yield b"\n".join(parts), owners
                parts, owners, size = [], [], 0
            at = end
            if at >= len(data):
                break
    if parts:
        yield b"\n".join(parts), owners


def word_hashes(texts: list[bytes], fold: np.ndarray | None = LOWER, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets): text i has words ``offsets[i]:offsets[i + 1]``.

    ``fold`` maps bytes before hashing; ``white`` says which bytes separate words.
    """
    found, counts = [], np.zeros(len(texts), dtype=np.int64)
    for data, owners in _pieces(texts):
        raw = np.frombuffer(data, dtype=np.uint8)
        if not len(raw):
            continue
        inside = ~white[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        lengths = ends - starts
        flat = raw[inside]
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(flat)) - np.repeat(first, lengths)
        value = _BYTE[flat if fold is None else fold[flat]] * _powers(int(lengths.max()))[place]
        found.append(mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64)))
        owner = np.array([o for o, _ in owners])
        begin = np.array([b for _, b in owners])
        np.add.at(counts, owner[np.searchsorted(begin, starts, side="right") - 1], 1)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``size``-word shingle, offsets). A text with fewer words has one: all its words."""
    counts = np.diff(offsets)
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(out_counts)))
    n = len(words)
    total = np.zeros(max(n, 1), np.uint64)[:n]
    for k in range(min(size, n)):
        total[: n - k] += words[k:] * _PLACES[k]
    keep = np.zeros(n, dtype=bool)
    long = np.flatnonzero(counts >= size)
    if len(long):
        ends = np.zeros(n + 1, dtype=np.int64)
        np.add.at(ends, offsets[long], 1)
        np.add.at(ends, offsets[long + 1] - size + 1, -1)
        keep = np.cumsum(ends[:n]) > 0
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        at, c = offsets[i], counts[i]
        total[at] = np.sum(words[at : at + c] * _PLACES[:c]) + np.uint64(c)
        keep[at] = True
    return mixed(total[keep] + np.uint64(size)), out
