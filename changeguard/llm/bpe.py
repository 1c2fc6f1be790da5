"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.llm.common import prepare

#: Characters of a text that go to the tokenizer at once.
CHUNK = 1 << 16


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of a text that can be encoded one by one with the result of the whole.

    A match of the pattern holds white space only alone or as its first character, so one always ends
    between a character that is no white space and white space. The part before such a boundary ends with
    no white space, hence no look-ahead changes; the part after it is matched from its start either way.
    Only a space, a tab or a line feed is taken as the white space after a boundary: the pattern and Python
    agree on those. A text without such a boundary stays whole.
    """
    def boundary(i: int) -> bool:
        return text[i] in " \t\n" and not text[i - 1].isspace()

    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut > at and not boundary(cut):
            cut -= 1
        if cut == at:
            cut = at + size
            while cut < len(text) and not boundary(cut):
                cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def encode_text(encoding, text: str) -> list[int]:
    return [i for part in safe_chunks(text) for i in encoding.encode_ordinary(part)]


def _rank_file(spark, rank_path: str):
    with open(rank_path, "rb") as f:  # read once, on the driver; a rank file has a fixed size of a few MB
        return spark.sparkContext.broadcast(f.read())


def encode_decode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """All columns of ``df`` beside ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``token_ids`` if asked for).

    The ids are decoded again as raw bytes, so nothing is lost where a token is no whole character. A NULL text
    counts as empty: no ids and the digests of nothing. An existing column of one of these names is replaced.
    """
    prepare(df.sparkSession)
    ranks = _rank_file(df.sparkSession, rank_path)
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]
    kept = [c for c in df.columns if c.lower() not in new]
    body = "__bpe_text"
    # Only the text goes through Python; the other columns come along unchanged.
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text), F.lit("")).alias(body))

    def run(batches):
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            counts, id_digests, text_digests, all_ids = [], [], [], []
            for t in batch.column(batch.schema.get_field_index(body)).to_pylist():
                found = encode_text(encoding, t)
                counts.append(len(found))
                id_digests.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(encoding.decode_bytes(found)).hexdigest())
                if ids:
                    all_ids.append(found)
            columns = [batch.column(i) for i in range(len(kept))] + [
                pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    schema = source.drop(body).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of its token ids in ``out``; NULL ids give NULL."""
    prepare(df.sparkSession)
    ranks = _rank_file(df.sparkSession, rank_path)
    names = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches):
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            found = [None if x is None else encoding.decode_bytes(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(found, pa.binary())], names=[*names, out])

    return df.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, df.select(*(F.col(f"`{c}`") for c in names)).schema.add(out, "binary"))
