"""The pipeline stage by stage against plain Python, and its registration."""

import hashlib

import public_tokenizers
import tiktoken  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline
from changeguard.llm import bpe, pii
from changeguard.llm.common import stored
from tests.conftest import SMALL
from tests.llm.data import awkward, none
from tests.llm.test_documents import shingle_set


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, tables[-1], SMALL), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        tables.append(out)
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert all(t.count() == len(r) for t, r in zip(tables, rows, strict=True))
    # quality rules: what failed is gone, no line was above the limits here
    judged = {r.doc_id: r for r in entry.queries()["op5_quality_rules"](spark, SMALL).collect()}
    assert rows[1].keys() == {i for i, r in judged.items() if r.kept}
    assert all(rows[1][i].text == rows[0][i].text for i in rows[1])
    # near duplicates: every document that went has a near copy of a smaller id, none that stayed has one linked
    sets = {i: shingle_set(r.text) for i, r in rows[1].items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert all(any(near(i, j) for j in sets if j != i) for i in rows[1].keys() - rows[2].keys())
    assert not any(near(i, j) for i in rows[2] for j in rows[2] if i < j)
    # decontamination: exactly those with an item within their words
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
    assert rows[2].keys() - rows[3].keys() == {i for i, r in rows[2].items() if any(plain(x) in plain(r.text) for x in items)}
    # surrogates: texts without entities are as they were
    for i, r in rows[4].items():
        found = list(pii.entities(rows[3][i].text))
        assert (r.text == rows[3][i].text) == (not found) and r.n_chars == len(r.text)
        assert not any(rows[3][i].text[a:b] in r.text for a, b, kind, _ in found if kind != "name")
    # tokens
    encoding = bpe._encoding(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    for i, r in rows[5].items():
        assert r.token_ids == encoding.encode_ordinary(rows[4][i].text)
        assert r.decoded_sha256 == hashlib.sha256(rows[4][i].text.encode()).hexdigest()
    assert rows[5].keys() == rows[4].keys()


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), none(spark)):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SMALL)
        assert out.count() == (docs.filter("doc_id = 4").count())  # only the long text passes the quality rules


def test_registration():
    queries = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in queries) for n in range(1, 14)) and "pipeline" in queries
    assert set(entry.oracle_sql()) <= set(queries)
