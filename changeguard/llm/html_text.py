"""The main text of web pages by wrapper induction over the pages of each host.

1. Every page is parsed to its block tree and reduced to an outline (labels and text digests, about half a kilobyte).
   Pages of a host with the same longest text are copies and have one vote.
2. One outline of each host is its reference. All pages of the host are aligned with it by simple tree matching and
   vote on each of its nodes: same text or other text. Nodes with the same text on nearly all pages are template, the
   varying ones slots. Nodes that the reference lacks, of another layout or left out on it, are voted on by their path.
3. Every page is aligned again; template nodes go, and so do slots around the article. A menu or an advert also varies
   from page to page, so slots are told apart by element, class, id and role, and by their links where a page names
   no article. What is left are the blocks of the article.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import prepare, stored
from changeguard.llm.dom import Node, align, leaves, outline, parse

#: A node is template if two different pages or more of the host have it, this share of them with the same text.
SAME = 0.8
#: Wrappers up to this many bytes of outlines are broadcast, more are joined to the pages of their hosts.
BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://([^/?#]*)", 1))


def _tuple(x):
    return (x[0], x[1], tuple(_tuple(c) for c in x[2]))


@lru_cache(maxsize=512)
def _read(text: str):
    return _tuple(json.loads(text))


def _digests(tree) -> list[str]:
    out = [tree[1]]
    for child in tree[2]:
        out += _digests(child)
    return out


def _paths(tree, above: int = 0) -> list[int]:
    """By node: a digest of the labels from the root to it."""
    out = [xxhash.xxh3_64_intdigest(f"{above} {tree[0]}") >> 1]
    for child in tree[2]:
        out += _paths(child, out[0])
    return out


def _longest(digests: list[str]) -> str:
    """The digest of a page's longest text, by which copies of an article are known."""
    return max((d for d in digests if d), key=lambda d: (int(d.split(".")[0]), d), default="")


def votes(reference, page) -> tuple[list[tuple[int, bool]], set[tuple[int, str]]]:
    """((reference node, same text) of each aligned node with text, (path, text digest) of the nodes that it lacks); none for a copy of the reference."""
    own, other = _digests(reference), _digests(page)
    if _longest(own) == _longest(other):
        return [], set()
    pairs = align(reference, page)
    rest = set(range(len(other))) - {m for _, m in pairs}
    paths = _paths(page) if rest else []
    return [(n, own[n] == other[m]) for n, m in pairs if own[n] and other[m]], {(paths[m], other[m]) for m in rest if other[m]}


def main_text(page: str, reference=None, template: frozenset[int] = frozenset(), lacking: frozenset[tuple[int, str]] = frozenset()) -> str:
    """The article's blocks, one line each. ``template`` names the reference's nodes that belong to the template, ``lacking`` the
    nodes of the template that the reference has not got, by path and digest."""
    root, order = parse(page), []
    tree = outline(root, order)
    gone = set()
    if reference is not None and (template or lacking):
        own, other, pairs = _digests(reference), _digests(tree), align(reference, tree)
        gone = {id(node) for n, m in pairs if n in template and own[n] == other[m] for node in order[m]}
        if lacking:
            paths = _paths(tree)
            gone |= {id(node) for m in set(range(len(other))) - {m for _, m in pairs} if (paths[m], other[m]) in lacking for node in order[m]}
    bodies: list[Node] = []

    def articles(node: Node) -> None:
        for child in node.children:
            if child.around:
                continue
            if child.tag in ("article", "main"):
                bodies.append(child)
            else:
                articles(child)

    articles(root)
    out: list[str] = []

    def content(node: Node, named: bool) -> None:
        if node.around or id(node) in gone:
            return
        if node.tag == "#":
            if named or node.links * 2 < len(node.text):
                out.append(node.text)
        for child in node.children:
            content(child, named)

    for body in bodies or [root]:
        content(body, bool(bodies))
    return "\n".join(out)


def _outlines(batches):
    for batch in batches:
        hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        trees = [outline(parse(p)) for p in pages]
        texts = [json.dumps(t, separators=(",", ":"), ensure_ascii=False) for t in trees]
        order = [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array([_longest(_digests(t)) for t in trees], pa.string()), pa.array(order, pa.int64()), pa.array(texts, pa.string())],
            names=["host", "longest", "order", "outline"])


_VOTES = "host string, node int, path bigint, digest string, seen bigint, same bigint"


def _vote(batches):
    """Votes of pages, added up by batch: on reference nodes, on paths that the reference lacks (no digest) and on texts there."""
    for batch in batches:
        seen, same = Counter(), Counter()
        for host, text, reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            on_nodes, lacked = votes(_read(reference), _tuple(json.loads(text)))
            for node, equal in on_nodes:
                seen[host, node, None, None] += 1
                same[host, node, None, None] += equal
            seen.update((host, None, path, None) for path in {path for path, _ in lacked})
            seen.update((host, None, path, digest) for path, digest in lacked)
        keys = list(seen)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)),
             pa.array([seen[k] for k in keys], pa.int64()), pa.array([same[k] for k in keys], pa.int64())], names=["host", "node", "path", "digest", "seen", "same"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, template, lacking) of every host that has template nodes; ``pages`` has host and html."""
    read = pages.filter("html is not null").mapInArrow(_outlines, "host string, longest string, order bigint, outline string")
    first = F.struct("order", "outline")
    outlines = stored(read.groupBy("host", "longest").agg(F.min("order").alias("order"), F.min_by("outline", first).alias("outline")), "outlines")
    references = stored(outlines.groupBy("host").agg(F.min_by("outline", first).alias("reference")), "references")
    asked = outlines.join(references, "host").select("host", "outline", "reference")
    by = ["host", "node", "path", "digest"]
    counted = stored(asked.mapInArrow(_vote, _VOTES).groupBy(*by).agg(F.sum("seen").alias("seen"), F.sum("same").alias("same")), "votes")
    # The reference itself has the node as well, so one vote is two pages; on what it lacks two pages must vote.
    template = counted.filter(F.col("node").isNotNull() & (F.col("same") >= SAME * F.col("seen"))).groupBy("host").agg(F.collect_list("node").alias("template"))
    paths = counted.filter("path is not null and digest is null and seen > 1").select("host", "path", F.col("seen").alias("pages"))
    texts = counted.filter("digest is not null and seen > 1").join(paths, ["host", "path"]).filter(F.col("seen") >= SAME * F.col("pages"))
    lacking = texts.groupBy("host").agg(F.collect_list(F.struct("path", "digest")).alias("lacking"))
    return references.join(template.join(lacking, "host", "full"), "host")


def _wrapper(reference, template, lacking):
    """A wrapper as ``main_text`` takes it; lists that are not there are empty."""
    return reference, frozenset(template or ()), frozenset((x["path"], x["digest"]) for x in lacking or ())


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: the id, the url, ``text`` (blocks joined by line feeds), ``n_chars``.

    A NULL or empty page has the empty text. Pages without a host share one. A host with one page, or with copies
    of one, has no template; its pages are read by their elements alone. Repeated rows give repeated rows, no rows none.
    """
    spark = df.sparkSession
    prepare(spark)
    source = df.select(F.col(page_id).alias("__id"), F.col(url).alias("__url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    known = stored(wrappers(source.select("host", "html")), "wrappers")
    lists = 4 * F.coalesce(F.size("template"), F.lit(0)) + 64 * F.coalesce(F.size("lacking"), F.lit(0))
    size = known.agg(F.sum(F.octet_length("reference") + F.octet_length("host") + lists)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shipped = spark.sparkContext.broadcast({r["host"]: _wrapper(r["reference"], r["template"], r["lacking"]) for r in known.collect()})
        rows = source
    else:
        shipped, rows = None, source.join(known, "host", "left").select("__id", "__url", "host", "html", "reference", "template", "lacking")

    def run(batches):
        for batch in batches:
            hosts, bodies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if shipped is None:
                held = [_wrapper(*w) for w in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True)]
            else:
                held = [shipped.value.get(h, (None, frozenset(), frozenset())) for h in hosts]
            texts = [main_text(b, r and _read(r), t, k) if b else "" for b, (r, t, k) in zip(bodies, held, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    out = rows.mapInArrow(run, source.select("__id", "__url").schema.add("text", "string").add("n_chars", "long"))
    return out.select(F.col("__id").alias(page_id), F.col("__url").alias(url), "text", "n_chars")
