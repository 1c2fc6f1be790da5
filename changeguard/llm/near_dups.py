"""MinHash near-duplicates by an inverted join over signature coordinates, confirmed on whole shingle sets.

1. Every text becomes its set of 5-word shingles; equal sets are one class, so exact copies are never paired.
2. A class is posted under each (coordinate, value) of its signature. Two classes with at least ``m`` equal
   coordinates (``matches_for``) share one within their rarest ``COORDINATES - m + 1`` (prefix), and values that nobody else
   has need no posting (skip), so frequent values of shared passages drop out.
3. In each posting list all members are compared with one hub, the least altered one, never all with all. The
   comparison keeps the differences from the hub. Two members of which at least one is no neighbour of the hub
   can only be similar if they share differences, and by an exactly known number; a second inverted join, over the
   differences and with its own prefix, finds these pairs. Only components are asked for, so it goes by stars as well:
   in each list of a difference one member is compared with those of other components, twice, and only what is left
   in other components then is compared in pairs. A large group of near copies so costs about as many comparisons
   as it has members, whether they are near the hub or only near each other, and no component is cut.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.llm.common import join_hint, prepare, row_key, stored
from changeguard.llm.components import components, joined
from changeguard.llm.wordhash import mixed, shingle_hashes, word_hashes

COORDINATES = 32
#: Percent that two sets share of their union, by the contract of op6.
SIMILARITY = 85
#: Chance with which a pair of just this similarity may have too few equal coordinates to be found.
MISSED = 1e-5

_RNG = np.random.default_rng(811)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MARKS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64))
#: Documents hashed at once, so that the signature work stays in the processor's cache.
_ROWS = 256
#: Larger Arrow batches only take memory, in the worker and in the executor that fills them.
_BATCH_BYTES = str(4 << 20)


def matches_for(similarity: int) -> int:
    """Equal coordinates to ask for, as many as a pair of this similarity lacks with a chance below ``MISSED``.

    That is 17 of 32 at 85 % (chance 3.5e-6) and 15 at 80 % (6.6e-6).
    """
    p, chance, m = similarity / 100, 0.0, 0
    while (chance := chance + comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) < MISSED:
        m += 1
    return m


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(_signed(flat)))


def _sets(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted shingle set of each text, and all sets' signatures (rows of texts without words are zero)."""
    words, offsets = word_hashes(texts)
    shingles, at = shingle_hashes(words, offsets)
    found = [np.unique(shingles[at[i] : at[i + 1]]) for i in range(len(texts))]
    filled = np.flatnonzero(np.diff(at))
    signature = np.zeros((len(texts), COORDINATES), dtype=np.uint64)
    if len(filled):
        for j, factor in enumerate(_FACTORS):
            # The coordinate is part of the value, so one number names a posting list.
            signature[filled, j] = np.minimum.reduceat(shingles * factor, at[filled]) ^ _MARKS[j]
    return found, signature


def _profile(batches):
    for batch in batches:
        texts = [x or b"" for x in batch.column(2).to_pylist()]
        for begin in range(0, len(texts), _ROWS):
            found, signature = _sets(texts[begin : begin + _ROWS])
            sizes = np.array([len(s) for s in found], dtype=np.int64)
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            offsets = np.arange(len(found) + 1) * COORDINATES
            part = batch.slice(begin, len(found))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes), pa.array(names, pa.binary()), _lists(signature.ravel(), offsets)],
                names=["__key", "__id", "n_shingles", "__class", "__tokens"])


def _whole_sets(batches):
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        for begin in range(0, len(texts), _ROWS):
            found, _ = _sets(texts[begin : begin + _ROWS])
            part = batch.slice(begin, len(found))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists(np.concatenate(found), np.concatenate(([0], np.cumsum([len(s) for s in found]))))], names=["node", "members"])


def _postings(classes: DataFrame, similarity: int) -> DataFrame:
    """(node, token, shared): the prefix postings of every class; ``shared`` counts its values that others have."""
    posts = classes.select("node", F.explode("tokens").alias("token"))
    common = posts.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    own = W.partitionBy("node")
    ranked = posts.join(common.hint("merge"), "token").select(
        "node", "token", F.row_number().over(own.orderBy("n", "token")).alias("place"), F.count("*").over(own).alias("shared"))
    # The rarest COORDINATES - m + 1 are the unshared values first, then these.
    return ranked.filter(F.col("place") <= F.col("shared") - matches_for(similarity) + 1).select("node", "token", "shared")


def _compared(docs: DataFrame, classes: DataFrame, posts: DataFrame, repeated: bool) -> DataFrame:
    """(hub, node, h, s, missing, d, diff): every member of a posting list against the list's hub.

    ``repeated`` tells that rows repeat id and text; only one of them gives its class its set.
    """
    lists = posts.groupBy("token").agg(F.min(F.struct((-F.col("shared")).alias("s"), "node")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    lists = stored(lists.select("token", F.col("hub.node").alias("hub")), "hubs")  # written, so that the join can split a hot list
    stars = posts.join(lists.hint(join_hint(lists)), "token").filter("node != hub").select("hub", "node").distinct()
    stars = stored(stars, "stars")
    how = join_hint(stars)
    wanted = stars.select("node").union(stars.select(F.col("hub").alias("node"))).distinct()
    texts = classes.select("node", F.col("key").alias("__key")).join(wanted.hint(how), "node").join(docs, "__key").select("node", "__body")
    sets = texts.mapInArrow(_whole_sets, "node long, members array<bigint>")
    sets = stored(sets.dropDuplicates(["node"]) if repeated else sets, "sets")
    hubs = sets.select(F.col("node").alias("hub"), F.col("members").alias("hub_members"))
    both = stars.hint(how).join(sets, "node").join(hubs, "hub").select(
        "hub", "node", F.size("hub_members").cast("long").alias("h"), F.size("members").cast("long").alias("s"),
        F.array_except("hub_members", "members").alias("gone"), F.array_except("members", "hub_members").alias("new"))
    out = both.select("hub", "node", "h", "s", F.size("gone").cast("long").alias("missing"), F.concat("gone", "new").alias("diff"))
    return stored(out.withColumn("d", F.size("diff").cast("long")), "compared")


def _is_link(common, sizes, similarity):
    return (100 + similarity) * common >= similarity * sizes


def _differences(compared: DataFrame, similarity: int) -> DataFrame:
    """(hub, item, node, h, w, d, linked, place, alone): the differences from the hub that members share, with their place by rarity.

    With h the hub's size, s a member's, m what it lacks of the hub, and v the shared differences of two members,
    their intersection is h - m1 - m2 + v. So similarity asks for v >= (w1 + w2 - (100 + S) h) / (100 + S) with
    w = S s + (100 + S) m. Members similar to the hub need no pair among themselves. ``alone`` counts the differences
    that a member shares with nobody.

    The smallest w that a partner may have tells how many differences a member shares at least with any partner;
    items too far behind for that (``last``) are left out, with members and lists that have no such items.
    """
    whole = 100 + similarity
    weighed = compared.withColumn("w", similarity * F.col("s") + whole * F.col("missing")).withColumn(
        "linked", _is_link(F.col("h") - F.col("missing"), F.col("h") + F.col("s"), similarity))
    least = weighed.groupBy("hub").agg(F.count("*").alias("n"), F.min("w").alias("any"), F.min(F.when(~F.col("linked"), F.col("w"))).alias("free"))
    least = stored(least.filter("n > 1 and free is not null").drop("n"), "least")  # written, so that the join can split a hot list
    partner = F.when(F.col("linked"), F.col("free")).otherwise(F.col("any"))
    able = weighed.join(least, "hub").withColumn("last", F.col("d") - F.ceil((F.col("w") + partner - whole * F.col("h")) / F.lit(whole))).filter("last >= 0")
    items = able.select("hub", "node", "h", "w", "d", "linked", "last", F.explode("diff").alias("item"))
    common = items.groupBy("hub", "item").agg(F.count("*").alias("n"), F.bool_and("linked").alias("quiet")).filter("n > 1 and not quiet")
    own = W.partitionBy("hub", "node")
    return items.join(common.hint("merge"), ["hub", "item"]).withColumn("place", F.row_number().over(own.orderBy("n", "item"))).withColumn(
        "alone", F.col("d") - F.count("*").over(own)).withColumn("place", F.col("alone") + F.col("place") - 1).filter("place <= last").drop("n", "quiet", "last")


def _verified(pairs: DataFrame, compared: DataFrame, similarity: int) -> DataFrame:
    """(a, b): the similar ones among pairs (hub, node1, node2) of members, by their differences from the hub."""
    side = lambda n: compared.select("hub", "h", F.col("node").alias(f"node{n}"), F.col("s").alias(f"s{n}"), F.col("missing").alias(f"m{n}"), F.col("diff").alias(f"diff{n}"))
    sized = pairs.hint(join_hint(pairs)).join(side(1), ["hub", "node1"]).join(side(2).drop("h"), ["hub", "node2"])
    common_members = F.col("h") - F.col("m1") - F.col("m2") + F.size(F.array_intersect("diff1", "diff2"))
    return sized.filter(_is_link(common_members, F.col("s1") + F.col("s2"), similarity)).select(F.col("node1").alias("a"), F.col("node2").alias("b"))


#: Rounds of stars over the lists of shared differences, before pairs.
STARS = 2


def _past_hub(compared: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """(node, label) with the components joined that similar members of a list connect, where one of them is not similar to the hub.

    ``labels`` has the components of the links to hubs. In each round a list's star is the least altered of those that
    miss the hub, later of those outside the list's largest component. The last round takes all pairs of which
    one is outside it; members of one component are never paired.
    """
    whole = 100 + similarity
    posted = stored(_differences(compared, similarity), "differences")
    fits = (F.ceil((F.col("w1") + F.col("w2") - whole * F.col("h")) / F.lit(whole)) <= F.least(
        "d1", "d2", F.col("d1") - F.col("place1"), F.col("d2") - F.col("place2"))) & ~(F.col("linked1") & F.col("linked2")) & (F.col("label1") != F.col("label2"))
    names = ("node", "w", "d", "place", "linked", "label")
    for turn in range(STARS + 1):
        tagged = stored(posted.join(labels.hint(join_hint(labels)), "node", "left").withColumn("label", F.coalesce("label", "node")), "tagged")
        sizes = tagged.groupBy("hub", "item", "label").agg(F.count("*").alias("n"), F.min(F.struct("linked", "alone", *names[:4])).alias("best"))
        lists = sizes.groupBy("hub", "item").agg(
            F.count("*").alias("labels"), F.bool_and("best.linked").alias("quiet"), F.max(F.struct("n", "label")).alias("major"),
            F.min(F.struct("best.*", "label")).alias("one")).filter("labels > 1 and not quiet")
        if turn:  # the best outside the largest component
            outside = sizes.join(lists.select("hub", "item", "major").hint("merge"), ["hub", "item"]).filter("label != major.label")
            lists = outside.groupBy("hub", "item").agg(F.any_value("major").alias("major"), F.min(F.struct("best.*", "label")).alias("one"))
        lists = stored(lists.select("hub", "item", F.col("major.label").alias("major"), *(F.col(f"one.{c}").alias(c + "1") for c in names)), "mixed")
        if lists.isEmpty():
            break
        lists = lists.hint(join_hint(lists))
        two = tagged.select("hub", "item", "h", *(F.col(c).alias(c + "2") for c in names))
        if turn < STARS:
            met = two.join(lists.drop("major"), ["hub", "item"]).filter(fits)
        else:
            one = tagged.join(lists.select("hub", "item", "major"), ["hub", "item"]).filter("label != major").select("hub", "item", "major", *(F.col(c).alias(c + "1") for c in names))
            one = stored(one, "outside")
            met = one.hint(join_hint(one)).join(two, ["hub", "item"]).filter(fits & ((F.col("label2") == F.col("major")) | (F.col("node1") < F.col("node2"))))
        pairs = stored(met.select("hub", "node1", "node2").distinct(), "past-hub")
        labels = joined(labels, _verified(pairs, compared, similarity))
    return labels


def _repeated(profiles: DataFrame) -> DataFrame:
    """Keys of rows with words that repeat id and text."""
    return profiles.filter("__class is not null").groupBy("__key").count().filter("count > 1").select("__key")


def _grouped(df: DataFrame, doc_id: str, text: str, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(documents with __key, __id, n_shingles, __class; classes with __class, label, best)."""
    prepare(df.sparkSession, _BATCH_BYTES)
    source = df.select(row_key(doc_id, text).alias("__key"), F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__body"))
    profiles = stored(source.mapInArrow(
        _profile, source.select("__key", "__id").schema.add("n_shingles", "long").add("__class", "binary").add("__tokens", T.ArrayType(T.LongType()))), "profiles")
    classes = profiles.filter("__class is not null").groupBy("__class").agg(
        F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))).alias("best"),
        F.any_value("__tokens").alias("tokens")).select(F.monotonically_increasing_id().alias("node"), "__class", "best", F.col("best.key").alias("key"), "tokens")
    classes = stored(classes, "classes")
    compared = _compared(source.select("__key", "__body"), classes, stored(_postings(classes, similarity), "postings"), not _repeated(profiles).isEmpty())
    near = compared.filter(_is_link(F.col("h") - F.col("missing"), F.col("h") + F.col("s"), similarity))
    labels = _past_hub(compared, components(near.select(F.col("hub").alias("a"), F.col("node").alias("b"))), similarity)
    grouped = classes.select("node", "__class", "best").join(labels.hint(join_hint(labels)), "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = grouped.groupBy("label").agg(F.min("best").alias("__best"))
    return profiles.drop("__tokens"), grouped.select("__class", "label").join(best, "label")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: the id, ``n_shingles``, ``component_id`` (smallest id it reaches) and ``kept``.

    Texts without words are NULL, empty or white space; they have no shingle, are linked with nothing and kept. Rows
    that repeat are in one component, each of them kept if its id is the smallest. A NULL id is larger than any; a
    component of NULL ids only has a NULL component_id and is kept. No rows give no rows.
    """
    profiles, groups = _grouped(df, doc_id, text, similarity)
    out = profiles.join(groups.select("__class", F.col("__best.id").alias("__component"), F.lit(True).alias("__in")), "__class", "left")
    component = F.when(F.col("__in"), F.col("__component")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(doc_id), "n_shingles", component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The columns of ``df``: one row of each component, that of the smallest id. Texts without words all stay."""
    profiles, groups = _grouped(df, doc_id, text, similarity)
    chosen = profiles.filter("__class is null").select("__key").union(groups.select(F.col("__best.key").alias("__key")).distinct())
    copies = _repeated(profiles)
    kept = df.withColumn("__key", row_key(doc_id, text)).join(chosen.distinct(), "__key", "left_semi")
    if not copies.isEmpty():  # rows that repeat id and text: one of them stays
        copies = stored(copies, "copies")
        kept = kept.join(copies, "__key", "left_anti").unionByName(kept.join(copies, "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select(*(F.col(f"`{c}`") for c in df.columns))
