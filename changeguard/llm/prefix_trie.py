"""Prefix trie of conversations by van Emde Boas recursion over depth.

Sequences of turns are cut at half depth. The halves are named: the content of a half by a digest of its own two halves,
a cut prefix by a digest of the cut before it and the content in between. Equal pieces (same cut above, same content)
are one row with a count from there on, so the upper trie and all lower forests are smaller tables of the same kind and
are cut again, together in one job, until a piece is one turn: then it is a node, and the name above it is its parent.

Totals go back the same way. What a lower forest holds is one sum, grafted on the cut node it hangs from, for all cuts
of a level at once; then the sums are handed from each cut node to the cut nodes above it, level by level.

So a trie of depth d takes about 4 log2(d) jobs over tables that halve or double from one to the next. A conversation is
never gathered in one place, however long, and a prefix that a third of all conversations share is one row from its
first naming on; before that its rows are added up ahead of the shuffle.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import prepare, stored, words_of
from changeguard.operators.ordered import scan

#: Shared turns are taken from the conversation whose id is the last multiple of this.
FAMILY, SHARED = 20, 4
#: Bytes of ids in one row on their way to a digest.
CHUNK = 1 << 20


def _name(*parts: Column | str) -> Column:
    """Digest of binary columns."""
    return F.unhex(F.md5(F.concat(*parts)))


def _root() -> Column:
    """Name of the empty prefix."""
    return F.unhex(F.md5(F.lit(b"root")))


def numbered(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, token): the turns of each conversation, numbered from 1, NULL turns first, ties by role, then by a hash of the text.

    A token names role and text, with the number of the text's words in its last 8 bytes.
    """
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.unhex(F.lpad(F.hex(F.size(words_of(text_)).cast("long")), 16, "0"))
    digest = _name(F.octet_length(role_).cast("string").cast("binary"), F.lit(b":"), role_.cast("binary"), text_.cast("binary"))
    rows = df.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("__turn"), role_.alias("__role"), F.xxhash64(role_, text_).alias("__tie"), F.concat(digest, words).alias("token"))
    return scan(rows, ["conv"], ["__turn", "__role", "__tie"], number="at").select("conv", "at", "token")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations; all conversation ids) of ``numbered`` turns.

    A conversation c starts with the first h turns of conversation c - c % family, h being crc32 of c as text modulo
    ``shared``, and goes on with its own turns after its first h.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    heads = turns.filter((F.col("at") < shared) & (F.col("conv") % family == 0)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("head")).withColumnRenamed("conv", "base")
    plans = stored(convs.join(heads, "base", "left").select(
        "conv", "n", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,token:binary>>")), F.lit(1), F.col("h").cast("int")).alias("head")), "conversations")
    first = plans.select("conv", F.explode("head").alias("x")).select("conv", "x.at", "x.token")
    own = turns.join(plans.filter("n > h").select("conv", "h", F.size("head").alias("g")), "conv").filter("at > h")
    return first.unionByName(own.select("conv", (F.col("at") - F.col("h") + F.col("g")).alias("at"), "token")), plans.select("conv")


def _contents(turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per level the distinct contents (content, left, right, n) of blocks of 2^level turns, and (conv, content) of whole sequences."""
    deepest = turns.agg(F.max("at").alias("m")).first()["m"]
    levels, blocks = max(0, (deepest - 1).bit_length()), turns.select("conv", (F.col("at") - 1).alias("block"), F.col("token").alias("content"), F.lit(1).cast("long").alias("n"))
    made = []
    for level in range(1, levels + 1):
        half = F.shiftright("block", 1)
        side = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.struct("content", "n")))
        pairs = blocks.groupBy("conv", half.alias("block")).agg(side(0).alias("a"), side(1).alias("b"))
        blocks = stored(pairs.select("conv", "block", _name(F.lit(bytes([level])), "a.content", F.coalesce("b.content", F.lit(b""))).alias("content"),
                                     F.col("a.content").alias("left"), F.col("b.content").alias("right"), (F.col("a.n") + F.coalesce("b.n", F.lit(0))).alias("n")), f"blocks-{level}")
        made.append(blocks.groupBy("content").agg(F.any_value("left").alias("left"), F.any_value("right").alias("right"), F.any_value("n").alias("n")))
        blocks = blocks.select("conv", "block", "content", "n")
    return made, blocks.select("conv", "content")


def _pieces(contents: list[DataFrame], wholes: DataFrame) -> list[DataFrame]:
    """Per level from 0 the pieces (above, below, at, content, whole, n_convs, least): the trie cut into blocks of 2^level turns.

    ``above`` and ``below`` name the prefixes before and after the block, ``at`` counts the turns before it. The last
    piece of a sequence keeps the name of the whole sequence; ``below`` counts for full blocks only.
    """
    top = len(contents)
    whole = wholes.groupBy("content").agg(F.count("*").alias("n_convs"), F.min("conv").alias("least"))
    now = stored(whole.select(_root().alias("above"), _name(_root(), "content").alias("below"), F.lit(0).cast("long").alias("at"), "content",
                              F.col("content").alias("whole"), "n_convs", "least"), f"pieces-{top}")
    out = [now]
    for level in range(top, 0, -1):
        half = 1 << (level - 1)
        cut = now.join(contents[level - 1].drop("n"), "content")
        name, alone = _name("above", "left"), F.col("right").isNull()
        left = F.struct("above", name.alias("below"), "at", F.col("left").alias("content"), F.when(alone, F.col("whole")).alias("whole"))
        right = F.struct(name.alias("above"), "below", (F.col("at") + half).alias("at"), F.col("right").alias("content"), "whole")
        halves = cut.select("n_convs", "least", F.explode(F.when(alone, F.array(left)).otherwise(F.array(left, right))).alias("p")).select("p.*", "n_convs", "least")
        # A NULL whole is a group like any other here.
        now = stored(halves.groupBy("above", "content", "whole").agg(
            F.any_value("below").alias("below"), F.any_value("at").alias("at"), F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"))
            .select("above", "below", "at", "content", "whole", "n_convs", "least"), f"pieces-{level - 1}")
        out.append(now)
    return out[::-1]


_SUMS = ("n_leaves", "saved_tokens")


def _summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in _SUMS))


def _grafted(nodes: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """(node, n_leaves, saved_tokens): for each prefix with descendants, the sums over all of them.

    ``edges`` has per level the full blocks (above, below, at). Going up, the nodes that a block of a level holds
    below its upper end are summed from those of its two halves. Going down, the sum of each lower half is
    grafted on the cut it hangs from and handed on to the cuts above.
    """
    held = stored(_summed(nodes.select(F.col("above").alias("node"), F.col("at"), *_SUMS), "node", "at"), "held-0")
    levels = [held]
    for level, edge in enumerate(edges):
        odd = F.col("at").bitwiseAND(1 << level) != 0
        upper = edge.select(F.col("below").alias("node"), "above")
        moved = held.filter(odd).join(upper, "node").select(F.col("above").alias("node"), (F.col("at") - (1 << level)).alias("at"), *_SUMS)
        held = stored(_summed(held.filter(~odd).unionByName(moved), "node", "at"), f"held-{level + 1}")
        levels.append(held)
    extra = None
    for level in range(len(edges) - 1, -1, -1):
        hung = levels[level].filter(F.col("at").bitwiseAND(1 << level) != 0)
        if extra is not None:
            upper = edges[level].select(F.col("below").alias("node"), "above")
            # Only ends of lower halves; the cut above an end of two blocks is the middle between them.
            passed = extra.join(upper, "node").select(F.col("above").alias("node"), (F.col("at") - (1 << level)).alias("at"), *_SUMS).filter("at > 0")
            hung = hung.unionByName(extra).unionByName(passed)
        extra = stored(_summed(hung, "node", "at"), f"grafted-{level}")
    whole = levels[-1].select("node", *_SUMS)  # the root's
    return whole if extra is None else whole.unionByName(extra.select("node", *_SUMS))


def _id_chunks(batches):
    """Runs of ids of one node, in order, as comma-joined texts of bounded size."""
    node, ids, size = None, [], 0

    def chunk():
        return pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for new, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (new != node or size > CHUNK):
                yield chunk()
                ids, size = [], 0
            node = new
            ids.append(conv)
            size += 20
    if ids:
        yield chunk()


def _digests(batches):
    """One digest per node over its chunks, which come one after the other."""
    node, state = None, None
    for batch in batches:
        out = []
        for new, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if new != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = new, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in out], pa.binary()), "ends_sha256": pa.array([d for _, d in out], pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]})


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): ids in ascending order. A hot node's ids are joined in many tasks and hashed as one stream."""
    members = stored(members, "ends")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = members.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_id_chunks, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie over ``sequences`` (conv, at from 1 without gaps, token); ``convs`` has every conv, also those without turns.

    One row per distinct prefix, the empty one included: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. No conversations, no nodes.
    """
    sequences, empty = stored(sequences, "sequences"), F.lit(hashlib.sha256().hexdigest())
    everyone = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    if sequences.isEmpty():
        root = everyone.withColumn("saved_tokens", F.lit(0).cast("long")).withColumn("n_leaves", F.lit(1).cast("long")).withColumn("n_children", F.lit(0).cast("long"))
        nodes = root.select(_root().alias("node"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("depth"), "n_convs", "least", "n_children", "n_leaves", "saved_tokens")
        ends = convs.select(_root().alias("node"), "conv")
    else:
        contents, wholes = _contents(sequences)
        pieces = _pieces(contents, wholes)
        last = pieces[0]
        tails = last.filter("whole is not null").select("whole", F.col("below").alias("node"))
        bare = convs.join(wholes.select("conv"), "conv", "left_anti")
        ends = wholes.join(tails, wholes["content"] == tails["whole"]).select("node", "conv").unionByName(bare.select(_root().alias("node"), "conv"))
        grown = last.groupBy("below").agg(
            F.any_value("above").alias("above"), F.any_value("at").alias("at"), F.any_value("content").alias("content"), F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"))
        children = grown.groupBy("above").agg(F.count("*").alias("n_children"))
        words = F.conv(F.hex(F.substring("content", 17, 8)), 16, 10).cast("long")
        own = stored(grown.join(children.withColumnRenamed("above", "below"), "below", "left").select(
            F.col("below").alias("node"), "above", "at", (F.col("at") + 1).alias("depth"), "n_convs", "least", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * words).alias("saved_tokens")), "nodes")
        # Of the pieces of a level, the full blocks that are followed by a cut or end there: their lower ends are prefixes.
        full = [p.join(contents[k - 1].filter(F.col("n") == 1 << k).select("content"), "content", "left_semi") if k else p for k, p in enumerate(pieces[:-1])]
        edges = [stored(p.select("above", "below", "at").dropDuplicates(["below"]), f"edges-{k}") for k, p in enumerate(full)]
        below = _grafted(own, edges).select("node", *(F.col(c).alias(f"__{c}") for c in _SUMS))
        firsts = children.filter(F.col("above") == _root()).select(F.lit(None).cast("long").alias("least"), F.lit(0).cast("long").alias("n_convs"), "n_children")
        top = everyone.withColumn("n_children", F.lit(0).cast("long")).unionByName(firsts).agg(
            F.min("least").alias("least"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children")).select(
            _root().alias("node"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("depth"), "n_convs", "least", "n_children",
            F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        everything = own.drop("at").unionByName(top)
        nodes = everything.join(below, "node", "left").select(
            *everything.columns[:-2], *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in _SUMS))
    nodes = stored(nodes, "totals")
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("above"), F.col("least").alias("parent_conv_id"))
    return nodes.join(parents, "above", "left").join(_ends(ends), "node", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns (``rebuilt``), one row per node as in ``trie``.

    Turns go by number, NULL first; turns with the same number by role, then by a hash of the text, so
    the order never depends on that of the rows. NULL role or text is empty. Rows without a conversation id belong to none and take no part. Rows that
    repeat are turns like others. No rows give no rows.
    """
    prepare(df.sparkSession)
    sequences, convs = rebuilt(stored(numbered(df, conv_id, turn, role, text), "turns"))
    return trie(sequences, convs)
