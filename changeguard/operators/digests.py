"""Compare two large tables by digests of key ranges: only ranges that differ are read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.operators.bounded import if_small
from changeguard.operators.reconcile import canonical_text, reconcile

#: Leaves of a digest tree and children of a node. The leaves bound what comes to the driver.
LEAVES, FANOUT = 4096, 16
#: Runs of neighbouring ranges that become conditions on the key.
MOST_RUNS = 100


def key_ranges(df: DataFrame, key: str, leaves: int = LEAVES) -> list | None:
    """Upper bounds that cut a numeric key into ranges of about equal rows; None for other keys, which are cut by hash."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return None
    points = df.agg(F.percentile_approx(key, [i / leaves for i in range(1, leaves)], max(10_000, 4 * leaves))).first()[0]
    return sorted(set(points or []))


def leaf_of(key: str, bounds: list | None, leaves: int = LEAVES) -> Column:
    """Number of the range of a key; NULL keys are in the first."""
    if bounds is None:
        return F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(leaves)), F.lit(0)).cast("int")
    if not bounds:
        return F.lit(0)
    # Binary search over the sorted bounds: as many steps as the bounds have binary digits.
    table, n = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), len(bounds)  # one literal, folded once
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    at = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s, _):
        above = F.element_at(table, at(s) + 1) < F.col(key)
        moved = F.struct(F.when(above, at(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(at(s)).alias("hi"))
        return F.when(s["lo"] < s["hi"], moved).otherwise(s)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda s: s["lo"])
    return F.coalesce(found, F.lit(0))


def leaf_digests(df: DataFrame, key: str, cols: Sequence[str], bounds: list | None, leaves: int = LEAVES) -> DataFrame:
    """(leaf, rows, digest) of a table: one pass; sums of row hashes, so digests can be stored, added and rolled up."""
    text = canonical_text(df, [key, *cols])
    parts = [F.sum(F.xxhash64(F.lit(salt), text).cast("decimal(38,0)")) for salt in ("a", "b")]
    return df.select("*", leaf_of(key, bounds, leaves).alias("leaf")).groupBy("leaf").agg(
        F.count("*").alias("rows"), *(p.alias(f"digest_{n}") for n, p in enumerate(parts)))


def rolled_up(digests: DataFrame, levels: int = 1, fanout: int = FANOUT) -> DataFrame:
    """The digests ``levels`` higher in the tree."""
    return digests.groupBy(F.floor(F.col("leaf") / fanout**levels).cast("int").alias("leaf")).agg(
        *(F.sum(c).alias(c) for c in ("rows", "digest_0", "digest_1")))


def differing_leaves(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(leaf) of two tables of digests that do not agree; a leaf that one side has not got differs."""
    both = src.unionByName(dst.select("leaf", *((-F.col(c)).alias(c) for c in ("rows", "digest_0", "digest_1"))))
    sums = both.groupBy("leaf").agg(*(F.sum(c).alias(c) for c in ("rows", "digest_0", "digest_1")))
    return sums.filter("rows <> 0 or digest_0 <> 0 or digest_1 <> 0").select("leaf")


def reconcile_ranges(src: DataFrame, dst: DataFrame, key: str, cols: Sequence[str], leaves: int = LEAVES) -> DataFrame:
    """The rows of ``reconcile`` whose status is not ``same``, from a second read of the differing ranges only.

    Ranges of numeric keys become conditions on the key that reach the scan, so files and row groups of
    other ranges are skipped; hash ranges are filtered while reading. Repeated keys are reported as ``duplicate``
    where their range differs; a range that holds the same rows on both sides is the same.
    """
    bounds = key_ranges(src, key, leaves)
    found = differing_leaves(leaf_digests(src, key, cols, bounds, leaves), leaf_digests(dst, key, cols, bounds, leaves))
    # At most ``leaves`` numbers.
    wanted = sorted(r["leaf"] for r in if_small(found, max(leaves, len(bounds or [])) + 1).collect())
    if not wanted:
        return reconcile(src.limit(0), dst.limit(0), [key], cols)
    which = _condition(key, bounds, wanted, leaves)
    return reconcile(src.filter(which), dst.filter(which), [key], cols).filter("status <> 'same'")


def _condition(key: str, bounds: list | None, wanted: list[int], leaves: int) -> Column:
    """Whether a key is in one of the wanted ranges; neighbouring ranges are one comparison."""
    if bounds is None:
        return leaf_of(key, None, leaves).isin(wanted)
    runs: list[list[int]] = []
    for leaf in wanted:
        if runs and leaf == runs[-1][1] + 1:
            runs[-1][1] = leaf
        else:
            runs.append([leaf, leaf])
    if len(runs) > MOST_RUNS:  # damage all over: the number of the range decides, row by row
        return leaf_of(key, bounds, leaves).isin(wanted)
    k, out = F.col(key), F.lit(False)
    for a, b in runs:
        low = k > bounds[a - 1] if a > 0 else F.lit(True)
        high = k <= bounds[b] if b < len(bounds) else F.lit(True)
        out = out | (low & high) | (k.isNull() if a == 0 else F.lit(False))
    return out
