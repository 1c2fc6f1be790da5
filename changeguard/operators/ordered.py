"""Ordered computations per key that survive hot keys.

A window partitioned by a key puts all rows of that key in one task. Here keys
with more rows than ``changeguard.group.maxRows`` are cut into ordered blocks:
split points are approximate quantiles of the order columns, each block is
summarised to one row, the summaries are scanned per key, and the result enters
every block as one extra carry row. Other keys stay as they are. All rows are
kept and the result is the same as with the plain window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.operators.bounded import if_small
from changeguard.session import group_row_limit

MAX_BLOCKS = 8192
MIN_GLOBAL_BLOCKS = 8


@dataclass(frozen=True)
class Splits:
    """Split points of one order column; ``hot`` are values that fill whole blocks.

    Rows with a hot value or NULL are split again by the next order column, if
    there are splits of one.
    """

    column: str
    points: tuple
    hot: tuple
    dtype: T.DataType


def _splittable(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))


def _sampled_quantiles(df: DataFrame, column: str, n: int, total: int) -> list:
    """Quantiles of a column without numeric order (text, binary, boolean), from a bounded sample."""
    want = 32 * n
    fraction = min(1.0, want / max(total, 1))
    rows = df.select(column).filter(F.col(column).isNotNull()).sample(fraction, seed=7).limit(2 * want)
    values = sorted(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in rows.collect())
    return [values[len(values) * i // n] for i in range(1, n)] if values else []


SAMPLE_ROWS = 200_000


def find_splits(df: DataFrame, order: Sequence[str], n: int, total: int) -> list[Splits]:
    """Approximate quantiles of the order columns from a sample of the ``total``
    rows. Any points give a right result; good ones give even blocks."""
    if n < 2:
        return []
    types = {c: df.schema[c].dataType for c in order}
    usable = [c for c in order if _splittable(types[c])]
    fractions = [i / n for i in range(1, n)]
    share = max(SAMPLE_ROWS, 500 * n) / max(total, 1)
    sampled = df.sample(share, seed=11) if share < 0.5 else df
    row = sampled.agg(
        F.count("*").alias("_rows"), *[F.count(c).alias(f"_known_{c}") for c in order],
        *[F.percentile_approx(F.col(c), fractions, 10 * n).alias(c) for c in usable]).first()
    found = []
    for c in order:
        if c in usable:
            values = list(row[c] or [])
        elif isinstance(types[c], (T.StringType, T.BinaryType, T.BooleanType)):
            values = _sampled_quantiles(df, c, n, total)
        else:
            break
        counts = Counter(values)
        points = sorted(counts)
        hot = tuple(p for p in points if counts[p] > 1)
        found.append(Splits(c, tuple(points), hot, types[c]))
        # Values or NULLs that fill a block are cut by the next column; so is a column of NULLs.
        if not hot and (row["_rows"] - row[f"_known_{c}"]) * n <= row["_rows"]:
            break
    return found if any(s.points for s in found) else []


def _literals(values: Sequence, dtype: T.DataType) -> Column:
    return F.array(*[F.lit(bytearray(v) if isinstance(v, bytes) else v).cast(dtype) for v in values])


def add_block(df: DataFrame, splits: Sequence[Splits], name: str = "_blk") -> DataFrame:
    """Block number, monotone in the order columns; NULL sorts first.

    How many points lie below a value is found by binary search, one projection
    per halving, which stays in generated code. Do not filter on the column
    above this: the predicate would be unrolled through all projections.
    """
    block, within = F.lit(0).cast("long"), F.lit(True)
    temps = []
    for level, s in enumerate(splits):
        value = F.col(s.column)
        if not s.points:  # only NULLs were seen; any value sorts behind them
            block = block * 4 + F.when(within & value.isNotNull(), 1).otherwise(F.when(within, -1).otherwise(0))
            within = within & value.isNull()
            continue
        below, table = f"_below{level}", _literals(s.points, s.dtype)
        temps.append(below)
        df = df.withColumn(below, F.lit(0))
        for bit in reversed(range(len(s.points).bit_length())):
            stride = 2**bit
            more = F.get(table, F.col(below) + (stride - 1)) < value
            df = df.withColumn(below, F.when(more, F.col(below) + stride).otherwise(F.col(below)))
        at_hot = F.coalesce(F.array_contains(_literals(s.hot, s.dtype), value), F.lit(False)) if s.hot else F.lit(False)
        step = F.when(value.isNull(), -1).otherwise(2 * F.col(below) + at_hot.cast("int"))
        block = block * (2 * len(s.points) + 4) + F.when(within, step).otherwise(0)
        within = within & (at_hot | value.isNull())
    return df.withColumn(name, block).drop(*temps)


def point_range(splits: Splits, block: int) -> tuple:
    """(low, high) of a block of a single order column: low < value <= high,
    None where it is open."""
    i = block // 2
    return (splits.points[i - 1] if i > 0 else None, splits.points[i] if i < len(splits.points) else None)


@dataclass(frozen=True)
class Cut:
    """How groups are cut: at ``splits``, all of them or only those in ``hot``."""

    by: tuple[str, ...]
    splits: tuple[Splits, ...]
    hot: DataFrame | None

    def tag(self, df: DataFrame) -> DataFrame:
        """Add ``_hot`` (the group is cut) and ``_blk``; uncut groups have one block."""
        if self.hot is None:
            return add_block(df, self.splits).withColumn("_hot", F.lit(True))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in self.by])
        keys = self.hot.select(*[F.col(c).alias(f"_h_{c}") for c in self.by], F.lit(True).alias("_hot"))
        names = df.columns
        marked = df.join(F.broadcast(keys), same, "left").select(*names, F.coalesce("_hot", F.lit(False)).alias("_hot"))
        blocks = add_block(marked, self.splits)
        return blocks.withColumn("_blk", F.when(F.col("_hot"), F.col("_blk")).otherwise(F.lit(-1)))


def choose_cut(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int | None = None) -> Cut | None:
    """None if every group is small enough for one task.

    Counts rows per group and collects only the groups above the limit, of which
    there are at most rows / limit; if that is still many, all groups are cut.
    Without group columns the whole frame is one group and always cut.
    """
    limit = limit or group_row_limit(df.sparkSession)
    hot, rows = None, df
    if by:
        counts = df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        hot = if_small(counts)
        total = df.count() if hot is None else hot.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if total == 0:
            return None
        if hot is not None:
            rows = _null_safe_semi(df, hot, by)
            hot = hot.drop("_n")
    else:
        total = df.count()
    n = min(MAX_BLOCKS, max(0 if by else MIN_GLOBAL_BLOCKS, math.ceil(total / limit) * 2))
    splits = find_splits(rows, order, n, total)
    return Cut(tuple(by), tuple(splits), hot) if splits else None


def _null_safe_semi(df: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    k = keys.select(*[F.col(c).alias(f"_h_{c}") for c in by])
    return df.join(F.broadcast(k), reduce(and_, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by]), "left_semi")


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    fill: Mapping[str, Column] | None = None,
    fill_next: Mapping[str, Column] | None = None,
    cut: Cut | None | bool = True,
) -> DataFrame:
    """Add ordered columns per group.

    ``number`` 1-based position, ``lag``/``lead`` value of the neighbour row,
    ``running`` inclusive sum, ``total`` sum of the whole group, ``fill`` last non-NULL value so far (this row
    included), ``fill_next`` first non-NULL value from this row on. ``order``
    must be a total order inside the group for a repeatable result. ``cut`` is a
    choice made before with ``choose_cut`` for the same groups and order.
    """
    by, order = list(by), list(order)
    lag, lead = dict(lag or {}), dict(lead or {})
    running, total = dict(running or {}), dict(total or {})
    fill, fill_next = dict(fill or {}), dict(fill_next or {})
    if number:
        running[number] = F.lit(1).cast("long")
    keep = df.columns
    if cut is True:
        cut = choose_cut(df, by, order)

    made = {**lag, **lead, **running, **total, **fill, **fill_next}
    rows = df.select("*", *[e.alias(f"_in_{n}") for n, e in made.items()])
    inp = {n: F.col(f"_in_{n}") for n in made}
    group, sort = list(by), [F.col(c) for c in order]
    if cut:
        rows = cut.tag(rows).withColumn("_pos", F.lit(1))
        rows = _with_carry(rows, by, order, lag, lead, running, total, fill, fill_next)
        group, sort = by + ["_blk"], [F.col("_pos"), *sort]

    w = Window.partitionBy(*group).orderBy(*sort)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    # In blocks the head row carries the group's total; other rows have NULL there.
    summed = {n: F.when(F.col("_hot"), F.max(f"_sum_{n}").over(whole)).otherwise(F.sum(inp[n]).over(whole)) if cut else F.sum(inp[n]).over(whole) for n in total}
    back = (
        Window.partitionBy(*group)
        .orderBy(*[F.desc(c) for c in (["_pos"] if cut else []) + order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = rows.select(
        *[F.col(c) for c in keep],
        *([F.col("_pos")] if cut else []),
        *[F.lag(inp[n]).over(w).alias(n) for n in lag],
        *[F.lead(inp[n]).over(w).alias(n) for n in lead],
        *[F.sum(inp[n]).over(upto).alias(n) for n in running],
        *[e.alias(n) for n, e in summed.items()],
        *[F.last(inp[n], ignorenulls=True).over(upto).alias(n) for n in fill],
        *[F.last(inp[n], ignorenulls=True).over(back).alias(n) for n in fill_next],
    )
    if cut:
        out = out.filter(F.col("_pos") == 1).drop("_pos")
    return out


def _with_carry(rows, by, order, lag, lead, running, total, fill, fill_next) -> DataFrame:
    """Add one head and one tail row per block with what the neighbours hand over."""
    at = F.struct(*[F.col(c) for c in order])

    def seen(n):
        return F.when(F.col(f"_in_{n}").isNotNull(), at)

    def boxed(n):
        return F.struct(F.col(f"_in_{n}").alias("v"))

    aggs = [F.lit(1).alias("_one")]
    aggs += [F.max_by(boxed(n), at).alias(f"_in_{n}") for n in lag]
    aggs += [F.min_by(boxed(n), at).alias(f"_in_{n}") for n in lead]
    aggs += [F.sum(f"_in_{n}").alias(f"_in_{n}") for n in (*running, *total)]
    aggs += [F.max_by(F.col(f"_in_{n}"), seen(n)).alias(f"_in_{n}") for n in fill]
    aggs += [F.min_by(F.col(f"_in_{n}"), seen(n)).alias(f"_in_{n}") for n in fill_next]
    blocks = rows.filter("_hot").groupBy(*by, "_blk").agg(*aggs)

    w = Window.partitionBy(*by).orderBy("_blk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c) for c in by] + [F.col("_blk"), F.lit(True).alias("_hot")]
    parts = [rows]
    head = [F.lag(f"_in_{n}").over(w)["v"].alias(f"_in_{n}") for n in lag]
    head += [F.sum(f"_in_{n}").over(before).alias(f"_in_{n}") for n in running]
    head += [F.sum(f"_in_{n}").over(Window.partitionBy(*by)).alias(f"_sum_{n}") for n in total]
    head += [F.last(f"_in_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in fill]
    tail = [F.lead(f"_in_{n}").over(w)["v"].alias(f"_in_{n}") for n in lead]
    tail += [F.last(f"_in_{n}", ignorenulls=True).over(after).alias(f"_in_{n}") for n in fill_next]
    if head:
        parts.append(blocks.select(*keys, F.lit(0).alias("_pos"), *head))
    if tail:
        parts.append(blocks.select(*keys, F.lit(2).alias("_pos"), *tail))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rolling(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    n: int,
    aggs: Mapping[str, Column],
) -> DataFrame:
    """Aggregates over the last ``n`` rows of each group, this row included.

    In hot groups rows are numbered first and cut into equal blocks; each block
    also gets the last ``n - 1`` rows of the block before it.
    """
    cut = choose_cut(df, by, order)
    if not cut:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
        return df.select("*", *[a.over(w).alias(k) for k, a in aggs.items()])
    size = max(n, group_row_limit(df.sparkSession))
    numbered = scan(df, by, order, number="_rn", cut=cut)
    at = F.col("_rn") - 1
    home = F.floor(at / size)
    copies = F.when(at % size >= size - (n - 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = numbered.select("*", F.explode(copies).alias("_copy")).withColumn("_blk", home + F.col("_copy"))
    w = Window.partitionBy(*by, "_blk").orderBy("_rn").rowsBetween(-(n - 1), 0)
    return (
        spread.select("*", *[a.over(w).alias(k) for k, a in aggs.items()])
        .filter(F.col("_copy") == 0)
        .drop("_rn", "_copy", "_blk")
    )
