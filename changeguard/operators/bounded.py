"""Checks of size before something is broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_ROWS = 20_000
LOCAL_BYTES = 16 << 20


def if_small(df: DataFrame, limit: int = LOCAL_ROWS) -> DataFrame | None:
    """The frame as a local table, evaluated once, if it has at most ``limit`` rows
    and ``LOCAL_BYTES`` of text."""
    rows, size = [], 0
    for row in df.limit(limit + 1).toLocalIterator():
        rows.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes, bytearray)))
        if len(rows) > limit or size > LOCAL_BYTES:
            return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def merge_groups(by: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Put frames with one row per group side by side.

    Union and regroup instead of a join: NULL keys match, and with no group
    columns no cross join is needed.
    """
    columns = [c for f in frames for c in f.columns if c not in by]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
