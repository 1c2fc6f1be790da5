"""Duplicate keys, unprocessed rows, NULLs and orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.operators.bounded import merge_groups


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def duplicate_keys(df: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    return df.groupBy(*_names(key)).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def unprocessed(df: DataFrame, column: str = "status", value: str = "pending") -> DataFrame:
    return df.agg(F.count_if(F.col(column) == value).alias("unprocessed"))


def integrity_report(
    df: DataFrame,
    key: str | Sequence[str] = "id",
    status: tuple[str, str] | None = None,
    not_null: Sequence[str] = (),
) -> DataFrame:
    """One row per check: name, number of offences, passed. All are reported."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in not_null]
    if status:
        counts.insert(0, F.count_if(F.col(status[0]) == status[1]).alias(f"unprocessed:{status[0]}"))
    frames = [duplicate_keys(df, key).agg(F.count("*").alias("duplicate_keys"))]
    if counts:
        frames.append(df.agg(*counts))
    wide = merge_groups([], *frames)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("offences")) for c in wide.columns
    ]))
    return wide.select(rows.alias("r")).select("r.*", (F.col("r.offences") == 0).alias("passed"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows without a parent. A NULL child key is not an orphan."""
    other = parent.select(F.col(parent_key or child_key).alias("_pk"))
    return child.filter(F.col(child_key).isNotNull()).join(other, F.col(child_key) == F.col("_pk"), "left_anti")
