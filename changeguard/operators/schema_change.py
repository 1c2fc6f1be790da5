"""Derive, expand, contract and roll back columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.functions.columns import as_expr
from changeguard.sources.tables import describe_schema


class ChangeError(Exception):
    """A gate of a data change failed."""


def derive(df: DataFrame, column: str, expr: str | Column) -> DataFrame:
    return df.withColumn(column, as_expr(expr))


def derive_many(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """Several columns in one projection; all see the row as it was before."""
    return df.withColumns({c: as_expr(e) for c, e in exprs.items()})


def expand(df: DataFrame, specs: Iterable) -> DataFrame:
    """Add each missing column as a typed NULL. ``specs`` have name and type."""
    have = {c.lower() for c in df.columns}
    new = {s.name: F.lit(None).cast(s.type) for s in specs if s.name.lower() not in have}
    return df.withColumns(new) if new else df


def _filler(dtype: T.DataType):
    """A typed non-NULL literal, so that coalesce with it is not nullable."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.DateType):
        return F.lit(dt.date(1970, 1, 1))
    if isinstance(dtype, T.TimestampType):
        return F.lit(dt.datetime(1970, 1, 1))
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    if isinstance(dtype, T.DecimalType):  # a literal of just this precision and scale; a cast would be nullable
        return F.lit(Decimal((0, (9,) * dtype.precision, -dtype.scale)))
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.BinaryType):
        return F.lit(bytearray())
    raise ChangeError(f"NOT NULL is not supported for columns of type {dtype.simpleString()}")


def contract(df: DataFrame, drop: Sequence[str] = (), not_null: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Drop columns and enforce NOT NULL.

    ``check`` counts NULLs first (one pass) and raises. Later NULLs still fail
    the job that writes the result, and the schema says not nullable.
    """
    missing = [c for c in not_null if c not in df.columns]
    if missing:
        raise ChangeError(f"no such column: {', '.join(missing)}")
    if check and not_null:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null]).first()
        bad = [f"{c} ({nulls[c]})" for c in not_null if nulls[c]]
        if bad:
            raise ChangeError(f"NULL in column(s) {', '.join(bad)}")
    out = df.drop(*drop)
    strict = {}
    for c in not_null:
        dtype = df.schema[c].dataType
        stop = F.raise_error(F.lit(f"NULL in column {c}")).cast(dtype)
        strict[c] = F.coalesce(F.col(c), stop, _filler(dtype))
    return out.withColumns(strict) if strict else out


def rollback(df: DataFrame, specs: Iterable) -> DataFrame:
    return df.drop(*[s.name for s in specs])


def verify_rollback(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that are still there; empty means the rollback is complete."""
    have = {c.lower() for c in df.columns}
    return [c for c in columns if c.lower() in have]


def cast_failures(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Per column: values, and values that are lost by a cast to the new type."""
    counts = df.agg(*[
        e for i, (c, t) in enumerate(casts.items()) for e in (
            F.count(c).alias(f"_n{i}"),
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"_f{i}"),
        )
    ])
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(t).alias("target_type"),
            F.col(f"_n{i}").alias("value_count"), F.col(f"_f{i}").alias("failed"),
            (F.col(f"_f{i}") == 0).alias("passed"),
        ) for i, (c, t) in enumerate(casts.items())
    ]))
    return counts.select(rows.alias("r")).select("r.*")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns added, dropped or changed in type or nullability from a to b."""
    left, right = describe_schema(a).alias("l"), describe_schema(b).alias("r")
    old, new = F.col("l.data_type"), F.col("r.data_type")
    change = (
        F.when(old.isNull(), "added").when(new.isNull(), "dropped").when(old != new, "retyped")
        .when(F.col("l.is_nullable") != F.col("r.is_nullable"), "nullability")
    )
    return (
        left.join(right, F.col("l.column_name") == F.col("r.column_name"), "full_outer")
        .select(
            F.coalesce("l.column_name", "r.column_name").alias("column_name"), change.alias("change"),
            old.alias("old_type"), new.alias("new_type"),
        )
        .filter(F.col("change").isNotNull())
    )
