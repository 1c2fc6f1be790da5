"""Does a stored column equal its defining expression?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.functions.columns import as_expr, differs, in_sample, ratio


def drift_scan(df: DataFrame, column: str, expr: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Total, NULLs, drifted rows and parity in one aggregate; 1.0 if empty."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(column).isNull()).alias("nulls"),
        F.count_if(differs(column, as_expr(expr))).alias("drifted"),
    )
    return counts.withColumn("parity", ratio(F.col("total") - F.col("drifted"), "total", 1.0))


def sampled_parity(df: DataFrame, column: str, expr: str | Column, key: str = "id", rate: float = 1.0, salt: str = "") -> DataFrame:
    """Parity on a repeatable sample by key hash; a rate outside (0, 1] means all rows."""
    rows = df.filter(in_sample(key, rate, salt))
    counts = rows.agg(
        F.count_if(~differs(column, as_expr(expr))).alias("matches"), F.count("*").alias("sampled")
    )
    return counts.withColumn("parity", ratio("matches", "sampled", 1.0))


def _per_column(counts: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Unpivot one row of ``field_i`` columns to one row per named column."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
        for i, c in enumerate(names)
    ]))
    return counts.select(rows.alias("r")).select("r.*")


def drift_columns(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """The drift report of several columns in one pass, one row each."""
    counts = df.agg(*[
        a for i, (c, e) in enumerate(exprs.items()) for a in (
            F.count("*").alias(f"total_{i}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"),
            F.count_if(differs(c, as_expr(e))).alias(f"drifted_{i}"),
        )
    ])
    rows = _per_column(counts, list(exprs), ["total", "nulls", "drifted"])
    return rows.withColumn("parity", ratio(F.col("total") - F.col("drifted"), "total", 1.0))


def verify_columns(df: DataFrame, exprs: Mapping[str, str | Column], key: str = "id", rate: float = 1.0, salt: str = "") -> DataFrame:
    """Rows and NULLs over all rows and parity on the sample, for several columns in one pass."""
    inside = in_sample(key, rate, salt)
    rows = df.select(*exprs, *[(~differs(c, as_expr(e))).alias(f"_same_{i}") for i, (c, e) in enumerate(exprs.items())], inside.alias("_in"))
    counts = rows.agg(*[
        a for i, c in enumerate(exprs) for a in (
            F.count("*").alias(f"total_{i}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"), F.count_if("_in").alias(f"sampled_{i}"),
            F.count_if(F.col("_in") & F.col(f"_same_{i}")).alias(f"matches_{i}"),
        )
    ])
    report = _per_column(counts, list(exprs), ["total", "nulls", "sampled", "matches"])
    return report.withColumn("parity", ratio("matches", "sampled", 1.0))


def parity_gate(report: DataFrame, threshold: float = 0.999, min_parity: float = 0.0) -> DataFrame:
    """Adds ``passed`` and ``reason``: remaining NULLs fail first, then parity. A
    sample without a row says nothing about a table that has some, and fails."""
    limit = max(threshold, min_parity)
    by_nulls, by_parity = F.col("nulls") > 0, F.col("parity") < limit
    unseen = (F.col("sampled") == 0) & (F.col("total") > 0) if "sampled" in report.columns else F.lit(False)
    reason = F.when(by_nulls, F.concat(F.col("nulls").cast("string"), F.lit(" rows still NULL"))).when(
        by_parity, F.format_string(f"parity %.5f < {limit:.5f}", F.col("parity"))
    )
    reason = F.coalesce(reason, F.when(unseen, F.format_string("none of %d rows sampled", F.col("total")) if "sampled" in report.columns else None))
    return report.withColumns({"passed": ~(by_nulls | by_parity | unseen), "reason": reason})
