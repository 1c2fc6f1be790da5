"""Compare a table with its changed copy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.operators.bounded import merge_groups
from changeguard.operators.integrity import orphans
from changeguard.operators.schema_change import cast_failures


def _pair_up(src: DataFrame, dst: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key with both sides' values and how often each side has it.

    Union and aggregate, not a join: repeated keys are counted and do not
    multiply, NULL keys match, and hot keys are combined before the shuffle.
    """
    def side(df, tag):
        return df.select(*key, *cols, F.lit(tag).alias("_side"))

    both = side(src, 0).unionByName(side(dst, 1))
    is_src, is_dst = F.col("_side") == 0, F.col("_side") == 1
    return both.groupBy(*key).agg(
        F.count_if(is_src).alias("_ns"), F.count_if(is_dst).alias("_nd"),
        *[F.max(F.when(is_src, F.col(c))).alias(f"_s_{c}") for c in cols],
        *[F.max(F.when(is_dst, F.col(c))).alias(f"_d_{c}") for c in cols],
    )


def reconcile(src: DataFrame, dst: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key: status missing / extra / changed / same / duplicate, the number
    of changed columns and of NULL mismatches."""
    pairs = _pair_up(src, dst, key, cols)
    present = (F.col("_ns") > 0) & (F.col("_nd") > 0)
    diff = [~F.col(f"_s_{c}").eqNullSafe(F.col(f"_d_{c}")) for c in cols]
    nulls = [F.col(f"_s_{c}").isNull() != F.col(f"_d_{c}").isNull() for c in cols]
    status = (
        F.when((F.col("_ns") > 1) | (F.col("_nd") > 1), "duplicate")
        .when(F.col("_nd") == 0, "missing").when(F.col("_ns") == 0, "extra")
        .when(reduce(or_, diff), "changed").otherwise("same")
    )

    def count(flags: list[Column]) -> Column:
        return F.when(present, reduce(lambda a, b: a + b, [f.cast("int") for f in flags])).otherwise(0)

    return pairs.select(
        *key, status.alias("status"), count(diff).alias("changed_columns"), count(nulls).alias("null_mismatches")
    )


def reconcile_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(
        F.count("*").alias("keys"), F.sum("null_mismatches").cast("long").alias("null_mismatches")
    )


def canonical_text(df: DataFrame, cols: Sequence[str], scale: int = 4) -> Column:
    """Length-prefixed text of a row with a mark for NULL. Floating point values
    are fixed to ``scale`` digits, timestamps are microseconds."""
    parts = []
    for c in cols:
        dtype, v = df.schema[c].dataType, F.col(c)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            text = F.round(v * 10**scale, 0).cast("decimal(38,0)").cast("string")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            text = F.unix_micros(v.cast("timestamp")).cast("string")
        else:
            text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def table_checksum(df: DataFrame, cols: Sequence[str] | None = None, algo: str = "crc32") -> DataFrame:
    """Row count and a checksum that does not depend on row order.

    ``crc32`` adds row CRCs, ``md5`` adds 32-bit md5 prefixes, ``xxhash64``
    combines by xor.
    """
    text = canonical_text(df, list(cols or df.columns))
    per_row = {
        "crc32": lambda: F.sum(F.crc32(text.cast("binary")).cast("decimal(38,0)")),
        "md5": lambda: F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")),
        "xxhash64": lambda: F.bit_xor(F.xxhash64(text)),
    }[algo]()
    return df.agg(F.count("*").alias("row_count"), F.coalesce(per_row.cast("string"), F.lit("0")).alias("checksum"))


def parity_report(
    src: DataFrame,
    dst: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    casts: Mapping[str, str] | None = None,
    fks: Sequence[tuple[str, DataFrame, str]] = (),
    algo: str = "crc32",
) -> DataFrame:
    """The five checks of a copied table and their conjunction, one row each."""
    used = [*key, *cols]
    pairs = reconcile_summary(reconcile(src, dst, key, cols))
    frames = [
        table_checksum(src, used, algo).select(
            F.col("row_count").alias("src_n"), F.col("checksum").alias("src_sum")),
        table_checksum(dst, used, algo).select(
            F.col("row_count").alias("dst_n"), F.col("checksum").alias("dst_sum")),
        pairs.agg(F.coalesce(F.sum("null_mismatches"), F.lit(0)).alias("nulls")),
    ]
    frames.append(
        cast_failures(dst, casts).agg(F.sum("failed").alias("casts")) if casts
        else src.sparkSession.range(1).select(F.lit(0).cast("long").alias("casts"))
    )
    lost = [orphans(dst, parent, ck, pk).agg(F.count("*").alias("n")) for ck, parent, pk in fks]
    if lost:
        frames.append(reduce(DataFrame.unionByName, lost).agg(F.sum("n").alias("orphans")))
    else:
        frames.append(src.sparkSession.range(1).select(F.lit(0).cast("long").alias("orphans")))
    wide = merge_groups([], *frames)

    def check(name, a, b):
        return F.struct(
            F.lit(name).alias("check"), a.cast("string").alias("source_value"),
            b.cast("string").alias("dest_value"), a.eqNullSafe(b).alias("passed"),
        )

    zero = F.lit(0).cast("long")
    checks = [
        check("row_count", F.col("src_n"), F.col("dst_n")),
        check("checksum", F.col("src_sum"), F.col("dst_sum")),
        check("null_values", zero, F.col("nulls")),
        check("type_conversion", zero, F.col("casts")),
        check("fk_integrity", zero, F.col("orphans")),
    ]
    passed = reduce(and_, [c["passed"] for c in checks])
    overall = F.struct(
        F.lit("overall").alias("check"), F.lit(None).cast("string").alias("source_value"),
        F.lit(None).cast("string").alias("dest_value"), passed.alias("passed"),
    )
    return wide.select(F.explode(F.array(*checks, overall)).alias("c")).select("c.*")


def row_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows one side has more often, without a key: the row, which side, how often.

    One aggregate over both sides; equal rows are combined before the shuffle.
    """
    cols = a.columns
    both = a.withColumn("_d", F.lit(1)).unionByName(b.select(*cols).withColumn("_d", F.lit(-1)))
    net = both.groupBy(*cols).agg(F.sum("_d").alias("_d")).filter(F.col("_d") != 0)
    return net.select(
        *cols, F.when(F.col("_d") > 0, "only_in_a").otherwise("only_in_b").alias("side"),
        F.abs("_d").alias("copies"),
    )
