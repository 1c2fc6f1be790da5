"""Tables and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_ROW = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("is_nullable", T.BooleanType(), False),
    T.StructField("column_default", T.StringType(), True),
])


def load_table(spark: SparkSession, path_or_name: str, fmt: str = "parquet") -> DataFrame:
    """A table by path or, without a slash, by catalog name."""
    if "/" in path_or_name:
        return spark.read.format(fmt).load(path_or_name)
    return spark.table(path_or_name)


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column in ordinal order. Files carry no column defaults."""
    rows = [
        (i + 1, f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("CURRENT_DEFAULT"))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, SCHEMA_ROW)


def observed_schema(df: DataFrame) -> DataFrame:
    """The schema with what the data says: rows and NULLs per column, one pass."""
    names = df.columns
    counted = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(names)])
    per_column = F.explode(F.array(*[
        F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.col(f"_{i}").alias("null_count"),
        ) for i, c in enumerate(names)
    ]))
    return counted.select("_rows", per_column.alias("c")).select("c.*", F.col("_rows").alias("row_count"))
