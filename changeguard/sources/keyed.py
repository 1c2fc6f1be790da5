"""A stored table with unique keys whose changes rewrite only the hash buckets they touch.

Rows lie in folders by a hash of their key. A numbered commit names the folders that a change has replaced, so readers see
all of a change or nothing, of two writers one is refused, and a run that stops before its commit leaves
files that nobody names. Folders that are not touched keep their files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeguard.sources.commits import CommitLog, Folder

BUCKETS = 1024
_MANIFEST = "version long, bucket int, folder string, buckets int"


class RepeatedKeys(ValueError):
    """Rows that are to be the first of a table share a key."""


class KeyedTable:
    """NULL is a key value like any other: it meets NULL. ``key`` columns identify a row of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema = spark.createDataFrame([], schema).schema
        self.log = CommitLog(spark, f"{self.path}/manifest", _MANIFEST)

    def _folders(self) -> tuple[dict[int, str], int]:
        """(folder of each bucket that has rows, number of buckets); as many rows as buckets come to the driver."""
        newest = self.log.read().groupBy("bucket").agg(F.max_by(F.struct("folder", "buckets"), "version").alias("_f")).collect()
        return {r["bucket"]: r["_f"]["folder"] for r in newest if r["_f"]["folder"]}, max((r["_f"]["buckets"] for r in newest), default=0)

    def _to_change(self) -> tuple[dict[int, str], int]:
        """``_folders`` for a change. The first change makes this object the writer, before it reads, and the one before is refused."""
        if self.log.number is None:
            self.log.claim()
        return self._folders()

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int").alias("__bucket")

    def _open(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._open(sorted(self._folders()[0].values()))

    def lookup(self, *values) -> DataFrame:
        """The row of a key, from its bucket alone."""
        folders, buckets = self._folders()
        if not buckets:
            return self._open([])
        wanted = [F.lit(v).cast(self.schema[k].dataType) for k, v in zip(self.key, values, strict=True)]
        at = self.spark.range(1).select(F.pmod(F.xxhash64(*wanted), F.lit(buckets))).first()[0]
        same = reduce(and_, [F.col(k).eqNullSafe(w) for k, w in zip(self.key, wanted, strict=True)])
        return self._open([folders[at]] if at in folders else []).filter(same)

    def _replace(self, rows: DataFrame, touched: Sequence[int], buckets: int) -> None:
        """Make ``rows`` the whole content of the ``touched`` buckets."""
        name = f"{self.log.writer}-{self.log.number + 1:012d}"
        writer = rows.select(*self.schema.fieldNames(), self._bucket(buckets)).repartition("__bucket").write.partitionBy("__bucket").mode("overwrite")
        for k in self.key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/data/{name}")
        there = set(Folder(self.spark, f"{self.path}/data/{name}").names())
        version = self.log.number + 1
        self.log.commit([
            {"version": version, "bucket": b, "folder": f"{name}/__bucket={b}" if f"__bucket={b}" in there else None, "buckets": buckets} for b in sorted(touched)])

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> None:
        """The first rows. Take so many buckets that one of them is a file of a few hundred megabytes."""
        if self._to_change()[1]:
            raise ValueError(f"{self.path} has rows already")
        if not rows.groupBy(*self.key).count().filter("count > 1").isEmpty():
            raise RepeatedKeys(f"keys {self.key} repeat")
        self._replace(rows, range(buckets), buckets)

    def _touched(self, rows: DataFrame, buckets: int) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(buckets)).distinct().collect()]

    def upsert(self, rows: DataFrame, keep: Sequence[str] = (), order: Sequence[str] = ()) -> int:
        """Rows replace those with the same key or are added; returns how many buckets were rewritten.

        Columns in ``keep`` stay as they were once set. Of several rows with one key the last by ``order`` counts, of
        rows equal in it the largest by the other columns in turn. Rows of one key combine before the shuffle.
        """
        folders, buckets = self._to_change()
        if not buckets:
            raise ValueError(f"{self.path} has no rows yet")
        names = self.schema.fieldNames()
        last = F.struct(*order, *(c for c in names if c not in order))
        # The winner by position, so that its columns may be renamed or left out of the order.
        new = rows.groupBy(*self.key).agg(F.max(last).alias("_new")).select(
            *self.key, *[F.col(f"_new.{c}").alias(c) for c in names if c not in self.key])
        touched = self._touched(rows, buckets)
        if not touched:
            return 0
        old = self._open([folders[b] for b in touched if b in folders])
        rest = [c for c in names if c not in self.key]
        both = old.select(*self.key, F.lit(0).alias("_side"), F.struct(*rest).alias("_row")).unionByName(
            new.select(*self.key, F.lit(1).alias("_side"), F.struct(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in rest]).alias("_row")))
        of = both.groupBy(*self.key).agg(F.max_by("_row", "_side").alias("_now"), F.min_by("_row", "_side").alias("_was"))
        merged = of.select(*[
            F.col(c) if c in self.key else (F.coalesce(f"_was.{c}", f"_now.{c}") if c in keep else F.col(f"_now.{c}")).alias(c) for c in names])
        self._replace(merged, touched, buckets)
        return len(touched)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows of these keys; returns how many buckets were rewritten. Of buckets without one of them only the keys are read."""
        folders, buckets = self._to_change()
        near = [folders[b] for b in self._touched(keys, buckets) if b in folders] if buckets else []
        gone = keys.select(*[F.col(k).alias(f"_{k}") for k in self.key]).distinct()
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key])
        touched = self._touched(self._open(near).join(gone, same, "left_semi"), buckets) if near else []
        if touched:
            self._replace(self._open([folders[b] for b in touched]).join(gone, same, "left_anti"), touched, buckets)
        return len(touched)

    def purge(self, condition: str | Column) -> int:
        """Remove rows that meet a condition; buckets without any are only read. Returns how many were rewritten."""
        folders, buckets = self._to_change()
        wanted = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        touched = self._touched(self.read().filter(wanted), buckets) if buckets else []
        if touched:
            self._replace(self._open([folders[b] for b in touched]).filter(~wanted), touched, buckets)
        return len(touched)
