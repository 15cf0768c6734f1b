"""Stored tables whose rows are dealt into buckets by key: a merge rewrites only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.shared import shared_path, written

from .tables import delete_keys, first_by

BUCKET = "__bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table under path, one folder a bucket. keys: the columns that name a row (or, for replace, a group of rows).

    buckets is fixed when the table is made: about the table's size by what one task should rewrite. Each write first puts what it is going to store into the
    shared folder, so nothing is read from files that are being replaced. Lost executors cost no more than their tasks. A driver that is lost while buckets are
    swapped can leave one of them out: the staged copy still has it.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _dealt(self, df: DataFrame) -> DataFrame:
        """df with its bucket, by the keys' texts; null keys have one too."""
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def create(self, df: DataFrame) -> KeyedTable:
        """The table with the rows of df, whatever was there before."""
        self._dealt(df).repartition(BUCKET).write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(self.path)
        try:
            self._stored(df.sparkSession)
        except AnalysisException:  # no row, so no file that tells the columns
            self._empty(df, 0)
        return self

    def _empty(self, like: DataFrame, bucket: int) -> None:
        """An empty file in a bucket: it keeps the columns, and dynamic overwrite leaves alone what has no rows."""
        like.where(F.lit(False)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={bucket}")

    def _stored(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        rows = spark.read.parquet(self.path)
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(list(buckets)))

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(BUCKET)

    def looked_up(self, wanted: DataFrame) -> DataFrame:
        """The rows with the keys of wanted; only their buckets are read."""
        dealt = written(self._dealt(wanted.select(*self.keys).distinct()), "wanted")
        return self._stored(wanted.sparkSession, self._touched(dealt)).join(dealt, [*self.keys, BUCKET], "left_semi").drop(BUCKET)

    def _touched(self, dealt: DataFrame) -> list[int]:
        return sorted(r[BUCKET] for r in dealt.select(BUCKET).distinct().collect())  # no more than there are buckets

    def _staged(self, made: DataFrame) -> DataFrame:
        """made, which is dealt by bucket, as a table in the shared folder that has a bucket's rows in files of its own."""
        path = shared_path(made.sparkSession, "merged")
        made.write.option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        return made.sparkSession.read.schema(made.schema).parquet(path)

    def _swap(self, made: DataFrame) -> None:
        """Replace the buckets that made, a staged table, has rows of; as its files are of one bucket each, they are rewritten where they are read."""
        made.write.option("compression", "zstd").mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def insert_if_absent(self, new: DataFrame, order: Sequence[Column]) -> None:
        """The first row of each key of new that the table lacks. No stored file is rewritten; keys that are there leave everything as it is."""
        first = written(self._dealt(first_by(new, self.keys, order)), "new")
        touched = self._touched(first)
        if touched:
            absent = first.join(self._stored(new.sparkSession, touched).select(*self.keys), list(self.keys), "left_anti")
            written(absent, "absent").repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def upsert(self, new: DataFrame, order: Sequence[Column], keep: Sequence[str] = ()) -> None:
        """One row for each key: new's first in the order, else the stored one. Columns in keep stay as stored."""
        first = written(self._dealt(first_by(new, self.keys, order)), "new")
        touched = self._touched(first)
        if touched:
            old = self._stored(new.sparkSession, touched)
            both = old.withColumn("__old", F.lit(1)).unionByName(first.select(old.columns).withColumn("__old", F.lit(0)))
            # keys that hold a null meet nothing: their stored rows and the new one are apart
            void = F.when(reduce(or_, [F.col(k).isNull() for k in self.keys]), F.col("__old"))
            same = Window.partitionBy(BUCKET, *self.keys, void)
            kept = {c: F.coalesce(F.max(F.when(F.col("__old") == 1, F.col(c))).over(same), c) for c in keep}
            newest = both.repartition(BUCKET).withColumn("__rank", F.rank().over(same.orderBy("__old"))).withColumns(kept).where("__rank = 1")
            self._swap(self._staged(newest.select(old.columns)))

    def replace(self, new: DataFrame, gone: DataFrame | None = None) -> None:
        """All rows with the keys of new (and of gone) make way for the rows of new. Buckets that end up empty keep no row."""
        rows = written(self._dealt(new), "new")
        keys = rows.select(*self.keys, BUCKET) if gone is None else rows.select(*self.keys, BUCKET).unionByName(self._dealt(gone.select(*self.keys)))
        keys = written(keys.distinct(), "keys")
        touched = self._touched(keys)
        if not touched:
            return
        old = self._stored(new.sparkSession, touched)
        left = self._staged(delete_keys(old, keys, [*self.keys, BUCKET]).select(old.columns).unionByName(rows.select(old.columns)).repartition(BUCKET))
        emptied = sorted(set(touched) - set(self._touched(left)))
        self._swap(left)
        for b in emptied:
            self._empty(left.drop(BUCKET), b)
