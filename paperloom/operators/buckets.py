"""Tables kept in buckets of their key, so that a write touches the buckets of its changes and leaves all other files as they are.

A change set is merged with its own buckets only: these are read, merged, written beside the table, and put in place of
the old ones by one dynamic partition overwrite.  A run that is repeated merges the same changes again, which the merges
of ``records`` (upsert, correction, replacement of children) leave without effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import fresh_folder

BUCKET = "bucket"


def bucket_of(key: Column, kind: T.DataType, buckets: int) -> Column:
    """Whole numbers by remainder, anything else by hash; null is in bucket 0."""
    number = key.cast("bigint") if isinstance(kind, T.IntegralType) else F.xxhash64(key)
    return F.coalesce(F.pmod(number, F.lit(buckets)), F.lit(0)).cast("int")


class BucketedTable:
    """A table in ``buckets`` folders; a bucket is one file, or several of at most ``file_rows`` rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int, file_rows: int = 5_000_000):
        self.spark, self.path, self.key, self.schema, self.buckets, self.file_rows = spark, path, key, schema, buckets, file_rows

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, bucket_of(F.col(self.key), self.schema[self.key].dataType, self.buckets))

    def _write(self, placed: DataFrame, mode: str) -> None:
        out = placed.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", self.file_rows)
        out.partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(self._placed(rows.select(*self.schema.names)), "errorifexists")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, of which only the files are listed and read."""
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def merge(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """``merge(current, changes)`` over the changes' buckets; gives their numbers.  A bucket that ends empty stays without rows."""
        touched = sorted(r[0] for r in changes.select(bucket_of(F.col(self.key), self.schema[self.key].dataType, self.buckets)).distinct().collect())  # as many as buckets at most
        if touched:
            beside = fresh_folder(self.spark, "merged-buckets")
            self._placed(merge(self.read(touched).drop(BUCKET), changes).select(*self.schema.names)).write.parquet(beside)
            merged = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(beside)
            left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
            self._write(merged, "overwrite")
            for gone in set(touched) - left:
                self._drop(gone)
        return touched

    def _drop(self, bucket: int) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
