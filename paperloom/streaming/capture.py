"""Capture as a stream: extraction files land in a folder, and each micro-batch maps the documents that it touches.

The checkpoint takes the place of a startup requeue, ``maxFilesPerTrigger`` that of a bounded queue.  A document's rows
may land in several files: what has landed is state of its document (``jobs.assembled``), so a batch reads its own files
and the state of its own documents, and maps these anew.  Results are written by batch, over what a failed try of that
batch wrote, so a replay adds nothing; of several results of a document the last batch's holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.streaming import jobs


def read_landing(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_mapped(stream: DataFrame, mapper: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "doc_id", row_keys: tuple[str, ...] | None = None):
    """Map the documents of each micro-batch whole; a document's rows are told apart by ``row_keys``, or by all columns (equal rows are one).

    Returns the query, which ends when the folder is read.
    """
    return jobs.write_batches(jobs.assembled(stream, key, list(row_keys or stream.columns)), f"{out}/mapped", checkpoint, mapper)


def read_mapped(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """Each document's rows of the last batch that mapped it."""
    rows = spark.read.parquet(f"{out}/mapped")
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi").drop("batch")


def with_retry(attempts: DataFrame, most: int = 3, base_seconds: float = 2.0) -> DataFrame:
    """doc_id, attempts, status, waited of a log of attempts (doc_id, attempt, succeeded).

    Attempts after the first success or past the most count for nothing; a document without success gives up.
    """
    rows = attempts.where(F.col("attempt") <= most).groupBy("doc_id").agg(F.min(F.when(F.col("succeeded"), F.col("attempt"))).alias("first"), F.max("attempt").alias("last"))
    used = F.coalesce("first", "last")
    waited = F.lit(base_seconds) * (F.pow(F.lit(2.0), used - 1) - 1)
    status = F.when(F.col("first").isNotNull(), "MAPPED").when(F.col("last") >= most, "FAILED").otherwise("CAPTURED")
    return rows.select("doc_id", used.alias("attempts"), status.alias("status"), waited.alias("waited"))
