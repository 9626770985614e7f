"""Helpers shared by the corpus operators: scratch tables, ids and column hygiene."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import shared_folder, ship

#: Separator bytes of the word contracts: space and \t \n \v \f \r.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of ids that may be broadcast, at some tens of bytes each.
BROADCAST_ROWS = 1_000_000

#: Bytes of an Arrow batch on its way to a Python worker; a single longer row is a batch of its own.
BATCH_BYTES = "4m"

_scopes: list[list[tuple[SparkSession, str]]] = []
_folders: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that ``spark.checkpoint.dir`` names; deleted when the application ends.

    Where the setting is missing, a local session gets a folder of its own, and a cluster raises: its machines share none.
    """
    folder = f"{shared_folder(spark)}/paperloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder, True)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _scopes[-1:]:
        scope.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete one staged table that no later plan reads."""
    folder = f"/paperloom-{df.sparkSession.sparkContext.applicationId}/"
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles() if folder in p}:
        _delete(df.sparkSession, path)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame | None], None]]:
    """Tables that are staged inside belong to it; the function that it gives deletes them, but for one table to keep.

    Tables of other runs stay, also of results that were built before and are read later.
    """
    own: list[tuple[SparkSession, str]] = []

    def release(keep: DataFrame | None = None) -> None:
        kept = {p.rsplit("/", 2)[-2] for p in keep.inputFiles()} if keep is not None else set()
        for table in [t for t in own if t[1].rsplit("/", 1)[-1] not in kept]:
            _delete(*table)
            own.remove(table)

    _scopes.append(own)
    try:
        yield release
    finally:
        _scopes.remove(own)


def _delete(spark: SparkSession, path: str, quiet: bool = False) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        if not quiet:  # at the end of the application its JVM may be gone
            raise


def spill_dir(prefix: str) -> str:
    """A task's own spill folder, on the disks that Spark gives its tasks; the task removes it."""
    roots = [p for p in os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",") if p]
    return tempfile.mkdtemp(prefix=prefix, dir=roots[os.getpid() % len(roots)] if roots else None)


def unit_hash(seed: str, *cols):
    """A reproducible number in (0, 1) for each row: 52 bits of md5 over the seed and the columns."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


#: So many copies of one row are numbered by one task.
COPIES = 10_000


def numbered_copies(rows: DataFrame, name: str, most: int = COPIES) -> DataFrame:
    """The rows with a number (from 0) among rows that are equal in all columns.

    Equal rows are counted before they meet and made anew from the count, in ranges that are dealt out: no task sorts,
    holds or makes all copies of a row that many are.
    """
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    few = counts.where(F.col("_copies") <= most).withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    ranges = counts.where(F.col("_copies") > most).withColumn("_first", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(most).cast("bigint")))).repartition("_first")
    many = ranges.withColumn(name, F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + most, F.col("_copies")) - 1))).drop("_first")
    return few.unionByName(many).drop("_copies")


def small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast only if it has few rows by count; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What the operators remember in a Python worker between partitions, by operator: functions that forget it.
CACHES: dict[str, Callable[[], object]] = {}


def settle(keep: str | None = None) -> None:
    """Forget what other operators remember in this worker, and give free memory back to the machine."""
    for name, forget in CACHES.items():
        if name != keep:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def python_map(df: DataFrame, call, schema, cache: str | None = None) -> DataFrame:
    """mapInArrow with this package shipped to the workers, on batches of bounded bytes.

    Workers are reused by later stages, so a partition begins and ends without the caches of other operators.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        settle(cache)
        try:
            yield from call(batches)
        finally:
            settle(cache)

    return df.mapInArrow(run, schema)


def appended(df: DataFrame, source: str, fields: list[tuple[str, T.DataType, pa.DataType]], call, cache: str | None = None) -> DataFrame:
    """df with columns that ``call`` makes of each value of ``source``, one tuple a row; columns of those names go."""
    df = df.drop(*[name for name, *_ in fields if name != source])
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind, _ in fields]])
    at = df.columns.index(source)

    def run(batches):
        for batch in batches:
            made = list(zip(*[call(x.as_py()) for x in batch.column(at)])) or [[] for _ in fields]
            arrays = [pa.array(values, kind) for values, (_, _, kind) in zip(made, fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *[f[0] for f in fields]])

    return python_map(df, run, schema, cache)
