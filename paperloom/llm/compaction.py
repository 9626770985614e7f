"""Executed bin-packed compaction: a table in many small files is packed into fewer, file by file.

Small files of a partition are packed into groups by first-fit over descending sizes, one group at a time: a group takes
the largest file left, then the next one down the order that its residual holds, which bisection of the descending sizes
finds and union-find moves past files already taken, until none remains.  A file joins the earliest group that holds it
exactly if that group, filled first, takes it, so both ways give the same groups.

Packing is a job by partition over the list of files, never over rows.  Groups of several are written by one Spark job,
each by one task that streams their rows in joining order into the partition folder of the group's first file; files
that are large or alone are not touched.  The sources are deleted after the job has committed.

Layout: one folder for each (day, lot, piece), hive style, of one file each; the three are not columns of the files.

Defined results: a null time is a day of its own (null) and sorts first, a null id counts as the empty text in checksum
and digest and sorts first; values that are no finite number count 0 cents; equal rows are kept as often as they occur;
columns of any name and number are carried; an empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import python_map, small, staged
from paperloom.session import fresh_folder, ship

#: A day is split into lots of about R / DAY_PARTS rows; files of under R / SMALL_PARTS rows are packed into up to R / FULL_PARTS.
DAY_PARTS, SMALL_PARTS, FULL_PARTS = 200, 750, 300


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Descending sizes -> groups of their places, as first-fit would fill them; a size over the capacity is alone."""
    n = len(sizes)
    negative = [-s for s in sizes]
    free = list(range(n + 1))  # union-find: the first place from here on that is not taken

    def find(k: int) -> int:
        root = k
        while free[root] != root:
            root = free[root]
        while free[k] != root:
            free[k], k = root, free[k]
        return root

    groups = []
    while (at := find(0)) < n:
        group, residual = [], capacity
        while at < n:
            group.append(at)
            free[at] = at + 1
            residual -= sizes[at]
            if residual < 0:
                break
            at = find(max(at + 1, bisect_left(negative, -residual)))
        groups.append(group)
    return groups


PLAN = "rows bigint, head_lot bigint, head_piece bigint, members bigint, place bigint"


def packed(files: DataFrame, keys: tuple[str, str, str], least: int, capacity: int) -> DataFrame:
    """files (day, lot, piece, rows) -> with head_lot, head_piece (of the first file of its group), members and place in it.

    Files of ``least`` rows or more are groups of their own.  A day's files are one group of this job: the list of one
    folder, of some hundred files, not their rows.
    """
    day, lot, piece = keys
    ship(files.sparkSession)
    schema = T.StructType([f for f in files.schema.fields if f.name in keys] + T.StructType.fromDDL(PLAN).fields)

    def plan(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["rows", lot, piece], ascending=[False, True, True]).reset_index(drop=True)
        apart = int((table["rows"] >= least).sum())
        heads, members, places = list(range(apart)), [1] * apart, [0] * apart
        heads, members, places = (x + [0] * (len(table) - apart) for x in (heads, members, places))
        for group in first_fit(table["rows"].tolist()[apart:], capacity):
            for k, at in enumerate(group):
                heads[apart + at], members[apart + at], places[apart + at] = apart + group[0], len(group), k
        return table.assign(head_lot=table[lot].to_numpy()[heads], head_piece=table[piece].to_numpy()[heads], members=members, place=places)[schema.names]

    return files.groupBy(day).applyInPandas(plan, schema)


def _own(name: str) -> str:
    """A helper column's name, which no table is expected to use."""
    return f"{name}__packing__"


def _floor_div(a, b):
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def partition_names(columns: list[str]) -> tuple[str, str, str]:
    """Names for day, lot and piece in the folders, other than the table's columns."""
    taken, ending = {c.lower() for c in columns}, ""
    while {f"part_{k}{ending}" for k in ("day", "lot", "piece")} & taken:
        ending += "_"
    return f"part_day{ending}", f"part_lot{ending}", f"part_piece{ending}"


def _write(rows: DataFrame, keys: tuple[str, ...], mode: str, folder: str) -> None:
    """One file for each key: rows come dealt out by key and sorted, and a file is not cut by its length."""
    rows.write.mode(mode).partitionBy(*keys).option("maxRecordsPerFile", 0).parquet(folder)


def whole_days(column, kind: T.DataType):
    """Days since 1970 of a time with a zone (by UTC) or without."""
    if isinstance(kind, T.TimestampType):
        return _floor_div(F.unix_micros(column), F.lit(86_400_000_000))
    return F.unix_date(column.cast("date")).cast("bigint")


def starting_files(table: DataFrame, folder: str, keys: tuple[str, str, str], time_col: str, id_col: str) -> int:
    """Write the table's starting files; gives its number of rows."""
    day, lot, piece = keys
    own_day, own_rows = _own("day"), _own("rows")
    dated = table.withColumn(day, whole_days(F.col(time_col), table.schema[time_col].dataType))
    days = staged(dated.groupBy(F.col(day).alias(own_day)).agg(F.count(F.lit(1)).alias(own_rows)), "days")
    total = days.agg(F.coalesce(F.sum(own_rows), F.lit(0))).first()[0]
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    lots = 1 + _floor_div(F.col(own_rows), F.lit(1 + total // DAY_PARTS))
    placed = dated.join(small(days), F.col(day).eqNullSafe(F.col(own_day)))
    placed = placed.select(*table.columns, day, F.pmod(_floor_div(h, F.lit(16)), lots).alias(lot), F.least(h % 4, _floor_div(h, F.lit(4)) % 4).alias(piece))
    _write(placed.repartition(*keys).sortWithinPartitions(*keys, time_col, id_col), keys, "errorifexists", folder)
    return total


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, keys: tuple[str, str, str]) -> DataFrame:
    """The folder's rows with their partition; no file is opened to find the schema."""
    return spark.read.schema(T.StructType([*schema.fields, *[T.StructField(k, T.LongType()) for k in keys]])).parquet(folder)


def _same(keys: tuple[str, ...], other: tuple[str, ...]):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other)])


def compact(spark: SparkSession, folder: str, schema: T.StructType, keys: tuple[str, str, str], least: int, capacity: int) -> DataFrame:
    """Pack each day's files of under ``least`` rows; gives for each final file its partition, the sources in joining order, and whether it is new."""
    day, lot, piece = keys
    rows, path = read_folder(spark, folder, schema, keys), F.col("_metadata.file_path")
    files = staged(rows.groupBy(*keys, path.alias("path")).agg(F.count(F.lit(1)).alias("rows")), "files")
    plan = staged(packed(files.select(*keys, "rows"), keys, least, capacity), "packing")
    source, head_lot, head_piece, place, row = (tuple(_own(k) for k in keys), *map(_own, ("lot", "piece", "place", "row")))
    moving = plan.where("members > 1").select(*[F.col(k).alias(s) for k, s in zip(keys, source)], F.col("head_lot").alias(head_lot), F.col("head_piece").alias(head_piece), F.col("place").alias(place))
    # the sources, whose number depends on days and lots and not on rows: only they are read again
    paths = [r.path for r in files.join(small(moving), _same(keys, source), "left_semi").select("path").toLocalIterator()]
    if paths:
        merging = spark.read.schema(rows.schema).option("basePath", folder).parquet(*map(unquote, paths))
        merging = merging.withColumn(row, F.col("_metadata.row_index")).join(small(moving), _same(keys, source))
        merging = merging.select(*schema.names, day, F.col(head_lot).alias(lot), F.col(head_piece).alias(piece), place, row)
        merging = merging.repartition(*keys).sortWithinPartitions(*keys, place, row)
        _write(merging.select(*schema.names, *keys), keys, "append", folder)
        _delete_files(spark, paths)
    name = F.concat_ws("-", F.col(lot), F.col(piece))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", name.alias("name")))), lambda x: x["name"]), ",")
    return plan.groupBy(day, F.col("head_lot").alias(lot), F.col("head_piece").alias(piece)).agg(joined.alias("sources"), (F.count(F.lit(1)) > 1).alias("rewritten"))


def _delete_files(spark: SparkSession, paths: list[str]) -> None:
    """Delete source files, and their folders where nothing is left."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        store = where.getFileSystem(conf)
        store.delete(where, False)
        if not len(store.listStatus(where.getParent())):
            store.delete(where.getParent(), False)


_DIGEST = pa.schema([("file", pa.string()), ("ids_sha256", pa.string())])


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """(file, row, id) sorted by file and row -> a digest for each file, streamed."""
    file, state, out = None, None, []
    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        texts = pc.fill_null(batch.column(2).cast(pa.string()), "").to_pylist()
        begin = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            text = ",".join(texts[begin:end])
            if name == file:
                state.update(b"," + text.encode())
            else:
                if file is not None:
                    out.append((file, state.hexdigest()))
                file, state = name, hashlib.sha256(text.encode())
            begin = end
    if file is not None:
        out.append((file, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=_DIGEST)


def described(spark: SparkSession, folder: str, schema: T.StructType, keys: tuple[str, str, str], id_col: str, value_col: str) -> DataFrame:
    """For each file of the folder: day, lot, piece, n_rows, least and greatest id, cents, the digest of its ids in file order, and its path."""
    rows = read_folder(spark, folder, schema, keys)
    value = F.col(value_col).cast("double")
    cents = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0).otherwise(F.floor(100 * value + 0.5))
    named = [F.col(k).alias(n) for k, n in zip(keys, ("day", "lot", "piece"))]
    file = F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]).alias("file")
    slim = rows.select(*named, file, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(id_col).cast("bigint").alias("id"), cents.cast("bigint").alias("cents"))
    facts = slim.groupBy("day", "lot", "piece", "file", "path").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("min_click_id"), F.max("id").alias("max_click_id"), F.sum("cents").alias("cents"))
    ordered = slim.select("file", "row", "id").repartition("file").sortWithinPartitions("file", "row")
    digests = python_map(ordered, _digests, "file string, ids_sha256 string")
    return facts.join(digests, "file").drop("file")


def op13_compact_clicks(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    folder, keys = fresh_folder(spark, "compacted-clicks"), partition_names(table.columns)
    total = starting_files(table, folder, keys, "arrived_at", "click_id")
    sources = compact(spark, folder, table.schema, keys, 1 + total // SMALL_PARTS, 1 + total // FULL_PARTS)
    sources = sources.toDF("_day", "_lot", "_piece", "sources", "rewritten")
    files = described(spark, folder, table.schema, keys, "click_id", "value")
    out = files.join(sources, _same(("day", "lot", "piece"), ("_day", "_lot", "_piece"))).drop("_day", "_lot", "_piece")
    return out.withColumn("columns", F.lit(",".join(table.columns)))


QUERIES = {"op13_compact_clicks": op13_compact_clicks}
ORACLES: dict[str, str] = {}
