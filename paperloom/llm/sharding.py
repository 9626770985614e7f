"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the fractional rank (rank - 1/2) / rows of
the source places every source evenly on (0, 1).  The order by fractional rank is cut into runs whose row
counts differ by one at most, so every run holds each source in the corpus's proportion (law ``rows``).

Ranks are exact without one task for a source or for the whole order: rows are counted for each cell of the
hash (and then of the fractional rank), the counts are accumulated, and rows are ordered only in their cell.

What tells rows apart goes into the hash: in the query the id, the text's digest, and a number among equal rows.  So
rows with one id or none are spread like others, and runs over other partitions agree.

Defined results: a null text has 0 bytes and checksum 0; the null source is a source of its own; ties of the hash go to
the smaller id, then by the further keys; an empty input gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import documents, numbered_copies, staged, unit_hash

CELLS, CELL_ROWS = 4096, 100_000  # at least so many cells, and more of them for more rows


def ranked(rows: DataFrame, groups: list[str], place: str, ties: list, name: str) -> DataFrame:
    """Add the rank (from 1) of each row by ``place`` in (0, 1) within its group, and the group's rows."""
    cells = max(CELLS, rows.count() // CELL_ROWS)
    rows = rows.withColumn("_cell", F.least(F.floor(F.col(place) * cells), F.lit(cells - 1)))
    counts = rows.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*(groups or [F.lit(1)]))
    counts = counts.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_cell").alias("_c"),
        (F.sum("_rows").over(group.orderBy("_cell")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(group).alias(f"{name}_rows"),
    )
    inside = Window.partitionBy(*groups, "_cell").orderBy(place, *ties)
    numbered = rows.withColumn("_inside", F.row_number().over(inside))
    same = F.col("_cell") == F.col("_c")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = numbered.join(counts, same).withColumn(f"{name}_rank", F.col("_before") + F.col("_inside"))
    return joined.drop("_cell", "_c", "_before", "_inside", *[f"_g_{g}" for g in groups])


def interleave(rows: DataFrame, shards: int = 8, seed: str = "shard", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows (source, keys, ...) -> the same with shard (0..shards-1) and slot (from 0, gapless); rows are told apart by the keys."""
    ties = [F.col(k).asc_nulls_last() for k in keys]
    rows = rows.withColumn("_place", unit_hash(seed, *[F.col(k) for k in keys]))
    first = ranked(rows, ["source"], "_place", ties, "_source")
    first = first.withColumn("_at", (F.col("_source_rank") - F.lit(0.5)) / F.col("_source_rows"))
    # where sources tie, the hash decides, so that no source always comes first
    order = ranked(first, [], "_at", ["_place", *ties, F.col("source").asc_nulls_last()], "_all")
    position = F.col("_all_rank") - 1
    shard = F.expr(f"div((_all_rank - 1) * {shards}, _all_rows)")
    start = F.expr(f"div(_shard * _all_rows + {shards - 1}, {shards})")
    return (
        order.withColumn("_shard", shard).withColumn("shard", F.col("_shard").cast("int")).withColumn("slot", position - start)
        .drop("_place", "_at", "_source_rank", "_source_rows", "_all_rank", "_all_rows", "_shard")
    )


def op4_stratified_shards(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_digest")
    )
    rows = interleave(staged(numbered_copies(rows, "_copy"), "shard-rows"), keys=("doc_id", "_digest", "_copy"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT doc_id, source, md5(encode(coalesce(text, ''))) AS digest, row_number() OVER (PARTITION BY doc_id, source, md5(encode(coalesce(text, '')))) - 1 AS copy, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), h AS (
  SELECT *, (CAST(CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || copy), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM d
), a AS (
  SELECT *, (CAST(row_number() OVER (PARTITION BY source ORDER BY u, doc_id NULLS LAST, digest, copy) AS DOUBLE) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS place FROM h
), o AS (
  SELECT *, row_number() OVER (ORDER BY place, u, doc_id NULLS LAST, digest, copy, source NULLS LAST) - 1 AS pos, count(*) OVER () AS n FROM a
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * 8 // n AS INTEGER) AS shard, pos - (pos * 8 // n * n + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o
"""

QUERIES = {"op4_stratified_shards": op4_stratified_shards}
ORACLES = {"op4_stratified_shards": SQL}
