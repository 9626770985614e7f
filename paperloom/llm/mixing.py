"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of all words, at most ``max_copies`` times its own
size, the excess reshared by weight.  A document of a source with target/size = rho is taken floor(rho) times
for certain; the rest of the source's target is filled by Pareto order sampling: documents are ranked by the
odds of a random number over the odds of their inclusion probability, and the ranks are taken in order until
the words taken come nearest to the target.  Optional per-document weights make the probabilities unequal.

Ranks are cut without putting a source in one task: words are summed for each of many equal cells of the rank, more of
them for more rows, the sums are accumulated over a row a cell, and rows are only ordered within their cell.  What tells
rows apart goes into the random number: in the query the id, the text's digest, and a number among equal rows, so that
rows with one id or none are spread like others.

In the query documents are weighted too: longer ones are somewhat less likely (``length_weight``), by whole numbers.

Defined results: null text has size 0; the null source is a source of its own, after all others; a source
without words takes nothing; ties of the rank go to the smaller id; an empty input gives an empty output; in ``mix``
rows of equal keys are drawn together, each counted, in the query repeated rows are drawn one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD_PATTERN, documents, numbered_copies, staged, unit_hash

CELLS, CELL_ROWS = 4096, 100_000  # at least so many cells, and more of them for more rows


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """source, source_size -> adds weight and target.  Its rows are the sources.

    Sources fill up in the order of cap/weight: those whose cap is below the level that the rest would get are
    capped, which is the fixed point of resharing the excess.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(pattern, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_copies)
    everything = Window.partitionBy(F.lit(1))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*", F.sum("source_size").over(everything).alias("_all"), F.sum("weight").over(everything).alias("_weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("_capped"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_capped_weight"),
    )
    left, weight_left = F.col("_all") - F.col("_capped"), F.col("_weights") - F.col("_capped_weight")
    level = level.withColumn("_full", F.col("cap") * weight_left <= F.col("weight") * left)
    # the first source that is not full has the highest level, and it holds for all that follow
    level = level.withColumn("_level", F.max(F.when(~F.col("_full"), left.cast("double") / weight_left)).over(everything))
    return level.select(
        "source", "source_size", "weight",
        F.when(F.col("_full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("_level")).alias("target"),
    )


def mix(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3, seed: str = "mix", weight_col: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows (doc_id, source, size[, weight_col, keys]) -> doc_id, source, size, source_size, target, copies, taken; the keys tell rows of one id apart."""
    cells_ = max(CELLS, rows.count() // CELL_ROWS)
    extra = [*([F.col(weight_col).cast("double").alias("w")] if weight_col else []), *keys]
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("size").cast("bigint").alias("size"), *extra)
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    targets = targets.withColumnRenamed("source", "_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if weight_col:  # expected copies follow the weights, and never pass max_copies
        mean = rows.groupBy("source").agg(F.sum(F.col("w") * F.col("size")).alias("_wsize")).withColumnRenamed("source", "_wsource")
        targets = targets.join(mean, targets["_source"].eqNullSafe(mean["_wsource"])).drop("_wsource")
        expected = F.when(F.col("_wsize") > 0, F.least(F.col("target") * F.col("w") / F.col("_wsize"), F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    drawn = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    drawn = drawn.withColumn("_expected", expected).withColumn("_base", F.floor("_expected"))
    p = F.col("_expected") - F.col("_base")
    odds = F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))
    drawn = drawn.withColumn("_p", p).withColumn("_u", unit_hash(seed, F.col("doc_id"), *[F.col(k) for k in keys]))
    # what is taken a whole number of times is not drawn: it stands anywhere, and adds nothing to the ranks
    drawn = drawn.withColumn("_rank", F.when(F.col("_p") > 0, odds / (1 + odds)).otherwise(F.col("_u"))).withColumn("_drawn", F.when(F.col("_p") > 0, F.col("size")).otherwise(0))
    drawn = drawn.withColumn("_cell", F.least(F.floor(F.col("_rank") * cells_), F.lit(cells_ - 1)))
    cells = drawn.groupBy("source", "_cell").agg(F.sum("_drawn").alias("_words"), F.sum(F.col("_base") * F.col("size")).alias("_sure"))
    over = Window.partitionBy("source").orderBy("_cell")
    cells = cells.select(
        F.col("source").alias("_s"), F.col("_cell").alias("_c"),
        (F.sum("_words").over(over) - F.col("_words")).alias("_before"), F.sum("_sure").over(Window.partitionBy("source")).alias("_certain"),
    )
    within = Window.partitionBy("source", "_cell").orderBy("_rank", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = drawn.withColumn("_in_cell", F.sum("_drawn").over(within))
    ordered = ordered.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    after = F.col("_before") + F.col("_in_cell")
    # taking a row brings the sum nearer to the target only while the target is past the row's middle
    nearer = (F.col("_p") > 0) & (2 * after - F.col("size") < 2 * (F.col("target") - F.col("_certain")))
    copies = (F.col("_base") + F.when(nearer, 1).otherwise(0)).cast("bigint")
    return ordered.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, size in words, of documents, and further columns."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", words.alias("size"), *more)


def length_weight(size):
    """12 for documents of under 100 words, down to 8 from 400 words on."""
    return F.lit(12) - F.least(F.lit(4), F.floor(size / 100))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = sized(docs, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_digest"))
    rows = staged(numbered_copies(rows, "_copy").withColumn("_weight", length_weight(F.col("size"))), "mix-sizes")
    return mix(rows, weight_col="_weight", keys=("_digest", "_copy")).drop("copies", "source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(encode(coalesce(text, ''))) AS digest, row_number() OVER (PARTITION BY doc_id, source, md5(encode(coalesce(text, '')))) - 1 AS copy, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum((12 - least(4, size // 100)) * size) AS DOUBLE) AS wsize FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest_weight
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * rest_weight <= weight * rest AS is_full FROM l
), t AS (
  SELECT source, source_size, wsize,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE)
      ELSE weight * max(CASE WHEN NOT is_full THEN CAST(rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END) OVER () END AS target FROM f
), e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.wsize > 0 THEN least(t.target * CAST(12 - least(4, d.size // 100) AS DOUBLE) / t.wsize, 3.0) ELSE 0.0 END AS rho,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || digest || ':' || copy), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, CAST(floor(rho) AS BIGINT) AS base, rho - floor(rho) AS p FROM e
), o AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u) / (p / (1 - p))) / (1 + u / (1 - u) / (p / (1 - p))) ELSE 1.0 END AS rnk FROM r
), c AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rnk, doc_id, size ROWS UNBOUNDED PRECEDING) AS after, sum(base * size) OVER (PARTITION BY source) AS sure FROM o
)
SELECT doc_id, size, source_size, target,
  CAST((base + CASE WHEN p > 0 AND 2 * after - size < 2 * (target - sure) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""

QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES = {"op9_mix_sources": SQL}
