"""Tables over several pages: roles, regions, column structure and concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAINS = {"LAST": ("LAST", "CONTINUATION", "FIRST"), "CONTINUATION": ("CONTINUATION", "FIRST"), "FIRST": ("FIRST",)}


def primary_role(page: Column, pages: Column) -> Column:
    return F.when(page == 1, "FIRST").when(page == pages, "LAST").otherwise("CONTINUATION")


def has_role(page: Column, pages: Column, role: Column) -> Column:
    """A document of one page is its first and its last page."""
    return F.when(role == "FIRST", page == 1).when(role == "LAST", page == pages).otherwise((page > 1) & (page < pages))


def region_role(page: Column, pages: Column, available: Column) -> Column:
    """The region that a page reads: its own role's, else one that comes before; a single page takes any."""
    role = primary_role(page, pages)
    pick = lambda chain: F.get(F.filter(F.array(*map(F.lit, chain)), lambda r: F.array_contains(available, r)), F.lit(0))
    found = F.when(role == "LAST", pick(CHAINS["LAST"])).when(role == "CONTINUATION", pick(CHAINS["CONTINUATION"])).otherwise(pick(CHAINS["FIRST"]))
    return F.when(pages == 1, pick(("FIRST", "LAST", "CONTINUATION"))).otherwise(found)


def scalar_page(role: Column, pages: Column) -> Column:
    """The page on which a scalar of the role is read, null if there is none."""
    return F.when(role == "LAST", pages).when(role == "CONTINUATION", F.when(pages >= 3, 2)).otherwise(F.lit(1))


#: What a column's canonical structure says; its geometry is the region's own.
STRUCTURE = ("sub_property", "data_type", "is_anchor", "table_header", "line_select", "line_picks", "line_separator", "line_offset")


def resolve_structure(canonical: DataFrame, region: DataFrame, key: str) -> DataFrame:
    """The region's columns by ordinal with the canonical structure, as far as both tables carry its columns.

    Unequal counts keep the region's own and say so (``mismatch``); a region without a canonical structure keeps its own too.
    """
    order, all_of = Window.partitionBy(key).orderBy("sort_order"), Window.partitionBy(key)
    said = [c for c in STRUCTURE if c in canonical.columns and c in region.columns]
    left = canonical.withColumn("ordinal", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(all_of))
    left = left.select(key, "ordinal", "_n", F.struct(*said, "sort_order").alias("_c"))
    right = region.withColumn("ordinal", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(all_of))
    both = right.join(left, [key, "ordinal"], "left").withColumn("_n", F.max("_n").over(all_of))  # null: no structure to impose
    same = F.coalesce(F.col("_n") == F.col("_m"), F.lit(False))
    merged = [F.when(same, F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) for c in (*said, "sort_order")]
    others = [c for c in region.columns if c not in (*said, key, "sort_order")]
    return both.select(key, "ordinal", *merged, *others, F.coalesce(F.col("_n") != F.col("_m"), F.lit(False)).alias("mismatch"))


def concatenate(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_rows, n_pages, confidence of page tables (key, page, n_rows, confidence): pages without rows are skipped."""
    full = pages.where("n_rows > 0")
    mean = F.bround(F.avg(F.col("confidence").cast("decimal(38,18)")), 4)
    return full.groupBy(key).agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_pages"), mean.alias("confidence"))


def page_runs(rows: DataFrame, key: str, order: str, page: str) -> DataFrame:
    """key, page, first, n: consecutive rows of one page."""
    over = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((F.col(page) != F.lag(page).over(over)).cast("int"), F.lit(1))
    marked = rows.withColumn("_at", F.row_number().over(over) - 1).withColumn("_run", F.sum(change).over(over))
    return marked.groupBy(key, "_run").agg(F.first(page).alias("page"), F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).drop("_run")
