"""Queries of documents built from zones, of recognizer payloads and of stored extractions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import percent
from paperloom.operators import records as R
from paperloom.operators import zonal as Z
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog
from paperloom.schema import ColumnSpec, FieldSpec, TemplateSpec
from paperloom.session import fresh_folder
from paperloom.sources import capture as C

CATALOG = Catalog()
query = CATALOG.query
PAGE = (0.0, 0.0, 1.0, 1.0)
COLUMNS = (
    ColumnSpec("qty", "INT", sort_order=1, x_start=0.04, x_end=0.12, is_anchor=True), ColumnSpec("description", "STRING", sort_order=2, x_start=0.15, x_end=0.6),
    ColumnSpec("amount", "DECIMAL", sort_order=3, x_start=0.8, x_end=1.0), ColumnSpec("size", "STRING", sort_order=4, x_start=0.15, x_end=0.6, line_select="ANCHOR", line_offset=1),
)
TEMPLATE = TemplateSpec(4, (
    FieldSpec(1, "invoice_id", "ZONE", zone=PAGE), FieldSpec(2, "total", "ZONE", "DECIMAL", zone=PAGE, page_role="LAST"), FieldSpec(3, "unzoned", "ZONE"), FieldSpec(4, "middle", "ZONE", default_value="none", page_role="CONT", zone=PAGE),
    FieldSpec(10, "line_item", "TABLE_CELL", columns=COLUMNS, page_role="FIRST", zone=PAGE),
    FieldSpec(11, "Line_Item", "TABLE_CELL", columns=tuple(ColumnSpec(f"other{i}", "STRING", sort_order=c.sort_order, x_start=c.x_start, x_end=c.x_end) for i, c in enumerate(COLUMNS)), page_role="CONTINUATION", zone=PAGE),
), "ZONAL")
SINGLE = TemplateSpec(5, (*TEMPLATE.fields[:3], TEMPLATE.fields[4]), "ZONAL")
ITEM_SQL = """'{"qty":' || CAST(l_quantity AS INTEGER) || ',"description":"Part ' || l_partkey || CASE WHEN row_idx % 2 = 0 THEN ' size ' || l_suppkey ELSE '' END || '","amount":' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ',"size":' || CASE WHEN row_idx % 2 = 0 THEN '"size ' || l_suppkey || '"' ELSE 'null' END"""
LAST_SQL = ITEM_SQL.replace("ELSE 'null' END", "WHEN row_idx = n THEN '\"FCA FACTORY\"' ELSE 'null' END")


def words(spark, sf):
    conf = ((F.col("word_id") % 40 + 60).cast("decimal(10,0)") / 100).cast("decimal(5,4)")
    return I.words(spark, sf).withColumn("conf", conf)


def scalars(spark, sf):
    """Zone reads: the number on the first page, a total on each."""
    docs = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("t"))
    reads = docs.join(I.pages(spark, sf), "doc_id")
    one = reads.where("page = 1").select("doc_id", F.lit(1).alias("field_id"), "page", F.concat(F.lit("US-"), "doc_id").alias("raw"))
    total = reads.select("doc_id", F.lit(2).alias("field_id"), "page", F.concat(F.lit("p"), "page", F.lit(": "), "t").alias("raw"))
    middle = reads.select("doc_id", F.lit(4).alias("field_id"), "page", F.concat(F.lit("page "), "page").alias("raw"))
    return one.unionByName(total).unionByName(middle).withColumn("confidence", F.lit(0.8).cast("decimal(5,4)"))


@query(
    "zonal_table_rows",
    f"""WITH {I.LINES_SQL}, e AS (SELECT l_orderkey AS doc_id, row_idx AS row, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty, 'Part ' || l_partkey || CASE WHEN row_idx % 2 = 0 THEN ' size ' || l_suppkey ELSE '' END AS description,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, CASE WHEN row_idx % 2 = 0 THEN 'size ' || l_suppkey WHEN row_idx = count(*) OVER (PARTITION BY l_orderkey) THEN 'FCA FACTORY' END AS size FROM numbered) SELECT *, CASE WHEN size IS NULL THEN 3 ELSE 4 END AS conf_n FROM e""",
)
def zonal_table_rows(spark, sf):
    """Rows of a region: cells by words, anchored lines, footers dropped; a cell without text counts for nothing.

    A dropped footer is no neighbour: what the last row's anchored column finds below may be the footer's line.
    """
    rows = Z.table_rows(words(spark, sf), ["doc_id"], PAGE, list(COLUMNS), consolidate=True)
    return rows.select("doc_id", "row", "qty", "description", "amount", "size", F.col("conf_n").cast("int").alias("conf_n"))


@query(
    "zonal_read_cells",
    f"""WITH {I.LINES_SQL} SELECT l_orderkey AS doc_id, row_idx AS row, CASE WHEN row_idx % 3 = 0 THEN '77' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty,
      CASE WHEN row_idx % 3 = 0 THEN 'read ' || row_idx ELSE 'Part ' || l_partkey || CASE WHEN row_idx % 2 = 0 THEN ' size ' || l_suppkey ELSE '' END END AS description FROM numbered""",
)
def zonal_read_cells(spark, sf):
    """What the recognizer read of a cell goes before its words, without shipping annotations; where that leaves nothing, the words."""
    own = words(spark, sf)
    read = I.lines(spark, sf).select(F.col("l_orderkey").alias("doc_id"), F.col("row_idx").alias("band"), F.explode(F.array(F.lit("qty"), F.lit("description"))).alias("column"))
    third = F.col("band") % 3 == 0
    text = F.when(F.col("column") == "qty", F.when(third, "\u0e57\u0e57").otherwise(" ")).otherwise(F.when(third, F.concat(F.lit("Warehouse 5\nread "), "band")).otherwise(F.lit("Container Number X\n")))
    read = read.withColumn("text", text).withColumn("confidence", F.lit(0.99))
    return Z.table_rows(own, ["doc_id"], PAGE, list(COLUMNS[:2]), read=read, consolidate=True).select("doc_id", "row", "qty", "description")


@query(
    "zonal_single_page",
    f"""WITH {I.LINES_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM numbered), t AS (SELECT l_orderkey AS doc_id, '[' || string_agg({LAST_SQL} || '}}', ',' ORDER BY row_idx) || ']' AS j FROM m GROUP BY 1), p AS (SELECT DISTINCT doc_id FROM t)
    SELECT o_orderkey AS doc_id, 1 AS field_id, 'US-' || o_orderkey AS normalized FROM orders JOIN p ON doc_id = o_orderkey
    UNION ALL SELECT o_orderkey, 2, '1' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders JOIN p ON doc_id = o_orderkey UNION ALL SELECT doc_id, 10, md5(j) FROM t""",
)
def zonal_single_page(spark, sf):
    """Documents read as one page: a field without a zone takes no part."""
    reads = scalars(spark, sf).where("page = 1").drop("page")
    out = Z.single_page(SINGLE, reads, words(spark, sf).withColumn("field_id", F.lit(10)), consolidate=True)
    return out.select("doc_id", "field_id", F.when(F.col("field_id") == 10, F.md5("normalized")).otherwise(F.col("normalized")).alias("normalized"))


@query(
    "multipage_build",
    f"""WITH {I.LINES_SQL}, {I.PAGES_SQL.strip()}, c AS (SELECT DISTINCT doc_id, pages FROM inv_pages), t AS (
      SELECT l_orderkey AS doc_id, '[' || string_agg({ITEM_SQL} || ',"_pg":' || ((row_idx - 1) // 5 + 1) || '}}', ',' ORDER BY row_idx) || ']' AS j FROM numbered GROUP BY 1)
    SELECT doc_id, 1 AS field_id, 'US-' || doc_id AS normalized, CAST(0.8 AS DOUBLE) AS confidence FROM c
    UNION ALL SELECT doc_id, 2, CAST(pages AS VARCHAR) || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), CAST(0.8 AS DOUBLE) FROM c JOIN orders ON o_orderkey = doc_id
    UNION ALL SELECT doc_id, 4, CASE WHEN pages >= 3 THEN 'page 2' ELSE 'none' END, CASE WHEN pages >= 3 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END FROM c
    UNION ALL SELECT doc_id, 10, md5(j), NULL FROM t""",
)
def multipage_build(spark, sf):
    """Documents of several pages: scalars on their role's page, tables by page and region under the first region's structure, put together."""
    page = F.when(F.col("word_id") < 1_000_000, F.expr("cast(div(div(word_id, 4) - 1, 5) + 1 as int)"))
    own = words(spark, sf).withColumn("page", page).where("page is not null")
    own = own.withColumn("field_id", F.when(F.col("page") == 1, 10).otherwise(11))
    out = Z.multi_page(TEMPLATE, I.pages(spark, sf).where("page = 1").select("doc_id", "pages"), scalars(spark, sf), own)
    table = F.col("field_id") == 10
    return out.select("doc_id", "field_id", F.when(table, F.md5("normalized")).otherwise(F.col("normalized")).alias("normalized"), F.when(~table, F.col("confidence").cast("double")).alias("confidence"))


def _payloads(spark, sf):
    """A payload a part: a form field, a line, and a table whose header spans two columns; every second is a later shard."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    n = F.length(name)
    text = F.concat(name, F.lit(" "), size)
    layout = lambda a, b: F.struct(F.array(F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))).alias("segments"), F.lit(0.9).alias("confidence"), F.array().cast("array<struct<x:double,y:double>>").alias("box"))
    zero = F.lit(0)
    key, value = layout(zero, n), layout(n + 1, F.length(text))
    cell = lambda c, span: F.struct(c.alias("layout"), F.lit(1).alias("row_span"), F.lit(span).alias("col_span"))
    table = F.struct(F.lit(0.5).alias("confidence"), F.array(F.array(cell(key, 2), cell(value, 1))).alias("header"), F.array(F.array(cell(value, 1), cell(value, 0), cell(key, 1))).alias("body"))
    page = F.struct(F.array(F.struct(key.alias("name"), value.alias("value")), F.struct(layout(n, n + 1).alias("name"), value.alias("value"))).alias("fields"), F.array(layout(zero, F.length(text))).alias("lines"), F.array(table).alias("tables"))
    parts = I.table(spark, sf, "part")
    return parts.select(F.col("p_partkey").alias("doc_id"), F.struct(text.alias("text"), F.array(page).alias("pages")).cast(C.PAYLOAD).alias("doc"), (F.col("p_partkey") % 2 * 15).cast("int").alias("page_offset"))


@query("payload_blocks", "WITH p AS (SELECT p_partkey AS doc_id, CAST(p_partkey % 2 * 15 + 1 AS INTEGER) AS page, replace(p_name, ':', '') || ': ' || p_size AS kv, p_name || ' ' || p_size AS line FROM part) SELECT doc_id, page, 'VALUE' AS block_type, kv AS content FROM p UNION ALL SELECT doc_id, page, 'LINE', line FROM p")
def payload_blocks(spark, sf):
    return C.payload_blocks(_payloads(spark, sf)).select("doc_id", "page", "block_type", "content")


@query("payload_cells", "SELECT p_partkey AS doc_id, CAST(p_partkey % 2 * 15 + 1 AS INTEGER) AS page, r AS row_idx, c AS col_idx, s AS col_span, r = 0 AS is_header, CASE WHEN is_key THEN p_name ELSE CAST(p_size AS VARCHAR) END AS content FROM part, (VALUES (0, 0, 2, TRUE), (0, 2, 1, FALSE), (1, 0, 1, FALSE), (1, 1, 1, FALSE), (1, 2, 1, TRUE)) v(r, c, s, is_key)")
def payload_cells(spark, sf):
    return C.payload_cells(_payloads(spark, sf)).select("doc_id", "page", "row_idx", "col_idx", "col_span", "is_header", "content")


@query("extraction_round_trip", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, content, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS run_id FROM blocks")
def extraction_round_trip(spark, sf):
    """Two runs of every document are saved, the second failed for a third of them; what loads is the last that succeeded."""
    path, rows = fresh_folder(spark, "extraction"), I.blocks(spark, sf)
    for run in (1, 2):
        own = rows.withColumn("run_id", F.lit(run))
        runs = own.select("doc_id", "run_id").distinct().withColumn("succeeded", (F.lit(run) == 1) | (F.col("doc_id") % 3 != 0))
        C.save_extraction(path, runs, blocks=own)
    return C.load_latest(spark, path, ("blocks",))["blocks"].select("doc_id", "block_id", "content", "run_id")


@query("document_pages", f"WITH {I.PAGES_SQL} SELECT doc_id, page, pages FROM inv_pages WHERE doc_id = 7")
def document_pages(spark, sf):
    return R.children_of(I.pages(spark, sf), "doc_id", 7, ["page"])


@query("document_properties", f"WITH {I.BLOCKS_SQL} SELECT block_id, trim(split_part(content, ':', 1)) AS property, CAST(round_even(CAST(confidence AS DOUBLE) * 100, 0) AS INTEGER) || '%' AS percent FROM blocks WHERE doc_id = 32 AND instr(content, ':') > 1")
def document_properties(spark, sf):
    rows = I.blocks(spark, sf).where("instr(content, ':') > 1").select("doc_id", "block_id", F.trim(F.substring_index("content", ":", 1)).alias("property"), percent(F.col("confidence")).alias("percent"))
    return R.children_of(rows, "doc_id", 32, ["block_id"]).drop("doc_id")


@query("event_log", "WITH e AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS event_id, o_orderstatus AS status FROM orders) SELECT doc_id, event_id, status FROM e UNION ALL SELECT c_custkey, coalesce((SELECT max(event_id) FROM e WHERE doc_id = c_custkey), 0) + 1, 'FAILED' FROM customer")
def event_log(spark, sf):
    events = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("event_id"), F.col("o_orderstatus").alias("status"))
    return R.with_event(events, I.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("FAILED").alias("status")))


@query("active_types", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def active_types(spark, sf):
    return R.active_types(I.table(spark, sf, "nation").withColumn("is_active", F.col("n_regionkey") != 2), "n_name").select("n_nationkey", "n_name")


@query("active_processor", "SELECT p_brand, min(p_partkey) AS p_partkey FROM part WHERE p_size % 2 = 0 GROUP BY p_brand")
def active_processor(spark, sf):
    rows = I.table(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_size") % 2 == 0).alias("is_active"))
    return R.first_active(rows, "p_brand", "p_partkey").select("p_brand", "p_partkey")
