"""Queries of the template mapping engine over rendered invoices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from paperloom.operators import mapping as M
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog
from paperloom.plans.text_queries import ORDER_SQL, date_sql, number_sql
from paperloom.schema import ColumnSpec, FieldSpec, StepSpec, TemplateSpec

CATALOG = Catalog()
query = CATALOG.query
LEAST = Decimal("0.70")
INVOICE = TemplateSpec(1, (
    FieldSpec(1, "invoice_id", key_pattern="^invoice no$", required=True, min_confidence=LEAST), FieldSpec(2, "invoice_date", data_type="DATE", key_pattern="^date$", required=True, min_confidence=LEAST),
    FieldSpec(3, "total", data_type="DECIMAL", key_pattern="^total$", required=True, min_confidence=LEAST), FieldSpec(4, "due_text", "REGEX", regex=r"Due Date: (\S+)", min_confidence=LEAST),
    FieldSpec(5, "currency", "CONSTANT", default_value="THB", steps=(StepSpec("case", {"mode": "lower"}),)),
    FieldSpec(6, "line_item", "TABLE_CELL", table_header="QTY", columns=(ColumnSpec("qty", "INT", "qty", 1), ColumnSpec("description", "STRING", "Description", 2), ColumnSpec("amount", "DECIMAL", " AMOUNT ", 3), ColumnSpec("none", "STRING", "no such", 4))),
))


def avg4_sql(x: str) -> str:
    """The mean of four-place decimals, half-even to four places, in whole numbers."""
    n, t = f"count({x})", f"CAST(sum(CAST({x} * 10000 AS BIGINT)) AS BIGINT)"
    return f"(({t} // {n} + CASE WHEN 2 * ({t} % {n}) > {n} THEN 1 WHEN 2 * ({t} % {n}) = {n} THEN ({t} // {n}) % 2 ELSE 0 END) / CAST(10000 AS DOUBLE))"


KEYED = ", keyed AS (SELECT *, CASE WHEN instr(content, ':') > 1 THEN trim(substring(content, 1, instr(content, ':') - 1)) END AS key, CASE WHEN instr(content, ':') > 1 THEN trim(substring(content, instr(content, ':') + 1)) END AS value FROM blocks)"


@query("property_map", f"WITH {I.BLOCKS_SQL}{KEYED} SELECT doc_id, lower(key) AS property, arg_max(value, block_id) AS value FROM keyed WHERE key IS NOT NULL GROUP BY 1, 2")
def property_map(spark, sf):
    return M.property_map(I.blocks(spark, sf))


_KV = "SELECT doc_id, arg_min(value, block_id) AS value, arg_min(confidence, block_id) AS conf, min(block_id) AS block_id FROM keyed WHERE regexp_matches(key, '{p}', 'i') GROUP BY doc_id"


@query(
    "kv_first_match",
    f"""WITH {I.BLOCKS_SQL}{KEYED}, i AS ({_KV.format(p='^invoice no$')}), t AS ({_KV.format(p='^total$')}), d AS (SELECT DISTINCT doc_id FROM blocks)
    SELECT doc_id, i.value AS invoice_id, CAST(i.conf AS DOUBLE) AS invoice_conf, 'TextBlock:' || i.block_id AS invoice_ref, coalesce({number_sql('t.value')}, t.value) AS total, CAST(coalesce(t.conf, 0) AS DOUBLE) AS total_conf
    FROM d LEFT JOIN i USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def kv_first_match(spark, sf):
    wide = M.resolve_blocks([INVOICE.fields[0], INVOICE.fields[2]], I.blocks(spark, sf))
    return wide.select("doc_id", F.col("f1.normalized").alias("invoice_id"), F.col("f1.confidence").cast("double").alias("invoice_conf"), F.col("f1.source_ref").alias("invoice_ref"), F.col("f3.normalized").alias("total"), F.col("f3.confidence").cast("double").alias("total_conf"))


@query(
    "full_text_regex",
    f"""WITH {I.BLOCKS_SQL}, t AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY page, block_id) AS text, CAST({avg4_sql('confidence')} AS DOUBLE) AS conf FROM blocks GROUP BY doc_id)
    SELECT doc_id, translate(regexp_extract(text, 'Due Date: (\\S+)', 1), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS due, CASE WHEN regexp_matches(text, 'Thank \\w+') THEN regexp_extract(text, 'Thank \\w+') END AS thanks, round(conf, 4) AS conf FROM t""",
)
def full_text_regex(spark, sf):
    fields = [INVOICE.fields[3], FieldSpec(7, "thanks", "REGEX", regex=r"Thank \w+")]
    wide = M.resolve_blocks(fields, I.blocks(spark, sf))
    return wide.select("doc_id", F.col("f4.normalized").alias("due"), F.col("f7.normalized").alias("thanks"), F.col("f4.confidence").cast("double").alias("conf"))


@query("full_text", f"WITH {I.BLOCKS_SQL} SELECT doc_id, md5(string_agg(content, chr(10) ORDER BY page, block_id)) AS text_md5 FROM blocks GROUP BY doc_id")
def full_text(spark, sf):
    return M.full_text(I.blocks(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


def _table_cell(name, selector, sql):
    @query(name, f"WITH {I.CELLS_SQL}, d AS (SELECT * FROM cells WHERE NOT is_header AND col_idx = 1) {sql}")
    def run(spark, sf):
        field = FieldSpec(8, "qty", "TABLE_CELL", "INT", table_header=" qty", row_selector=selector)
        wide = M.resolve_cells([field], I.cells(spark, sf))
        return wide.select("doc_id", F.col("f8.raw").alias("raw"), F.col("f8.normalized").alias("normalized"), F.col("f8.confidence").cast("double").alias("conf"))


for _name, _selector, _pick in (("table_cell_first", None, "arg_min"), ("table_cell_last", "LAST", "arg_max")):
    _raw = f"{_pick}(content, row_idx)"
    _table_cell(_name, _selector, f", p AS (SELECT doc_id, {_raw} AS raw, {_pick}(confidence, row_idx) AS conf FROM d GROUP BY doc_id) SELECT doc_id, raw, coalesce(regexp_replace({number_sql('raw')}, '\\.[0-9]*$', ''), raw) AS normalized, CAST(conf AS DOUBLE) AS conf FROM p")
_table_cell("table_cell_all", "ALL", "SELECT doc_id, string_agg(content, ' | ' ORDER BY row_idx) AS raw, string_agg(content, ' | ' ORDER BY row_idx) AS normalized, " + avg4_sql('confidence') + " AS conf FROM d GROUP BY doc_id")

_ITEMS = f"""items AS (
  SELECT doc_id, row_idx, max(CASE WHEN col_idx = 1 THEN coalesce(regexp_replace({number_sql('content')}, '\\.[0-9]*$', ''), translate(content, '๐๑๒๓๔๕๖๗๘๙', '0123456789')) END) AS qty,
    max(CASE WHEN col_idx = 2 THEN content END) AS description, max(CASE WHEN col_idx = 4 THEN {number_sql('content')} END) AS amount
  FROM cells WHERE NOT is_header GROUP BY 1, 2
), table_conf AS (
  SELECT doc_id, CAST({avg4_sql('confidence')} AS DECIMAL(5,4)) AS conf, CAST(max(row_idx) AS INTEGER) AS n_rows FROM cells WHERE NOT is_header AND col_idx <> 3 GROUP BY doc_id
)"""


@query("line_item_array", f"WITH {I.CELLS_SQL}, {_ITEMS} SELECT doc_id, row_idx, qty, description, amount, CAST(NULL AS VARCHAR) AS missing, CAST(conf AS DOUBLE) AS conf, n_rows FROM items JOIN table_conf USING (doc_id)")
def line_item_array(spark, sf):
    rows = M.field_rows(INVOICE.fields[5], I.cells(spark, sf))
    return rows.select("doc_id", "row_idx", "qty", "description", "amount", F.col("none").alias("missing"), F.col("confidence").cast("double").alias("conf"), "n_rows")


@query("line_item_json", f"""WITH {I.CELLS_SQL}, {_ITEMS} SELECT doc_id, md5('[' || string_agg('{{"qty":' || CASE WHEN regexp_matches(qty, '^-?[0-9]+$') THEN qty ELSE '"' || qty || '"' END || ',"description":"' || description || '","amount":' || amount || ',"none":null}}', ',' ORDER BY row_idx) || ']') AS json_md5 FROM items GROUP BY doc_id""")
def line_item_json(spark, sf):
    rows = M.field_rows(INVOICE.fields[5], I.cells(spark, sf))
    return M.items_json(rows, INVOICE.fields[5]).select("doc_id", F.md5("items").alias("json_md5"))


@query("constant_and_default", f"WITH {I.BLOCKS_SQL} SELECT DISTINCT doc_id, 'THB' AS currency, CAST(1 AS DOUBLE) AS currency_conf, 'n/a' AS missing, CAST(0 AS DOUBLE) AS missing_conf FROM blocks")
def constant_and_default(spark, sf):
    wide = M.resolve_blocks([FieldSpec(5, "currency", "CONSTANT", default_value="THB"), FieldSpec(9, "missing", key_pattern="^never$", default_value="n/a")], I.blocks(spark, sf))
    return wide.select("doc_id", F.col("f5.normalized").alias("currency"), F.col("f5.confidence").cast("double").alias("currency_conf"), F.col("f9.normalized").alias("missing"), F.col("f9.confidence").cast("double").alias("missing_conf"))


_LONG = f""", i AS ({_KV.format(p='^invoice no$')}), t AS ({_KV.format(p='^total$')}), dt AS ({_KV.format(p='^date$')}),
ft AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY page, block_id) AS text, CAST({avg4_sql('confidence')} AS DECIMAL(5,4)) AS conf FROM blocks GROUP BY doc_id),
long AS (
  SELECT ft.doc_id, 1 AS field_id, i.value AS normalized, i.conf AS conf, TRUE AS required FROM ft LEFT JOIN i USING (doc_id)
  UNION ALL SELECT ft.doc_id, 2, {date_sql('dt.value', 'o.ord')}, dt.conf, TRUE FROM ft LEFT JOIN dt USING (doc_id) LEFT JOIN orders_of o USING (doc_id)
  UNION ALL SELECT ft.doc_id, 3, {number_sql('t.value')}, coalesce(t.conf, 0), TRUE FROM ft LEFT JOIN t USING (doc_id)
  UNION ALL SELECT doc_id, 4, translate(regexp_extract(text, 'Due Date: (\\S+)', 1), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), conf, FALSE FROM ft
  UNION ALL SELECT doc_id, 5, 'thb', CAST(1 AS DECIMAL(5,4)), FALSE FROM ft
  UNION ALL SELECT ft.doc_id, 6, CASE WHEN c.n_rows IS NULL THEN '[]' ELSE 'rows:' || c.n_rows END, c.conf, FALSE FROM ft LEFT JOIN table_conf c USING (doc_id)
), marked AS (SELECT *, coalesce(conf < CASE WHEN field_id < 5 THEN 0.70 ELSE 0.60 END, FALSE) AS below FROM long)"""
_OUT = f"SELECT doc_id, CAST({avg4_sql('conf')} AS DOUBLE) AS overall_confidence, bool_or(below) OR bool_or(required AND coalesce(trim(normalized), '') = '') AS needs_review FROM marked GROUP BY doc_id"
FULL_SQL = f"WITH {ORDER_SQL}{KEYED}, {I.CELLS_SQL.strip()}, {_ITEMS}{_LONG}"


def mapped(spark, sf):
    return M.map_documents(INVOICE, I.blocks(spark, sf), I.cells(spark, sf))


@query("threshold_flags", f"{FULL_SQL} SELECT doc_id, field_id, below, CAST(conf AS DOUBLE) AS conf FROM marked")
def threshold_flags(spark, sf):
    return mapped(spark, sf).select("doc_id", "field_id", "below", F.col("confidence").cast("double").alias("conf"))


@query("mapped_values", f"{FULL_SQL} SELECT doc_id, field_id, normalized FROM marked")
def mapped_values(spark, sf):
    rows = F.regexp_extract("source_ref", "(rows:[0-9]+)$", 1)
    return mapped(spark, sf).select("doc_id", "field_id", F.when((F.col("field_id") == 6) & (F.col("normalized") != "[]"), rows).otherwise(F.col("normalized")).alias("normalized"))


@query("overall_confidence", f"{FULL_SQL} SELECT doc_id, overall_confidence FROM ({_OUT})")
def overall_confidence(spark, sf):
    return M.outcomes(mapped(spark, sf)).select("doc_id", F.col("overall_confidence").cast("double").alias("overall_confidence"))


@query("needs_review", f"{FULL_SQL} SELECT CASE WHEN needs_review THEN 'NEEDS_REVIEW' ELSE 'MAPPED' END AS status, count(*) AS n FROM ({_OUT}) GROUP BY 1")
def needs_review(spark, sf):
    return M.outcomes(mapped(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_ocr_first",
    f"""{FULL_SQL}, o AS ({_OUT}) SELECT doc_id, max(CASE WHEN field_id = 1 THEN normalized END) AS invoice_id, max(CASE WHEN field_id = 2 THEN normalized END) AS invoice_date,
      max(CASE WHEN field_id = 3 THEN normalized END) AS total, max(o.overall_confidence) AS overall_confidence, bool_or(o.needs_review) AS needs_review FROM marked JOIN o USING (doc_id) GROUP BY doc_id""",
)
def map_ocr_first(spark, sf):
    """Invoice id, date, total, confidence and routing of every rendered invoice: the flagship."""
    wide = M.with_outcome(INVOICE, M.map_wide(INVOICE, I.blocks(spark, sf), I.cells(spark, sf)))
    return wide.select(
        "doc_id", F.col("e0.normalized").alias("invoice_id"), F.col("e1.normalized").alias("invoice_date"), F.col("e2.normalized").alias("total"),
        F.col("overall_confidence").cast("double").alias("overall_confidence"), "needs_review",
    )


@query("mapped_json", f"""{FULL_SQL} SELECT doc_id, '{{"invoice_id":"' || max(CASE WHEN field_id = 1 THEN normalized END) || '","invoice_date":' || coalesce('"' || max(CASE WHEN field_id = 2 THEN normalized END) || '"', 'null') || ',"total":' || coalesce(max(CASE WHEN field_id = 3 THEN normalized END), 'null') || '}}' AS mapped_json FROM marked GROUP BY doc_id""")
def mapped_json(spark, sf):
    return M.mapped_json(M.map_documents(TemplateSpec(2, INVOICE.fields[:3]), I.blocks(spark, sf), I.cells(spark, sf)))


ZONAL = TemplateSpec(3, (
    FieldSpec(1, "invoice_id", "ZONE", required=True), FieldSpec(2, "invoice_date", "ZONE", "DATE", required=True), FieldSpec(3, "total", "ZONE", "DECIMAL", default_value="0.00"),
    FieldSpec(10, "line_item", "TABLE_CELL", required=True, page_role="FIRST"), FieldSpec(11, "Line_Item", "TABLE_CELL", page_role="CONTINUATION"),
), "ZONAL")
_ZONAL = f"""WITH {ORDER_SQL}, {I.LINES_SQL.strip()}, z AS (
  SELECT doc_id, block_id AS field_id, trim(substring(content, instr(content, ':') + 1)) AS raw, confidence AS conf FROM blocks WHERE block_id IN (1, 2)
  UNION ALL SELECT doc_id, 3, trim(substring(content, instr(content, ':') + 1)), confidence FROM blocks WHERE block_id = 4
), zt AS (
  SELECT l_orderkey AS doc_id, CASE WHEN row_idx <= 5 THEN 10 ELSE 11 END AS field_id, CAST(count(*) AS INTEGER) AS n_rows FROM numbered GROUP BY 1, 2
), d AS (SELECT doc_id FROM z UNION SELECT doc_id FROM zt), ord_of AS (
  SELECT doc_id, arg_min(vote, field_id) AS ord FROM (SELECT doc_id, field_id, CASE WHEN TRY_CAST(regexp_extract(translate(raw, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '([0-9]{{1,2}})\\s*[/\\-.]\\s*([0-9]{{1,2}})\\s*[/\\-.]\\s*([0-9]{{2,4}})', 1) AS INTEGER) > 12 THEN 'D'
    WHEN TRY_CAST(regexp_extract(translate(raw, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '([0-9]{{1,2}})\\s*[/\\-.]\\s*([0-9]{{1,2}})\\s*[/\\-.]\\s*([0-9]{{2,4}})', 2) AS INTEGER) > 12 THEN 'M' END AS vote FROM z) WHERE vote IS NOT NULL GROUP BY doc_id
), zlong AS (
  SELECT d.doc_id, f.field_id, CASE WHEN z.raw IS NULL AND zt.n_rows IS NULL THEN f.def WHEN f.field_id >= 10 THEN 'rows:' || zt.n_rows WHEN f.field_id = 1 THEN z.raw WHEN f.field_id = 2 THEN {date_sql('z.raw', 'q.ord')} ELSE {number_sql('z.raw')} END AS normalized,
    CASE WHEN z.raw IS NULL AND zt.n_rows IS NULL THEN 0 ELSE coalesce(z.conf, 0.9) END AS conf, f.field_id = 11 AND zt.n_rows IS NULL AND EXISTS (SELECT 1 FROM zt b WHERE b.doc_id = d.doc_id)
    OR f.field_id = 10 AND zt.n_rows IS NULL AND EXISTS (SELECT 1 FROM zt b WHERE b.doc_id = d.doc_id) AS skipped
  FROM d CROSS JOIN (VALUES (1, NULL), (2, NULL), (3, '0.00'), (10, NULL), (11, NULL)) f(field_id, def) LEFT JOIN z ON z.doc_id = d.doc_id AND z.field_id = f.field_id LEFT JOIN zt ON zt.doc_id = d.doc_id AND zt.field_id = f.field_id LEFT JOIN ord_of q ON q.doc_id = d.doc_id
)"""


def zonal(spark, sf):
    read = M.split_key(I.blocks(spark, sf)).where("block_id in (1, 2, 4)")
    scalars = read.select("doc_id", F.when(F.col("block_id") == 4, 3).otherwise(F.col("block_id")).cast("int").alias("field_id"), F.col("value").alias("raw"), "confidence")
    rows = I.lines(spark, sf).groupBy(F.col("l_orderkey").alias("doc_id"), F.when(F.col("row_idx") <= 5, 10).otherwise(11).alias("field_id")).agg(F.count(F.lit(1)).cast("int").alias("n_rows"))
    tables = rows.select("doc_id", "field_id", F.concat(F.lit("rows:"), F.col("n_rows")).alias("items_json"), "n_rows", F.lit(0.9).cast("decimal(5,4)").alias("confidence"))
    return M.map_zonal(ZONAL, scalars, tables)


@query("map_zonal", f"{_ZONAL} SELECT doc_id, field_id, normalized, CAST(conf AS DOUBLE) AS conf, conf < 0.6 AS below FROM zlong WHERE NOT skipped")
def map_zonal(spark, sf):
    return zonal(spark, sf).select("doc_id", "field_id", "normalized", F.col("confidence").cast("double").alias("conf"), "below")


@query("zonal_sibling_skip", f"{_ZONAL} SELECT doc_id, count(*) AS emitted FROM zlong WHERE field_id >= 10 AND NOT skipped GROUP BY doc_id")
def zonal_sibling_skip(spark, sf):
    return zonal(spark, sf).where("field_id >= 10").groupBy("doc_id").agg(F.count(F.lit(1)).alias("emitted"))
