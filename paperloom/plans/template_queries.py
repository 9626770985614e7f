"""Documents of several templates in one plan, over layouts that hold the hard cases, and templates as rows.

The documents come from orders: months first or days first by order, keys in changing letter case, empty values, missing
confidences, documents without blocks or tables, columns with one header twice, two headers over one column, tables
without rows, missing and blank cells, and templates that do not exist.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from paperloom.operators import mapping as M
from paperloom.operators import records as R
from paperloom.operators import templates as X
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog
from paperloom.plans.mapping_queries import avg4_sql
from paperloom.plans.text_queries import _VOTE, date_sql, number_sql
from paperloom.schema import ColumnSpec, FieldSpec, StepSpec, TemplateSpec

CATALOG = Catalog()
query = CATALOG.query
LEAST = Decimal("0.70")
COLUMNS = (ColumnSpec("qty", "INT", "QTY", 1), ColumnSpec("item", "STRING", "Item", 2), ColumnSpec("shipped", "DATE", "shipped", 3), ColumnSpec("amount", "DECIMAL", "amount", 4), ColumnSpec("none", "STRING", "no such", 5))
SPECS = (
    TemplateSpec(1, (
        FieldSpec(1, "invoice_id", key_pattern="^invoice no$", required=True, min_confidence=LEAST), FieldSpec(2, "invoice_date", data_type="DATE", key_pattern="^date$", min_confidence=LEAST),
        FieldSpec(3, "total", data_type="DECIMAL", key_pattern="^total$", default_value="0.00", required=True), FieldSpec(4, "deadline", "REGEX", "DATE", regex=r"deadline: (\S+)"),
        FieldSpec(5, "line_item", "TABLE_CELL", table_header="qty", columns=COLUMNS, min_confidence=LEAST),
    )),
    TemplateSpec(2, (
        FieldSpec(1, "invoice_id", key_pattern="invoice", steps=(StepSpec("case", {"mode": "upper"}, 1), StepSpec("regex_replace", {"pattern": "^US-", "replacement": "#"}, 2))), FieldSpec(2, "first_qty", "TABLE_CELL", "INT", table_header="QTY"),
        FieldSpec(3, "last_ship", "TABLE_CELL", "DATE", table_header="Shipped", row_selector="LAST"), FieldSpec(4, "all_qty", "TABLE_CELL", "INT", table_header="qty", row_selector="ALL"),
        FieldSpec(5, "items", "TABLE_CELL", table_header="Item", row_selector="ALL", default_value="no items"), FieldSpec(6, "first_amount", "TABLE_CELL", "DECIMAL", table_header="AMOUNT", required=True),
    )),
    TemplateSpec(3, (
        FieldSpec(1, "note", "REGEX", regex=r"no \w+ here", default_value="none"), FieldSpec(2, "last_item", "TABLE_CELL", table_header="description", row_selector="LAST", columns=COLUMNS),
        FieldSpec(3, "currency", "CONSTANT", default_value="thb", steps=(StepSpec("case", {"mode": "upper"}),)), FieldSpec(4, "total", data_type="DECIMAL", key_pattern="^total$", steps=(StepSpec("default", {"value": "0"}, 1), StepSpec("number_clean", {"decimals": 1}, 2))),
    )),
)


def hard_documents(spark, sf):
    """doc_id, template_id: a quarter asks for a template that does not exist."""
    k = F.col("o_orderkey")
    return I.table(spark, sf, "orders").select(k.alias("doc_id"), F.when(k % 4 == 3, 9).otherwise(k % 4 + 1).cast("int").alias("template_id"))


def _dated(day, k):
    return F.when(k % 2 == 1, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))


def _confidence(seed, weight):
    return F.when(seed % 7 == 0, None).otherwise((weight % 41 + 55).cast("decimal(10,0)") / 100).cast("decimal(5,4)")


def hard_blocks(spark, sf):
    k, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    lines = F.array(
        F.concat(F.when(k % 3 == 0, "INVOICE NO: US-").otherwise("Invoice no: us-"), k.cast("string")), F.concat(F.lit("Date: "), _dated(F.col("o_orderdate").cast("date"), k)),
        F.when(k % 5 != 0, F.when(k % 2 == 1, "Deadline: 12/31/1999").otherwise("Deadline: 31/12/1999")), F.when(k % 10 == 0, "total:"), F.concat(F.when(k % 4 < 2, "TOTAL: ").otherwise("Total: "), total), F.when(k % 7 == 0, "No colon here"),
    )
    rows = I.table(spark, sf, "orders").where(k % 13 != 0).select(k.alias("doc_id"), F.posexplode(lines).alias("at", "content")).where("content is not null")
    b = F.col("at") + 1
    return rows.select("doc_id", F.lit(1).alias("page"), b.cast("bigint").alias("block_id"), "content", _confidence(F.col("doc_id") + b * 3, F.col("doc_id") * 7 + b * 13).alias("confidence"))


def hard_cells(spark, sf):
    """The cells of a line are made in one pass, those of the header with the first; they stay dealt by order."""
    rows = I.lines(spark, sf).where("l_orderkey % 17 <> 0")
    k, r = F.col("l_orderkey"), F.col("row_idx")
    texts = (
        F.when((k + r) % 4 != 0, F.col("l_quantity").cast("int").cast("string")), F.when(F.col("l_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit("Part "), F.col("l_partkey"))), _dated(F.col("l_shipdate").cast("date"), k),
        F.when(F.col("l_partkey") % 11 == 0, "—").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")), F.when(k % 3 == 0, F.col("l_tax").cast("decimal(18,2)").cast("string")),
    )
    def cell(table, row, column, text, is_header):
        return F.struct(F.lit(table).alias("table_idx"), row.alias("row_idx"), F.lit(column).alias("col_idx"), text.alias("content"), F.lit(is_header).alias("is_header"))

    def head(table, row, column, text, when):
        return cell(table, F.lit(row), column, F.when(when, text), True)

    data = [cell(1, r + 1, column, text, False) for column, text in enumerate(texts, 1)]
    heads = (
        head(0, 0, 1, "Qty", k % 8 == 0), head(0, 0, 2, "Item", k % 8 == 0), head(1, 0, 1, "Qty", k > 0), head(1, 0, 2, "DESCRIPTION", k > 0), head(1, 1, 2, "Item", k % 5 == 0), head(1, 0, 3, "Shipped", k > 0),
        head(1, 0, 4, "AMOUNT", k > 0), head(1, 0, 5, "Amount", k % 3 == 0),
    )
    every = rows.select(k.alias("doc_id"), F.inline(F.when(r == 1, F.array(*heads, *data)).otherwise(F.array(*data)))).where("content is not null")
    seed = F.col("doc_id") + F.col("row_idx") * 3 + F.col("col_idx")
    return every.select("doc_id", "table_idx", "row_idx", "col_idx", "is_header", "content", _confidence(seed, F.col("doc_id") + F.col("row_idx") * 3 + F.col("col_idx") * 5).alias("confidence"))


_CONF = "CASE WHEN ({seed}) % 7 = 0 THEN NULL ELSE CAST(CAST(({weight}) % 41 + 55 AS DECIMAL(10,0)) / 100 AS DECIMAL(5,4)) END"
HARD_SQL = (
    I.LINES_SQL
    + f""",
docs AS (
  SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 3 THEN 9 ELSE CAST(o_orderkey % 4 + 1 AS INTEGER) END AS template_id FROM orders
), ord AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 1 THEN strftime(CAST(o_orderdate AS DATE), '%m/%d/%Y') ELSE strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') END AS day, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total FROM orders WHERE o_orderkey % 13 <> 0
), written AS (
  SELECT k AS doc_id, 1 AS block_id, CASE WHEN k % 3 = 0 THEN 'INVOICE NO: US-' ELSE 'Invoice no: us-' END || k AS content FROM ord UNION ALL SELECT k, 2, 'Date: ' || day FROM ord
  UNION ALL SELECT k, 3, CASE WHEN k % 2 = 1 THEN 'Deadline: 12/31/1999' ELSE 'Deadline: 31/12/1999' END FROM ord WHERE k % 5 <> 0 UNION ALL SELECT k, 4, 'total:' FROM ord WHERE k % 10 = 0
  UNION ALL SELECT k, 5, CASE WHEN k % 4 < 2 THEN 'TOTAL: ' ELSE 'Total: ' END || total FROM ord UNION ALL SELECT k, 6, 'No colon here' FROM ord WHERE k % 7 = 0
), blocks AS (
  SELECT *, {_CONF.format(seed='doc_id + block_id * 3', weight='doc_id * 7 + block_id * 13')} AS confidence FROM written
), line AS (
  SELECT *, l_orderkey AS k, CASE WHEN l_orderkey % 2 = 1 THEN strftime(CAST(l_shipdate AS DATE), '%m/%d/%Y') ELSE strftime(CAST(l_shipdate AS DATE), '%d/%m/%Y') END AS day FROM numbered WHERE l_orderkey % 17 <> 0
), cell AS (
  SELECT k AS doc_id, 1 AS table_idx, row_idx + 1 AS row_idx, 1 AS col_idx, FALSE AS is_header, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS content FROM line WHERE (k + row_idx) % 4 <> 0
  UNION ALL SELECT k, 1, row_idx + 1, 2, FALSE, CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE 'Part ' || l_partkey END FROM line UNION ALL SELECT k, 1, row_idx + 1, 3, FALSE, day FROM line
  UNION ALL SELECT k, 1, row_idx + 1, 4, FALSE, CASE WHEN l_partkey % 11 = 0 THEN '—' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END FROM line
  UNION ALL SELECT k, 1, row_idx + 1, 5, FALSE, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) FROM line WHERE k % 3 = 0
  UNION ALL SELECT k, h.t, h.r, h.c, TRUE, h.name FROM line, (VALUES (0, 0, 1, 'Qty', 8), (0, 0, 2, 'Item', 8), (1, 0, 1, 'Qty', 1), (1, 0, 2, 'DESCRIPTION', 1), (1, 1, 2, 'Item', 5), (1, 0, 3, 'Shipped', 1), (1, 0, 4, 'AMOUNT', 1), (1, 0, 5, 'Amount', 3)) h(t, r, c, name, every)
    WHERE row_idx = 1 AND k % h.every = 0
), cells AS (
  SELECT *, {_CONF.format(seed='doc_id + row_idx * 3 + col_idx', weight='doc_id + row_idx * 3 + col_idx * 5')} AS confidence FROM cell
)"""
)


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_FIELDS = [(t.template_id, f.field_id, f.target_property, f.source_type if not f.columns else "ROWS", f.data_type, f.key_pattern, f.regex, 1 if f.regex and "(" in f.regex else 0, (f.table_header or "").lower() or None, f.row_selector, f.default_value, f.required, f.min_confidence) for t in SPECS for f in t.fields]
_TYPED = f"CASE WHEN coalesce(trim({{x}}), '') = '' THEN NULL WHEN dtype = 'DECIMAL' THEN coalesce({number_sql('{x}')}, trim({{x}})) WHEN dtype = 'INT' THEN coalesce(regexp_replace({number_sql('{x}')}, '\\.[0-9]*$', ''), trim({{x}})) WHEN dtype = 'DATE' THEN coalesce({date_sql('{x}', 'ord')}, trim({{x}})) ELSE trim({{x}}) END"
#: Relational: rows of fields and columns joined with rows of blocks and cells.
MAPPED_SQL = (
    HARD_SQL
    + f""",
fields(template_id, field_id, prop, src, dtype, pat, rx, grp, header, sel, def, req, least) AS (VALUES {', '.join('(' + ', '.join(map(_value, f)) + ')' for f in _FIELDS)}
), cols(spot, name, ctype, header) AS (VALUES {', '.join(f"({i}, '{c.sub_property}', '{c.data_type}', '{c.table_header.lower()}')" for i, c in enumerate(COLUMNS))}
), want AS (
  SELECT d.doc_id, f.*, o.ord FROM docs d JOIN fields f USING (template_id) LEFT JOIN (SELECT doc_id, arg_min(vote, block_id) AS ord FROM (SELECT doc_id, block_id, {_VOTE.replace('{c}', 'content')} AS vote FROM blocks) WHERE vote IS NOT NULL GROUP BY doc_id) o USING (doc_id)
), keyed AS (
  SELECT doc_id, block_id, confidence, trim(substring(content, 1, instr(content, ':') - 1)) AS key, trim(substring(content, instr(content, ':') + 1)) AS value FROM blocks WHERE instr(content, ':') > 1
), kv AS (
  SELECT w.doc_id, w.field_id, arg_min({{'v': k.value, 'c': k.confidence, 'b': k.block_id}}, k.block_id) AS h FROM want w JOIN keyed k ON k.doc_id = w.doc_id AND w.src = 'KEY_VALUE' AND regexp_matches(k.key, w.pat, 'i') GROUP BY 1, 2
), whole AS (
  SELECT doc_id, string_agg(content, chr(10) ORDER BY block_id) AS text, coalesce({avg4_sql('confidence')}, 0) AS conf FROM blocks GROUP BY doc_id
), rx AS (
  SELECT w.doc_id, w.field_id, CASE WHEN grp = 1 THEN regexp_extract(t.text, '(?i)' || rx, 1) ELSE regexp_extract(t.text, '(?i)' || rx) END AS raw, t.conf FROM want w JOIN whole t ON t.doc_id = w.doc_id AND w.src = 'REGEX' AND regexp_matches(t.text, '(?i)' || rx)
), heads AS (
  SELECT doc_id, table_idx, lower(trim(content)) AS header, arg_min(col_idx, row_idx * 1000 + col_idx) AS col_idx FROM cells WHERE is_header GROUP BY ALL
), single AS (
  SELECT w.doc_id, w.field_id, h.table_idx, h.col_idx, c.row_idx, c.content, c.confidence, w.sel, dense_rank() OVER (PARTITION BY w.doc_id, w.field_id ORDER BY h.table_idx) AS nth
  FROM want w JOIN heads h ON h.doc_id = w.doc_id AND h.header = w.header AND w.src = 'TABLE_CELL' JOIN cells c ON c.doc_id = h.doc_id AND c.table_idx = h.table_idx AND c.col_idx = h.col_idx AND NOT c.is_header
), picked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY CASE WHEN sel = 'LAST' THEN -row_idx ELSE row_idx END) AS n FROM single WHERE nth = 1
), one AS (
  SELECT doc_id, field_id, string_agg(content, ' | ' ORDER BY row_idx) AS raw, coalesce({avg4_sql('confidence')}, 0) AS conf, 'Table:' || max(table_idx) || '/Col:' || max(col_idx) AS ref FROM picked WHERE sel = 'ALL' OR n = 1 GROUP BY 1, 2
), spine AS (
  SELECT DISTINCT doc_id, table_idx, row_idx FROM cells WHERE NOT is_header
), usable AS (
  SELECT w.doc_id, w.field_id, w.sel, min(h.table_idx) AS table_idx FROM want w JOIN heads h ON h.doc_id = w.doc_id AND h.header = w.header AND w.src = 'ROWS'
  WHERE EXISTS (SELECT 1 FROM spine s WHERE s.doc_id = h.doc_id AND s.table_idx = h.table_idx) AND EXISTS (SELECT 1 FROM heads k JOIN cols ON cols.header = k.header WHERE k.doc_id = h.doc_id AND k.table_idx = h.table_idx) GROUP BY ALL
), taken AS (
  SELECT u.*, s.row_idx, row_number() OVER (PARTITION BY u.doc_id, u.field_id ORDER BY CASE WHEN u.sel = 'LAST' THEN -s.row_idx ELSE s.row_idx END) AS n FROM usable u JOIN spine s ON s.doc_id = u.doc_id AND s.table_idx = u.table_idx
), grid AS (
  SELECT t.doc_id, t.field_id, t.table_idx, t.row_idx, cols.spot, cols.name, cols.ctype AS dtype, c.content AS x, c.confidence, o.ord
  FROM taken t CROSS JOIN cols LEFT JOIN heads h ON h.doc_id = t.doc_id AND h.table_idx = t.table_idx AND h.header = cols.header LEFT JOIN cells c ON c.doc_id = t.doc_id AND c.table_idx = t.table_idx AND c.row_idx = t.row_idx AND c.col_idx = h.col_idx AND NOT c.is_header
    LEFT JOIN (SELECT DISTINCT doc_id, ord FROM want) o ON o.doc_id = t.doc_id WHERE t.sel IS NULL OR t.n = 1
), texts AS (
  SELECT *, {_TYPED.replace('{x}', 'x')} AS v FROM grid
), items AS (
  SELECT doc_id, field_id, table_idx, row_idx, '{{' || string_agg('"' || name || '":' || CASE WHEN v IS NULL THEN 'null' WHEN dtype IN ('INT', 'DECIMAL') AND regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?$') THEN v ELSE '"' || v || '"' END, ',' ORDER BY spot) || '}}' AS item FROM texts GROUP BY ALL
), arrays AS (
  SELECT i.doc_id, i.field_id, '[' || string_agg(item, ',' ORDER BY row_idx) || ']' AS json, 'Table:' || max(table_idx) || '/rows:' || count(*) AS ref, max(m.conf) AS conf
  FROM items i JOIN (SELECT doc_id, field_id, {avg4_sql('confidence')} AS conf FROM texts GROUP BY ALL) m USING (doc_id, field_id) GROUP BY 1, 2
), resolved AS (
  SELECT w.doc_id, w.template_id, w.field_id, w.prop, w.def, w.req, w.least, w.dtype, w.ord, w.src, CASE w.src WHEN 'KEY_VALUE' THEN kv.h.v WHEN 'REGEX' THEN rx.raw WHEN 'TABLE_CELL' THEN one.raw WHEN 'CONSTANT' THEN w.def END AS raw,
    CASE w.src WHEN 'KEY_VALUE' THEN kv.h IS NOT NULL WHEN 'REGEX' THEN rx.doc_id IS NOT NULL WHEN 'TABLE_CELL' THEN one.doc_id IS NOT NULL ELSE TRUE END AS hit, w.sel,
    CASE w.src WHEN 'KEY_VALUE' THEN CASE WHEN kv.h IS NULL THEN 0 ELSE kv.h.c END WHEN 'REGEX' THEN coalesce(rx.conf, 0) WHEN 'TABLE_CELL' THEN coalesce(one.conf, 0) WHEN 'CONSTANT' THEN 1 ELSE a.conf END AS conf,
    CASE w.src WHEN 'KEY_VALUE' THEN 'TextBlock:' || kv.h.b WHEN 'REGEX' THEN CASE WHEN rx.doc_id IS NOT NULL THEN 'Regex:fulltext' END WHEN 'TABLE_CELL' THEN one.ref WHEN 'ROWS' THEN a.ref END AS source_ref, coalesce(a.json, '[]') AS json
  FROM want w LEFT JOIN kv USING (doc_id, field_id) LEFT JOIN rx USING (doc_id, field_id) LEFT JOIN one USING (doc_id, field_id) LEFT JOIN arrays a USING (doc_id, field_id)
), typed AS (
  SELECT *, CASE WHEN src = 'ROWS' THEN json WHEN src = 'CONSTANT' OR NOT hit THEN def WHEN sel = 'ALL' THEN raw ELSE {_TYPED.replace('{x}', 'raw')} END AS v FROM resolved
), stepped AS (
  SELECT *, CASE WHEN template_id = 2 AND field_id = 1 THEN regexp_replace(upper(coalesce(v, raw)), '^US-', '#') WHEN template_id = 3 AND field_id = 3 THEN upper(v)
    WHEN template_id = 3 AND field_id = 4 THEN coalesce(CAST(CAST(TRY_CAST(CASE WHEN coalesce(trim(coalesce(v, raw)), '') = '' THEN '0' ELSE coalesce(v, raw) END AS DECIMAL(30,10)) AS DECIMAL(30,1)) AS VARCHAR), v) ELSE v END AS normalized,
    coalesce(conf < least, FALSE) AS below FROM typed
)"""
)


def _templates(spark):
    return spark.createDataFrame([X.template_row(t) for t in SPECS], X.TEMPLATES)


def _mapped(spark, sf):
    return X.map_by_template(hard_documents(spark, sf), _templates(spark), hard_blocks(spark, sf), hard_cells(spark, sf))


@query("map_many_templates", f"WITH {MAPPED_SQL} SELECT doc_id, template_id, field_id, prop AS target_property, CASE WHEN src = 'ROWS' THEN NULL ELSE raw END AS raw, normalized, CAST(conf AS DOUBLE) AS conf, source_ref, below FROM stepped")
def map_many_templates(spark, sf):
    """Every value of documents of three templates, from one plan that does not know the templates."""
    long = X.long_form(_mapped(spark, sf))
    return long.select("doc_id", "template_id", "field_id", "target_property", "raw", "normalized", F.col("confidence").cast("double").alias("conf"), "source_ref", "below")


@query(
    "map_many_outcomes",
    f"""WITH {MAPPED_SQL}, out AS (SELECT doc_id, count(*) AS n, {avg4_sql('CAST(conf AS DECIMAL(9,4))')} AS overall, bool_or(below) OR bool_or(req AND coalesce(trim(normalized), '') = '') AS review,
      '{{' || string_agg('"' || prop || '":' || CASE WHEN src = 'ROWS' THEN normalized WHEN normalized IS NULL THEN 'null' WHEN dtype IN ('INT', 'DECIMAL') AND regexp_matches(normalized, '^-?[0-9]+(\\.[0-9]+)?$') THEN normalized ELSE '"' || normalized || '"' END, ',' ORDER BY field_id) || '}}' AS json FROM stepped GROUP BY doc_id)
    SELECT d.doc_id, d.template_id, CAST(out.n AS INTEGER) AS n_values, CAST(overall AS DOUBLE) AS overall_confidence, CASE WHEN review THEN 'NEEDS_REVIEW' WHEN NOT review THEN 'MAPPED' END AS status, md5(json) AS json_md5 FROM docs d LEFT JOIN out USING (doc_id)""",
)
def map_many_outcomes(spark, sf):
    """One row a document, also of those whose template does not exist."""
    rows = X.with_outcome(_mapped(spark, sf))
    n = F.when(F.col("values").isNotNull(), F.size("values"))
    return rows.select("doc_id", "template_id", n.alias("n_values"), F.col("overall_confidence").cast("double").alias("overall_confidence"), "status", F.md5("mapped_json").alias("json_md5"))


@query("map_hard_layout", f"WITH {MAPPED_SQL} SELECT doc_id, field_id, normalized, CAST(conf AS DOUBLE) AS conf, source_ref, below FROM stepped WHERE template_id = 1")
def map_hard_layout(spark, sf):
    """The first template compiled into its plan, over its documents: the same values."""
    own = hard_documents(spark, sf).where("template_id = 1").select("doc_id")
    long = M.map_documents(SPECS[0], hard_blocks(spark, sf), hard_cells(spark, sf), own)
    return long.select("doc_id", "field_id", "normalized", F.col("confidence").cast("double").alias("conf"), "source_ref", "below")


_ROUND = ", ".join(f"({', '.join(map(_value, (t.template_id, f.field_id, f.target_property, f.source_type, f.table_header, c.sub_property if c else None, c.sort_order if c else None, s.kind if s else None, s.order if s else None)))})" for t in SPECS for f in t.fields for c in (f.columns or [None]) for s in (f.steps or [None]))


@query(
    "template_round_trip",
    f"""WITH t(template_id, field_id, target_property, source_type, table_header, sub_property, sort_order, kind, step_order) AS (VALUES {_ROUND}), n AS (SELECT n_nationkey AS k FROM nation)
    SELECT CAST(template_id + 10 * k AS INTEGER) AS template_id, CAST(field_id + 10 * template_id + 100 * k AS INTEGER) AS field_id, target_property, source_type, table_header, sub_property, CAST(sort_order AS INTEGER) AS sort_order, kind, CAST(step_order AS INTEGER) AS step_order FROM t, n""",
)
def template_round_trip(spark, sf):
    """Templates of every nation: nested rows taken apart into relational ones, nested again from them, and taken apart once more."""
    k = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    own = F.transform("fields", lambda f: f.withField("field_id", (f["field_id"] + F.col("template_id") * 10 + F.col("k") * 100).cast("int")))
    given = _templates(spark).crossJoin(k).withColumn("fields", own).withColumn("template_id", (F.col("template_id") + F.col("k") * 10).cast("int")).drop("k")
    again = X.nested(given.drop("fields"), *X.flattened(given))
    fields, columns, steps = X.flattened(again)
    rows = fields.join(columns.select("field_id", "sub_property", "sort_order"), "field_id", "left").join(steps.select("field_id", "kind", "step_order"), "field_id", "left")
    return rows.select("template_id", "field_id", "target_property", "source_type", "table_header", "sub_property", "sort_order", "kind", "step_order")


@query(
    "review_save",
    f"""WITH {HARD_SQL}, o AS (SELECT k, arg_min(vote, row_idx) AS ord FROM (SELECT k, row_idx, {_VOTE.replace('{c}', 'day')} AS vote FROM line) WHERE vote IS NOT NULL GROUP BY k),
    j AS (SELECT l.k AS doc_id, '[' || string_agg('{{"qty":' || CAST(l_quantity AS INTEGER) || ',"day":"' || coalesce({date_sql('day', 'o.ord')}, day) || '","note":null' || CASE WHEN row_idx % 2 = 0 THEN ',"_pg":2' ELSE '' END || '}}', ',' ORDER BY row_idx) || ']' AS json FROM line l LEFT JOIN o USING (k) WHERE l.k % 6 = 0 GROUP BY l.k)
    SELECT o_orderkey AS doc_id, f.field_id, CASE WHEN f.field_id = 1 AND o_orderkey % 4 = 0 THEN 'fixed' WHEN f.field_id = 2 AND j.json IS NOT NULL THEN j.json ELSE 'old' END AS normalized, NOT (f.field_id = 1 AND o_orderkey % 4 = 0 OR f.field_id = 2 AND j.json IS NOT NULL) AS below,
      CASE WHEN o_orderstatus = 'O' AND (o_orderkey % 4 = 0 OR j.json IS NOT NULL) THEN 'VALIDATED' WHEN o_orderstatus = 'O' THEN 'NEEDS_REVIEW' ELSE 'MAPPED' END AS status
    FROM orders CROSS JOIN (VALUES (1), (2)) f(field_id) LEFT JOIN j ON j.doc_id = o_orderkey""",
)
def review_save(spark, sf):
    """Fields and tables that reviewers edited: values, cleared flags, and the status of their documents."""
    docs = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW").otherwise("MAPPED").alias("status"))
    values = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("field_id"), F.lit("old").alias("normalized"), F.lit(True).alias("below"))
    fixes = docs.where("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("field_id"), F.lit("fixed").alias("value"))
    cells = [F.lit("qty"), F.col("l_quantity").cast("int").cast("string"), F.lit("day"), _dated(F.col("l_shipdate").cast("date"), F.col("l_orderkey"))]
    row = F.when(F.col("row_idx") % 2 == 0, F.create_map(*cells, F.lit("_pg"), F.lit("2"))).otherwise(F.create_map(*cells, F.lit("_pg"), F.lit("x")))
    rows = I.lines(spark, sf).where("l_orderkey % 17 <> 0 and l_orderkey % 6 = 0").select(F.col("l_orderkey").alias("doc_id"), "row_idx", row.alias("m"))
    edits = rows.groupBy("doc_id").agg(F.collect_list(F.struct("row_idx", "m")).alias("r")).select("doc_id", F.lit(2).alias("field_id"), F.transform(F.array_sort("r", lambda a, b: a["row_idx"] - b["row_idx"]), lambda x: x["m"]).alias("rows"))
    columns = spark.createDataFrame([(2, [("qty", "INT"), ("day", "DATE"), ("note", "STRING")]), (3, [])], "field_id int, columns array<struct<sub_property:string,data_type:string>>")
    saved, done = R.review_saved(docs, values, fixes, edits, columns)
    return saved.join(done, "doc_id").select("doc_id", "field_id", "normalized", "below", "status")
