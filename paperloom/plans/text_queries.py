"""Queries of text normalization, transformer steps and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.functions import scalars as S
from paperloom.functions.transforms import apply_steps
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog
from paperloom.schema import StepSpec

CATALOG = Catalog()
query = CATALOG.query

# Building blocks of the SQL side: number and date of an expression.
_AR = "translate({s}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"
_KEPT = f"regexp_replace(regexp_replace({_AR}, '[^0-9.\\-]', '', 'g'), '^([^-]*)-$', '-\\1')"
NUMBER_SQL = (
    "CASE WHEN regexp_matches({k}, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') AND length(regexp_replace({k}, '[^0-9]', '', 'g')) <= 28 THEN "
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({k}, '^(-?)0*([0-9])', '\\1\\2'), '\\.$', ''), '^(-?)\\.', '\\10.'), '^-([0.]*)$', '\\1') END"
)
_D = r"([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{2,4})"


def number_sql(s: str) -> str:
    return NUMBER_SQL.replace("{k}", _KEPT.replace("{s}", s))


def date_sql(s: str, order: str = "NULL") -> str:
    """ISO date text of an expression."""
    ar = _AR.replace("{s}", s)
    a, b, y = (f"TRY_CAST(regexp_extract({ar}, '{_D}', {k}) AS INTEGER)" for k in (1, 2, 3))
    year = f"(CASE WHEN {y} < 50 THEN {y} + 2000 WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END)"
    year = f"({year} - CASE WHEN regexp_matches({ar}, 'พ\\.?\\s?ศ\\.?') OR {year} >= 2400 THEN 543 ELSE 0 END)"
    month_first = f"(CASE WHEN {a} > 12 THEN FALSE WHEN {b} > 12 THEN TRUE ELSE coalesce({order} = 'M', FALSE) END)"
    day, month = f"(CASE WHEN {month_first} THEN {b} ELSE {a} END)", f"(CASE WHEN {month_first} THEN {a} ELSE {b} END)"
    iso = f"lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad(CAST({day} AS VARCHAR), 2, '0')"
    return f"strftime(TRY_CAST({iso} AS DATE), '%Y-%m-%d')"


@query("number_normalize", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, {number_sql('content')} AS number_text, CAST({number_sql('content')} AS DOUBLE) AS number_value FROM blocks")
def number_normalize(spark, sf):
    text = N.number_text(F.col("content"))
    return I.blocks(spark, sf).select("doc_id", "block_id", text.alias("number_text"), text.try_cast("double").alias("number_value"))


@query("date_normalize_be", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, regexp_matches({_AR.replace('{s}', 'content')}, '{_D}') AS is_date, {date_sql('content')} AS iso FROM blocks")
def date_normalize_be(spark, sf):
    return I.blocks(spark, sf).select("doc_id", "block_id", N.looks_like_date(F.col("content")).alias("is_date"), N.date_text(F.col("content"), F.lit(None).cast("string")).alias("iso"))


def with_order(df, key="doc_id", place=("page", "block_id"), text="content"):
    """Add the day/month order that each document's first decisive date fixes: one aggregate, one join."""
    vote = N.date_order_vote(F.col(text))
    order = df.select(key, *place, vote.alias("vote")).where("vote is not null").groupBy(key).agg(F.min_by("vote", F.struct(*place)).alias("order"))
    return df.join(order, key, "left")


_VOTE = f"CASE WHEN TRY_CAST(regexp_extract({_AR.replace('{s}', '{c}')}, '{_D}', 1) AS INTEGER) > 12 THEN 'D' WHEN TRY_CAST(regexp_extract({_AR.replace('{s}', '{c}')}, '{_D}', 2) AS INTEGER) > 12 THEN 'M' END"
ORDER_SQL = I.BLOCKS_SQL + ", votes AS (SELECT doc_id, block_id, " + _VOTE.replace("{c}", "content") + " AS vote FROM blocks), orders_of AS (SELECT doc_id, arg_min(vote, block_id) AS ord FROM votes WHERE vote IS NOT NULL GROUP BY doc_id)"


@query("date_order_infer", f"WITH {ORDER_SQL} SELECT b.doc_id, coalesce(max(o.ord), 'U') AS day_month_order, count(*) AS n_blocks FROM blocks b LEFT JOIN orders_of o USING (doc_id) GROUP BY b.doc_id")
def date_order_infer(spark, sf):
    vote = F.struct("page", "block_id")
    rows = I.blocks(spark, sf).withColumn("vote", N.date_order_vote(F.col("content")))
    return rows.groupBy("doc_id").agg(F.coalesce(F.min_by("vote", F.when(F.col("vote").isNotNull(), vote)), F.lit("U")).alias("day_month_order"), F.count(F.lit(1)).alias("n_blocks"))


@query("date_order_documents", "SELECT lang, coalesce(" + _VOTE.replace("{c}", "text") + ", 'U') AS vote, count(*) AS n FROM documents GROUP BY 1, 2")
def date_order_documents(spark, sf):
    return I.table(spark, sf, "documents").groupBy("lang", F.coalesce(N.date_order_vote(F.col("text")), F.lit("U")).alias("vote")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_dispatch",
    f"""WITH {ORDER_SQL}, p AS (SELECT b.*, o.ord, {date_sql('content', 'o.ord')} AS d, {number_sql('content')} AS n, {_AR.replace('{s}', 'content')} AS ar FROM blocks b LEFT JOIN orders_of o USING (doc_id))
    SELECT doc_id, block_id, CASE WHEN d IS NOT NULL THEN d WHEN n IS NOT NULL THEN n WHEN ar <> content THEN ar END AS normalized,
      CASE WHEN d IS NOT NULL THEN 'Date' WHEN n IS NOT NULL THEN 'Number' ELSE 'Text' END AS kind FROM p""",
)
def normalize_dispatch(spark, sf):
    made = with_order(I.blocks(spark, sf)).withColumn("n", N.normalized(F.col("content"), F.col("order")))
    return made.select("doc_id", "block_id", F.col("n.value").alias("normalized"), F.col("n.kind").alias("kind"))


@query(
    "typed_cells",
    f"""WITH {I.CELLS_SQL}, t AS (SELECT *, CASE col_idx WHEN 1 THEN 'INT' WHEN 2 THEN 'STRING' ELSE 'DECIMAL' END AS data_type, {number_sql('content')} AS n, {_AR.replace('{s}', 'content')} AS ar FROM cells WHERE NOT is_header)
    SELECT doc_id, row_idx, col_idx, CASE data_type WHEN 'INT' THEN coalesce(regexp_replace(regexp_replace(n, '\\.[0-9]*$', ''), '^-?0?$', '0'), ar) WHEN 'DECIMAL' THEN coalesce(n, ar) ELSE content END AS value_text,
      CASE data_type WHEN 'INT' THEN TRY_CAST(regexp_replace(n, '\\.[0-9]*$', '') AS BIGINT) END AS value_long, CASE data_type WHEN 'DECIMAL' THEN CAST(n AS DOUBLE) END AS value_double FROM t""",
)
def typed_cells(spark, sf):
    kind = F.when(F.col("col_idx") == 1, "INT").when(F.col("col_idx") == 2, "STRING").otherwise("DECIMAL")
    made = I.cells(spark, sf).where(~F.col("is_header")).withColumn("c", N.typed_cell(F.col("content"), kind, F.lit(None).cast("string")))
    return made.select("doc_id", "row_idx", "col_idx", F.col("c.text").alias("value_text"), F.col("c.lng").alias("value_long"), F.col("c.dec").cast("double").alias("value_double"))


def _step(name, kind, config, table, key, column, sql):
    @query(name, f"SELECT {key}, {sql} AS value FROM {table}")
    def run(spark, sf):
        return I.table(spark, sf, table).select(key, apply_steps(F.col(column), [StepSpec(kind, config)]).alias("value"))

    return run


_step("transform_trim", "trim", {}, "documents", "doc_id", "text", r"regexp_replace(regexp_replace(text, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '')")
_step("transform_case_upper", "case", {"mode": "upper"}, "part", "p_partkey", "p_name", "upper(p_name)")
_step("transform_case_lower", "case", {"mode": "lower"}, "part", "p_partkey", "p_type", "lower(p_type)")
_step("transform_case_title", "case", {"mode": "title"}, "part", "p_partkey", "p_type", "list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')")
_step("transform_regex", "regex_replace", {"pattern": "[aeiou]+", "replacement": "_"}, "part", "p_partkey", "p_name", "regexp_replace(p_name, '[aeiou]+', '_', 'g')")
_step("transform_number_clean", "number_clean", {"decimals": 2}, "part", "p_partkey", "p_brand", "coalesce(CAST(CAST(TRY_CAST(regexp_replace(p_brand, '[^0-9.\\-]', '', 'g') AS DECIMAL(38,10)) AS DECIMAL(38,2)) AS VARCHAR), p_brand)")
_step("transform_default", "default", {"value": "none"}, "events", "event_id", "event_type", "CASE WHEN trim(coalesce(event_type, '')) = '' THEN 'none' ELSE event_type END")
_step("transform_summary", "ai_summary", {"maxChars": 40}, "documents", "doc_id", "text", "'[summary] ' || CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '…' ELSE text END")
_step("transform_translate", "translate", {"to": "th"}, "part", "p_partkey", "p_name", "'[th] ' || p_name")


@query("transform_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'n/a' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS value FROM orders")
def transform_date(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "M/d/yyyy")).when(k % 4 == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.lit("n/a"))
    return I.table(spark, sf, "orders").select("o_orderkey", apply_steps(text, [StepSpec("date_normalize", {"format": "yyyy/MM/dd"})]).alias("value"))


@query("transform_pipeline", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, upper(regexp_replace(content, '[^:]*:\\s*', '')) AS value FROM blocks")
def transform_pipeline(spark, sf):
    steps = [StepSpec("case", {"mode": "upper"}, 3), StepSpec("regex_replace", {"pattern": r"^[^:]*:\s*", "replacement": ""}, 1), StepSpec("unknown", {}, 2), StepSpec("trim", {}, 4), StepSpec("case", {"mode": "lower"}, 5, False)]
    return I.blocks(spark, sf).select("doc_id", "block_id", apply_steps(F.col("content"), steps).alias("value"))


@query("confidence_band", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, CASE WHEN confidence < 0.7 THEN 'Low' WHEN confidence >= 0.85 THEN 'High' ELSE 'Medium' END AS band, CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%' AS percent FROM blocks")
def confidence_band(spark, sf):
    return I.blocks(spark, sf).select("doc_id", "block_id", S.confidence_band(F.col("confidence"), 0.70).alias("band"), S.percent(F.col("confidence")).alias("percent"))


@query("junk_anchor", f"WITH {I.CELLS_SQL} SELECT doc_id, row_idx, NOT regexp_matches({_AR.replace('{s}', 'content')}, '[0-9]') AS junk FROM cells WHERE col_idx = 1 AND NOT is_header")
def junk_anchor(spark, sf):
    return I.cells(spark, sf).where((F.col("col_idx") == 1) & ~F.col("is_header")).select("doc_id", "row_idx", S.junk_anchor(F.col("content"), F.lit("INT")).alias("junk"))


@query("sha256_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_fingerprint(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("sha256_dedupe", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def sha256_dedupe(spark, sf):
    return I.table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_CLAMP = "greatest(0, least(1, {x}))"


@query(
    "zone_pixel_rect",
    f"""WITH {I.WORDS_SQL}, e AS (SELECT doc_id, word_id, CAST(greatest(0, least(round_even(x * 248, 0), 247)) AS INTEGER) AS px, CAST(greatest(0, least(round_even(y * 351, 0), 350)) AS INTEGER) AS py,
      CAST(round_even(w * 248, 0) AS INTEGER) AS pw, CAST(round_even(h * 351, 0) AS INTEGER) AS ph FROM words)
    SELECT doc_id, word_id, px, py, CASE WHEN pw < 1 THEN 1 WHEN pw > 248 - px THEN 248 - px ELSE pw END AS pw, CASE WHEN ph < 1 THEN 1 WHEN ph > 351 - py THEN 351 - py ELSE ph END AS ph FROM e""",
)
def zone_pixel_rect(spark, sf):
    """On a page of 248 x 351 pixels, where a side's own rounding and that of its ends differ."""
    rect = S.zone_pixels(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(248), F.lit(351))
    made = I.words(spark, sf).withColumn("r", rect)
    return made.select("doc_id", "word_id", F.col("r.left").alias("px"), F.col("r.top").alias("py"), F.col("r.width").alias("pw"), F.col("r.height").alias("ph"))


@query(
    "cell_pixel_rect",
    f"""WITH {I.WORDS_SQL}, e AS (SELECT doc_id, word_id, 100 + CAST(round_even(x * 200, 0) AS INTEGER) AS px, 50 + CAST(round_even(y * 300, 0) AS INTEGER) AS py,
      CAST(round_even((x + w - x) * 200, 0) AS INTEGER) AS pw, CAST(round_even((y + h - y) * 300, 0) AS INTEGER) AS ph FROM words)
    SELECT doc_id, word_id, px, py, greatest(1, least(greatest(1, pw), 300 - px)) AS pw, greatest(1, least(greatest(1, ph), 350 - py)) AS ph FROM e""",
)
def cell_pixel_rect(spark, sf):
    """Word boxes as cells of a zone of 200 x 300 pixels at (100, 50), their ends given the wrong way round."""
    zone = F.struct(F.lit(100).alias("left"), F.lit(50).alias("top"), F.lit(200).alias("width"), F.lit(300).alias("height"))
    rect = S.cell_pixels(zone, F.col("x") + F.col("w"), F.col("x"), F.col("y") + F.col("h"), F.col("y"))
    made = I.words(spark, sf).withColumn("r", rect)
    return made.select("doc_id", "word_id", F.col("r.left").alias("px"), F.col("r.top").alias("py"), F.col("r.width").alias("pw"), F.col("r.height").alias("ph"))


@query("zone_frames", f"WITH {I.WORDS_SQL} SELECT doc_id, word_id, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (x - CAST(0.1 AS DOUBLE)) / CAST(0.8 AS DOUBLE))) AS zone_x, CAST(0.1 AS DOUBLE) + x * CAST(0.8 AS DOUBLE) AS page_x FROM words")
def zone_frames(spark, sf):
    return I.words(spark, sf).select("doc_id", "word_id", S.page_to_zone_x(F.col("x"), F.lit(0.1), F.lit(0.8)).alias("zone_x"), S.crop_to_page_x(F.col("x"), F.lit(0.1), F.lit(0.8)).alias("page_x"))


@query("batch_routing", f"WITH {I.PAGES_SQL} SELECT doc_id, CASE WHEN pages <= 1 THEN 'online' WHEN doc_id % 2 = 0 THEN 'batch' ELSE 'error' END AS route FROM page_counts")
def batch_routing(spark, sf):
    return I.pages(spark, sf).where("page = 1").select("doc_id", S.batch_route(F.col("pages"), 1, F.when(F.col("doc_id") % 2 == 0, "b").otherwise("")).alias("route"))


@query(
    "failure_messages",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Classification' WHEN 1 THEN 'Extraction' WHEN 2 THEN 'Mapping' ELSE 'EXPORT' END || ' failed: ' ||
      left(regexp_extract(replace(replace(text, ' ', CASE WHEN doc_id % 3 = 0 THEN chr(13) ELSE ' ' END), '. ', '.' || chr(10)), '^[^\r\n]*'), 200) AS message FROM documents""",
)
def failure_messages(spark, sf):
    """Messages that end their first line in either way, or not within 200 characters."""
    stage = F.element_at(F.array(*map(F.lit, ("CLASSIFY", "EXTRACT", "MAP", "EXPORT"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.replace(F.col("text"), F.lit(" "), F.when(F.col("doc_id") % 3 == 0, F.lit("\r")).otherwise(F.lit(" ")))
    return I.table(spark, sf, "documents").select("doc_id", S.failure_message(stage, F.replace(text, F.lit(". "), F.lit(".\n"))).alias("message"))


@query(
    "scale_factor",
    """WITH e AS (SELECT p_partkey, p_size * 40 AS wide, p_size * 60 AS high, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size * 10 END AS dpi FROM part), f AS (
      SELECT *, CASE WHEN dpi >= 1 THEN CASE WHEN dpi < 300 THEN CAST(300 AS DOUBLE) / dpi ELSE 1.0 END WHEN wide < 1000 THEN CAST(1000 AS DOUBLE) / wide ELSE 1.0 END AS scale FROM e), g AS (
      SELECT *, least(scale, CAST(12000 AS DOUBLE) / greatest(wide, high)) AS factor FROM f)
    SELECT p_partkey, factor, CAST(round_even(wide * factor, 0) AS INTEGER) AS new_width, CAST(round_even(high * factor, 0) AS INTEGER) AS new_height FROM g""",
)
def scale_factor(spark, sf):
    size = F.col("p_size")
    dpi = F.when(size % 3 == 0, 0).otherwise(size * 10)
    factor = S.target_size(size * 40, size * 60, dpi)
    made = I.table(spark, sf, "part").select("p_partkey", factor.alias("factor"), S.enlarged(size * 40, size * 60, factor).alias("to"))
    return made.select("p_partkey", "factor", F.col("to.width").alias("new_width"), F.col("to.height").alias("new_height"))


@query("block_binding", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, CASE WHEN block_id % 2 = 0 THEN 'TABLE_CELL' ELSE 'KEY_VALUE' END AS source_type, trim(split_part(content, ':', 1)) AS label, CASE WHEN block_id % 3 = 0 THEN 'block-' || block_id END AS anchor FROM blocks")
def block_binding(spark, sf):
    kind = F.when(F.col("block_id") % 2 == 0, "table_cell").otherwise("LINE")
    ref = F.when(F.col("block_id") % 3 == 0, F.concat(F.lit("TextBlock:"), F.col("block_id"))).otherwise(F.lit("Table:1"))
    return I.blocks(spark, sf).select("doc_id", "block_id", S.source_type(kind).alias("source_type"), S.block_key(F.col("content")).alias("label"), S.block_anchor(ref).alias("anchor"))
