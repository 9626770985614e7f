"""Queries of the record model: lookups, upserts, review, export, workflow and capture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.functions import scalars as S
from paperloom.operators import buckets as B
from paperloom.operators import records as R
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog
from paperloom.session import fresh_folder
from paperloom.sources import capture as C
from paperloom.streaming import capture as Z
from paperloom.streaming import jobs as J

CATALOG = Catalog()
query = CATALOG.query
STATES = ["CAPTURED", "CLASSIFIED", "EXTRACTED", "MAPPED", "NEEDS_REVIEW", "VALIDATED", "CONSUMED", "FAILED", "SAMPLE"]


def orders(spark, sf):
    """Orders as documents: status and type from the order."""
    status = F.when(F.col("o_orderstatus") == "F", "VALIDATED").when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW").otherwise("SAMPLE")
    return I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status"), (F.col("o_custkey") % 4).cast("int").alias("doc_type"), F.col("o_orderdate").alias("created"), "o_custkey")


ORDERS_SQL = "docs AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE 'SAMPLE' END AS status, CAST(o_custkey % 4 AS INTEGER) AS doc_type, o_orderdate AS created, o_custkey FROM orders)"
TARGETS = [(1, "all", None, True), (2, "one", 1, True), (3, "two", 2, True), (4, "off", 1, False), (5, "three", 3, True)]
TARGETS_SQL = "targets AS (SELECT * FROM (VALUES (1, 'all', NULL, TRUE), (2, 'one', 1, TRUE), (3, 'two', 2, TRUE), (4, 'off', 1, FALSE), (5, 'three', 3, TRUE)) v(target_id, name, t_type, is_active))"


def targets(spark):
    return spark.createDataFrame(TARGETS, "target_id int, name string, doc_type int, is_active boolean")


@query("document_by_id", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def document_by_id(spark, sf):
    return I.table(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("top_recent", f"WITH {ORDERS_SQL} SELECT doc_id, status, doc_type, o_custkey FROM docs WHERE status <> 'SAMPLE' ORDER BY created DESC, doc_id LIMIT 50")
def top_recent(spark, sf):
    rows = orders(spark, sf).where("status <> 'SAMPLE'").orderBy(F.desc("created"), "doc_id").limit(50)
    return rows.select("doc_id", "status", "doc_type", "o_custkey")


@query("documents_by_status", f"WITH {ORDERS_SQL} SELECT doc_id, doc_type FROM docs WHERE status = 'VALIDATED'")
def documents_by_status(spark, sf):
    return orders(spark, sf).where("status = 'VALIDATED'").select("doc_id", "doc_type")


@query("docs_with_previews", f"WITH {ORDERS_SQL} SELECT doc_id, status FROM docs WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id)")
def docs_with_previews(spark, sf):
    return R.with_any(orders(spark, sf), I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id")), "doc_id").select("doc_id", "status")


@query("page_recount", "SELECT l_orderkey AS doc_id, count(*) AS page_count FROM lineitem GROUP BY 1")
def page_recount(spark, sf):
    return I.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("page_count"))


@query("unreferenced_fields", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unreferenced_fields(spark, sf):
    used = I.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.without_any(I.table(spark, sf, "part"), used, "p_partkey").select("p_partkey", "p_name")


@query("template_candidates", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS is_multi_page FROM customer")
def template_candidates(spark, sf):
    marks = I.table(spark, sf, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return R.flagged(I.table(spark, sf, "customer").select("c_custkey"), marks, "c_custkey", "is_multi_page")


@query("template_field_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS field_count FROM customer")
def template_field_counts(spark, sf):
    rows = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.counted(I.table(spark, sf, "customer").select("c_custkey"), rows, "c_custkey", "field_count")


@query("active_template", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS template_id, arg_max(o_orderstatus, o_orderkey) AS mode FROM orders GROUP BY 1")
def active_template(spark, sf):
    rows = I.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("template_id"), F.col("o_orderstatus").alias("mode"))
    return R.latest(rows, "o_custkey", "template_id")


@query("latest_result", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_result(spark, sf):
    return R.latest(I.table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("distinct_keys_top100", "SELECT DISTINCT p_type AS property FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 10 ORDER BY 1 LIMIT 100")
def distinct_keys_top100(spark, sf):
    used = I.table(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("p_partkey"))
    return R.with_any(I.table(spark, sf, "part"), used, "p_partkey").select(F.col("p_type").alias("property")).distinct().orderBy("property").limit(100)


@query("grouped_steps", "SELECT l_orderkey AS field_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY row_idx) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(I.LINE_ORDER) + ") AS row_idx FROM lineitem) WHERE l_returnflag = 'N' GROUP BY 1")
def grouped_steps(spark, sf):
    rows = I.lines(spark, sf).withColumn("active", F.col("l_returnflag") == "N")
    steps = R.grouped(rows, "l_orderkey", "row_idx", ["l_partkey"], "steps", "active")
    return steps.select(F.col("l_orderkey").alias("field_id"), F.array_join(F.transform("steps", lambda s: s["l_partkey"].cast("string")), ",").alias("steps"))


@query("merge_not_matched", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM (VALUES (100, 'NEW')) v")
def merge_not_matched(spark, sf):
    current = I.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return R.insert_missing(current, spark.createDataFrame([(0, "ignored"), (100, "NEW")], "n_nationkey int, n_name string"), "n_nationkey")


@query("upsert_fields", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'CHANGED' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 101, 'ADDED'")
def upsert_fields(spark, sf):
    current = I.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return R.upsert(current, spark.createDataFrame([(3, "CHANGED"), (101, "ADDED")], "n_nationkey int, n_name string"), "n_nationkey")


@query("replace_columns", "SELECT n_regionkey, n_nationkey AS column_id, 7 AS sort_order FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT * FROM (VALUES (2, 500, 0), (2, 501, 1), (2, 502, 9)) v")
def replace_columns(spark, sf):
    current = I.table(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("column_id"), F.lit(7).alias("sort_order"))
    return R.replace_children(current, spark.createDataFrame([(2, 500, 0), (2, 501, 0), (2, 502, 9)], "n_regionkey int, column_id int, sort_order int"), "n_regionkey")


@query("partial_binding", "SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 5 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
def partial_binding(spark, sf):
    changes = spark.createDataFrame([(4, "X", None), (5, None, 9)], "n_nationkey int, n_name string, n_regionkey int")
    return R.overlay(I.table(spark, sf, "nation"), changes, ["n_nationkey"], ["n_name", "n_regionkey"])


@query("apply_corrections", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id AS field_id, CASE WHEN doc_id % 10 = 0 AND block_id = 4 THEN '1.00' ELSE content END AS normalized, confidence < 0.8 AND NOT (doc_id % 10 = 0 AND block_id = 4) AS below FROM blocks")
def apply_corrections(spark, sf):
    values = I.blocks(spark, sf).select("doc_id", F.col("block_id").alias("field_id"), F.col("content").alias("normalized"), (F.col("confidence") < 0.8).alias("below"))
    fixes = I.table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(4).cast("bigint").alias("field_id"), F.lit("1.00").alias("value"))
    return R.correct(values, fixes)


@query("derive_properties", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, trim(substring(content, 1, instr(content, ':') - 1)) AS key, trim(substring(content, instr(content, ':') + 1)) AS value FROM blocks WHERE instr(content, ':') > 1")
def derive_properties(spark, sf):
    from paperloom.operators.mapping import split_key

    return split_key(I.blocks(spark, sf)).where("key is not null").select("doc_id", "block_id", "key", "value")


@query("processor_for_engine", "SELECT c_mktsegment AS engine, min(c_custkey) AS processor_id FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def processor_for_engine(spark, sf):
    return I.table(spark, sf, "customer").where("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("engine")).agg(F.min("c_custkey").alias("processor_id"))


@query("export_fanout", f"WITH {ORDERS_SQL}, {TARGETS_SQL} SELECT doc_id, target_id FROM docs JOIN targets ON is_active AND (t_type IS NULL OR t_type = doc_type) WHERE status IN ('VALIDATED', 'CONSUMED')")
def export_fanout(spark, sf):
    ready = orders(spark, sf).where(F.col("status").isin("VALIDATED", "CONSUMED"))
    return R.matching_targets(ready, targets(spark)).select("doc_id", "target_id")


@query(
    "consumed_docs",
    f"""WITH {ORDERS_SQL}, {TARGETS_SQL}, a AS (SELECT doc_id, (doc_id + target_id) % 9 <> 0 AS ok FROM docs JOIN targets ON is_active AND (t_type IS NULL OR t_type = doc_type) WHERE status IN ('VALIDATED', 'CONSUMED'))
    SELECT d.doc_id, CASE WHEN status IN ('VALIDATED', 'CONSUMED') AND coalesce((SELECT bool_and(ok) FROM a WHERE a.doc_id = d.doc_id), FALSE) THEN 'CONSUMED' ELSE status END AS status FROM docs d""",
)
def consumed_docs(spark, sf):
    docs = orders(spark, sf)
    tried = R.matching_targets(docs.where(F.col("status").isin("VALIDATED", "CONSUMED")), targets(spark))
    return R.consumed(docs, tried.select("doc_id", ((F.col("doc_id") + F.col("target_id")) % 9 != 0).alias("succeeded")))


@query("logs_with_target", f"WITH {TARGETS_SQL} SELECT event_id, name AS target FROM events LEFT JOIN targets ON target_id = event_id % 7 ORDER BY event_id DESC LIMIT 200")
def logs_with_target(spark, sf):
    logs = I.table(spark, sf, "events").withColumn("target_id", (F.col("event_id") % 7).cast("int"))
    return logs.join(targets(spark), "target_id", "left").select("event_id", F.col("name").alias("target")).orderBy(F.desc("event_id")).limit(200)


def log(spark, sf):
    names = F.array(*map(F.lit, STATES))
    return I.table(spark, sf, "events").select("user_id", "event_id", F.element_at(names, (F.col("event_id") * 7 % 9 + 1).cast("int")).alias("status"))


_LOG = "log AS (SELECT user_id, event_id, (['" + "', '".join(STATES) + "'])[event_id * 7 % 9 + 1] AS status FROM events)"


@query("status_latest", f"WITH {_LOG} SELECT user_id, max(event_id) AS event_id, arg_max(status, event_id) AS status FROM log GROUP BY 1")
def status_latest(spark, sf):
    return R.latest(log(spark, sf), "user_id", "event_id")


_STEPS = ", ".join(f"('{a or ''}', '{b}')" for a, b in R.TRANSITIONS)


@query(
    "status_transitions_valid",
    f"WITH {_LOG}, b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM log) SELECT event_id, before, status, status = 'FAILED' OR (coalesce(before, ''), status) IN (SELECT (a, b) FROM (VALUES {_STEPS}) s(a, b)) AS valid FROM b",
)
def status_transitions_valid(spark, sf):
    return R.checked_events(log(spark, sf), "user_id", ["event_id"], "status").select("event_id", "before", "status", "valid")


@query("finalize_review", f"WITH {ORDERS_SQL} SELECT doc_id, CASE status WHEN 'NEEDS_REVIEW' THEN 'VALIDATED' ELSE status END AS status FROM docs")
def finalize_review(spark, sf):
    return orders(spark, sf).select("doc_id", R.finalize(F.col("status")).alias("status"))


@query("retry_schedule", "SELECT p_partkey, CAST(unnest(range(1, p_size % 4 + 2)) AS INTEGER) AS attempt, 2.0::DOUBLE * pow(2, unnest(range(1, p_size % 4 + 2)) - 1) AS delay FROM part")
def retry_schedule(spark, sf):
    most = F.col("p_size") % 4 + 1
    rows = I.table(spark, sf, "part").select("p_partkey", most.alias("most"), F.posexplode(R.retry_delays(4, 2.0)).alias("at", "delay"))
    return rows.where("at < most").select("p_partkey", (F.col("at") + 1).alias("attempt"), "delay")


@query("retry_outcomes", "WITH a AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_id % 3 = 0 AS ok FROM events), g AS (SELECT doc_id, min(CASE WHEN ok THEN attempt END) AS f, max(attempt) AS l FROM a WHERE attempt <= 3 GROUP BY 1) SELECT doc_id, coalesce(f, l) AS attempts, CASE WHEN f IS NOT NULL THEN 'MAPPED' WHEN l >= 3 THEN 'FAILED' ELSE 'CAPTURED' END AS status, 2.0::DOUBLE * (pow(2, coalesce(f, l) - 1) - 1) AS waited FROM g")
def retry_outcomes(spark, sf):
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    tried = I.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), attempt.cast("bigint").alias("attempt"), (F.col("event_id") % 3 == 0).alias("succeeded"))
    return Z.with_retry(tried)


@query("shard_page_offsets", "SELECT l_orderkey, l_linenumber, l_quantity, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset FROM lineitem")
def shard_page_offsets(spark, sf):
    rows = I.table(spark, sf, "lineitem").withColumn("pages", F.col("l_quantity").cast("bigint")).withColumn("index", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"))
    return C.shard_offsets(rows, "l_orderkey", "index", "pages").select("l_orderkey", "l_linenumber", "l_quantity", "page_offset")


@query("cell_grid_spans", f"WITH {I.LINES_SQL}, s AS (SELECT *, greatest(1, l_linenumber % 3) AS span FROM numbered) SELECT l_orderkey, row_idx, CAST(sum(span) OVER (PARTITION BY l_orderkey ORDER BY row_idx) - span AS BIGINT) AS col_idx FROM s")
def cell_grid_spans(spark, sf):
    rows = I.lines(spark, sf).withColumn("span", F.col("l_linenumber") % 3)
    return C.grid_columns(rows, ["l_orderkey"], "row_idx", "span").select("l_orderkey", "row_idx", F.col("col_idx").cast("bigint").alias("col_idx"))


@query("text_anchors", "SELECT doc_id, substring(text, 1, 5) || CASE WHEN length(text) >= 20 THEN substring(text, 11, 10) ELSE '' END AS anchored FROM documents")
def text_anchors(spark, sf):
    segments = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 5), (10, 20), (30, 30), (5, 10_000_000))])
    return I.table(spark, sf, "documents").select("doc_id", F.concat(F.when(F.length("text") < 5, F.col("text")).otherwise(F.lit("")), S.anchored_text(F.col("text"), segments)).alias("anchored"))


@query("polygon_boxes", "SELECT p_partkey, least(p_size, p_size * 3 % 17)::DOUBLE AS x0, least(p_size, 20)::DOUBLE AS y0, greatest(p_size, p_size * 3 % 17)::DOUBLE AS x1, greatest(p_size, 20)::DOUBLE AS y1 FROM part")
def polygon_boxes(spark, sf):
    a, b = F.col("p_size").cast("double"), (F.col("p_size") * 3 % 17).cast("double")
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x in (a, b) for y in (a, F.lit(20.0))])
    return I.table(spark, sf, "part").select("p_partkey", S.polygon_box(points).alias("p")).select("p_partkey", "p.x0", "p.y0", "p.x1", "p.y1")


@query("sidecar_boxes", "SELECT p_partkey, p_name AS text, p_size::DOUBLE / 100 AS x, 0.1::DOUBLE AS y, 10::DOUBLE / 100 AS w, 0::DOUBLE AS conf FROM part WHERE trim(p_name) <> ''")
def sidecar_boxes(spark, sf):
    size = F.col("p_size").cast("double")
    box = F.array(F.array(size, F.lit(10.0)), F.array(size + 10, F.lit(10.0)), F.array(size + 10, F.lit(20.0)), F.array(size, F.lit(20.0)))
    payload = F.struct(F.array(F.col("p_name"), F.lit(" ")).alias("texts"), F.array(F.lit(None).cast("double"), F.lit(1.0)).alias("scores"), F.array(box, box).alias("boxes"))
    words = I.table(spark, sf, "part").select("p_partkey", payload.alias("payload")).select("p_partkey", F.explode(C.word_boxes(F.col("payload"))).alias("w"))
    unit = words.select("p_partkey", F.col("w.text").alias("text"), F.col("w.conf").alias("conf"), C.unit_box(F.col("w"), F.lit(100.0), F.lit(100.0)).alias("b"))
    return unit.select("p_partkey", "text", "b.x", "b.y", "b.w", "conf")


@query("form_blocks", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id, trim(replace(split_part(content, ':', 1), ':', '')) || ': ' || CAST(block_id AS VARCHAR) AS content FROM blocks")
def form_blocks(spark, sf):
    return I.blocks(spark, sf).select("doc_id", "block_id", C.form_block(F.concat(F.substring_index("content", ":", 1), F.lit(":")), F.concat(F.lit(" "), F.col("block_id"))).alias("content"))


@query("latest_extraction", f"WITH {I.BLOCKS_SQL} SELECT doc_id, block_id FROM blocks b WHERE block_id = (SELECT max(block_id) FROM blocks c WHERE c.doc_id = b.doc_id AND c.block_id <> 6)")
def latest_extraction(spark, sf):
    runs = I.blocks(spark, sf).select("doc_id", F.col("block_id").alias("run_id"), (F.col("block_id") != 6).alias("succeeded"))
    return C.latest_run(runs, I.blocks(spark, sf).withColumn("run_id", F.col("block_id"))).select("doc_id", "block_id")


_BOX = """'{"left":0.1,"top":0.25,"width":0.5,"height":0.125}'"""


@query(
    "extraction_json",
    f"""WITH {I.BLOCKS_SQL}, {I.CELLS_SQL.strip()}, {I.PAGES_SQL.strip()}, p AS (SELECT doc_id, string_agg('{{"pageNumber":' || page || ',"width":' || CASE WHEN page % 2 = 1 THEN 600 + page ELSE 0 END || ',"height":800}}', ',' ORDER BY page) AS j FROM inv_pages GROUP BY 1
    ), b AS (SELECT doc_id, string_agg('{{"id":"block-' || block_id || '","page":1,"type":"' || CASE WHEN block_id = 1 THEN 'KEY' ELSE 'LINE' END || '","text":"' || content || '","normalizedValue":null,"confidence":' || confidence || ',"bbox":' || CASE WHEN block_id = 1 THEN {_BOX} ELSE 'null' END || '}}', ',' ORDER BY block_id) AS j FROM blocks WHERE block_id <> 2 GROUP BY 1
    ), c AS (SELECT doc_id, max(row_idx) + 1 AS n, string_agg('{{"rowIndex":' || row_idx || ',"colIndex":' || col_idx || ',"rowSpan":1,"colSpan":1,"isHeader":' || is_header || ',"type":"TABLE_CELL","text":"' || content || '","normalizedValue":null,"confidence":' || confidence || ',"bbox":null}}', ',' ORDER BY row_idx, col_idx) AS j FROM cells GROUP BY 1)
    SELECT o_orderkey AS doc_id, '{{"documentId":' || o_orderkey || ',"pages":[' || coalesce(p.j, '') || '],"blocks":[' || coalesce(b.j, '') || '],"tables":[' || coalesce('{{"id":"table-1","page":1,"rowCount":' || c.n || ',"columnCount":4,"cells":[' || c.j || ']}}', '') || ']}}' AS json
    FROM orders LEFT JOIN p ON p.doc_id = o_orderkey LEFT JOIN b ON b.doc_id = o_orderkey LEFT JOIN c ON c.doc_id = o_orderkey""",
)
def extraction_json(spark, sf):
    kind = F.when(F.col("block_id") == 2, "WORD").when(F.col("block_id") == 1, "key").otherwise("PARAGRAPH")
    none = F.lit(None).cast("double")
    blocks = I.blocks(spark, sf).select("*", kind.alias("block_type"), F.lit(0.1).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("w"), F.when(F.col("block_id") == 1, 0.125).otherwise(none).alias("h"))
    pages = I.pages(spark, sf).select("doc_id", "page", F.when(F.col("page") % 2 == 1, F.col("page") + 600).alias("width"), F.lit(800).alias("height"))
    return C.extraction_json(I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")), pages, blocks, I.cells(spark, sf))


@query(
    "bucket_rewrite",
    "WITH hit AS (SELECT DISTINCT l_orderkey % 16 AS bucket FROM lineitem WHERE l_orderkey % 16 IN (3, 8) AND l_quantity > 45) SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS field_id, l_partkey, CASE WHEN l_orderkey % 16 IN (3, 8) AND l_quantity > 45 THEN 'fixed' ELSE l_comment END AS value, l_orderkey % 16 IN (SELECT bucket FROM hit) AS rewritten FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag AS l_comment FROM lineitem)",
)
def bucket_rewrite(spark, sf):
    """Corrections of two buckets of a table in sixteen: all rows, and whether their file is a new one."""
    lines = I.table(spark, sf, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("field_id"), "l_partkey", F.col("l_returnflag").alias("value"), "l_quantity")
    table = B.BucketedTable(spark, fresh_folder(spark, "bucketed"), "doc_id", rows.schema, 16)
    table.create(rows)
    files = lambda: table.read().select("bucket", F.col("_metadata.file_path").alias("path")).distinct()
    before = [r.path for r in files().collect()]  # one a bucket
    changes = rows.where("doc_id % 16 in (3, 8) and l_quantity > 45").select("doc_id", "field_id", "l_partkey", F.lit("fixed").alias("fixed")).distinct()
    fix = lambda now, new: now.join(new, ["doc_id", "field_id", "l_partkey"], "left").withColumn("value", F.when((F.col("l_quantity") > 45), F.coalesce("fixed", "value")).otherwise(F.col("value"))).drop("fixed")
    table.merge(changes, fix)
    out = table.read().withColumn("rewritten", ~F.col("_metadata.file_path").isin(before))
    return out.select("doc_id", "field_id", "l_partkey", "value", "rewritten")


@query(
    "status_overlay",
    f"WITH {ORDERS_SQL} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'FAILED' WHEN doc_id % 6 = 0 THEN 'CLASSIFIED' ELSE status END AS status, CAST(CASE WHEN doc_id % 6 = 0 THEN 7 ELSE doc_type END AS INTEGER) AS doc_type, CAST(CASE WHEN doc_id % 6 = 0 THEN 0.92 END AS DOUBLE) AS confidence, doc_id % 9 = 0 OR doc_id % 6 = 0 AS updated FROM docs",
)
def status_overlay(spark, sf):
    """Classification of some documents, then a status of some: what is named changes and is updated."""
    docs = orders(spark, sf)
    at = F.timestamp_seconds(F.lit(0))
    decided = docs.where("doc_id % 6 = 0").select("doc_id", F.lit(7).alias("doc_type"), F.lit(0.92).alias("confidence"))
    changes = docs.where("doc_id % 9 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit("CAPTURED").alias("status"), F.lit(1).alias("at")), F.struct(F.lit("FAILED").alias("status"), F.lit(2).alias("at")))).alias("c")).select("doc_id", "c.*")
    out = R.with_status(R.classified(docs, decided, at), changes, at)
    return out.select("doc_id", "status", "doc_type", F.col("classify_confidence").cast("double").alias("confidence"), F.col("updated_at").isNotNull().alias("updated"))


@query("review_items", f"WITH {I.LINES_SQL} SELECT l_orderkey AS doc_id, row_idx, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(CASE WHEN row_idx % 2 = 0 THEN row_idx ELSE 1 END AS INTEGER) AS page FROM numbered")
def review_items(spark, sf):
    price = F.col("l_tax").cast("decimal(18,2)").cast("string")
    item = F.concat(F.lit('{"price":'), price, F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit(',"_pg":'), F.col("row_idx"))).otherwise(F.lit("")), F.lit("}"))
    docs = I.lines(spark, sf).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("row_idx", item.alias("j")))).alias("i"))
    json = F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x["j"]), ","), F.lit("]"))
    rows = docs.select("doc_id", R.line_items(json, ["price"]).alias("r")).select("doc_id", R.retyped(F.col("r"), {"price": "DECIMAL"}, F.lit(None).cast("string")).alias("r"))
    return rows.select("doc_id", F.posexplode("r").alias("at", "x")).select("doc_id", (F.col("at") + 1).alias("row_idx"), "x.price", "x.page")


@query("template_resolve", "SELECT o_orderkey, c_custkey AS template_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = o_orderkey % 25")
def template_resolve(spark, sf):
    picks = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("template_id"), (F.col("o_orderkey") % 25).cast("int").alias("doc_type"))
    candidates = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("template_id"), F.col("c_nationkey").cast("int").alias("doc_type"))
    return R.resolved_template(picks, candidates).select("o_orderkey", "template_id")


@query("save_validation", "SELECT n_regionkey AS template_id, lower(trim(left(n_name, 1))) AS name FROM nation GROUP BY 1, 2 HAVING count(*) > 1 AND (count(CASE WHEN n_nationkey % 5 <> 0 THEN 1 END) < count(*) OR count(DISTINCT CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey % 5 END) < count(*))")
def save_validation(spark, sf):
    role = F.when(F.col("n_nationkey") % 5 != 0, (F.col("n_nationkey") % 5).cast("string"))
    return R.duplicate_regions(I.table(spark, sf, "nation").select(F.col("n_regionkey").alias("template_id"), F.concat(F.lit(" "), F.left("n_name", F.lit(1)), F.lit(" ")).alias("name"), role.alias("role")))


@query("newest_sample", "SELECT c_mktsegment, arg_max(c_custkey, c_acctbal) AS doc_id FROM customer WHERE c_name LIKE '%1%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def newest_sample(spark, sf):
    docs = R.with_any(I.table(spark, sf, "customer").where("c_name like '%1%'"), I.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return R.newest(docs.withColumn("doc_id", F.col("c_custkey")), "c_mktsegment", "doc_id", ["c_acctbal", "c_custkey"])


@query("language_allow_list", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'tha+eng' WHEN 'fr' THEN 'tha' END AS ocr, CASE lang WHEN 'en' THEN 'CONTINUATION' WHEN 'de' THEN 'LAST' ELSE 'FIRST' END AS role FROM documents")
def language_allow_list(spark, sf):
    raw = F.when(F.col("lang") == "en", " ENG ").when(F.col("lang") == "de", "eng+tha").when(F.col("lang") == "fr", "tha").otherwise("xyz")
    role = F.when(F.col("lang") == "en", "cont").when(F.col("lang") == "de", " last").otherwise("?")
    return I.table(spark, sf, "documents").select("doc_id", N.ocr_languages(raw).alias("ocr"), N.page_role(role).alias("role"))


@query("hmac_signature")
def hmac_signature(spark, sf):
    return C.signed(I.table(spark, sf, "documents").select("doc_id", "text"), "text", "secret").select("doc_id", "signature")


@query("strip_internal_keys", "SELECT p_partkey, '{\"rows\":[{\"q\":1.50}],\"n\":\"' || p_name || '\"}' AS json FROM part")
def strip_internal_keys(spark, sf):
    text = F.concat(F.lit('{"_id": 1, "rows": [{"q": 1.50, "_pg": 2}], "n": "'), F.col("p_name"), F.lit('"}'))
    return C.stripped(I.table(spark, sf, "part").select("p_partkey", text.alias("json")), "json")


@query("stream_capture", f"WITH {I.BLOCKS_SQL} SELECT doc_id, count(*) AS n_blocks FROM blocks GROUP BY doc_id")
def stream_capture(spark, sf):
    """Blocks land as files that cut through documents, are mapped in micro-batches and read back; the result is that of the batch."""
    root, rows = fresh_folder(spark, "stream"), I.blocks(spark, sf)
    rows.repartition(3, "block_id").write.parquet(f"{root}/landing")
    stream = Z.read_landing(spark, f"{root}/landing", rows.schema, 2)
    mapper = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    Z.write_mapped(stream, mapper, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return Z.read_mapped(spark, f"{root}/out")


LATENESS, BASE = 40.0, 6.0


def job_succeeds(doc_id: int, attempt: int) -> bool:
    """The outcomes of this query: some documents fail at some attempts, some at all."""
    return doc_id % 11 != 0 and (doc_id * 7 + attempt * 3) % 4 != 0


_OK = "(doc_id % 11 <> 0 AND (doc_id * 7 + {n} * 3) % 4 <> 0)"


@query(
    "stream_jobs",
    f"""WITH firsts AS (SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1),
    j AS (SELECT *, CASE WHEN {_OK.format(n=1)} THEN 1 WHEN {_OK.format(n=2)} THEN 2 WHEN {_OK.format(n=3)} THEN 3 ELSE 4 END AS won FROM firsts)
    SELECT sha256, doc_id, CAST(n AS INTEGER) AS attempt, CAST(1704067200000 + doc_id * 1000 + 40000 + 6000 * (2 ** (n - 1) - 1) AS BIGINT) AS at_ms, CASE WHEN n = won THEN 'MAPPED' WHEN n = 3 THEN 'FAILED' ELSE 'CAPTURED' END AS to_status
    FROM j, (VALUES (1), (2), (3)) t(n) WHERE n <= won""",
)
def stream_jobs(spark, sf):
    """Uploads land in three parts, some behind their time, and the query is started anew for each; equal contents are one job, failures are tried again by timers."""
    landing, out, checkpoint = (fresh_folder(spark, f"jobs-{k}") for k in ("landing", "out", "checkpoint"))
    second = lambda n: F.timestamp_seconds(F.lit(1704067200) + n)
    rows = I.table(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id", second(F.col("doc_id")).alias("at"))
    last = rows.agg(F.max("doc_id")).first()[0] or 0
    part = last // 3 + 1
    behind = (F.col("doc_id") % 5 == 0) & (F.col("doc_id") % part >= part - 30)  # less than the lateness
    parts = rows.withColumn("part", F.least(F.lit(2), F.floor(F.col("doc_id") / part) + behind.cast("int")))
    end = spark.range(1).select(F.lit("end").alias("sha256"), F.lit(None).cast("bigint").alias("doc_id"), second(F.lit(last + 3600)).alias("at"))  # it only moves time on
    rows.limit(0).write.parquet(landing)  # the folder has to be there before it is read
    span = last - (rows.agg(F.min("doc_id")).first()[0] or 0) + 7200.0  # equal contents are one job however far apart they are uploaded
    stream = J.run_jobs(spark.readStream.schema(rows.schema).parquet(landing), job_succeeds, LATENESS, 3, BASE, span)
    for landed in [*(parts.where(F.col("part") == k).drop("part") for k in range(3)), end]:
        landed.write.mode("append").parquet(landing)
        J.write_batches(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("sha256", "doc_id", "attempt", "at_ms", "to_status")


@query("mode_routing", f"WITH {ORDERS_SQL} SELECT doc_type, CASE WHEN doc_type = 0 THEN 'INLINE' ELSE 'QUEUE' END AS route, count(*) AS n FROM docs GROUP BY 1, 2")
def mode_routing(spark, sf):
    mode = F.when(F.col("doc_type") == 0, "REALTIME").otherwise("QUEUE")
    return orders(spark, sf).groupBy("doc_type", R.processing_route(mode).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("upload_validation", "SELECT p_partkey FROM part WHERE p_size % 5 > 0 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_partkey % 40)")
def upload_validation(spark, sf):
    """Files that are not empty and name an existing template."""
    rows = I.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).alias("length"), (F.col("p_partkey") % 40).cast("int").alias("template_id"))
    return R.valid_uploads(rows, I.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("template_id"))).select("p_partkey")


@query(
    "review_hydrate",
    f"""WITH {I.BLOCKS_SQL}, f AS (SELECT * FROM (VALUES (1, 'invoice_id'), (2, 'invoice_date'), (4, 'total')) v(field_id, label)) SELECT doc_id, field_id, label, content, CASE WHEN confidence < 0.7 THEN 'Low' WHEN confidence >= 0.85 THEN 'High' ELSE 'Medium' END AS band,
      'block-' || block_id AS anchor FROM blocks JOIN f ON field_id = block_id""",
)
def review_hydrate(spark, sf):
    fields = spark.createDataFrame([(1, "invoice_id"), (2, "invoice_date"), (4, "total")], "field_id int, zone_label string")
    ref = F.concat(F.lit("TextBlock:"), F.col("block_id"))
    values = I.blocks(spark, sf).where("block_id in (1, 2, 4)").select("doc_id", F.col("block_id").cast("int").alias("field_id"), "content", "confidence", ref.alias("source_ref"))
    return R.review_values(values, fields, 0.70).select("doc_id", "field_id", F.col("zone_label").alias("label"), "content", "band", "anchor")


@query(
    "document_detail",
    f"""WITH {I.BLOCKS_SQL} SELECT o_orderkey AS doc_id, (SELECT count(*) FROM blocks WHERE doc_id = o_orderkey) AS blocks, (SELECT string_agg(content, '|' ORDER BY block_id) FROM blocks WHERE doc_id = o_orderkey AND block_id < 4) AS properties,
      (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS result_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS exports FROM orders""",
)
def document_detail(spark, sf):
    docs, own = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")), I.blocks(spark, sf)
    lines = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_quantity")
    results = lines.withColumnRenamed("l_linenumber", "result_id")
    detail = R.document_detail(docs, results, own.select("doc_id", "block_id", "content"), own.where("block_id < 4").select("doc_id", F.col("block_id").alias("property"), "content"), lines.withColumnRenamed("l_linenumber", "attempt"))
    count = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("bigint")
    return detail.select("doc_id", count("blocks").alias("blocks"), F.array_join(F.transform("properties", lambda p: p["content"]), "|").alias("properties"), F.col("result.result_id").alias("result_id"), count("exports").alias("exports"))
