"""Queries of the store: captured files, pages, templates with their samples, users and re-exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import records as R
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog
from paperloom.plans.record_queries import ORDERS_SQL, TARGETS_SQL, orders, targets
from paperloom.sources import capture as C
from paperloom.sources import recognizer as W

CATALOG = Catalog()
query = CATALOG.query


@query(
    "captured_documents",
    """SELECT md5('/in/' || doc_id || '.pdf') AS doc_id, sha256(coalesce(text, '')) AS sha256, 'UPLOAD' AS channel, 'CAPTURED' AS status, 3 AS template_id, CAST(1 AS INTEGER) AS event_id FROM documents""",
)
def captured_documents(spark, sf):
    text = F.coalesce("text", F.lit(""))
    stored = I.table(spark, sf, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    documents, events = C.captured(stored, "UPLOAD", template_id=3)
    return documents.join(events.select("doc_id", "event_id"), "doc_id").select("doc_id", "sha256", "channel", "status", "template_id", "event_id")


@query("page_counts", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 1 AND doc_id % 2 = 0 THEN CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS INTEGER) ELSE 1 END AS page_count FROM documents")
def page_counts(spark, sf):
    """A blank ends a page of these documents; a type or a file name makes them PDF."""
    path = F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".png"))
    kind = F.when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0), "application/pdf")
    stored = I.table(spark, sf, "documents").select("doc_id", path.alias("path"), kind.alias("content_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return C.page_counts(stored, lambda content: content.count(b" ") + 1).select("doc_id", "page_count")


@query("page_images", "SELECT o_orderkey AS doc_id, l_linenumber - 1 AS page, 'store/' || o_orderkey || '.page-' || (l_linenumber - 1) || '.png' AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 1 AND (o_custkey % 4 = 0 OR l_linenumber - 1 <= o_custkey % 4)")
def page_images(spark, sf):
    documents = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("store/"), F.col("o_orderkey"), F.lit(".pdf")).alias("path"), (F.col("o_custkey") % 4).alias("page_count"))
    wanted = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page"))
    return C.page_images(documents, wanted)


@query("template_list", "SELECT c_custkey AS template_id, n_name AS type_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS field_count FROM customer JOIN nation ON n_nationkey = c_nationkey")
def template_list(spark, sf):
    templates = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("template_id"), F.col("c_nationkey").alias("type_id"), F.col("c_name").alias("name"), F.lit(1).alias("version"))
    types = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("name"))
    fields = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("template_id"))
    return R.template_list(templates, types, fields).select("template_id", "type_name", "field_count")


@query("created_templates", "SELECT n_nationkey AS template_id, n_name AS name, 2 AS version FROM nation UNION ALL SELECT * FROM (VALUES (25, 'a', 1), (26, 'b', 1)) v")
def created_templates(spark, sf):
    templates = I.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("template_id"), F.col("n_name").alias("name"), F.lit(2).alias("version"), F.lit(True).alias("is_active"))
    return R.created_templates(templates, spark.createDataFrame([("b",), ("a",)], "name string")).select("template_id", "name", "version")


@query(
    "sample_binding",
    """WITH s AS (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderpriority LIKE '%URGENT%' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
    SELECT n_nationkey AS template_id, CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_regionkey AS BIGINT) WHEN lower(n_name) LIKE '%an%' THEN (SELECT k FROM s) END AS sample_doc_id FROM nation""",
)
def sample_binding(spark, sf):
    own = F.when(F.col("n_nationkey") % 2 == 1, F.col("n_regionkey").cast("bigint"))
    templates = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("template_id"), F.col("n_name").alias("name"), own.alias("sample_doc_id"))
    documents = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("file_name"), F.col("o_orderdate").alias("created"))
    pages = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    return R.bound_newest_sample(templates, documents, pages, "urgent", "an").select("template_id", "sample_doc_id")


@query("user_roles", "SELECT c_custkey AS user_id, n_name AS role_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def user_roles(spark, sf):
    people = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"), F.col("c_mktsegment").alias("email"), (F.col("c_acctbal") > 0).alias("is_active"))
    roles = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role_name"))
    return R.role_names(R.user_by_email(people, "BUILDING").select("user_id", "role_id"), roles)


@query("ensured_columns", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS target FROM nation")
def ensured_columns(spark, sf):
    rows = I.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return R.ensure_columns(R.ensure_columns(rows, {"target": "string"}), {"TARGET": "int", "N_NAME": "int"})


@query("reexport", f"WITH {ORDERS_SQL}, {TARGETS_SQL} SELECT doc_id, target_id FROM docs JOIN targets ON is_active AND (t_type IS NULL OR t_type = doc_type) WHERE status IN ('VALIDATED', 'CONSUMED') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND l_quantity > 40)")
def reexport(spark, sf):
    wanted = I.table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("doc_id"))
    return R.reexported(orders(spark, sf), targets(spark), wanted).select("doc_id", "target_id")


@query("template_columns", "SELECT o_orderkey AS field_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY row_idx) AS columns FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(I.LINE_ORDER) + ") AS row_idx FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'N' OR o_orderstatus = 'F' AND l_returnflag = 'A' GROUP BY 1")
def template_columns(spark, sf):
    fields = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("field_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("template_id"))
    columns = I.lines(spark, sf).select(F.col("l_orderkey").alias("field_id"), F.col("row_idx").alias("sort_order"), "l_partkey", F.col("l_returnflag").isin("N", "A").alias("is_active"))
    found = R.template_columns(fields, columns, 1, ["l_partkey"])
    return found.select("field_id", F.array_join(F.transform("columns", lambda c: c["l_partkey"].cast("string")), ",").alias("columns"))


@query(
    "save_result",
    """WITH r AS (SELECT l_orderkey AS doc_id, CAST(max(l_linenumber) AS BIGINT) AS last FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey AS doc_id, coalesce(last, 0) + 1 AS result_id FROM orders LEFT JOIN r ON doc_id = o_orderkey WHERE o_orderstatus = 'O')
    , v AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS result_id, 'old' AS value FROM lineitem UNION ALL SELECT doc_id, result_id, v FROM f, (VALUES ('total'), ('date')) t(v))
    SELECT *, max(result_id) OVER (PARTITION BY doc_id) AS latest FROM v""",
)
def save_result(spark, sf):
    """Every result's values after the open orders got a further result of two values."""
    old = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("result_id"))
    headers = I.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("doc_id"))
    lines = headers.select("doc_id", F.explode(F.array(F.lit("total"), F.lit("date"))).alias("value"))
    results, values = R.saved_results(old, old.withColumn("value", F.lit("old")), headers, lines)
    last = results.groupBy("doc_id").agg(F.max("result_id").alias("latest"))
    return values.join(last, "doc_id").select("doc_id", "result_id", "value", "latest")


@query(
    "recognizer_words",
    """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_suppkey AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y, l_partkey % 5 AS odd, 500 + l_orderkey % 100 AS width, l_orderkey % 9 AS bad FROM lineitem)
    SELECT doc_id, 'w' || n AS text, x / width AS x, y / 400.0 AS y, (x + 20 - x) / width AS w, (y + 8 - y) / 400.0 AS h, CASE WHEN odd = 1 THEN 0.0 ELSE 0.75 END AS conf FROM w WHERE bad <> 0 AND odd NOT IN (2, 3)""",
)
def recognizer_words(spark, sf):
    """Recognizer answers as JSON, some of pages without width, with words without text, score or box."""
    odd, x, y = F.col("l_partkey") % 5, F.col("l_suppkey").cast("double"), F.col("l_quantity").cast("double")
    box = F.concat(F.lit("["), x, F.lit(","), y, F.when(odd == 2, "]").otherwise(F.concat(F.lit(","), x + 20, F.lit(","), y + 8, F.lit("]"))))
    word = F.concat(F.lit('{"text":"'), F.when(odd == 3, " ").otherwise(F.concat(F.lit(" w"), F.col("l_linenumber"))), F.lit('","bbox":'), box, F.when(odd == 1, "}").otherwise(',"conf":0.75}'))
    rows = I.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(word)), ",").alias("w"))
    width = F.when(F.col("doc_id") % 9 == 0, 0).otherwise(500 + F.col("doc_id") % 100)
    answer = F.concat(F.lit('{"page_width":'), width, F.lit(',"page_height":400,"words":['), F.col("w"), F.lit("]}"))
    return rows.select("doc_id", F.explode(W.words(answer)).alias("b")).select("doc_id", "b.*")
