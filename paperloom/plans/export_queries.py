"""Queries of the export outbox: orders as documents, their lines as mapped results."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from paperloom.operators import exports as X
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog
from paperloom.plans.record_queries import ORDERS_SQL, orders
from paperloom.session import fresh_folder

CATALOG = Catalog()
query = CATALOG.query
TARGETS = [(1, "all", "rest_webhook", None, True), (2, "one", "REST_WEBHOOK", 1, True), (3, "two", "FTP", 2, True), (4, "off", "REST_WEBHOOK", 1, False), (5, "three", "ERP", 3, True)]
_TARGETS_SQL = "targets AS (SELECT * FROM (VALUES (1, 'rest_webhook', NULL, TRUE), (2, 'REST_WEBHOOK', 1, TRUE), (3, 'FTP', 2, TRUE), (4, 'REST_WEBHOOK', 1, FALSE), (5, 'ERP', 3, TRUE)) v(target_id, kind, t_type, is_active))"


def webhook(send: dict) -> tuple[bool, int, str]:
    """A receiver of this query that refuses some documents and answers with the digest of what it got."""
    refused = send["doc_id"] % 7 == 0
    return not refused, 500 if refused else 200, hashlib.md5(send["body"].encode()).hexdigest()


EXPORTERS = {"Rest_Webhook": webhook, "erp": lambda send: (False, None, "no ERP client is configured")}
#: Every line of an order is one of its results; the last of some has no model.
_LAST = "latest AS (SELECT l_orderkey AS doc_id, max(l_linenumber) AS n, arg_max(l_partkey, l_linenumber) AS part FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1)"
_SENT = f"""WITH {ORDERS_SQL}, {_TARGETS_SQL}, {_LAST}, ready AS (SELECT d.doc_id, d.status, d.doc_type, '{{"id":' || d.doc_id || ',"rows":[{{"part":' || part || '.00}}]}}' AS body FROM docs d JOIN latest l USING (doc_id) WHERE status = 'VALIDATED' AND n % 4 <> 0),
log AS (SELECT doc_id, target_id, CASE WHEN lower(kind) = 'rest_webhook' AND doc_id % 7 <> 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status_code, CASE WHEN lower(kind) = 'rest_webhook' THEN CASE WHEN doc_id % 7 = 0 THEN 500 ELSE 200 END END AS http_status,
  CASE lower(kind) WHEN 'rest_webhook' THEN md5(body) WHEN 'erp' THEN 'no ERP client is configured' ELSE 'No exporter registered for kind ''' || kind || '''' END AS response_snippet FROM ready JOIN targets ON is_active AND (t_type IS NULL OR t_type = doc_type))"""


def _inputs(spark, sf):
    one = I.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    json = F.concat(F.lit('{"id":'), F.col("l_orderkey"), F.lit(',"_run":3,"rows":[{"part":'), F.col("part"), F.lit('.00,"_pg":1}]}'))
    results = one.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("result_id"), F.when(F.col("l_linenumber") % 4 != 0, json).otherwise(" ").alias("json"))
    return orders(spark, sf), results, spark.createDataFrame(TARGETS, "target_id int, name string, kind string, doc_type int, is_active boolean")


@query("export_log", f"{_SENT} SELECT doc_id, target_id, status_code, CAST(http_status AS INTEGER) AS http_status, response_snippet FROM log")
def export_log(spark, sf):
    """The log after a run, a replay of it, and a replay that met only half of the documents."""
    documents, results, targets = _inputs(spark, sf)
    folder = fresh_folder(spark, "export-log")
    X.run_exports(documents.where("doc_id % 2 = 0"), results, targets, EXPORTERS, folder)
    X.run_exports(documents, results, targets, EXPORTERS, folder)
    log = X.run_exports(documents, results, targets, EXPORTERS, folder)
    return log.select("doc_id", "target_id", "status_code", "http_status", "response_snippet")


@query(
    "export_events",
    f"""{_SENT} SELECT r.doc_id, r.status AS from_status, CASE WHEN n IS NULL THEN r.status ELSE 'CONSUMED' END AS to_status, CASE WHEN n IS NULL THEN 'No active export target — nothing exported' ELSE 'Exported to ' || n || ' target(s)' END AS note
    FROM ready r LEFT JOIN (SELECT doc_id, count(*) AS n, bool_and(status_code = 'SUCCESS') AS done FROM log WHERE target_id > 1 GROUP BY 1) l USING (doc_id) WHERE n IS NULL OR done""",
)
def export_events(spark, sf):
    """What an export does to documents, where only targets of a type are active."""
    documents, results, targets = _inputs(spark, sf)
    log = X.run_exports(documents, results, targets.where("target_id > 1"), EXPORTERS, fresh_folder(spark, "export-log"))
    return X.outcome(documents, results, log)
