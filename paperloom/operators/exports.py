"""Export as an outbox: what is to be sent is derived, each attempt has a key of its own, and the log of attempts only grows.

A send is a ready document's latest mapped result to one of its targets.  Its key is made of document, result, target and
round (a manual re-export is a further round), so that a replay finds its attempts in the log and sends nothing again;
the key also goes with the request, for a receiver to tell a repeat after a lost task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.normalize import is_blank
from paperloom.operators import records as R
from paperloom.session import ship
from paperloom.sources import capture as C

READY = ("VALIDATED", "CONSUMED")
LOG = "attempt_key string, doc_id bigint, target_id int, round int, status_code string, http_status int, response_snippet string, attempt int"
SNIPPET = 500
#: An exporter takes one send (a dict of its columns) and answers (succeeded, HTTP status or None, response).
Exporter = Callable[[dict], tuple[bool, int | None, str | None]]


def exportable(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Documents that may go out, with their latest result (result_id, json): ready ones whose last result has a model; nothing else is sent in its place."""
    last = R.latest(results, "doc_id", "result_id").select("doc_id", "result_id", "json")
    return documents.where(F.col("status").isin(*READY)).join(last, "doc_id").where(~is_blank(F.col("json")))


def sends(documents: DataFrame, results: DataFrame, targets: DataFrame, round_: int = 1) -> DataFrame:
    """attempt_key, doc_id, target_id, round, body and the target's columns: a row for each ready document and matching active target."""
    bodies = C.stripped(exportable(documents, results), "json").withColumnRenamed("json", "body")
    about = targets.select("target_id", *[c for c in ("name", "kind", "endpoint", "auth_header", "secret") if c in targets.columns])
    rows = R.matching_targets(bodies, targets).join(about, "target_id")
    key = F.sha2(F.concat_ws("|", "doc_id", "result_id", "target_id", F.lit(round_)), 256)
    return rows.select(key.alias("attempt_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "target_id", F.lit(round_).alias("round"), "body", *about.columns[1:])


def unsent(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Sends without an attempt in the log."""
    return rows.join(log.select("attempt_key"), "attempt_key", "left_anti")


def dispatched(rows: DataFrame, exporters: dict[str, Exporter]) -> DataFrame:
    """Each send through the exporter of its target's kind, whatever its letter case -> rows of the log.  A kind without one fails, and says so."""
    ship(rows.sparkSession)
    by_kind = {kind.lower(): send for kind, send in exporters.items()}

    def one(send: dict) -> tuple:
        exporter = by_kind.get((send["kind"] or "").lower())
        done, http, text = exporter(send) if exporter else (False, None, f"No exporter registered for kind '{send['kind']}'")
        return send["attempt_key"], send["doc_id"], send["target_id"], send["round"], "SUCCESS" if done else "FAILED", http, None if text is None else text[:SNIPPET], 1

    names = [part.split()[0] for part in LOG.split(", ")]

    def run(batches):
        for batch in batches:
            made = pd.DataFrame([one(s) for s in batch.astype(object).where(batch.notna(), None).to_dict("records")], columns=names)
            yield made.assign(http_status=made["http_status"].astype("Int32"))

    return rows.mapInPandas(run, LOG)


def http_exporter(timeout: float = 30.0) -> Exporter:
    """A webhook: the exact body with its signature, the target's header, and the attempt's key."""
    def send(row: dict) -> tuple[bool, int | None, str | None]:
        done, http, text = C.request(row.get("endpoint"), row["body"], row.get("secret") or "", row.get("auth_header"), timeout, {"X-Attempt-Key": row["attempt_key"]})
        return done, http, text

    return send


def export_log(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts so far; an empty log where nothing was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(folder)


def run_exports(documents: DataFrame, results: DataFrame, targets: DataFrame, exporters: dict[str, Exporter], folder: str, round_: int = 1) -> DataFrame:
    """Send what has no attempt yet, and append the attempts to the log in one commit; gives the whole log.  A replay adds nothing."""
    spark = documents.sparkSession
    todo = unsent(sends(documents, results, targets, round_), export_log(spark, folder))
    dispatched(todo, exporters).write.mode("append").parquet(folder)
    return export_log(spark, folder)


def outcome(documents: DataFrame, results: DataFrame, log: DataFrame, round_: int = 1) -> DataFrame:
    """doc_id, from_status, to_status, note of the documents that an export concerns: consumed if all of a round's attempts succeeded, else as before.

    Without an active target nothing is consumed, and the event says so.  A failed document has no event, its log tells.
    """
    tried = log.where(F.col("round") == round_).groupBy("doc_id").agg(F.count(F.lit(1)).alias("ran"), F.bool_and(F.col("status_code") == "SUCCESS").alias("done"))
    rows = exportable(documents, results).select(F.col("doc_id").cast("bigint").alias("doc_id"), "status").join(tried, "doc_id", "left")
    note = F.when(F.col("ran").isNull(), "No active export target — nothing exported").otherwise(F.concat(F.lit("Exported to "), F.col("ran"), F.lit(" target(s)")))
    rows = rows.where(F.col("ran").isNull() | F.col("done"))
    return rows.select("doc_id", F.col("status").alias("from_status"), F.when(F.col("ran").isNull(), F.col("status")).otherwise("CONSUMED").alias("to_status"), note.alias("note"))


def all_targets(targets: DataFrame) -> DataFrame:
    return targets.orderBy("name")


def target_by_id(targets: DataFrame, target_id: int) -> DataFrame:
    return targets.where(F.col("target_id") == target_id)
