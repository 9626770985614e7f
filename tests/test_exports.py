from pyspark.sql import functions as F

from paperloom.operators import exports as X

DOCS = "doc_id bigint, doc_type int, status string"
RESULTS = "doc_id bigint, result_id bigint, json string"
TARGETS = "target_id int, name string, kind string, endpoint string, auth_header string, secret string, doc_type int, is_active boolean"


def inputs(spark):
    docs = spark.createDataFrame([(1, 1, "VALIDATED"), (2, 1, "NEEDS_REVIEW"), (3, 2, "CONSUMED"), (4, 1, "VALIDATED"), (5, 9, "VALIDATED"), (6, 1, "VALIDATED")], DOCS)
    results = spark.createDataFrame([(1, 1, '{"a":1}'), (1, 2, '{"a":2.50,"_x":1}'), (2, 1, "{}"), (3, 1, "{}"), (4, 1, '{"a":1}'), (4, 2, "  "), (5, 1, "{}")], RESULTS)
    targets = spark.createDataFrame([(1, "b", "HOOK", None, None, "s", 1, True), (2, "a", "other", None, None, None, 1, True), (3, "c", "hook", None, None, None, 2, True), (4, "d", "hook", None, None, None, 2, False)], TARGETS)
    return docs, results, targets


def test_guards_kinds_and_replays(spark, tmp_path):
    def hook(send):
        return True, 204, send["body"] + "x" * 600

    folder = str(tmp_path / "log")
    docs, results, targets = inputs(spark)
    log = X.run_exports(docs, results, targets, {"Hook": hook}, folder)
    first = sorted(tuple(r) for r in log.collect())
    got = {(r.doc_id, r.target_id): r for r in log.collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 3)}  # not ready, without a model in the last result, inactive, of no target: not sent
    assert got[1, 1].response_snippet.startswith('{"a":2.50}xxx') and len(got[1, 1].response_snippet) == 500 and (got[1, 1].status_code, got[1, 1].http_status) == ("SUCCESS", 204)
    assert (got[1, 2].status_code, got[1, 2].http_status, got[1, 2].response_snippet) == ("FAILED", None, "No exporter registered for kind 'other'")
    assert {(r.doc_id, r.to_status, r.note) for r in X.outcome(docs, results, log).collect()} == {(3, "CONSUMED", "Exported to 1 target(s)"), (5, "VALIDATED", "No active export target — nothing exported")}

    def never(send):
        raise AssertionError("a replay sends nothing")

    assert sorted(tuple(r) for r in X.run_exports(docs, results, targets, {"hook": never, "other": never}, folder).collect()) == first
    again = X.run_exports(docs.where("doc_id = 1"), results, targets, {"hook": hook, "OTHER": hook}, folder, round_=2)  # a manual re-export
    assert again.count() == 5 and {(r.doc_id, r.to_status) for r in X.outcome(docs.where("doc_id = 1"), results, again, 2).collect()} == {(1, "CONSUMED")}


def test_nothing_to_send(spark, tmp_path):
    docs, results, targets = inputs(spark)
    assert X.run_exports(docs.limit(0), results, targets, {}, str(tmp_path / "log")).collect() == []
    assert [r.name for r in X.all_targets(targets).collect()] == ["a", "b", "c", "d"] and X.target_by_id(targets, 3).first().name == "c"


def test_http_exporter_answers_failures(spark):
    send = X.http_exporter(1.0)
    row = {"endpoint": None, "body": "{}", "secret": None, "auth_header": None, "attempt_key": "k"}
    assert send(row) == (False, None, "No endpoint configured")
    done, http, text = send(row | {"endpoint": "http://127.0.0.1:1/"})
    assert not done and http is None and text.startswith("HTTP error")
    assert X.unsent(spark.createDataFrame([("k",), ("m",)], "attempt_key string"), spark.createDataFrame([("k",)], "attempt_key string")).select(F.col("attempt_key")).first()[0] == "m"
