import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import capture, jobs

START = datetime.datetime(2024, 1, 1)
UPLOADS = "sha256 string, doc_id bigint, at timestamp"


@pytest.fixture
def queue(spark, tmp_path):
    """Feed uploads (hash, doc, second) of one batch, from a query that is started anew; gives all events so far."""
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    spark.createDataFrame([], UPLOADS).write.parquet(landing)

    def fails_twice(doc_id, n):
        return n == 3 if doc_id == 2 else doc_id != 3

    def feed(rows):
        rows = [(h, d, START + datetime.timedelta(seconds=s)) for h, d, s in rows]
        spark.createDataFrame(rows, UPLOADS).coalesce(1).write.mode("append").parquet(landing)
        stream = jobs.run_jobs(spark.readStream.schema(UPLOADS).parquet(landing), fails_twice, 10, 3, 4, 100)
        jobs.write_batches(stream, out, checkpoint).awaitTermination()
        zero = int(START.replace(tzinfo=datetime.timezone.utc).timestamp())
        found = spark.read.schema(jobs.EVENTS + ", batch int").parquet(out).collect()
        return sorted((r.sha256, r.doc_id, r.attempt, r.at_ms // 1000 - zero, r.to_status) for r in found)

    return feed


def test_the_earliest_of_equal_uploads_is_the_job_and_failures_are_tried_again(queue):
    assert queue([("a", 1, 5), ("b", 2, 3), ("a", 9, 6)]) == []  # none of them can begin yet
    assert queue([("a", 4, 2), ("c", 3, 14)]) == []  # out of order, but not later than the lateness: it is the job
    done = queue([("a", 5, 26), ("x", 8, 30)])  # time is 20: a began at 12, b at 13 and again at 17, and will at 25
    assert done == [("a", 4, 1, 12, "MAPPED"), ("b", 2, 1, 13, "CAPTURED"), ("b", 2, 2, 17, "CAPTURED")]
    done = queue([("y", 8, 60)])
    assert [e for e in done if e[0] in "abc"] == [("a", 4, 1, 12, "MAPPED"), ("b", 2, 1, 13, "CAPTURED"), ("b", 2, 2, 17, "CAPTURED"), ("b", 2, 3, 25, "MAPPED"), ("c", 3, 1, 24, "CAPTURED"), ("c", 3, 2, 28, "CAPTURED"), ("c", 3, 3, 36, "FAILED")]
    again = queue([("b", 7, 55), ("y", 8, 61)])  # finished jobs are not begun again
    assert [e for e in again if e[0] == "b"] == [e for e in done if e[0] == "b"]


def test_finished_jobs_are_forgotten_after_the_retention(queue):
    queue([("a", 1, 0)])
    queue([("t", 8, 500)])
    assert [e for e in queue([("a", 1, 600), ("t2", 8, 700)]) if e[0] == "a"] == [("a", 1, 1, 10, "MAPPED"), ("a", 1, 1, 610, "MAPPED")]


def test_documents_are_assembled_from_files_and_repeats_change_nothing(spark, tmp_path):
    schema = "doc_id bigint, page int, block_id bigint, content string"
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    for k, rows in enumerate([[(1, 1, 1, "a"), (2, 1, 1, "x")], [(1, 1, 2, "b")], [(1, 1, 2, "b"), (3, 1, 1, "q")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = capture.read_landing(spark, landing, spark.read.parquet(landing).schema)
        capture.write_mapped(stream, lambda df: df.groupBy("doc_id").agg(F.sort_array(F.collect_list("content")).alias("texts")), out, checkpoint).awaitTermination()
    assert {r.doc_id: r.texts for r in capture.read_mapped(spark, out).collect()} == {1: ["a", "b"], 2: ["x"], 3: ["q"]}
    # a batch maps what it touches, not what has landed before
    assert {r.batch: r.n for r in spark.read.parquet(f"{out}/mapped").groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 2, 1: 1, 2: 2}


def test_rows_without_keys_are_assembled_without_python(spark, tmp_path):
    """Equal rows of one file, of another and of a replay are one; nulls count; with keys the last row of a key holds."""
    schema = "doc_id bigint, block_id bigint, content string, confidence decimal(5,4)"
    landing, c = f"{tmp_path}/landing", Decimal("0.5000")
    files = [[(1, 1, "a", c), (1, 1, "a", c), (1, 2, None, None)], [(1, 1, "a", c), (1, 2, "b", c)], [(1, 2, None, None), (2, 1, "x", c)]]
    for out, keys, kept, want in (("all", None, "stateStoreSave", {1: ["a", "b"], 2: ["x"]}), ("keyed", ("doc_id", "block_id"), "transformWithStateInPySparkExec", {1: ["a"], 2: ["x"]})):
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{landing}-{out}")
            stream = capture.read_landing(spark, f"{landing}-{out}", spark.read.parquet(f"{landing}-{out}").schema)
            mapper = lambda df: df.groupBy("doc_id").agg(F.sort_array(F.collect_list("content")).alias("texts"), F.count(F.lit(1)).alias("n"))
            query = capture.write_mapped(stream, mapper, f"{tmp_path}/{out}", f"{tmp_path}/checkpoint-{out}", row_keys=keys)
            query.awaitTermination()
            assert {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]} == {kept}
        found = capture.read_mapped(spark, f"{tmp_path}/{out}").collect()
        assert {r.doc_id: r.texts for r in found} == want
        assert {r.doc_id: r.n for r in found}[1] == (3 if keys is None else 2)


def test_equal_contents_far_apart_are_one_job(spark, tmp_path):
    """Uploads of one content that lie more than a day apart, as ids of large tables do."""
    from paperloom.plans.record_queries import stream_jobs

    rows = [(2, "a"), (7, "b"), (100_002, "c"), (150_000, "a"), (300_006, "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = stream_jobs(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {2, 7, 100_002} and len({(r.sha256, r.attempt) for r in found}) == len(found)
