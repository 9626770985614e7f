import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import images
from paperloom.functions import scalars as S
from paperloom.operators import records as R
from paperloom.sources import capture as C
from paperloom.streaming import capture as Z


def test_junk_bands_and_patterns(spark):
    df = spark.createDataFrame([("INT", "1", False), ("INT", "๑", False), ("INT", "ม", True), ("INT", "", True), ("DECIMAL", "—", True), ("STRING", "ม", False)], "t string, v string, want boolean")
    assert df.where(S.junk_anchor(F.col("v"), F.col("t")) != F.col("want")).count() == 0
    bands = spark.createDataFrame([(None,), (0.59,), (0.6,), (0.79,), (0.8,)], "c double").select(S.confidence_band(F.col("c"), 0.60)).collect()
    assert [b[0] for b in bands] == ["Low", "Low", "Medium", "Medium", "High"]
    assert S.key_pattern("Total (USD)") == r"^Total\ \(USD\)$" and S.pattern_label(S.key_pattern("Total (USD)")) == "Total (USD)"


def test_line_items_keep_number_text_and_pages(spark):
    df = spark.createDataFrame([('[{"qty":1,"_pg":1,"p":100.00},{"qty":2,"_pg":3},{"qty":3}]',)], "j string")
    rows = df.select(R.line_items(F.col("j"), ["qty", "p"])).first()[0]
    assert [(r.qty, r.p, r.page) for r in rows] == [("1", "100.00", 1), ("2", "", 3), ("3", "", 1)]


def test_strip_sign_and_post(spark):
    assert C.strip_internal('{"a":100.00,"_b":1,"c":[{"_pg":2,"d":1}]}') == '{"a":100.00,"c":[{"d":1}]}' and C.strip_internal("not json") == "not json"
    assert C.signature("key", "The quick brown fox jumps over the lazy dog") == "sha256=f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, body string")
    sent = C.post(df, "body", lambda body, sign: (body == "a", sign * 20), "k").collect()
    assert {r.doc_id: r.succeeded for r in sent} == {1: True, 2: False} and all(len(r.response) == 500 for r in sent)


def test_export_only_if_all_succeed(spark):
    docs = spark.createDataFrame([(1, "VALIDATED"), (2, "VALIDATED"), (3, "VALIDATED"), (4, "MAPPED")], "doc_id int, status string")
    tried = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (4, True)], "doc_id int, succeeded boolean")
    assert {r.doc_id: r.status for r in R.consumed(docs, tried).collect()} == {1: "CONSUMED", 2: "VALIDATED", 3: "VALIDATED", 4: "MAPPED"}


def test_duplicate_regions(spark):
    rows = [(1, "Items", "FIRST"), (1, " items", "LAST"), (2, "x", "FIRST"), (2, "X", "FIRST"), (3, "y", None), (3, "y", "LAST"), (4, "alone", None)]
    assert sorted(r.template_id for r in R.duplicate_regions(spark.createDataFrame(rows, "template_id int, name string, role string")).collect()) == [2, 3]


def test_fallback_of_a_source(spark):
    def down(batch: pd.DataFrame) -> pd.DataFrame:
        raise ConnectionError

    pages = spark.createDataFrame([(1,), (2,)], "page int")
    got = C.recognized(pages, down, "page int, text string", lambda b: b.assign(text="other")).collect()
    assert {r.text for r in got} == {"other"}


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    rows = spark.createDataFrame([(i % 7, i) for i in range(40)], "doc_id bigint, n int")
    rows.repartition(4, "n").write.parquet(landing)  # the rows of a document are in several files
    mapper = lambda df: df.groupBy("doc_id").agg(F.sum("n").alias("s"))
    for checkpoint in (mark, mark, mark + "-lost"):
        Z.write_mapped(Z.read_landing(spark, landing, rows.schema, 1), mapper, out, checkpoint).awaitTermination()
    assert sorted(map(tuple, Z.read_mapped(spark, out).collect())) == sorted(map(tuple, mapper(rows).collect()))


def test_images():
    page = np.full((60, 80), 255, np.uint8)
    page[20:22, 10:70] = 0
    assert images.ink_profile(page)[20] == 60 and images.ink_profile(page).sum() == 120 and images.skew_degrees(page) == 0.0
    noisy = page.copy()
    noisy[40, 40] = 0
    assert images.median3(noisy)[40, 40] == 255


def test_payload_to_blocks_and_cells(spark):
    """Form fields and lines over two shards, empty keys and texts left out, and a grid with spans."""
    text = "No:: 7  Total 9 hello"
    at = lambda a, b, c=0.9: {"segments": [{"start": a, "end": b}], "confidence": c, "box": [{"x": 0.1, "y": 0.2}, {"x": 0.3, "y": 0.4}]}
    cell = lambda a, b, span=1: {"layout": at(a, b), "row_span": 0, "col_span": span}
    page = {
        "fields": [{"name": at(0, 4), "value": at(5, 6)}, {"name": at(6, 8), "value": at(5, 6)}], "lines": [at(8, 15), at(6, 8)],
        "tables": [{"confidence": 0.5, "header": [[cell(0, 2, 2), cell(8, 13)]], "body": [[cell(5, 6), cell(14, 15), cell(16, 21)]]}],
    }
    rows = spark.createDataFrame([(1, {"text": text, "pages": [page, {"fields": None, "lines": [at(16, 21)], "tables": None}]}, 0), (1, {"text": text, "pages": [page]}, 2), (2, {"text": None, "pages": []}, 0)], f"doc_id bigint, doc {C.PAYLOAD}, page_offset int")
    blocks = [(r.page, r.block_type, r.content) for r in C.payload_blocks(rows).orderBy("page", "at").collect()]
    one = [("VALUE", "No: 7"), ("LINE", "Total 9")]
    assert blocks == [(1, *b) for b in one] + [(2, "LINE", "hello")] + [(3, *b) for b in one]
    cells = [(r.page, r.row_idx, r.col_idx, r.row_span, r.col_span, r.is_header, r.content) for r in C.payload_cells(rows).orderBy("page", "row_idx", "col_idx").collect()]
    grid = [(0, 0, 1, 2, True, "No"), (0, 2, 1, 1, True, "Total"), (1, 0, 1, 1, False, "7"), (1, 1, 1, 1, False, "9"), (1, 2, 1, 1, False, "hello")]
    assert cells == [(p, *g) for p in (1, 3) for g in grid]


def test_save_and_load_the_latest_extraction(spark, tmp_path):
    path = str(tmp_path / "store")
    for run, ok in ((1, True), (2, True), (3, False)):
        blocks = spark.createDataFrame([(1, run, f"b{run}"), (2, run, "x")][: 2 if run == 1 else 1], "doc_id bigint, run_id int, content string")
        C.save_extraction(path, blocks.select("doc_id", "run_id", F.lit(ok).alias("succeeded")).distinct(), blocks=blocks, cells=blocks)
    got = C.load_latest(spark, path)
    assert {(r.doc_id, r.run_id, r.content) for r in got["blocks"].collect()} == {(1, 2, "b2"), (2, 1, "x")} == {(r.doc_id, r.run_id, r.content) for r in got["cells"].collect()}


def test_record_functions(spark):
    picks = spark.createDataFrame([(1, 5, 10), (2, 5, 11), (3, 6, None)], "doc_id int, doc_type int, template_id int")
    known = spark.createDataFrame([(5, 10), (6, 11)], "doc_type int, template_id int")
    assert {r.doc_id: r.template_id for r in R.resolved_template(picks, known).collect()} == {1: 10, 2: None, 3: None}
    engines = spark.createDataFrame([("a", 3, True), ("a", 2, False), ("a", 4, True), ("b", 1, False)], "engine string, processor_id int, is_active boolean")
    assert [(r.engine, r.processor_id) for r in R.first_active(engines, "engine", "processor_id").collect()] == [("a", 3)]
    log = spark.createDataFrame([(1, 1, "CAPTURED"), (1, 2, "MAPPED")], "doc_id int, event_id int, status string")
    more = R.with_event(log, spark.createDataFrame([(1, "VALIDATED"), (2, "CAPTURED")], "doc_id int, status string"))
    assert {tuple(r) for r in more.collect()} == {(1, 1, "CAPTURED"), (1, 2, "MAPPED"), (1, 3, "VALIDATED"), (2, 1, "CAPTURED")}
    uploads = spark.createDataFrame([(1, 0, 7), (2, 1, 7), (3, 1, 8)], "doc_id int, length int, template_id int")
    assert [r.doc_id for r in R.valid_uploads(uploads, spark.createDataFrame([(7,)], "template_id int")).collect()] == [2]
    values = spark.createDataFrame([(1, 4, 0.9, "TextBlock:3"), (1, 5, None, "Zone:5")], "doc_id int, field_id int, confidence double, source_ref string")
    got = {r.field_id: r for r in R.review_values(values, spark.createDataFrame([(4, 0.1)], "field_id int, zone_x double")).collect()}
    assert (got[4].band, got[4].anchor, got[4].zone_x) == ("High", "block-3", 0.1) and (got[5].band, got[5].anchor, got[5].zone_x) == ("Low", None, None)
    detail = R.document_detail(
        spark.createDataFrame([(1,), (2,)], "doc_id int"), spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "doc_id int, result_id int, mapped string"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id int, block_id int, content string"),
        spark.createDataFrame([(1, "no", "7")], "doc_id int, property string, value string"), spark.createDataFrame([(1, 1, False)], "doc_id int, attempt int, succeeded boolean"),
    )
    rows = {r.doc_id: r for r in detail.collect()}
    assert rows[1].result.mapped == "new" and [b.content for b in rows[1].blocks] == ["a", "b"] and rows[1].exports[0].succeeded is False and rows[2].result is None and rows[2].blocks is None
