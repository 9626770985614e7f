import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import images
from paperloom.operators import records as R
from paperloom.sources import capture as C


@pytest.fixture
def endpoint():
    """An HTTP server that accepts bodies without 'no' and answers with what it was sent."""
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            answer = (self.headers["X-Signature"] + "|" + (self.headers["X-Key"] or "") + "|").encode() + body * 100
            self.send_response(500 if b"no" in body else 200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/hook"
    server.shutdown()
    server.server_close()


def test_webhook_signs_the_exact_bytes(spark, endpoint):
    rows = spark.createDataFrame([(1, '{"a":"ไทย"}'), (2, "no"), (3, None)], "doc_id int, body string")
    got = {r.doc_id: r for r in C.post(rows, "body", C.webhook(endpoint, "X-Key", "s3"), "s3").collect()}
    assert [got[k].succeeded for k in (1, 2, 3)] == [True, False, True] and all(len(r.response) <= 500 for r in got.values())
    assert got[1].response.startswith(C.signature("s3", '{"a":"ไทย"}') + '|s3|{"a":"ไทย"}') and got[3].response == C.signature("s3", "") + "|s3|"
    assert C.webhook(" ")("x", "y") == (False, "No endpoint configured") and C.erp("x", "y")[0] is False
    succeeded, response = C.webhook("http://127.0.0.1:1/")("x", "y")
    assert not succeeded and response.startswith("HTTP error")


def test_captured_files_become_documents_and_events(spark, tmp_path):
    for name, text in (("a.pdf", "one two"), ("b.PNG", "one"), ("empty.pdf", "")):  # an empty file is no upload
        (tmp_path / name).write_text(text)
    stored = C.files(spark, str(tmp_path))
    documents, events = C.captured(stored, "UPLOAD", template_id=4, user="u")
    assert {(r.channel, r.status, r.template_id, r.captured_by, r.languages) for r in documents.collect()} == {("UPLOAD", "CAPTURED", 4, "u", None)}
    assert {r.doc_id for r in events.where("event_id = 1 and status = 'CAPTURED'").collect()} == {r.doc_id for r in C.captured(stored, "UPLOAD")[0].collect()} and events.count() == 2


def test_pages_are_counted_and_rendered_through_a_seam(spark):
    rows = spark.createDataFrame([("x.PDF", None, b"a b", 2), ("y", "application/pdf", b"", 0), ("z.png", "image/png", b"img", 1), (None, None, b"q", 1)], "path string, content_type string, content binary, page int")
    assert {r.path: r.page_count for r in C.page_counts(rows, lambda c: len(c.split())).collect()} == {"x.PDF": 2, "y": 0, "z.png": 1, None: 1}

    def draw(content, page, dpi):
        if not content:
            raise ValueError("empty")
        return content + f"@{page}/{dpi}".encode()

    got = {r.path: r.image for r in C.rendered(rows, draw, best_effort=True).collect()}
    assert got["y"] is None and bytes(got["x.PDF"]) == b"a b@2/300" and bytes(got["z.png"]) == b"img" and bytes(got[None]) == b"q"
    with pytest.raises(Exception, match="empty"):
        C.rendered(rows, draw).collect()


def test_page_images_exist_only_within_a_document(spark):
    documents = spark.createDataFrame([(1, "s/a.pdf", 2), (2, "s/b.pdf", 0)], "doc_id int, path string, page_count int")
    wanted = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 9), (3, 1)], "doc_id int, page int")
    assert {(r.doc_id, r.page, r.path) for r in C.page_images(documents, wanted).collect()} == {(1, 1, "s/a.page-1.png"), (1, 2, "s/a.page-2.png"), (2, 9, "s/b.page-9.png")}


def test_templates_samples_and_columns(spark):
    none = spark.createDataFrame([], "template_id int, name string, version int, is_active boolean")
    made = R.created_templates(none, spark.createDataFrame([("n",)], "name string"))
    assert [tuple(r) for r in made.collect()] == [(1, "n", 1, True)]
    templates = spark.createDataFrame([(1, "My Multipage", None), (2, "multipage", 7), (3, "other", None)], "template_id int, name string, sample_doc_id int")
    documents = spark.createDataFrame([(1, "a-MULTIPAGE-invoice.pdf", 1), (2, "multipage-invoice", 2), (3, "multipage-invoice", 2), (4, "multipage-invoice", 9)], "doc_id int, file_name string, created int")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    assert {r.template_id: r.sample_doc_id for r in R.bound_newest_sample(templates, documents, pages, "multipage-invoice", "Multipage").collect()} == {1: 3, 2: 7, 3: None}
    assert {r.template_id: r.sample_doc_id for r in R.bound_newest_sample(templates, documents, pages, "nothing", "Multipage").collect()} == {1: None, 2: 7, 3: None}
    guarded = R.ensure_columns(templates, {"Name": "int", "mode": "string"})
    assert guarded.columns == [*templates.columns, "mode"] and R.ensure_columns(guarded, {"mode": "int"}).columns == guarded.columns


def test_reexport_asks_for_the_status_again(spark):
    documents = spark.createDataFrame([(1, "VALIDATED", 1), (2, "MAPPED", 1), (3, "CONSUMED", 2), (4, "VALIDATED", 1)], "doc_id int, status string, doc_type int")
    targets = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 1, False)], "target_id int, doc_type int, is_active boolean")
    wanted = spark.createDataFrame([(1,), (1,), (2,), (3,)], "doc_id int")
    assert sorted((r.doc_id, r.target_id) for r in R.reexported(documents, targets, wanted).collect()) == [(1, 1), (1, 2), (3, 1)]


def test_a_page_is_enlarged_straightened_and_cleaned():
    page = np.full((120, 200), 255, np.uint8)
    for row in (30, 60, 90):
        page[row : row + 3, 20:180] = 0
    assert (images.preprocess(page) == images.median3(page)).all()  # nothing to do but to filter
    big = images.preprocess(page, dpi=150)
    assert big.shape == (240, 400) and abs(int(images.ink_profile(big).sum()) - 4 * int(images.ink_profile(page).sum())) < 200
    assert images.preprocess(page, min_width=300).shape == (180, 300) and images.preprocess(page, dpi=1, cap=400).shape == (240, 400)
    tilted = images.rotated(page, 3.0)
    assert abs(images.skew_degrees(tilted)) >= 2.5 and images.skew_degrees(images.preprocess(tilted)) == 0.0
    assert images.rotated(page, 90.0).shape == (200, 120) and (images.rotated(images.rotated(page, 90.0), -90.0) == page).all()
    assert images.grayscale(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0]]], np.uint8)).tolist() == [[255, 0, 54]]
