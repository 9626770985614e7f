import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from paperloom.session import ship
from paperloom.sources import recognizer as R


@pytest.fixture
def service():
    """A recognizer: the image's text is its answer's word; some images are slow, refused, or answered at the second try."""
    seen, now, most = {}, [0], [0]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            now[0] += 1
            most[0] = max(most[0], now[0])
            body = self.rfile.read(int(self.headers["Content-Length"]))
            text = body.split(b"\r\n\r\n", 1)[1].rsplit(b"\r\n--", 1)[0].decode()
            seen[text] = seen.get(text, 0) + 1
            if text == "slow":
                time.sleep(3)
            time.sleep(0.05)
            code = 400 if text == "bad" else 503 if text == "again" and seen[text] == 1 else 200
            words = [{"text": f" {text} ", "bbox": [10, 20, 30, 60], "conf": 0.5}, {"text": "", "bbox": [0, 0, 1, 1]}, {"text": "x", "bbox": [1, 2]}]
            tables = [{"cell_bbox": [[0, 0, 50, 100], [1, 2, 3]]}, {}, {"cell_bbox": [[50, 0, 100, 100]]}]
            answer = json.dumps({"page_width": 100, "page_height": 200, "words": words} if self.path == "/ocr" else {"page_width": 100, "page_height": 200, "tables": tables}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)
            now[0] -= 1

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", most
    server.shutdown()
    server.server_close()


@pytest.fixture
def source(spark):
    ship(spark)
    spark.dataSource.register(R.RecognizerSource)
    return lambda kind, endpoint, folder, **more: kind.format("recognizer").options(endpoint=endpoint, timeout="1", wait="0.01", **more).load(str(folder))


def test_batch(spark, source, service, tmp_path):
    endpoint, most = service
    for text in ("one", "two", "again", "bad", "slow", "three"):
        (tmp_path / f"{text}.png").write_text(text)
    rows = {r.path.rsplit("/", 1)[1][:-4]: r for r in source(spark.read, endpoint, tmp_path, files_per_partition="4", concurrency="2").withColumn("words", R.words(F.col("answer"))).collect()}
    assert {k: (r.tries, r.error is None) for k, r in rows.items()} == {"one": (1, True), "two": (1, True), "three": (1, True), "again": (2, True), "bad": (1, False), "slow": (2, False)}
    assert [tuple(w) for w in rows["one"].words] == [("one", 0.1, 0.1, 0.2, 0.2, 0.5)] and rows["bad"].words == [] and rows["bad"].error == "HTTP 400"
    assert most[0] <= 2 * 2 + 2  # two partitions of two requests, and what timed out
    boxes = source(spark.read, endpoint, tmp_path, route="structure").where("answer is not null").select(R.cells(F.col("answer")).alias("c")).first().c
    assert [tuple(b) for b in boxes] == [(0.0, 0.0, 0.5, 0.5), (0.5, 0.0, 1.0, 0.5)]
    down = source(spark.read, "http://127.0.0.1:1", tmp_path).collect()
    assert len(down) == 6 and all(r.answer is None and r.error for r in down)


def test_stream_goes_on_behind_what_it_committed(spark, source, service, tmp_path):
    endpoint, _ = service
    crops, out, checkpoint = tmp_path / "crops", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    crops.mkdir()

    def run():
        rows = source(spark.readStream, endpoint, crops)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.schema(R.ANSWERS).parquet(out).collect())

    (crops / "a.png").write_text("a")
    (crops / ".hidden").write_text("h")
    assert run() == ["a.png"]
    (crops / "b.png").write_text("b")
    assert run() == ["a.png", "b.png"]
