"""A recognizer service as a data source: image files in, the service's answers out, in batches or as a stream.

    spark.dataSource.register(RecognizerSource)
    spark.read.format("recognizer").option("endpoint", "http://host:8866").option("route", "ocr").load("/crops")

Files are dealt to partitions; within one, a bounded number of requests is under way at a time, each with a time-out and
a number of tries.  A file that the service never answers is a row with an error and no answer, for a fallback to take.
As a stream, the offset is the last file by time and name, so that a restarted query goes on behind what it committed.
The folder has to be readable by all machines.  Answers are JSON text; ``words`` and ``cells`` read them in the JVM.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ANSWERS = "path string, tries int, answer string, error string"
WORDS = "struct<page_width:double,page_height:double,words:array<struct<text:string,bbox:array<double>,conf:double>>>"
CELLS = "struct<page_width:double,page_height:double,tables:array<struct<cell_bbox:array<array<double>>>>>"


def words(answer: Column) -> Column:
    """The words of an answer: array of struct(text, x, y, w, h, conf) in 0..1; no text, no four values or no page, no word."""
    a = F.from_json(answer, WORDS)
    width, height = a["page_width"], a["page_height"]
    def one(w):
        x1, y1, x2, y2 = (F.get(w["bbox"], F.lit(k)) for k in range(4))
        return F.struct(F.trim(w["text"]).alias("text"), (x1 / width).alias("x"), (y1 / height).alias("y"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"), F.coalesce(w["conf"], F.lit(0.0)).alias("conf"))

    good = F.filter(a["words"], lambda w: (F.size(w["bbox"]) == 4) & (F.coalesce(F.trim(w["text"]), F.lit("")) != ""))
    return F.when((width > 0) & (height > 0) & good.isNotNull(), F.transform(good, one)).otherwise(F.array().cast("array<struct<text:string,x:double,y:double,w:double,h:double,conf:double>>"))


def cells(answer: Column) -> Column:
    """The cells of all tables of a structure answer: array of boxes (left, top, right, bottom) in 0..1; other boxes are skipped."""
    a = F.from_json(answer, CELLS)
    width, height = a["page_width"], a["page_height"]
    boxes = F.flatten(F.filter(F.transform(a["tables"], lambda t: t["cell_bbox"]), lambda b: b.isNotNull()))
    unit = lambda b: F.struct((F.get(b, F.lit(0)) / width).alias("left"), (F.get(b, F.lit(1)) / height).alias("top"), (F.get(b, F.lit(2)) / width).alias("right"), (F.get(b, F.lit(3)) / height).alias("bottom"))
    good = F.filter(boxes, lambda b: F.size(b) == 4)
    return F.when((width > 0) & (height > 0) & good.isNotNull(), F.transform(good, unit)).otherwise(F.array().cast("array<struct<left:double,top:double,right:double,bottom:double>>"))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Service:
    """The requests of one partition."""

    def __init__(self, options: dict[str, str]):
        self.url = f"{options['endpoint'].rstrip('/')}/{options.get('route', 'ocr')}"
        self.timeout, self.tries = float(options.get("timeout", 120)), max(1, int(options.get("tries", 2)))
        self.concurrency, self.wait = max(1, int(options.get("concurrency", 4))), float(options.get("wait", 0.5))

    def _post(self, path: str) -> str:
        with open(path, "rb") as file:
            image = file.read()
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{os.path.basename(path)}"\r\nContent-Type: image/png\r\n\r\n'
        body = head.encode() + image + f"\r\n--{mark}--\r\n".encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": f"multipart/form-data; boundary={mark}"}, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as got:
            text = got.read().decode("utf-8")
        if not text.strip():
            raise ValueError(f"empty answer from {self.url}")
        json.loads(text)
        return text

    def answer(self, path: str) -> tuple:
        """(path, tries, answer, error): a refusal of the file itself is final, anything else is tried again."""
        for n in range(1, self.tries + 1):
            try:
                return path, n, self._post(path), None
            except urllib.error.HTTPError as refused:
                error = f"HTTP {refused.code}"
                if refused.code < 500:
                    break
            except (OSError, ValueError) as failed:
                error = f"{type(failed).__name__}: {failed}"[:200]
            if n < self.tries:
                time.sleep(self.wait * 2 ** (n - 1))
        return path, n, None, error

    def answers(self, paths: list[str]) -> Iterator[tuple]:
        with ThreadPoolExecutor(self.concurrency) as pool:
            for k in range(0, len(paths), 16 * self.concurrency):  # so many answers are held at a time
                yield from pool.map(self.answer, paths[k : k + 16 * self.concurrency])


def _listed(options: dict[str, str]) -> list[tuple[int, str]]:
    """(time, path) of the folder's files in order; names that begin with a dot or underscore are none."""
    folder = options["path"].removeprefix("file://")
    found = [(e.stat().st_mtime_ns, e.path) for e in os.scandir(folder) if e.is_file() and e.name[0] not in "._"]
    return sorted(found)


def _dealt(paths: list[str], options: dict[str, str]) -> list[Files]:
    size = max(1, int(options.get("files_per_partition", 64)))
    return [Files(paths[k : k + size]) for k in range(0, len(paths), size)] or [Files([])]


class RecognizerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        return _dealt([path for _, path in _listed(self.options)], self.options)

    def read(self, partition):
        yield from Service(self.options).answers(partition.paths)


class RecognizerStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self):
        return {"time": 0, "path": ""}

    def latestOffset(self):
        found = _listed(self.options)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start, end):
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return _dealt([path for at, path in _listed(self.options) if low < (at, path) <= high], self.options)

    def read(self, partition):
        yield from Service(self.options).answers(partition.paths)

    def commit(self, end):
        """Spark's checkpoint holds the offsets; the files stay."""


class RecognizerSource(DataSource):
    """Options: path, endpoint, route, timeout (seconds), tries, wait (seconds, doubled by try), concurrency, files_per_partition."""

    @classmethod
    def name(cls):
        return "recognizer"

    def schema(self):
        return ANSWERS

    def reader(self, schema):
        return RecognizerReader(dict(self.options))

    def streamReader(self, schema):
        return RecognizerStream(dict(self.options))
