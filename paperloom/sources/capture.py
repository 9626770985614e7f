"""Capture: files, shards and recognizer payloads to the extraction relations; sinks for results.

Recognition itself is a seam: ``recognized`` runs any function of pandas batches in place of an engine.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import anchored_text, polygon_box
from paperloom.session import ship


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256, length, modified of stored files; empty files are no uploads, and the scan leaves them out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A table of a relational store; with a numeric key and its bounds, read in ranges of the key by as many tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def captured(stored: DataFrame, channel: str, status: str = "CAPTURED", template_id: int | None = None, user: str | None = None, languages: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and their first events of stored files (path, sha256, length, modified): an id by path, so that a rerun makes the same rows."""
    about = {"channel": channel, "status": status, "template_id": template_id, "captured_by": user, "languages": languages}
    kinds = {"template_id": "int"}
    documents = stored.select(F.md5("path").alias("doc_id"), *stored.columns, *[F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in about.items()])
    events = documents.select("doc_id", F.lit(1).alias("event_id"), "status", F.col("modified").alias("at"))
    return documents, events


def is_pdf(path: Column, content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)) | F.coalesce(F.endswith(F.lower(path), F.lit(".pdf")), F.lit(False))


def page_counts(stored: DataFrame, counter: Callable[[bytes], int]) -> DataFrame:
    """Files (path, content_type, content, ...) with page_count: what the counter says of a PDF, 1 of anything else, which no Python sees."""
    ship(stored.sparkSession)

    @F.pandas_udf("int")
    def count(contents: pd.Series) -> pd.Series:
        return contents.map(counter).astype("int32")

    pdf = is_pdf(F.col("path"), F.col("content_type"))
    return stored.where(pdf).withColumn("page_count", count("content")).unionByName(stored.where(~pdf).withColumn("page_count", F.lit(1)))


def rendered(pages: DataFrame, renderer: Callable[[bytes, int, int], bytes], dpi: int = 300, best_effort: bool = False) -> DataFrame:
    """Pages (path, content_type, content, page, ...) with image: a PDF's page at a resolution, any other file as it is.

    A page that cannot be rendered raises; with ``best_effort``, as for previews, its image is null.
    """
    ship(pages.sparkSession)

    def draw(content: bytes, page: int) -> bytes | None:
        try:
            return renderer(content, max(1, page), dpi)
        except Exception:  # noqa: BLE001 - a preview may be missing, whatever the reason
            if not best_effort:
                raise
            return None

    @F.pandas_udf("binary")
    def image(contents: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([draw(c, int(n)) for c, n in zip(contents, numbers)], dtype=object)

    pdf = is_pdf(F.col("path"), F.col("content_type"))
    return pages.where(pdf).withColumn("image", image("content", "page")).unionByName(pages.where(~pdf).withColumn("image", F.col("content")))


def page_images(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, page, path of wanted pages (doc_id, page) that exist: from 1 to the document's page_count, or any where that is unknown (0); paths come from the documents alone."""
    rows = wanted.join(documents.select("doc_id", "path", "page_count"), "doc_id")
    there = (F.col("page") >= 1) & ((F.col("page_count") <= 0) | (F.col("page") <= F.col("page_count")))
    return rows.where(there).select("doc_id", "page", preview_path(F.col("path"), F.col("page")).alias("path"))


def preview_path(path: Column, page: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".page-"), page.cast("string"), F.lit(".png"))


def recognized(pages: DataFrame, engine: Callable[[pd.DataFrame], pd.DataFrame], schema: str, fallback: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """The engine on batches of pages; a connection failure goes to the fallback, other errors surface."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            try:
                yield engine(batch)
            except (ConnectionError, TimeoutError):
                if fallback is None:
                    raise
                yield fallback(batch)

    return pages.mapInPandas(run, schema)


def word_boxes(payload: Column) -> Column:
    """Recognizer arrays texts/scores/boxes as struct(text, x0, y0, x1, y1, conf): four values or a polygon a box."""
    rows = F.arrays_zip(payload["texts"].alias("t"), payload["scores"].alias("s"), payload["boxes"].alias("b"))
    def one(r):
        flat = F.flatten(r["b"])
        xs, ys = F.filter(flat, lambda _, i: i % 2 == 0), F.filter(flat, lambda _, i: i % 2 == 1)
        return F.struct(r["t"].alias("text"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), F.coalesce(r["s"], F.lit(0.0)).alias("conf"))

    return F.filter(F.transform(rows, one), lambda w: F.coalesce(F.trim(w["text"]), F.lit("")) != "")


def unit_box(word: Column, width: Column, height: Column) -> Column:
    """Pixels to 0..1."""
    return F.struct((word["x0"] / width).alias("x"), (word["y0"] / height).alias("y"), ((word["x1"] - word["x0"]) / width).alias("w"), ((word["y1"] - word["y0"]) / height).alias("h"))


def shard_offsets(shards: DataFrame, key: str, index: str, pages: str) -> DataFrame:
    """Pages before each shard, in order of the shard's index."""
    over = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("page_offset", F.coalesce(F.sum(pages).over(over), F.lit(0)))


def grid_columns(cells: DataFrame, row: list[str], order: str, span: str) -> DataFrame:
    """Column index of each cell: the spans before it, each one at least."""
    width = F.greatest(F.lit(1), F.coalesce(span, F.lit(1)))
    over = Window.partitionBy(*row).orderBy(order)
    return cells.withColumn("col_idx", F.sum(width).over(over) - width)


def form_block(key: Column, value: Column) -> Column:
    """A form field as ``Key: Value``; colons leave the key, an empty key gives null."""
    clean = F.trim(F.regexp_replace(F.coalesce(key, F.lit("")), ":", ""))
    return F.when(clean != "", F.concat(clean, F.lit(": "), F.trim(F.coalesce(value, F.lit("")))))


_LAYOUT = "struct<segments: array<struct<start: bigint, end: bigint>>, confidence: double, box: array<struct<x: double, y: double>>>"
#: A recognizer's document: its text, and by page the form fields, lines and tables as layouts over that text.
PAYLOAD = (
    "struct<text: string, pages: array<struct<"
    f"fields: array<struct<name: {_LAYOUT}, value: {_LAYOUT}>>, lines: array<{_LAYOUT}>, "
    f"tables: array<struct<confidence: double, header: array<array<struct<layout: {_LAYOUT}, row_span: int, col_span: int>>>, body: array<array<struct<layout: {_LAYOUT}, row_span: int, col_span: int>>>>>>>>"
)


def _layout_text(text: Column, layout: Column) -> Column:
    return F.coalesce(F.trim(anchored_text(text, layout["segments"])), F.lit(""))


def payload_blocks(payloads: DataFrame) -> DataFrame:
    """doc_id, page, at, block_type, content, confidence, box of payloads (doc_id, doc, page_offset).

    Form fields come first, as ``Key: Value`` blocks (fields without a key are left out), then the page's lines that hold
    text; shards of one document follow each other by their page offset.
    """
    text = F.col("doc.text")
    def of(page):
        fields = F.transform(page["fields"], lambda f: F.struct(F.lit("VALUE").alias("block_type"), form_block(_layout_text(text, f["name"]), _layout_text(text, f["value"])).alias("content"), f["value"]["confidence"].alias("confidence"), polygon_box(f["value"]["box"]).alias("box")))
        lines = F.transform(page["lines"], lambda x: F.struct(F.lit("LINE").alias("block_type"), F.nullif(_layout_text(text, x), F.lit("")).alias("content"), x["confidence"].alias("confidence"), polygon_box(x["box"]).alias("box")))
        none = F.array().cast("array<struct<block_type:string,content:string,confidence:double,box:struct<x0:double,y0:double,x1:double,y1:double>>>")
        return F.filter(F.concat(F.coalesce(fields, none), F.coalesce(lines, none)), lambda b: b["content"].isNotNull())

    pages = payloads.select("doc_id", "page_offset", F.posexplode(F.transform("doc.pages", of)).alias("p", "blocks"))
    rows = pages.select("doc_id", (F.col("page_offset") + F.col("p") + 1).cast("int").alias("page"), F.posexplode("blocks").alias("at", "b"))
    return rows.select("doc_id", "page", "at", "b.block_type", "b.content", F.col("b.confidence").cast("decimal(5,4)").alias("confidence"), "b.box")


def payload_cells(payloads: DataFrame) -> DataFrame:
    """doc_id, page, table_idx, row_idx, col_idx, row_span, col_span, is_header, content, confidence: header rows before body rows, columns by the spans before them."""
    pages = payloads.select("doc_id", F.col("doc.text").alias("text"), "page_offset", F.posexplode("doc.pages").alias("p", "page"))
    tables = pages.select("doc_id", "text", (F.col("page_offset") + F.col("p") + 1).cast("int").alias("page"), F.posexplode("page.tables").alias("table_idx", "t"))
    none = F.array().cast("array<struct<header:boolean,cells:array<struct<layout:" + _LAYOUT + ",row_span:int,col_span:int>>>>")
    part = lambda rows, head: F.coalesce(F.transform(rows, lambda r: F.struct(F.lit(head).alias("header"), r.alias("cells"))), none)
    rows = tables.select("doc_id", "text", "page", "table_idx", F.posexplode(F.concat(part(F.col("t.header"), True), part(F.col("t.body"), False))).alias("row_idx", "r"))
    cells = rows.select("doc_id", "text", "page", "table_idx", "row_idx", F.col("r.header").alias("is_header"), F.col("r.cells").alias("cells"), F.posexplode("r.cells").alias("k", "c"))
    span = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1)))
    before = F.aggregate(F.slice("cells", F.lit(1), F.col("k")), F.lit(0), lambda n, c: n + span(c["col_span"]))
    return cells.select(
        "doc_id", "page", "table_idx", "row_idx", before.alias("col_idx"), span(F.col("c.row_span")).alias("row_span"), span(F.col("c.col_span")).alias("col_span"), "is_header",
        _layout_text(F.col("text"), F.col("c.layout")).alias("content"), F.col("c.layout.confidence").cast("decimal(5,4)").alias("confidence"),
    )


def save_extraction(path: str, runs: DataFrame, **relations: DataFrame) -> None:
    """Append an extraction's relations (blocks, tables, cells, ... with run_id), and its runs last: a run that is not there was not saved."""
    for name, rows in relations.items():
        rows.write.mode("append").parquet(f"{path}/{name}")
    runs.write.mode("append").parquet(f"{path}/runs")


def load_latest(spark: SparkSession, path: str, names: tuple[str, ...] = ("blocks", "cells")) -> dict[str, DataFrame]:
    """The relations of each document's last successful run."""
    runs = spark.read.parquet(f"{path}/runs")
    return {name: latest_run(runs, spark.read.parquet(f"{path}/{name}")) for name in names}


def _box(rows: DataFrame) -> Column:
    """The box of a block or cell, if all its four sides are known."""
    if not {"x", "y", "w", "h"} <= set(rows.columns):
        return F.lit(None).cast("struct<left:double,top:double,width:double,height:double>")
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    return F.when(known, F.struct(F.col("x").alias("left"), F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height")))


def _or_null(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def extraction_json(documents: DataFrame, pages: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, json of every document, as the API nests its pages, blocks and tables; words are left out, absent values are null.

    pages (doc_id, page, width, height); blocks (doc_id, page, block_id, block_type, content, confidence[, normalized, x,
    y, w, h]); cells (doc_id, table_idx, row_idx, col_idx, is_header, content, confidence[, page, row_span, col_span,
    normalized, x, y, w, h]).  Everything of a document meets by one key, in the JVM.
    """
    def gathered(rows: DataFrame, entry: Column, name: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"]).alias(name))

    kind = F.when(F.upper("block_type").isin("KEY", "VALUE"), F.upper("block_type")).otherwise("LINE")
    page = F.struct(F.col("page").alias("pageNumber"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))
    block = F.struct(
        F.concat(F.lit("block-"), F.col("block_id")).alias("id"), "page", kind.alias("type"), F.col("content").alias("text"), _or_null(blocks, "normalized", "string").alias("normalizedValue"),
        F.col("confidence").alias("confidence"), _box(blocks).alias("bbox"),
    )
    cell = F.struct(
        F.col("row_idx").alias("rowIndex"), F.col("col_idx").alias("colIndex"), F.coalesce(_or_null(cells, "row_span", "int"), F.lit(1)).alias("rowSpan"), F.coalesce(_or_null(cells, "col_span", "int"), F.lit(1)).alias("colSpan"),
        F.col("is_header").alias("isHeader"), F.lit("TABLE_CELL").alias("type"), F.col("content").alias("text"), _or_null(cells, "normalized", "string").alias("normalizedValue"), F.col("confidence").alias("confidence"), _box(cells).alias("bbox"),
    )
    rows = cells.groupBy("doc_id", "table_idx").agg(
        F.sort_array(F.collect_list(cell)).alias("cells"), F.coalesce(F.min(_or_null(cells, "page", "int")), F.lit(1)).alias("page"),
        (F.max("row_idx") + 1).alias("rowCount"), F.max("col_idx").alias("columnCount"),
    )
    table = F.struct(F.concat(F.lit("table-"), F.col("table_idx")).alias("id"), "page", "rowCount", "columnCount", "cells")
    out = documents.select("doc_id").join(gathered(pages, F.struct("page", page.alias("v")), "pages"), "doc_id", "left")
    out = out.join(gathered(blocks.where("upper(block_type) <> 'WORD'"), F.struct("page", "block_id", block.alias("v")), "blocks"), "doc_id", "left")
    out = out.join(gathered(rows, F.struct("page", "table_idx", table.alias("v")), "tables"), "doc_id", "left")
    parts = {n: F.coalesce(n, F.array()) for n in ("pages", "blocks", "tables")}
    body = F.struct(F.col("doc_id").alias("documentId"), *[c.alias(n) for n, c in parts.items()])
    return out.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def latest_run(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of each document's last successful run."""
    last = runs.where("succeeded").groupBy("doc_id").agg(F.max("run_id").alias("run_id"))
    return blocks.join(last, ["doc_id", "run_id"], "left_semi")


def signature(secret: str, body: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def signed(df: DataFrame, body: str, secret: str, name: str = "signature") -> DataFrame:
    """Add the HMAC-SHA256 of the exact UTF-8 body; HMAC is no built-in, so it runs on Arrow batches."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def sign(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: signature(secret, b), na_action="ignore")

    return df.withColumn(name, sign(body))


class _Number(str):
    """The text of a JSON number."""


def _stripped(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_stripped(v)}" for k, v in value.items() if not k.startswith("_")) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_stripped, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def strip_internal(text: str | None) -> str | None:
    """JSON without keys that start with an underscore, at any depth; anything else as it is. Number text stays."""
    try:
        return _stripped(json.loads(text, parse_float=_Number, parse_int=_Number))
    except (TypeError, ValueError):
        return text


#: A JSON string; and what stands between brackets, down to the depth that JSON of models may have.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
JSON_DEPTH = 64


def _between() -> str:
    inside = rf'(?:[^"\[\]{{}}]++|{_STRING})*+'
    for _ in range(JSON_DEPTH - 1):
        inside = rf'(?:[^"\[\]{{}}]++|{_STRING}|[\[{{]{inside}[\]}}])*+'
    return inside


def without_internal_keys(json_text: Column) -> Column:
    """JSON without the members whose keys start with an underscore, at any depth, and without blanks between its tokens.

    Text that is no JSON stays.  What is removed is found in the text, so that numbers keep their digits: strings that
    are no such key are stepped over, and a member goes with its whole value and the comma behind it.
    """
    value = rf'(?:{_STRING}|[^",\[\]{{}}]++|[\[{{]{_between()}[\]}}])'
    other = rf'({_STRING}(?!:)|"(?!_)[^"\\]*+(?:\\.[^"\\]*+)*+")'
    tight = F.regexp_replace(json_text, rf"({_STRING})|\s++", "$1")
    fewer = F.regexp_replace(tight, rf"{other}|{_STRING}:{value},?", "$1")
    whole = F.regexp_replace(fewer, rf"({_STRING})|,(?=[\]}}])", "$1")
    return F.when(F.get_json_object(json_text, "$").isNotNull(), whole).otherwise(json_text)


def stripped(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, without_internal_keys(F.col(column)))


def post(df: DataFrame, body: str, send: Callable[[str, str], tuple[bool, str]], secret: str) -> DataFrame:
    """Send each body with its signature through ``send(body, signature) -> (succeeded, response)``; responses keep 500 characters."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches):
        for batch in batches:
            results = [send(b, signature(secret, b)) for b in batch[body].fillna("")]
            yield batch[names].assign(succeeded=[r[0] for r in results], response=[(r[1] or "")[:500] for r in results])

    return df.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", succeeded boolean, response string")


def webhook(endpoint: str | None, auth_header: str | None = None, secret: str = "", timeout: float = 30.0) -> Callable[[str, str], tuple[bool, str]]:
    """A ``send`` for ``post`` over HTTP: the exact UTF-8 body with its signature; failures are answers, never raised."""

    def send(body: str, sign: str) -> tuple[bool, str]:
        done, _, text = request(endpoint, body, secret, auth_header, timeout, {"X-Signature": sign})
        return done, text

    return send


def request(endpoint: str | None, body: str | None, secret: str = "", auth_header: str | None = None, timeout: float = 30.0, more: dict[str, str] | None = None) -> tuple[bool, int | None, str]:
    """(succeeded, HTTP status, response) of one signed POST."""
    if not (endpoint or "").strip():
        return False, None, "No endpoint configured"
    headers = {"Content-Type": "application/json", "X-Signature": signature(secret, body or "")} | ({auth_header: secret} if (auth_header or "").strip() else {}) | (more or {})
    try:
        with urllib.request.urlopen(urllib.request.Request(endpoint, (body or "").encode(), headers, method="POST"), timeout=max(1.0, timeout)) as got:
            return True, got.status, got.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as refused:
        return False, refused.code, refused.read().decode("utf-8", "replace")
    except TimeoutError:
        return False, None, "Request timed out"
    except OSError as failed:
        late = isinstance(getattr(failed, "reason", None), TimeoutError)
        return False, None, "Request timed out" if late else f"HTTP error: {failed}"


def erp(body: str, sign: str) -> tuple[bool, str]:
    """The place of an ERP client: a ``send`` that refuses everything."""
    return False, "no ERP client is configured"
