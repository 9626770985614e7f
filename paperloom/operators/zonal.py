"""Documents built from zones: table rows of a region, and whole documents of one page or of several.

Words come in page coordinates relative to their region's zone (0..1), as rows of (keys..., word_id, text, x, y, w, h,
conf).  A template is driver data: regions, roles and column structures are resolved before any plan is made.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.operators import mapping as M
from paperloom.operators import multipage as P
from paperloom.operators import tables as T
from paperloom.operators.authoring import ROLES, anchor_column
from paperloom.schema import ColumnSpec, FieldSpec, TemplateSpec

TEXT_TYPES = ("STRING", "TEXT")
PAGE_KEY = "_pg"


def _role(field: FieldSpec) -> str:
    return ROLES.get((field.page_role or "").strip().upper(), "FIRST")


def _range(column: ColumnSpec, zone) -> tuple[float, float]:
    """A column's span within its zone; a column without a span is as wide as the zone."""
    x, _, w, _ = zone
    unit = lambda v: max(0.0, min(1.0, (v - x) / w)) if w > 0 else 0.0
    return unit(x if column.x_start is None else column.x_start), unit(x + w if column.x_end is None else column.x_end)


def ordered_columns(field: FieldSpec) -> list[ColumnSpec]:
    return sorted(field.columns, key=lambda c: c.sort_order)


def resolved_columns(canonical: list[ColumnSpec], region: list[ColumnSpec]) -> tuple[list[ColumnSpec], bool]:
    """The region's spans with the canonical structure; unequal counts keep the region's own, and say so."""
    if not canonical:
        return region, False
    if len(canonical) != len(region):
        return region, True
    return [replace(c, x_start=r.x_start, x_end=r.x_end) for c, r in zip(canonical, region)], False


def table_rows(words: DataFrame, keys: list[str], zone, columns: list[ColumnSpec], read: DataFrame | None = None, consolidate: bool = False) -> DataFrame:
    """keys, row (from 1), the columns' canonical texts, and the sum and number of the confidences that count.

    A cell is what the recognizer read of it (``read``: keys, band, column, text, confidence), or where its lines give
    nothing, the words inside; anchored columns take their line beside the anchor.  With ``consolidate`` footer rows go
    and descriptions lose shipping annotations.  A cell without text counts for no confidence.
    """
    anchor = _range(anchor_column(tuple(columns)), zone)
    vote = F.struct(N.date_order_vote(F.col("text")).alias("vote"), "word_id")
    zones = T.nested(words, keys, _order=F.min_by(vote["vote"], F.when(vote["vote"].isNotNull(), vote["word_id"]))).where(T.known(keys))
    given = F.array().cast("array<struct<band:int,column:string,text:string,confidence:decimal(5,4)>>")
    if read is not None:
        cell = F.struct(F.col("band").cast("int").alias("band"), "column", F.coalesce("text", F.lit("")).alias("text"), F.col("confidence").cast("decimal(5,4)").alias("confidence"))
        zones = zones.join(read.groupBy(*keys).agg(F.collect_list(cell).alias("_read")), keys, "left")
        given = F.coalesce("_read", given)
    counts = lambda c: (c["text"] != "") & c["confidence"].isNotNull()

    def chosen(c: ColumnSpec, lines):
        if consolidate and c.data_type.strip().upper() in TEXT_TYPES:
            text = F.array_join(T.clean_lines(F.array_join(lines, "\n")), "\n")
        else:
            text = F.replace(F.array_join(lines, "\n"), F.lit("\r"), F.lit(""))
        return T.select_lines(text, c.line_select, c.line_picks, c.line_separator)

    def entry(text, confidence):
        return F.struct(text.alias("text"), confidence.cast("decimal(5,4)").alias("confidence"))

    def plain_cell(c: ColumnSpec, inside, band, reads):
        """The cell's candidates: its words, or each of its reads that says something."""
        def of(ws):
            own = lambda otherwise: F.when(F.size(ws) > 0, entry(chosen(c, T.texts_in(ws)), M.array_mean4(F.transform(ws, lambda w: w["conf"])))).otherwise(otherwise)
            if read is None:
                return F.when(F.size(ws) > 0, F.array(own(F.lit(None)))).otherwise(F.array().cast("array<struct<text:string,confidence:decimal(5,4)>>"))
            empty = entry(F.lit(""), F.lit(None))
            def pick(r):
                return N.bound(chosen(c, F.array(r["text"])), lambda text: F.when(text != "", entry(text, r["confidence"])).otherwise(own(empty)))

            mine = F.filter(reads, lambda r: (r["band"] == band) & (r["column"] == c.sub_property))
            alone = F.when(F.size(ws) > 0, F.array(own(empty))).otherwise(F.array().cast("array<struct<text:string,confidence:decimal(5,4)>>"))
            return N.bound(mine, lambda found: F.when(F.size(found) > 0, F.transform(found, pick)).otherwise(alone))

        return N.bound(F.filter(inside, lambda w: w["xc"].between(*_range(c, zone))), of)

    # step by step, so that no expression nests deeply
    zones = zones.withColumn("bands", T.bands_in(F.col("w"), *anchor))
    if consolidate:
        told = T.consolidated_in(F.col("w"), F.col("bands"), *anchor)
        zones = zones.withColumn("bands", N.bound(told, lambda rows: F.filter("bands", lambda b, i: ~F.get(rows, i)["footer"])))
    anchored = [c for c in columns if c.line_select.strip().upper() == "ANCHOR"]
    if anchored:
        zones = zones.withColumn("found", T.anchors_in(F.col("w"), F.col("bands"), *anchor))
        zones = zones.withColumns({f"a{i}": T.anchored_in(F.col("w"), F.col("found"), *_range(c, zone), c.line_offset, c.line_separator, conf=True) for i, c in enumerate(columns) if c in anchored})
    marks_of = F.struct(F.lit(0), *[f"a{i}" for i, c in enumerate(columns) if c in anchored])

    def row(b, ws, marks, reads):
        def cells(inside):
            return F.array(*[
                F.transform(F.filter(marks[f"a{i}"], lambda m: m["band"] == b["band"]), lambda m: entry(m["text"], m["confidence"])) if c in anchored else plain_cell(c, inside, b["band"], reads)
                for i, c in enumerate(columns)
            ])

        return F.struct(b["band"].alias("row"), N.bound(F.filter(ws, lambda w: w["yc"].between(b["y_start"], b["y_end"])), cells).alias("cells"))

    rows = N.bound(F.col("w"), lambda ws: N.bound(given, lambda reads: N.bound(marks_of, lambda marks: F.transform("bands", lambda b: row(b, ws, marks, reads)))))
    wide = zones.select(*keys, "_order", F.inline(rows))
    total = lambda cs: F.when(F.size(cs) > 0, F.aggregate(cs, F.lit(0).cast("decimal(15,4)"), lambda a, c: (a + c["confidence"]).cast("decimal(15,4)")))
    sums = N.bound(F.filter(F.flatten("cells"), counts), lambda cs: F.struct(total(cs).alias("conf_sum"), F.size(cs).cast("bigint").alias("conf_n")))
    texts = [F.array_max(F.transform(F.get("cells", F.lit(i)), lambda c: c["text"])).alias(f"_{i}") for i in range(len(columns))]
    wide = wide.select(*keys, "_order", "row", *texts, sums.alias("sums"))
    typed = [N.typed_text(F.col(f"_{i}"), c.data_type, F.col("_order")).alias(c.sub_property) for i, c in enumerate(columns)]
    return wide.select(*keys, "row", *typed, "sums.conf_sum", "sums.conf_n")


def _as_table(rows: DataFrame, keys: list[str], columns: list[ColumnSpec], page: str | None = None) -> DataFrame:
    """keys, items (row and JSON object), n_rows, confidence of table rows."""
    members = [F.concat(F.lit(f'"{c.sub_property}":'), M.json_text(F.col(c.sub_property), c.data_type)) for c in columns]
    if page:
        members.append(F.concat(F.lit(f'"{PAGE_KEY}":'), F.col(page).cast("string")))
    item = F.struct("row", F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("json"))
    mean = F.sum("conf_sum").cast("decimal(38,18)") / F.sum("conf_n")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).cast("int").alias("n_rows"), F.bround(mean, 4).cast("decimal(5,4)").alias("confidence"))


def _joined(items):
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["json"]), ","), F.lit("]"))


TABLES = "doc_id bigint, field_id int, items_json string, n_rows int, confidence decimal(5,4)"


def _of_every(documents: DataFrame, tables: DataFrame | None, field_id: int) -> DataFrame:
    """A region's table (doc_id, items_json, n_rows, confidence) for every document: without rows it is empty, and no confidence is known."""
    found = documents.select("doc_id")
    found = found.join(tables, "doc_id", "left") if tables is not None else found.select("doc_id", F.lit(None).cast("string").alias("items_json"), F.lit(0).alias("n_rows"), F.lit(None).cast("decimal(5,4)").alias("confidence"))
    return found.select("doc_id", F.lit(field_id).alias("field_id"), F.coalesce("items_json", F.lit("[]")).alias("items_json"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "confidence")


def single_page(template: TemplateSpec, scalars: DataFrame, words: DataFrame, consolidate: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """The long form of documents of one page, from zone reads (doc_id, field_id, raw, confidence) and region words (doc_id, field_id, ...).

    Documents are those with reads or words, or those of ``documents`` (doc_id), where some may have neither.  A region
    in which no row is found is an empty table.  Fields without a zone take no part, nor do tables without columns.
    """
    documents = scalars.select("doc_id").unionByName(words.select("doc_id")).distinct() if documents is None else documents
    zoned = [f for f in template.fields if f.zone is not None]
    regions = [f for f in zoned if f.source_type == "TABLE_CELL" and f.columns]
    tables = []
    for f in regions:
        columns = ordered_columns(f)
        rows = table_rows(words.where(F.col("field_id") == f.field_id), ["doc_id"], f.zone, columns, consolidate=consolidate)
        tables.append(_of_every(documents, _as_table(rows, ["doc_id"], columns).select("doc_id", _joined(F.col("items")).alias("items_json"), "n_rows", "confidence"), f.field_id))
    own = [f.field_id for f in zoned if f.source_type != "TABLE_CELL"]
    empty = scalars.sparkSession.createDataFrame([], TABLES)
    return M.map_zonal(replace(template, fields=tuple(zoned)), scalars.where(F.col("field_id").isin(own)), reduce(DataFrame.unionByName, tables, empty), documents)


def multi_page(template: TemplateSpec, pages: DataFrame, scalars: DataFrame, words: DataFrame, consolidate: bool = False) -> DataFrame:
    """The long form of documents of several pages.

    pages (doc_id, pages); scalars (doc_id, field_id, page, raw, confidence): each field is read once, on the page of
    its role.  words (doc_id, page, field_id, ...): every page's table is read by the region that its role picks, with
    the structure of the FIRST region (else that of the lowest field id), and pages are put together in order, each row
    with its page; the result is the canonical region's.
    """
    zoned = [f for f in template.fields if f.zone is not None]
    roles = {f.field_id: _role(f) for f in zoned}
    role_of = F.lit(None).cast("string")
    for field_id, role in roles.items():
        role_of = F.when(F.col("field_id") == field_id, role).otherwise(role_of)
    sized = pages.select("doc_id", F.greatest("pages", F.lit(1)).alias("_pages"))
    single = [f.field_id for f in zoned if f.source_type != "TABLE_CELL"]
    reads = scalars.where(F.col("field_id").isin(single)).join(sized, "doc_id").where(F.col("page") == P.scalar_page(role_of, F.col("_pages"))).select("doc_id", "field_id", "raw", "confidence")
    groups: dict[str, list[FieldSpec]] = {}
    for f in zoned:
        if f.source_type == "TABLE_CELL":
            groups.setdefault(f.target_property.lower(), []).append(f)
    tables = []
    for members in groups.values():
        by_role = {_role(f): f for f in members}
        canonical = by_role.get("FIRST") or min(members, key=lambda f: f.field_id)
        available = F.array(*[F.lit(r) for r in by_role])
        per_page = []
        for role, region in by_role.items():
            columns, _ = resolved_columns(ordered_columns(canonical), ordered_columns(region))
            if not region.columns:
                continue
            own = words.where(F.col("field_id") == region.field_id).join(sized, "doc_id").where(P.region_role(F.col("page"), F.col("_pages"), available) == role).drop("_pages")
            per_page.append(_as_table(table_rows(own, ["doc_id", "page"], region.zone, columns, consolidate=consolidate), ["doc_id", "page"], columns, "page"))
        whole = None
        if per_page:
            every = reduce(DataFrame.unionByName, per_page)
            whole = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "items"))).alias("p"), F.sum("n_rows").cast("int").alias("n_rows"), M.mean4(F.col("confidence")).alias("confidence"))
            items = F.flatten(F.transform("p", lambda x: x["items"]))
            whole = whole.select("doc_id", _joined(items).alias("items_json"), "n_rows", "confidence")
        tables.append(_of_every(pages, whole, canonical.field_id))
    empty = scalars.sparkSession.createDataFrame([], TABLES)
    return M.map_zonal(replace(template, fields=tuple(zoned)), reads, reduce(DataFrame.unionByName, tables, empty), pages)
