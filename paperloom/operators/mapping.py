"""Templates compiled to plans: fields resolved from blocks, table cells or zones, then scored and routed.

Here a template is driver data (``templates`` maps documents of many templates, which are rows).  All key/value and
regex fields of a document come out of one aggregate by ``doc_id``; its tables are nested once, and every table field is
an expression over them.  Blocks and cells are never multiplied by fields.  The long form (one row a document and field)
is the canonical result; the wide form and the JSON model are derived from it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.functions.transforms import apply_steps
from paperloom.schema import FieldSpec, TemplateSpec

RESULT = "raw string, normalized string, confidence decimal(5,4), source_ref string"
_WIDE = "decimal(38,18)"


def round4(x: Column) -> Column:
    """Half-even to four places, from the full-precision mean."""
    return F.bround(x, 4).cast("decimal(5,4)")


def mean4(x: Column) -> Column:
    return round4(F.avg(x.cast(_WIDE)))


def split_key(blocks: DataFrame) -> DataFrame:
    """Add key and value: the text before and after the first colon, null without a key."""
    at = F.instr("content", ":")
    key = F.when(at > 1, F.regexp_replace(F.expr("substring(content, 1, instr(content, ':') - 1)"), N.WHITE_ENDS, ""))
    value = F.when(at > 1, F.regexp_replace(F.expr("substring(content, instr(content, ':') + 1)"), N.WHITE_ENDS, ""))
    return blocks.withColumn("key", key).withColumn("value", value)


def property_map(blocks: DataFrame) -> DataFrame:
    """doc_id, property (lower case), value: the last block of a key wins."""
    rows = split_key(blocks).where(F.coalesce(F.length("key"), F.lit(0)) > 0)
    return rows.groupBy("doc_id", F.lower("key").alias("property")).agg(F.max_by("value", F.struct("page", "block_id")).alias("value"))


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: blocks in order, joined by line feeds."""
    return blocks.groupBy("doc_id").agg(_full_text().alias("text"))


def _full_text() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("page", "block_id", "content")))
    return F.array_join(F.transform(ordered, lambda b: b["content"]), "\n")


def result(raw, normalized, confidence, ref) -> Column:
    return F.struct(raw.cast("string").alias("raw"), normalized.cast("string").alias("normalized"), confidence.cast("decimal(5,4)").alias("confidence"), ref.cast("string").alias("source_ref"))


def empty_result(field: FieldSpec) -> Column:
    """No match: the default value without confidence, which still counts in the average."""
    return result(F.lit(None), F.lit(field.default_value), F.lit(0), F.lit(None))


def _without_blocks(field: FieldSpec) -> Column:
    """What a field is where no block or cell gives it: a constant its value, an unknown source nothing, all others the empty result."""
    if field.source_type == "CONSTANT":
        return result(F.lit(field.default_value), F.lit(field.default_value), F.lit(1), F.lit(None))
    if field.source_type in ("KEY_VALUE", "REGEX", "TABLE_CELL"):
        return empty_result(field)
    return result(F.lit(None), F.lit(None), F.lit(0), F.lit(None))


def resolve_blocks(fields: list[FieldSpec], blocks: DataFrame) -> DataFrame:
    """doc_id, order (D, M or null), and a column f<id> for each key/value, regex and constant field."""
    rows = split_key(blocks).withColumn("_at", F.struct("page", "block_id")).withColumn("_vote", N.date_order_vote(F.col("content")))
    aggregates = [F.min_by("_vote", F.when(F.col("_vote").isNotNull(), F.col("_at"))).alias("order"), mean4(F.col("confidence")).alias("_mean")]
    keyed = {f.field_id for f in fields if f.source_type == "KEY_VALUE" and f.key_pattern is not None}
    searched = {f.field_id for f in fields if f.source_type == "REGEX" and f.regex is not None}
    for f in (f for f in fields if f.field_id in keyed):
        hit = F.col("key").rlike("(?iu)" + f.key_pattern)
        aggregates.append(F.min_by(F.struct("value", "confidence", "block_id"), F.when(hit, F.col("_at"))).alias(f"k{f.field_id}"))
    if searched:
        aggregates.append(_full_text().alias("_text"))
    wide = rows.groupBy("doc_id").agg(*aggregates)
    out = []
    for f in fields:
        if f.field_id in keyed:
            k = F.col(f"k{f.field_id}")
            value = N.typed_text(k["value"], f.data_type, F.col("order"))
            found = result(k["value"], value, k["confidence"], F.concat(F.lit("TextBlock:"), k["block_id"]))
            out.append(F.when(k.isNotNull(), found).otherwise(empty_result(f)).alias(f"f{f.field_id}"))
        elif f.field_id in searched:
            pattern, group = "(?iu)" + f.regex, 1 if re.compile(f.regex).groups else 0
            raw = F.regexp_extract("_text", pattern, group)
            found = result(raw, N.typed_text(raw, f.data_type, F.col("order")), F.coalesce("_mean", F.lit(0)), F.lit("Regex:fulltext"))
            out.append(F.when(F.col("_text").rlike(pattern), found).otherwise(empty_result(f)).alias(f"f{f.field_id}"))
        elif f.source_type != "TABLE_CELL":
            out.append(_without_blocks(f).alias(f"f{f.field_id}"))
    return wide.select("doc_id", "order", *out)


def nested_tables(cells: DataFrame) -> DataFrame:
    """doc_id, tables: the document's tables in order, each with its header cells in reading order and its data rows in order.

    One exchange and one grouping, by document.
    """
    return cells.repartition("doc_id").groupBy("doc_id").agg(tables_of(F.collect_list(cell_entry())).alias("tables"))


def cell_entry() -> Column:
    """A cell as one value, which sorts by its place; null if it is neither header nor data."""
    text = F.when(F.col("is_header"), header_key(F.col("content"))).otherwise(F.col("content"))
    return F.when(F.col("is_header").isNotNull(), F.struct("table_idx", "row_idx", "col_idx", "is_header", text.alias("content"), "confidence"))


def tables_of(entries: Column) -> Column:
    """A document's tables from its cells in any order (``cell_entry``)."""
    def table(cells):
        rows = N.bound(F.filter(cells, lambda c: ~c["is_header"]), lambda data: F.transform(_runs(data, "row_idx"), lambda row: F.struct(first(row)["row_idx"].alias("row_idx"), row.alias("cells"))))
        return F.struct(first(cells)["table_idx"].alias("table_idx"), F.filter(cells, lambda c: c["is_header"]).alias("heads"), rows.alias("rows"))

    return N.bound(F.sort_array(entries), lambda cells: F.transform(_runs(cells, "table_idx"), table))


def _runs(items: Column, member: str) -> Column:
    """A bound array, ordered by the member, cut where the member changes."""
    def slices(starts):
        return F.transform(starts, lambda at, k: F.slice(items, at, F.coalesce(F.get(starts, k + 1), F.size(items) + 1) - at))

    places = F.transform(items, lambda x, i: F.when((i == 0) | ~F.get(items, i - 1)[member].eqNullSafe(x[member]), i + 1))
    return N.bound(F.filter(places, lambda at: at.isNotNull()), slices)


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def header_key(header: Column) -> Column:
    return F.lower(N.trimmed(header))


def _column_of(table: Column, header: Column) -> Column:
    """The column of the table's first header cell of that name; null if there is none."""
    return first(F.filter(table["heads"], lambda h: h["content"] == header))["col_idx"]


def _cell_at(row: Column, column: Column) -> Column:
    """The row's first cell in the column, which is often as far on as the column's number."""
    cells, near = row["cells"], lambda k: F.get(row["cells"], column - k)["col_idx"]
    return F.when((near(1) == column) & ((column == 1) | (near(2) < column)), F.get(cells, column - 1)).when(column.isNotNull(), first(F.filter(cells, lambda c: c["col_idx"] == column)))


def array_mean4(values: Column, exact: str = _WIDE) -> Column:
    """The mean of an array's values that are not null, to four places; null without any.  ``exact`` holds their sums (``sum_type``)."""
    def of(known):
        total = F.aggregate(known, F.lit(0).cast(exact), lambda a, x: (a + x.cast(exact)).cast(exact))
        return F.when(F.size(known) == 1, round4(first(known).cast(_WIDE))).when(F.size(known) > 0, round4(total.cast(_WIDE) / F.size(known)))

    return N.bound(F.filter(values, lambda x: x.isNotNull()), of)


def sum_type(kind: str) -> str:
    """A decimal type that holds sums of a hundred million values of the type: a short one, kept as a number of the machine, if that will do."""
    found = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    return f"decimal({int(found[1]) + 8},{found[2]})" if found and int(found[1]) <= 10 else _WIDE


def _selected(items: Column, selector: Column, default: str) -> Column:
    """The array's first, its last, or all of its items."""
    pick = F.coalesce(selector, F.lit(default))
    some = "ALL" if default == "FIRST" else "FIRST"
    one, all_ = (F.slice(items, 1, 1), items) if default == "FIRST" else (items, F.slice(items, 1, 1))
    return F.when(pick == "LAST", F.slice(items, -1, 1)).when(pick == some, all_).otherwise(one)


def single_cell(tables: Column, header: Column, selector: Column, kind: Column | str, order: Column, otherwise: Column, exact: str = _WIDE) -> Column:
    """The result of a single-cell field of a type in capitals: of the first table that has its header over a column with data."""
    def in_table(t):
        return N.bound(_column_of(t, header), lambda c: F.struct(t["table_idx"].alias("table_idx"), c.alias("col_idx"), F.filter(F.transform(t["rows"], lambda r: _cell_at(r, c)), lambda x: x.isNotNull()).alias("cells")))

    def found(hit):
        def of(chosen):
            raw = F.array_join(F.transform(chosen, lambda x: F.coalesce(x["content"], F.lit(""))), " | ")
            value = F.when(selector == "ALL", raw).otherwise(N.typed_as(raw, kind, order))
            ref = F.concat(F.lit("Table:"), hit["table_idx"], F.lit("/Col:"), hit["col_idx"])
            return result(raw, value, F.coalesce(array_mean4(F.transform(chosen, lambda x: x["confidence"]), exact), F.lit(0)), ref)

        return F.when(hit.isNotNull(), N.bound(_selected(hit["cells"], selector, "FIRST"), of)).otherwise(otherwise)

    usable = F.filter(F.transform(tables, in_table), lambda t: t["col_idx"].isNotNull() & (F.size(t["cells"]) > 0))
    return N.bound(first(usable), found)


def table_rows(tables: Column, header: Column, columns: Column, selector: Column, order: Column, exact: str = _WIDE) -> Column:
    """A table field's rows: struct(table_idx, rows: array of row_idx and values, confidence), or null if no table fits.

    ``columns`` is an array of struct(header, kind: the type in capitals).  It is the first table with the field's header, a header of a
    column, and a data row.  Every data row is an item; what has no column or no cell is null.
    """
    def resolved(t):
        return F.struct(t["table_idx"].alias("table_idx"), t["rows"].alias("rows"), F.transform(columns, lambda c: _column_of(t, c["header"])).alias("columns"))

    def items(t):
        def found(rows):
            return F.transform(rows, lambda r: F.struct(r["row_idx"].alias("row_idx"), F.transform(t["columns"], lambda at: _cell_at(r, at)).alias("cells")))

        def of(rows):
            made = F.transform(rows, lambda r: F.struct(r["row_idx"].alias("row_idx"), F.zip_with(columns, r["cells"], lambda c, cell: N.typed_as(cell["content"], c["kind"], order)).alias("values")))
            confidence = array_mean4(F.flatten(F.transform(rows, lambda r: F.transform(r["cells"], lambda cell: cell["confidence"]))), exact)
            return F.struct(t["table_idx"].alias("table_idx"), made.alias("rows"), confidence.alias("confidence"))

        return F.when(t.isNotNull(), N.bound(found(_selected(t["rows"], selector, "ALL")), of))

    anchored = F.filter(tables, lambda t: F.exists(t["heads"], lambda h: h["content"] == header) & (F.size(t["rows"]) > 0))
    usable = F.filter(F.transform(anchored, resolved), lambda t: F.exists(t["columns"], lambda at: at.isNotNull()))
    return N.bound(first(usable), items)


def _lit(value) -> Column:
    return F.lit(value).cast("string")


def _key(header: str | None) -> Column:
    return _lit(header if header is None else header.strip().lower())


def _sub_columns(field: FieldSpec) -> list:
    return sorted(field.columns, key=lambda c: c.sort_order)


def _rows_of(field: FieldSpec, order: Column) -> Column:
    columns = F.array(*[F.struct(_key(c.table_header).alias("header"), F.lit(c.data_type.upper()).alias("kind")) for c in _sub_columns(field)])
    return table_rows(F.col("tables"), _key(field.table_header), columns, _lit(field.row_selector), order)


def _with_order(cells: DataFrame, orders: DataFrame | None) -> DataFrame:
    tables = nested_tables(cells)
    return tables.withColumn("order", _lit(None)) if orders is None else tables.join(orders.select("doc_id", "order"), "doc_id", "left")


def resolve_cells(fields: list[FieldSpec], cells: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """doc_id and a column f<id> for each single-cell field."""
    found = [single_cell(F.col("tables"), _key(f.table_header), _lit(f.row_selector), f.data_type.upper(), F.col("order"), empty_result(f)).alias(f"f{f.field_id}") for f in fields]
    return _with_order(cells, orders).select("doc_id", *found)


def field_rows(field: FieldSpec, cells: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """doc_id, table_idx, row_idx, a canonical text for each column of a table field, n_rows, confidence: a row for each data row.

    It is ``table_rows`` without nesting.  A document's cells are sorted once; its tables' columns, rows, choice and mean
    are windows and groups over that order, and cells that are dealt by their documents already need no exchange.
    """
    columns, names = _sub_columns(field), [f"_v{k}" for k in range(len(field.columns))]
    kind = dict(cells.dtypes)["confidence"]
    exact = F.col("confidence") if kind.startswith("decimal") else F.col("confidence").cast(_WIDE)
    if orders is not None:
        cells = cells.join(orders.select("doc_id", "order"), "doc_id", "left")
    order = F.lit(None).cast("string") if orders is None else F.col("order")
    table, no = ["doc_id", "table_idx"], F.lit(False)
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    whole, document = Window.partitionBy(*table).orderBy("row_idx", "col_idx").rowsBetween(*every), Window.partitionBy("doc_id")
    rows = cells.withColumn("_head", F.when(F.col("is_header"), header_key(F.col("content"))))
    at = {f"_c{k}": F.min(F.when(F.col("_head") == _key(c.table_header), F.struct("row_idx", "col_idx"))).over(whole)["col_idx"] for k, c in enumerate(columns)}
    rows = rows.withColumns({"_anchored": F.max(F.col("_head") == _key(field.table_header)).over(whole), **at})
    rows = rows.where(F.col("_anchored") & reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in at], no) & ~F.col("is_header"))
    cells_of = [F.min(F.when(F.col("col_idx") == F.col(c), F.struct("content", exact.alias("confidence")))).alias(n) for c, n in zip(at, names)]
    rows = rows.groupBy(*table, "row_idx", *([] if orders is None else ["order"])).agg(*cells_of)
    # the first such table, and of its rows those that are selected
    rows = rows.withColumn("_first", F.min(F.struct("table_idx")).over(document)).where(F.col("_first.table_idx").eqNullSafe(F.col("table_idx")))
    if field.row_selector in ("FIRST", "LAST"):
        end = F.min if field.row_selector == "FIRST" else F.max
        rows = rows.withColumn("_end", end(F.struct("row_idx")).over(document)).where(F.col("_end.row_idx").eqNullSafe(F.col("row_idx")))
    known = sum((F.col(n)["confidence"].isNotNull().cast("int") for n in names), F.lit(0))
    total = sum((F.coalesce(F.col(n)["confidence"], F.lit(0).cast("decimal(1,0)")) for n in names), F.lit(0).cast("decimal(1,0)"))
    rows = rows.withColumns({"n_rows": F.count(F.lit(1)).over(document).cast("int"), "_known": F.sum(known).over(document), "_total": F.sum(total).over(document)})
    mean = F.when(F.col("_known") > 0, round4(F.col("_total").cast(_WIDE) / F.col("_known").cast("int")))
    texts = [N.typed_text(F.col(n)["content"], c.data_type, order).alias(c.sub_property) for n, c in zip(names, columns)]
    return rows.select(*table, "row_idx", *texts, "n_rows", mean.alias("confidence"))


def json_string(value: Column) -> Column:
    """A text as a JSON string; what has nothing to escape is only quoted."""
    return F.when(value.rlike(r"^[ !#-\[\]-~]*\z"), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))


def json_label(name: Column) -> Column:
    """A member's name with its colon."""
    return F.concat(json_string(name), F.lit(":"))


def json_of(value: Column, data_type: Column) -> Column:
    """``json_text`` with the type in a column."""
    return _json_as(value, F.upper(data_type))


def _json_as(value: Column, kind: Column) -> Column:
    plain = kind.isin("DECIMAL", "INT") & value.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return F.when(value.isNull(), "null").when(plain, value).when((kind == "BOOL") & value.isin("True", "False"), F.lower(value)).otherwise(json_string(value))


def json_text(value: Column, data_type: str) -> Column:
    """A JSON member value: canonical numbers keep their scale, null stays null."""
    quoted = json_string(value)
    if data_type in ("DECIMAL", "INT"):
        quoted = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value).otherwise(quoted)
    if data_type == "BOOL":
        quoted = F.when(value.isin("True", "False"), F.lower(value)).otherwise(quoted)
    return F.coalesce(F.when(value.isNotNull(), quoted), F.lit("null"))


def items_json(rows: DataFrame, field: FieldSpec) -> DataFrame:
    """doc_id, items: the rows of ``field_rows`` as a JSON array of objects, in order."""
    members = [F.concat(F.lit(f'"{c.sub_property}":'), json_text(F.col(c.sub_property), c.data_type)) for c in _sub_columns(field)]
    item = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    items = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", item.alias("json")))).alias("items"))
    return items.select("doc_id", F.concat(F.lit("["), F.array_join("items.json", ","), F.lit("]")).alias("items"))


def rows_json(rows: Column, columns: Column) -> Column:
    """Rows of values as a JSON array of objects; ``columns`` is an array of struct(label, kind), see ``json_label`` and ``table_rows``."""
    def one(row):
        members = F.zip_with(columns, row["values"], lambda c, value: F.concat(c["label"], _json_as(value, c["kind"])))
        return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform(rows, one), ","), F.lit("]"))


def map_wide(template: TemplateSpec, blocks: DataFrame, cells: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id and, for each field in template order, a struct e0, e1, ... of what the long form has of it.

    Documents are those with blocks or cells, or those of ``documents`` (doc_id), where some may have neither.  Parts of a struct that nobody reads are pruned, a table field's JSON among them.
    """
    singles = [f for f in template.fields if f.source_type == "TABLE_CELL" and not f.columns]
    arrays = [f for f in template.fields if f.source_type == "TABLE_CELL" and f.columns]
    wide = resolve_blocks(list(template.fields), blocks)
    if documents is not None:
        wide = documents.select("doc_id").join(wide, "doc_id", "left")
    if singles or arrays:
        wide = wide.join(nested_tables(cells), "doc_id", "outer" if documents is None else "left").withColumns(
            {f"f{f.field_id}": single_cell(F.col("tables"), _key(f.table_header), _lit(f.row_selector), f.data_type.upper(), F.col("order"), empty_result(f)) for f in singles}
            | {f"t{f.field_id}": _rows_of(f, F.col("order")) for f in arrays}
        )
    entries = []
    for i, f in enumerate(template.fields):
        if f in arrays:  # a missing table is an empty list without confidence
            t = F.col(f"t{f.field_id}")
            labels = F.array(*[F.struct(json_label(F.lit(c.sub_property)).alias("label"), F.lit(c.data_type.upper()).alias("kind")) for c in _sub_columns(f)])
            raw, value, confidence = _lit(None), F.coalesce(rows_json(t["rows"], labels), F.lit("[]")), t["confidence"]
            ref = F.concat(F.lit("Table:"), t["table_idx"], F.lit("/rows:"), F.size(t["rows"]))
        else:
            c = F.coalesce(F.col(f"f{f.field_id}"), _without_blocks(f))
            raw, value, confidence, ref = c["raw"], c["normalized"], c["confidence"], c["source_ref"]
            value = apply_steps(F.coalesce(value, raw), f.steps) if f.steps else value
        entries.append(F.struct(
            F.lit(f.field_id).alias("field_id"), F.lit(f.target_property).alias("target_property"), raw.alias("raw"), value.alias("normalized"), confidence.alias("confidence"),
            ref.alias("source_ref"), F.coalesce(confidence < F.lit(f.min_confidence), F.lit(False)).alias("below"), F.lit(f.required).alias("required"), F.lit(f.data_type if f not in arrays else "JSON").alias("data_type"),
        ).alias(f"e{i}"))
    return wide.select("doc_id", *entries)


def map_documents(template: TemplateSpec, blocks: DataFrame, cells: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The long form: doc_id, field_id, target_property, raw, normalized, confidence, source_ref, below, required, data_type."""
    return map_wide(template, blocks, cells, documents).select("doc_id", F.inline(F.array(*[f"e{i}" for i in range(len(template.fields))])))


def with_outcome(template: TemplateSpec, wide: DataFrame) -> DataFrame:
    """The wide form with overall_confidence and needs_review of each document, without another aggregate."""
    entries = [(F.col(f"e{i}"), f.required) for i, f in enumerate(template.fields)]
    known = sum((F.col(f"e{i}.confidence").isNotNull().cast("int") for i in range(len(entries))), F.lit(0))
    total = sum((F.coalesce(e["confidence"], F.lit(0)).cast("decimal(20,10)") for e, _ in entries), F.lit(0).cast("decimal(20,10)"))
    review = reduce(lambda a, b: a | b, [e["below"] | N.is_blank(e["normalized"]) if required else e["below"] for e, required in entries])
    return wide.withColumn("overall_confidence", round4(F.when(known > 0, total.cast("decimal(20,10)") / known))).withColumn("needs_review", review)


def outcomes(long: DataFrame) -> DataFrame:
    """doc_id, overall_confidence, needs_review, status of mapped documents."""
    blank = F.col("required") & N.is_blank(F.col("normalized"))
    review = F.bool_or("below") | F.bool_or(blank)
    rows = long.groupBy("doc_id").agg(mean4(F.col("confidence")).alias("overall_confidence"), review.alias("needs_review"))
    return rows.withColumn("status", F.when(F.col("needs_review"), "NEEDS_REVIEW").otherwise("MAPPED"))


def mapped_json(long: DataFrame) -> DataFrame:
    """doc_id, mapped_json: members in field order; of a repeated property the last value stays, at its first place."""
    member = json_text(F.col("normalized"), "STRING")
    for kind in ("DECIMAL", "INT", "BOOL"):
        member = F.when(F.col("data_type") == kind, json_text(F.col("normalized"), kind)).otherwise(member)
    member = F.when(F.col("data_type") == "JSON", F.coalesce("normalized", F.lit("null"))).otherwise(member)
    rows = long.groupBy("doc_id", "target_property").agg(F.min("field_id").alias("at"), F.max_by(member, "field_id").alias("m"))
    entry = F.concat(F.regexp_replace(F.to_json(F.array("target_property")), r"^\[|\]$", ""), F.lit(":"), F.col("m"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", entry.alias("e")))).alias("members"))
    return rows.select("doc_id", F.concat(F.lit("{"), F.array_join(F.transform("members", lambda x: x["e"]), ","), F.lit("}")).alias("mapped_json"))


def map_zonal(template: TemplateSpec, scalars: DataFrame, tables: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The long form from zone results (doc_id, field_id, raw, confidence) and zone tables (doc_id, field_id, items_json, n_rows, confidence).

    With ``documents`` (doc_id) those without any result are mapped too.  A field without a result takes its default at confidence 0; a table region without rows whose property
    another region has produced emits nothing; a table without rows has no value, which a required field shows.
    """
    no_scalar, no_table = {"raw": "string", "s_conf": "decimal(5,4)"}, {"items_json": "string", "n_rows": "int", "t_conf": "decimal(5,4)"}
    one = scalars.select("doc_id", "field_id", "raw", F.col("confidence").cast("decimal(5,4)").alias("s_conf"), *[F.lit(None).cast(t).alias(n) for n, t in no_table.items()])
    two = tables.select("doc_id", "field_id", *[F.lit(None).cast(t).alias(n) for n, t in no_scalar.items()], "items_json", "n_rows", F.col("confidence").cast("decimal(5,4)").alias("t_conf"))
    results = one.withColumn("vote", N.date_order_vote(F.col("raw"))).unionByName(two.withColumn("vote", F.lit(None).cast("string")))
    own = [F.max(F.when(F.col("field_id") == f.field_id, F.struct("s_conf", "t_conf", "raw", "items_json", "n_rows"))).alias(f"r{i}") for i, f in enumerate(template.fields)]
    rows = results.groupBy("doc_id").agg(F.min_by("vote", F.when(F.col("vote").isNotNull(), F.col("field_id"))).alias("order"), *own)
    if documents is not None:
        rows = documents.select("doc_id").join(rows, "doc_id", "left")
    regions = [(i, f.target_property.lower()) for i, f in enumerate(template.fields) if f.source_type == "TABLE_CELL"]
    entries = []
    for i, f in enumerate(template.fields):
        r = F.col(f"r{i}")
        missing = r["s_conf"].isNull() & r["n_rows"].isNull()
        if f.source_type == "TABLE_CELL":
            value, ref = F.when(r["n_rows"] > 0, r["items_json"]), F.concat(F.lit("ZoneTable/rows:"), r["n_rows"])
        else:
            value, ref = N.typed_text(r["raw"], f.data_type, F.col("order")), F.lit("Zone")
            value = apply_steps(F.coalesce(value, r["raw"]), f.steps) if f.steps else value
        confidence = F.when(missing, F.lit(0)).otherwise(F.coalesce(r["s_conf"], r["t_conf"])).cast("decimal(5,4)")
        entry = F.struct(
            F.lit(f.field_id).alias("field_id"), F.lit(f.target_property).alias("target_property"), r["raw"].alias("raw"), F.when(missing, F.lit(f.default_value)).otherwise(value).alias("normalized"), confidence.alias("confidence"),
            F.when(~missing, ref).alias("source_ref"), F.coalesce(confidence < F.lit(f.min_confidence), F.lit(False)).alias("below"), F.lit(f.required).alias("required"),
        )
        siblings = [F.col(f"r{k}.n_rows").isNotNull() for k, name in regions if name == f.target_property.lower() and k != i]
        if f.source_type == "TABLE_CELL" and siblings:
            entry = F.when(r["n_rows"].isNotNull() | ~reduce(lambda a, b: a | b, siblings), entry)
        entries.append(entry)
    return rows.select("doc_id", F.inline(F.array_compact(F.array(*entries))))
