"""Templates as rows: relational template tables to one nested row a template and back, and documents of many templates mapped in one plan.

A document meets its template by an equi-join; from there on it is one row, whose fields, blocks and tables are arrays.
No row is made for a field or a block, the number of templates does not change the plan, and nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.functions import transforms as T
from paperloom.operators import mapping as M
from paperloom.schema import TemplateSpec

COLUMN = "struct<sub_property:string,data_type:string,table_header:string,sort_order:int,x_start:double,x_end:double,is_anchor:boolean>"
STEP = "struct<step_order:int,kind:string,config:map<string,string>>"
FIELD = (
    "struct<field_id:int,target_property:string,source_type:string,data_type:string,key_pattern:string,regex:string,table_header:string,row_selector:string,default_value:string,"
    f"required:boolean,min_confidence:decimal(5,4),page_role:string,zone:struct<x:double,y:double,width:double,height:double>,columns:array<{COLUMN}>,steps:array<{STEP}>>"
)
TEMPLATES = f"template_id int, mode string, document_type string, version int, is_active boolean, fields array<{FIELD}>"
_PARTS = ("columns", "steps", "zone")


def _members(struct: str) -> list[str]:
    """Names of a struct type's own members."""
    depth, names, name = 0, [], ""
    for c in struct.removeprefix("struct<")[:-1] + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            names.append(name.partition(":")[0])
            name = ""
        else:
            name += c
    return names


FIELD_MEMBERS, COLUMN_MEMBERS, STEP_MEMBERS = _members(FIELD), _members(COLUMN), _members(STEP)


def _sorted(array: Column, member: str) -> Column:
    """An array of structs by one of their members; the others need no order."""
    return F.array_sort(array, lambda a, b: F.when(a[member] < b[member], -1).when(a[member] > b[member], 1).otherwise(0))


def nested(templates: DataFrame, fields: DataFrame, columns: DataFrame, steps: DataFrame) -> DataFrame:
    """One row a template with its fields by id, their active columns and steps in order: what a mapping run reads.

    fields: template_id, field_id and plain members of FIELD, the zone as zone_x, zone_y, zone_width, zone_height;
    columns: field_id and members of COLUMN, is_active; steps: field_id, step_order, kind, config, is_active.
    """
    def children(rows: DataFrame, members: list[str], order: str, kind: str, name: str) -> DataFrame:
        entry = F.struct(*[F.col(m) if m in rows.columns else F.lit(None).alias(m) for m in dict.fromkeys([order, *members])])
        kept = rows.where(F.coalesce("is_active", F.lit(True))) if "is_active" in rows.columns else rows
        ordered = F.transform(_sorted(F.collect_list(entry), order), lambda c: F.struct(*[c[m].alias(m) for m in members]))
        return kept.groupBy("field_id").agg(ordered.cast(f"array<{kind}>").alias(name))

    zone = F.when(F.col("zone_x").isNotNull(), F.struct(*[F.col(f"zone_{k}").cast("double").alias(k) for k in ("x", "y", "width", "height")])) if "zone_x" in fields.columns else F.lit(None)
    rows = fields.join(children(columns, COLUMN_MEMBERS, "sort_order", COLUMN, "columns"), "field_id", "left").join(children(steps, STEP_MEMBERS, "step_order", STEP, "steps"), "field_id", "left")
    entry = F.struct(*[zone.alias("zone") if m == "zone" else F.col(m) if m in _PARTS or m in fields.columns else F.lit(None).alias(m) for m in FIELD_MEMBERS])
    gathered = rows.groupBy("template_id").agg(_sorted(F.collect_list(entry.cast(FIELD)), "field_id").alias("fields"))
    return templates.join(gathered, "template_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast(f"array<{FIELD}>")))


def template_by_id(templates: DataFrame, template_id: int) -> DataFrame:
    """One template with its fields."""
    return templates.where(F.col("template_id") == template_id)


def flattened(nested_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested templates back to rows of fields, columns and steps; columns and steps carry their order."""
    fields = nested_rows.select("template_id", F.explode("fields").alias("f"))
    plain = [F.col(f"f.{m}").alias(m) for m in FIELD_MEMBERS if m not in _PARTS]
    zone = [F.col(f"f.zone.{k}").alias(f"zone_{k}") for k in ("x", "y", "width", "height")]
    columns = fields.select(F.col("f.field_id").alias("field_id"), F.inline("f.columns"))
    steps = fields.select(F.col("f.field_id").alias("field_id"), F.inline("f.steps"))
    return fields.select("template_id", *plain, *zone), columns, steps


def template_row(spec: TemplateSpec) -> tuple:
    """A specification as a row of TEMPLATES."""
    def config(c: dict) -> dict:
        return {k: v if isinstance(v, str) else str(v) for k, v in c.items()}

    fields = [
        (
            f.field_id, f.target_property, f.source_type, f.data_type, f.key_pattern, f.regex, f.table_header, f.row_selector, f.default_value, f.required, f.min_confidence, f.page_role, f.zone,
            [(c.sub_property, c.data_type, c.table_header, c.sort_order, c.x_start, c.x_end, c.is_anchor) for c in sorted(f.columns, key=lambda c: c.sort_order)],
            [(s.order, s.kind, config(s.config)) for s in sorted(f.steps, key=lambda s: s.order) if s.active],
        )
        for f in spec.fields
    ]
    return spec.template_id, spec.mode, spec.document_type, 1, True, fields


#: Steps whose configuration is a column: name -> (value, map of texts) -> value.
STEPS = {
    "trim": lambda v, c: N.trimmed(v),
    "case": lambda v, c: F.when(c["mode"] == "upper", F.upper(v)).when(c["mode"] == "lower", F.lower(v)).when(c["mode"] == "title", T.title_case(v)).otherwise(v),
    "regex_replace": lambda v, c: F.when(c["pattern"].isNull(), v).otherwise(F.regexp_replace(v, F.coalesce(c["pattern"], F.lit("")), F.replace(F.coalesce(c["replacement"], F.lit("")), F.lit("\\"), F.lit("\\\\")))),
    "number_clean": lambda v, c: F.coalesce(_fixed(T.cleaned_number(v), F.coalesce(c["decimals"].try_cast("int"), F.lit(2))), v),
    "date_normalize": lambda v, c: F.coalesce(F.call_function("date_format", T.parsed_date(v), F.coalesce(c["format"], F.lit("yyyy-MM-dd"))), v),
    "default": lambda v, c: F.when(N.is_blank(v), c["value"]).otherwise(v),
    "ai_summary": lambda v, c: F.when(N.is_blank(v), v).otherwise(F.concat(F.lit("[summary] "), _cut(v, F.coalesce(c["maxChars"].try_cast("int"), F.lit(120))))),
    "translate": lambda v, c: F.concat(F.lit("["), F.coalesce(c["to"], F.lit("en")), F.lit("] "), v),
}


def _fixed(number: Column, decimals: Column) -> Column:
    text = F.lit(None).cast("string")
    for n in range(11):
        text = F.when(decimals == n, number.cast(f"decimal(38,{n})").cast("string")).otherwise(text)
    return text


def _cut(v: Column, most: Column) -> Column:
    return F.when(F.length(v) > most, F.concat(F.substr(v, F.lit(1), most), F.lit("…"))).otherwise(v)


def _stepped(value: Column, steps: Column) -> Column:
    """The value after the field's steps in order; steps of unknown types are skipped."""
    def one(v, step):
        out = v
        for name, make in STEPS.items():
            out = F.when(F.lower(step["kind"]) == name, make(v, step["config"])).otherwise(out)
        return out

    return F.aggregate(F.coalesce(steps, F.array().cast(f"array<{STEP}>")), value, one)


def _matches(text: Column, pattern: Column) -> Column:
    """A search with a pattern from a column: this function keeps the last pattern compiled, which RLIKE does not."""
    return F.regexp_instr(text, pattern) > 0


def _groups(pattern: Column) -> Column:
    """Whether a pattern has capturing groups: an open bracket that is neither escaped, in a class, nor special."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    return bare.rlike(r"\((?!\?)|\(\?<[A-Za-z]")


def _document_rows(documents: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """One row a document: its blocks in order and its cells in any, gathered by one grouping of the three tables.

    Each is dealt by document, unless it is already.
    """
    block = F.struct("page", "block_id", "content", "key", "value", "confidence")
    parts = [documents.select("doc_id", F.struct("template_id").alias("asked")), M.split_key(blocks).select("doc_id", block.alias("block")), cells.select("doc_id", M.cell_entry().alias("cell"))]
    rows = reduce(lambda a, b: a.unionByName(b, True), [p.repartition("doc_id") for p in parts])
    # nothing belongs to a document without id
    whole = rows.where("doc_id is not null or asked is not null").groupBy("doc_id").agg(*[F.collect_list(n).alias(f"{n}s") for n in ("asked", "block", "cell")])
    return whole.select("doc_id", F.inline("askeds"), F.sort_array("blocks").alias("blocks"), "cells")


def _entry(f: Column, row: dict[str, Column], exact: str) -> Column:
    """A field's struct of the long form, from its specification ``f`` and the document's row; ``exact`` holds sums of its cells' confidences."""
    kind, is_array, has_steps = f["source"], f["is_array"], f["has_steps"]
    empty = M.result(F.lit(None), f["default_value"], F.lit(0), F.lit(None))

    def key_value(hit):
        found = M.result(hit["value"], N.typed_as(hit["value"], f["kind"], row["order"]), hit["confidence"], F.concat(F.lit("TextBlock:"), hit["block_id"]))
        return F.when(hit.isNotNull(), found).otherwise(empty)

    def searched(pattern):
        raw = F.call_function("regexp_extract", row["text"], pattern, f["regex_group"])
        found = N.bound(raw, lambda r: M.result(r, N.typed_as(r, f["kind"], row["order"]), F.coalesce(row["mean"], F.lit(0)), F.lit("Regex:fulltext")))
        return F.when(_matches(row["text"], pattern), found).otherwise(empty)

    first_hit = M.first(F.filter(row["keyed"], lambda b: _matches(b["key"], f["key_pattern"])))
    scalar = (
        F.when((kind == "KEY_VALUE") & f["key_pattern"].isNotNull(), N.bound(first_hit, key_value))
        .when((kind == "REGEX") & f["regex"].isNotNull() & row["text"].isNotNull(), searched(f["regex"]))
        .when(kind == "TABLE_CELL", M.single_cell(row["tables"], f["header"], f["row_selector"], f["kind"], row["order"], empty, exact))
        .when(kind == "CONSTANT", M.result(f["default_value"], f["default_value"], F.lit(1), F.lit(None)))
        .when(kind.isin("KEY_VALUE", "REGEX"), empty).otherwise(M.result(F.lit(None), F.lit(None), F.lit(0), F.lit(None)))
    )

    def array_entry(t):
        ref = F.concat(F.lit("Table:"), t["table_idx"], F.lit("/rows:"), F.size(t["rows"]))
        return M.result(F.lit(None), F.coalesce(M.rows_json(t["rows"], f["columns"]), F.lit("[]")), t["confidence"], ref)

    table = M.table_rows(row["tables"], f["header"], f["columns"], f["row_selector"], row["order"], exact)

    def finished(r):
        value = F.when(has_steps & ~is_array, _stepped(F.coalesce(r["normalized"], r["raw"]), f["steps"])).otherwise(r["normalized"])
        return F.struct(
            f["field_id"].alias("field_id"), f["target_property"].alias("target_property"), r["raw"].alias("raw"), value.alias("normalized"), r["confidence"].alias("confidence"), r["source_ref"].alias("source_ref"),
            F.coalesce(r["confidence"] < f["min_confidence"], F.lit(False)).alias("below"), F.coalesce(f["required"], F.lit(False)).alias("required"), F.when(is_array, "JSON").otherwise(f["data_type"]).alias("data_type"),
        )

    return N.bound(F.when(is_array, N.bound(table, array_entry)).otherwise(scalar), finished)


def map_by_template(documents: DataFrame, templates: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """documents (doc_id, template_id) -> doc_id, template_id, values (the long form's structs, in the order of the fields).

    A document whose template does not exist has null values: nothing is guessed.
    """
    fields = templates.select("template_id", F.transform("fields", _prepared).alias("fields"), _any_key(F.col("fields")).alias("any_key"), *[_any(F.col("fields"), of).alias(name) for name, of in _USES.items()])
    rows = _document_rows(documents.select("doc_id", "template_id"), blocks, cells).join(fields, "template_id", "left")
    # one pass over the blocks leaves those that any of the template's patterns finds; what no field of the template reads is not made
    keyed = F.filter("blocks", lambda b: b["key"].isNotNull() & F.when(F.col("any_key") != "", _matches(b["key"], F.col("any_key"))).otherwise(False))
    votes = F.filter(F.transform("blocks", lambda b: N.date_order_vote(b["content"])), lambda v: v.isNotNull())
    text = F.array_join(F.transform("blocks", lambda b: b["content"]), "\n")
    rows = rows.select(
        "doc_id", "template_id", "fields", "blocks", keyed.alias("keyed"), F.when(F.col("dated"), M.first(votes)).alias("order"),
        F.when(F.col("searched") & (F.size("blocks") > 0), text).alias("text"), F.when(F.col("tabled"), M.tables_of(F.col("cells"))).alias("tables"),
    )
    row = {n: F.col(n) for n in ("order", "keyed", "text", "tables")} | {"mean": M.array_mean4(F.transform("blocks", lambda b: b["confidence"]), M.sum_type(dict(blocks.dtypes)["confidence"]))}
    exact = M.sum_type(dict(cells.dtypes)["confidence"])
    return rows.select("doc_id", "template_id", F.transform("fields", lambda f: _entry(f, row, exact)).alias("values"))


#: What the fields of a template read of a document beside its keys.
_USES = {
    "dated": lambda f: (F.upper(f["data_type"]) == "DATE") | F.exists(f["columns"], lambda c: F.upper(c["data_type"]) == "DATE"),
    "searched": lambda f: F.upper(f["source_type"]) == "REGEX", "tabled": lambda f: F.upper(f["source_type"]) == "TABLE_CELL",
}


def _any(fields: Column, of) -> Column:
    return F.exists(fields, lambda f: F.coalesce(of(f), F.lit(False)))


def _prepared(f: Column) -> Column:
    """What depends on the template alone: headers and patterns as they are compared, types in capitals, names as JSON has them, and the regex's group that counts."""
    def some(parts):
        return F.coalesce(F.size(parts), F.lit(0)) > 0

    columns = F.transform(f["columns"], lambda c: c.withField("header", M.header_key(c["table_header"])).withField("label", M.json_label(c["sub_property"])).withField("kind", F.upper(c["data_type"])))
    own = {
        "columns": columns, "header": M.header_key(f["table_header"]), "regex_group": F.when(_groups(f["regex"]), 1).otherwise(0), "kind": F.upper(f["data_type"]), "source": F.upper(f["source_type"]),
        "key_pattern": F.concat(F.lit("(?iu)"), f["key_pattern"]), "regex": F.concat(F.lit("(?iu)"), f["regex"]), "is_array": (F.upper(f["source_type"]) == "TABLE_CELL") & some(f["columns"]), "has_steps": some(f["steps"]),
    }
    return reduce(lambda made, name: made.withField(name, own[name]), own, f)


def _any_key(fields: Column) -> Column:
    """All key patterns of a template as one."""
    patterns = F.transform(F.filter(fields, lambda f: (F.upper(f["source_type"]) == "KEY_VALUE") & f["key_pattern"].isNotNull()), lambda f: F.concat(F.lit("(?:"), f["key_pattern"], F.lit(")")))
    joined = F.array_join(patterns, "|")
    return F.when(joined != "", F.concat(F.lit("(?iu)"), joined)).otherwise("")


def long_form(mapped: DataFrame) -> DataFrame:
    """A row for each value.

    The outer form asks nothing of the values beforehand: a filter on them would be moved down and compute them all again.
    """
    return mapped.select("doc_id", "template_id", F.inline_outer("values")).where(F.col("below").isNotNull())


def with_outcome(mapped: DataFrame) -> DataFrame:
    """Mapped documents with overall_confidence, needs_review, status and mapped_json, from the values in their row."""
    values = F.col("values")
    review = F.exists(values, lambda v: v["below"] | (v["required"] & N.is_blank(v["normalized"])))
    # of a repeated property the last value stays, at its first place
    first = F.filter(values, lambda v, i: ~F.exists(F.slice(values, F.lit(1), i), lambda w: w["target_property"] == v["target_property"]))
    last = lambda v: F.element_at(F.filter(values, lambda w: w["target_property"] == v["target_property"]), F.lit(-1))
    text = lambda v: F.when(v["data_type"] == "JSON", F.coalesce(v["normalized"], F.lit("null"))).otherwise(M.json_of(v["normalized"], v["data_type"]))
    members = F.transform(first, lambda v: F.concat(M.json_string(v["target_property"]), F.lit(":"), N.bound(last(v), text)))
    out = mapped.withColumn("overall_confidence", M.array_mean4(F.transform(values, lambda v: v["confidence"]))).withColumn("needs_review", review)
    return out.withColumn("status", F.when(F.col("needs_review"), "NEEDS_REVIEW").when(~F.col("needs_review"), "MAPPED")).withColumn("mapped_json", F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
