"""Relational statements over the record model: lookups, upserts, results, events, export and workflow.

Writes are overlays: an update is a join with a small change set, an upsert is what is not changed plus the
changes, status is derived from the event log.  Names follow the tables they act on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.normalize import bound, date_order_vote, trimmed, typed_text
from paperloom.functions.scalars import block_anchor, confidence_band
from paperloom.operators.mapping import json_of, json_string

#: Allowed (from, to) steps of a document's status; a failure may follow anything.
TRANSITIONS = (
    (None, "CAPTURED"), ("CAPTURED", "CAPTURED"), ("CAPTURED", "CLASSIFIED"), ("CLASSIFIED", "EXTRACTED"), ("EXTRACTED", "MAPPED"), ("EXTRACTED", "NEEDS_REVIEW"), ("EXTRACTED", "FAILED"),
    ("CLASSIFIED", "MAPPED"), ("CLASSIFIED", "NEEDS_REVIEW"), ("FAILED", "CAPTURED"), ("NEEDS_REVIEW", "VALIDATED"), ("VALIDATED", "CONSUMED"), ("CONSUMED", "CONSUMED"),
)


def recent(documents: DataFrame, status: str, created: str, n: int, exclude: str = "SAMPLE") -> DataFrame:
    return documents.where(F.col(status) != exclude).orderBy(F.desc(created), *sorted(set(documents.columns) - {created})).limit(n)


def with_any(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows that have a match: EXISTS."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def without_any(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows that have no match: NOT EXISTS."""
    return left.join(right.select(key), key, "left_anti")


def flagged(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """A correlated EXISTS as a column."""
    marks = right.select(key).distinct().withColumn(flag, F.lit(True))
    return left.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def counted(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """A correlated COUNT as a column."""
    return left.join(right.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an order that is unique in it."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def grouped(children: DataFrame, parent: str, order: str, columns: list[str], name: str, active: str | None = None) -> DataFrame:
    """parent, name: the active children in order, as an array of structs."""
    rows = children.where(F.col(active)) if active else children
    return rows.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))


def children_of(children: DataFrame, key: str, value, order: list[str], active: str | None = None) -> DataFrame:
    """One parent's rows in order (pages of a document, properties, fields of a template)."""
    rows = children.where(F.col(key) == value)
    return (rows.where(F.col(active)) if active else rows).orderBy(*order)


def active_types(types: DataFrame, name: str = "name") -> DataFrame:
    return types.where("is_active").orderBy(name)


def first_active(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's active row of the least order: the processor of an engine, the template of a type."""
    columns = [c for c in rows.columns if c != key]
    return rows.where("is_active").groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def with_event(events: DataFrame, fresh: DataFrame, key: str = "doc_id", number: str = "event_id") -> DataFrame:
    """The log with further events (key, ...), numbered on from each key's last."""
    last = events.groupBy(key).agg(F.max(number).alias("_last"))
    columns = [c for c in fresh.columns if c != key]
    over = Window.partitionBy(key).orderBy(*(columns or [key]))
    added = fresh.join(last, key, "left").withColumn(number, F.coalesce("_last", F.lit(0)) + F.row_number().over(over)).drop("_last")
    return events.unionByName(added, allowMissingColumns=True)


def saved_results(results: DataFrame, values: DataFrame, headers: DataFrame, lines: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Results and values with a further result a document: headers (key, ...) are numbered on, lines (key, ...) carry that number; one header a key."""
    numbered = with_event(results, headers, key, "result_id")
    last = results.groupBy(key).agg(F.max("result_id").alias("_last"))
    added = lines.join(last, key, "left").withColumn("result_id", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    return numbered, values.unionByName(added, allowMissingColumns=True)


def template_list(templates: DataFrame, types: DataFrame, fields: DataFrame) -> DataFrame:
    """Templates with their type's name and their number of fields, by name and then the newest version first."""
    named = templates.join(types.select("type_id", F.col("name").alias("type_name")), "type_id")
    return counted(named, fields, "template_id", "field_count").orderBy("name", F.desc("version"))


def template_columns(fields: DataFrame, columns: DataFrame, template_id: int, names: list[str]) -> DataFrame:
    """field_id, columns: the active sub-columns of a template's fields, in order."""
    own = with_any(columns, fields.where(F.col("template_id") == template_id), "field_id")
    return grouped(own, "field_id", "sort_order", names, "columns", "is_active")


def created_templates(templates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Templates with new ones (columns but an id): ids go on from the largest, version 1, active; designers add a few at a time."""
    last = templates.agg(F.coalesce(F.max("template_id"), F.lit(0)).alias("_last"))
    added = fresh.crossJoin(F.broadcast(last)).withColumn("template_id", F.col("_last") + F.row_number().over(Window.orderBy(*fresh.columns)))  # one row
    return templates.unionByName(added.drop("_last").withColumns({"version": F.lit(1), "is_active": F.lit(True)}), allowMissingColumns=True)


def bound_newest_sample(templates: DataFrame, documents: DataFrame, pages: DataFrame, file_part: str, name_part: str) -> DataFrame:
    """Templates whose name holds a part and that have no sample get the newest document with pages whose file name holds another; if there is none, nothing changes."""
    found = with_any(documents.where(F.contains(F.lower("file_name"), F.lit(file_part.lower()))), pages, "doc_id")
    newest_one = found.agg(F.max_by("doc_id", F.struct("created", "doc_id")).alias("_sample"))
    free = F.col("sample_doc_id").isNull() & F.contains(F.lower("name"), F.lit(name_part.lower()))
    rows = templates.crossJoin(F.broadcast(newest_one))  # one row
    return rows.withColumn("sample_doc_id", F.when(free, F.col("_sample")).otherwise(F.col("sample_doc_id"))).drop("_sample")


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.col("is_active") & (F.col("email") == email))


def role_names(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """user_id, role_name of every role that a user holds."""
    return user_roles.join(roles, "role_id").select("user_id", "role_name")


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The frame with each column (name: type), null where it was not there; names are case-blind, and doing it twice changes nothing."""
    present = {c.lower() for c in df.columns}
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name.lower() not in present})


def newest(documents: DataFrame, kind: str, document_id: str, order: list[str]) -> DataFrame:
    """kind, document: of each kind the newest document, by several keys in turn."""
    return documents.groupBy(kind).agg(F.max_by(document_id, F.struct(*order)).alias(document_id))


def resolved_template(picks: DataFrame, candidates: DataFrame, kind: str = "doc_type", template: str = "template_id") -> DataFrame:
    """Picks with their template if it is a candidate of the document's type, else with null: nothing is guessed."""
    known = candidates.select(kind, template).distinct().withColumn("_known", F.lit(True))
    return picks.join(known, [kind, template], "left").withColumn(template, F.when(F.col("_known"), F.col(template))).drop("_known")


def processing_route(mode: Column) -> Column:
    return F.when(F.upper(trimmed(mode)) == "REALTIME", "INLINE").otherwise("QUEUE")


def valid_uploads(uploads: DataFrame, templates: DataFrame, length: str = "length", template: str = "template_id") -> DataFrame:
    """Uploads of files that are not empty and that name an existing template."""
    return with_any(uploads.where(F.col(length) > 0), templates, template)


def review_values(values: DataFrame, fields: DataFrame, cutoff: float = 0.60) -> DataFrame:
    """Mapped values with their field's zone, the band of their confidence and the block that they came from; a field that is gone leaves its zone empty."""
    zones = fields.select("field_id", *[c for c in fields.columns if c.startswith("zone_")])
    rows = values.join(zones, "field_id", "left")
    return rows.withColumn("band", confidence_band(F.col("confidence"), cutoff)).withColumn("anchor", block_anchor(F.col("source_ref")))


def document_detail(documents: DataFrame, results: DataFrame, extraction: DataFrame, properties: DataFrame, logs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with their latest result and, as arrays in order, blocks, properties and export attempts."""
    def gathered(rows, order, name):
        return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in (key, order)]))).alias(name))

    out = documents.join(latest(results, key, "result_id").select(key, F.struct("result_id", *[c for c in results.columns if c not in (key, "result_id")]).alias("result")), key, "left")
    for rows, order, name in ((extraction, "block_id", "blocks"), (properties, "property", "properties"), (logs, "attempt", "exports")):
        out = out.join(gathered(rows, order, name), key, "left")
    return out


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return without_any(current, changes, key).unionByName(changes, allowMissingColumns=True)


def insert_missing(current: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """MERGE ... WHEN NOT MATCHED THEN INSERT."""
    return current.unionByName(without_any(seed, current, key), allowMissingColumns=True)


def replace_children(current: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Delete a parent's children, then insert the new ones; a sort order of 0 becomes the ordinal."""
    if "sort_order" in fresh.columns:
        at = F.row_number().over(Window.partitionBy(parent).orderBy("sort_order", *[c for c in fresh.columns if c not in (parent, "sort_order")]))
        fresh = fresh.withColumn("sort_order", F.when(F.col("sort_order") == 0, at - 1).otherwise(F.col("sort_order")))
    return without_any(current, fresh, parent).unionByName(fresh, allowMissingColumns=True)


def overlay(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A partial update: what a change leaves null stays."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return current.join(new, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def correct(values: DataFrame, corrections: DataFrame) -> DataFrame:
    """values (doc_id, field_id, normalized, below) with a reviewer's corrections (doc_id, field_id, value), which clear the flag."""
    new = corrections.select("doc_id", "field_id", F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    rows = values.join(new, ["doc_id", "field_id"], "left")
    return rows.withColumn("normalized", F.when(F.col("_hit"), F.col("_value")).otherwise(F.col("normalized"))).withColumn("below", F.col("below") & F.col("_hit").isNull()).drop("_value", "_hit")


def matching_targets(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with each active target of their type or of every type.

    The wildcard is one join: targets are few and spread over the types that occur, so it stays an equi-join.
    """
    active = targets.where("is_active")
    typed = active.where("doc_type is not null").select(F.col("doc_type").alias("_type"), "target_id")
    every = active.where("doc_type is null").agg(F.collect_list("target_id").alias("_every"))
    own = typed.groupBy("_type").agg(F.collect_list("target_id").alias("_own"))
    none = F.array().cast("array<int>")
    rows = documents.join(own, F.col("doc_type") == F.col("_type"), "left").crossJoin(F.broadcast(every))  # one row
    both = F.concat(F.coalesce("_own", none), F.coalesce("_every", none))
    return rows.withColumn("target_id", F.explode(both)).drop("_type", "_own", "_every")


def reexported(documents: DataFrame, targets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sends of a manual re-export (wanted: doc_id): only documents that are ready by now go out, once to each target."""
    ready = documents.where(F.col("status").isin("VALIDATED", "CONSUMED"))
    return matching_targets(with_any(ready, wanted, "doc_id"), targets)


def consumed(documents: DataFrame, attempts: DataFrame) -> DataFrame:
    """doc_id, status after export: CONSUMED only if at least one target ran and all succeeded."""
    done = attempts.groupBy("doc_id").agg(F.bool_and("succeeded").alias("_all"))
    ready = F.col("status").isin("VALIDATED", "CONSUMED") & F.coalesce("_all", F.lit(False))
    return documents.join(done, "doc_id", "left").select("doc_id", F.when(ready, "CONSUMED").otherwise(F.col("status")).alias("status"))


def classified(documents: DataFrame, decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """Documents with a classifier's decisions (doc_id, doc_type, confidence): these are CLASSIFIED and updated now, all others stay."""
    new = decisions.select("doc_id", F.col("doc_type").alias("_type"), F.col("confidence").cast("decimal(5,4)").alias("_sure"), F.lit(True).alias("_hit"))
    rows = ensure_columns(documents, {"classify_confidence": "decimal(5,4)", "updated_at": "timestamp"}).join(new, "doc_id", "left")
    hit = F.col("_hit").isNotNull()
    changed = {"doc_type": F.col("_type"), "classify_confidence": F.col("_sure"), "status": F.lit("CLASSIFIED"), "updated_at": F.current_timestamp() if now is None else now}
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed.items()}).drop("_type", "_sure", "_hit")


def with_status(documents: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Documents with new states (doc_id, status), updated now; a document that several changes name takes the one of the last ``at``."""
    last = changes.groupBy("doc_id").agg((F.max_by("status", "at") if "at" in changes.columns else F.max("status")).alias("_status"))
    rows = ensure_columns(documents, {"updated_at": "timestamp"}).join(last, "doc_id", "left")
    hit = F.col("_status").isNotNull()
    return rows.withColumn("updated_at", F.when(hit, F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("_status", "status")).drop("_status")


def checked_events(events: DataFrame, key: str, order: list, status: str) -> DataFrame:
    """Events with the status before and whether the step is allowed."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    allowed = F.array(*[F.concat(F.lit((a or "") + ">"), F.lit(b)) for a, b in TRANSITIONS])
    step = F.concat(F.coalesce(before, F.lit("")), F.lit(">"), F.col(status))
    return events.withColumn("before", before).withColumn("valid", F.array_contains(allowed, step) | (F.col(status) == "FAILED"))


def finalize(status: Column) -> Column:
    return F.when(status == "NEEDS_REVIEW", "VALIDATED").otherwise(status)


def retry_delays(attempts: int, base_seconds: float) -> Column:
    """Seconds before each further attempt."""
    return F.transform(F.sequence(F.lit(1), F.lit(attempts)), lambda k: F.lit(base_seconds) * F.pow(F.lit(2.0), k - 1))


def line_items(json: Column, names: list[str]) -> Column:
    """A JSON array of objects as array<struct<string...>>: number text stays as written, missing is empty."""
    schema = "array<struct<" + ",".join(f"`{n}`:string" for n in [*names, "_pg"]) + ">>"
    quoted = F.regexp_replace(json, r'((?<!\\)"\s*:\s*)(-?[0-9][0-9.eE+\-]*)(?=\s*[,}])', '$1"$2"')  # parsing would drop the scale
    rows = F.from_json(quoted, schema)
    page = lambda r: F.coalesce(F.when(r["_pg"].try_cast("int") >= 1, r["_pg"].try_cast("int")), F.lit(1))
    return F.transform(rows, lambda r: F.struct(*[F.coalesce(r[n], F.lit("")).alias(n) for n in names], page(r).alias("page")))


def retyped(rows: Column, types: dict[str, str], order: Column) -> Column:
    """Edited rows typed again, with their page."""
    return F.transform(rows, lambda r: F.struct(*[typed_text(r[n], t, order).alias(n) for n, t in types.items()], r["page"].alias("page")))


def edited_tables(edits: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, field_id, value: a reviewer's rows (doc_id, field_id, rows: array of map) as the JSON that a mapping run would store.

    columns: field_id, columns (array of struct(sub_property, data_type) in order); edits of other fields are left out.
    Every cell is typed again by the day/month order that the edited cells show; a row keeps its page.
    """
    rows = edits.join(columns.where(F.size("columns") > 0).select("field_id", "columns"), "field_id")
    votes = F.filter(F.flatten(F.transform("rows", lambda r: F.transform(F.map_values(r), date_order_vote))), lambda v: v.isNotNull())
    rows = rows.withColumn("_order", F.get(votes, F.lit(0)))

    def item(r):
        cell = lambda c: F.concat(json_string(c["sub_property"]), F.lit(":"), bound(typed_text(F.try_element_at(r, c["sub_property"]), c["data_type"], F.col("_order")), lambda v: json_of(v, c["data_type"])))
        page = F.try_element_at(r, F.lit("_pg")).try_cast("int")
        members = F.concat(F.transform("columns", cell), F.when(page >= 1, F.array(F.concat(F.lit('"_pg":'), page))).otherwise(F.array().cast("array<string>")))
        return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))

    return rows.select("doc_id", "field_id", F.concat(F.lit("["), F.array_join(F.transform("rows", item), ","), F.lit("]")).alias("value"))


def review_saved(documents: DataFrame, values: DataFrame, corrections: DataFrame, edits: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values with a reviewer's corrections of fields and tables, and the documents, of which the reviewed ones are finalized."""
    every = corrections.select("doc_id", "field_id", "value").unionByName(edited_tables(edits, columns))
    reviewed = corrections.select("doc_id").unionByName(edits.select("doc_id")).distinct().withColumn("_hit", F.lit(True))
    done = documents.join(reviewed, "doc_id", "left").withColumn("status", F.when(F.col("_hit"), finalize(F.col("status"))).otherwise(F.col("status"))).drop("_hit")
    return correct(values, every), done


def duplicate_regions(regions: DataFrame) -> DataFrame:
    """template_id, name of tables that may not be saved: several regions need distinct roles, all given."""
    groups = regions.groupBy("template_id", F.lower(trimmed(F.col("name"))).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("r"), F.count_distinct("role").alias("d"))
    return groups.where("n > 1 and (r < n or d < n)").select("template_id", "name")
