"""Template authoring: checks and defaults for what a designer saves; driver-side, since a template is small."""

from __future__ import annotations

from dataclasses import replace

from paperloom.functions.scalars import key_pattern
from paperloom.schema import ColumnSpec, FieldSpec, StepSpec, TemplateSpec

ROLES = {"FIRST": "FIRST", "CONTINUATION": "CONTINUATION", "CONT": "CONTINUATION", "LAST": "LAST"}
# The characters that a zone's hint allows.
HINTS = {"NUMERIC": "0123456789๐๑๒๓๔๕๖๗๘๙.,-", "DATE": "0123456789๐๑๒๓๔๕๖๗๘๙/.-", "INT": "0123456789๐๑๒๓๔๕๖๗๘๙"}


def reflow(columns: tuple[ColumnSpec, ...]) -> tuple[ColumnSpec, ...]:
    """Columns of equal width over 0..1."""
    n = len(columns)
    return tuple(replace(c, x_start=i / n, x_end=(i + 1) / n) for i, c in enumerate(columns))


def copy_columns(first: FieldSpec, other: FieldSpec) -> FieldSpec:
    """The first region's columns on another region; line offsets are a region's own and are not copied."""
    return replace(other, columns=tuple(replace(c, line_offset=0) for c in first.columns))


def zone_hint(hint: str | None, mode: int = 0) -> tuple[str | None, int]:
    """Character whitelist and segmentation mode of a hint: an explicit mode above 0 wins, else a single line (7)."""
    return HINTS.get((hint or "").strip().upper()), mode if mode > 0 else 7


def saved_role(role: str | None) -> str | None:
    return ROLES.get((role or "").strip().upper())


def template_errors(name: str, document_type: str | None, types: set[str], sample: int | None, samples: set[int]) -> list[str]:
    """What keeps a template from being created."""
    errors = []
    if not (name or "").strip():
        errors.append("name is required")
    if document_type not in types:
        errors.append("document type is unknown")
    if sample is not None and sample not in samples:
        errors.append("sample is unknown")
    return errors


def region_errors(template: TemplateSpec) -> list[str]:
    """Tables that several regions feed need a role on each, all different."""
    groups: dict[str, list[str | None]] = {}
    for f in template.fields:
        if f.source_type == "TABLE_CELL":
            groups.setdefault(f.target_property.strip().lower(), []).append(saved_role(f.page_role))
    return [name for name, roles in groups.items() if len(roles) > 1 and (None in roles or len(set(roles)) < len(roles))]


def is_multi_page(template: TemplateSpec) -> bool:
    return any((f.page_role or "").strip() for f in template.fields)


def saved_fields(rows: list[dict]) -> tuple[FieldSpec, ...]:
    """Designer rows to fields: unnamed rows go, a blank type is STRING, a sort order of 0 is the ordinal."""
    out = []
    for row in rows:
        name = (row.get("target_property") or "").strip()
        if not name:
            continue
        columns = tuple(
            ColumnSpec(c["sub_property"].strip(), (c.get("data_type") or "STRING").strip().upper(), (c.get("table_header") or "").strip() or None, c.get("sort_order") or i, c.get("x_start"), c.get("x_end"), bool(c.get("is_anchor")), line_offset=int(c.get("line_offset") or 0))
            for i, c in enumerate(row.get("columns") or ())
            if (c.get("sub_property") or "").strip()
        )
        steps = tuple(StepSpec(s["kind"], s.get("config") or {}, i + 1) for i, s in enumerate(row.get("steps") or ()))
        out.append(FieldSpec(row.get("field_id") or len(out) + 1, name, row.get("source_type") or ("TABLE_CELL" if columns else "KEY_VALUE"), (row.get("data_type") or "STRING").strip().upper(), row.get("key_pattern"), columns=columns, steps=steps, page_role=saved_role(row.get("page_role"))))
    return tuple(out)


def visual_save(template: TemplateSpec, rows: list[dict]) -> tuple[TemplateSpec, int]:
    """The template after a designer's partial save, and how many rows were saved.

    Fields that no row names stay as they are.  A new field (no id) gets its binding; a known one gets it only where
    ``binding_changed`` is set, else its name, type, duty and threshold alone.  The key pattern comes from the key that
    was clicked, never from the row.  Columns are replaced only where ``columns_changed`` is set; steps always stay.
    """
    blank = lambda text: (text or "").strip() or None
    fields = {f.field_id: f for f in template.fields}
    saved = 0
    for row in rows:
        name = blank(row.get("target_property"))
        if not name:
            continue
        saved += 1
        number = row.get("field_id") or 0
        fresh = number <= 0
        if fresh:
            number = max(fields, default=0) + 1
        elif number not in fields:
            continue
        old = fields.get(number) or FieldSpec(number, name)
        new = replace(old, target_property=name, data_type=row.get("data_type") or old.data_type, required=bool(row.get("required")), min_confidence=row.get("min_confidence", old.min_confidence))
        if fresh or row.get("binding_changed"):
            kind, clicked = row.get("source_type") or "KEY_VALUE", blank(row.get("binding_key"))
            new = replace(
                new, source_type=kind, key_pattern=key_pattern(clicked) if kind == "KEY_VALUE" and clicked else None, regex=None,
                table_header=blank(row.get("table_header")), row_selector=blank(row.get("row_selector")), default_value=blank(row.get("default_value")),
            )
        if row.get("columns_changed"):
            named = [c for c in row.get("columns") or () if blank(c.get("sub_property"))]
            new = replace(new, columns=tuple(ColumnSpec(c["sub_property"].strip(), c.get("data_type") or "STRING", blank(c.get("table_header")), c.get("sort_order") or i) for i, c in enumerate(named)))
        fields[number] = new
    return replace(template, fields=tuple(fields.values())), saved


def anchor_column(columns: tuple[ColumnSpec, ...]) -> ColumnSpec | None:
    """The first anchor, else the first column."""
    return next((c for c in columns if c.is_anchor), columns[0] if columns else None)


def consolidates(template_id: int, listed: tuple[int, ...] = (12,)) -> bool:
    """Consolidation is on for listed templates only."""
    return template_id in listed


def detection_note(separators: list[float], has_sample: bool, zone_width: float) -> str:
    if not has_sample:
        return "no sample document"
    if zone_width <= 0:
        return "the zone is empty"
    return f"{len(separators) + 1} columns" if separators else "no columns found"
