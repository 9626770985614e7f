from paperloom.operators import authoring as A
from paperloom.schema import ColumnSpec, FieldSpec, TemplateSpec


def test_saved_fields_and_columns():
    rows = [{"target_property": " "}, {"target_property": "items", "page_role": "cont", "columns": [{"sub_property": "q", "data_type": "int"}, {"sub_property": " "}, {"sub_property": "d", "line_offset": -2}]}]
    (field,) = A.saved_fields(rows)
    assert field.source_type == "TABLE_CELL" and field.page_role == "CONTINUATION" and [c.sub_property for c in field.columns] == ["q", "d"] and field.columns[1].line_offset == -2
    assert A.copy_columns(field, FieldSpec(2, "items")).columns[1].line_offset == 0
    assert [(c.x_start, c.x_end) for c in A.reflow(field.columns)] == [(0.0, 0.5), (0.5, 1.0)]
    assert A.anchor_column(field.columns).sub_property == "q" and A.anchor_column((*field.columns, ColumnSpec("z", is_anchor=True))).sub_property == "z" and A.anchor_column(()) is None


def test_checks():
    pair = lambda a, b: TemplateSpec(1, (FieldSpec(1, "Items", "TABLE_CELL", page_role=a), FieldSpec(2, " items ", "TABLE_CELL", page_role=b)))
    assert A.region_errors(pair("FIRST", "LAST")) == [] and A.region_errors(pair("FIRST", "FIRST")) and A.region_errors(pair("FIRST", None))
    assert A.is_multi_page(pair("FIRST", None)) and not A.is_multi_page(pair(None, " "))
    assert A.template_errors(" ", "x", {"y"}, 3, {4}) == ["name is required", "document type is unknown", "sample is unknown"] and not A.template_errors("n", "y", {"y"}, None, set())
    assert A.zone_hint("date") == ("0123456789๐๑๒๓๔๕๖๗๘๙/.-", 7) and A.zone_hint(None, 6) == (None, 6) and A.consolidates(12) and not A.consolidates(1)
    assert A.detection_note([0.5], True, 0.3) == "2 columns" and A.detection_note([], False, 1) == "no sample document"


def test_visual_save_changes_only_what_was_sent():
    """A known field without a new binding keeps key, header and columns; a bound one is derived from the clicked key."""
    step = A.StepSpec("trim")
    old = TemplateSpec(1, (FieldSpec(1, "no", key_pattern="^A$", table_header="h", columns=(ColumnSpec("q"),), steps=(step,)), FieldSpec(2, "total", regex="x"), FieldSpec(4, "untouched", key_pattern="^U$")))
    rows = [
        {"field_id": 1, "target_property": " number ", "data_type": "INT", "required": True, "binding_key": "ignored"},
        {"field_id": 2, "target_property": "total", "source_type": "KEY_VALUE", "binding_key": " Total (USD) ", "binding_changed": True, "table_header": " "},
        {"target_property": "items", "source_type": "TABLE_CELL", "binding_key": "x", "columns_changed": True, "columns": [{"sub_property": " "}, {"sub_property": " d ", "sort_order": 3}]},
        {"field_id": 9, "target_property": "gone"}, {"field_id": 1, "target_property": " "},
    ]
    new, saved = A.visual_save(old, rows)
    one, two, four, fresh = new.fields
    assert saved == 4 and (one.target_property, one.data_type, one.required, one.key_pattern, one.table_header, one.columns, one.steps) == ("number", "INT", True, "^A$", "h", (ColumnSpec("q"),), (step,))
    assert two.key_pattern == r"^Total\ \(USD\)$" and two.regex is None and two.table_header is None and four == old.fields[2]
    assert (fresh.field_id, fresh.source_type, fresh.key_pattern) == (5, "TABLE_CELL", None) and [(c.sub_property, c.sort_order) for c in fresh.columns] == [("d", 3)]
