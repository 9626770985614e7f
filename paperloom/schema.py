"""Template specifications: the small, driver-side half of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class ColumnSpec:
    """A sub-column of a table field."""

    sub_property: str
    data_type: str = "STRING"
    table_header: str | None = None
    sort_order: int = 0
    x_start: float | None = None
    x_end: float | None = None
    is_anchor: bool = False
    line_select: str = "ALL"
    line_picks: tuple[int, ...] = ()
    line_separator: str = " "
    line_offset: int = 0


@dataclass(frozen=True)
class StepSpec:
    """A transformer step: its type and JSON configuration."""

    kind: str
    config: dict = field(default_factory=dict)
    order: int = 0
    active: bool = True


@dataclass(frozen=True)
class FieldSpec:
    """A mapped field: a projected column and its access path."""

    field_id: int
    target_property: str
    source_type: str = "KEY_VALUE"
    data_type: str = "STRING"
    key_pattern: str | None = None
    regex: str | None = None
    table_header: str | None = None
    row_selector: str | None = None
    default_value: str | None = None
    required: bool = False
    min_confidence: Decimal = Decimal("0.60")
    columns: tuple[ColumnSpec, ...] = ()
    steps: tuple[StepSpec, ...] = ()
    page_role: str | None = None
    zone: tuple[float, float, float, float] | None = None  # x, y, width, height on the page, in 0..1


@dataclass(frozen=True)
class TemplateSpec:
    template_id: int
    fields: tuple[FieldSpec, ...]
    mode: str = "OCR_FIRST"
    document_type: str | None = None
