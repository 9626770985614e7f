"""Transformer steps: a registry of Column -> Column functions folded in step order.

``register`` adds a step of one's own; a step of an unknown type is skipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.normalize import is_blank, trimmed
from paperloom.schema import StepSpec

Step = Callable[[Column, dict], Column]
REGISTRY: dict[str, Step] = {}
#: Formats tried in turn when a date step has no list of its own; month-first where both readings exist.
DATE_FORMATS = (
    "yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "M/d/yy", "yyyy-MM-dd HH:mm[:ss]", "yyyy-MM-dd'T'HH:mm[:ss][.SSS][XXX]", "M/d/yyyy H:mm[:ss]", "M/d/yyyy h:mm[:ss] a",
)


def register(name: str) -> Callable[[Step], Step]:
    def add(step: Step) -> Step:
        REGISTRY[name.lower()] = step
        return step

    return add


def apply_steps(value: Column, steps: Iterable[StepSpec]) -> Column:
    active = sorted((s for s in steps if s.active), key=lambda s: s.order)
    return reduce(lambda v, s: REGISTRY[s.kind.lower()](v, s.config) if s.kind.lower() in REGISTRY else v, active, value)


def parse_steps(text: str) -> list[StepSpec]:
    """Lines ``type|{json}`` to steps; broken JSON counts as no configuration."""
    steps = []
    for order, line in enumerate(line.strip() for line in (text or "").splitlines() if line.strip()):
        kind, _, config = line.partition("|")
        try:
            parsed = json.loads(config) if config.strip() else {}
        except ValueError:
            parsed = {}
        steps.append(StepSpec(kind.strip(), parsed if isinstance(parsed, dict) else {}, order + 1))
    return steps


def format_steps(steps: Iterable[StepSpec]) -> str:
    return "\n".join(f"{s.kind}|{json.dumps(s.config)}" if s.config else s.kind for s in sorted(steps, key=lambda s: s.order))


@register("trim")
def _trim(v: Column, config: dict) -> Column:
    return trimmed(v)


def title_case(v: Column) -> Column:
    """Words begin at a letter and go on through letters, marks, digits and apostrophes; all else separates them."""
    parts = F.regexp_extract_all(F.lower(v), F.lit(r"(\p{L}[\p{L}\p{M}\p{N}']*|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), "")


@register("case")
def _case(v: Column, config: dict) -> Column:
    mode = config.get("mode")
    if mode == "upper":
        return F.upper(v)
    if mode == "lower":
        return F.lower(v)
    if mode == "title":
        return title_case(v)
    return v


@register("regex_replace")
def _regex_replace(v: Column, config: dict) -> Column:
    pattern = config.get("pattern")
    replacement = (config.get("replacement") or "").replace("\\", "\\\\")  # a backslash is no escape in a replacement
    return F.regexp_replace(v, pattern, replacement) if pattern is not None else v


def cleaned_number(v: Column) -> Column:
    """The number in a text; digits of other scripts stay and so do not parse, and a sign may stand before or after it."""
    kept = F.regexp_replace(F.regexp_replace(v, r"[^\p{Nd}.\-]", ""), r"^([^-]+)-$", "-$1")
    return F.when(kept.rlike(r"^-?[0-9.]+$"), kept.try_cast("decimal(38,10)"))


@register("number_clean")
def _number_clean(v: Column, config: dict) -> Column:
    """The number as text with fixed decimals; what does not parse stays."""
    return F.coalesce(cleaned_number(v).cast(f"decimal(38,{int(config.get('decimals', 2))})").cast("string"), v)


def parsed_date(v: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """The day by the first format that fits; years of two digits end at 2049."""
    def one(pattern):
        day = F.try_to_date(trimmed(v), pattern)
        short = "yy" in pattern and "yyyy" not in pattern
        return F.when(F.year(day) > 2049, F.add_months(day, -1200)).otherwise(day) if short else day

    return F.coalesce(*[one(f) for f in formats])


@register("date_normalize")
def _date_normalize(v: Column, config: dict) -> Column:
    wanted = str(config.get("format") or "yyyy-MM-dd")
    return F.coalesce(F.date_format(parsed_date(v, config.get("formats", DATE_FORMATS)), wanted), v)


@register("default")
def _default(v: Column, config: dict) -> Column:
    return F.when(is_blank(v), F.lit(config.get("value"))).otherwise(v)


@register("ai_summary")
def _summary(v: Column, config: dict) -> Column:
    most = int(config.get("maxChars", 120))
    cut = F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…"))).otherwise(v)
    return F.when(is_blank(v), v).otherwise(F.concat(F.lit("[summary] "), cut))


@register("translate")
def _translate(v: Column, config: dict) -> Column:
    return F.concat(F.lit(f"[{config.get('to') or 'en'}] "), v)
