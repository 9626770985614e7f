"""Scalar rules of capture, review and template authoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.normalize import arabic_digits, trimmed


def confidence_band(confidence: Column, cutoff: float = 0.60) -> Column:
    """Low below the cutoff or without confidence, High from half the way to one, else Medium."""
    high = cutoff + (1 - cutoff) / 2
    return F.when(confidence.isNull() | (confidence < cutoff), "Low").when(confidence >= high, "High").otherwise("Medium")


def junk_anchor(value: Column, data_type: Column) -> Column:
    """A numeric anchor without a digit."""
    return F.upper(data_type).isin("INT", "DECIMAL") & ~F.coalesce(arabic_digits(value).rlike("[0-9]"), F.lit(False))


#: Labels of pipeline stages in failure messages; another stage is its own label.
STAGE_LABELS = {"CLASSIFY": "Classification", "EXTRACT": "Extraction", "MAP": "Mapping"}


def failure_message(stage: Column | str, message: Column, most: int = 200) -> Column:
    """``Mapping failed: reason``: the first line of the reason, whichever way lines end, cut to the most characters."""
    stage = stage if isinstance(stage, Column) else F.lit(stage)
    label = stage
    for name, text in STAGE_LABELS.items():
        label = F.when(stage == name, text).otherwise(label)
    return F.concat(label, F.lit(" failed: "), F.left(F.substring_index(F.translate(message, "\r", "\n"), "\n", 1), F.lit(most)))


def block_anchor(source_ref: Column) -> Column:
    """``TextBlock:n`` as ``block-n``; anything else is null."""
    found = F.regexp_extract(source_ref, "^TextBlock:([0-9]+)$", 1)
    return F.when(found != "", F.concat(F.lit("block-"), found))


def percent(confidence: Column) -> Column:
    return F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit("%"))


def zone_pixels(x, y, w, h, width, height) -> Column:
    """Zone in 0..1 to struct(left, top, width, height) in pixels: each rounded half-even, clamped, one pixel at least."""
    left, top = (F.greatest(F.lit(0), F.least(F.rint(a * b), b - 1)).cast("int") for a, b in ((x, width), (y, height)))
    wide, high = (F.greatest(F.lit(1), F.least(F.rint(s * b), b - a)).cast("int") for s, b, a in ((w, width, left), (h, height, top)))
    none = (width <= 0) | (height <= 0)
    parts = {"left": F.when(none, 0).otherwise(left), "top": F.when(none, 0).otherwise(top), "width": F.when(none, 1).otherwise(wide), "height": F.when(none, 1).otherwise(high)}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def cell_pixels(zone: Column, x_start, x_end, y_start, y_end) -> Column:
    """A cell of a zone (struct of left, top, width, height in pixels) from its column and band in 0..1, inside the zone."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    def side(low, high, start, length):
        a, b = unit(F.least(low, high)), unit(F.greatest(low, high))
        at = (start + F.rint(a * length)).cast("int")
        size = F.greatest(F.lit(1), F.rint((b - a) * length).cast("int"))
        return at, F.greatest(F.lit(1), F.least(size, start + length - at)).cast("int")

    left, wide = side(x_start, x_end, zone["left"], zone["width"])
    top, high = side(y_start, y_end, zone["top"], zone["height"])
    return F.struct(left.alias("left"), top.alias("top"), wide.alias("width"), high.alias("height"))


def page_to_zone_x(x, zone_x, zone_w) -> Column:
    return F.when(zone_w <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - zone_x) / zone_w)))


def crop_to_page_x(x, zone_x, zone_w) -> Column:
    return zone_x + x * zone_w


def batch_route(pages: Column, limit: int, bucket: Column) -> Column:
    return F.when(pages <= limit, "online").when(F.coalesce(bucket, F.lit("")) != "", "batch").otherwise("error")


def polygon_box(points: Column) -> Column:
    """struct(x0, y0, x1, y1) of an array of struct(x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def anchored_text(text: Column, segments: Column) -> Column:
    """The concatenated [start, end) segments of a text; invalid segments are skipped."""
    good = F.filter(segments, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))
    return F.array_join(F.transform(good, lambda s: F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))), "")


def target_size(width, height, dpi, wanted_dpi: int = 300, min_width: int = 1000, cap: int = 12_000) -> Column:
    """Factor to enlarge an image: by its resolution if that is known, else to the least width; never below 1, or past the cap."""
    by_dpi, by_width = F.lit(float(wanted_dpi)) / dpi, F.lit(float(min_width)) / width
    factor = F.greatest(F.lit(1.0), F.when(dpi >= 1, by_dpi).otherwise(by_width))
    return F.greatest(F.lit(1.0), F.least(factor, F.lit(float(cap)) / F.greatest(width, height)))


def enlarged(width, height, factor: Column) -> Column:
    """struct(width, height) of an image enlarged by the factor: whole pixels, one at least."""
    sides = [F.greatest(F.rint(side * factor).cast("int"), F.lit(1)) for side in (width, height)]
    return F.struct(sides[0].alias("width"), sides[1].alias("height"))


def dots_per_inch(density: Column, unit: Column) -> Column:
    """Resolution from metadata; a unit that is no length says nothing (0)."""
    unit = F.lower(unit)
    return F.when(unit == "pixelspercentimeter", density * 2.54).when(unit == "pixelspermeter", density * 0.0254).when(unit == "pixelsperinch", density).otherwise(F.lit(0.0))


def source_type(block_type: Column) -> Column:
    return F.when(F.upper(F.coalesce(block_type, F.lit(""))) == "TABLE_CELL", "TABLE_CELL").otherwise("KEY_VALUE")


def block_key(text: Column) -> Column:
    """What stands before the first colon, or all of it."""
    return trimmed(F.when(F.instr(text, ":") > 1, F.substring_index(text, ":", 1)).otherwise(text))


def key_pattern(label: str) -> str:
    """An anchored pattern that matches exactly this label."""
    return "^" + "".join("\\" + c if c in "\\.[]{}()*+-?^$|# " else c for c in label.strip()) + "$"


def pattern_label(pattern: str) -> str:
    """The label of such a pattern."""
    out, escaped = [], False
    for c in pattern.removeprefix("^").removesuffix("$"):
        if c == "\\" and not escaped:
            escaped = True
            continue
        out.append(c)
        escaped = False
    return "".join(out)
