"""Tables rebuilt from word boxes: row bands, cell assignment, lines, anchored reads and consolidation.

Words are rows (keys..., text, x, y, w, h, conf...) with boxes relative to their zone; ``keys`` name the zone.
Everything of a zone is grouped once by its keys; a zone's words are bounded by a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.normalize import bound, trimmed
from paperloom.operators.mapping import array_mean4

MERGE_OVERLAP, MIN_HEIGHT, SAME_LINE, FOLLOWER_LINES = 0.5, 0.4, 0.40, 3.0
# The lexicon of shipping invoices that consolidation goes by.
METADATA_PREFIXES = ("AVIEXP", "Warehouse", "JC Number", "UC Number", "Container Number", "Seal Number", "Our Reference", "Your Order", "Origin :", "Origin:")
METADATA_PHRASES = ("Passenger Car Radial Tyre", "Light Truck Tyre", "Michelin Brand", "B.F. Goodrich")
FOOTER_KEYWORDS = ("FCA FACTORY", "PLACE OF DELIVERY", "CIP ", "Freight", "Insurance", "Inland")


def centred(words: DataFrame) -> DataFrame:
    return words.withColumns({"xc": F.col("x") + F.col("w") / 2, "yc": F.col("y") + F.col("h") / 2, "bottom": F.col("y") + F.col("h")})


def boundary(low: Column, high: Column, profile: Column | None = None) -> Column:
    """Between two clusters: the middle, or the centre of the longest run of least ink in the gap."""
    middle = (low + high) / 2
    if profile is None:
        return middle
    last = F.size(profile) - 1
    a = F.greatest(F.lit(0), F.least(F.floor(F.least(low, high) * last).cast("int"), last))
    b = F.greatest(F.lit(0), F.least(F.ceil(F.greatest(low, high) * last).cast("int"), last))

    def centre(span, gap, least):
        marks = F.array_join(F.transform(gap, lambda ink: F.when(ink == least, "1").otherwise("0")), "")

        def longest(text):
            run = F.array_max(F.transform(F.split(text, "0"), F.length))
            return bound(run, lambda n: (span["a"] + F.instr(text, F.repeat(F.lit("1"), n)) - 1 + (n - 1) / 2) / last)

        return bound(marks, longest)

    def snapped(span):
        gap = F.slice(profile, span["a"] + 1, span["b"] - span["a"] + 1)
        found = bound(gap, lambda g: bound(F.array_min(g), lambda least: centre(span, g, least)))
        return F.when((last < 1) | (low == high) | (span["b"] <= span["a"]), middle).otherwise(found)

    return bound(F.struct(a.alias("a"), b.alias("b")), snapped)


def ink_profile(words: DataFrame, keys: list[str], samples: int, units: int = 1000) -> DataFrame:
    """keys, profile: the ink of each of a zone's sample rows, as the widths of the words that stand in it, in units of the zone's width.

    A sweep: every word adds its width at its first row and takes it back behind its last, and running sums of these
    differences are the levels between them.  One exchange, and no row for a sample.
    """
    first = F.greatest(F.lit(0), F.floor(F.col("y") * samples)).cast("int")
    behind = F.least(F.lit(samples), F.ceil((F.col("y") + F.col("h")) * samples)).cast("int")
    ink = F.rint(F.col("w") * units).cast("bigint")
    steps = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("ink")), F.struct(first.alias("at"), ink.alias("ink")), F.struct(behind.alias("at"), (-ink).alias("ink")))
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("ink")))
    rows = words.repartition(*keys).select(*keys, F.inline(F.when(behind > first, steps).otherwise(none)))
    levels = rows.groupBy(*keys, "at").agg(F.sum("ink").alias("ink"))
    along = Window.partitionBy(*keys).orderBy("at")
    levels = levels.select(*keys, "at", F.sum("ink").over(along).alias("level"), (F.coalesce(F.lead("at").over(along), F.lit(samples)) - F.col("at")).alias("n"))
    zones = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "level", "n"))).alias("l"))
    return zones.select(*keys, F.flatten(F.transform("l", lambda x: F.array_repeat(x["level"], x["n"]))).alias("profile"))


def nested(words: DataFrame, keys: list[str], **extra: Column) -> DataFrame:
    """keys, w: each zone's centred words as one array in order of their centres; ``extra`` are further aggregates of the zone.

    This is the only exchange of what is derived from a zone (the functions named ``..._in``); words that are already
    dealt by their zone need none.
    """
    rows = centred(words)
    first = [c for c in ("yc", "x", "word_id") if c in rows.columns]
    word = F.struct(*first, *[c for c in rows.columns if c not in (*keys, *first)])
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(word)).alias("w"), *[v.alias(k) for k, v in extra.items()])


def known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def zones(words: DataFrame, keys: list[str], x_start: float, x_end: float) -> DataFrame:
    """keys, w, bands: a row for each zone, with its words and the row bands that its anchors start."""
    found = nested(words, keys).where(known(keys))
    return found.select(*keys, "w", bands_in(F.col("w"), x_start, x_end).alias("bands"))


def _zones_of(words: DataFrame, marks: DataFrame, keys: list[str], name: str = "bands") -> DataFrame:
    """``zones`` with bands or anchors from a table of their own, in order."""
    columns = ["band", *[c for c in marks.columns if c not in (*keys, "band")]]
    return nested(words, keys).join(marks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)), keys)


def _middle(values: Column) -> Column:
    """The median of sorted values."""
    return (F.get(values, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(values, F.floor(F.size(values) / 2).cast("int"))) / 2


def bands_in(words: Column, x_start: float, x_end: float, profile: Column | None = None) -> Column:
    """The bands (band from 1, y_start, y_end, top, bottom) that a zone's anchor words start, tiling 0..1.

    Clusters grow as words merge into them, so they are a fold over the zone's anchors in vertical order.
    """
    none = F.array().cast("array<struct<top:double,bottom:double>>")

    def alone(w):
        return F.array(F.struct(w["top"].alias("top"), w["bottom"].alias("bottom")))

    def merge(acc, w):
        def beside(last):
            shared = F.least(last["bottom"], w["bottom"]) - F.greatest(last["top"], w["top"])
            smaller = F.least(last["bottom"] - last["top"], w["h"])
            joins = (shared > 0) & (smaller > 0) & (shared / smaller >= MERGE_OVERLAP)
            grown = F.struct(F.least(last["top"], w["top"]).alias("top"), F.greatest(last["bottom"], w["bottom"]).alias("bottom"))
            return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, alone(w)))

        return F.when(F.size(acc) == 0, alone(w)).otherwise(bound(F.element_at(acc, -1), beside))

    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    def banded(clusters):
        between = F.transform(F.slice(clusters, F.lit(2), F.size(clusters)), lambda c, i: boundary(F.get(clusters, i)["bottom"], c["top"], profile))

        def bands(edges):
            def band(c, i):
                start = F.when(i == 0, F.lit(0.0)).otherwise(F.get(edges, i - 1))
                end = F.when(i == F.size(clusters) - 1, F.lit(1.0)).otherwise(F.get(edges, i))
                ends = F.struct(start.alias("a"), end.alias("b"), i.alias("i"))
                return bound(ends, lambda e: F.struct((e["i"] + 1).alias("band"), clamp(e["a"]).alias("y_start"), clamp(F.greatest(e["b"], e["a"])).alias("y_end"), c["top"].alias("top"), c["bottom"].alias("bottom")))

            return F.transform(clusters, band)

        return bound(between, bands)

    def of(ws):
        box = lambda w: F.struct(w["yc"].alias("yc"), w["y"].alias("top"), w["bottom"].alias("bottom"), w["h"].alias("h"))
        anchors = F.sort_array(F.transform(F.filter(ws, lambda w: w["xc"].between(x_start, x_end)), box))
        heights = F.sort_array(F.filter(F.transform(ws, lambda w: w["h"]), lambda h: h > 0))
        least = F.coalesce(bound(heights, _middle), F.lit(0.0)) * MIN_HEIGHT
        tall = bound(least, lambda limit: F.filter(anchors, lambda w: w["h"] >= limit))
        return bound(F.aggregate(tall, none, merge), banded)

    return bound(words, of)


def segment_rows(words: DataFrame, keys: list[str], x_start: float, x_end: float, profile: Column | None = None, samples: int | None = None) -> DataFrame:
    """keys, band (from 1), y_start, y_end, top, bottom: the rows that anchor words start, tiling 0..1.

    Boundaries snap to a zone's ``profile``, or, with ``samples``, to that of its own words.
    """
    boxes = ["x", "y", "w", "h"]
    if profile is None:
        found = nested(words.select(*keys, *boxes), keys)
        if samples is None:
            return found.select(*keys, F.inline(bands_in(F.col("w"), x_start, x_end)))
        box = found.join(ink_profile(words, keys, samples), keys).withColumnRenamed("profile", "_ink")
        return box.select(*keys, F.inline(bound(F.col("_ink"), lambda ink: bands_in(F.col("w"), x_start, x_end, ink))))
    rows = words.select(*keys, *boxes, profile.alias("_ink"))
    box = centred(rows).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("yc", "x", "y", "w", "h", "xc", "bottom"))).alias("w"), F.first("_ink").alias("_ink"))
    return box.select(*keys, F.inline(bound(F.col("_ink"), lambda ink: bands_in(F.col("w"), x_start, x_end, ink))))


def _within(words: Column, band: Column) -> Column:
    """The words whose centres are in the band, its ends included: a word on an edge is in both bands."""
    return F.filter(words, lambda w: w["yc"].between(band["y_start"], band["y_end"]))


def _column(words: Column, a: float, b: float) -> Column:
    return F.filter(words, lambda w: w["xc"].between(a, b))


def cells_in(words: Column, bands: Column, columns: list[tuple[str, float, float]]) -> Column:
    """The cells (band, column, y_start, y_end, words) that hold words: centres inside band and column, ends included."""
    def of(ws):
        def cells(b):
            def split(inside):
                return F.array(*[F.struct(b["band"].alias("band"), F.lit(n).alias("column"), b["y_start"].alias("y_start"), b["y_end"].alias("y_end"), _column(inside, x0, x1).alias("words")) for n, x0, x1 in columns])

            return bound(_within(ws, b), split)

        return F.filter(F.flatten(F.transform(bands, cells)), lambda c: F.size(c["words"]) > 0)

    return bound(words, of)


def assign_cells(words: DataFrame, bands: DataFrame, keys: list[str], columns: list[tuple[str, float, float]]) -> DataFrame:
    """Words with band and column: centres inside both, ends included, so a word on an edge is in both cells."""
    return cell_words(_zones_of(words, bands, keys), keys, columns)


def cell_words(found: DataFrame, keys: list[str], columns: list[tuple[str, float, float]]) -> DataFrame:
    """``assign_cells`` of ``zones``."""
    cells = found.select(*keys, F.inline(cells_in(F.col("w"), F.col("bands"), columns)))
    return cells.select(*keys, "band", "column", "y_start", "y_end", F.inline("words"))


def lines_in(words: Column) -> Column:
    """The line (from 1) of each word, which come in order of centres: a word below everything before it starts one."""
    start = F.struct(F.lit(None).cast("double").alias("low"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(s, w):
        line = s["line"] + F.when(F.coalesce(w["y"] > s["low"], F.lit(True)), 1).otherwise(0)
        return bound(line, lambda n: F.struct(F.greatest(s["low"], w["bottom"]).alias("low"), n.alias("line"), F.concat(s["out"], F.array(n)).alias("out")))

    return F.aggregate(words, start, step, lambda s: s["out"])


def texts_in(words: Column) -> Column:
    """The texts of the lines of words, which come in order of centres, each from left to right."""
    def several(ws):
        def lines(at):
            entry = lambda w, i: F.struct(F.get(at, i).alias("line"), w["x"].alias("x"), w["word_id"].alias("word_id"), w["text"].alias("text"))
            one = lambda entries, n: F.array_join(F.transform(F.filter(entries, lambda e: e["line"] == n), lambda e: e["text"]), " ")
            return bound(F.sort_array(F.transform(ws, entry)), lambda entries: F.transform(F.sequence(F.lit(1), F.array_max(at)), lambda n: one(entries, n)))

        return bound(lines_in(ws), lines)

    def of(ws):
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).when(F.size(ws) == 1, F.array(F.coalesce(F.get(ws, F.lit(0))["text"], F.lit("")))).otherwise(several(ws))

    return bound(words, of)


def with_lines(words: DataFrame, keys: list[str], tie: str = "word_id") -> DataFrame:
    """Add the line (from 1): a word below everything before it, in order of centres, starts one."""
    over = Window.partitionBy(*keys).orderBy("yc", "x", tie)
    below = F.max("bottom").over(over.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("_new", F.coalesce((F.col("y") > below).cast("int"), F.lit(1))).withColumn("line", F.sum("_new").over(over)).drop("_new")


def line_texts(words: DataFrame, keys: list[str], tie: str = "word_id") -> DataFrame:
    """keys, line, text: each line's words from left to right."""
    rows = with_lines(words, keys, tie).groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("x", tie, "text"))).alias("w"))
    return rows.select(*keys, "line", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"))


def reading_order(words: DataFrame, keys: list[str], tie: str = "word_id") -> DataFrame:
    """keys, text: a line ends where centres jump by more than half a word's height."""
    over = Window.partitionBy(*keys).orderBy("yc", tie)
    jump = F.abs(F.col("yc") - F.lag("yc").over(over)) > F.col("h") / 2
    rows = centred(words).withColumn("line", F.sum(F.coalesce(jump.cast("int"), F.lit(1))).over(over))
    lines = rows.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("x", tie, "text"))).alias("w"))
    lines = lines.withColumn("text", F.array_join(F.transform("w", lambda w: w["text"]), " "))
    joined = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return joined.select(*keys, F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def cell_texts(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, column, text: a cell's lines joined by line feeds."""
    cell = [*keys, "band", "column"]
    rows = assigned.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("yc", "x", "word_id", "y", "bottom", "text"))).alias("words"))
    return rows.select(*cell, F.array_join(texts_in(F.col("words")), "\n").alias("text"))


def select_lines(text: Column, mode: str = "ALL", picks: tuple[int, ...] = (), separator: str = " ") -> Column:
    """The lines of a cell: ALL joined, the FIRST, or those PICKed from 0 (none of them there: ALL)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda s: s != "")
    if mode.strip().upper() == "FIRST":
        return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    chosen = F.filter(F.array(*[F.get(lines, F.lit(i)) for i in picks if i >= 0] or [F.lit(None).cast("string")]), lambda s: s.isNotNull())
    if mode.strip().upper() == "PICK":
        lines = F.when(F.size(chosen) > 0, chosen).otherwise(lines)
    return F.array_join(lines, separator)


def anchors_in(words: Column, bands: Column, x_start: float, x_end: float) -> Column:
    """band, top, bottom, centre of each band that has anchor words, with the neighbours' centres and the median line height."""
    def of(ws, own):
        def mark(b):
            def spanned(near):
                top, bottom = F.array_min(F.transform(near, lambda w: w["y"])), F.array_max(F.transform(near, lambda w: w["bottom"]))
                return bound(F.struct(top.alias("top"), bottom.alias("bottom")), lambda s: F.struct(b["band"].alias("band"), s["top"].alias("top"), s["bottom"].alias("bottom"), ((s["top"] + s["bottom"]) / 2).alias("centre")))

            return bound(_within(own, b), spanned)

        heights = F.sort_array(F.filter(F.transform(ws, lambda w: w["h"]), lambda h: h.isNotNull()))
        height = bound(heights, lambda hs: F.get(hs, F.floor(F.size(hs) / 2).cast("int")))

        def placed(marks):
            beside = lambda i: F.when(i >= 0, F.get(marks, i)["centre"])
            def full(tall):
                return F.transform(marks, lambda m, i: F.struct(m["band"].alias("band"), m["top"].alias("top"), m["bottom"].alias("bottom"), m["centre"].alias("centre"), beside(i - 1).alias("before"), beside(i + 1).alias("after"), tall.alias("line_height")))

            return bound(height, full)

        return F.filter(bound(F.transform(bands, mark), placed), lambda m: m["centre"].isNotNull())

    return bound(words, lambda ws: bound(_column(ws, x_start, x_end), lambda own: of(ws, own)))


def anchors(words: DataFrame, bands: DataFrame, keys: list[str], x_start: float, x_end: float) -> DataFrame:
    """keys, band, top, bottom, centre of each band's anchor words, with the neighbours' centres and the median line height."""
    return _zones_of(words, bands, keys).select(*keys, F.inline(anchors_in(F.col("w"), F.col("bands"), x_start, x_end)))


def anchored_in(words: Column, found: Column, x_start: float, x_end: float, offset: int, separator: str = " ", conf: bool = False) -> Column:
    """band, text, confidence (with ``conf``) of each anchor: its own line, or the Nth line above (-N) or below (+N) within its half of the gap.

    The confidence is the mean of the words that were read, wherever they stand; lines are put together by the separator.
    A follower (closer than three line heights to the anchor before) reads nothing, nor does an offset past the lines.
    """
    inside = lambda w: w["xc"].between(x_start, x_end)

    def own_line(ws, a):
        def hit(w):
            shared = F.least(a["bottom"], w["bottom"]) - F.greatest(a["top"], w["y"])
            smaller = F.least(a["bottom"] - a["top"], w["h"])
            return (w["y"] < a["bottom"]) & (w["bottom"] > a["top"]) & (smaller > 0) & (shared / smaller >= SAME_LINE)

        return F.filter(ws, hit)

    def other_line(ws, a):
        follower = F.coalesce((a["line_height"] > 0) & (a["centre"] - a["before"] < FOLLOWER_LINES * a["line_height"]), F.lit(False))
        if offset < 0:
            half, beside = F.coalesce((a["before"] + a["centre"]) / 2, F.lit(0.0)), lambda w, edge: (w["yc"] < a["top"]) & (w["yc"] > edge)
        else:
            half, beside = F.coalesce((a["centre"] + a["after"]) / 2, F.lit(1.0)), lambda w, edge: (w["yc"] > a["bottom"]) & (w["yc"] < edge)
        side = F.when(follower, F.slice(ws, 1, 0)).otherwise(bound(half, lambda edge: F.filter(ws, lambda w: beside(w, edge))))

        def wanted(near):  # lines are those of all columns
            def pick(at):
                line = F.array_max(at) + offset + 1 if offset < 0 else F.lit(offset)
                return bound(line, lambda n: F.filter(near, lambda w, i: (F.get(at, i) == n) & inside(w)))

            return F.when(F.size(near) == 0, near).otherwise(bound(lines_in(near), pick))

        return bound(side, wanted)

    def of(ws):
        def read(a):
            def made(picked):
                lines = F.filter(F.transform(texts_in(picked), trimmed), lambda s: s != "")
                text = F.when(F.size(picked) == 0, F.lit("")).otherwise(F.array_join(lines, separator))
                mean = [array_mean4(F.transform(picked, lambda w: w["conf"])).alias("confidence")] if conf else []
                return F.struct(a["band"].alias("band"), text.alias("text"), *mean)

            return bound(own_line(ws, a) if offset == 0 else other_line(ws, a), made)

        return F.transform(found, read)

    return bound(_column(words, x_start, x_end) if offset == 0 else words, of)


def anchored_cell(words: DataFrame, found: DataFrame, keys: list[str], x_start: float, x_end: float, offset: int, separator: str = " ") -> DataFrame:
    """keys, band, text, confidence (if words have ``conf``) of anchors, as ``anchored_in`` reads them."""
    zones = _zones_of(words, found, keys, "found")
    return zones.select(*keys, F.inline(anchored_in(F.col("w"), F.col("found"), x_start, x_end, offset, separator, "conf" in words.columns)))


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    return bound(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(n.lower())) for n in needles]))


def consolidated_in(words: Column, bands: Column, x_start: float, x_end: float, footers: tuple[str, ...] = FOOTER_KEYWORDS) -> Column:
    """band, text, qty, footer, corroborated of each band: footer bands go; a quantity equal to the sum kept above only corroborates."""
    def of(ws):
        def summed(b):
            def read(inside):
                ordered = F.sort_array(F.transform(_column(inside, x_start, x_end), lambda w: F.struct(w["x"].alias("x"), w["word_id"].alias("word_id"), w["text"].alias("text"))))
                quantity = F.array_join(F.transform(ordered, lambda w: F.regexp_replace(F.coalesce(w["text"], F.lit("")), r"[^\p{Nd}]", "")), "").try_cast("bigint")
                text = F.array_join(F.transform(inside, lambda w: w["text"]), " ")
                footer = has_any(text, footers)
                return F.struct(b["band"].alias("band"), F.when(F.size(inside) > 0, text).alias("text"), F.when(F.size(inside) > 0, quantity).alias("qty"), footer.alias("footer"))

            return bound(_within(ws, b), read)

        def above(rows):
            known = F.transform(rows, lambda r: F.when(~r["footer"], F.coalesce(r["qty"], F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
            start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
            sums = F.aggregate(known, start, lambda s, q: F.struct((s["sum"] + q).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])
            full = lambda r, before: F.struct(r["band"].alias("band"), r["text"].alias("text"), r["qty"].alias("qty"), r["footer"].alias("footer"), F.coalesce(r["footer"] & (r["qty"] == before), F.lit(False)).alias("corroborated"))
            return F.zip_with(rows, sums, full)

        return bound(F.transform(bands, summed), above)

    return bound(words, of)


def consolidate(words: DataFrame, bands: DataFrame, keys: list[str], x_start: float, x_end: float, footers: tuple[str, ...] = FOOTER_KEYWORDS) -> DataFrame:
    """keys, band, text, qty, footer, corroborated of bands, as ``consolidated_in`` tells them; a zone without words has no footers."""
    marks = bands.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("band", "y_start", "y_end"))).alias("bands"))
    return nested(words, keys).join(marks, keys, "right").select(*keys, F.inline(consolidated_in(F.col("w"), F.col("bands"), x_start, x_end, footers)))


def clean_lines(text: Column, prefixes: tuple[str, ...] = METADATA_PREFIXES, phrases: tuple[str, ...] = METADATA_PHRASES) -> Column:
    """The description lines that are neither blank nor shipping annotations."""
    def annotation(low):
        return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p.lower())) for p in prefixes] + [F.contains(low, F.lit(p.lower())) for p in phrases])

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda s: s != "")
    return F.filter(lines, lambda s: ~bound(F.lower(s), annotation))


def detect_columns(cells: DataFrame, keys: list[str], tolerance: float = 0.02, share: float = 0.04, floor: int = 4) -> DataFrame:
    """keys, column (from 1), separator: between columns that enough cells' left edges start.

    Left edges closer than the tolerance chain into clusters; a column ends at the median right edge of its cells.  Cells
    of equal edges are counted before they are shuffled, and only distinct edges are ordered.
    """
    zone = Window.partitionBy(*keys)
    along = zone.orderBy("left", "right")
    edges = cells.groupBy(*keys, "left", "right").agg(F.count(F.lit(1)).alias("n"))
    gap = F.coalesce((F.col("left") - F.lag("left").over(along) > tolerance).cast("int"), F.lit(1))
    rows = edges.withColumn("_n", F.sum("n").over(zone)).withColumn("_cluster", F.sum(gap).over(along))
    starts = rows.groupBy(*keys, "_cluster").agg((F.sum(F.col("left") * F.col("n")) / F.sum(F.when(F.col("left").isNotNull(), F.col("n")))).alias("start"), F.sum("n").alias("n"), F.max("_n").alias("_n"))
    starts = starts.where(F.col("n") >= F.greatest(F.lit(floor), F.rint(F.col("_n") * share)))
    order = zone.orderBy("start")
    starts = starts.select(*keys, "start", F.lead("start").over(order).alias("next"), F.row_number().over(order).alias("column")).where("next is not null")
    inside = (F.col("left") >= F.col("start") - tolerance) & (F.col("left") < F.col("next") - tolerance)
    own = starts.join(edges, keys).where(inside & (F.col("right") > F.col("start")) & (F.col("right") <= F.col("next")))
    ends = _medians(own, [*keys, "column"], "right").withColumnRenamed("right", "end")
    found = starts.join(ends, [*keys, "column"], "left")
    return found.select(*keys, "column", ((F.coalesce("end", (F.col("start") + F.col("next")) / 2) + F.col("next")) / 2).alias("separator"))


def _medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the median of values that occur ``n`` times: by ranks, so that no task holds a group's values at once."""
    each = rows.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    ranked = each.withColumn("_to", F.sum("n").over(Window.partitionBy(*keys).orderBy(value)))
    ranked = ranked.join(each.groupBy(*keys).agg(F.sum("n").alias("_all")), keys)
    holds = lambda at: F.max(F.when((F.col("_to") - F.col("n") <= at) & (at < F.col("_to")), F.col(value)))
    low, high = holds(F.expr("(_all - 1) div 2")), holds(F.expr("_all div 2"))
    return ranked.groupBy(*keys).agg(((low + high) / 2).alias(value))


def contiguous_columns(separators: Column, low: float = 0.0, high: float = 1.0, margin: float = 0.005, least: float = 0.004) -> Column:
    """Detected separators as contiguous struct(start, end): clamped inside, sorted, near ones dropped."""
    inside = F.array_sort(F.transform(separators, lambda s: F.greatest(F.lit(low + margin), F.least(F.lit(high - margin), s))))
    kept = F.filter(inside, lambda s, i: (i == 0) | (s - F.get(inside, i - 1) > least))
    starts, ends = F.concat(F.array(F.lit(low)), kept), F.concat(kept, F.array(F.lit(high)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def pixel_columns(cells: DataFrame, keys: list[str], width: float, height: float, zone_x: float, zone_w: float) -> DataFrame:
    """keys, column, separator on the page, of pixel boxes (array of four) in a crop; malformed boxes are skipped."""
    good = cells.where((F.size("box") == 4) & (F.get("box", F.lit(2)) > F.get("box", F.lit(0))) & F.lit(width > 0 and height > 0))
    unit = good.select(*keys, (F.get("box", F.lit(0)) / width).alias("left"), (F.get("box", F.lit(2)) / width).alias("right"))
    return detect_columns(unit, keys).withColumn("separator", zone_x + F.col("separator") * zone_w)


def assemble_cells(read: DataFrame, fallback: DataFrame, keys: list[str], mode: str = "ALL") -> DataFrame:
    """keys, band, column, text, confidence: the recognizer's read of a cell, or where that is empty its words.

    Both have (keys, band, column, text, confidence); an empty cell has no confidence.
    """
    cell = [*keys, "band", "column"]
    one = read.select(*cell, select_lines(F.col("text"), mode).alias("_read"), F.col("confidence").alias("_rc"))
    two = fallback.select(*cell, select_lines(F.col("text"), mode).alias("_words"), F.col("confidence").alias("_wc"))
    rows = one.join(two, cell, "full")
    use = F.coalesce(F.col("_read") != "", F.lit(False))
    text = F.when(use, F.col("_read")).otherwise(F.coalesce("_words", F.lit("")))
    return rows.select(*cell, text.alias("text"), F.when(text != "", F.when(use, F.col("_rc")).otherwise(F.col("_wc"))).alias("confidence"))
