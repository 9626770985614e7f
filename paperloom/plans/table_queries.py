"""Queries of table reconstruction and multi-page assembly over rendered word boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import multipage as P
from paperloom.operators import tables as T
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query
KEYS = ["doc_id"]
ANCHOR = (0.04, 0.12)
COLUMNS = [("qty", 0.04, 0.12), ("description", 0.15, 0.6), ("amount", 0.8, 1.0)]
D = "CAST({} AS DOUBLE)"
BANDS_SQL = f"""{I.WORDS_SQL}, boxes AS (
  SELECT *, x + w / 2 AS xc, y + h / 2 AS yc, y + h AS bottom FROM words
), anchor AS (
  SELECT doc_id, CAST(row_number() OVER o AS INTEGER) AS band, y AS top, bottom, lag(bottom) OVER o AS pb, lead(y) OVER o AS nt FROM boxes WHERE xc BETWEEN 0.04 AND 0.12 WINDOW o AS (PARTITION BY doc_id ORDER BY yc)
), bands AS (
  SELECT doc_id, band, top, bottom, CASE WHEN pb IS NULL THEN CAST(0 AS DOUBLE) ELSE (pb + top) / 2 END AS y_start, CASE WHEN nt IS NULL THEN CAST(1 AS DOUBLE) ELSE (bottom + nt) / 2 END AS y_end FROM anchor
)"""
CELLED_SQL = f"""{BANDS_SQL}, celled AS (
  SELECT b.*, c.col, a.band FROM boxes b JOIN (VALUES ('qty', 0.04, 0.12), ('description', 0.15, 0.6), ('amount', 0.8, 1.0)) c(col, a, z) ON b.xc BETWEEN c.a AND c.z JOIN bands a ON a.doc_id = b.doc_id AND b.yc BETWEEN a.y_start AND a.y_end
)"""


def bands_of(words):
    return T.segment_rows(words, KEYS, *ANCHOR)


def zones_of(spark, sf):
    return T.zones(I.words(spark, sf), KEYS, *ANCHOR)


@query("segment_rows", f"WITH {BANDS_SQL} SELECT doc_id, band, y_start, y_end FROM bands")
def segment_rows(spark, sf):
    return bands_of(I.words(spark, sf)).select("doc_id", "band", "y_start", "y_end")


@query("assign_cells", f"WITH {CELLED_SQL} SELECT doc_id, band, col AS column_name, count(*) AS words FROM celled GROUP BY 1, 2, 3")
def assign_cells(spark, sf):
    placed = T.cell_words(zones_of(spark, sf), KEYS, COLUMNS)
    return placed.groupBy("doc_id", "band", F.col("column").alias("column_name")).agg(F.count(F.lit(1)).alias("words"))


@query("cell_texts", f"WITH {CELLED_SQL} SELECT doc_id, band, col AS column_name, string_agg(text, chr(10) ORDER BY yc, x) AS text FROM celled GROUP BY 1, 2, 3")
def cell_texts(spark, sf):
    cells = zones_of(spark, sf).select("doc_id", F.inline(T.cells_in(F.col("w"), F.col("bands"), COLUMNS)))
    return cells.select("doc_id", "band", F.col("column").alias("column_name"), F.array_join(T.texts_in(F.col("words")), "\n").alias("text"))


_LINES = f"""{I.WORDS_SQL}, boxes AS (SELECT *, y + h / 2 AS yc, y + h AS bottom FROM words), flagged AS (
  SELECT *, CASE WHEN y > max(bottom) OVER (PARTITION BY doc_id ORDER BY yc, x, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM boxes
), lined AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY yc, x, word_id) + 1 AS line FROM flagged)"""


@query("words_to_lines", f"WITH {_LINES} SELECT doc_id, CAST(line AS BIGINT) AS line, string_agg(text, ' ' ORDER BY x, word_id) AS text FROM lined GROUP BY 1, 2")
def words_to_lines(spark, sf):
    return T.line_texts(T.centred(I.words(spark, sf)), KEYS).select("doc_id", "line", "text")


@query(
    "reading_order",
    f"""WITH {I.WORDS_SQL}, boxes AS (SELECT *, y + h / 2 AS yc FROM words), j AS (SELECT *, CASE WHEN abs(yc - lag(yc) OVER (PARTITION BY doc_id ORDER BY yc, word_id)) > h / 2 THEN 1 ELSE 0 END AS fresh FROM boxes),
    l AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY yc, word_id) AS line FROM j), t AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY x, word_id) AS text FROM l GROUP BY 1, 2)
    SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY line)) AS text_md5 FROM t GROUP BY doc_id""",
)
def reading_order(spark, sf):
    return T.reading_order(I.words(spark, sf), KEYS).select("doc_id", F.md5("text").alias("text_md5"))


def _anchored(name, offset, sql):
    @query(name, f"WITH {BANDS_SQL}, cnt AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM numbered GROUP BY 1) SELECT a.doc_id, a.band, {sql} AS text FROM bands a JOIN cnt USING (doc_id) LEFT JOIN numbered r ON r.l_orderkey = a.doc_id AND r.row_idx = a.band LEFT JOIN numbered q ON q.l_orderkey = a.doc_id AND q.row_idx = a.band - 1")
    def run(spark, sf):
        found = T.anchors_in(F.col("w"), F.col("bands"), *ANCHOR)
        return zones_of(spark, sf).select("doc_id", F.inline(T.anchored_in(F.col("w"), found, 0.15, 0.6, offset)))


# in the rendered layout a wrapped second line follows even rows at 0.3 of the row pitch below the anchor's centre
_anchored("anchor_line", 0, "CASE WHEN a.band > cnt.n THEN 'FCA FACTORY' ELSE 'Part ' || r.l_partkey END")
_anchored("anchor_offset_below", 1, "CASE WHEN a.band <= cnt.n AND a.band % 2 = 0 THEN 'size ' || r.l_suppkey ELSE '' END")


_SPLIT = r"[trim(s) FOR s IN string_split(text, chr(10)) IF trim(s) <> '']"


def _line_select(name, mode, picks, sql):
    @query(name, f"WITH l AS (SELECT doc_id, {_SPLIT} AS lines FROM documents) SELECT doc_id, md5({sql}) AS text_md5 FROM l")
    def run(spark, sf):
        return I.table(spark, sf, "documents").select("doc_id", F.md5(T.select_lines(F.col("text"), mode, picks, "|")).alias("text_md5"))


_line_select("line_select_all", "ALL", (), "array_to_string(lines, '|')")
_line_select("line_select_first", "first", (), "coalesce(lines[1], '')")
_line_select("line_select_pick", "PICK", (1, 3), "CASE WHEN len(lines) >= 4 THEN lines[2] || '|' || lines[4] WHEN len(lines) >= 2 THEN lines[2] ELSE array_to_string(lines, '|') END")

_CONS = f"""WITH {BANDS_SQL}, f AS (SELECT a.doc_id, a.band, c.n, a.band > c.n AS footer, CASE WHEN a.band > c.n THEN c.q ELSE CAST(r.l_quantity AS INTEGER) END AS qty FROM bands a
  JOIN (SELECT l_orderkey AS doc_id, count(*) AS n, sum(CAST(l_quantity AS INTEGER)) AS q FROM numbered GROUP BY 1) c USING (doc_id) LEFT JOIN numbered r ON r.l_orderkey = a.doc_id AND r.row_idx = a.band)"""


@query("consolidate_rows", f"{_CONS} SELECT doc_id, count(*) FILTER (NOT footer) AS kept, count(*) FILTER (footer) AS dropped FROM f GROUP BY doc_id")
def consolidate_rows(spark, sf):
    rows = zones_of(spark, sf).select("doc_id", F.inline(T.consolidated_in(F.col("w"), F.col("bands"), *ANCHOR)))
    return rows.groupBy("doc_id").agg(F.count_if(~F.col("footer")).alias("kept"), F.count_if("footer").alias("dropped"))


@query("running_sum_corroboration", f"{_CONS} SELECT doc_id, band, CAST(qty AS BIGINT) AS qty, footer AS corroborated FROM f")
def running_sum_corroboration(spark, sf):
    rows = zones_of(spark, sf).select("doc_id", F.inline(T.consolidated_in(F.col("w"), F.col("bands"), *ANCHOR)))
    return rows.select("doc_id", "band", "qty", "corroborated")


@query("clean_lines", f"WITH l AS (SELECT doc_id, {_SPLIT} AS lines FROM documents) SELECT doc_id, len([s FOR s IN lines IF NOT (starts_with(lower(s), 'the') OR contains(lower(s), 'tion'))]) AS kept FROM l")
def clean_lines(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.size(T.clean_lines(F.col("text"), ("The",), ("TION",))).cast("bigint").alias("kept"))


@query(
    "detect_columns",
    f"""WITH {I.WORDS_SQL}, e AS (SELECT doc_id % 50 AS grp, x AS l, x + w AS r FROM words), g AS (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY grp ORDER BY l, r) > 0.02 THEN 1 ELSE 0 END AS fresh, count(*) OVER (PARTITION BY grp) AS n FROM e),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY l, r) AS c FROM g), s AS (SELECT grp, c, avg(l) AS start, count(*) AS m, max(n) AS n FROM k GROUP BY 1, 2),
    t AS (SELECT grp, start, lead(start) OVER (PARTITION BY grp ORDER BY start) AS nxt, row_number() OVER (PARTITION BY grp ORDER BY start) AS col FROM s WHERE m >= greatest(4, round_even(n * 0.04, 0))),
    u AS (SELECT t.grp, t.col, t.start, t.nxt, median(CASE WHEN e.r > t.start AND e.r <= t.nxt THEN e.r END) AS fin FROM t LEFT JOIN e ON e.grp = t.grp AND e.l >= t.start - 0.02 AND e.l < t.nxt - 0.02 WHERE t.nxt IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT grp, CAST(col AS INTEGER) AS col, round((coalesce(fin, (start + nxt) / 2) + nxt) / 2, 9) AS separator FROM u""",
)
def detect_columns(spark, sf):
    cells = I.words(spark, sf).select((F.col("doc_id") % 50).alias("grp"), F.col("x").alias("left"), (F.col("x") + F.col("w")).alias("right"))
    return T.detect_columns(cells, ["grp"]).select("grp", F.col("column").alias("col"), F.round("separator", 9).alias("separator"))


@query("reflow_columns", "SELECT p_partkey, CAST(unnest(range(0, p_size % 5 + 1)) AS INTEGER) AS k, p_size % 5 + 1 AS n FROM part")
def reflow_columns(spark, sf):
    """Contiguous columns from equally spaced separators, some of them too near to keep."""
    n = F.col("p_size") % 5 + 1
    near = F.transform(F.sequence(F.lit(1), n), lambda k: k / n)
    separators = F.concat(F.filter(near, lambda s: s < 1), F.filter(F.transform(near, lambda s: s + 0.001), lambda s: s < 1))
    columns = I.table(spark, sf, "part").select("p_partkey", n.alias("n"), T.contiguous_columns(separators).alias("c"))
    return columns.select("p_partkey", F.posexplode("c").alias("k", "_"), "n").select("p_partkey", "k", "n")


@query(
    "page_roles",
    f"""WITH {I.PAGES_SQL} SELECT doc_id, page, CASE WHEN page = 1 THEN 'FIRST' WHEN page = pages THEN 'LAST' ELSE 'CONTINUATION' END AS primary_role, page = pages AS is_last, page > 1 AND page < pages AS is_middle FROM inv_pages""",
)
def page_roles(spark, sf):
    page, pages = F.col("page"), F.col("pages")
    return I.pages(spark, sf).select("doc_id", "page", P.primary_role(page, pages).alias("primary_role"), P.has_role(page, pages, F.lit("LAST")).alias("is_last"), P.has_role(page, pages, F.lit("CONTINUATION")).alias("is_middle"))


@query(
    "table_role_pick",
    f"""WITH {I.PAGES_SQL} SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN 'FIRST' WHEN doc_id % 3 = 1 THEN CASE WHEN page = 1 THEN 'FIRST' ELSE 'CONTINUATION' END
      ELSE CASE WHEN pages = 1 THEN 'LAST' WHEN page = 1 THEN NULL WHEN page = pages THEN 'LAST' ELSE 'CONTINUATION' END END AS role, CASE WHEN pages >= 3 THEN 2 END AS middle_page FROM inv_pages""",
)
def table_role_pick(spark, sf):
    third = F.col("doc_id") % 3
    available = F.when(third == 0, F.array(F.lit("FIRST"))).when(third == 1, F.array(F.lit("FIRST"), F.lit("CONTINUATION"))).otherwise(F.array(F.lit("CONTINUATION"), F.lit("LAST")))
    return I.pages(spark, sf).select("doc_id", "page", P.region_role(F.col("page"), F.col("pages"), available).alias("role"), P.scalar_page(F.lit("CONTINUATION"), F.col("pages")).alias("middle_page"))


@query(
    "column_structure_resolve",
    """WITH n AS (SELECT p_partkey, p_size % 4 AS canonical, p_size % 3 + 1 AS own FROM part), r AS (SELECT *, unnest(range(1, own + 1)) AS ordinal FROM n)
    SELECT p_partkey, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN own = canonical THEN 'c' || ordinal ELSE 'r' || ordinal END AS sub_property, CASE WHEN own = canonical THEN 'INT' ELSE 'STRING' END AS data_type,
      CASE WHEN own = canonical THEN ordinal = 1 ELSE FALSE END AS is_anchor, CAST(CASE WHEN own = canonical THEN ordinal ELSE 0 END AS INTEGER) AS line_offset, CAST(ordinal AS DOUBLE) / 10 AS x_start, canonical > 0 AND own <> canonical AS mismatch FROM r""",
)
def column_structure_resolve(spark, sf):
    """Canonical structures of 0 to 3 columns on regions of 1 to 3: equal counts merge, other counts mismatch, none imposes nothing."""
    parts, k = I.table(spark, sf, "part"), F.col("k")
    def columns(n, prefix, kind, anchor, offset):
        rows = parts.select("p_partkey", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("k"))
        return rows.select("p_partkey", F.concat(F.lit(prefix), k).alias("sub_property"), F.lit(kind).alias("data_type"), anchor.alias("is_anchor"), offset.cast("int").alias("line_offset"), k.alias("sort_order"), (k / 10).alias("x_start"))

    canonical = columns((F.col("p_size") % 4).cast("int"), "c", "INT", k == 1, k).drop("x_start")
    region = columns((F.col("p_size") % 3 + 1).cast("int"), "r", "STRING", F.lit(False), F.lit(0))
    return P.resolve_structure(canonical, region, "p_partkey").select("p_partkey", "ordinal", "sub_property", "data_type", "is_anchor", "line_offset", "x_start", "mismatch")


@query(
    "multipage_concat",
    f"""WITH {I.LINES_SQL}, p AS (SELECT l_orderkey AS doc_id, (row_idx - 1) // 5 + 1 AS page, count(*) AS n_rows, CAST((l_orderkey + (row_idx - 1) // 5) % 40 + 60 AS DECIMAL(10,0)) / 100 AS conf FROM numbered GROUP BY 1, 2, 4)
    SELECT doc_id, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_pages, CAST(round_even(CAST(sum(CAST(conf AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS DOUBLE) AS confidence FROM p GROUP BY doc_id""",
)
def multipage_concat(spark, sf):
    page = F.expr("cast(div(row_idx - 1, 5) + 1 as int)")
    rows = I.lines(spark, sf).groupBy(F.col("l_orderkey").alias("doc_id"), page.alias("page")).agg(F.count(F.lit(1)).alias("n_rows"))
    rows = rows.withColumn("confidence", (((F.col("doc_id") + F.col("page") - 1) % 40 + 60).cast("decimal(10,0)") / 100).cast("decimal(5,4)"))
    return P.concatenate(rows).withColumn("confidence", F.col("confidence").cast("double"))


@query("page_runs", f"WITH {I.LINES_SQL} SELECT l_orderkey AS doc_id, CAST((row_idx - 1) // 5 + 1 AS BIGINT) AS page, min(row_idx) - 1 AS first, count(*) AS n FROM numbered GROUP BY 1, 2")
def page_runs(spark, sf):
    rows = I.lines(spark, sf).select(F.col("l_orderkey").alias("doc_id"), "row_idx", F.expr("div(row_idx - 1, 5) + 1").alias("page"))
    return P.page_runs(rows, "doc_id", "row_idx", "page")


@query(
    "cell_assembly",
    f"""WITH {CELLED_SQL}, w AS (SELECT doc_id, band, col, string_agg(text, ' ' ORDER BY yc, x) AS text, max(word_id % 40 + 60) / CAST(100 AS DOUBLE) AS conf FROM celled GROUP BY 1, 2, 3)
    SELECT doc_id, band, col AS column_name, CASE WHEN band % 2 = 0 AND col = 'qty' THEN 'read ' || band ELSE text END AS text, CASE WHEN band % 2 = 0 AND col = 'qty' THEN CAST(0.99 AS DOUBLE) ELSE conf END AS confidence FROM w""",
)
def cell_assembly(spark, sf):
    zones = zones_of(spark, sf)
    cells = zones.select("doc_id", F.inline(T.cells_in(F.col("w"), F.col("bands"), COLUMNS)))
    confidence = F.array_max(F.transform("words", lambda w: w["word_id"] % 40 + 60)) / 100
    inside = cells.select("doc_id", "band", "column", F.array_join(T.texts_in(F.col("words")), "\n").alias("text"), confidence.alias("confidence"))
    found = zones.select("doc_id", F.inline("bands"))
    text = F.when(F.col("band") % 2 == 0, F.concat(F.lit(" \nread "), F.col("band"))).otherwise(F.lit(" \n"))
    read = found.select("doc_id", "band", F.lit("qty").alias("column"), text.alias("text"), F.lit(0.99).alias("confidence"))
    return T.assemble_cells(read, inside, KEYS).withColumnRenamed("column", "column_name")


@query(
    "pixel_columns",
    f"""WITH {I.WORDS_SQL}, j AS (SELECT *, CAST((x + doc_id % 7 * CAST(0.004 AS DOUBLE)) * 1000 AS DOUBLE) AS px, CAST(w * 1000 AS DOUBLE) AS pw FROM words WHERE word_id <> 4 AND doc_id % 11 <> 0), e AS (SELECT doc_id % 50 AS grp, px / 1000 AS l, (px + pw) / 1000 AS r FROM j),
    g AS (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY grp ORDER BY l, r) > 0.02 THEN 1 ELSE 0 END AS fresh, count(*) OVER (PARTITION BY grp) AS n FROM e),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY l, r) AS c FROM g), s AS (SELECT grp, c, avg(l) AS start, count(*) AS m, max(n) AS n FROM k GROUP BY 1, 2),
    t AS (SELECT grp, start, lead(start) OVER (PARTITION BY grp ORDER BY start) AS nxt, row_number() OVER (PARTITION BY grp ORDER BY start) AS col FROM s WHERE m >= greatest(4, round_even(n * 0.04, 0))),
    u AS (SELECT t.grp, t.col, t.start, t.nxt, median(CASE WHEN e.r > t.start AND e.r <= t.nxt THEN e.r END) AS fin FROM t LEFT JOIN e ON e.grp = t.grp AND e.l >= t.start - 0.02 AND e.l < t.nxt - 0.02 WHERE t.nxt IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT grp, CAST(col AS INTEGER) AS col, round(0.1 + (coalesce(fin, (start + nxt) / 2) + nxt) / 2 * 0.8, 6) AS separator FROM u""",
)
def pixel_columns(spark, sf):
    """Separators of boxes in crops of 1000 x 500 pixels at 0.1 + 0.8 of the page, shifted by document; malformed boxes are skipped."""
    left, wide = (F.col("x") + F.col("doc_id") % 7 * 0.004) * 1000, F.col("w") * 1000
    box = F.when(F.col("word_id") == 4, F.array(F.lit(1.0))).when(F.col("doc_id") % 11 == 0, F.array(left + wide, F.lit(0.0), left, F.lit(10.0))).otherwise(F.array(left, F.lit(0.0), left + wide, F.lit(10.0)))
    cells = I.words(spark, sf).select((F.col("doc_id") % 50).alias("grp"), box.alias("box"))
    found = T.pixel_columns(cells, ["grp"], 1000.0, 500.0, 0.1, 0.8)
    return found.select("grp", F.col("column").alias("col"), F.round("separator", 6).alias("separator"))