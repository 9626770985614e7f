"""Word geometry over layouts that hold the hard cases, with SQL that segments and reads on its own.

Every order is a zone.  Rows stand on a pitch of 100 units; some follow the row before closely, leaders have lines above,
quantities are split into tokens that overlap enough to be one or too little, specks stand in the anchor column, and
lines below may belong to the half of the next row.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import tables as T
from paperloom.plans import invoices as I
from paperloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query
KEYS, ANCHOR, COLUMN, SAMPLES = ["doc_id"], (0.04, 0.12), (0.15, 0.6), 60


def hard_words(spark, sf):
    rows = I.lines(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    k, r, high = F.col("l_orderkey"), F.col("row_idx"), (F.col("n") + 1) * 100
    base, follows, q = (r - 1) * 100, (r > 1) & ((k + r) % 4 == 0), F.col("l_quantity").cast("int")
    at = base + F.when(follows, -20).otherwise(60)

    def word(i, text, x, top, wide, tall=8):
        return F.struct((r * 10 + i).cast("bigint").alias("word_id"), text.cast("string").alias("text"), F.lit(x).alias("x"), (top / high).alias("y"), F.lit(wide).alias("w"), (F.lit(tall) / high).alias("h"))

    items = F.array(
        F.when(k % 5 != 0, word(0, q, 0.06, at, 0.03)).otherwise(word(0, F.floor(q / 10), 0.05, at, 0.02)), F.when(k % 5 == 0, word(1, q % 10, 0.075, at + F.when(k % 2 == 0, 2).otherwise(5), 0.02)),
        word(2, F.concat(F.lit("Part "), F.col("l_partkey")), 0.2, at, 0.3), F.when(~follows, word(3, F.lit("note"), 0.2, base + 35, 0.1)), F.when(~follows, word(4, F.concat(F.lit("S"), F.col("l_suppkey")), 0.32, base + 35, 0.2)),
        F.when(~follows & (k % 3 != 0), word(5, F.concat(F.lit("ref "), F.col("l_partkey")), 0.2, base + 20, 0.2)), F.when(r % 2 == 0, word(6, F.concat(F.lit("size "), F.col("l_linenumber")), 0.2, at + 12, 0.2)),
        F.when(k % 7 == 0, word(7, F.lit("|"), 0.07, base + 10, 0.01, 2)),
    )
    return rows.select(k.alias("doc_id"), F.explode(items).alias("b")).where("b is not null").select("doc_id", "b.*")


HARD_WORDS_SQL = (
    I.LINES_SQL
    + """, sized AS (
  SELECT *, l_orderkey AS k, row_idx AS r, (count(*) OVER (PARTITION BY l_orderkey) + 1) * 100 AS high, (row_idx - 1) * 100 AS base, row_idx > 1 AND (l_orderkey + row_idx) % 4 = 0 AS follows, CAST(l_quantity AS INTEGER) AS q FROM numbered
), placed AS (SELECT *, base + CASE WHEN follows THEN -20 ELSE 60 END AS spot FROM sized
), words AS (
  SELECT k AS doc_id, CAST(r * 10 + i AS BIGINT) AS word_id, text, CAST(x AS DOUBLE) AS x, top / high AS y, CAST(w AS DOUBLE) AS w, tall / high AS h FROM (
    SELECT k, r, high, 0 AS i, CASE WHEN k % 5 <> 0 THEN CAST(q AS VARCHAR) ELSE CAST(q // 10 AS VARCHAR) END AS text, CASE WHEN k % 5 <> 0 THEN 0.06 ELSE 0.05 END AS x, spot AS top, CASE WHEN k % 5 <> 0 THEN 0.03 ELSE 0.02 END AS w, 8 AS tall FROM placed
    UNION ALL SELECT k, r, high, 1, CAST(q % 10 AS VARCHAR), 0.075, spot + CASE WHEN k % 2 = 0 THEN 2 ELSE 5 END, 0.02, 8 FROM placed WHERE k % 5 = 0 UNION ALL SELECT k, r, high, 2, 'Part ' || l_partkey, 0.2, spot, 0.3, 8 FROM placed
    UNION ALL SELECT k, r, high, 3, 'note', 0.2, base + 35, 0.1, 8 FROM placed WHERE NOT follows UNION ALL SELECT k, r, high, 4, 'S' || l_suppkey, 0.32, base + 35, 0.2, 8 FROM placed WHERE NOT follows
    UNION ALL SELECT k, r, high, 5, 'ref ' || l_partkey, 0.2, base + 20, 0.2, 8 FROM placed WHERE NOT follows AND k % 3 <> 0 UNION ALL SELECT k, r, high, 6, 'size ' || l_linenumber, 0.2, spot + 12, 0.2, 8 FROM placed WHERE r % 2 = 0
    UNION ALL SELECT k, r, high, 7, '|', 0.07, base + 10, 0.01, 2 FROM placed WHERE k % 7 = 0)
), boxes AS (
  SELECT *, x + w / 2 AS xc, y + h / 2 AS yc, y + h AS bottom FROM words
)"""
)
#: Anchors in order, merged one after the other.
CLUSTERS_SQL = (
    HARD_WORDS_SQL
    + """, tall AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY yc, y, bottom, h) AS nth FROM boxes b JOIN (SELECT doc_id, median(h) AS mid FROM boxes WHERE h > 0 GROUP BY 1) m USING (doc_id) WHERE xc BETWEEN 0.04 AND 0.12 AND h >= 0.4 * mid
), fold AS (
  SELECT doc_id, nth, 1 AS band, y AS top, bottom FROM tall WHERE nth = 1
  UNION ALL SELECT t.doc_id, t.nth, CASE WHEN j THEN band ELSE band + 1 END, CASE WHEN j THEN least(f.top, t.y) ELSE t.y END, CASE WHEN j THEN greatest(f.bottom, t.bottom) ELSE t.bottom END
  FROM (SELECT t.*, f.band AS band, f.top, f.bottom AS fb, least(f.bottom, t.bottom) - greatest(f.top, t.y) > 0 AND (least(f.bottom, t.bottom) - greatest(f.top, t.y)) / least(f.bottom - f.top, t.h) >= 0.5 AS j FROM fold f JOIN tall t ON t.doc_id = f.doc_id AND t.nth = f.nth + 1) t,
    LATERAL (SELECT t.top AS top, t.fb AS bottom) f
), clusters AS (
  SELECT doc_id, band, min(top) AS top, max(bottom) AS bottom FROM fold GROUP BY 1, 2
), near AS (
  SELECT *, lag(bottom) OVER o AS pb, lead(top) OVER o AS nt FROM clusters WINDOW o AS (PARTITION BY doc_id ORDER BY band)
)"""
)
HARD_BANDS_SQL = (
    CLUSTERS_SQL
    + """, bands AS (
  SELECT doc_id, band, top, bottom, CASE WHEN pb IS NULL THEN CAST(0 AS DOUBLE) ELSE greatest(0, least(1, (pb + top) / 2)) END AS y_start,
    CASE WHEN nt IS NULL THEN CAST(1 AS DOUBLE) ELSE greatest(0, least(1, greatest((bottom + nt) / 2, CASE WHEN pb IS NULL THEN 0 ELSE (pb + top) / 2 END))) END AS y_end FROM near
)"""
)


def _bands(words):
    return T.segment_rows(words, KEYS, *ANCHOR)


def _zones(spark, sf):
    return T.zones(hard_words(spark, sf), KEYS, *ANCHOR)


@query("segment_hard_rows", f"WITH RECURSIVE {HARD_BANDS_SQL} SELECT doc_id, CAST(band AS INTEGER) AS band, round(y_start, 9) AS y_start, round(y_end, 9) AS y_end, round(top, 9) AS top, round(bottom, 9) AS bottom FROM bands")
def segment_hard_rows(spark, sf):
    rounded = [F.round(c, 9).alias(c) for c in ("y_start", "y_end", "top", "bottom")]
    return _bands(hard_words(spark, sf)).select("doc_id", "band", *rounded)


_INK = f""", rows_of AS (
  SELECT doc_id, unnest(range(0, {SAMPLES})) AS k FROM (SELECT DISTINCT doc_id FROM words)
), ink AS (
  SELECT r.doc_id, r.k, coalesce(sum(CAST(round_even(w.w * 1000, 0) AS BIGINT)), 0) AS ink FROM rows_of r LEFT JOIN words w ON w.doc_id = r.doc_id AND r.k >= greatest(0, floor(w.y * {SAMPLES})) AND r.k < least({SAMPLES}, ceil((w.y + w.h) * {SAMPLES})) GROUP BY 1, 2
)"""


@query("ink_profile", f"WITH {HARD_WORDS_SQL}{_INK} SELECT doc_id, string_agg(CAST(ink AS VARCHAR), ',' ORDER BY k) AS profile FROM ink GROUP BY doc_id")
def ink_profile(spark, sf):
    return T.ink_profile(hard_words(spark, sf), KEYS, SAMPLES).select("doc_id", F.array_join(F.transform("profile", lambda p: p.cast("string")), ",").alias("profile"))


_LAST = SAMPLES - 1


@query(
    "boundary_ink_snap",
    f"""WITH RECURSIVE {CLUSTERS_SQL}{_INK}, gaps AS (
      SELECT doc_id, band, bottom, nt, least({_LAST}, greatest(0, CAST(floor(least(bottom, nt) * {_LAST}) AS BIGINT))) AS a, least({_LAST}, greatest(0, CAST(ceil(greatest(bottom, nt) * {_LAST}) AS BIGINT))) AS b FROM near WHERE nt IS NOT NULL
    ), least_ink AS (
      SELECT g.doc_id, g.band, i.k, i.ink = min(i.ink) OVER (PARTITION BY g.doc_id, g.band) AS low FROM gaps g JOIN ink i ON i.doc_id = g.doc_id AND i.k BETWEEN g.a AND g.b
    ), runs AS (
      SELECT doc_id, band, min(k) AS start, count(*) AS len FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, band ORDER BY k) AS island FROM least_ink WHERE low) GROUP BY doc_id, band, island
    ), best AS (
      SELECT doc_id, band, arg_min({{'s': start, 'l': len}}, {{'n': -len, 's': start}}) AS r FROM runs GROUP BY 1, 2
    )
    SELECT g.doc_id, CAST(g.band AS INTEGER) AS band, round(CASE WHEN bottom = nt OR b <= a THEN (bottom + nt) / 2 ELSE (r.s + (r.l - 1) / 2) / {_LAST} END, 9) AS y_end FROM gaps g JOIN best USING (doc_id, band)""",
)
def boundary_ink_snap(spark, sf):
    """Boundaries between rows in the longest run without ink, by profiles of the documents' own words."""
    rows = T.segment_rows(hard_words(spark, sf), KEYS, *ANCHOR, samples=SAMPLES)
    # a band never ends before it starts: what is compared is the boundary itself, the next band's start
    following = F.lead("y_start").over(Window.partitionBy(*KEYS).orderBy("band"))
    return rows.select("doc_id", "band", F.round(following, 9).alias("y_end")).where("y_end is not null")


_MARKS = """, inside AS (
  SELECT a.doc_id, a.band, min(b.y) AS top, max(b.bottom) AS bottom FROM bands a LEFT JOIN boxes b ON b.doc_id = a.doc_id AND b.xc BETWEEN 0.04 AND 0.12 AND b.yc BETWEEN a.y_start AND a.y_end GROUP BY 1, 2
), marks AS (
  SELECT *, lag(centre) OVER o AS before, lead(centre) OVER o AS after FROM (SELECT *, (top + bottom) / 2 AS centre FROM inside) WINDOW o AS (PARTITION BY doc_id ORDER BY band)
), line_height AS (
  SELECT doc_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS lh FROM boxes GROUP BY doc_id
), own AS (
  SELECT m.*, before IS NOT NULL AND lh > 0 AND centre - before < 3.0 * lh AS follower FROM marks m JOIN line_height USING (doc_id) WHERE centre IS NOT NULL
)"""


@query("anchor_follower", f"WITH RECURSIVE {HARD_BANDS_SQL}{_MARKS} SELECT doc_id, count(*) AS anchors, count(*) FILTER (follower) AS followers FROM own GROUP BY doc_id")
def anchor_follower(spark, sf):
    """How many anchors stand closer than three line heights to the one before."""
    found = _zones(spark, sf).select("doc_id", F.inline(T.anchors_in(F.col("w"), F.col("bands"), *ANCHOR)))
    close = F.col("centre") - F.col("before") < T.FOLLOWER_LINES * F.col("line_height")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("anchors"), F.count_if(close).alias("followers"))


def _anchored(name, offset):
    side = "yc < o.top AND yc > coalesce((before + centre) / 2, 0)" if offset < 0 else "yc > o.bottom AND yc < coalesce((centre + after) / 2, 1)"
    wanted = f"line = last + {offset} + 1" if offset < 0 else f"line = {offset}"

    @query(
        name,
        f"""WITH RECURSIVE {HARD_BANDS_SQL}{_MARKS}, side AS (
          SELECT o.doc_id, o.band, b.word_id, b.text, b.x, b.y, b.yc, b.xc, b.bottom, CASE WHEN b.y > max(b.bottom) OVER (PARTITION BY o.doc_id, o.band ORDER BY b.yc, b.x, b.word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
          FROM own o JOIN boxes b ON b.doc_id = o.doc_id AND NOT follower AND {side}
        ), lined AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, band ORDER BY yc, x, word_id) + 1 AS line FROM side
        ), ended AS (SELECT *, max(line) OVER (PARTITION BY doc_id, band) AS last FROM lined
        ), picked AS (SELECT *, CASE WHEN y > max(bottom) OVER (PARTITION BY doc_id, band ORDER BY yc, x, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS again FROM ended WHERE {wanted} AND xc BETWEEN 0.15 AND 0.6
        ), parts AS (SELECT *, sum(again) OVER (PARTITION BY doc_id, band ORDER BY yc, x, word_id) AS part FROM picked)
        SELECT o.doc_id, CAST(o.band AS INTEGER) AS band, coalesce((SELECT string_agg(text, ' ' ORDER BY part, x, word_id) FROM parts p WHERE p.doc_id = o.doc_id AND p.band = o.band), '') AS text FROM own o""",
    )
    def run(spark, sf):
        found = T.anchors_in(F.col("w"), F.col("bands"), *ANCHOR)
        return _zones(spark, sf).select("doc_id", F.inline(T.anchored_in(F.col("w"), found, *COLUMN, offset)))


_anchored("anchor_offset_above", -1)
_anchored("anchor_offset_further_above", -2)
_anchored("anchor_offset_under", 1)
_anchored("anchor_offset_past", 2)
