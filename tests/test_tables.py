from decimal import Decimal

from pyspark.sql import functions as F

from paperloom.operators import multipage as P
from paperloom.operators import tables as T

WORDS = "doc_id bigint, word_id bigint, text string, x double, y double, w double, h double"


def words(spark, quantities, descriptions=()):
    rows = [(1, i, str(t), 0.35, y, 0.03, 0.04) for i, (t, y) in enumerate(quantities)] + [(1, 100 + i, "d", 0.05, y, 0.20, 0.04) for i, y in enumerate(descriptions)]
    return spark.createDataFrame(rows, WORDS)


def bands(spark, ys, descriptions=(), **more):
    return T.segment_rows(words(spark, [(1, y) for y in ys], descriptions), ["doc_id"], 0.30, 0.45, **more).orderBy("band").collect()


def test_bands(spark):
    got = bands(spark, [0.10, 0.30, 0.50])
    assert len(got) == 3 and got[0].y_start == 0 and got[-1].y_end == 1 and all(a.y_end == b.y_start for a, b in zip(got, got[1:]))
    assert len(bands(spark, [0.100, 0.150])) == 2 and len(bands(spark, [0.10, 0.105, 0.30])) == 2 and bands(spark, [], [0.1, 0.3]) == []
    wrapped = bands(spark, [0.10, 0.30, 0.50], [0.10, 0.155])
    assert wrapped[0].y_start <= 0.12 <= wrapped[0].y_end and wrapped[0].y_start <= 0.175 <= wrapped[0].y_end
    ink = F.array(*[F.lit(0 if 18 <= k <= 22 else 5) for k in range(41)])
    snapped = bands(spark, [0.20, 0.70], profile=ink)
    assert len(snapped) == 2 and abs(snapped[0].y_end - 0.5) < 1e-9


def test_edges_belong_to_both_cells(spark):
    df = spark.createDataFrame([(1, 1, "Edge", 0.45, 0.1, 0.08, 0.04), (1, 2, "7", 0.53, 0.1, 0.04, 0.04), (1, 3, "on", 0.48, 0.1, 0.04, 0.04)], WORDS)
    band = spark.createDataFrame([(1, 1, 0.0, 1.0)], "doc_id bigint, band int, y_start double, y_end double")
    got = {(r.text, r.column) for r in T.assign_cells(df, band, ["doc_id"], [("description", 0.0, 0.50), ("qty", 0.50, 0.65)]).collect()}
    assert got == {("Edge", "description"), ("7", "qty"), ("on", "description"), ("on", "qty")}


def test_line_selection_and_cleaning(spark):
    df = spark.createDataFrame([("Front and rear\nbrake cables\n \n",)], "s string")
    pick = lambda **k: df.select(T.select_lines(F.col("s"), **k)).first()[0]
    assert pick() == "Front and rear brake cables" and pick(mode="first") == "Front and rear" and pick(mode="PICK", picks=(1, 9)) == "brake cables" and pick(mode="PICK", picks=(7,)) == pick()
    lines = "AVIEXP 1\nContainer Number X\n245/45 ZR18 (100Y) XL TL PILOT SPORT 4 S MI\nPassenger Car Radial Tyre\nOur Reference 5\norigin : TH"
    assert spark.createDataFrame([(lines,)], "s string").select(T.clean_lines(F.col("s"))).first()[0] == ["245/45 ZR18 (100Y) XL TL PILOT SPORT 4 S MI"]


def test_consolidation(spark):
    quantities = [6, 14, 9, 57, 99, 2, 31, 6, 7, 11, 14, 1, 1, 12, 270]
    rows = [(1, i, str(q), 0.06, (i + 0.4) / 15, 0.03, 0.01) for i, q in enumerate(quantities)]
    rows += [(1, 100, "FCA FACTORY Freight Insurance Inland CIP PLACE OF DELIVERY", 0.2, 14.4 / 15, 0.4, 0.01)]
    df = spark.createDataFrame(rows, WORDS)
    got = T.consolidate(df, T.segment_rows(df, ["doc_id"], 0.04, 0.12), ["doc_id"], 0.04, 0.12).orderBy("band").collect()
    assert sum(not r.footer for r in got) == 14 and [r.band for r in got if r.footer and r.corroborated] == [15]
    few = words(spark, [(1, 0.1), (2, 0.3), (3, 0.5)])
    assert not any(r.footer for r in T.consolidate(few, T.segment_rows(few, ["doc_id"], 0.30, 0.45), ["doc_id"], 0.30, 0.45).collect())


def test_anchor_reads_stay_in_their_half(spark):
    h = 0.02
    rows = [(1, 1, "57", 0.06, 0.10, 0.03, h), (1, 2, "99", 0.06, 0.60, 0.03, h), (1, 3, "7", 0.06, 0.64, 0.03, h)]
    rows += [(1, 10 + k, f"m{k}", 0.3, 0.14 + 0.04 * k, 0.1, h) for k in range(3)] + [(1, 20 + k, f"n{k}", 0.3, 0.48 + 0.04 * k, 0.1, h) for k in range(3)] + [(1, 30, "line", 0.3, 0.60, 0.1, h)]
    df = spark.createDataFrame(rows, WORDS)
    found = T.anchors(df, T.segment_rows(df, ["doc_id"], 0.04, 0.12), ["doc_id"], 0.04, 0.12)
    read = lambda offset: [r.text for r in T.anchored_cell(df, found, ["doc_id"], 0.2, 0.6, offset).orderBy("band").collect()]
    assert read(0) == ["", "line", ""] and read(-1) == ["", "n2", ""] and read(-3) == ["", "n0", ""] and read(-4) == ["", "", ""]
    assert read(1)[0] == "m0" and read(3)[0] == "m2" and read(4)[0] == "" and read(1)[2] == ""


def test_columns(spark):
    grid = [(1, s, s + 0.10) for s in (0.02, 0.20, 0.38, 0.56, 0.74, 0.88) for _ in range(10)]
    two = [(2, 0.05, 0.25)] * 12 + [(2, 0.60, 0.90)] * 12 + [(2, 0.33, 0.35), (2, 0.45, 0.50)]
    one = [(3, 0.1, 0.3)] * 8
    df = spark.createDataFrame(grid + two + one, "zone int, left double, right double")
    got: dict = {}
    for r in T.detect_columns(df, ["zone"]).orderBy("zone", "column").collect():
        got.setdefault(r.zone, []).append(r.separator)
    assert len(got[1]) == 5 and all(abs(a - b) < 0.005 for a, b in zip(got[1], (0.16, 0.34, 0.52, 0.70, 0.86)))
    assert len(got[2]) == 1 and 0.25 < got[2][0] < 0.60 and 3 not in got
    cols = df.select(T.contiguous_columns(F.array(F.lit(0.5), F.lit(0.2), F.lit(0.502), F.lit(1.2))).alias("c")).first().c
    assert [(round(c.start, 3), round(c.end, 3)) for c in cols] == [(0.0, 0.2), (0.2, 0.5), (0.5, 0.995), (0.995, 1.0)]


def test_columns_of_zones_with_many_equal_edges_order_distinct_ones(spark):
    """Cells of equal edges are counted before they are shuffled; medians weigh them, with even and odd numbers."""
    cells = spark.range(3001).select(F.lit(1).alias("zone"), F.when(F.col("id") < 1000, 0.1).otherwise(0.6).alias("left"), F.when(F.col("id") < 500, 0.2).when(F.col("id") < 1000, 0.4).otherwise(0.9).alias("right"))
    found = T.detect_columns(cells, ["zone"])
    (got,) = found.collect()
    assert abs(got.separator - (0.3 + 0.6) / 2) < 1e-9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and plan.strip().splitlines()[-3].lstrip(" :+-").startswith("Aggregate")  # the cells' own aggregate comes first


def test_roles(spark):
    df = spark.range(1, 4).select(F.col("id").alias("p"))
    role = lambda n, have: [r[0] for r in df.where(F.col("p") <= n).orderBy("p").select(P.region_role(F.col("p"), F.lit(n), F.array(*map(F.lit, have)))).collect()]
    assert role(3, ["FIRST", "CONTINUATION", "LAST"]) == ["FIRST", "CONTINUATION", "LAST"] and role(3, ["FIRST", "CONTINUATION"]) == ["FIRST", "CONTINUATION", "CONTINUATION"]
    assert role(3, ["LAST"]) == [None, None, "LAST"] and role(1, ["LAST"]) == ["LAST"]
    pages = spark.createDataFrame([(1, i, p) for i, p in enumerate([1] * 5 + [2] * 5 + [3] * 2)], "doc_id int, i int, page int")
    assert sorted(tuple(r)[1:] for r in P.page_runs(pages, "doc_id", "i", "page").collect()) == [(1, 0, 5), (2, 5, 5), (3, 10, 2)]


def test_pixel_columns_are_the_separators_of_the_unit_boxes_on_the_page(spark):
    """Two columns whose gap is 0.25 to 0.60 of the crop; malformed, turned and empty boxes change nothing, nor does a crop without size give any."""
    boxes = [(1, [50.0, 0.0, 250.0, 9.0])] * 12 + [(1, [600.0, 0.0, 900.0, 9.0])] * 12 + [(1, [420.0]), (1, None), (1, [500.0, 0.0, 430.0, 9.0])]
    df = spark.createDataFrame(boxes, "zone int, box array<double>")
    unit = spark.createDataFrame([(1, 0.05, 0.25)] * 12 + [(1, 0.60, 0.90)] * 12, "zone int, left double, right double")
    (want,) = T.detect_columns(unit, ["zone"]).collect()
    (got,) = T.pixel_columns(df, ["zone"], 1000.0, 10.0, 0.1, 0.8).collect()
    assert got["column"] == want["column"] and abs(got.separator - (0.1 + 0.8 * want.separator)) < 1e-9 and 0.1 + 0.8 * 0.05 < got.separator <= 0.1 + 0.8 * 0.60
    assert T.pixel_columns(df, ["zone"], 0.0, 10.0, 0.1, 0.8).count() == 0


ZONE = (0.0, 0.0, 1.0, 1.0)
REGION_WORDS = "doc_id bigint, page int, field_id int, word_id bigint, text string, x double, y double, w double, h double, conf double"


def _zonal(spark, columns, words, pages, role=None, scalars=()):
    from paperloom.operators.zonal import multi_page, single_page
    from paperloom.schema import FieldSpec, TemplateSpec

    spec = TemplateSpec(1, (FieldSpec(1, "id", "ZONE", zone=ZONE, default_value="d"), FieldSpec(10, "line_item", "TABLE_CELL", required=True, zone=ZONE, page_role=role, columns=columns)))
    read = spark.createDataFrame(list(scalars), "doc_id bigint, field_id int, page int, raw string, confidence decimal(5,4)")
    given = spark.createDataFrame(words, REGION_WORDS)
    docs = spark.createDataFrame(pages, "doc_id bigint, pages int")
    one = {(r.doc_id, r.field_id): r for r in single_page(spec, read.drop("page"), given.drop("page"), documents=docs).collect()}
    two = {(r.doc_id, r.field_id): r for r in multi_page(spec, docs, read, given).collect()}
    return one, two


def test_regions_without_rows_and_documents_without_reads(spark):
    from paperloom.schema import ColumnSpec

    columns = (ColumnSpec("qty", "INT", x_start=0.0, x_end=0.2, is_anchor=True), ColumnSpec("d", x_start=0.2, x_end=1.0, sort_order=1))
    words = [(1, 1, 10, 1, "4", 0.05, 0.1, 0.05, 0.1, 0.9), (1, 1, 10, 2, "bolt", 0.3, 0.1, 0.1, 0.1, 0.7)]
    for got in _zonal(spark, columns, words, [(1, 1), (2, 1)], scalars=[(1, 1, 1, "A1", Decimal("0.8"))]):
        assert set(got) == {(1, 1), (1, 10), (2, 1), (2, 10)} and '"qty":4' in got[1, 10].normalized and got[1, 10].source_ref == "ZoneTable/rows:1"
        empty = got[2, 10]
        assert (empty.normalized, empty.confidence, empty.source_ref, empty.below) == (None, None, "ZoneTable/rows:0", False)
        assert (got[2, 1].normalized, got[2, 1].confidence) == ("d", 0)


def test_anchored_cells_count_the_words_that_were_read(spark):
    from paperloom.schema import ColumnSpec

    columns = (ColumnSpec("qty", "INT", x_start=0.0, x_end=0.2, is_anchor=True), ColumnSpec("ref", x_start=0.2, x_end=1.0, sort_order=1, line_select="ANCHOR", line_offset=1, line_separator="/"))
    words = [
        (1, 1, 10, 1, "4", 0.05, 0.10, 0.05, 0.04, 0.9), (1, 1, 10, 2, "spec", 0.3, 0.10, 0.1, 0.04, 0.5), (1, 1, 10, 3, "R1", 0.3, 0.16, 0.1, 0.04, 0.7), (1, 1, 10, 4, "more", 0.3, 0.22, 0.1, 0.04, 0.1),
        (1, 1, 10, 5, "5", 0.05, 0.60, 0.05, 0.04, 0.9),
    ]
    one, _ = _zonal(spark, columns, words, [(1, 1)])
    got = one[1, 10]
    assert got.normalized == '[{"qty":4,"ref":"R1"},{"qty":5,"ref":null}]'
    assert got.confidence == Decimal("0.8333")  # 0.9, 0.7 and 0.9: the words beside the one that was read do not count


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_what_is_derived_from_a_zone_shuffles_its_words_once(spark):
    """Words that are dealt by their zone are not shuffled again for bands, cells, anchors, footers or whole rows."""
    from paperloom.operators import zonal as Z
    from paperloom.plans.zonal_queries import COLUMNS

    dealt = spark.range(40).selectExpr("id div 4 as doc_id", "id as word_id", "'7' as text", "0.06 as x", "(id % 4) / 4 as y", "0.03 as w", "0.1 as h", "0.9 as conf")
    dealt = dealt.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "w", "h")}).repartition("doc_id")
    found = T.zones(dealt, ["doc_id"], 0.04, 0.12)
    cells = found.select("doc_id", F.inline(T.cells_in(F.col("w"), F.col("bands"), [("qty", 0.04, 0.12)])))
    anchored = found.select("doc_id", F.inline(T.anchored_in(F.col("w"), T.anchors_in(F.col("w"), F.col("bands"), 0.04, 0.12), 0.0, 1.0, 1)))
    rows = Z.table_rows(dealt, ["doc_id"], ZONE, list(COLUMNS), consolidate=True)
    assert [exchanges(df) for df in (cells, anchored, rows)] == [1, 1, 1]
    assert rows.count() == 40 and {r.qty for r in rows.collect()} == {"7"}


def test_profiles_join_once_a_zone(spark):
    """Bands that snap to the profile of a zone's own words are those of that profile given with each word, without a profile in every word."""
    rows = [(z, i, "1", x, (60.0 * i + 7 * z + d) / 600, 0.03 + d / 300, 0.02) for z in (1, 2, 3) for i in range(1, 8) for x, d in ((0.06, 0), (0.2, 13), (0.5, 13))]
    df = spark.createDataFrame(rows, "doc_id bigint, word_id bigint, text string, x double, y double, w double, h double").repartition("doc_id")
    given = T.segment_rows(df.join(T.ink_profile(df, ["doc_id"], 60), "doc_id"), ["doc_id"], 0.04, 0.12, profile=F.col("profile"))
    own = T.segment_rows(df, ["doc_id"], 0.04, 0.12, samples=60)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, given.collect())) and own.count() == 21
    assert own.where("band = 2").exceptAll(T.segment_rows(df, ["doc_id"], 0.04, 0.12).where("band = 2")).count() > 0
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_list(struct(yc")  # the words meet the profile as a zone
