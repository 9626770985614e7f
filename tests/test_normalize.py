import pytest
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.functions import scalars as S
from paperloom.operators import multipage as P


def one(spark, column, value, **more):
    row = {"s": value} | more
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("r")).first().r


def all_of(spark, make, pairs):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(pairs)], "i int, s string").select("i", make(F.col("s")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [want for _, want in pairs]


def test_digits_and_numbers(spark):
    all_of(spark, N.arabic_digits, [("๑๒๓", "123"), ("๐๙", "09"), ("INV-๒๐๒๖", "INV-2026"), ("abc", "abc")])
    all_of(spark, N.number_text, [
        ("145.00", "145.00"), ("12,840.00", "12840.00"), ("฿ ๒,๕๐๐.๗๕", "2500.75"), ("9.06", "9.06"), ("", None), ("abc", None), ("12-", "-12"), ("1.2.3", None), ("1-2", None), (".5", "0.5"),
        ("5.", "5"), ("US-001", "-1"), ("007", "7"), ("-0", "0"), (None, None), ("-", None),
    ])


def test_idempotent_digits(spark):
    texts = [("๑a๒", None), ("x", None), ("12๙", None)]
    rows = spark.createDataFrame(texts, "s string, t string").select(N.arabic_digits(F.col("s")).alias("a"), N.arabic_digits(N.arabic_digits(F.col("s"))).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_dates(spark):
    for text, order, want in [
        ("๒๖/๐๒/๒๕๖๒", "D", "2019-02-26"), ("11/02/2562", "D", "2019-02-11"), ("26/02/2019", "M", "2019-02-26"), ("11/02/2019", "M", "2019-11-02"), ("11/02/2019", None, "2019-02-11"),
        ("30/02/2019", None, None), ("70.23.22.57", None, None), ("1 - 2 - 49", None, "2049-02-01"), ("1.2.50", None, "1950-02-01"), ("พ.ศ. 1/2/62", None, None), ("no", None, None),
    ]:
        got = one(spark, N.date_text(F.col("s"), F.col("o")), text, o=order)
        assert got == (want if text[0] != "พ" else "1419-02-01"), text


@pytest.mark.parametrize(("texts", "want"), [(["11/02/2019", "26/02/2019"], "D"), (["02/26/2019"], "M"), (["01/02/2019", "03/04/2019"], None)])
def test_order_by_the_first_decisive_date(spark, texts, want):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").withColumn("v", N.date_order_vote(F.col("s")))
    assert df.where("v is not null").agg(F.min_by("v", "i").alias("v")).first().v == want


def test_dispatch_and_typed_values(spark):
    assert tuple(one(spark, N.normalized(F.col("s"), F.lit(None).cast("string")), "26/02/2019")) == ("2019-02-26", "Date")
    assert tuple(one(spark, N.normalized(F.col("s"), F.lit(None).cast("string")), "฿12,840.00")) == ("12840.00", "Number")
    assert tuple(one(spark, N.normalized(F.col("s"), F.lit(None).cast("string")), "abc")) == (None, "Text")
    for kind, text, want in [
        ("DECIMAL", "๑.๒.๓", "1.2.3"), ("INT", "๑.๒.๓", "1.2.3"), ("DATE", "๑๑/๐เท/๒๕๒๓", "11/0เท/2523"), ("DECIMAL", "๑,๒๓๔.๕๖", "1234.56"), ("DATE", "๑๑/๐๒/๒๕๖๒", "2019-02-11"),
        ("INT", "-7.9", "-7"), ("BOOL", " Yes", "True"), ("BOOL", "no", "False"), ("STRING", "  a b ", "a b"), ("STRING", " \t", None), ("STRING", "INV-๒๕๖๒-๐๐๑", "INV-2562-001"), ("INT", "-0.5", "0"), ("DECIMAL", "-.5", "-0.5"), ("DECIMAL", "-0.00", "0.00"), ("DECIMAL", "145.00", "145.00"),
    ]:
        assert one(spark, N.typed_text(F.col("s"), kind, F.lit(None).cast("string")), text) == want, (kind, text)
    cell = one(spark, N.typed_cell(F.col("s"), "INT", F.lit(None).cast("string")), "12")
    assert (cell.kind, cell.text, cell.lng, cell.dec) == ("INT", "12", 12, None)


def test_image_and_zone_rules(spark):
    """The golden cases of enlarging, of zones and cells in pixels, of page regions and of failure messages."""
    c = F.lit
    row = spark.range(1).select(
        S.enlarged(c(1000), c(1300), S.target_size(c(1000), c(1300), c(150.0), 300, 2200)).alias("low"), S.enlarged(c(2480), c(3508), S.target_size(c(2480), c(3508), c(300.0), 300, 2200)).alias("enough"),
        S.enlarged(c(100), c(200), S.target_size(c(100), c(200), c(0.0), 300, 50_000)).alias("capped"), S.zone_pixels(c(0.14), c(0.0), c(0.12), c(1.0), c(10), c(10)).alias("zone"),
        S.dots_per_inch(c(11811.0), c("PixelsPerMeter")).alias("dpi"), S.failure_message("MAP", c("a\rb\nc")).alias("cr"), S.failure_message("EXTRACT", c("x" * 300)).alias("long"),
        P.region_role(c(1), c(1), F.array(c("CONTINUATION"), c("LAST"))).alias("single"), P.region_role(c(1), c(3), F.array(c("CONTINUATION"), c("LAST"))).alias("first"),
        S.cell_pixels(F.struct(c(10).alias("left"), c(20).alias("top"), c(100).alias("width"), c(50).alias("height")), c(0.5), c(0.25), c(0.9), c(1.4)).alias("cell"),
    ).first()
    assert tuple(row.low) == (2000, 2600) and tuple(row.enough) == (2480, 3508) and tuple(row.capped) == (6000, 12000)
    assert tuple(row.zone) == (1, 0, 1, 10) and abs(row.dpi - 300) < 0.01 and row.cr == "Mapping failed: a" and row.long == "Extraction failed: " + "x" * 200
    assert row.single == "LAST" and row["first"] is None and tuple(row.cell) == (35, 65, 25, 5)


def test_column_structures(spark):
    names = "k int, sub_property string, data_type string, line_offset int, sort_order int, x_start double"
    canonical = spark.createDataFrame([(1, "qty", "INT", 0, 1, 0.0), (1, "size", "STRING", 1, 2, 0.5), (3, "a", "INT", 0, 1, 0.0)], names)
    region = spark.createDataFrame([(1, "q", "STRING", 0, 7, 0.1), (1, "s", "STRING", 0, 8, 0.4), (2, "own", "DATE", 2, 1, 0.2), (3, "x", "STRING", 0, 1, 0.1), (3, "y", "STRING", 0, 2, 0.2)], names)
    got = [tuple(r) for r in P.resolve_structure(canonical, region, "k").orderBy("k", "ordinal").collect()]
    assert got == [
        (1, 1, "qty", "INT", 0, 1, 0.1, False), (1, 2, "size", "STRING", 1, 2, 0.4, False), (2, 1, "own", "DATE", 2, 1, 0.2, False), (3, 1, "x", "STRING", 0, 1, 0.1, True), (3, 2, "y", "STRING", 0, 2, 0.2, True),
    ]


def test_types_in_a_column_give_what_fixed_types_give(spark):
    texts = ["1", "0", "007", "1.", "1.50", "0.50", ".5", "-0", "12-", " 5 ", "๑๒", "12\n", "1.12345678901", "1234567890123456", "12/31/2019", "31/12/2019", "03/04/2019", "03-04.2019", "30/02/2019", "13/13/2019", "01/02/2399", "01/02/2400", "01/02/2562",
             "01/02/0999", "1/2/19", "12/31/2019\n", " 03/04/2019", "๐๓/๐๔/๒๕๖๒", "พ.ศ. 03/04/2019", "true", "No", "a\n", " b", "c ", "", " ", "—", "\x1f", None]
    kinds = ("DECIMAL", "INT", "DATE", "BOOL", "STRING", "Date", "other")
    df = spark.createDataFrame([(t, k, o) for t in texts for k in kinds for o in ("M", "D", None)], "t string, k string, o string")
    fixed = F.coalesce(*[F.when(F.col("k") == k, N.typed_text(F.col("t"), k, F.col("o"))) for k in kinds])
    rows = df.select("t", "k", "o", N.typed_text(F.col("t"), F.col("k"), F.col("o")).alias("a"), fixed.alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == []
    got = {(r.t, r.k, r.o): r.a for r in rows}
    assert got["03/04/2019", "DATE", "M"] == "2019-03-04" and got["03/04/2019", "DATE", None] == "2019-04-03" and got["12/31/2019", "DATE", "D"] == "2019-12-31" and got["30/02/2019", "DATE", "D"] == "30/02/2019"
    assert got["01/02/2562", "DATE", "D"] == "2019-02-01" and got["1.50", "INT", None] == "1" and got["007", "DECIMAL", None] == "7" and got["๐๓/๐๔/๒๕๖๒", "DATE", "D"] == "2019-04-03" and got[" b", "STRING", None] == "b"
