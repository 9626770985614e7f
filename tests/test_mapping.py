from decimal import Decimal

from pyspark.sql import functions as F

from paperloom.functions import transforms as T
from paperloom.operators import mapping as M
from paperloom.schema import ColumnSpec, FieldSpec, StepSpec, TemplateSpec

BLOCKS = "doc_id bigint, page int, block_id bigint, content string, confidence decimal(5,4)"
CELLS = "doc_id bigint, table_idx int, row_idx int, col_idx int, is_header boolean, content string, confidence decimal(5,4)"
LEAST = Decimal("0.50")


def template(keys, table):
    fields = tuple(FieldSpec(i, name, data_type=kind, key_pattern=f"^{key}$", required=True, min_confidence=LEAST) for i, (name, kind, key) in enumerate(keys, 1))
    columns = tuple(ColumnSpec(*c, i) for i, c in enumerate(table))
    return TemplateSpec(1, (*fields, FieldSpec(20, "line_item", "TABLE_CELL", table_header=table[0][2], columns=columns)))


def frames(spark, blocks, grid, confidence="0.95"):
    c = Decimal(confidence)
    b = spark.createDataFrame([(1, 1, i, t, c) for i, t in enumerate(blocks, 1)], BLOCKS)
    cells = spark.createDataFrame([(1, 1, r, k, r == 0, t, c) for r, row in enumerate(grid) for k, t in enumerate(row, 1)], CELLS)
    return b, cells


def test_english_invoice(spark):
    keys = [("invoice_id", "STRING", "invoice no"), ("invoice_date", "DATE", "date"), ("due_date", "DATE", "due date"), ("subtotal", "DECIMAL", "subtotal"), ("sales_tax", "DECIMAL", "sales tax"), ("total", "DECIMAL", "total")]
    table = [("qty", "INT", "QTY"), ("description", "STRING", "DESCRIPTION"), ("unit_price", "DECIMAL", "UNIT PRICE"), ("amount", "DECIMAL", "AMOUNT")]
    blocks = ["Invoice No: US-001", "Date: 11/02/2019", "Due Date: 26/02/2019", "Subtotal: 145.00", "Sales Tax: 9.06", "Total: 154.06"]
    grid = [["QTY", "DESCRIPTION", "UNIT PRICE", "AMOUNT"], ["1", "Front and rear brake cables", "100.00", "100.00"], ["2", "New set of pedal arms", "15.00", "30.00"], ["3", "Labor 3hrs", "5.00", "15.00"]]
    long = M.map_documents(template(keys, table), *frames(spark, blocks, grid)).cache()
    got = {r.target_property: r for r in long.collect()}
    assert {k: got[k].normalized for k, *_ in keys} == {"invoice_id": "US-001", "invoice_date": "2019-02-11", "due_date": "2019-02-26", "subtotal": "145.00", "sales_tax": "9.06", "total": "154.06"}
    assert got["line_item"].normalized.startswith('[{"qty":1,"description":"Front and rear brake cables","unit_price":100.00,"amount":100.00},')
    assert got["invoice_id"].source_ref == "TextBlock:1" and got["line_item"].source_ref == "Table:1/rows:3"
    out = M.outcomes(long).first()
    assert out.overall_confidence == Decimal("0.95") and not out.needs_review and out.status == "MAPPED"
    assert '"total":154.06' in M.mapped_json(long).first().mapped_json


def test_thai_invoice_and_a_missing_field(spark):
    keys = [("invoice_id", "STRING", "เลขที่"), ("invoice_date", "DATE", "วันที่"), ("due_date", "DATE", "ครบกำหนด"), ("total", "DECIMAL", "รวมทั้งสิ้น"), ("missing", "STRING", "nothing")]
    blocks = ["เลขที่: INV-๒๕๖๒-๐๐๑", "วันที่: ๑๑/๐๒/๒๕๖๒", "ครบกำหนด: ๒๖/๐๒/๒๕๖๒", "รวมทั้งสิ้น: ๑,๓๒๐.๙๘"]
    t, (b, cells) = template(keys, [("qty", "INT", "QTY")]), frames(spark, blocks, [["OTHER"], ["1"]])
    long = M.map_documents(t, b, cells).cache()
    got = {r.target_property: r for r in long.collect()}
    assert [got[k].normalized for k in ("invoice_id", "invoice_date", "due_date", "total")] == ["INV-2562-001", "2019-02-11", "2019-02-26", "1320.98"]
    assert got["missing"].confidence == 0 and got["missing"].below and got["line_item"].normalized == "[]" and not got["line_item"].below
    assert M.outcomes(long).first().needs_review
    wide = M.with_outcome(t, M.map_wide(t, b, cells)).first()
    assert (wide.overall_confidence, wide.needs_review) == (M.outcomes(long).first().overall_confidence, True)


def test_first_match_last_property_and_selectors(spark):
    b, cells = frames(spark, ["No: 1", "no : 2", "blank:", "x"], [["A", "B"], ["1", "x"], ["2", "y"]])
    assert M.resolve_blocks([FieldSpec(1, "n", key_pattern="^no$"), FieldSpec(2, "e", key_pattern="^blank$", default_value="d")], b).select("f1.normalized", F.col("f2.normalized").alias("e")).first() == ("1", None)
    assert {r.property: r.value for r in M.property_map(b).collect()} == {"no": "2", "blank": ""}
    for pick, want in ((None, "1"), ("LAST", "2"), ("ALL", "1 | 2")):
        assert M.resolve_cells([FieldSpec(3, "a", "TABLE_CELL", table_header=" a ", row_selector=pick)], cells).select("f3.normalized").first()[0] == want


def test_steps(spark):
    df = spark.createDataFrame([(" a-b cd ", "2.345", "11/02/2019", "x" * 130)], "a string, n string, d string, s string")
    got = df.select(
        T.apply_steps(F.col("a"), [StepSpec("trim"), StepSpec("case", {"mode": "title"}, 1)]).alias("t"), T.apply_steps(F.col("n"), [StepSpec("number_clean")]).alias("n"),
        T.apply_steps(F.col("d"), [StepSpec("date_normalize")]).alias("d"), T.apply_steps(F.col("s"), [StepSpec("ai_summary")]).alias("s"), T.apply_steps(F.lit(" "), [StepSpec("default", {"value": "z"})]).alias("z"),
    ).first()
    assert (got.t, got.n, got.d, got.z) == ("A-B Cd", "2.35", "2019-11-02", "z") and got.s == "[summary] " + "x" * 120 + "…"
    signs = spark.createDataFrame([("12-", "12.00-"), ("-3.456", "a\\b")], "n string, r string").select(
        T.apply_steps(F.col("n"), [StepSpec("number_clean")]).alias("n"), T.apply_steps(F.col("r"), [StepSpec("regex_replace", {"pattern": "[0-9.]+", "replacement": "\\"})]).alias("r"),
        T.apply_steps(F.col("r"), [StepSpec("case", {"mode": "UPPER"})]).alias("c"),
    ).collect()
    assert [(r.n, r.r, r.c) for r in signs] == [("-12.00", "\\-", "12.00-"), ("-3.46", "a\\b", "a\\b")]
    steps = T.parse_steps('trim\ncase|{"mode": "upper"}\nbroken|{')
    assert [s.kind for s in steps] == ["trim", "case", "broken"] and steps[1].config == {"mode": "upper"} and steps[2].config == {}
    assert T.format_steps(steps).splitlines()[:2] == ["trim", 'case|{"mode": "upper"}']


def test_zonal_rules(spark):
    t = TemplateSpec(1, (FieldSpec(1, "id", "ZONE", required=True), FieldSpec(2, "d", "ZONE", "DATE"), FieldSpec(3, "n", "ZONE", default_value="q"), FieldSpec(10, "line_item", "TABLE_CELL", required=True), FieldSpec(11, "Line_Item", "TABLE_CELL")))
    scalars = spark.createDataFrame([(1, 1, "US-001", Decimal("0.95")), (1, 2, "26/02/2019", Decimal("0.30"))], "doc_id bigint, field_id int, raw string, confidence decimal(5,4)")
    tables = spark.createDataFrame([(1, 10, "[1]", 0, Decimal("0.9"))], "doc_id bigint, field_id int, items_json string, n_rows int, confidence decimal(5,4)")
    got = {r.field_id: r for r in M.map_zonal(t, scalars, tables).collect()}
    assert set(got) == {1, 2, 3, 10} and got[2].normalized == "2019-02-26" and got[2].below and got[3].normalized == "q" and got[3].confidence == 0
    assert got[10].normalized is None and got[10].source_ref == "ZoneTable/rows:0"


def test_rows_of_table_fields_are_those_of_nested_tables(spark):
    """Several tables, headers in two rows or missing, two cells of one place, columns of one header, rows without cells, unknown confidence."""
    c, low = Decimal("0.90"), Decimal("0.31")
    grid = [(1, 1, 0, 1, True, " QTY ", c), (1, 2, 0, 2, True, "Qty", c), (1, 2, 0, 1, True, "name", c), (1, 2, 1, 1, True, "qty", c), (1, 2, 2, 2, False, "๑๐.", c), (1, 2, 2, 2, False, "05-", low), (1, 2, 2, 1, False, "a", None),
            (1, 2, 3, 4, False, "x", c), (1, 2, 4, 2, False, " ", c), (2, 1, 0, 1, True, "qty", c), (3, 5, 0, 1, True, "qty", c), (3, 5, 0, 3, True, "name", c), (3, 5, 1, 3, False, "b", low), (4, 1, 1, 1, False, "1", c), (5, None, None, 1, True, "qty", c), (5, None, None, 1, False, "7", c)]
    cells = spark.createDataFrame(grid, CELLS).repartition("doc_id")
    orders = spark.createDataFrame([(1, "D")], "doc_id bigint, order string")
    for selector in (None, "FIRST", "LAST"):
        field = FieldSpec(1, "items", "TABLE_CELL", table_header="qty", row_selector=selector, columns=(ColumnSpec("n", "INT", "QTY", 1), ColumnSpec("d", "DECIMAL", "qty", 3), ColumnSpec("name", "STRING", "Name", 2), ColumnSpec("none", "STRING", "no", 4)))
        nested = M.nested_tables(cells).select("doc_id", M._rows_of(field, F.lit(None).cast("string")).alias("t")).select("doc_id", "t.table_idx", F.inline("t.rows"), F.size("t.rows").alias("n"), "t.confidence")
        want = {(r.doc_id, r.table_idx, r.row_idx, *r["values"], r.n, r.confidence) for r in nested.collect()}
        for known in (None, orders):
            assert {tuple(r) for r in M.field_rows(field, cells, known).collect()} == want and len(want) == (5 if selector is None else 3)
    plan = M.field_rows(field, cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # dealt and sorted once


def test_line_items_are_dealt_once(spark, tmp_path):
    from paperloom.plans import mapping_queries as Q

    lines = spark.range(9).selectExpr(
        "id % 3 AS l_orderkey", "id * 50 AS l_partkey", "id AS l_suppkey", "cast(id AS int) AS l_linenumber", "double(id + 1) AS l_quantity", "double(id) * 10 AS l_extendedprice", "0.1D AS l_discount", "0.05D AS l_tax",
        "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp'2024-01-02 00:00:00' AS l_shipdate",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for query in (Q.line_item_array, Q.line_item_json):
        assert query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.doc_id, r.row_idx): (r.qty, r.description, r.amount, r.missing, r.n_rows) for r in Q.line_item_array(spark, str(tmp_path)).collect()}
    assert len(got) == 9 and got[1, 2] == ("—", "Part 200", "40.00", None, 3) and got[2, 3] == ("—", "Part 400", "80.00", None, 3)
