from decimal import Decimal

from pyspark.sql import functions as F

from paperloom.functions import transforms as T
from paperloom.operators import mapping as M
from paperloom.operators import templates as X
from paperloom.schema import ColumnSpec, FieldSpec, StepSpec, TemplateSpec

BLOCKS = "doc_id bigint, page int, block_id bigint, content string, confidence decimal(5,4)"
CELLS = "doc_id bigint, table_idx int, row_idx int, col_idx int, is_header boolean, content string, confidence decimal(5,4)"
C = Decimal("0.9000")


def grid(doc, table, rows, first=0):
    """Rows of (is_header, text or None); None makes no cell."""
    return [(doc, table, first + r, c, head, text, conf) for r, row in enumerate(rows) for c, (head, text, conf) in enumerate(row, 1) if text is not None]


def h(text):
    return True, text, C


def d(text, conf=C):
    return False, text, conf


def both(spark, spec, blocks, cells, doc=1):
    """Values by property, from the compiled template and from the template as a row: they agree."""
    b, c = spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(cells, CELLS)
    docs = spark.createDataFrame([(doc, spec.template_id)], "doc_id bigint, template_id int")
    one = {r.target_property: r.asDict() for r in M.map_documents(spec, b, c, docs).collect()}
    two = {r.target_property: r.asDict() for r in X.long_form(X.map_by_template(docs, spark.createDataFrame([X.template_row(spec)], X.TEMPLATES), b, c)).drop("template_id").collect()}
    assert one == two
    return one


def test_table_rules(spark):
    columns = (ColumnSpec("qty", "INT", "qty", 1), ColumnSpec("note", "STRING", "Note", 2), ColumnSpec("day", "DATE", "Day", 3), ColumnSpec("gone", "STRING", "gone", 4))
    spec = TemplateSpec(1, (
        FieldSpec(1, "rows", "TABLE_CELL", table_header="qty", columns=columns), FieldSpec(2, "last", "TABLE_CELL", table_header="qty", columns=columns[:1], row_selector="LAST"), FieldSpec(3, "first", "TABLE_CELL", "DATE", table_header="DAY"),
        FieldSpec(4, "all", "TABLE_CELL", table_header="note", row_selector="ALL"), FieldSpec(5, "second", "TABLE_CELL", table_header="other name"), FieldSpec(6, "absent", "TABLE_CELL", table_header="nothing", default_value="n/a"),
        FieldSpec(7, "nulls", "TABLE_CELL", "INT", table_header="Qty", row_selector="LAST"), FieldSpec(8, "empty", "TABLE_CELL", table_header="nothing", columns=columns),
    ))
    cells = grid(1, 1, [
        [h("QTY"), h("note"), h("Day"), h("Note")], [h(None), h("other name")],
        [d("1"), d("a"), d("03/04/2019"), d("longer text")], [d(None), d("b", None), d("05/04/2019")], [d("3", None), d("c"), d(None)],
    ])
    cells += grid(1, 0, [[h("qty")]])  # a header without data
    got = both(spark, spec, [(1, 1, 1, "Due: 01/31/2019", C)], cells)
    assert got["rows"]["normalized"] == '[{"qty":1,"note":"a","day":"2019-03-04","gone":null},{"qty":null,"note":"b","day":"2019-05-04","gone":null},{"qty":3,"note":"c","day":null,"gone":null}]'
    assert got["rows"]["source_ref"] == "Table:1/rows:3" and got["rows"]["raw"] is None
    assert got["last"]["normalized"] == '[{"qty":3}]' and got["last"]["confidence"] is None and not got["last"]["below"]
    assert (got["first"]["normalized"], got["first"]["source_ref"]) == ("2019-03-04", "Table:1/Col:3")  # months first, as the document's other date shows
    assert (got["all"]["raw"], got["all"]["confidence"]) == ("a | b | c", Decimal("0.9000"))  # the unknown confidence is left out
    assert got["second"]["normalized"] == "a" and got["absent"]["normalized"] == "n/a" and got["absent"]["confidence"] == 0
    assert got["nulls"]["normalized"] == "3" and got["nulls"]["confidence"] == 0
    assert got["empty"]["normalized"] == "[]" and got["empty"]["source_ref"] is None and not got["empty"]["below"]


def test_text_rules(spark):
    spec = TemplateSpec(2, (
        FieldSpec(1, "total", "REGEX", "DECIMAL", regex=r"total: (\S+)"), FieldSpec(2, "whole", "REGEX", regex=r"thank (?:you|u)"), FieldSpec(3, "const", "CONSTANT", default_value="x", steps=(StepSpec("case", {"mode": "upper"}),)),
        FieldSpec(4, "blank", key_pattern="^blank$", default_value="d"), FieldSpec(5, "any", key_pattern="invoice|bill", steps=(StepSpec("regex_replace", {"pattern": "(\\d)", "replacement": "<$1>"}, 2), StepSpec("trim", {}, 1), StepSpec("no such", {}, 3))),
        FieldSpec(6, "odd", "SOMETHING"), FieldSpec(7, "none", "KEY_VALUE"), FieldSpec(8, "n", key_pattern="^n$", steps=(StepSpec("number_clean", {"decimals": 3}),)), FieldSpec(9, "missing", "REGEX", regex="(zzz)", default_value="no"),
    ))
    texts = [": x", "no colon", "blank:", "TOTAL: ๑๒.50", "Thank You", "The BILL : a1", "n: 2.3456"]
    got = both(spark, spec, [(1, 1, i, t, C if i != 2 else None) for i, t in enumerate(texts, 1)], [])
    assert (got["total"]["normalized"], got["total"]["source_ref"], got["total"]["confidence"]) == ("12.50", "Regex:fulltext", C)
    assert got["whole"]["normalized"] == "Thank You" and got["const"]["normalized"] == "X" and got["const"]["source_ref"] is None
    assert (got["blank"]["raw"], got["blank"]["normalized"]) == ("", None) and got["any"]["normalized"] == "a<1>" and got["n"]["normalized"] == "2.346"
    assert got["odd"]["confidence"] == 0 and got["none"]["confidence"] == 0 and got["missing"]["normalized"] == "no"


def test_documents_without_reads_and_without_templates(spark):
    spec = TemplateSpec(3, (FieldSpec(1, "a", key_pattern="a", default_value="d", required=True), FieldSpec(2, "b", "CONSTANT", default_value="c"), FieldSpec(3, "r", "REGEX", regex="x")))
    got = both(spark, spec, [(9, 1, 1, "z", C)], [(9, 1, 0, 1, True, "q", C)])
    assert [got[k]["normalized"] for k in "abr"] == ["d", "c", None] and got["a"]["below"]
    docs = spark.createDataFrame([(1, 3), (2, 44), (3, None)], "doc_id bigint, template_id int")
    rows = X.with_outcome(X.map_by_template(docs, spark.createDataFrame([X.template_row(spec)], X.TEMPLATES), spark.createDataFrame([], BLOCKS), spark.createDataFrame([], CELLS)))
    assert {r.doc_id: r.status for r in rows.collect()} == {1: "NEEDS_REVIEW", 2: None, 3: None}


def test_template_rows_keep_order_and_parts(spark):
    spec = TemplateSpec(4, (
        FieldSpec(2, "t", "TABLE_CELL", table_header="Q", columns=(ColumnSpec("b", sort_order=2), ColumnSpec("a", sort_order=1)), zone=(0.1, 0.2, 0.3, 0.4)), FieldSpec(1, "k", steps=(StepSpec("case", {"mode": "upper"}, 2), StepSpec("trim", {}, 1), StepSpec("default", {"value": "x"}, 3, False))),
    ))
    row = spark.createDataFrame([X.template_row(spec)], X.TEMPLATES)
    fields, columns, steps = X.flattened(row)
    again = X.nested(row.drop("fields"), fields, columns, steps)
    got = again.first().fields
    assert [f.field_id for f in got] == [1, 2] and [s.kind for s in got[0].steps] == ["trim", "case"] and [c.sub_property for c in got[1].columns] == ["a", "b"]
    assert got[1].zone.width == 0.3 and got[0].zone is None and dict(got[0].steps[1].config) == {"mode": "upper"}
    assert X.nested(row.drop("fields"), fields.limit(0), columns, steps).first().fields == []
    off = columns.withColumn("is_active", F.col("sub_property") == "a")
    assert [c.sub_property for c in X.nested(row.drop("fields"), fields, off, steps).first().fields[1].columns] == ["a"]


def test_title_case_and_numbers(spark):
    df = spark.createDataFrame([("foo/bar. (BAZ_qux) o'neil 1st a1b-c", "๑๒ 5", "1/2/49"), ("ÉCOLE été", "(1,234.5", "3/4/50 ")], "t string, n string, d string")
    got = df.select(T.title_case(F.col("t")).alias("t"), T.apply_steps(F.col("n"), [StepSpec("number_clean")]).alias("n"), T.apply_steps(F.col("d"), [StepSpec("date_normalize")]).alias("d")).collect()
    assert [tuple(r) for r in got] == [("Foo/Bar. (Baz_Qux) O'neil 1St A1b-C", "๑๒ 5", "2049-01-02"), ("École Été", "1234.50", "1950-03-04")]


def test_zonal_steps(spark):
    t = TemplateSpec(1, (FieldSpec(1, "id", "ZONE", steps=(StepSpec("case", {"mode": "upper"}),)), FieldSpec(2, "x", "ZONE", default_value="q", steps=(StepSpec("case", {"mode": "upper"}),))))
    scalars = spark.createDataFrame([(1, 1, "ab", C)], "doc_id bigint, field_id int, raw string, confidence decimal(5,4)")
    tables = spark.createDataFrame([], "doc_id bigint, field_id int, items_json string, n_rows int, confidence decimal(5,4)")
    got = {r.field_id: (r.normalized, r.source_ref) for r in M.map_zonal(t, scalars, tables).collect()}
    assert got == {1: ("AB", "Zone"), 2: ("q", None)}


def test_values_are_computed_once_from_one_grouping(spark, tmp_path):
    from paperloom.plans import template_queries as Q

    spark.range(40).selectExpr("id AS o_orderkey", "double(id) AS o_totalprice", "timestamp'2024-02-03 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(120).selectExpr(
        "id % 40 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "cast(id AS int) AS l_linenumber", "double(id) AS l_quantity", "double(id) AS l_extendedprice", "0.1D AS l_discount", "0.05D AS l_tax", "'N' AS l_returnflag",
        "'O' AS l_linestatus", "timestamp'2024-01-02 00:00:00' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    query = Q.map_many_templates(spark, str(tmp_path))
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter (" in line and "transform(" in line]  # no filter computes the values beforehand
    assert plan.count("FileScan parquet [l_orderkey") == 1 and plan.count("Exchange hashpartitioning") == 5  # lines, blocks and documents by document, two by template
    got = {(r.doc_id, r.target_property): r.normalized for r in query.collect()}
    assert len(got) == 150 and got[4, "invoice_date"] == "2024-02-03" and got[1, "first_qty"] == "1" and got[5, "first_qty"] == "5"


def test_repeated_documents_and_ids_that_are_null(spark):
    spec = TemplateSpec(7, (FieldSpec(1, "a", key_pattern="^a$"), FieldSpec(2, "t", "TABLE_CELL", table_header="q", row_selector="ALL"), FieldSpec(3, "r", "REGEX", regex="x*")))
    docs = spark.createDataFrame([(1, 7), (1, 7), (1, None), (None, 7), (2, 7)], "doc_id bigint, template_id int")
    b = spark.createDataFrame([(1, 1, 1, "a: v", C), (None, 1, 1, "a: w", C), (3, 1, 1, "a: z", C)], BLOCKS)
    c = spark.createDataFrame([(1, 1, 0, 1, True, "Q", C), (1, 1, 1, 1, False, "5", C), (1, 1, 2, 1, None, "6", C), (1, 1, 3, 1, False, "7", None), (None, 1, 0, 1, True, "Q", C), (None, 1, 1, 1, False, "8", C)], CELLS)
    rows = X.long_form(X.map_by_template(docs, spark.createDataFrame([X.template_row(spec)], X.TEMPLATES), b, c)).collect()
    assert sorted((r.doc_id or 0, r.field_id, r.raw, r.source_ref) for r in rows if r.doc_id == 1) == [(1, k, raw, ref) for k, raw, ref in ((1, "v", "TextBlock:1"), (2, "5 | 7", "Table:1/Col:1"), (3, "", "Regex:fulltext")) for _ in range(2)]
    assert [(r.raw, r.source_ref) for r in rows if r.doc_id != 1] == [(None, None)] * 6  # neither blocks nor cells, and a text that is not there is not searched
