import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from paperloom.operators import records as R
from paperloom.operators.buckets import BucketedTable
from paperloom.sources import capture as C

SCHEMA = "doc_id bigint, field_id int, value string"


def contents(path):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def test_writes_touch_the_buckets_of_their_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(d, f, f"{d}.{f}") for d in range(40) for f in range(3)] + [(None, 1, "n")], SCHEMA)
    table = BucketedTable(spark, path, "doc_id", rows.schema, 8)
    table.create(rows)
    before = contents(path)
    assert len(before) == 8
    changes = spark.createDataFrame([(3, 1, "new"), (11, 9, "added")], SCHEMA)

    def upsert(current, new):
        return current.join(new, ["doc_id", "field_id"], "left_anti").unionByName(new)

    assert table.merge(changes, upsert) == [3]
    after = contents(path)
    assert {p for p in before if before[p] == after.get(p)} == {p for p in before if "bucket=3/" not in p}
    want = sorted((d, f, "new" if (d, f) == (3, 1) else f"{d}.{f}") for d in range(40) for f in range(3)) + [(11, 9, "added")]
    assert sorted(tuple(r)[:3] for r in table.read().where("doc_id is not null").collect()) == sorted(want) and table.read([0]).where("doc_id is null").count() == 1
    assert table.merge(changes, upsert) == [3] and table.read().count() == 122  # again: nothing more
    gone = spark.createDataFrame([(k * 8 + 5,) for k in range(5)], "doc_id bigint")
    assert table.merge(gone, lambda now, new: now.join(new, "doc_id", "left_anti")) == [5] and table.read([5]).count() == 0
    assert table.merge(gone.limit(0), upsert) == [] and table.read().count() == 107


def test_status_and_classification(spark):
    docs = spark.createDataFrame([(1, 1, "CAPTURED"), (2, 1, "CAPTURED")], "doc_id bigint, doc_type int, status string")
    some = R.classified(docs, spark.createDataFrame([(1, 5, 0.92), (9, 5, 0.5)], "doc_id bigint, doc_type int, confidence double"))
    got = {r.doc_id: r for r in some.collect()}
    assert (got[1].doc_type, got[1].status, float(got[1].classify_confidence)) == (5, "CLASSIFIED", 0.92) and got[1].updated_at and not got[2].updated_at and got[2].status == "CAPTURED"
    done = R.with_status(some, spark.createDataFrame([(2, "A", 2), (2, "B", 1)], "doc_id bigint, status string, at int"), F.timestamp_seconds(F.lit(60)))
    assert {r.doc_id: r.status for r in done.collect()} == {1: "CLASSIFIED", 2: "A"}


def test_extraction_json_of_documents_with_and_without_parts(spark):
    import json

    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    pages = spark.createDataFrame([(1, 2, None, 5), (1, 1, 4, 5)], "doc_id bigint, page int, width int, height int")
    blocks = spark.createDataFrame([(1, 1, 7, "word", "w"), (1, 1, 9, "Value", 'q"x'), (1, 1, 8, "paragraph", None)], "doc_id bigint, page int, block_id bigint, block_type string, content string").withColumn("confidence", F.lit(None).cast("decimal(5,4)"))
    cells = spark.createDataFrame([(1, 3, 0, 1, True, "H")], "doc_id bigint, table_idx int, row_idx int, col_idx int, is_header boolean, content string").withColumn("confidence", F.lit(0.5).cast("decimal(5,4)"))
    got = {r.doc_id: json.loads(r.json) for r in C.extraction_json(docs, pages, blocks, cells).collect()}
    assert got[2] == {"documentId": 2, "pages": [], "blocks": [], "tables": []}
    assert [p["pageNumber"] for p in got[1]["pages"]] == [1, 2] and got[1]["pages"][1]["width"] == 0
    assert [(b["id"], b["type"], b["text"], b["bbox"]) for b in got[1]["blocks"]] == [("block-8", "LINE", None, None), ("block-9", "VALUE", 'q"x', None)]
    assert got[1]["tables"][0]["cells"][0] == {"rowIndex": 0, "colIndex": 1, "rowSpan": 1, "colSpan": 1, "isHeader": True, "type": "TABLE_CELL", "text": "H", "normalizedValue": None, "confidence": 0.5, "bbox": None}


def test_edited_tables_are_typed_by_the_order_that_their_cells_show(spark):
    edits = spark.createDataFrame([
        (1, 2, [{"d": "03/04/2019", "n": "๑๒", "_pg": "2"}, {"d": "12/31/2019", "n": "x", "_pg": "0"}]), (2, 2, []), (3, 9, [{"d": "1"}]), (4, 3, [{"d": "1"}]),
    ], "doc_id bigint, field_id int, rows array<map<string,string>>")
    columns = spark.createDataFrame([(2, [("d", "DATE"), ("n", "INT"), ("gone", "STRING")]), (3, [])], "field_id int, columns array<struct<sub_property:string,data_type:string>>")
    got = {r.doc_id: r.value for r in R.edited_tables(edits, columns).collect()}
    assert got == {1: '[{"d":"2019-03-04","n":12,"gone":null,"_pg":2},{"d":"2019-12-31","n":"x","gone":null}]', 2: "[]"}
    docs = spark.createDataFrame([(1, "NEEDS_REVIEW"), (2, "MAPPED"), (5, "NEEDS_REVIEW")], "doc_id bigint, status string")
    values = spark.createDataFrame([(1, 2, "old", True), (1, 1, "a", True), (5, 1, "b", True)], "doc_id bigint, field_id int, normalized string, below boolean")
    fixes = spark.createDataFrame([(1, 1, "A"), (7, 1, "z")], "doc_id bigint, field_id int, value string")
    saved, done = R.review_saved(docs, values, fixes, edits, columns)
    assert {(r.doc_id, r.field_id): (r.normalized[:4], r.below) for r in saved.collect()} == {(1, 2): ('[{"d', False), (1, 1): ("A", False), (5, 1): ("b", True)}
    assert {r.doc_id: r.status for r in done.collect()} == {1: "VALIDATED", 2: "MAPPED", 5: "NEEDS_REVIEW"}


def test_internal_keys_go_at_any_depth_and_numbers_keep_their_text(spark):
    import random

    draw = random.Random(4)

    def value(depth):
        kind = draw.randrange(8 if depth else 4)
        if kind < 2:
            return draw.choice(["1.50", "-0", "1e5", "true", "null", "12345678901234567890.100"])
        if kind < 4:
            return draw.choice(['"_x"', '"a \\"_b\\": 1, }"', '"ไทย , ]"', '""', '"\\\\\\\\"', '"{[_"'])
        if kind < 6:
            return "[" + draw.choice([",", " , "]).join(value(depth - 1) for _ in range(draw.randrange(4))) + "]"
        keys = draw.sample(["a", "_b", "c_", "_", "_pg", "d,", "e}"], draw.randrange(6))
        return "{" + draw.choice([",", ", "]).join(f'"{k}"{draw.choice(["", " "])}:{draw.choice(["", " ", chr(10)])}{value(depth - 1)}' for k in keys) + "}"

    texts = [value(6) for _ in range(400)] + ["", "no json", '{"_a":1', None, " ", '{"a":"_b"}', '{"_a":{"b":[1,{"_c":2}]}}', "[" * 60 + '{"_a":1,"b":[]}' + "]" * 60, '{"_x":"' + "y\\\\n" * 20000 + '","k":1}', '{"k":"' + "z" * 300_000 + '"}']
    got = {r.i: r.t for r in C.stripped(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").collect()}
    for i, text in enumerate(texts):
        want = C.strip_internal(text)
        assert got[i] == want, (text[:300], got[i][:300], want[:300])


def test_extraction_json_reads_the_lines_of_its_cells_once(spark, tmp_path):
    from paperloom.plans import invoices as I

    spark.range(4).selectExpr(
        "id % 2 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "cast(id AS int) AS l_linenumber", "double(id) AS l_quantity", "double(id) AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus", "current_timestamp() AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = I.cells(spark, str(tmp_path))
    assert cells._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and cells.count() == 24 and cells.where("is_header").count() == 8
