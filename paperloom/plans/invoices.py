"""Invoices rendered from orders and lineitem: blocks, table cells, word boxes and page regions.

Every relation is keyed by ``doc_id`` and has the same definition here and in SQL (the ``*_SQL`` CTEs).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.normalize import ARABIC_DIGITS, THAI_DIGITS

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
PAGE_ROWS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _date(day, thai):
    buddhist = F.concat(F.date_format(day, "dd/MM/"), (F.year(day) + 543).cast("string"))
    return F.when(thai, F.translate(buddhist, ARABIC_DIGITS, THAI_DIGITS)).otherwise(F.date_format(day, "dd/MM/yyyy"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, block_id, content, confidence: key/value lines of each order; a third in Thai digits."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    thai = k % 3 == 0
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    total = F.when(thai, F.translate(total, ARABIC_DIGITS, THAI_DIGITS)).otherwise(total)
    lines = [
        F.concat(F.lit("Invoice No: US-"), k.cast("string")), F.concat(F.lit("Date: "), _date(day, thai)), F.concat(F.lit("Due Date: "), _date(F.date_add(day, 15), thai)),
        F.when(k % 7 != 0, F.concat(F.lit("Total: "), total)), F.when(k % 5 == 0, F.concat(F.lit("Invoice No : DUP-"), k.cast("string"))), F.when(k % 11 == 0, F.lit("Thank you")),
    ]
    line = F.posexplode(F.array(*lines)).alias("at", "content")
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), line).where("content is not null")
    b = F.col("at") + 1
    confidence = (((F.col("doc_id") * 7 + b * 13) % 41 + 60).cast("decimal(10,0)") / 100).cast("decimal(5,4)")
    return rows.select("doc_id", F.lit(1).alias("page"), b.cast("bigint").alias("block_id"), "content", confidence.alias("confidence"))


BLOCKS_SQL = """
ord AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderkey % 3 = 0 AS thai, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total FROM orders
), dated AS (
  SELECT *, CASE WHEN thai THEN translate(strftime(day, '%d/%m/') || CAST(year(day) + 543 AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙') ELSE strftime(day, '%d/%m/%Y') END AS d1,
    CASE WHEN thai THEN translate(strftime(day + 15, '%d/%m/') || CAST(year(day + 15) + 543 AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙') ELSE strftime(day + 15, '%d/%m/%Y') END AS d2,
    CASE WHEN thai THEN translate(total, '0123456789', '๐๑๒๓๔๕๖๗๘๙') ELSE total END AS t
  FROM ord
), lines AS (
  SELECT k AS doc_id, 1 AS block_id, 'Invoice No: US-' || k AS content FROM dated
  UNION ALL SELECT k, 2, 'Date: ' || d1 FROM dated UNION ALL SELECT k, 3, 'Due Date: ' || d2 FROM dated
  UNION ALL SELECT k, 4, 'Total: ' || t FROM dated WHERE k % 7 <> 0
  UNION ALL SELECT k, 5, 'Invoice No : DUP-' || k FROM dated WHERE k % 5 = 0
  UNION ALL SELECT k, 6, 'Thank you' FROM dated WHERE k % 11 = 0
), blocks AS (
  SELECT doc_id, 1 AS page, CAST(block_id AS BIGINT) AS block_id, content, CAST(CAST((doc_id * 7 + block_id * 13) % 41 + 60 AS DECIMAL(10,0)) / 100 AS DECIMAL(5,4)) AS confidence FROM lines
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with its row number (from 1) within the order."""
    over = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf_dir, "lineitem").withColumn("row_idx", F.row_number().over(over))


LINES_SQL = f"""
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS INTEGER) AS row_idx FROM lineitem
)"""
HUNDREDTH = Decimal("0.01")
HEADERS = ("QTY", "DESCRIPTION", "UNIT PRICE", "AMOUNT")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, table_idx, row_idx (0: header), col_idx, is_header, content, confidence.

    The rows stay dealt by order, as those of ``words`` do.
    """
    rows = lines(spark, sf_dir)
    quantity = F.col("l_quantity").cast("int").cast("string")
    quantity = F.when(F.col("row_idx") % 4 == 0, F.translate(quantity, ARABIC_DIGITS, THAI_DIGITS)).when(F.col("l_partkey") % 50 == 0, F.lit("—")).otherwise(quantity)
    content = [
        quantity, F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.col("l_tax").cast("decimal(18,2)").cast("string"),
        F.concat(F.lit("฿ "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")),
    ]
    r = F.col("row_idx")
    def row(number, texts):
        return [F.struct(F.lit(1).alias("table_idx"), number.alias("row_idx"), F.lit(at).alias("at"), text.alias("content")) for at, text in enumerate(texts)]

    data, head = row(r, content), row(F.lit(0), [F.lit(h) for h in HEADERS])
    every = rows.select(F.col("l_orderkey").alias("doc_id"), F.inline(F.when(r == 1, F.array(*head, *data)).otherwise(F.array(*data))))
    confidence = (((F.col("doc_id") + F.col("row_idx") * 3 + F.col("at") * 5) % 50 + 50).cast("decimal(3,0)") * HUNDREDTH).cast("decimal(5,4)")
    return every.select("doc_id", "table_idx", "row_idx", (F.col("at") + 1).alias("col_idx"), (F.col("row_idx") == 0).alias("is_header"), "content", confidence.alias("confidence"))


CELLS_SQL = (
    LINES_SQL
    + """,
raw_cells AS (
  SELECT l_orderkey AS doc_id, row_idx, 1 AS col_idx, CASE WHEN row_idx % 4 = 0 THEN translate(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙')
    WHEN l_partkey % 50 = 0 THEN '—' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS content FROM numbered
  UNION ALL SELECT l_orderkey, row_idx, 2, 'Part ' || l_partkey FROM numbered
  UNION ALL SELECT l_orderkey, row_idx, 3, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) FROM numbered
  UNION ALL SELECT l_orderkey, row_idx, 4, '฿ ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) FROM numbered
  UNION ALL SELECT l_orderkey, 0, h.col, h.name FROM numbered, (VALUES (1, 'QTY'), (2, 'DESCRIPTION'), (3, 'UNIT PRICE'), (4, 'AMOUNT')) h(col, name) WHERE row_idx = 1
), cells AS (
  SELECT doc_id, 1 AS table_idx, row_idx, col_idx, row_idx = 0 AS is_header, content,
    CAST(CAST((doc_id + row_idx * 3 + (col_idx - 1) * 5) % 50 + 50 AS DECIMAL(10,0)) / 100 AS DECIMAL(5,4)) AS confidence FROM raw_cells
)"""
)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word_id, text, x, y, w, h: a quantity and description a line, a wrapped second line in even rows,
    and a footer band whose quantity is the sum of the lines' quantities.

    The rows stay dealt by order, so that what groups the words by doc_id needs no other exchange.
    """
    order, quantity = Window.partitionBy("l_orderkey"), F.col("l_quantity").cast("int")
    rows = lines(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(order)).withColumn("q", F.sum(quantity).over(order))
    r, n = F.col("row_idx"), F.col("n") + 1
    y, h = (r - 0.75) / n, F.lit(0.25) / n
    def box(word_id, text, x, top, wide):
        return F.struct(word_id.cast("bigint").alias("word_id"), text.cast("string").alias("text"), F.lit(x).alias("x"), top.alias("y"), F.lit(wide).alias("w"), h.alias("h"))

    last, foot = r == F.col("n"), (F.col("n") + 0.25) / n
    items = F.array(
        box(r * 4, quantity, 0.06, y, 0.03), box(r * 4 + 1, F.concat(F.lit("Part "), F.col("l_partkey")), 0.2, y, 0.3),
        F.when(r % 2 == 0, box(r * 4 + 2, F.concat(F.lit("size "), F.col("l_suppkey")), 0.2, (r - 0.45) / n, 0.2)), box(r * 4 + 3, F.col("l_extendedprice").cast("decimal(18,2)"), 0.85, y, 0.1),
        F.when(last, box(F.lit(1_000_000), F.col("q"), 0.06, foot, 0.03)), F.when(last, box(F.lit(1_000_001), F.lit("FCA FACTORY"), 0.2, foot, 0.3)),
    )
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.explode(items).alias("b")).where("b is not null").select("doc_id", "b.*")


WORDS_SQL = (
    LINES_SQL
    + """,
counted AS (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM numbered
), words AS (
  SELECT l_orderkey AS doc_id, CAST(row_idx * 4 AS BIGINT) AS word_id, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS text, CAST(0.06 AS DOUBLE) AS x,
    (row_idx - CAST(0.75 AS DOUBLE)) / (n + 1) AS y, CAST(0.03 AS DOUBLE) AS w, CAST(0.25 AS DOUBLE) / (n + 1) AS h FROM counted
  UNION ALL SELECT l_orderkey, row_idx * 4 + 1, 'Part ' || l_partkey, 0.2, (row_idx - CAST(0.75 AS DOUBLE)) / (n + 1), 0.3, CAST(0.25 AS DOUBLE) / (n + 1) FROM counted
  UNION ALL SELECT l_orderkey, row_idx * 4 + 2, 'size ' || l_suppkey, 0.2, (row_idx - CAST(0.45 AS DOUBLE)) / (n + 1), 0.2, CAST(0.25 AS DOUBLE) / (n + 1) FROM counted WHERE row_idx % 2 = 0
  UNION ALL SELECT l_orderkey, row_idx * 4 + 3, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), 0.85, (row_idx - CAST(0.75 AS DOUBLE)) / (n + 1), 0.1, CAST(0.25 AS DOUBLE) / (n + 1) FROM counted
  UNION ALL SELECT l_orderkey, 1000000, CAST(sum(CAST(l_quantity AS INTEGER)) AS VARCHAR), 0.06, (count(*) + CAST(0.25 AS DOUBLE)) / (count(*) + 1), 0.03, CAST(0.25 AS DOUBLE) / (count(*) + 1) FROM numbered GROUP BY 1
  UNION ALL SELECT l_orderkey, 1000001, 'FCA FACTORY', 0.2, (count(*) + CAST(0.25 AS DOUBLE)) / (count(*) + 1), 0.3, CAST(0.25 AS DOUBLE) / (count(*) + 1) FROM numbered GROUP BY 1
)"""
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, pages: one page for every five lines."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).cast("int").alias("pages"))
    return n.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"), "pages")


PAGES_SQL = """
page_counts AS (
  SELECT l_orderkey AS doc_id, CAST(ceil(count(*) / 5.0) AS INTEGER) AS pages FROM lineitem GROUP BY 1
), inv_pages AS (
  SELECT doc_id, CAST(unnest(range(1, pages + 1)) AS INTEGER) AS page, pages FROM page_counts
)"""
