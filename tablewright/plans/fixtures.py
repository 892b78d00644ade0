"""Tables derived from a line-item table: one per order, twenty to an article, in six shapes.

The statement uses only what Spark SQL and DuckDB share, so that an independent engine can build the same
slots. Shapes by order key modulo 6: 0 one header row; 1 two header rows; 2 one header row and a first
column merged over runs of equal flags; 3 as 1 under a title row; 4 as 0 with a full-width row before each
flag; 5 as 1 with the header rows repeated half way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.shared import bucketed, deal, kept_by_table, parts, shared_dir  # noqa: F401

FIXTURE_CTES = """
names AS (
    SELECT * FROM (VALUES (0, 'Flag', 'Line', 0), (1, 'Status', 'Line', 0), (2, 'Line no', 'Line', 0), (3, 'Quantity', 'Amounts', 3),
                          (4, 'Price', 'Amounts', 3), (5, 'Discount', 'Amounts', 3), (6, 'Ship date', 'Shipping', 6)) AS v(col_idx, leaf, span, span_col)),
ranked AS (
    SELECT l_orderkey AS t, l_orderkey % 6 AS shape, l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS STRING) AS line,
           CAST(CAST(l_quantity AS DECIMAL(18, 2)) AS STRING) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) AS price,
           CAST(CAST(l_discount AS DECIMAL(18, 2)) AS STRING) AS discount, CAST(CAST(l_shipdate AS DATE) AS STRING) AS ship,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linestatus, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn,
           dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS g,
           count(*) OVER (PARTITION BY l_orderkey) AS n
    FROM lineitem),
body AS (
    SELECT *, CASE WHEN shape IN (0, 2) THEN rn WHEN shape = 1 THEN rn + 1 WHEN shape = 3 THEN rn + 2 WHEN shape = 4 THEN rn + g
                   ELSE rn + 1 + CASE WHEN rn > floor(n / 2) THEN 2 ELSE 0 END END AS row_at,
           min(rn) OVER (PARTITION BY t, flag) AS first_rn
    FROM ranked),
orders_ AS (SELECT t, shape, max(n) AS n FROM body GROUP BY t, shape),
bands AS (
    SELECT t, CASE shape WHEN 3 THEN 2 WHEN 1 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS row_at, 'leaf' AS kind, CAST(NULL AS STRING) AS flag FROM orders_
    UNION ALL SELECT t, CASE shape WHEN 3 THEN 1 ELSE 0 END, 'span', NULL FROM orders_ WHERE shape IN (1, 3, 5)
    UNION ALL SELECT t, floor(n / 2) + 3, 'leaf', NULL FROM orders_ WHERE shape = 5
    UNION ALL SELECT t, floor(n / 2) + 2, 'span', NULL FROM orders_ WHERE shape = 5
    UNION ALL SELECT t, 0, 'title', NULL FROM orders_ WHERE shape = 3
    UNION ALL SELECT t, min(row_at) - 1, 'section', flag FROM body WHERE shape = 4 GROUP BY t, flag),
placed AS (
    SELECT t, CAST(row_at AS INT) AS row_idx, col_idx,
           CAST(CASE WHEN shape = 2 AND col_idx = 0 THEN first_rn ELSE row_at END AS INT) AS top_row, col_idx AS top_col,
           CASE col_idx WHEN 0 THEN flag WHEN 1 THEN status WHEN 2 THEN line WHEN 3 THEN quantity WHEN 4 THEN price WHEN 5 THEN discount ELSE ship END AS text
    FROM body CROSS JOIN names
    UNION ALL
    SELECT t, CAST(row_at AS INT), col_idx, CAST(row_at AS INT),
           CASE kind WHEN 'leaf' THEN col_idx WHEN 'span' THEN span_col ELSE 0 END,
           CASE kind WHEN 'leaf' THEN leaf WHEN 'span' THEN span WHEN 'title' THEN 'Lines of order ' || CAST(t AS STRING) ELSE 'Returned ' || flag END
    FROM bands CROSS JOIN names),
named AS (
    SELECT 'PMC' || CAST(CAST(floor(t / 20) AS BIGINT) + 1 AS STRING) || '/t' || CAST(t % 20 AS STRING) AS table_uid, row_idx, col_idx,
           CAST(dense_rank() OVER (PARTITION BY t ORDER BY top_row, top_col) - 1 AS INT) AS cell_id, text
    FROM placed),
slots AS (SELECT table_uid, row_idx, col_idx, cell_id FROM named),
cells AS (
    SELECT table_uid, cell_id, min(row_idx) AS row_idx, min(col_idx) AS col_idx, max(row_idx) AS last_row, max(col_idx) AS last_col, max(text) AS text
    FROM named GROUP BY table_uid, cell_id)
"""


#: The same places by one pass over rows dealt by table: what `bands` has once an order comes with its first row, and a
#: section's line with its flag's first, so that nothing is dealt again.
PLACES = """
WITH ranked AS (
    SELECT table_uid, t, t % 6 AS shape, flag, status, CAST(line AS STRING) AS line, CAST(CAST(quantity AS DECIMAL(18, 2)) AS STRING) AS quantity, CAST(CAST(price AS DECIMAL(18, 2)) AS STRING) AS price,
           CAST(CAST(discount AS DECIMAL(18, 2)) AS STRING) AS discount, CAST(CAST(ship AS DATE) AS STRING) AS ship,
           row_number() OVER (PARTITION BY table_uid, t ORDER BY flag, status, line, part, supp, quantity, price, discount, tax, ship) AS rn,
           dense_rank() OVER (PARTITION BY table_uid, t ORDER BY flag) AS g, count(*) OVER (PARTITION BY table_uid, t) AS n
    FROM {dealt}),
body AS (
    SELECT *, CASE WHEN shape IN (0, 2) THEN rn WHEN shape = 1 THEN rn + 1 WHEN shape = 3 THEN rn + 2 WHEN shape = 4 THEN rn + g
                   ELSE rn + 1 + CASE WHEN rn > floor(n / 2) THEN 2 ELSE 0 END END AS row_at,
           min(rn) OVER (PARTITION BY table_uid, t, flag) AS first_rn
    FROM ranked),
lines AS (
    SELECT *, inline(filter(array(
        struct(CAST(row_at AS INT) AS at, 'data' AS kind), struct(CASE shape WHEN 3 THEN 2 WHEN 1 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS at, IF(rn = 1, 'leaf', NULL) AS kind),
        struct(CASE shape WHEN 3 THEN 1 ELSE 0 END AS at, IF(rn = 1 AND shape IN (1, 3, 5), 'span', NULL) AS kind), struct(CAST(floor(n / 2) AS INT) + 3 AS at, IF(rn = 1 AND shape = 5, 'leaf', NULL) AS kind),
        struct(CAST(floor(n / 2) AS INT) + 2 AS at, IF(rn = 1 AND shape = 5, 'span', NULL) AS kind), struct(0 AS at, IF(rn = 1 AND shape = 3, 'title', NULL) AS kind),
        struct(CAST(row_at - 1 AS INT) AS at, IF(rn = first_rn AND shape = 4, 'section', NULL) AS kind)), b -> b.kind IS NOT NULL))
    FROM body),
spread AS (
    SELECT *, inline(array(struct(0 AS col_idx, 'Flag' AS leaf, 'Line' AS span, 0 AS span_col), struct(1 AS col_idx, 'Status' AS leaf, 'Line' AS span, 0 AS span_col), struct(2 AS col_idx, 'Line no' AS leaf, 'Line' AS span, 0 AS span_col), struct(3 AS col_idx, 'Quantity' AS leaf, 'Amounts' AS span, 3 AS span_col),
                           struct(4 AS col_idx, 'Price' AS leaf, 'Amounts' AS span, 3 AS span_col), struct(5 AS col_idx, 'Discount' AS leaf, 'Amounts' AS span, 3 AS span_col), struct(6 AS col_idx, 'Ship date' AS leaf, 'Shipping' AS span, 6 AS span_col)))
    FROM lines),
placed AS (
    SELECT table_uid, t, CAST(at AS INT) AS row_idx, col_idx, CAST(CASE WHEN kind = 'data' AND shape = 2 AND col_idx = 0 THEN first_rn ELSE at END AS INT) AS top_row,
           CASE kind WHEN 'data' THEN col_idx WHEN 'leaf' THEN col_idx WHEN 'span' THEN span_col ELSE 0 END AS top_col,
           CASE kind WHEN 'leaf' THEN leaf WHEN 'span' THEN span WHEN 'title' THEN 'Lines of order ' || CAST(t AS STRING) WHEN 'section' THEN 'Returned ' || flag
                     ELSE CASE col_idx WHEN 0 THEN flag WHEN 1 THEN status WHEN 2 THEN line WHEN 3 THEN quantity WHEN 4 THEN price WHEN 5 THEN discount ELSE ship END END AS text
    FROM spread)
SELECT table_uid, row_idx, col_idx, CAST(dense_rank() OVER (PARTITION BY table_uid, t ORDER BY top_row, top_col) - 1 AS INT) AS cell_id, text FROM placed
"""

#: About how many line items are in one part of the tables; each makes about eleven places.
PART_ROWS = 25_000

_written: dict[tuple[str, str], tuple[str, int]] = {}


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The rows of `named`, dealt by table_uid, and into how many parts."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lineitem.count()
    n = max(1, rows // PART_ROWS, min(spark.sparkContext.defaultParallelism, rows // 5_000))
    uid = "'PMC' || CAST(CAST(floor(l_orderkey / 20) AS BIGINT) + 1 AS STRING) || '/t' || CAST(l_orderkey % 20 AS STRING) AS table_uid"
    named = {"t": "orderkey", "flag": "returnflag", "status": "linestatus", "line": "linenumber", "part": "partkey", "supp": "suppkey", "quantity": "quantity", "price": "extendedprice", "discount": "discount", "tax": "tax", "ship": "shipdate"}
    dealt = lineitem.selectExpr(uid, *[f"l_{column} AS {name}" for name, column in named.items()]).repartition(n, "table_uid")
    return spark.sql(PLACES, dealt=dealt), n


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slots with the text of the cell on each, derived and written to the shared folder once in an application, in
    buckets of table_uid: plans read them many times, plans over files stay small, and what is done by table is done
    where a table lies."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        made, n = places(spark, sf_dir)
        name = f"tables_{uuid.uuid4().hex}"
        bucketed(name, n, made)
        _written[key] = name, n
    name, n = _written[key]
    deal(spark, n)
    return spark.table(name)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_uid, row_idx, col_idx, cell_id)"""
    return texts(spark, sf_dir).drop("text")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(texts(spark, sf_dir))


def cells_of(named: DataFrame) -> DataFrame:
    """(table_uid, cell_id, row_idx, col_idx, last_row, last_col, text), places being a cell's first"""
    ends = (F.min("row_idx").alias("row_idx"), F.min("col_idx").alias("col_idx"), F.max("row_idx").alias("last_row"), F.max("col_idx").alias("last_col"))
    return named.groupBy("table_uid", "cell_id").agg(*ends, F.max("text").alias("text"))
