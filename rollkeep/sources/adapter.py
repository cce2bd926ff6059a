"""Register frames built from the sample tables, as SQL that Spark and DuckDB both read.

``{name}`` stands for a table. The same text makes the Spark frame and the views of the
SQL that queries are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ENTRIES = """
SELECT o.o_orderkey AS id, n.n_regionkey AS workspace_id, n.n_nationkey AS batch_id, o.o_orderpriority AS type_id,
  'REG/' || n.n_name || '/' || CAST(year(o.o_orderdate) AS STRING) || '/' || lpad(CAST(o.o_orderkey AS STRING), 7, '0') AS number,
  'C-' || CAST(c.c_custkey AS STRING) || '-' || CAST(year(o.o_orderdate) AS STRING) AS registration_number,
  p.p_name AS primary_name, p.p_brand AS secondary_name,
  CAST(o.o_orderdate AS DATE) AS event_date,
  CASE o.o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'SUPERSEDED' ELSE 'VOID' END AS status,
  o.o_orderkey % 50 = 0 AS needs_review,
  CASE WHEN o.o_orderkey % 17 = 0 THEN 'SUSPECTED' WHEN o.o_orderkey % 19 = 0 THEN 'CONFIRMED' WHEN o.o_orderkey % 23 = 0 THEN 'DISTINCT' ELSE 'NONE' END AS duplicate_status,
  o.o_orderdate AS created_at, round(o.o_totalprice, 2) AS total
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {part} p ON p.p_partkey = o.o_orderkey % 200 + 1
"""

NAMES = """
SELECT l.l_orderkey AS certificate_id, l.l_linenumber AS position,
  CASE l.l_linenumber % 5 WHEN 0 THEN 'subject' WHEN 1 THEN 'father' WHEN 2 THEN 'mother' WHEN 3 THEN 'party' ELSE 'witness' END AS role,
  p.p_name AS value
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

PAGES = "SELECT conv_id AS document_id, turn + 1 AS page_number, role, text FROM {conversations}"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The Spark frame of an adapter text."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def view(text: str) -> str:
    """The same for DuckDB, as a subquery."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return "(" + text.strip() + ")"
