"""Queries between reading and the register: units, links, types, publication, evidence, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeep.functions import boxes
from rollkeep.functions.text import slug
from rollkeep.operators import export, extract, publish, review
from rollkeep.sources import delimited, readers
from rollkeep.sources.adapter import ENTRIES, frame, view
from rollkeep.sources.scratch import fresh_dir
from rollkeep.streaming import stages

LINKS = "SELECT DISTINCT l_orderkey AS certificate_id, l_orderkey * 10 + l_linenumber AS document_id, l_linenumber AS page_start, l_linenumber + 2 AS page_end, 'PRIMARY' AS state FROM {lineitem}"
UNITS = "SELECT DISTINCT o_orderkey AS document_id, CAST(1 AS BIGINT) AS page_start, 1 + o_orderkey % 9 AS page_end FROM {orders}"
EVIDENCE = """SELECT DISTINCT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN 'manual' ELSE 'rule' END AS method,
 CASE WHEN l_linenumber % 4 <> 0 THEN l_linenumber * 2 END AS page_number FROM {lineitem} WHERE l_orderkey % 5 = 0"""
QUEUE = """SELECT o_orderkey AS extraction_id, o_custkey % 25 AS batch_id, o_orderpriority AS class_key, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'N-' || CAST(o_orderkey AS STRING) END AS number,
 CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE 'APPROVED' END AS status FROM {orders}"""
BATCHES = "SELECT n_nationkey AS batch_id, CASE WHEN n_regionkey = 1 THEN n_regionkey + 100 END AS pinned_type FROM {nation}"
TYPES = "SELECT r_regionkey AS type_id, CASE r_regionkey WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '2-HIGH' WHEN 3 THEN '5-LOW' ELSE '3-MEDIUM' END AS class_key, r_regionkey <> 3 AS active FROM {region}"
CELLS = """SELECT document_id, 'f' AS fingerprint, 1 AS page_number, 0 AS table, row, c.column, CASE c.column WHEN 0 THEN 'LINE ' || CAST(row AS STRING) WHEN 1 THEN ' ' ELSE 'no ' || CAST(part AS STRING) END AS text
FROM (SELECT l_orderkey AS document_id, l_linenumber AS row, min(l_partkey) AS part FROM {lineitem} GROUP BY 1, 2) l CROSS JOIN (VALUES (0), (1), (2)) c(column)"""
RULES = "SELECT DISTINCT user_id % 40 AS template_id, event_type AS field, event_id AS created_at, 'rule ' || CAST(event_id AS STRING) AS rule FROM {events}"


def units_split(spark: SparkSession, d: str) -> DataFrame:
    return review.split_unit(frame(spark, d, UNITS), 1 + F.col("document_id") % 5)


def units_merged(spark: SparkSession, d: str) -> DataFrame:
    return review.merge_units(review.split_unit(frame(spark, d, UNITS), 1 + F.col("document_id") % 5), F.col("document_id") % 2)


def replaced_documents(spark: SparkSession, d: str) -> DataFrame:
    links = frame(spark, d, LINKS)
    new = links.where("document_id % 7 = 0").select("document_id", (F.col("document_id") + 1_000_000_000).alias("new_document_id"))
    return review.replaced(links, new)


def resolved_types(spark: SparkSession, d: str) -> DataFrame:
    rows = publish.resolved_types(frame(spark, d, QUEUE), frame(spark, d, BATCHES), frame(spark, d, TYPES))
    return rows.select("extraction_id", "batch_id", "type_id")


def publish_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = publish.resolved_types(frame(spark, d, QUEUE), frame(spark, d, BATCHES), frame(spark, d, TYPES))
    register = frame(spark, d, "SELECT l_orderkey AS source_extraction_id FROM {lineitem} WHERE l_linenumber > 4")
    return publish.to_publish(rows, register).select("extraction_id", "type_id", "number")


def export_summary(spark: SparkSession, d: str) -> DataFrame:
    return publish.export_summary(frame(spark, d, QUEUE).withColumn("type_id", F.col("class_key")), "batch_id")


def manual_kept(spark: SparkSession, d: str) -> DataFrame:
    """Re-extraction keeps what was entered by hand."""
    e = frame(spark, d, EVIDENCE)
    key, value = F.concat(F.lit("f"), (F.col("n") % 2).cast("string")), F.concat(F.lit("old "), F.col("n").cast("string"))
    one = e.withColumns({"old": F.create_map(key, value), "methods": F.create_map(key, F.col("method")), "read": F.create_map(F.lit("f1"), F.lit("new"))})
    kept = publish.kept_manual(F.col("read"), F.col("old"), F.col("methods"))
    return one.select("id", "n", F.try_element_at(kept, F.lit("f0")).alias("f0"), F.try_element_at(kept, F.lit("f1")).alias("f1"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, EVIDENCE)
    source = F.when(F.col("page_number").isNotNull(), F.create_map(F.lit("name"), F.struct("page_number", F.lit("Name:").alias("snippet"))))
    empty = F.create_map().cast("map<string,struct<page_number:bigint,snippet:string>>")
    evidence = publish.provenance(F.create_map(F.lit("name"), F.col("method")), F.coalesce(source.cast("map<string,struct<page_number:bigint,snippet:string>>"), empty))
    got = F.try_element_at(evidence, F.lit("name"))
    return e.select("id", "n", got["method"].alias("method"), got["page_number"].alias("page"), got["snippet"].alias("snippet"))


def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "SELECT l_orderkey AS unit_id, CASE WHEN l_partkey % 2 = 0 THEN 'name' ELSE 'number' END AS field, round(l_discount, 2) AS confidence, l_linenumber AS page_number, CAST(l_suppkey AS STRING) AS value FROM {lineitem}")
    return publish.candidate_values(c)


def enclosing_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 13 AS DOUBLE) AS t FROM {part}")
    a = boxes.box(F.col("s"), F.col("t"), F.col("s") + 10, F.col("t") + 4)
    b = boxes.box(F.col("t"), F.col("s"), F.col("t") + 8, F.col("s") + 5)
    around = boxes.union(a, b)
    both = boxes.enclosing(F.array(a, b, F.lit(None)))
    return p.select("id", *[around[n].alias(n) for n in boxes.SIDES], (around == both).alias("same"), F.round(boxes.vertical_overlap(a, b), 6).alias("overlap"))


def newest_rules(spark: SparkSession, d: str) -> DataFrame:
    return readers.newest_rules(frame(spark, d, RULES)).select("template_id", "field", "rule")


def label_slugs(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "SELECT p_partkey, ' ' || p_name || ' (No.) -- ' || p_type || '!' AS label FROM {part}").select("p_partkey", slug(F.col("label")).alias("slug"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    names = "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'scans/' || s_name || '?.pdf' WHEN 1 THEN 'con.txt' WHEN 2 THEN 'a/b/..' ELSE s_name || '*' END AS name FROM {supplier}"
    return frame(spark, d, names).select("s_suppkey", readers.safe_name(F.col("name")).alias("name"))


def redacted_maps(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "SELECT c_custkey, c_name FROM {customer}")
    m = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("subject_name"), F.col("c_name"), F.lit("note"), F.concat(F.lit("mail x"), F.col("c_custkey").cast("string"), F.lit("@example.org on 01/02/2024")))
    clean = export.redacted(m)
    return c.select("c_custkey", *[clean[k].alias(k) for k in ("id", "subject_name", "note")])


def cursors(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, ENTRIES).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    c = e.withColumn("cursor", publish.cursor(F.col("created_at"), F.col("id")))
    back = publish.read_cursor(F.col("cursor"))
    return c.select("id", "cursor", ((back["t"] == F.col("created_at")) & (back["i"] == F.col("id").cast("string"))).alias("same"))


def import_second_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an import that repeat either number of the register or of a row kept before them."""
    rows = frame(spark, d, "SELECT o_orderkey AS row_number, 'n' || CAST(o_custkey AS STRING) AS number_key, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || CAST(o_orderkey % 400 AS STRING) ELSE '' END AS registration_key FROM {orders}")
    register = frame(spark, d, "SELECT 'n' || CAST(n_nationkey AS STRING) AS number_key, '' AS registration_key FROM {nation}")
    return delimited.repeated_numbers(rows.groupBy("row_number").agg(F.min("number_key").alias("number_key"), F.min("registration_key").alias("registration_key")), register)


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = frame(spark, d, CELLS)
    rules = "SELECT 'f' AS fingerprint, 'total' AS field, 'Line 2' AS anchor, NULL AS pattern FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'f', 'part', 'line', '[1-9][0-9]*$' FROM {region} WHERE r_regionkey = 0"
    return extract.applied_cells(cells, frame(spark, d, rules))


def stage_states(spark: SparkSession, d: str) -> DataFrame:
    """Documents through two stages whose deliveries overlap and come again late."""
    docs = frame(spark, d, "SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 7 THEN '' ELSE text END AS text FROM {documents}")
    words = F.size(F.split("text", " "))
    read = stages.Stage("read", ("QUEUED",), "READ", lambda df: df.select("document_id", words.cast("long").alias("words"), F.when(F.col("text") == "", "no_text").alias("code")))
    seal = stages.Stage("seal", ("READ",), "SEALED", lambda df: df.select("document_id", F.lit(0).cast("long").alias("words"), F.lit(None).cast("string").alias("code")))
    root = fresh_dir(spark)
    stages.register(docs, root, "all")
    stages.advance(docs.where("document_id % 2 = 0"), "even", read, root)
    stages.advance(docs, "all", read, root)
    stages.advance(docs.where("document_id % 3 = 0"), "third", seal, root)
    stages.advance(docs.where("document_id % 2 = 0"), "even", read, root)
    gave = stages.results(spark, root, read, "document_id long, words long, code string").select("document_id", "words")
    return stages.states(stages.moves(spark, root)).join(gave, "document_id", "left")


QUERIES = {
    "stage_states": stage_states,
    "import_second_numbers": import_second_numbers,
    "table_cells": table_cells,
    "units_split": units_split,
    "units_merged": units_merged,
    "replaced_documents": replaced_documents,
    "resolved_types": resolved_types,
    "publish_queue": publish_queue,
    "export_summary": export_summary,
    "manual_kept": manual_kept,
    "provenance": provenance,
    "best_candidates": best_candidates,
    "enclosing_boxes": enclosing_boxes,
    "newest_rules": newest_rules,
    "label_slugs": label_slugs,
    "safe_names": safe_names,
    "redacted_maps": redacted_maps,
    "cursors": cursors,
}

_SPLIT = f"""u AS (SELECT *, 1 + document_id % 5 AS cut FROM {view(UNITS)} x),
p AS (SELECT document_id, page_start, CASE WHEN cut > page_start AND cut <= page_end THEN cut - 1 ELSE page_end END AS page_end FROM u UNION ALL SELECT document_id, cut, page_end FROM u WHERE cut > page_start AND cut <= page_end),
s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_start, page_end) - 1 AS ordinal FROM p)"""
_TYPED = f"""t AS (SELECT q.*, coalesce(b.pinned_type, k.type_id) AS type_id FROM {view(QUEUE)} q LEFT JOIN {view(BATCHES)} b USING (batch_id)
LEFT JOIN (SELECT class_key, min(type_id) AS type_id FROM {view(TYPES)} x WHERE active GROUP BY 1) k USING (class_key))"""

SQL = {
    "stage_states": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN '' ELSE text END AS text FROM documents)
SELECT doc_id AS document_id, CASE WHEN text <> '' AND doc_id % 3 = 0 THEN 3 ELSE 2 END AS version, CASE WHEN text = '' THEN 'FAILED' WHEN doc_id % 3 = 0 THEN 'SEALED' ELSE 'READ' END AS status,
 CASE WHEN text = '' THEN 'no_text' END AS code, len(string_split(text, ' ')) AS words FROM t""",
    "table_cells": """WITH l AS (SELECT l_orderkey AS document_id, l_linenumber AS row, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2)
SELECT document_id, 'total' AS field, 'no ' || part AS value, 0.95::DOUBLE AS confidence FROM l WHERE row = 2
UNION ALL SELECT document_id, 'part', CAST(arg_min(part, row) AS VARCHAR), 0.95::DOUBLE FROM l GROUP BY 1 HAVING arg_min(part, row) <> 0""",
    "units_split": f"WITH {_SPLIT} SELECT document_id, page_start, page_end, ordinal FROM s",
    "units_merged": f"""WITH {_SPLIT}, g AS (SELECT document_id, min(page_start) AS page_start, max(page_end) AS page_end FROM s GROUP BY document_id, CASE WHEN ordinal = document_id % 2 + 1 THEN document_id % 2 ELSE ordinal END)
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_start, page_end) - 1 AS ordinal FROM g""",
    "replaced_documents": f"SELECT certificate_id, document_id, page_start, page_end, CASE WHEN document_id % 7 = 0 THEN 'SUPERSEDED' ELSE state END AS state FROM {view(LINKS)} l UNION ALL SELECT certificate_id, document_id + 1000000000, page_start, page_end, 'PRIMARY' FROM {view(LINKS)} l WHERE document_id % 7 = 0",
    "resolved_types": f"WITH {_TYPED} SELECT extraction_id, batch_id, type_id FROM t",
    "publish_queue": f"WITH {_TYPED} SELECT extraction_id, type_id, number FROM t WHERE type_id IS NOT NULL AND trim(number) <> '' AND extraction_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4)",
    "export_summary": f"SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('NEEDS_REVIEW', 'FAILED')) AS unreviewed, array_to_string(list_sort(list(DISTINCT class_key)), ',') AS types FROM {view(QUEUE)} q GROUP BY 1",
    "manual_kept": f"SELECT id, n, CASE WHEN method = 'manual' AND n % 2 = 0 THEN 'old ' || n END AS f0, CASE WHEN method = 'manual' AND n % 2 = 1 THEN 'old ' || n ELSE 'new' END AS f1 FROM {view(EVIDENCE)} e",
    "provenance": f"SELECT id, n, method, page_number AS page, CASE WHEN page_number IS NOT NULL THEN 'Name:' END AS snippet FROM {view(EVIDENCE)} e",
    "best_candidates": "SELECT unit_id, field, confidence, page_number, value FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, field ORDER BY confidence DESC, page_number, value) AS r FROM (SELECT l_orderkey AS unit_id, CASE WHEN l_partkey % 2 = 0 THEN 'name' ELSE 'number' END AS field, round(l_discount, 2) AS confidence, l_linenumber AS page_number, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem)) WHERE r = 1",
    "enclosing_boxes": """WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 13 AS DOUBLE) AS t FROM part), o AS (SELECT *, least(t + 4, s + 5) - greatest(t, s) AS h FROM p)
SELECT id, least(s, t) AS x0, least(t, s) AS y0, greatest(s + 10, t + 8) AS x1, greatest(t + 4, s + 5) AS y1, true AS same, round(CASE WHEN h > 0 THEN h / 4.0 ELSE 0 END, 6) AS overlap FROM o""",
    "newest_rules": f"SELECT template_id, field, rule FROM (SELECT *, row_number() OVER (PARTITION BY template_id, field ORDER BY created_at DESC) AS r FROM {view(RULES)} x) WHERE r = 1",
    "label_slugs": "SELECT p_partkey, substr(trim(regexp_replace(regexp_replace(lower(p_name || ' (No.) -- ' || p_type), '[^a-z0-9_ -]+', '', 'g'), '[ -]+', '_', 'g'), '_'), 1, 60) AS slug FROM part",
    "safe_names": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN regexp_replace(s_name, '[^A-Za-z0-9._ -]', '_', 'g') || '_.pdf' WHEN 1 THEN '_con.txt' WHEN 2 THEN 'file' ELSE regexp_replace(s_name, '[^A-Za-z0-9._ -]', '_', 'g') || '_' END AS name FROM supplier",
    "redacted_maps": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, '[hidden]' AS subject_name, 'mail [email] on [date]' AS note FROM customer",
    "cursors": f"""SELECT id, base64(encode('{{"t":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '","i":"' || id || '"}}')) AS cursor, true AS same FROM {view(ENTRIES)} e""",
}
