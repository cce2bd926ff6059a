"""Queries over files in and out: imports, exports, kinds of files, the audit trail, limits and windows."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.functions.text import formula_guard
from rollkeep.operators import duplicates, export, review
from rollkeep.plans.schema import Field, Schema
from rollkeep.queries import sqltext as S
from rollkeep.sources import delimited, files, records
from rollkeep.sources.adapter import ENTRIES, frame, view

IMPORT = '''
SELECT s_suppkey + 2 AS row_number, CASE WHEN s_suppkey % 17 = 0 THEN ' , ' WHEN s_suppkey % 19 = 0 THEN ',' || s_name
  ELSE 'S-' || CAST(s_suppkey % 60 AS STRING) || ',"' || s_name || ', ""x""",' || CAST(s_nationkey AS STRING) || CASE WHEN s_suppkey % 23 = 0 THEN ',extra' ELSE '' END END AS line
FROM {supplier}
'''
PLAN = delimited.plan_headers(Schema((Field("number", "Certificate number", role="identifier", required=True), Field("name", "Name"), Field("nation", "Nation"))), ["Certificate Number", "name", "NATION"])


def rows(spark: SparkSession, d: str) -> DataFrame:
    return delimited.read_rows(frame(spark, d, IMPORT), PLAN, ",")


def import_rows(spark: SparkSession, d: str) -> DataFrame:
    get = lambda n: F.try_element_at("fields", F.lit(n)).alias(n)
    return rows(spark, d).select("row_number", get("number"), get("name"), get("nation"), "too_many", "too_few")


RECORDS = """
SELECT 'documents' AS path, CAST(floor((doc_id * 2 + CASE WHEN pos >= 2 THEN 1 ELSE 0 END) / 9.0) AS BIGINT) AS block, doc_id * 1000000 + pos AS at, line, ',' AS delimiter FROM (
  SELECT doc_id, posexplode(split(CAST(doc_id AS STRING) || ',"' || source || '",' || CASE WHEN doc_id % 7 = 0 THEN 'bare ""' || lang || '"' ELSE '"' || replace(coalesce(text, ''), '"', '""') || '"' END, '\n')) AS (pos, line) FROM {documents})
UNION ALL SELECT 'documents', CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'number,"nation",name', ','
"""
DOCUMENT_PLAN = delimited.HeaderPlan(("number", "nation", "name"), (), (), ())


def import_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a delimited file whose cells hold line breaks, cut into blocks in the middle of records."""
    held = records.records(frame(spark, d, RECORDS)).withColumnRenamed("record", "line")
    get = lambda n: F.try_element_at("fields", F.lit(n)).alias(n)
    return delimited.read_rows(held, DOCUMENT_PLAN).select("row_number", get("number"), get("nation"), get("name"), "too_many", "too_few", "oversized")


def _done(spark: SparkSession, d: str) -> DataFrame:
    register = frame(spark, d, "SELECT 's' || CAST(r_regionkey AS STRING) AS number_key FROM {region}")
    return delimited.outcomes(rows(spark, d), "number", register)


def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _done(spark, d)


def import_counters(spark: SparkSession, d: str) -> DataFrame:
    return delimited.counters(_done(spark, d))


def import_errors(spark: SparkSession, d: str) -> DataFrame:
    return delimited.first_errors(_done(spark, d), 20).select("row_number", "code")


def formula_guarded(spark: SparkSession, d: str) -> DataFrame:
    t = frame(spark, d, "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || c_name AS v FROM {customer}")
    return t.select("c_custkey", formula_guard(F.col("v")).alias("v"))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, ENTRIES).where("type_id = '3-MEDIUM'")
    values = F.create_map(F.lit("name"), F.col("primary_name"), F.lit("total"), F.concat(F.lit("+"), F.col("batch_id").cast("string")))
    return export.wide(e.withColumns({"fields": values, "extra_fields": F.create_map(F.lit("brand"), F.col("secondary_name"))}), ["name", "total", "missing"], ["brand"])


def export_cells(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "SELECT c_custkey, c_acctbal, c_custkey % 2 = 0 AS flag, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_custkey % 7 AS a, c_custkey % 7 + c_custkey % 2 AS b FROM {customer}")
    return export.cells(e.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").cast("double").alias("balance"), "flag", "segment", export.page_range(F.col("a"), F.col("b")).alias("pages")))


def export_json(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "SELECT n_nationkey, n_name FROM {nation}").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.lit("").alias("remarks"))).alias("row"))


def extra_keys(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "SELECT event_type, props, user_id FROM {events}")
    keyed = F.map_from_arrays(F.array(F.lit("k"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))), F.array(F.lit(""), F.lit("")))
    from rollkeep.operators.counts import distinct_keys

    return distinct_keys(e.withColumn("fields", keyed), "fields", "event_type").select("event_type", F.array_join("keys", ",").alias("keys"))


def audit_sanitised(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "SELECT event_id, event_type, props FROM {events}")
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("name"), F.lit("x"), F.lit("status"), F.repeat("event_type", 60)))
    clean = export.sanitized(m)
    return e.select("event_id", F.try_element_at(clean, F.lit("k")).alias("k"), F.try_element_at(clean, F.lit("name")).alias("name"), F.length(F.try_element_at(clean, F.lit("status"))).cast("long").alias("status_length"))


def rate_window(spark: SparkSession, d: str) -> DataFrame:
    """How many requests each user made in the hour up to each request."""
    e = frame(spark, d, "SELECT event_id, user_id, ts FROM {events}").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    held = W.partitionBy("user_id").orderBy("s").rangeBetween(-3_600_000_000 + 1, 0)
    return e.select("event_id", F.count("*").over(held).alias("requests"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "SELECT * FROM {events}")
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "SELECT * FROM {events}")
    s = e.groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = frame(spark, d, "SELECT doc_id, source, text FROM {documents}").withColumn("digest", files.content_hash(F.col("text"))).drop("text")
    return duplicates.first_copies(docs, ["source"], "digest", ["doc_id"], "doc_id").select("doc_id", "source", "duplicate_of")


def duplicate_fan_out(spark: SparkSession, d: str) -> DataFrame:
    docs = frame(spark, d, "SELECT doc_id AS document_id, text FROM {documents}").withColumn("digest", files.content_hash(F.col("text"))).drop("text")
    firsts = duplicates.first_copies(docs, [], "digest", ["document_id"], "document_id")
    units = docs.join(firsts.where("duplicate_of is null").select("document_id"), "document_id", "left_semi").select("document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    return duplicates.fan_out(firsts, units).select("document_id", F.col("ordinal").cast("long").alias("ordinal"))


def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    head = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'PK' || chr(3) || chr(4) WHEN 2 THEN 'BM..' WHEN 3 THEN 'GIF89a' WHEN 4 THEN 'RIFF1234WEBP' ELSE props END AS head FROM {events}"
    return frame(spark, d, head).select("event_id", files.file_kind(F.col("head").cast("binary"), F.lit("x.bin")).alias("kind"))


def _packed(batches):
    """(id, name, content): an archive of each text, with another archive and a member that leads out."""
    for batch in batches:
        rows = []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            inner, outer = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("id.txt", str(i))
            with zipfile.ZipFile(outer, "w") as z:
                for name, content in (("texts/a.txt", text or ""), ("in.zip", inner.getvalue()), ("../out.txt", "x")):
                    z.writestr(name, content)
            rows.append({"id": i, "name": f"{i}.zip", "content": outer.getvalue()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("name", pa.string()), ("content", pa.binary())]))


def archive_contents(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed into archives within archives, and unpacked."""
    texts = frame(spark, d, "SELECT doc_id AS id, text FROM {documents}")
    found = files.expanded(texts.mapInArrow(_packed, "id long, name string, content binary"))
    return found.where("kind <> 'zip' or problem is not null").select("root", "path", F.col("depth").cast("long").alias("depth"), "bytes", "digest", "problem")


def upload_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "SELECT l_orderkey AS upload_id, CAST((l_linenumber - 1) * 10 AS BIGINT) AS at, CAST(10 AS BIGINT) AS length, CAST(40 AS BIGINT) AS total FROM {lineitem}").where("at < 40")
    return files.assembled(c, 10)


def image_frames(spark: SparkSession, d: str) -> DataFrame:
    i = frame(spark, d, "SELECT n_nationkey AS id, n_nationkey % 4 AS n FROM {nation}")
    return files.frames(i, "n").select("id", F.col("page_number").cast("long").alias("page_number"), "text", "needs_ocr")


def answer_cache(spark: SparkSession, d: str) -> DataFrame:
    wanted = frame(spark, d, "SELECT doc_id, text FROM {documents}").select("doc_id", F.sha2(F.concat(F.lit("model|"), F.coalesce("text", F.lit(""))), 256).alias("key"))
    cache = wanted.where("doc_id % 3 = 0").select("key").distinct().withColumn("answer", F.substring("key", 1, 8))
    hit, miss = export.cached(wanted, cache, ["key"])
    return hit.select("doc_id", "answer").unionByName(miss.select("doc_id", F.lit(None).cast("string").alias("answer")))


def review_actions(spark: SparkSession, d: str) -> DataFrame:
    a = frame(spark, d, "SELECT user_id AS id, event_id AS at, CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'correct' WHEN 'error' THEN 'void' WHEN 'signup' THEN 'settle' ELSE 'note' END AS action FROM {events}")
    return review.folded(a)


def revision_changes(spark: SparkSession, d: str) -> DataFrame:
    r = frame(spark, d, "SELECT user_id AS id, event_id AS version, event_type AS value FROM {events}")
    return review.revision_changes(r, "id", "version", "value").groupBy("id").agg(F.count_if("changed").alias("changes"))


QUERIES = {
    "import_rows": import_rows, "import_records": import_records, "import_outcomes": import_outcomes, "import_counters": import_counters, "import_errors": import_errors, "formula_guard": formula_guarded, "export_rows": export_rows, "export_cells": export_cells, "export_json": export_json,
    "extra_keys": extra_keys, "audit_sanitise": audit_sanitised, "rate_window": rate_window, "event_windows": event_windows, "user_sessions": user_sessions, "content_dedupe": content_dedupe, "duplicate_fan_out": duplicate_fan_out,
    "file_kinds": file_kinds, "upload_chunks": upload_chunks, "archive_contents": archive_contents, "image_frames": image_frames, "answer_cache": answer_cache, "review_actions": review_actions, "revision_changes": revision_changes,
}

_ROWS = """r AS (SELECT s_suppkey + 2 AS row_number, s_suppkey % 17 = 0 AS blank, s_suppkey % 19 = 0 AS bare, s_suppkey % 23 = 0 AS more, 'S-' || s_suppkey % 60 AS number, s_name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier),
k AS (SELECT row_number, CASE WHEN NOT bare THEN number END AS number, CASE WHEN bare THEN s_name ELSE s_name || ', "x"' END AS name, CASE WHEN NOT bare THEN nation END AS nation, NOT bare AND more AS too_many, bare AS too_few FROM r WHERE NOT blank)"""
_OUT = _ROWS + """, h AS (SELECT *, lower(replace(coalesce(number, ''), '-', '')) AS key, CASE WHEN too_many THEN 'extra_columns' WHEN number IS NULL THEN 'missing_identifier' END AS bad FROM k),
f AS (SELECT *, min(row_number) FILTER (bad IS NULL) OVER (PARTITION BY key) AS first FROM h),
o AS (SELECT row_number, key, CASE WHEN bad IS NOT NULL THEN 'failed' WHEN coalesce(row_number > first, false) OR key IN ('s0', 's1', 's2', 's3', 's4') THEN 'skipped' ELSE 'created' END AS outcome,
 coalesce(bad, CASE WHEN coalesce(row_number > first, false) OR key IN ('s0', 's1', 's2', 's3', 's4') THEN 'duplicate_number' END) AS code FROM f)"""

SQL = {
    "import_rows": f"WITH {_ROWS} SELECT * FROM k",
    "import_records": """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) + 1 AS row_number, CAST(doc_id AS VARCHAR) AS number, source AS nation,
 trim(CASE WHEN doc_id % 7 = 0 THEN 'bare ""' || lang || '"' ELSE coalesce(text, '') END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS name FROM documents)
SELECT row_number, number, nation, nullif(substr(name, 1, 4000), '') AS name, false AS too_many, false AS too_few, length(name) > 4000 AS oversized FROM d""",
    "import_outcomes": f"WITH {_OUT} SELECT * FROM o",
    "import_counters": f"WITH {_OUT} SELECT count(*) AS total, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, CASE WHEN count(*) FILTER (outcome <> 'created') > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM o",
    "import_errors": f"WITH {_OUT} SELECT row_number, code FROM o WHERE code IS NOT NULL ORDER BY row_number LIMIT 20",
    "formula_guard": "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN '''' ELSE '' END || CASE c_custkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || c_name AS v FROM customer",
    "export_rows": f"SELECT id, primary_name AS name, '''+' || batch_id AS total, '' AS missing, secondary_name AS extra_brand FROM {view(ENTRIES)} e WHERE type_id = '3-MEDIUM'",
    "export_cells": "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || printf('%.2f', c_acctbal) AS balance, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 7 AS VARCHAR) ELSE c_custkey % 7 || '-' || (c_custkey % 7 + 1) END AS pages FROM customer",
    "export_json": "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"remarks\":\"\"}' AS row FROM nation",
    "extra_keys": "SELECT event_type, array_to_string(list_sort(list(DISTINCT k)), ',') AS keys FROM (SELECT event_type, unnest(['k', 'u' || user_id % 3]) AS k FROM events) GROUP BY 1",
    "audit_sanitise": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS name, least(200, length(event_type) * 60) AS status_length FROM events",
    "rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS requests FROM events",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
    "content_dedupe": "SELECT doc_id, source, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS first FROM documents)",
    "duplicate_fan_out": "SELECT doc_id AS document_id, o AS ordinal FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents), (SELECT unnest([0::BIGINT, 1::BIGINT]) AS o) WHERE first <> doc_id",
    "file_kinds": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'bmp' WHEN 3 THEN 'gif' WHEN 4 THEN 'webp' ELSE 'unknown' END AS kind FROM events",
    "archive_contents": """SELECT doc_id AS root, doc_id || '.zip!texts/a.txt' AS path, 1::BIGINT AS depth, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS digest, NULL AS problem FROM documents
UNION ALL SELECT doc_id, doc_id || '.zip!in.zip!id.txt', 2, strlen(CAST(doc_id AS VARCHAR)), sha256(CAST(doc_id AS VARCHAR)), NULL FROM documents UNION ALL SELECT doc_id, doc_id || '.zip!../out.txt', 1, 1, NULL, 'path' FROM documents""",
    "upload_chunks": "WITH c AS (SELECT DISTINCT l_orderkey AS upload_id, (l_linenumber - 1) * 10 AS p FROM lineitem WHERE l_linenumber <= 4), r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY p) - 1 AS k FROM c) SELECT upload_id, CAST(sum(CASE WHEN p = k * 10 THEN 10 ELSE 0 END) AS BIGINT) AS received, sum(CASE WHEN p = k * 10 THEN 10 ELSE 0 END) = 40 AS complete FROM r GROUP BY 1",
    "image_frames": "SELECT n_nationkey AS id, p AS page_number, '' AS text, true AS needs_ocr FROM (SELECT n_nationkey, unnest(range(1, greatest(1, n_nationkey % 4) + 1)) AS p FROM nation)",
    "answer_cache": "WITH w AS (SELECT doc_id, sha256('model|' || coalesce(text, '')) AS key FROM documents) SELECT doc_id, CASE WHEN key IN (SELECT key FROM w WHERE doc_id % 3 = 0) THEN substr(key, 1, 8) END AS answer FROM w",
    "review_actions": """WITH a AS (SELECT user_id AS id, event_id AS p, event_type AS t FROM events), f AS (SELECT id, min(p) FILTER (t = 'error') AS voided, min(p) FILTER (t = 'signup') AS settled FROM a GROUP BY 1),
x AS (SELECT a.*, voided, settled FROM a JOIN f USING (id))
SELECT id, CASE WHEN max(voided) IS NOT NULL THEN 'VOID' WHEN bool_or(t = 'click' AND p > settled) THEN 'APPROVED' WHEN max(settled) IS NOT NULL THEN 'OPEN' ELSE 'SUSPECTED' END AS status, count(*) FILTER (t = 'view' AND p < coalesce(voided, p + 1)) + 1 AS version FROM x GROUP BY 1""",
    "revision_changes": "WITH r AS (SELECT user_id AS id, event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT id, count(*) FILTER (changed) AS changes FROM r GROUP BY 1",
}
