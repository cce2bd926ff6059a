"""Queries over the read path: text forms, values, splitting, classifying, extracting, validating, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.functions import text as T
from rollkeep.functions import values as V
from rollkeep.operators import counts, extract, layout, split, validate
from rollkeep.plans.schema import Field, Schema, changed_keys, draft, draft_problems, exploded, patched
from rollkeep.queries import sqltext as S
from rollkeep.sources.adapter import ENTRIES, PAGES, frame, view

DATES = """
SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || CAST(year(o_orderdate) AS STRING)
  WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING)
  WHEN 2 THEN CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) AS STRING) || '.' || CAST(year(o_orderdate) AS STRING)
  WHEN 3 THEN '31-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(year(o_orderdate) AS STRING)
  WHEN 4 THEN CAST(day(o_orderdate) AS STRING) || ' - ' || CAST(month(o_orderdate) AS STRING) || ' - ' || CAST(year(o_orderdate) % 100 AS STRING)
  ELSE 'no date ' || CAST(o_orderkey AS STRING) END AS printed
FROM {orders}
"""
RECORDS = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'D-' || CAST(o_orderkey AS STRING) END AS certificate_number,
  CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 31 = 0 THEN '2190-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_of_death,
  CAST(year(o_orderdate) - o_orderkey % 100 + CASE WHEN o_orderkey % 41 = 0 THEN 120 ELSE 0 END AS STRING) || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 5) AS date_of_birth,
  CASE WHEN o_orderkey % 13 = 0 THEN '31-02-1999' WHEN o_orderkey % 9 = 0 THEN '1990-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS registration_date,
  CASE WHEN o_orderkey % 37 = 0 THEN 'old' ELSE CAST(o_orderkey % 140 AS STRING) END AS age,
  CASE o_orderkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'female.' WHEN 2 THEN 'unknown' WHEN 3 THEN 'a boy' ELSE '' END AS sex,
  lpad(CAST(o_custkey AS STRING), 5, '0') || '-' || lpad(CAST(o_orderkey AS STRING), 7, '0') || '-1' AS id_a,
  CASE WHEN o_orderkey % 7 = 0 THEN lpad(CAST(o_custkey AS STRING), 5, '0') || '-' || lpad(CAST(o_orderkey AS STRING), 7, '0') || '-1' WHEN o_orderkey % 10 = 0 THEN '12345' ELSE '' END AS id_b,
  CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0.9 END AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'llm' ELSE 'rule' END AS method
FROM {orders}
"""
SCHEMA = Schema(
    (
        Field("certificate_number", "Certificate number", "reference", "identifier", True),
        Field("date_of_death", "Date of death", "date", "death_date", True),
        Field("date_of_birth", "Date of birth", "date", "birth_date"),
        Field("registration_date", "Registration date", "date", "registration_date"),
        Field("age", "Age", "number", "age"),
        Field("sex", "Sex", "sex"),
        Field("id_a", "Identity number", "id_number"),
        Field("id_b", "Informant's number", "id_number"),
    )
)
NAMES = [f.name for f in SCHEMA.fields]
TODAY = "2024-01-01"
WORDS = {"en": {"the ": 3.0, "and ": 1.0, "that ": 2.0}, "de": {"der ": 3.0, "und ": 2.0, "die ": 1.0}, "fr": {"les ": 3.0, "que ": 1.0, "est ": 2.0}, "es": {"los ": 3.0, "para ": 2.0, "las ": 1.0}}
HEADS, NUMS = ("(?i)^[a-z]*th",), ("(?i)\\bof\\s+([A-Za-z]{4,})",)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "SELECT doc_id, text, lang, source FROM {documents}")


def as_pages(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")


def records(spark: SparkSession, d: str) -> DataFrame:
    r = frame(spark, d, RECORDS)
    as_map = lambda f: F.map_from_arrays(F.array(*[F.lit(n) for n in NAMES]), F.array(*[f(n) for n in NAMES]))
    return r.select(
        "id",
        as_map(F.col).alias("fields"),
        F.create_map(F.lit("date_of_death"), F.lit("03-04-2019"), F.lit("x"), F.lit("")).alias("printed"),
        as_map(lambda n: F.col("confidence").cast("double")).alias("confidences"),
        as_map(lambda n: F.col("method")).alias("methods"),
        F.lit(0.9).cast("double").alias("type_confidence"),
        F.lit(0.8).cast("double").alias("boundary_confidence"),
        (F.col("id") % 8 == 0).alias("ocr_used"),
        ((F.col("id") % 80) * 1.0).cast("double").alias("ocr_confidence"),
    )


def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, DATES).withColumn("r", V.read_date(F.col("printed"))).select("id", "printed", "r.*")


def time_normalise(spark: SparkSession, d: str) -> DataFrame:
    clock = "SELECT event_id, CAST(event_id % 14 AS STRING) || CASE event_id % 3 WHEN 0 THEN ':' WHEN 1 THEN '.' ELSE ' : ' END || lpad(CAST(event_id % 70 AS STRING), 2, '0') || CASE event_id % 4 WHEN 0 THEN ' pm' WHEN 1 THEN ' A.M.' ELSE '' END AS printed FROM {events}"
    return frame(spark, d, clock).select("event_id", V.read_time(F.col("printed")).alias("time"))


def cnic_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit(" "), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit(" 9"))).otherwise(F.concat(F.lit("id "), F.col("o_orderkey").cast("string")))
    return frame(spark, d, "SELECT * FROM {orders}").select("o_orderkey", V.format_cnic(raw).alias("cnic"))


def number_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("PKR "), F.format_number("o_totalprice", 2), F.lit(" only"))
    return frame(spark, d, "SELECT o_orderkey, o_totalprice FROM {orders}").select("o_orderkey", V.read_number(raw).alias("amount"))


def sex_normalise(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, RECORDS).select("id", V.read_sex(F.col("sex")).alias("sex"))


def age_years(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders}")
    return e.select("o_orderkey", V.age_in_years(F.lit("1960-02-29").cast("date"), F.col("day")).cast("long").alias("age"))


def language_tag(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.detect_language(F.col("text")).alias("language"))


def normal_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("digest"))


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Dr. Syed ' WHEN 1 THEN 'Mrs ' ELSE '' END || c_name || ' Malik' AS name FROM {customer}").select("c_custkey", T.name_key(F.col("name")).alias("name_key"), T.number_key(F.col("name")).alias("number_key"), T.slug(F.col("name")).alias("slug"))


def shared_names(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "SELECT p_partkey, p_name FROM {part}")
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.concat(F.lit("Mr "), F.col("p_name"), F.lit(" ring")).alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", T.shares_a_name(F.col("p_name"), F.col("other")).alias("shares"))


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.sha2(T.redact(F.col("text"), 300), 256).alias("digest"))


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    words = frame(spark, d, "SELECT lower(text) AS text FROM {benchmark}").select(F.explode(F.split("text", "[^\\p{L}]+")).alias("word"))
    return extract.text_quality(as_pages(spark, d), words.where("word <> ''")).drop("page_number")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return extract.fingerprints(as_pages(spark, d))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return extract.lines_of(as_pages(spark, d)).groupBy("document_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.count("next_text").alias("followed"))


def page_layout(spark: SparkSession, d: str) -> DataFrame:
    """Messages set in rows of six words in two columns, English, Urdu and numbers mixed."""
    words = frame(spark, d, "SELECT conv_id AS document_id, turn AS page_number, posexplode(filter(split(text, '[ \\\\t\\\\n]+'), w -> w <> '')) AS (k, word) FROM {conversations}")
    row, slot = F.floor(F.col("k") / 6), F.col("k") % 6
    urdu = F.when((F.col("k") + F.col("page_number")) % 5 == 0, "نام").when((F.col("k") + F.col("page_number")) % 5 == 3, "علی").when((F.col("k") + F.col("page_number")) % 5 == 4, F.col("k").cast("string"))
    top = (row * 20 + F.floor(row / 11) * 40 + F.col("k") * 7 % 3).cast("double")
    left = (slot * 40 + F.when(slot >= 3, 60).otherwise(0)).cast("double")
    placed = words.select("document_id", "page_number", F.coalesce(urdu, "word").alias("text"), left.alias("x0"), top.alias("y0"), (left + 30).alias("x1"), (top + 10).alias("y1"))
    return layout.lines(placed)


#: Documents with licence lines as poor scans leave them.
SCANNED = """SELECT doc_id AS document_id, 1 AS page_number, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'Licensed under', 'Licens3d undor') WHEN 2 THEN replace(replace(text, 'Licensed', 'icensed'), 'License, Version', 'Licence. Versi0n') ELSE replace(text, 'the', 'thc') END
 || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Licensed under the' || chr(10) || 'terms of ' || source WHEN doc_id % 3 = 1 THEN chr(10) || 'anguage - ' || lang ELSE '' END AS text FROM {documents}"""
LABELS = {"licence": ("licensed under the", "licensed under"), "licence_version": ("license, version",), "language": ("language",), "article": ("the",)}


def labelled_fields(spark: SparkSession, d: str) -> DataFrame:
    lines = extract.lines_of(frame(spark, d, SCANNED))
    return extract.labelled(lines, LABELS, {"licence_version": "number"}, damaged=85.0).select("document_id", "field", "value", "confidence")


#: Documents under titles as poor scans leave them.
TITLED = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Certificate of Birth' WHEN 1 THEN 'Office 12' || chr(10) || 'Certif1cate of Birth' WHEN 2 THEN 'Cert1ficate 0f Deat' WHEN 3 THEN 'ertificate of Marriage No. 7' WHEN 4 THEN 'NIKAH NAMA, cause of death' WHEN 5 THEN 'Certificate' ELSE '' END
 || chr(10) || coalesce(text, '') AS text FROM {documents}"""


def classify_titles(spark: SparkSession, d: str) -> DataFrame:
    return split.classified(frame(spark, d, TITLED)).select("doc_id", "class.*")


def extra_fields(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "SELECT event_id AS document_id, event_type || ' kind: value ' || CAST(user_id AS STRING) || chr(10) || 'Date of birth: 1999' || chr(10) || 'user note: ' || props AS text FROM {events}").withColumn("page_number", F.lit(1))
    return extract.extra_fields(extract.lines_of(p), ["date of birth", "error kind"])


def template_fields(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "SELECT event_id AS document_id, 'Type: ' || event_type || chr(10) || 'User' || chr(10) || CAST(user_id AS STRING) AS text, event_type AS fingerprint FROM {events}").withColumn("page_number", F.lit(1))
    rules = spark.createDataFrame([(k, "kind", "type", "after", None) for k in ("click", "view")] + [("click", "user", "user", "below", "^[0-9]+$"), ("error", "user", "user", "below", "^[0-9]$")], "fingerprint string, field string, anchor string, where string, pattern string")
    lines = extract.lines_of(p).join(p.select("document_id", "fingerprint"), "document_id")
    return extract.applied(lines, rules)


def learned_rules(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d, "SELECT event_id AS document_id, 'Kind of event: ' || event_type || chr(10) || 'Person' || chr(10) || 'U' || CAST(user_id AS STRING) AS text FROM {events}").withColumn("page_number", F.lit(1))
    fixes = frame(spark, d, "SELECT event_id AS document_id, 'kind' AS field, event_type AS value FROM {events} WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'person', 'U' || CAST(user_id AS STRING) FROM {events} WHERE event_id % 2 = 1")
    return extract.learned(extract.lines_of(p), fixes)


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return split.boundaries(split.summaries(frame(spark, d, PAGES), HEADS, NUMS))


def page_range_join(spark: SparkSession, d: str) -> DataFrame:
    pages = frame(spark, d, PAGES)
    units = split.boundaries(split.summaries(pages, HEADS, NUMS))
    return split.pages_of_units(units, pages).groupBy("document_id", "ordinal").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def unit_renumber(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("document_id").orderBy("page_number")) - 1
    end = F.coalesce(F.lead("page_number").over(W.partitionBy("document_id").orderBy("page_number")) - 1, F.max("page_number").over(W.partitionBy("document_id")))
    return frame(spark, d, PAGES).where("role = 'user'").select("document_id", place.cast("long").alias("ordinal"), F.col("page_number").alias("page_start"), end.cast("long").alias("page_end"))


def classify(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", split.classify(F.col("text"), WORDS).alias("c")).select("doc_id", "c.*")


def unit_reading(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "SELECT conv_id AS unit_id, turn + 1 AS page_number, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) * 1.0 END AS confidence, turn = 5 AS needed_ocr, CASE WHEN turn = 0 THEN '' ELSE role END AS language FROM {conversations}")
    return counts.unit_reading(rows.withColumn("confidence", F.col("confidence").cast("double")))


def ocr_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "SELECT user_id, event_id AS attempt, value AS confidence, event_id % 10 / 10.0 AS hit_rate FROM {events}")
    return extract.best_attempts(rows.withColumns({"confidence": F.col("confidence").cast("double"), "hit_rate": F.col("hit_rate").cast("double")}), "user_id")


def merge_layers(spark: SparkSession, d: str) -> DataFrame:
    li = frame(spark, d, "SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag || CAST(l_linenumber AS STRING) END AS a, l_tax * 10 AS ca, l_linestatus || CAST(l_partkey AS STRING) AS b, l_discount * 10 AS cb, l_linenumber, l_partkey, l_suppkey FROM {lineitem}")
    layer = lambda v, c: F.struct(F.col(v).alias("value"), F.round(F.col(c).cast("double"), 4).alias("confidence"))
    return li.withColumn("m", validate.merged_layers(F.array(layer("a", "ca"), layer("b", "cb")))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "m.value", "m.confidence")


def verified_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", "text", F.concat(F.substring_index("text", " ", 2), F.when(F.col("doc_id") % 3 == 0, F.lit(" zzz")).otherwise(F.lit(""))).alias("answer"))
    return rows.select("doc_id", validate.verified(F.col("answer"), F.col("text")).alias("verified"))


def row_score_route(spark: SparkSession, d: str) -> DataFrame:
    v = validate.validated(records(spark, d), SCHEMA, F.lit(TODAY).cast("date"))
    return v.select("id", F.array_join("flags", ",").alias("flags"), "score", "status")


def row_issues(spark: SparkSession, d: str) -> DataFrame:
    v = validate.validated(records(spark, d), SCHEMA, F.lit(TODAY).cast("date"))
    return v.select("id", F.inline_outer("issues")).where("flag is not null").groupBy("field", "flag").agg(F.count("*").alias("n"))


def register_draft(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", *[c.alias(n) for n, c in draft(SCHEMA).items() if n in ("number", "event_date", "fileable")])


def dates_exploded(spark: SparkSession, d: str) -> DataFrame:
    return exploded(records(spark, d), SCHEMA, ("death_date", "birth_date"), "id").withColumn("position", F.col("position").cast("long"))


def row_correction(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).withColumn("change", F.map_from_arrays(F.array(F.lit("sex"), F.lit("age")), F.array(F.when(F.col("id") % 2 == 0, F.lit("F")), F.lit("44"))))
    new = patched(F.col("fields"), F.col("change"))
    return r.withColumn("new", new).select("id", F.array_join(changed_keys(F.col("fields"), F.col("new")), ",").alias("changed"), F.try_element_at("new", F.lit("age")).alias("age"), F.try_element_at("new", F.lit("sex")).alias("sex"))


def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    fields = frame(spark, d, "SELECT p_brand AS schema_id, CASE WHEN p_size % 9 = 0 THEN p_name ELSE lower(p_type) || CAST(p_size AS STRING) END AS name, CASE WHEN p_size = 1 THEN ' ' ELSE p_type END AS label, p_size % 2 = 0 AS searchable, CASE WHEN p_size = 7 THEN 'identifier' WHEN p_size % 3 = 0 THEN 'none' ELSE 'subject' END AS role FROM {part}")
    return draft_problems(fields)


def accuracy_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    o = frame(spark, d, "SELECT CAST(o_orderkey % 20 AS STRING) AS document, o_orderpriority AS field, o_orderstatus AS expected, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END END AS actual FROM {orders}")
    return counts.accuracy(o)


QUERIES = {
    "date_normalise": date_normalise, "time_normalise": time_normalise, "cnic_normalise": cnic_normalise, "number_normalise": number_normalise, "sex_normalise": sex_normalise, "age_years": age_years,
    "language_tag": language_tag, "normal_text": normal_text, "name_keys": name_keys, "shared_names": shared_names, "redacted_documents": redacted_documents, "text_quality": text_quality,
    "form_fingerprints": fingerprints, "page_lines": page_lines, "page_layout": page_layout, "labelled_fields": labelled_fields, "classify_titles": classify_titles, "extra_fields": extra_fields, "template_fields": template_fields, "learned_rules": learned_rules,
    "split_boundaries": boundaries, "page_range_join": page_range_join, "unit_renumber": unit_renumber, "classify_keywords": classify, "unit_reading": unit_reading, "ocr_selection": ocr_selection,
    "merge_layers": merge_layers, "verified_answers": verified_answers, "row_score_route": row_score_route, "row_issues": row_issues, "register_draft": register_draft, "dates_exploded": dates_exploded,
    "row_correction": row_correction, "schema_problems": schema_problems, "accuracy_scoreboard": accuracy_scoreboard,
}

R = view(RECORDS)
_D = "try_cast({} AS DATE)"
_ISO = "regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')"
_LINES = "list_filter(regexp_split_to_array({}, '\\r\\n|[\\n\\r]'), lambda x: trim(x, ' ') <> '')"


def _checked() -> str:
    """CTEs: rows with their list of issues."""
    c: list[str] = []
    add = lambda test, field, flag: c.append(f"CASE WHEN {test} THEN {{'field': '{field}', 'flag': {flag}}} END")
    empty = " AND ".join(f"trim({n}) = ''" for n in NAMES)
    add(empty, "", "'NO_FIELDS_EXTRACTED'")
    for n in ("certificate_number", "date_of_death"):
        add(f"NOT ({empty}) AND trim({n}) = ''", n, "'MISSING_REQUIRED'")
    for n in ("date_of_death", "date_of_birth", "registration_date"):
        add(f"{n} <> '' AND d_{n} IS NULL", n, f"CASE WHEN regexp_matches({n}, '^[0-9]+-[0-9]+-[0-9]+$') THEN 'DATE_IMPOSSIBLE' ELSE 'DATE_UNPARSEABLE' END")
        add(f"d_{n} > DATE '{TODAY}'", n, "'DATE_IN_FUTURE'")
        if n == "date_of_death":
            add(f"d_{n} IS NOT NULL", n, "'DATE_AMBIGUOUS'")
    add("d_date_of_birth > d_date_of_death", "date_of_death", "'DOD_BEFORE_DOB'")
    add("coalesce(d_date_of_death, d_date_of_birth) > d_registration_date", "registration_date", "'REGISTRATION_BEFORE_EVENT'")
    add("age <> '' AND try_cast(age AS DOUBLE) IS NULL", "age", "'VALUE_TRUNCATED'")
    lived = "(year(d_date_of_death) - year(d_date_of_birth) - CASE WHEN month(d_date_of_death) < month(d_date_of_birth) OR (month(d_date_of_death) = month(d_date_of_birth) AND day(d_date_of_death) < day(d_date_of_birth)) THEN 1 ELSE 0 END)"
    add(f"try_cast(age AS DOUBLE) > 130 OR abs({lived} - try_cast(age AS DOUBLE)) > 1", "age", "'AGE_INCONSISTENT'")
    shape = "regexp_matches({}, '^[0-9]{{5}}-[0-9]{{7}}-[0-9]$')"
    add(f"id_a <> '' AND NOT {shape.format('id_a')}", "id_a", "'CNIC_INVALID'")
    add(f"id_b <> '' AND NOT {shape.format('id_b')}", "id_b", "'CNIC_INVALID'")
    add(f"{shape.format('id_b')} AND {shape.format('id_a')} AND id_a = id_b", "id_b", "'DUPLICATE_ID_IN_ROW'")
    add("sex = 'unknown'", "sex", "'SEX_UNRECOGNISED'")
    add("id % 8 = 0 AND id % 80 = 0", "", "'OCR_EMPTY'")
    add("id % 8 = 0 AND id % 80 > 0 AND id % 80 < 60", "", "'LOW_OCR_CONFIDENCE'")
    for n in NAMES:
        add(f"{n} <> '' AND confidence < 0.6", n, "'LOW_FIELD_CONFIDENCE'")
    days = ", ".join(f"CASE WHEN {_ISO.format(n)} THEN {_D.format(n)} END AS d_{n}" for n in ("date_of_death", "date_of_birth", "registration_date"))
    return f"r AS (SELECT *, {days} FROM {R} z), i AS (SELECT *, list_filter([{', '.join(c)}], lambda x: x IS NOT NULL) AS issues FROM r)"


SERIOUS = ", ".join(f"'{x}'" for x in validate.SERIOUS)
_WEIGHTED = " + ".join(f"CASE WHEN {n} <> '' THEN {3.0 if f.required else 1.0}::DOUBLE * CAST(confidence AS DOUBLE) * CASE method WHEN 'llm' THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END ELSE 0.0::DOUBLE END" for n, f in zip(NAMES, SCHEMA.fields, strict=True))
_TOTAL = sum(3.0 if f.required else 1.0 for f in SCHEMA.fields)


def _class_sql(words: dict[str, dict[str, float]] = WORDS, source: str = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)", damaged: bool = False) -> str:
    """Classes by weighted phrases; with ``damaged`` also by titles that the heading's lines are like."""
    scores, titles = [], [(k, p) for k, phrases in words.items() for p, w in phrases.items() if w >= split.TITLE]
    q = lambda p: "'" + p.replace("'", "''") + "'"
    for kind, phrases in words.items():
        added = f" + CASE WHEN kind = '{kind}' AND NOT contains(low, name) THEN 6.0 ELSE 0.0 END" if damaged else ""
        scores.append(" + ".join(f"CASE WHEN contains(head, {q(p)}) THEN {2 * w} WHEN contains(low, {q(p)}) THEN {w} ELSE 0.0 END" for p, w in phrases.items()) + added)
    structs = ", ".join(f"{{'score': CAST({s} AS DOUBLE), 'rank': {-i}, 'type': '{k}'}}" for i, (k, s) in enumerate(zip(words, scores, strict=True)))
    named = ", ".join(f"({i}, '{k}', {q(p)})" for i, (k, p) in enumerate(titles))
    like = f"""tl AS (SELECT doc_id, unnest(range(len(hl))) AS pos, trim(unnest(hl), ' ') AS low FROM h WHERE head <> ''), tw AS (SELECT * FROM tl WHERE length(low) >= 8),
{S.likeness("tw", [p for _, p in titles], 85)},
tn AS (SELECT * FROM (VALUES {named}) t(i, kind, name)), tb AS (SELECT doc_id, kind, name, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN contains(low, name) THEN 1 ELSE ratio END DESC, tw.pos, i) AS place FROM tw JOIN lk USING (low) JOIN tn USING (name)),
hh AS (SELECT h.*, kind, name FROM h LEFT JOIN (SELECT * FROM tb WHERE place = 1) USING (doc_id)),""" if damaged else "hh AS (SELECT * FROM h),"
    return f"""WITH t AS (SELECT doc_id, lower(text) AS low, {_LINES.format("lower(text)")} AS l FROM {source}),
h AS (SELECT *, array_to_string(hl, chr(10)) AS head FROM (SELECT doc_id, low, CASE WHEN len(l) >= 3 THEN l[1:CAST(greatest(1, least(6, len(l) // 3)) AS INT)] ELSE [] END AS hl FROM t)),
{like}
s AS (SELECT doc_id, list_reverse_sort([{structs}]) AS r FROM hh),
x AS (SELECT doc_id, r[1] AS a, r[2] AS b FROM s)
SELECT doc_id, CASE WHEN a.score > 0 AND a.score - b.score >= 1.5 THEN a.type ELSE 'OTHER' END AS type,
 CASE WHEN a.score > 0 AND a.score - b.score >= 1.5 THEN least(0.98, round(least(1.0, a.score / 10.0) * (2 * a.score / (a.score + b.score) - 1), 4)) ELSE 0.0 END AS confidence, a.score AS top, b.score AS second FROM x"""


def _labelled_sql() -> str:
    """Labelled values: the label that explains most of a line, at its last place or most like; the rest of the line or the next one; the best reading of each field."""
    held = ", ".join(f"('{f}', '{n}', {len(n)})" for f, names in LABELS.items() for n in names)
    sep, under = ":=.\\-–—", " OR ".join(f"contains(lower(next_text), '{n}')" for names in LABELS.values() for n in names)
    tidy = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '^[\\s{sep}/|]+', ''), '[\\s{sep}/|]+$', ''), '^(?:[^0-9\\s]\\s+)+', '')"
    return f"""WITH p AS (SELECT document_id, {_LINES.format("text")} AS l FROM {view(SCANNED)} s),
t AS (SELECT document_id, line, l[line + 1] AS text, l[line + 2] AS next_text, lower(l[line + 1]) AS low FROM (SELECT document_id, l, unnest(range(len(l))) AS line FROM p)),
{S.likeness("t", [n for names in LABELS.values() for n in names], 85)},
f AS (SELECT * FROM (VALUES {held}) t(field, name, n)),
m AS (SELECT t.*, field, name, n, length(low) - position(reverse(name) IN reverse(low)) - n + 2 AS pos, n AS length, 1.0::DOUBLE AS ratio FROM t, f WHERE contains(low, name)
 UNION ALL SELECT t.*, field, f.name, n, pos, length, ratio FROM t JOIN lk ON t.low = lk.low JOIN f ON f.name = lk.name WHERE NOT contains(t.low, f.name)),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id, line, field ORDER BY ratio * n DESC, pos, name) AS place FROM m WHERE n > 7 OR trim(regexp_replace(substr(low, 1, pos - 1), '[\\s{sep}/|()\\[\\]]+', '', 'g'), ' ') = ''),
r AS (SELECT *, substr(text, pos + length) AS rest FROM o WHERE place = 1),
v AS (SELECT *, {tidy("rest")} AS here, {tidy("coalesce(next_text, '')")} AS below FROM r),
w AS (SELECT *, CASE WHEN here <> '' THEN here WHEN below <> '' AND NOT ({under}) THEN below END AS value, round(CASE WHEN here = '' THEN 0.8::DOUBLE WHEN regexp_matches(rest, '^\\s*[{sep}/|]') THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END * ratio, 4) AS confidence FROM v),
k AS (SELECT * REPLACE (CASE WHEN field = 'licence_version' THEN nullif(trim(regexp_extract(value, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ' '), '') ELSE value END AS value) FROM w)
SELECT document_id, field, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field ORDER BY ratio >= 1 DESC, ratio * n DESC, confidence DESC, line) AS best FROM k WHERE value IS NOT NULL) WHERE best = 1"""


_SUMMARY = f"""p AS (SELECT document_id, page_number, {_LINES.format('text')} AS l, text FROM {view(PAGES)} q),
hd AS (SELECT *, array_to_string(l[1:CAST(greatest(1, least(6, round_even(len(l) * 0.35, 0))) AS INT)], chr(10)) AS top FROM p),
s AS (SELECT document_id, page_number, regexp_matches(top, '(?i)^[a-z]*th') AS heading,
  coalesce(nullif(regexp_extract(top, '(?i)\\bof\\s+([A-Za-z]{{4,}})', 1), ''), nullif(regexp_extract(text, '(?i)\\bof\\s+([A-Za-z]{{4,}})', 1), '')) AS number FROM hd),
c AS (SELECT *, number IS DISTINCT FROM lag(number) OVER w OR row_number() OVER w = 1 AS changed FROM s WINDOW w AS (PARTITION BY document_id ORDER BY page_number)),
a AS (SELECT document_id, max(page_number) AS last, list_sort(list(DISTINCT page_number) FILTER (heading)) AS heads, list_sort(list(DISTINCT page_number) FILTER (changed)) AS changes, bool_and(number IS NOT NULL) AS numbered FROM c GROUP BY 1),
g AS (SELECT *, CASE WHEN len(heads) >= 2 AND heads[1] = 1 THEN list_transform(range(2, CAST(len(heads) AS BIGINT) + 1), lambda i: heads[i] - heads[i - 1]) END AS gaps FROM a),
k AS (SELECT *, CASE WHEN gaps IS NOT NULL THEN list_reduce(gaps, lambda x, y: gcd(x, y)) END AS stride FROM g),
b AS (SELECT *, CASE WHEN last = 1 THEN 1 WHEN gaps IS NOT NULL AND len(list_distinct(gaps)) = 1 AND gaps[1] = last - heads[-1] + 1 THEN 3
  WHEN numbered AND len(changes) >= 2 AND changes[1] = 1 THEN 4
  WHEN gaps IS NOT NULL AND len(heads) >= 3 AND len(list_distinct(gaps)) > 1 AND last % stride = 0 AND last // stride > len(heads) THEN 5
  WHEN gaps IS NOT NULL THEN 6 ELSE 1 END AS m FROM k),
st AS (SELECT document_id, last, CASE m WHEN 1 THEN [1] WHEN 4 THEN changes WHEN 5 THEN range(1, last + 1, stride) ELSE heads END AS starts,
  CASE m WHEN 1 THEN 'single_document' WHEN 3 THEN 'uniform_page_count' WHEN 4 THEN 'serial_number' WHEN 5 THEN 'fixed_stride' ELSE 'content_header' END AS method,
  CASE m WHEN 1 THEN CASE WHEN last = 1 THEN 1.0 ELSE 0.6 END WHEN 3 THEN 0.92 WHEN 4 THEN 0.88 WHEN 5 THEN round(0.55 + 0.15 * len(list_filter(gaps, lambda z: z = stride)) / len(gaps), 2) ELSE 0.85 END AS confidence FROM b),
u AS (SELECT document_id, i - 1 AS ordinal, starts[i] AS page_start, coalesce(starts[i + 1] - 1, last) AS page_end, method, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, unnest(range(1, CAST(len(starts) AS BIGINT) + 1)) AS i FROM st))"""

_READ = """p AS (SELECT id, printed, try_cast(regexp_extract(printed, '^\\s*([0-9]{1,4})\\s*[-/.]\\s*([0-9]{1,2})\\s*[-/.]\\s*([0-9]{1,4})\\s*$', 1) AS INT) AS a, try_cast(regexp_extract(printed, '^\\s*([0-9]{1,4})\\s*[-/.]\\s*([0-9]{1,2})\\s*[-/.]\\s*([0-9]{1,4})\\s*$', 2) AS INT) AS b, try_cast(regexp_extract(printed, '^\\s*([0-9]{1,4})\\s*[-/.]\\s*([0-9]{1,2})\\s*[-/.]\\s*([0-9]{1,4})\\s*$', 3) AS INT) AS c FROM {}),
q AS (SELECT *, CASE WHEN a > 31 THEN try_cast(lpad(CAST(a AS VARCHAR), 4, '0') || '-' || lpad(CAST(b AS VARCHAR), 2, '0') || '-' || lpad(CAST(c AS VARCHAR), 2, '0') AS DATE) END AS y,
 CASE WHEN c >= 1 THEN try_cast(lpad(CAST(c AS VARCHAR), 4, '0') || '-' || lpad(CAST(b AS VARCHAR), 2, '0') || '-' || lpad(CAST(a AS VARCHAR), 2, '0') AS DATE) END AS dm, CASE WHEN c >= 1 THEN try_cast(lpad(CAST(c AS VARCHAR), 4, '0') || '-' || lpad(CAST(a AS VARCHAR), 2, '0') || '-' || lpad(CAST(b AS VARCHAR), 2, '0') AS DATE) END AS md FROM p)"""

SQL = {
    "date_normalise": "WITH " + _READ.replace("{}", view(DATES)) + " SELECT id, printed, CAST(CASE WHEN a > 31 THEN y ELSE coalesce(dm, md) END AS VARCHAR) AS iso, coalesce(a <= 31 AND dm IS NOT NULL AND md IS NOT NULL AND a <> b, false) AS ambiguous, a IS NOT NULL AND (CASE WHEN a > 31 THEN y ELSE coalesce(dm, md) END) IS NULL AS impossible FROM q",
    "time_normalise": "WITH p AS (SELECT event_id, event_id % 14 AS h, event_id % 70 AS m, event_id % 4 AS k FROM events), q AS (SELECT *, CASE WHEN k = 0 AND h < 12 THEN h + 12 WHEN k = 1 AND h = 12 THEN 0 ELSE h END AS hour FROM p) SELECT event_id, CASE WHEN hour <= 23 AND m <= 59 THEN lpad(CAST(hour AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') END AS time FROM q",
    "cnic_normalise": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '-9' END AS cnic FROM orders",
    "number_normalise": "SELECT o_orderkey, printf('%.2f', o_totalprice) AS amount FROM orders",
    "sex_normalise": f"SELECT id, CASE sex WHEN 'Male' THEN 'male' WHEN 'female.' THEN 'female' WHEN 'a boy' THEN 'male' END AS sex FROM {R} r",
    "age_years": "SELECT o_orderkey, CAST(year(o_orderdate) - 1960 - CASE WHEN (month(o_orderdate), day(o_orderdate)) < (2, 29) THEN 1 ELSE 0 END AS BIGINT) AS age FROM orders",
    "language_tag": "WITH l AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g')) AS a FROM documents) SELECT doc_id, CASE WHEN n < 3 THEN NULL WHEN a / n >= 0.85 THEN 'urd' WHEN a / n <= 0.05 THEN 'eng' WHEN n IS NULL THEN NULL ELSE 'eng+urd' END AS language FROM l",
    "normal_text": "SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), chr(10)), chr(10) || ' ')) AS digest FROM documents",
    "name_keys": f"WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Dr. Syed ' WHEN 1 THEN 'Mrs ' ELSE '' END || c_name || ' Malik' AS name FROM customer) SELECT c_custkey, {S.name_key('name')} AS name_key, {S.number_key('name')} AS number_key, substr(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_\\s-]+', '', 'g'), '[\\s-]+', '_', 'g'), 1, 60) AS slug FROM c",
    "shared_names": "WITH q AS (SELECT p_partkey + 1 AS p_partkey, string_split(p_name || ' ring', ' ') AS b FROM part), j AS (SELECT p.p_partkey, string_split(p.p_name, ' ') AS a, b FROM part p JOIN q USING (p_partkey)) SELECT p_partkey, list_has_all(a, b) OR list_has_all(b, a) AS shares FROM j",
    "redacted_documents": "WITH " + ", ".join(
        f"r{i + 1} AS (SELECT doc_id, regexp_replace(text, '{p}', '{m}', 'g') AS text FROM {'r' + str(i) if i else 'documents'})" for i, (p, m) in enumerate(T.REDACTIONS)
    ) + f", s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[{T.ARABIC}]+(?:\\s+[{T.ARABIC}]+)*', '[text]', 'g'), '(?i)(password|secret|token|api_key)\\s*[=:]\\s*[^\\s,;]+', '\\1=[hidden]', 'g') AS text FROM r{len(T.REDACTIONS)}) SELECT doc_id, sha256(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '... (+' || CAST(length(text) - 300 AS VARCHAR) || ' chars)' ELSE text END) AS digest FROM s",
    "text_quality": """WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM benchmark),
t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS x FROM documents), f AS (SELECT * FROM t WHERE length(x) >= 2 AND regexp_matches(x, '[\\p{L}\\p{N}]')),
r AS (SELECT doc_id, count(*) AS tokens, count(*) FILTER (CASE WHEN regexp_matches(x, '^[0-9]+$') THEN true WHEN regexp_matches(x, '[0-9]') THEN length(x) <= 20 ELSE x IN (SELECT word FROM w WHERE word <> '') END) AS hits FROM f GROUP BY 1),
d AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n, length(regexp_replace(text, '\\s', '', 'g')) AS v FROM documents)
SELECT doc_id AS document_id, CAST(n AS BIGINT) AS char_count, CASE WHEN v > 0 THEN round(n / v, 4) ELSE 0.0 END AS alnum_ratio, coalesce(round(hits / tokens, 4), 0.0) AS hit_rate, coalesce(tokens, 0) AS tokens, n < 100 OR coalesce(round(hits / tokens, 4), 0.0) < 0.35 AS needs_ocr FROM d LEFT JOIN r USING (doc_id)""",
    "form_fingerprints": "WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(split_part(x, ':', 1), '\\s+', ' ', 'g'), ' '))) AS h FROM documents), f AS (SELECT doc_id, unnest(list_filter(h, lambda x: length(x) BETWEEN 4 AND 60 AND NOT regexp_matches(x, '[0-9]'))) AS x, generate_subscripts(list_filter(h, lambda x: length(x) BETWEEN 4 AND 60 AND NOT regexp_matches(x, '[0-9]')), 1) AS i FROM l), k AS (SELECT doc_id, x FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS r FROM f GROUP BY doc_id, x) WHERE r <= 40), g AS (SELECT doc_id, list_sort(list(x)) AS a FROM k GROUP BY 1) SELECT d.doc_id AS document_id, sha256('v1|' || coalesce(array_to_string(list_transform(a, lambda x: x || chr(10)), ''), '')) AS fingerprint FROM documents d LEFT JOIN g USING (doc_id)",
    "page_lines": f"WITH l AS (SELECT doc_id, {_LINES.format('text')} AS l FROM documents) SELECT doc_id AS document_id, CAST(len(l) AS BIGINT) AS lines, CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT) AS chars, CAST(len(l) - 1 AS BIGINT) AS followed FROM l WHERE len(l) > 0",
    "extra_fields": "SELECT event_id AS document_id, event_type || ' kind' AS label, 'value ' || user_id AS value FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'user note', props FROM events",
    "template_fields": "SELECT event_id AS document_id, 'kind' AS field, event_type AS value, 0.95::DOUBLE AS confidence FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR), 0.95::DOUBLE FROM events WHERE event_type = 'click' OR (event_type = 'error' AND user_id < 10)",
    "learned_rules": "SELECT event_id AS document_id, 'kind' AS field, 'Kind of event' AS anchor, 'after' AS \"where\" FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'person', 'Person', 'below' FROM events WHERE event_id % 2 = 1",
    "split_boundaries": f"WITH {_SUMMARY} SELECT * FROM u",
    "page_range_join": f"WITH {_SUMMARY} SELECT u.document_id, ordinal, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM u JOIN p ON u.document_id = p.document_id AND p.page_number BETWEEN page_start AND page_end GROUP BY 1, 2",
    "unit_renumber": f"WITH p AS (SELECT * FROM {view(PAGES)} q WHERE role = 'user') SELECT document_id, row_number() OVER w - 1 AS ordinal, page_number AS page_start, coalesce(lead(page_number) OVER w - 1, max(page_number) OVER (PARTITION BY document_id)) AS page_end FROM p WINDOW w AS (PARTITION BY document_id ORDER BY page_number)",
    "classify_keywords": _class_sql(),
    "classify_titles": _class_sql(split.KEYWORDS, view(TITLED) + " titled", damaged=True),
    "labelled_fields": _labelled_sql(),
    "verified_answers": """WITH a AS (SELECT doc_id, lower(text) AS t, lower(array_to_string(string_split(text, ' ')[1:2], ' ') || CASE WHEN doc_id % 3 = 0 THEN ' zzz' ELSE '' END) AS a FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(a, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS wa, list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS wt FROM a)
SELECT doc_id, contains(t, a) OR (len(wa) > 0 AND len(list_intersect(wa, wt)) = len(list_distinct(wa))) AS verified FROM w""",
    "page_layout": """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM conversations),
k AS (SELECT conv_id, turn, k, k // 6 AS r, k % 6 AS s, k % 6 // 3 AS c, CASE (k + turn) % 5 WHEN 0 THEN 'نام' WHEN 3 THEN 'علی' WHEN 4 THEN CAST(k AS VARCHAR) ELSE word END AS word
 FROM (SELECT conv_id, turn, unnest(range(len(w))) AS k, unnest(w) AS word FROM w)),
d AS (SELECT *, CASE WHEN regexp_matches(word, '\\p{L}') THEN word IN ('نام', 'علی') END AS kind, s * 40 + CASE WHEN s >= 3 THEN 60 ELSE 0 END AS x, r * 20 + r // 11 * 40 + k * 7 % 3 AS y FROM k),
b AS (SELECT *, first_value(kind IGNORE NULLS) OVER (PARTITION BY conv_id, turn, r, c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM d),
q AS (SELECT *, CASE WHEN base THEN -s ELSE s END AS q FROM b),
n AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY conv_id, turn, r, c ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base) AS l,
 coalesce(first_value(kind IGNORE NULLS) OVER (PARTITION BY conv_id, turn, r, c ORDER BY q ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), base) AS f FROM q),
a AS (SELECT *, coalesce(coalesce(kind <> base, l <> base AND f <> base), false) AS against FROM n),
t AS (SELECT *, CASE WHEN against <> lag(against) OVER (PARTITION BY conv_id, turn, r, c ORDER BY q) THEN 1 ELSE 0 END AS turned, coalesce(min(base) OVER (PARTITION BY conv_id, turn, r), false) AS leftwards FROM a),
i AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id, turn, r, c ORDER BY q) AS stretch FROM t)
SELECT conv_id AS document_id, turn AS page_number, r AS line, r // 11 AS block, string_agg(word, ' ' ORDER BY CASE WHEN leftwards THEN -c ELSE c END, stretch, CASE WHEN against THEN -q ELSE q END) AS text,
 CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x) + 30 AS DOUBLE) AS x1, CAST(max(y) + 10 AS DOUBLE) AS y1 FROM i GROUP BY conv_id, turn, r""",
    "unit_reading": "SELECT conv_id AS unit_id, round(avg(CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) * 1.0::DOUBLE END), 2) AS confidence, bool_or(turn = 5) AS ocr_used, arg_min(role, turn) FILTER (turn <> 0) AS language FROM conversations GROUP BY 1",
    "ocr_selection": "WITH a AS (SELECT user_id, event_id AS attempt, value + 40 * (event_id % 10 / 10.0::DOUBLE) AS w FROM events) SELECT user_id, attempt, round(w, 4) AS worth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, attempt) AS r FROM a) WHERE r = 1",
    "merge_layers": "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag || l_linenumber END AS a, round(l_tax * 10, 4) AS ca, l_linestatus || l_partkey AS b, round(l_discount * 10, 4) AS cb FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a = '' OR cb > ca + 0.2::DOUBLE THEN b ELSE a END AS value, CASE WHEN a = '' OR cb > ca + 0.2::DOUBLE THEN cb ELSE ca END AS confidence FROM x",
    "row_score_route": f"""WITH {_checked()}, f AS (SELECT *, list_transform(issues, lambda x: x.flag) AS fl FROM i),
g AS (SELECT *, list_filter(fl, lambda x, k: list_position(fl, x) = k) AS flags FROM f),
s AS (SELECT *, ({_WEIGHTED}) / {_TOTAL} AS coverage, list_sum(list_transform(flags, lambda x: CASE WHEN x IN ({SERIOUS}) THEN 0.25::DOUBLE ELSE 0.08::DOUBLE END)) AS cost FROM g),
z AS (SELECT id, flags, round(least(0.99::DOUBLE, greatest(0.0, coverage * greatest(0.9::DOUBLE, coverage) * (1.0 - least(0.6::DOUBLE, coalesce(cost, 0))))) + 1e-9, 4) AS score FROM s)
SELECT id, array_to_string(flags, ',') AS flags, score, CASE WHEN score < 0.6 THEN 'FAILED' WHEN len(flags) > 0 OR score < 1 THEN 'NEEDS_REVIEW' ELSE 'AUTO_APPROVED' END AS status FROM z""",
    "row_issues": f"WITH {_checked()}, e AS (SELECT unnest(issues) AS x FROM i) SELECT x.field AS field, x.flag AS flag, count(*) AS n FROM e GROUP BY 1, 2",
    "register_draft": f"SELECT id, nullif(certificate_number, '') AS number, coalesce(try_cast(nullif(date_of_death, '') AS DATE), try_cast(date_of_birth AS DATE)) AS event_date, certificate_number <> '' AS fileable FROM {R} r",
    "dates_exploded": f"SELECT id, role, field_name, CAST(0 AS BIGINT) AS position, value FROM (SELECT id, 'death_date' AS role, 'date_of_death' AS field_name, date_of_death AS value FROM {R} r UNION ALL SELECT id, 'birth_date', 'date_of_birth', date_of_birth FROM {R} r) WHERE value <> ''",
    "row_correction": f"SELECT id, array_to_string(list_filter([CASE WHEN age <> '44' THEN 'age' END, CASE WHEN id % 2 = 1 OR sex <> 'F' THEN 'sex' END], lambda x: x IS NOT NULL), ',') AS changed, '44' AS age, CASE WHEN id % 2 = 0 THEN 'F' END AS sex FROM {R} r",
    "schema_problems": """WITH f AS (SELECT p_brand AS schema_id, CASE WHEN p_size % 9 = 0 THEN p_name ELSE lower(p_type) || p_size END AS name, CASE WHEN p_size = 1 THEN ' ' ELSE p_type END AS label, p_size % 2 = 0 AS searchable, CASE WHEN p_size = 7 THEN 'identifier' WHEN p_size % 3 = 0 THEN 'none' ELSE 'subject' END AS role FROM part)
SELECT DISTINCT schema_id, 'bad_key' AS problem FROM f WHERE NOT regexp_matches(name, '^[a-z][a-z0-9_]{0,62}$') UNION ALL SELECT DISTINCT schema_id, 'blank_label' FROM f WHERE trim(label) = '' UNION ALL SELECT DISTINCT schema_id, 'searchable_without_role' FROM f WHERE searchable AND role = 'none'
UNION ALL SELECT schema_id, 'repeated_key' FROM f GROUP BY 1 HAVING count(DISTINCT name) < count(*) UNION ALL SELECT schema_id, 'identifiers' FROM f GROUP BY 1 HAVING count(*) FILTER (role = 'identifier') <> 1 UNION ALL SELECT schema_id, 'too_many' FROM f GROUP BY 1 HAVING count(*) > 200""",
    "accuracy_scoreboard": "WITH o AS (SELECT CAST(o_orderkey % 20 AS VARCHAR) AS document, o_orderpriority AS field, o_orderkey % 5 <> 0 AND (o_orderkey % 3 <> 0 OR o_orderstatus = 'F') AS ok FROM orders) SELECT document, field, round(avg(CAST(ok AS INT)), 4) AS accuracy, count(*) AS n FROM o GROUP BY GROUPING SETS ((document), (field), ())",
}
