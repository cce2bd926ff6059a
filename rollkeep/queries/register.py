"""Queries over the register: search, duplicates, counters, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeep.operators import counts, duplicates, index, search
from rollkeep.queries import sqltext as S
from rollkeep.sources.adapter import ENTRIES, NAMES, frame, view
from rollkeep.sources.scratch import fresh_dir

KEYED = f"(SELECT *, {S.number_key('number')} AS number_key, {S.number_key('registration_number')} AS registration_key, {S.name_key('primary_name')} AS name_key FROM {view(ENTRIES)} e)"
NAME, NEAR = "Mr Red  Widget", "redd widgets"


def entries(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, ENTRIES)


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return search.with_keys(entries(spark, d))


def _search(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = search.tiered(search.filtered(keyed(spark, d)), frame(spark, d, NAMES), text)
        return hits.select("id", "number", "primary_name", F.col("tier").cast("long").alias("tier"), F.round("similarity", 4).alias("similarity"))

    return run


def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The register put into a stored index in two appends, the second of which replaces a tenth of the first, and a similar name looked up."""
    e, names, root = entries(spark, d), frame(spark, d, NAMES), fresh_dir(spark)
    old = e.where("id % 10 = 0 or id % 3 = 0").withColumn("primary_name", F.when(F.col("id") % 10 == 0, F.lit("redd widget")).otherwise(F.col("primary_name")))
    index.append(old, names.join(old.select(F.col("id").alias("certificate_id")), "certificate_id", "left_semi"), root, 0)
    new = e.where("id % 10 = 0 or id % 3 <> 0")
    index.append(new, names.join(new.select(F.col("id").alias("certificate_id")), "certificate_id", "left_semi"), root, 1)
    hits = index.lookup(spark, root, NEAR, search.filtered)
    return hits.select("id", "number", "primary_name", F.col("tier").cast("long").alias("tier"), F.round("similarity", 4).alias("similarity"))


def _search_sql(text: str) -> str:
    n, m = S.number_key(f"'{text}'"), S.name_key(f"'{text}'")
    return f"""
WITH q AS (SELECT {n} AS n, {m} AS m),
roles AS (SELECT DISTINCT certificate_id FROM {view(NAMES)} x, q WHERE {S.name_key('x.value')} = q.m),
scored AS (SELECT e.*, {S.similarity('e.name_key', 'q.m')} AS similarity,
  CASE WHEN q.n <> '' AND (e.number_key = q.n OR e.registration_key = q.n) THEN 1
       WHEN length(q.n) >= 3 AND (starts_with(e.number_key, q.n) OR starts_with(e.registration_key, q.n)) THEN 2
       WHEN q.m <> '' AND (e.name_key = q.m OR e.id IN (SELECT certificate_id FROM roles)) THEN 3
       WHEN q.m <> '' AND {S.similarity('e.name_key', 'q.m')} >= 0.35 THEN 4 END AS tier
  FROM {KEYED} e, q WHERE e.status <> 'VOID')
SELECT id, number, primary_name, CAST(tier AS BIGINT) AS tier, round(similarity, 4) AS similarity
FROM scored WHERE tier = (SELECT min(tier) FROM scored)"""


def filtered_browse(spark: SparkSession, d: str) -> DataFrame:
    hits = search.filtered(entries(spark, d), workspace=1, needs_review=False, since="1995-01-01", until="1997-12-31")
    return search.page(hits, offset=20, limit=30).select("id", "event_date", "primary_name")


def page_total(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(entries(spark, d), workspace=2, duplicates_only=True).agg(F.count("*").alias("total"))


def keyset(spark: SparkSession, d: str) -> DataFrame:
    return search.keyset_page(entries(spark, d), ("1995-06-01 00:00:00", 40), 50).select("id", "number")


def namesake_counts(spark: SparkSession, d: str) -> DataFrame:
    k = keyed(spark, d)
    rows = search.page(search.filtered(k, type_id="1-URGENT"), limit=40)
    return search.namesakes(rows, k).select("id", "name_key", "namesakes")


def name_in_any_role(spark: SparkSession, d: str) -> DataFrame:
    roles = frame(spark, d, NAMES).where(F.col("role").isin("father", "mother")).withColumn("key", search.name_key(F.col("value")))
    return entries(spark, d).join(roles.where("key = 'red widget'").select(F.col("certificate_id").alias("id")), "id", "left_semi").select("id", "number")


def field_exact(spark: SparkSession, d: str) -> DataFrame:
    values = F.create_map(F.lit("brand"), F.col("secondary_name"), F.lit("name"), F.col("primary_name"))
    return entries(spark, d).withColumn("values", values).where(F.try_element_at("values", F.lit("brand")) == "Brand#7").select("id", "secondary_name")


def field_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(entries(spark, d), batch_id=4).where(F.lower("primary_name").startswith("re")).select("id", "primary_name")


def substring_grid(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where(F.col("primary_name").ilike("%widg%") | F.col("number").ilike("%/1997/%9")).select("id", "primary_name", "number")


def similar_names(spark: SparkSession, d: str) -> DataFrame:
    keys = keyed(spark, d).select(F.col("name_key").alias("key"))
    return search.similar_pairs(keys, keys, 0.5).withColumn("similarity", F.round("similarity", 4))


def dup_same_number(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.same_number(keyed(spark, d))


def dup_same_person(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.same_person(keyed(spark, d))


def dup_classified(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.classified(keyed(spark, d)).withColumn("place", F.col("place").cast("long"))


def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.review_counts(entries(spark, d))


def row_serials(spark: SparkSession, d: str) -> DataFrame:
    return counts.serials(entries(spark, d), "batch_id", ["created_at", "id"]).where("needs_review").select("id", "batch_id", "serial")


def batch_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.by_status(entries(spark, d).withColumn("size", F.length("number").cast("long")), "batch_id", "status", "size")


def batch_closure(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d).withColumns({"open": F.col("id") % 997 == 0, "failed": F.col("id") % 499 == 0})
    return counts.closure(rows, "batch_id", "open", "failed")


def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    return counts.progress(entries(spark, d).withColumn("done", F.col("status") == "ACTIVE"), "batch_id", "done")


def names_exploded(spark: SparkSession, d: str) -> DataFrame:
    pair = F.array(F.struct(F.lit("subject").alias("role"), F.col("primary_name").alias("value")), F.struct(F.lit("party").alias("role"), F.col("secondary_name").alias("value")))
    rows = entries(spark, d).select("id", F.posexplode(pair).alias("position", "name"))
    return rows.select("id", F.col("position").cast("long").alias("position"), "name.role", "name.value", search.name_key(F.col("name.value")).alias("value_key"))


def role_positions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    names = frame(spark, d, NAMES)
    place = F.row_number().over(W.partitionBy("certificate_id", "role").orderBy("position", "value")) - 1
    return names.select("certificate_id", "role", "position", "value", place.cast("long").alias("occurrence"))


def child_rows(spark: SparkSession, d: str) -> DataFrame:
    held = frame(spark, d, NAMES).groupBy(F.col("certificate_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "role", "value"))), "|").alias("names"))
    return entries(spark, d).where("needs_review").join(held, "id", "left").select("id", "names")


def cited_entries(spark: SparkSession, d: str) -> DataFrame:
    e, n = entries(spark, d), frame(spark, d, NAMES)
    return e.join(n, e["id"] == n["certificate_id"]).groupBy("batch_id").agg(F.countDistinct("id").alias("cited"), F.countDistinct("value").alias("names"))


def unpublished(spark: SparkSession, d: str) -> DataFrame:
    held = entries(spark, d).where("status = 'ACTIVE'").select(F.col("id").alias("certificate_id"))
    return frame(spark, d, NAMES).join(held, "certificate_id", "left_anti").select("certificate_id").distinct()


def default_version(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("id", F.struct("needs_review", "created_at", "id"))
    return entries(spark, d).groupBy("type_id").agg(best.alias("id"))


def next_versions(spark: SparkSession, d: str) -> DataFrame:
    return counts.next_versions(entries(spark, d).withColumn("version", F.year("event_date") - 1990), "type_id", "version")


def supersede_questions(spark: SparkSession, d: str) -> DataFrame:
    c = duplicates.classified(keyed(spark, d)).where("strong and place = 1")
    e = entries(spark, d).select("id", "created_at")
    pairs = c.join(e.select(F.col("id").alias("a_id"), F.col("created_at").alias("a_created")), "a_id").join(e.select(F.col("id").alias("b_id"), F.col("created_at").alias("b_created")), "b_id")
    return duplicates.resolve(pairs.withColumn("same", F.col("a_id") % 2 == 0)).distinct()


def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return frame(spark, d, "SELECT * FROM {events}").where((F.col("event_type") == "error") & (F.col("ts") < now - F.expr("INTERVAL 12 HOURS"))).select("event_id", "user_id")


def archive_tree(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of a root over a bounded number of parent links."""
    e = entries(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.floor(F.col("id") / 7)).alias("parent"))
    level = e.where("parent = 1").select("id", F.lit(1).cast("long").alias("depth"))
    tree = level
    for depth in (2, 3):
        level = e.join(level.select(F.col("id").alias("parent")), "parent").select("id", F.lit(depth).cast("long").alias("depth"))
        tree = tree.unionByName(level)
    return tree


def delete_impact(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    mine = e.where("batch_id = 3").select("id")
    links = frame(spark, d, NAMES).select(F.col("certificate_id").alias("id"), (F.col("position") % 3 == 0).alias("foreign_batch"))
    cited = links.join(mine, "id", "left_semi").groupBy("id").agg(F.max("foreign_batch").alias("kept"))
    return mine.join(cited, "id", "left").select("id", F.when(F.coalesce("kept", F.lit(False)), "drop_link").otherwise("remove").alias("action"))


QUERIES = {
    "search_number_exact": _search("c 10 / 1995"),
    "search_number_prefix": _search("REG/NATION_3/1996"),
    "search_name_exact": _search(NAME),
    "search_name_similar": _search(NEAR),
    "search_indexed": search_indexed,
    "search_filtered_browse": filtered_browse,
    "search_page_total": page_total,
    "keyset_page": keyset,
    "namesake_counts": namesake_counts,
    "search_any_role": name_in_any_role,
    "search_field_exact": field_exact,
    "search_field_prefix": field_prefix,
    "rows_substring": substring_grid,
    "similar_name_pairs": similar_names,
    "dup_same_number": dup_same_number,
    "dup_same_person": dup_same_person,
    "dup_classified": dup_classified,
    "review_counts": review_counts,
    "row_serials": row_serials,
    "batch_status_counts": batch_status_counts,
    "batch_closure": batch_closure,
    "batch_progress": batch_progress,
    "names_exploded": names_exploded,
    "role_positions": role_positions,
    "child_rows": child_rows,
    "cited_entries": cited_entries,
    "unpublished_anti": unpublished,
    "default_version": default_version,
    "next_versions": next_versions,
    "resolve_duplicates": supersede_questions,
    "stale_runs": stale_runs,
    "archive_tree": archive_tree,
    "delete_impact": delete_impact,
}

E = view(ENTRIES)
N = view(NAMES)
_OLDEST = "QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.created_at, b.id) <= 20"
SAME_NUMBER = f"""SELECT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.workspace_id = b.workspace_id AND a.id <> b.id AND b.status <> 'VOID'
  AND (b.number_key = a.number_key AND a.number_key <> '' OR a.registration_key <> '' AND (b.registration_key = a.registration_key OR b.number_key = a.registration_key)) {_OLDEST}"""
SAME_PERSON = f"""SELECT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.workspace_id = b.workspace_id AND a.type_id = b.type_id AND a.name_key = b.name_key AND a.event_date = b.event_date
  WHERE a.id <> b.id AND a.name_key <> '' AND a.number_key <> b.number_key AND b.status <> 'VOID' {_OLDEST}"""
CLASSIFIED = f"""k AS MATERIALIZED (SELECT * FROM {KEYED} z), num AS ({SAME_NUMBER}), per AS ({SAME_PERSON}),
c AS (SELECT a_id, b_id, true AS by_number FROM num UNION ALL SELECT a_id, b_id, false FROM per WHERE (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM num)),
t AS (SELECT c.*, a.type_id = b.type_id AS same_type, a.created_at AS a_created, b.created_at AS b_created FROM c JOIN k a ON a.id = a_id JOIN k b ON b.id = b_id),
ranked AS (SELECT a_id, b_id, a_created, b_created, CASE WHEN by_number AND same_type THEN 'same_number' WHEN by_number THEN 'same_number_other_type' ELSE 'same_name_and_event_date' END AS reason,
  by_number AND same_type AS strong, row_number() OVER (PARTITION BY a_id ORDER BY (by_number AND same_type) DESC, same_type DESC, by_number DESC, b_created, b_id) AS place FROM t)"""

SQL = {
    "search_number_exact": _search_sql("c 10 / 1995"),
    "search_number_prefix": _search_sql("REG/NATION_3/1996"),
    "search_name_exact": _search_sql(NAME),
    "search_name_similar": _search_sql(NEAR),
    "search_indexed": _search_sql(NEAR),
    "search_filtered_browse": f"SELECT id, event_date, primary_name FROM {E} e WHERE workspace_id = 1 AND status <> 'VOID' AND NOT needs_review AND event_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' ORDER BY event_date DESC NULLS LAST, created_at DESC, id DESC LIMIT 30 OFFSET 20",
    "search_page_total": f"SELECT count(*) AS total FROM {E} e WHERE workspace_id = 2 AND status <> 'VOID' AND duplicate_status <> 'NONE'",
    "keyset_page": f"SELECT id, number FROM {E} e WHERE created_at > TIMESTAMP '1995-06-01' OR (created_at = TIMESTAMP '1995-06-01' AND id > 40) ORDER BY created_at, id LIMIT 51",
    "namesake_counts": f"""WITH k AS (SELECT * FROM {KEYED} z), p AS (SELECT * FROM k WHERE status <> 'VOID' AND type_id = '1-URGENT' ORDER BY event_date DESC NULLS LAST, created_at DESC, id DESC LIMIT 40)
SELECT id, name_key, (SELECT count(*) FROM k WHERE k.workspace_id = p.workspace_id AND k.name_key = p.name_key AND k.status <> 'VOID') AS namesakes FROM p""",
    "search_any_role": f"SELECT id, number FROM {E} e WHERE id IN (SELECT certificate_id FROM {N} n WHERE role IN ('father', 'mother') AND {S.name_key('value')} = 'red widget')",
    "search_field_exact": f"SELECT id, secondary_name FROM {E} e WHERE secondary_name = 'Brand#7'",
    "search_field_prefix": f"SELECT id, primary_name FROM {E} e WHERE batch_id = 4 AND status <> 'VOID' AND lower(primary_name) LIKE 're%'",
    "rows_substring": f"SELECT id, primary_name, number FROM {E} e WHERE primary_name ILIKE '%widg%' OR number ILIKE '%/1997/%9'",
    "similar_name_pairs": f"WITH k AS (SELECT DISTINCT name_key AS key FROM {KEYED} z WHERE name_key <> '') SELECT a.key AS left_key, b.key AS right_key, round({S.similarity('a.key', 'b.key')}, 4) AS similarity FROM k a, k b WHERE {S.similarity('a.key', 'b.key')} >= 0.5",
    "dup_same_number": f"WITH k AS MATERIALIZED (SELECT * FROM {KEYED} z) {SAME_NUMBER}",
    "dup_same_person": f"WITH k AS MATERIALIZED (SELECT * FROM {KEYED} z) {SAME_PERSON}",
    "dup_classified": f"WITH {CLASSIFIED} SELECT a_id, b_id, reason, strong, place FROM ranked WHERE place <= 20",
    "review_counts": f"SELECT workspace_id, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (duplicate_status = 'SUSPECTED') AS suspected, count(*) FILTER (needs_review) AS total FROM {E} e WHERE status <> 'VOID' GROUP BY 1",
    "row_serials": f"SELECT id, batch_id, serial FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id) AS serial FROM {E} e) WHERE needs_review",
    "batch_status_counts": f"SELECT batch_id, status, count(*) AS n, CAST(coalesce(sum(length(number)), 0) AS BIGINT) AS bytes FROM {E} e GROUP BY ALL",
    "batch_closure": f"SELECT batch_id, CASE WHEN bool_or(id % 997 = 0) THEN 'OPEN' WHEN bool_or(id % 499 = 0) THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM {E} e GROUP BY 1",
    "batch_progress": f"SELECT batch_id, round(100.0 * count(*) FILTER (status = 'ACTIVE') / count(*), 1) AS percent FROM {E} e GROUP BY 1",
    "names_exploded": f"SELECT id, position, role, value, {S.name_key('value')} AS value_key FROM (SELECT id, CAST(0 AS BIGINT) AS position, 'subject' AS role, primary_name AS value FROM {E} e UNION ALL SELECT id, 1, 'party', secondary_name FROM {E} e)",
    "role_positions": f"SELECT certificate_id, role, position, value, row_number() OVER (PARTITION BY certificate_id, role ORDER BY position, value) - 1 AS occurrence FROM {N} n",
    "child_rows": f"SELECT e.id, n.names FROM {E} e LEFT JOIN (SELECT certificate_id, array_to_string(list_sort(list(role || ':' || value)), '|') AS names FROM {N} x GROUP BY 1) n ON e.id = n.certificate_id WHERE e.needs_review",
    "cited_entries": f"SELECT batch_id, count(DISTINCT id) AS cited, count(DISTINCT value) AS names FROM {E} e JOIN {N} n ON e.id = n.certificate_id GROUP BY 1",
    "unpublished_anti": f"SELECT DISTINCT certificate_id FROM {N} n WHERE certificate_id NOT IN (SELECT id FROM {E} e WHERE status = 'ACTIVE')",
    "default_version": f"SELECT type_id, id FROM (SELECT type_id, id, row_number() OVER (PARTITION BY type_id ORDER BY needs_review DESC, created_at DESC, id DESC) AS r FROM {E} e) WHERE r = 1",
    "next_versions": f"SELECT type_id, CAST(coalesce(max(year(event_date) - 1990), 0) + 1 AS BIGINT) AS next_version FROM {E} e GROUP BY 1",
    "resolve_duplicates": f"""WITH {CLASSIFIED}, p AS (SELECT *, a_id % 2 = 0 AS same, (a_created, a_id) <= (b_created, b_id) AS a_first FROM ranked WHERE strong AND place = 1),
o AS (SELECT same, CASE WHEN a_first THEN a_id ELSE b_id END AS kept, CASE WHEN a_first THEN b_id ELSE a_id END AS later FROM p)
SELECT kept AS id, 'ACTIVE' AS status, CASE WHEN same THEN 'CONFIRMED' ELSE 'DISTINCT' END AS duplicate_status, CAST(NULL AS BIGINT) AS superseded_by FROM o
UNION SELECT later, CASE WHEN same THEN 'SUPERSEDED' ELSE 'ACTIVE' END, CASE WHEN same THEN 'CONFIRMED' ELSE 'DISTINCT' END, CASE WHEN same THEN kept END FROM o""",
    "stale_runs": "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-05' - INTERVAL 12 HOUR",
    "archive_tree": f"WITH RECURSIVE e AS (SELECT id, CASE WHEN id % 7 <> 0 THEN id // 7 END AS parent FROM {E} x), t AS (SELECT id, CAST(1 AS BIGINT) AS depth FROM e WHERE parent = 1 UNION ALL SELECT e.id, depth + 1 FROM e JOIN t ON e.parent = t.id WHERE depth < 3) SELECT id, depth FROM t",
    "delete_impact": f"SELECT e.id, CASE WHEN coalesce(c.kept, false) THEN 'drop_link' ELSE 'remove' END AS action FROM {E} e LEFT JOIN (SELECT certificate_id, bool_or(position % 3 = 0) AS kept FROM {N} n GROUP BY 1) c ON e.id = c.certificate_id WHERE batch_id = 3",
}
