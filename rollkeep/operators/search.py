"""Search over register entries: filters, tiers, namesakes and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.functions.text import name_key, number_key, similarity, trigrams
from rollkeep.sources.scratch import materialize

SIMILAR = 0.35
SHORTEST_PREFIX = 3
DEEPEST = 10_000
TIERS = ("number", "prefix", "name", "similar")


def with_keys(entries: DataFrame) -> DataFrame:
    """Entries with the keys that search compares."""
    return entries.withColumns({"number_key": number_key(F.col("number")), "registration_key": number_key(F.col("registration_number")), "name_key": name_key(F.col("primary_name"))})


def filtered(entries: DataFrame, workspace: int | None = None, type_id: str | None = None, batch_id: int | None = None, needs_review: bool | None = None, duplicates_only: bool = False, since: str | None = None, until: str | None = None, include_void: bool = False) -> DataFrame:
    """The filters that every search shares; each is a plain predicate that reaches the scan."""
    tests: list[Column] = []
    if workspace is not None:
        tests.append(F.col("workspace_id") == workspace)
    if not include_void:
        tests.append(F.col("status") != "VOID")
    if type_id is not None:
        tests.append(F.col("type_id") == type_id)
    if batch_id is not None:
        tests.append(F.col("batch_id") == batch_id)
    if needs_review is not None:
        tests.append(F.col("needs_review") == needs_review)
    if duplicates_only:
        tests.append(F.col("duplicate_status") != "NONE")
    if since is not None:
        tests.append(F.col("event_date") >= F.lit(since).cast("date"))
    if until is not None:
        tests.append(F.col("event_date") <= F.lit(until).cast("date"))
    return reduce(lambda df, t: df.where(t), tests, entries)


def asked(spark: SparkSession, text: str) -> tuple[str, str]:
    """The number key and the name key of what is searched for."""
    keys = spark.range(1).select(number_key(F.lit(text)).alias("n"), name_key(F.lit(text)).alias("m")).first()  # of a literal
    return keys["n"], keys["m"]


def tiered(keyed: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """The first tier that finds anything for ``text``: exact number, number prefix, exact name in any role, similar name.

    All tiers are judged in one pass; ``tier`` and ``similarity`` are added. The tier is
    chosen on all hits, so that a page past the end doesn't fall through to the next one.
    Names are compared once for each different key. This reads the whole register; for repeated searches
    keep a :mod:`rollkeep.operators.index`.
    """
    n, m = asked(keyed.sparkSession, text)
    exact = (F.col("number_key") == n) | (F.col("registration_key") == n) if n else F.lit(False)
    prefix = F.col("number_key").startswith(n) | F.col("registration_key").startswith(n) if len(n) >= SHORTEST_PREFIX else F.lit(False)
    tier = F.when(exact, 1).when(prefix, 2)
    if m:
        roles = names.select("value", F.col("certificate_id").alias("id"))
        meant = roles.select("value").distinct().where(name_key(F.col("value")) == m)
        by_role = roles.join(meant, "value", "left_semi").select("id").distinct().withColumn("by_role", F.lit(True))
        near = keyed.select(F.col("name_key").alias("_key")).distinct().withColumn("_near", similarity(F.col("_key"), F.lit(m))).where((F.col("_near") >= SIMILAR) & (F.col("_key") != ""))
        keyed = keyed.join(by_role, "id", "left").join(near, F.col("name_key") == F.col("_key"), "left")
        tier = tier.when((F.col("name_key") == m) | F.coalesce("by_role", F.lit(False)), 3).when(F.col("_near").isNotNull(), 4)
    hits = materialize(keyed.withColumn("tier", tier).where("tier is not null").drop("by_role", "_key", "_near"))
    best = hits.agg(F.min("tier").alias("best"))
    found = hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")  # one row
    return found.withColumn("similarity", similarity(F.col("name_key"), F.lit(m)) if m else F.lit(0.0))


def page(hits: DataFrame, offset: int = 0, limit: int = 25, similar: bool = False) -> DataFrame:
    """One page, newest first or most similar first; beyond the deepest offset there is none."""
    if offset > DEEPEST:
        return hits.limit(0)
    order = [F.desc("similarity"), F.asc("id")] if similar else [F.desc_nulls_last("event_date"), F.desc("created_at"), F.desc("id")]
    return hits.orderBy(*order).offset(offset).limit(limit)


def keyset_page(entries: DataFrame, after: tuple | None, limit: int) -> DataFrame:
    """The next rows after (created_at, id), oldest first, and one more to tell whether there are more."""
    if after is not None:
        t, i = F.lit(after[0]).cast(entries.schema["created_at"].dataType), F.lit(after[1])
        entries = entries.where((F.col("created_at") > t) | ((F.col("created_at") == t) & (F.col("id") > i)))
    return entries.orderBy("created_at", "id").limit(limit + 1)


def namesakes(page_rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """``page_rows`` with the number of entries of the workspace that carry the same name key."""
    held = keyed.where("status <> 'VOID'").join(page_rows.select("workspace_id", "name_key").distinct(), ["workspace_id", "name_key"], "left_semi")
    counts = held.groupBy("workspace_id", "name_key").agg(F.count("*").alias("namesakes"))
    return page_rows.join(counts, ["workspace_id", "name_key"], "left").withColumn("namesakes", F.coalesce("namesakes", F.lit(1).cast("long")))


def similar_pairs(left: DataFrame, right: DataFrame, floor: float = SIMILAR) -> DataFrame:
    """(left_key, right_key, similarity) of all key pairs at or above ``floor``, by a trigram index.

    Keys are distinct texts in column ``key``. Instead of comparing all pairs, only the
    rarest trigrams of each key are joined: two keys that similar share at least
    ceil(floor * n) of n trigrams, so one of the first n - ceil(floor * n) + 1 in a fixed order.
    """
    a, b = (df.select("key").distinct().withColumn("grams", trigrams(F.col("key"))).where(F.size("grams") > 0) for df in (left, right))
    counts = b.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame) -> DataFrame:
        ranked = df.select("key", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(counts, "gram", "left")
        first = F.row_number().over(W.partitionBy("key").orderBy(F.coalesce("n", F.lit(0)), "gram"))
        return ranked.withColumn("place", first).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * floor) + 1).select("key", "size", "gram")

    x, y = prefixes(a), prefixes(b)
    met = x.join(y.select(F.col("key").alias("other"), F.col("size").alias("other_size"), "gram"), "gram")
    met = met.where((F.col("other_size") >= F.ceil(F.col("size") * floor)) & (F.col("size") >= F.ceil(F.col("other_size") * floor))).select("key", "other").distinct()
    score = met.withColumn("similarity", similarity(F.col("key"), F.col("other"))).where(F.col("similarity") >= floor)
    return score.select(F.col("key").alias("left_key"), F.col("other").alias("right_key"), "similarity")
