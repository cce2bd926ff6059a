"""Review of entries: actions folded in order, revisions, replaced documents, manual splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folded(actions: DataFrame) -> DataFrame:
    """(id, status, version) after the actions (id, at, action) on each entry in order.

    Entries begin suspected. 'settle' answers the question, 'approve' works only after
    that, 'correct' adds a version, 'void' ends it; others change nothing. The state
    depends on the order, so it is a fold; each step is a small state, and running
    maxima over the order replace a row-by-row loop: nothing of an entry is gathered.
    """
    order = W.partitionBy("id").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = lambda a: F.coalesce(F.max(F.when(F.col("action") == a, 1)).over(order), F.lit(0))
    marked = actions.withColumns({"settled": seen("settle"), "voided": seen("void")})
    open_step = (F.col("voided") == 0) | (F.col("action") == "void")
    counted = marked.withColumns({"approved": (F.col("action") == "approve") & (F.col("settled") == 1) & open_step, "corrected": (F.col("action") == "correct") & open_step})
    last = counted.groupBy("id").agg(F.max("settled").alias("settled"), F.max("voided").alias("voided"), F.max(F.col("approved").cast("int")).alias("approved"), F.count_if("corrected").alias("corrections"))
    status = F.when(F.col("voided") == 1, "VOID").when(F.col("approved") == 1, "APPROVED").when(F.col("settled") == 1, "OPEN").otherwise("SUSPECTED")
    return last.select("id", status.alias("status"), (F.col("corrections") + 1).alias("version"))


def revision_changes(revisions: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Revisions with whether the value differs from the version before."""
    by = W.partitionBy(key).orderBy(version)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(by)) & (F.row_number().over(by) > 1)
    return revisions.withColumn("changed", changed)


def current(revisions: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of each entry; all versions stay in the table."""
    newest = revisions.groupBy(key).agg(F.max(version).alias(version))
    return revisions.join(newest, [key, version])


def replaced(links: DataFrame, replacements: DataFrame) -> DataFrame:
    """Links after a document is replaced: the old link is superseded, the new one takes over its pages."""
    old = links.join(replacements, "document_id", "left")
    kept = old.select("certificate_id", "document_id", "page_start", "page_end", F.when(F.col("new_document_id").isNotNull(), "SUPERSEDED").otherwise(F.col("state")).alias("state"))
    new = old.where("new_document_id is not null").select("certificate_id", F.col("new_document_id").alias("document_id"), "page_start", "page_end", F.lit("PRIMARY").alias("state"))
    return kept.unionByName(new)


def split_unit(units: DataFrame, at: Column) -> DataFrame:
    """Units cut before page ``at`` where that lies inside; ordinals are given anew."""
    inside = (at > F.col("page_start")) & (at <= F.col("page_end"))
    parts = F.when(inside, F.array(F.struct(F.col("page_start").alias("s"), (at - 1).alias("e")), F.struct(at.alias("s"), F.col("page_end").alias("e")))).otherwise(F.array(F.struct(F.col("page_start").alias("s"), F.col("page_end").alias("e"))))
    rows = units.select("document_id", F.inline(parts)).select("document_id", F.col("s").alias("page_start"), F.col("e").alias("page_end"))
    return renumbered(rows)


def merge_units(units: DataFrame, first: Column) -> DataFrame:
    """Adjacent units ``first`` and the next of the same document become one; ordinals are given anew."""
    group = F.when(F.col("ordinal") == first + 1, first).otherwise(F.col("ordinal"))
    rows = units.groupBy("document_id", group.alias("g")).agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    return renumbered(rows.drop("g"))


def renumbered(units: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("document_id").orderBy("page_start", "page_end")) - 1
    return units.withColumn("ordinal", place.cast("long"))
