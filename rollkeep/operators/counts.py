"""Counters, serial numbers and other aggregates over the register and its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeep.operators.prefix import RANK, prefix_sums
from rollkeep.sources.scratch import materialize


def by_status(rows: DataFrame, batch: str, status: str, size: str) -> DataFrame:
    """Rows and bytes of each batch and status."""
    return rows.groupBy(batch, status).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def closure(rows: DataFrame, batch: str, open_status: str, failed_status: str) -> DataFrame:
    """Whether a batch is still open, complete, or complete with errors."""
    is_open, failed = F.max(F.col(open_status).cast("int")) == 1, F.max(F.col(failed_status).cast("int")) == 1
    return rows.groupBy(batch).agg(F.when(is_open, "OPEN").when(failed, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED").alias("status"))


def review_counts(entries: DataFrame) -> DataFrame:
    """Entries to review and suspected duplicates by workspace; the total is the first, not the sum."""
    held = entries.where("status <> 'VOID'")
    return held.groupBy("workspace_id").agg(F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("duplicate_status") == "SUSPECTED").alias("suspected"), F.count_if("needs_review").alias("total"))


def serials(rows: DataFrame, batch: str, order: list[str]) -> DataFrame:
    """``rows`` with the serial number of each row in its batch, from 1, before any filter.

    Rows are ranked over all batches by ranges, and the rank of a batch's first row is
    taken off, so that a batch of any size is spread over tasks.
    """
    ranked = materialize(prefix_sums(rows, [F.col(c) for c in (batch, *order)], {})[0])
    firsts = ranked.groupBy(F.col(batch).alias("_batch")).agg(F.min(RANK).alias("_first"))
    return ranked.join(firsts, F.col(batch).eqNullSafe(F.col("_batch"))).withColumn("serial", F.col(RANK) - F.col("_first") + 1).drop(RANK, "_batch", "_first")


def progress(rows: DataFrame, batch: str, done: str) -> DataFrame:
    """Percent of a batch's rows that are done, to one digit."""
    return rows.groupBy(batch).agg(F.round(100.0 * F.count_if(done) / F.count("*"), 1).alias("percent"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """Share of exact values overall, by document and by field, of (document, field, expected, actual)."""
    exact = F.avg(F.expr("case when expected <=> actual then 1.0D else 0.0D end"))
    sets = outcomes.groupingSets([("document",), ("field",), ()], "document", "field")
    return sets.agg(F.round(exact, 4).alias("accuracy"), F.count("*").alias("n"))


def next_versions(versions: DataFrame, key: str, version: str) -> DataFrame:
    return versions.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast("long").alias("next_version"))


def distinct_keys(rows: DataFrame, fields: str, batch: str) -> DataFrame:
    """The different keys of a map column by batch, sorted."""
    return rows.select(batch, F.explode(F.map_keys(fields)).alias("key")).distinct().groupBy(batch).agg(F.array_sort(F.collect_set("key")).alias("keys"))


def unit_reading(pages: DataFrame) -> DataFrame:
    """Of each unit the mean OCR confidence, whether any page needed OCR, and the first page's language that isn't blank."""
    spoken = F.when(F.col("language") != "", F.struct("page_number", "language"))
    return pages.groupBy("unit_id").agg(F.round(F.avg("confidence"), 2).alias("confidence"), F.coalesce(F.bool_or("needed_ocr"), F.lit(False)).alias("ocr_used"), F.min(spoken)["language"].alias("language"))
