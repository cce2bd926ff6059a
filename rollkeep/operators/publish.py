"""Between reading and the register: which rows are published as which type, with what evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.plans.schema import patched


def kept_manual(read: Column, old: Column, old_methods: Column) -> Column:
    """Values of a new reading; what a person had entered before survives it."""
    return patched(read, F.map_filter(old, lambda k, v: v.isNotNull() & (F.coalesce(F.try_element_at(old_methods, k), F.lit("")) == "manual")))


def provenance(methods: Column, sources: Column) -> Column:
    """field -> struct(method, page_number, snippet) of what is known about each value."""
    return F.map_zip_with(methods, sources, lambda k, m, s: F.struct(m.alias("method"), s["page_number"].alias("page_number"), s["snippet"].alias("snippet")))


def resolved_types(rows: DataFrame, batches: DataFrame, types: DataFrame) -> DataFrame:
    """``rows`` with ``type_id``: the batch's pinned type, else the active type of the row's classifier key.

    rows: batch_id, class_key; batches: batch_id, pinned_type; types: type_id, class_key, active.
    Of several active types with one key the smallest id counts.
    """
    active = types.where("active").groupBy("class_key").agg(F.min("type_id").alias("by_key"))
    joined = rows.join(batches.select("batch_id", "pinned_type"), "batch_id", "left").join(active, "class_key", "left")
    return joined.withColumn("type_id", F.coalesce("pinned_type", "by_key")).drop("pinned_type", "by_key")


def to_publish(rows: DataFrame, register: DataFrame) -> DataFrame:
    """Rows with a type and an identifier that the register doesn't cite yet; safe to run again.

    rows: extraction_id, type_id, number; register: source_extraction_id.
    """
    ready = rows.where(F.col("type_id").isNotNull() & (F.trim("number") != ""))
    done = register.select(F.col("source_extraction_id").alias("extraction_id"))
    return ready.join(done, "extraction_id", "left_anti")


def export_summary(rows: DataFrame, by: str) -> DataFrame:
    """What an export will hold: rows, unreviewed rows and certificate types by ``by``."""
    unreviewed = F.count_if(F.col("status").isin("NEEDS_REVIEW", "FAILED"))
    return rows.groupBy(by).agg(F.count("*").alias("total"), unreviewed.alias("unreviewed"), F.array_join(F.array_sort(F.collect_set("type_id")), ",").alias("types"))


def cursor(at: Column, id_column: Column) -> Column:
    """An opaque text for the place in an order by time and id."""
    return F.base64(F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), id_column.cast("string").alias("i"))).cast("binary"))


def read_cursor(text: Column) -> Column:
    """struct(t, i) of a cursor; null where the text isn't one."""
    read = F.from_json(F.try_to_binary(text, F.lit("base64")).cast("string"), "t timestamp_ntz, i string")
    return F.when(read["t"].isNotNull() & read["i"].isNotNull(), read)


def candidate_values(candidates: DataFrame) -> DataFrame:
    """One candidate for each unit and field: the most certain, of equals that of the earliest page."""
    order = W.partitionBy("unit_id", "field").orderBy(F.desc("confidence"), "page_number", "value")
    return candidates.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
