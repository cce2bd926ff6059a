"""Operator 10: mix sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.operators.prefix import RANK, prefix_sums
from rollkeep.llm.storage import fresh, materialize

SPACES = "[ \\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and 0x09-0x0D; null has none."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), SPACES)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """One row for each source: its size, target, share rate and the rank of its first row.

    Sources take the weights in turn by code point, null last. The whole size is shared by
    weight; a source stops at ``cap`` times its own size and the excess is shared again
    among the others, until none is above. Each round is one aggregate over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    ranked, totals = prefix_sums(sources, [F.col("source")], {"_first": "_docs", "_words": "source_size"})
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = materialize(ranked.withColumn("_weight", F.element_at(turn, (F.col(RANK) % len(weights) + 1).cast("int"))))
    total, rate, before = totals["_words"], 0.0, None
    while True:
        above = F.col("_weight") * F.lit(rate) > cap * F.col("source_size")
        got = ranked.agg(F.sum(F.when(above, F.col("source_size"))).alias("held"), F.sum(F.when(~above, F.col("_weight"))).alias("open")).first()
        state = (got["held"] or 0, got["open"] or 0)
        if state == before or not state[1]:
            break
        rate, before = (total - cap * state[0]) / state[1], state
    share = F.col("_weight") * F.lit(rate)
    most = cap * F.col("source_size")
    return materialize(ranked.select("source", "source_size", "_first", F.when(share > most, most).otherwise(share).cast("double").alias("target")))


def random_offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def systematic_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 10) -> DataFrame:
    """How often the mix takes each document: columns of ``docs`` plus size, source_size, target, copies.

    ``docs`` has doc_id, source and size; other columns pass through. Within a source the
    documents stand by size, so that large and small ones are taken in proportion; each
    expects target / source_size copies. Running sums of these, shifted by one random
    offset for each source, give a copy wherever they cross an integer. A source
    without words has target 0 and gives no copies. An empty table gives no rows.
    """
    targets = source_targets(docs, weights, cap)
    order = [F.col("source"), F.col("size"), F.col("doc_id")]
    placed, _ = prefix_sums(docs, order, {})
    t = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col(RANK) - F.col("_first")
    offset = random_offset(F.col("source"), seed)
    copies = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    joined = placed.join(t, placed["source"].eqNullSafe(t["_source"]))
    return joined.withColumn("copies", copies.cast("long")).drop(RANK, "_first", "_source")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 10) -> DataFrame:
    """doc_id, size (words), source_size, target (of its source) and taken (words, repeats counted).

    Null texts have size 0; a null source is a source of its own, the last. Repeated rows
    and repeated or null doc_ids are documents like any others; other columns are ignored.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    taken = systematic_copies(materialize(sized), weights, cap, seed)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 10) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    row, times = fresh("_row", docs), fresh("_times", docs)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    sized = numbered.select(F.col(row).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    copies = systematic_copies(materialize(sized), weights, cap, seed).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    taken = numbered.join(copies, row)
    return taken.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)
