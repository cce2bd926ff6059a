"""Operator 2: contiguous shards of near equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeep.operators.prefix import RANK, prefix_sums


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, whole_group: float = 0.1) -> DataFrame:
    """Cut the documents into ``n_shards`` contiguous shards whose byte sizes are near equal.

    Documents stand in the order of their text's hash, so that equal texts are neighbours
    and each shard is a fair mixture. Prefix sums of the sizes are cut at equal targets.
    A cut that falls inside a group of equal texts moves to the group's nearer end if the
    group holds at most ``whole_group`` of a shard; larger groups are split, which keeps
    the sizes near equal however large a group grows.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot
    (position in the shard, gapless from 0) and grown_shard (null: only a law by key has it).
    Null texts count as empty; null and repeated doc_ids and repeated rows are sharded like
    any others; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    )
    order = [F.col(c) for c in ("_hash", "text_crc32", "size", "doc_id")]
    placed, totals = prefix_sums(rows, order, {"_start": "size"})
    cuts = [totals["_start"] * k // n_shards for k in range(1, n_shards)]

    # The documents that hold the last byte before a cut: one for each cut at most.
    before = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    straddling = placed.where(F.exists(before, lambda c: (F.col("_start") < c) & (c <= F.col("_start") + F.col("size"))))
    held = straddling.select("_hash", "_start", "size").collect() if totals[RANK] else []
    for k, c in enumerate(cuts):
        for r in held:  # a cut stands between documents
            if r["_start"] < c <= r["_start"] + r["size"]:
                cuts[k] = r["_start"] if c - r["_start"] < r["_start"] + r["size"] - c else r["_start"] + r["size"]
    hashes = sorted({r["_hash"] for r in held})
    if hashes:
        groups = placed.where(F.col("_hash").isin(hashes)).groupBy("_hash", "text_crc32")
        ends = groups.agg(F.min("_start").alias("lo"), F.max(F.col("_start") + F.col("size")).alias("hi")).collect()
        limit = whole_group * totals["_start"] / n_shards
        for k, c in enumerate(cuts):
            for g in ends:
                if g["lo"] < c < g["hi"] <= g["lo"] + limit:
                    cuts[k] = g["lo"] if c - g["lo"] <= g["hi"] - c else g["hi"]
    shard = F.lit(0) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_start")))
    sharded = placed.withColumn("shard", shard.cast("int"))
    firsts = sharded.groupBy("shard").agg(F.min(RANK).alias("_first"))
    return sharded.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col(RANK) - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
