"""Global prefix sums over an ordered table from per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.sources.scratch import materialize

RANK = "_rank"


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """Number the rows of ``df`` in ``order`` and add exclusive running sums.

    ``sums`` maps each new column to the (long) column it accumulates. The rows are dealt
    into ranges of the order, each range keeps its own running sums, and the sum of the
    ranges before it is added: only one row of totals per range meets on the driver.
    Rows equal in the whole order are told apart by their place in the input, so that
    one repeated row can't fill a range. Returns the table with ``_rank`` (from 0) and the
    sums, and the grand totals (``_rank`` holds the row count).
    """
    spark = df.sparkSession
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    tied = df.select("*", *keys, F.monotonically_increasing_id().alias("_tie"))
    by = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))] + [F.col("_tie")]
    ranged = materialize(tied.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))

    held = {RANK: F.lit(1)} | {k: F.col(v) for k, v in sums.items()}
    totals = ranged.groupBy("_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in held.items()]).orderBy("_range").collect()
    offsets, so_far = [], dict.fromkeys(held, 0)
    for t in totals:
        offsets.append((t["_range"], *so_far.values()))
        so_far = {k: v + t[k] for k, v in so_far.items()}
    offset = spark.createDataFrame(offsets, "_range int, " + ", ".join(f"_before{i} long" for i in range(len(held))))

    # One row for each range, so its size is bounded by the number of partitions.
    within = W.partitionBy("_range").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.join(F.broadcast(offset), "_range")
    for i, (k, c) in enumerate(held.items()):
        out = out.withColumn(k, F.col(f"_before{i}") + F.coalesce(F.sum(c).over(within), F.lit(0)) - F.coalesce(c, F.lit(0)))
    return out.select(*df.columns, *held), so_far
