"""Documents passed through stages, each of which takes effect once however often it is delivered.

State is a log that is only added to: each stage writes, for each delivery it answers, one folder of
moves (document_id, version, status, code) named by stage and delivery. The status of a document is that
of its highest version. A stage takes only documents that stand in a status it accepts (compare), and its
move carries the next version (set). Results are written before the moves and count only if their
delivery has moves, so what a killed attempt leaves is not seen and is replaced when the
delivery comes again; a delivery that was answered before gives the same rows under the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeep.sources.scratch import materialize

FAILED = "FAILED"
MOVES = "document_id long, version long, status string, code string, stage string, delivery string"


@dataclass(frozen=True)
class Stage:
    """``work`` makes of claimed documents rows of (document_id, code, ...): code is null, or why the document failed.

    It may give several rows for a document, or none. ``takes`` are the statuses it accepts, ``gives`` the status that follows.
    """

    name: str
    takes: tuple[str, ...]
    gives: str
    work: Callable[[DataFrame], DataFrame]


def moves(spark: SparkSession, root: str) -> DataFrame:
    """All moves so far."""
    spark.createDataFrame([], MOVES).write.mode("append").partitionBy("stage", "delivery").parquet(f"{root}/moves")  # so that there is a table
    return spark.read.schema(MOVES).parquet(f"{root}/moves")


def register(docs: DataFrame, root: str, delivery: str, status: str = "QUEUED") -> None:
    """Enter documents that the log doesn't hold; those it holds stay as they are."""
    spark = docs.sparkSession
    known = moves(spark, root).where(~_this("register", delivery)).select("document_id")
    new = docs.select(F.col("document_id").cast("long").alias("document_id")).where("document_id IS NOT NULL").distinct().join(known, "document_id", "left_anti")
    _write(new.select("document_id", F.lit(1).cast("long").alias("version"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("code")), f"{root}/moves/stage=register/delivery={delivery}")


def _this(stage: str, delivery: str) -> Column:
    return (F.col("stage") == stage) & (F.col("delivery") == delivery)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def states(log: DataFrame) -> DataFrame:
    """(document_id, version, status, code) of each document of a log.

    Two moves of one version are told apart by stage and delivery, the first in order being the one that counts.
    """
    last = log.groupBy("document_id").agg(F.max("version").alias("version"))
    return log.join(last, ["document_id", "version"]).groupBy("document_id", "version").agg(F.min(F.struct("stage", "delivery", "status", "code")).alias("_m")).select("document_id", "version", "_m.status", "_m.code")


def claim(batch: DataFrame, log: DataFrame, takes: tuple[str, ...]) -> DataFrame:
    """The rows of a batch whose document stands in one of the statuses, with its ``version``; of repeated rows of a document one."""
    once = batch.where("document_id IS NOT NULL").dropDuplicates(["document_id"])
    held = states(log.join(once.select("document_id"), "document_id", "left_semi"))
    return once.join(held.where(F.col("status").isin(*takes)).select("document_id", "version"), "document_id")


def advance(batch: DataFrame, delivery: str, stage: Stage, root: str) -> None:
    """Answer one delivery of documents (document_id, ...): claim, work, results, moves.

    Documents that this delivery moved before and that have gone on since keep their move and
    their results; the others are claimed as if it hadn't been answered.
    """
    spark = batch.sparkSession
    log, own = moves(spark, root), _this(stage.name, delivery)
    claimed = materialize(claim(batch, log.where(~own), stage.takes))
    kept = materialize(log.where(own).join(claimed, "document_id", "left_anti").select("document_id", "version", "status", "code"))
    done = stage.work(claimed.drop("version"))
    out = f"{root}/results/stage={stage.name}/delivery={delivery}"
    if not kept.isEmpty():
        done = done.unionByName(materialize(spark.read.schema(done.schema).parquet(out).join(kept, "document_id", "left_semi")))
    _write(done, out)
    codes = spark.read.schema(done.schema).parquet(out).groupBy("document_id").agg(F.min("code").alias("code"))
    moved = claimed.select("document_id", "version").join(codes, "document_id", "left")
    moved = moved.select("document_id", (F.col("version") + 1).alias("version"), F.when(F.col("code").isNull(), stage.gives).otherwise(FAILED).alias("status"), "code")
    _write(moved.unionByName(kept), f"{root}/moves/stage={stage.name}/delivery={delivery}")


def results(spark: SparkSession, root: str, stage: Stage, form: str) -> DataFrame:
    """The rows that ``stage`` gave, of answered deliveries only; ``form`` is their schema."""
    answered = moves(spark, root).where(F.col("stage") == stage.name).select("document_id", "delivery")
    rows = spark.read.schema(f"{form}, delivery string").option("basePath", f"{root}/results/stage={stage.name}").parquet(f"{root}/results/stage={stage.name}")
    return rows.join(answered, ["document_id", "delivery"]).drop("delivery")


def run(stream: DataFrame, stage: Stage, root: str, checkpoint: str) -> None:
    """Answer all that a stream of documents holds now; a restart goes on with the delivery that was cut off.

    Deliveries are named by the checkpoint's batch number and its folder, so two streams into one stage don't meet.
    """
    name = checkpoint.rstrip("/").rpartition("/")[2]
    stream.writeStream.foreachBatch(lambda batch, epoch: advance(batch, f"{name}-{epoch}", stage, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
