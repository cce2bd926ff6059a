"""Where intermediate tables are written and iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local session gets a temporary folder; on a cluster that would
    lose data with the machine, so that is an error.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="rollkeep-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(held)
    return held


def fresh_dir(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/rollkeep-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: the lineage ends here and survives lost executors.

    Unlike a checkpoint the copy is columnar and compressed, its size is known to the
    planner, and later readers take only the columns they need.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
