"""The Spark session the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "rollkeep", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys have underscores for dots.

    On a cluster pass ``spark_checkpoint_dir``, a folder that driver and executors share.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
