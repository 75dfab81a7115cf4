"""Session settings that the engine is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "bhashaloom", **settings: str) -> SparkSession:
    """A local session for tests and bench; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "6g",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables in a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Frame over as many tasks as there are cores, where its files give fewer than half as many.

    Small files would else keep most cores idle through costly steps. Large tables have splits enough and stay as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if 2 * frame._jdf.queryExecution().toRdd().getNumPartitions() < cores else frame
