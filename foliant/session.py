"""Session and table helpers shared by every module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables that a data folder holds, one Parquet file or folder each.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def get_spark(cores: int | str = "*", app: str = "foliant", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FOLIANT_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; any path that Spark's readers can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
