"""Session settings used by tests, the bench and local runs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "8", name: str = "quire") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "12g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Joins within a document carry its id among their keys, and every side is placed by it:
# with the first setting off they run on that placement instead of shuffling by all keys.
# The second keeps a union of placed sides from claiming their placement: adaptive
# execution may coalesce the sides differently afterwards. The third bounds what Python
# workers are handed at once by its bytes: rows hold whole documents, packages and archives.
# The last two keep a task's share of the documents small whatever their number: they are
# placed before they become tokens, which take a hundred times their bytes.
PLAN_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
                 "spark.sql.unionOutputPartitioning": "false",
                 "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
                 "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000"}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.sparkContext.getCheckpointDir()
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = where or tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where
