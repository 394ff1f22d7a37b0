"""Sessions, and the package on the workers' path."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    That is enough where the folder is shared or the session is local; elsewhere ship the package with
    --py-files or install it.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is dear for each row.

    A table of a few files or row groups is dealt out evenly; one with enough partitions, as any large
    one has, stays as it is and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_session(name: str = "pagewarden", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with settings that suit small data; a cluster's own settings come from spark-submit."""
    settings = {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true"} | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return on_workers(builder.getOrCreate())
