"""Collection from files that keep arriving: each batch adds only URLs that the store hasn't seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.operators.collection import parse_feed
from pagewarden.sources.store import Store


def collect_feed(spark: SparkSession, feed_dir: str, store: Store, day: str, checkpoint: str, source: str = "openphish", label: int = 1, limit: int = 5000):
    """Take all feed files that are new since the last run into the store, and end; running it again is harmless."""

    def add(batch: DataFrame, _: int) -> None:
        lines = batch.select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
        store.collect("phishing" if label == 1 else "benign", parse_feed(lines, limit), source, label, day)

    stream = spark.readStream.schema("value string").text(feed_dir)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
