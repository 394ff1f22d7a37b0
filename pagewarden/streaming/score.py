"""Scores of a stream of navigations, with settings that may change while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagewarden.operators.verdicts import is_navigation, score_urls
from pagewarden.sources.files import read_membership, read_settings


def score_navigations(spark: SparkSession, events: DataFrame, settings_path: str, out: str, checkpoint: str, filter_path: str | None = None, once: bool = False) -> StreamingQuery:
    """Append tab_id, ts, url and verdict of the navigations among events (tab_id, ts, frame_id, url) to Parquet files.

    Nothing is scored before the settings and the filter of popular domains are there: both are read ahead
    of the first batch, and what can't be read ends the call. The settings are read again for each batch,
    so a change takes effect with the next one. With `once` it ends when all there is has been scored.
    """
    read_settings(spark, settings_path)
    popular = read_membership(spark, filter_path) if filter_path else None

    def score(batch: DataFrame, _: int) -> None:
        rows = batch.filter(is_navigation(batch["frame_id"], batch["url"])).select("tab_id", "ts", "url")
        score_urls(rows, settings=read_settings(spark, settings_path), popular=popular).select("tab_id", "ts", "url", "verdict").write.mode("append").parquet(out)

    stream = events.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
