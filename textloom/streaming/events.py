"""Streaming forms of the history queries: the same aggregates with watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder of events."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


def once(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and ends; a second call goes on from the checkpoint."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Source units (path, text, modified) of files as they come into a folder, each read whole."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def debounced(changes: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(path, start, n): bursts of changes (path, modified) of a file, over once it has been quiet."""
    g = changes.withWatermark("modified", late).groupBy("path", F.session_window("modified", quiet)).agg(F.count("*").alias("n"))
    return g.select("path", F.col("session_window.start").alias("start"), "n")


#: Version of the state below; a state of an earlier one is begun anew.
STATE = 2


def severities(runs: DataFrame) -> DataFrame:
    """(rule_id, runs, severity) after each batch of runs (rule_id, fired): a rule that fires in three runs on end rises to high, and in five falls to low.

    The number of runs on end is kept for each rule, with the version of what is kept.
    """

    def follow(key, batches, state):
        version, streak = state.get if state.exists else (STATE, 0)
        streak = streak if version == STATE else 0
        for batch in batches:
            for fired in batch["fired"]:
                streak = streak + 1 if fired else 0
        state.update((STATE, streak))
        yield pd.DataFrame({"rule_id": [key[0]], "runs": [streak], "severity": ["low" if streak >= 5 else "high" if streak >= 3 else "medium"]})

    return runs.groupBy("rule_id").applyInPandasWithState(follow, "rule_id string, runs int, severity string", "version int, streak int", "update", GroupStateTimeout.NoTimeout)
