"""Streaming ingest: raw landing at once, parsing later by source, rules on the stream, and burst alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.operators.normalize import normalize
from emberlog.operators.report import write_events
from emberlog.sources.lines import number_lines, raw_events


def land(spark: SparkSession, path: str, out: str, checkpoint: str, year: int, latest: str | None = None):
    """Phase one: new lines of a folder's text files as events with whatever time leads them.

    A batch is written to a folder of its own, so a batch that is run again replaces what it wrote before.
    """
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))

    def commit(batch: DataFrame, number: int) -> None:
        raw_events(number_lines(batch), year, latest).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def replace_sources(landed: DataFrame, parse: Callable[[DataFrame], DataFrame], source: str, out: str, checkpoint: str):
    """Phase two: each micro-batch is parsed, normalized and put in place of its sources' earlier rows."""

    def commit(batch: DataFrame, _: int) -> None:
        write_events(normalize(parse(batch.select("file", "id_seq", "raw")), source), out)

    return landed.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def split_by_time(events: DataFrame, delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Stamped events with a watermark, and unstamped ones, which no watermark may drop."""
    return events.where("ts IS NOT NULL").withWatermark("ts", delay), events.where("ts IS NULL")


def rates(events: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events a window and source, final once the watermark has passed."""
    stamped, _ = split_by_time(events, delay)
    return stamped.groupBy(F.window("ts", window), "source").agg(F.count("*").alias("n"))


def burst_alerts(events: DataFrame, key: str, window: int, threshold: int) -> DataFrame:
    """An alert when a key's count in its trailing window reaches the threshold; then again only after it fell below.

    State is the key's times within the window, bounded by the threshold. Unlike the batch rule it cannot know the
    densest window; the batch result stays the truth.
    """
    own = events.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", f"{window} seconds").select(F.col(key).alias("key"), "id", "ts", F.unix_timestamp("ts").alias("epoch"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, alerted = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        rows = pd.concat(list(parts)).sort_values(["epoch", "id"])
        out = []
        for epoch, event in zip(rows["epoch"], rows["id"], strict=True):
            times = [t for t in times if t >= epoch - window][-threshold + 1 :] + [epoch] if threshold > 1 else [epoch]
            full = len(times) >= threshold
            if full and not alerted:
                out.append((k[0], event, int(epoch), len(times)))
            alerted = full
        state.update((times, alerted))
        state.setTimeoutTimestamp(max(int((max(times) + window + 1) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "id", "epoch", "count"])

    return own.groupBy("key").applyInPandasWithState(step, "key string, id string, epoch long, count long", "times array<long>, alerted boolean", "append", GroupStateTimeout.EventTimeTimeout)
