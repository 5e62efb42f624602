"""Sliding-window bursts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key's time line is cut into slices of so many windows; each slice also sees one window of the slice before it.
SLICE_WINDOWS = 8


def find_bursts(events: DataFrame, key: Column, window: int, threshold: int | Column, scale: Column | None = None) -> DataFrame:
    """For each key the event that ends the densest window of ``window`` seconds, if it holds ``threshold`` events.

    Returns key, id, epoch, count, first_id and first_epoch (the window's first event). Among equally dense windows the
    earliest counts. Events of one second count in record order: those up to the ending event. Events without time or
    key take no part. ``threshold`` and ``scale`` (units a second; the window is then in units) are constant for a key.

    No key gathers in one task: a second's events are counted before they are shuffled, as only the last of them can end
    the densest window; seconds are then windowed by slices of the key's time line, each with a halo of one window.
    """
    least, scale = (threshold if isinstance(threshold, Column) else F.lit(threshold)), F.lit(1) if scale is None else scale
    own = events.select(key.alias("key"), "id", "id_seq", F.unix_timestamp("ts").alias("epoch"), scale.cast("long").alias("scale"), least.alias("least")).where(F.col("epoch").isNotNull() & F.col("key").isNotNull() & (F.col("key") != ""))
    seconds = own.groupBy("key", "epoch").agg(F.count("*").alias("n"), F.min("scale").alias("scale"), F.min("least").alias("least"), F.min_by("id", F.struct("id_seq", "id")).alias("head"), F.max_by("id", F.struct("id_seq", "id")).alias("tail"))
    span = max(window, 1) * SLICE_WINDOWS
    placed = seconds.withColumn("scaled", F.col("epoch") * F.col("scale")).withColumn("own", F.floor(F.col("scaled") / span))
    halo = F.when(F.col("scaled") >= (F.col("own") + 1) * span - window, F.col("own") + 1)
    sliced = placed.withColumn("slice", F.explode(F.array_compact(F.array("own", halo))))
    ranged = W.partitionBy("key", "slice").orderBy("scaled").rangeBetween(-window, 0)
    counted = sliced.withColumn("count", F.sum("n").over(ranged)).withColumn("first", F.first(F.struct("head", "epoch")).over(ranged))
    dense = counted.where((F.col("slice") == F.col("own")) & (F.col("count") >= F.col("least")))
    best = dense.groupBy("key").agg(F.max_by(F.struct(F.col("tail").alias("id"), "epoch", "count", "first"), F.struct("count", -F.col("epoch"))).alias("b"))
    return best.select("key", "b.id", "b.epoch", "b.count", F.col("b.first.head").alias("first_id"), F.col("b.first.epoch").alias("first_epoch"))


def burst_ratio(events: DataFrame, bin_seconds: int = 60, least_events: int = 30, least_bins: int = 3) -> DataFrame:
    """Each event's bin count over the median of its source's non-empty bins; bins start at the source's first event.

    Sources with too few stamped events or bins have no ratio.
    """
    stamped = events.where(F.col("ts").isNotNull()).select("id", "source_id", F.unix_timestamp("ts").alias("epoch"))
    first = stamped.groupBy("source_id").agg(F.min("epoch").alias("lo"), F.count("*").alias("n"))
    binned = stamped.join(first, "source_id").withColumn("bin", F.floor((F.col("epoch") - F.col("lo")) / bin_seconds))
    bins = binned.groupBy("source_id", "bin").agg(F.count("*").alias("in_bin"))
    medians = bins.groupBy("source_id").agg(F.percentile("in_bin", 0.5).alias("median"), F.count("*").alias("bins"))
    fit = medians.where(F.col("bins") >= least_bins)
    return binned.where(F.col("n") >= least_events).join(bins, ["source_id", "bin"]).join(fit, "source_id").select("id", "source_id", "in_bin", "median", (F.col("in_bin") / F.col("median")).alias("ratio"))
