"""Curated event sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.text import clean_labels, fmt_span, raw_hash
from emberlog.operators import needles
from emberlog.operators.durable import stored


def case_set(events: DataFrame, picked: DataFrame) -> DataFrame:
    """Picked events (event_id, labels, note) with the anchor by which they are found again."""
    anchors = events.select(F.col("id").alias("event_id"), "file", raw_hash(F.col("raw")).alias("raw_hash"))
    return picked.withColumn("labels", clean_labels(F.col("labels"))).join(anchors, "event_id")


def reanchor(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries (file, raw_hash, ...) with the id of the first event of that file and text; null if it is gone."""
    anchors = events.groupBy("file", raw_hash(F.col("raw")).alias("raw_hash")).agg(F.min_by("id", "id_seq").alias("event_id"))
    return entries.join(anchors, ["file", "raw_hash"], "left")


def lost(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries whose event is not there any more."""
    return entries.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti")


def locate(events: DataFrame, lines: DataFrame, prefix: int = 400) -> DataFrame:
    """(id, line, exact): an event's place in its numbered file: the first line equal to its text, else the first that holds its first 400 characters.

    Equal lines come from a join on file and text. What is left meets the lines of its file through its rarest gram, never
    through the file alone. An event without text, or whose text no line holds, has no place.
    """
    trimmed = lines.select("file", F.col("id_seq").alias("line"), F.trim("raw").alias("text"))
    wanted = events.select("id", "file", F.trim("raw").alias("text")).where(F.col("text") != "")
    first = trimmed.groupBy("file", "text").agg(F.min("line").alias("line"))
    placed = stored(wanted.join(first, ["file", "text"], "left").select("id", "file", F.when(F.col("line").isNull(), F.substring("text", 1, prefix)).alias("needle"), "line"), "placed")
    texts = trimmed.select("line", F.col("file").alias("scope"), "text")
    within = needles.by_grams(texts, placed.where("line IS NULL").select("id", F.col("file").alias("scope"), "needle"))
    loose = within.groupBy("id").agg(F.min("line").alias("line")).withColumn("exact", F.lit(False))
    return placed.where("line IS NOT NULL").select("id", "line", F.lit(True).alias("exact")).unionByName(loose)


def context(located: DataFrame, events: DataFrame, lines: DataFrame, around: int = 3) -> DataFrame:
    """The lines within ``around`` of each located event."""
    own = located.join(events.select("id", "file"), "id")
    numbered = lines.select("file", F.col("id_seq").alias("near"), "raw")
    spots = own.select("id", "file", "line", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("near"))
    return spots.join(numbered, ["file", "near"]).select("id", "near", (F.col("near") == F.col("line")).alias("is_event"), "raw")


def file_page(lines: DataFrame, needle: str = "", offset: int = 0, limit: int = 200, cut: int = 2000) -> DataFrame:
    """A page of a file's numbered lines that hold a text, apart from case; long lines are cut for display."""
    found = lines.where(F.lower("raw").contains(needle.lower())) if needle else lines
    return found.orderBy("file", "id_seq").offset(offset).limit(limit).select("file", F.col("id_seq").alias("line"), F.substring("raw", 1, cut).alias("text"))


def gaps(entries: DataFrame, *by: str) -> DataFrame:
    """Timeline entries (ts, id_seq) with the seconds since the one before, of the same ``by`` if given, and their text, as ``+3m 12s``.

    A case's timeline is small; pool-wide timelines should be told apart by something.
    """
    at = F.unix_timestamp("ts")
    before = F.lag(at).over(W.partitionBy(*by).orderBy(F.col("ts").asc_nulls_last(), "id_seq"))
    return entries.withColumn("gap_seconds", at - before).withColumn("gap", F.when(F.col("gap_seconds").isNotNull(), F.concat(F.lit("+"), fmt_span(F.col("gap_seconds")))))
