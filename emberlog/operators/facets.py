"""Counts by value, field facets, time histograms and entity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.operators.dsl import field_value, node_query
from emberlog.operators.search import page, spread_sample, where

FIXED = {"source": "source", "sourceid": "source_id", "source_id": "source_id", "file": "file", "host": "host", "user": "user", "sev": "sev"}


def group_values(name: str) -> Column:
    """The values of an event that it is counted under, as an array; empty for none."""
    low = name.lower()
    if low in FIXED:
        values = F.array(F.col(FIXED[low]))
    elif low == "entity":
        values = F.col("entities")
    elif low in ("detection", "rule"):
        values = F.transform("detections", lambda d: d["id"])
    else:
        values = F.array(field_value(name))
    return F.coalesce(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), F.array().cast("array<string>"))


def aggregate(found: DataFrame, group_by: str, top: int = 200) -> DataFrame:
    """value, n, first and last time, most frequent first, ties by value."""
    exploded = found.select("ts", F.explode(group_values(group_by)).alias("value"))
    counted = exploded.groupBy("value").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return counted.orderBy(F.desc("n"), "value").limit(min(top, 200))


def without_field(found: DataFrame, group_by: str) -> DataFrame:
    return found.agg(F.count_if(F.size(group_values(group_by)) == 0).alias("without_field"))


def distinct_values(found: DataFrame, group_by: str) -> DataFrame:
    return found.select(F.explode(group_values(group_by)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def _pairs() -> Column:
    """(name, value) of the fixed columns and of the dynamic fields that are not named like one."""
    fixed = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("source", "file", "host", "user", "sev")]
    dynamic = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    own = F.filter(dynamic, lambda p: ~p["name"].isin("source", "file", "host", "user", "sev"))
    return F.filter(F.concat(F.array(*fixed), F.coalesce(own, F.array().cast("array<struct<name:string,value:string>>"))), lambda p: p["value"] != "")


def facets(found: DataFrame, top: int = 8) -> DataFrame:
    """For each field its commonest values: name, events, distinct_values, value, n, rank. Pre-aggregated by (name, value)."""
    counted = found.select(F.inline(_pairs())).groupBy("name", "value").agg(F.count("*").alias("n"))
    per_name = counted.groupBy("name").agg(F.sum("n").alias("events"), F.count("*").alias("distinct_values"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)
    return ranked.join(per_name, "name")


UNITS = {"minute": 60, "hour": 3600, "day": 86_400}


def histogram(found: DataFrame, unit: str = "auto") -> DataFrame:
    """bucket and n of the non-empty buckets; events without time in the row of bucket null.

    ``auto`` takes minutes up to three hours of span, hours up to five days, else days.
    """
    if unit == "auto":
        row = found.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        span = (row["hi"] - row["lo"]).total_seconds() if row["lo"] else 0
        unit = "minute" if span <= 3 * 3600 else "hour" if span <= 5 * 86_400 else "day"
    at = F.unix_timestamp("ts")
    return found.groupBy(F.timestamp_seconds(at - F.pmod(at, F.lit(UNITS[unit]))).alias("bucket")).agg(F.count("*").alias("n"))


def peak(buckets: DataFrame) -> DataFrame:
    """The fullest bucket, the first of equals."""
    return buckets.where("bucket IS NOT NULL").orderBy(F.desc("n"), "bucket").limit(1)


def sources(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id", "file", "source").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def source_states(source_rows: DataFrame) -> DataFrame:
    """One row: how many sources wait for parsing, are not done yet, and need a person's decision.

    ``source_rows`` has state (READY, REVIEW or MAP) and parsed, whether the second phase has run.
    """
    undone, asked = ~F.col("parsed"), F.col("state") != "READY"
    return source_rows.agg(F.count("*").alias("sources"), F.count_if(undone & ~asked).alias("pending"), F.count_if(undone).alias("outstanding"), F.count_if(asked).alias("needs_action"))


def field_vocabulary(events: DataFrame) -> DataFrame:
    return events.select(F.explode(F.map_keys("fields")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def case_snapshot(events: DataFrame) -> DataFrame:
    """One row: events, tally of severities, range, distinct detections and entities."""
    entities = events.select(F.explode("entities").alias("e")).agg(F.count_distinct("e")).first()[0]
    return events.agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("sev") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")],
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(F.size("detections")).alias("detections"),
        F.lit(entities).cast("long").alias("entities"),
    )


def entity_profile(events: DataFrame, entity: str, top: int = 8, sample: int = 5) -> dict[str, DataFrame]:
    """What is known of an entity: its events' count, facets, histogram, a spread sample, and mentions in text by source."""
    own = where(events, node_query(entity))
    mentions = where(events, '"' + entity.replace("\\", "\\\\").replace('"', '\\"') + '"').groupBy("source").agg(F.count("*").alias("mentions"))
    return {
        "count": own.agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
        **{name: aggregate(own, name, top) for name in ("source", "host", "user", "detection", "sev")},
        "histogram": histogram(own),
        "sample": spread_sample(own, sample),
        "latest": page(own, limit=sample),
        "mentions": mentions,
    }
