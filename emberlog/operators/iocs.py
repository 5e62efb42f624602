"""Indicators of compromise out of events with hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import network, text
from emberlog.operators import needles

# Fixed value: paths that count as indicators.
IOC_PATH = r"(?<![\w/])(/(?:tmp|root|home|etc|var|opt|usr|dev|srv|mnt|data)/[\w./-]+)"
AGENT_RULES = ["SIGMA-WEB-0042", "SIGMA-WEB-0050"]


def _all(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def occurrences(detected: DataFrame) -> DataFrame:
    """One row for each indicator and event with a hit."""
    field = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    agent = F.when(F.exists("detections", lambda d: d["id"].isin(AGENT_RULES)) & (field("user_agent") != ""), field("user_agent"))
    endpoint = F.when((field("dst_port") != "") & network.is_public_ipv4(field("dst")), F.concat(field("dst"), F.lit(":"), field("dst_port")))
    found = F.concat(
        _all(F.filter("entities", network.is_public_ipv4), "ipv4"), _all(text.every(F.col("raw"), text.ACCESS_KEY), "aws-access-key"),
        _all(text.every(F.col("raw"), text.KEY_PRINT), "ssh-key-fingerprint"), _all(text.every(F.col("raw"), IOC_PATH), "file-path"),
        _all(F.array_compact(F.array(agent)), "user-agent"), _all(F.array_compact(F.array(endpoint)), "dst-endpoint"),
    )
    return detected.where(F.size("detections") > 0).select("id", "id_seq", "ts", "file", F.inline(found))


def summarise(found: DataFrame) -> DataFrame:
    """kind, value, count, files and range; most seen first."""
    return found.groupBy("kind", "value").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("file")).alias("files"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy(F.desc("count"), "kind", "value")


def extract(detected: DataFrame) -> DataFrame:
    return summarise(occurrences(detected))


def hit_sample(found: DataFrame, least: int = 5) -> DataFrame:
    """The first hit of each file, and the first ones up to ``least`` in all."""
    order = [F.col("ts").asc_nulls_last(), F.col("id_seq")]
    per_file = F.row_number().over(W.partitionBy("kind", "value", "file").orderBy(*order))
    marked = found.withColumn("of_file", per_file)
    rest = F.row_number().over(W.partitionBy("kind", "value").orderBy((F.col("of_file") > 1).cast("int"), *order))
    return marked.withColumn("place", rest).where((F.col("of_file") == 1) | (F.col("place") <= least)).select("kind", "value", "id", "file", "ts")


def locate(events: DataFrame, manual: DataFrame, most_bytes: int = needles.AUTOMATON_BYTES) -> DataFrame:
    """Where given indicators (kind, value) occur: in text, message or a field, or as an entity.

    Any number of them: up to ``most_bytes`` of values go through the events in one scan of an automaton, more are joined
    on their rarest grams. Empty values are nowhere.
    """
    own = manual.where(F.col("value") != "").select("kind", "value").distinct()
    named = events.select("id", "id_seq", "ts", "file", F.explode(F.array_distinct("entities")).alias("value")).join(own.select("value").distinct(), "value")
    texts = F.concat(F.array("raw", "msg"), F.coalesce(F.map_values("fields"), F.array().cast("array<string>")))
    texts = events.select("id", "id_seq", "ts", "file", F.explode(F.array_distinct(texts)).alias("text")).where(F.col("text") != "")
    size = own.agg(F.sum(F.octet_length("value") + 8)).first()[0] or 0
    if needles.ahocorasick is not None and size <= most_bytes:
        found = needles.by_automaton(texts, [r["value"] for r in own.select("value").distinct().collect()])
    else:
        found = needles.by_grams(texts.withColumn("scope", F.lit("")), own.select(F.lit("").alias("scope"), F.col("value").alias("needle")).distinct())
    every = found.select("id", "id_seq", "ts", "file", F.col("needle").alias("value")).unionByName(named.select("id", "id_seq", "ts", "file", "value")).distinct()
    return every.join(own, "value").select("id", "id_seq", "ts", "file", "kind", "value")


def merge(extracted: DataFrame, located: DataFrame) -> DataFrame:
    """Found and given indicators together, each event once."""
    return summarise(extracted.unionByName(located).dropDuplicates(["kind", "value", "id"]))


def markers(indicators: DataFrame) -> DataFrame:
    """Timeline marks by first sight; what has no time is left out."""
    return indicators.where("first_ts IS NOT NULL").select("kind", "value", F.col("first_ts").alias("ts"), "count").orderBy("ts", "kind", "value")
