"""Findings, summary and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.severity import sev_name, sev_rank

#: Names of exported objects are derived from this, so equal content gets equal ids.
NAMESPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


def findings(cluster_rows: DataFrame, members: DataFrame, rules: int = 6, evidence: int = 5) -> DataFrame:
    """Each cluster with its first rules and first events."""
    order = [F.col("epoch"), F.col("id_seq")]
    seen = members.select("cluster", "epoch", "id_seq", F.posexplode("detections").alias("p", "d")).groupBy("cluster", F.col("d.name").alias("rule")).agg(F.min(F.struct("epoch", "id_seq", "p")).alias("at"))
    first_rules = seen.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy("at"))).where(F.col("k") <= rules).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rule"))), lambda x: x["rule"]).alias("rules"))
    first_events = members.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(*order))).where(F.col("k") <= evidence).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("evidence"))
    return cluster_rows.join(first_rules, "cluster").join(first_events, "cluster")


def summary(detected: DataFrame, cluster_rows: DataFrame) -> DataFrame:
    """One row: overall severity and a sentence."""
    once = detected.agg(F.count("*").alias("events"), F.count_if(F.size("detections") > 0).alias("hit_events"), F.max(F.when(F.size("detections") > 0, sev_rank(F.col("sev"))).otherwise(0)).alias("rank"))
    span = cluster_rows.agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).first()
    text = F.format_string("%d events, %d with detections, in %d clusters.", "events", "hit_events", F.lit(span["n"]))
    return once.select(sev_name(F.col("rank")).alias("severity"), text.alias("summary"), F.lit(span["start"]).alias("start"), F.lit(span["end"]).alias("end"))


def markdown(title: str, summary_row, finding_rows: list, indicator_rows: list) -> str:
    """A report's text from its few rows; lists are collected by the caller with a limit."""
    lines = [f"# {title}", "", summary_row["summary"], f"Severity: **{summary_row['severity']}**", "", "| Finding | Severity | Start | Events | Rules |", "|-|-|-|-|-|"]
    lines += [f"| {f['title']} | {f['sev']} | {f['start']} | {f['events']} | {', '.join(f['rules'])} |" for f in finding_rows]
    lines += ["", "| Indicator | Kind | Count | Files |", "|-|-|-|-|"]
    escape = lambda x: str(x).replace("|", "\\|")
    return "\n".join(lines + [f"| {escape(i['value'])} | {i['kind']} | {i['count']} | {', '.join(i['files'])} |" for i in indicator_rows]) + "\n"


def _object_id(kind: Column, text: Column) -> Column:
    """``kind--`` and the name-based (version 5) identifier of a text: SHA-1 of the namespace and the text, cut to its form."""
    digest = F.sha1(F.concat(F.lit(bytearray(NAMESPACE.bytes)), F.concat(kind, text).cast("binary")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(kind, F.lit("--"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def stix_objects(indicators: DataFrame, finding_rows: DataFrame) -> DataFrame:
    """One JSON object a row: an indicator for each indicator, an attack pattern for each finding. Ids follow the content."""
    quoted = F.regexp_replace(F.regexp_replace("value", r"\\", r"\\\\"), "'", r"\\'")
    whole = lambda form: F.format_string(form, quoted)
    pattern = (
        F.when(F.col("kind") == "ipv4", whole("[ipv4-addr:value = '%s']"))
        .when(F.col("kind") == "file-path", whole("[file:name = '%s']"))
        .when(F.col("kind") == "user-agent", whole("[network-traffic:extensions.'http-request-ext'.request_header.'User-Agent' = '%s']"))
        .when(F.col("kind") == "dst-endpoint", F.format_string("[network-traffic:dst_ref.value = '%s' AND network-traffic:dst_port = %s]", F.substring_index("value", ":", 1), F.substring_index("value", ":", -1)))
        .otherwise(F.format_string("[x-log-indicator:%s = '%s']", F.regexp_replace("kind", "-", "_"), quoted))
    )
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first = indicators.select(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat_ws(" ", "kind", "value").alias("name"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), when("first_ts").alias("valid_from"))
    second = finding_rows.select(F.lit("attack-pattern").alias("type"), F.lit("2.1").alias("spec_version"), F.concat_ws(" ", "id", "title").alias("name"), F.concat(F.lit("Rules: "), F.array_join("rules", ", ")).alias("description"), when("start").alias("valid_from"))
    to = lambda df, key: df.withColumn("id", _object_id(F.col("type"), F.col(key))).select("id", F.to_json(F.struct("id", *df.columns)).alias("json"))
    return to(first, "pattern").unionByName(to(second, "name"))


def report_json(summary_frame: DataFrame, finding_rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """The report as JSON, one object a row: its summary, then each finding and each indicator under its kind."""
    rows = lambda df, kind: df.select(F.lit(kind).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    return rows(summary_frame, "summary").unionByName(rows(finding_rows, "finding")).unionByName(rows(indicators, "indicator"))


def stix_bundle(objects: list[str]) -> str:
    """The bundle of objects that are already JSON."""
    return f'{{"type":"bundle","id":"bundle--{uuid.uuid5(NAMESPACE, "".join(sorted(objects)))}","objects":[{",".join(objects)}]}}'


def write_events(events: DataFrame, path: str) -> None:
    """Writes events by source; a source that is written again replaces its own rows and no other's."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)
