"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

DETECTION = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "level")])

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("id_seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("sev", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("detections", T.ArrayType(DETECTION)),
    ]
)

#: Severities from least to most severe; the place is the rank.
SEVERITIES = ("info", "low", "medium", "high", "critical")

PARSED = "file string, id_seq long, raw string, msg string, ts timestamp, host string, user string, sev string, fields map<string,string>"
