"""The event table over the given ``events`` table: arithmetic only, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.severity import infer_severity, sev_rank
from emberlog.operators.durable import compiled


def log_events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The event table. ``spread``: its rows are dealt to all tasks first, as a file of few row groups is read by as few."""
    e = compiled(spark.read.parquet(f"{sf_dir}/events.parquet"))
    e = e.repartition("event_id") if spread else e
    own = e.select(
        F.concat(F.lit("e"), F.lower(F.hex(F.col("event_id") + 1))).alias("id"),
        F.col("event_id").alias("id_seq"),
        F.date_trunc("second", F.col("ts")).alias("ts"),
        F.when(F.col("event_type").isin("click", "view"), "nginx.access")
        .when(F.col("event_type") == "error", "app.jsonl")
        .when(F.col("event_type") == "signup", "syslog")
        .otherwise("firewall.edge")
        .alias("source"),
        F.concat(F.lit("s"), F.col("event_id") % 4).alias("source_id"),
        F.concat(F.lit("log"), F.col("event_id") % 4, F.lit(".log")).alias("file"),
        F.concat(F.lit("host-"), F.col("user_id") % 7).alias("host"),
        F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("svc_"), F.col("user_id"))).otherwise(F.concat(F.lit("u"), F.col("user_id"))).alias("user"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.concat(F.lit("45.83."), F.col("user_id") % 200, F.lit("."), F.col("user_id") % 50 + 1).alias("f_src_ip"),
        F.concat(F.lit("45.83."), F.col("user_id") * 7 % 200, F.lit("."), F.col("user_id") * 7 % 50 + 1).alias("dst"),
        F.floor(F.col("value") * 1000000).cast("string").alias("f_bytes"),
        (F.col("event_id") % 5 < 3).alias("lb"),
    )
    web, net, app, log = (F.col("source") == s for s in ("nginx.access", "firewall.edge", "app.jsonl", "syslog"))
    k = F.col("k")
    own = own.select(
        "*",
        k.cast("string").alias("f_k"),
        F.when(web, F.when(k < 20, "401").when(k < 30, "500").otherwise("200")).alias("f_status"),
        F.when(web, F.when(k % 4 == 0, "/login").when(k % 4 == 1, "/api/v1/items").when(k % 4 == 2, "/index.html").otherwise("/wp-login.php?x=1")).alias("f_path"),
        F.when(web, F.when(k % 3 == 0, "GET").otherwise("POST")).alias("f_method"),
        F.when(net, F.when(k % 2 == 0, "allow").otherwise("deny")).alias("f_action"),
        F.when(net, F.col("dst")).alias("f_dst"),
        F.when(app, F.when(k < 10, "error").when(k < 40, "warn").otherwise("info")).alias("f_level"),
        F.when(app, F.when(k % 5 == 0, "report.export").otherwise("request")).alias("f_event"),
        F.when(app, (k * 200).cast("string")).alias("f_rows"),
        F.when(log, "sshd").alias("f_program"),
        F.when(log, F.when(k < 50, "Failed").otherwise("Accepted")).alias("f_result"),
    )
    own = own.withColumn(
        "msg",
        F.when(web, F.concat_ws(" ", "f_method", "f_path", "f_status"))
        .when(net, F.concat_ws(" ", F.when(k % 2 == 0, "allowed tcp to").otherwise("denied tcp to"), "f_dst"))
        .when(app, F.concat_ws(" ", "f_event", F.lit("took"), "f_k", F.lit("ms")))
        .otherwise(F.concat_ws(" ", "f_result", F.lit("password for"), "user")),
    )
    names = {"k": "f_k", "src_ip": "f_src_ip", "bytes": "f_bytes", "http.status": "f_status", "http.path": "f_path", "http.method": "f_method", "action": "f_action", "dst": "f_dst", "level": "f_level", "event": "f_event", "rows": "f_rows", "program": "f_program", "result": "f_result"}
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in names.items()]), lambda x: x["value"].isNotNull())
    own = own.withColumn("fields", F.map_from_entries(entries)).withColumn("raw", F.concat_ws(" ", "source", "user", "host", "f_src_ip", "msg"))
    own = own.withColumn("sev", infer_severity(F.lit(None).cast("string"), F.col("fields"), F.col("msg")))
    entities = F.array_distinct(F.array_compact(F.array("f_src_ip", "f_dst", "user", "host", F.when(F.col("lb"), "lb-0"))))
    return own.select(
        "id", "id_seq", "ts", F.unix_timestamp("ts").alias("epoch"), "source", "source_id", "file", "host", "user", "msg", "sev",
        sev_rank(F.col("sev")).alias("sev_rank"), "raw", "fields", entities.alias("entities"),
        F.array().cast("array<struct<id:string,name:string,level:string>>").alias("detections"),
    )


#: The same table as a SQL prelude: ``ev`` with a column f_... for each field, and ``ent`` with a row for each entity.
EVENTS_SQL = r"""
WITH e0 AS (SELECT 'e' || lower(to_hex(event_id + 1)) AS id, event_id AS id_seq, date_trunc('second', ts) AS ts,
  CASE WHEN event_type IN ('click', 'view') THEN 'nginx.access' WHEN event_type = 'error' THEN 'app.jsonl' WHEN event_type = 'signup' THEN 'syslog' ELSE 'firewall.edge' END AS source,
  's' || (event_id % 4) AS source_id, 'log' || (event_id % 4) || '.log' AS file, 'host-' || (user_id % 7) AS host,
  CASE WHEN user_id % 10 = 0 THEN 'svc_' || user_id ELSE 'u' || user_id END AS "user",
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  '45.83.' || (user_id % 200) || '.' || (user_id % 50 + 1) AS f_src_ip,
  '45.83.' || (user_id * 7 % 200) || '.' || (user_id * 7 % 50 + 1) AS dst,
  CAST(CAST(floor(value * 1000000) AS BIGINT) AS VARCHAR) AS f_bytes, event_id % 5 < 3 AS lb FROM events),
e1 AS (SELECT *, CAST(k AS VARCHAR) AS f_k,
  CASE WHEN source = 'nginx.access' THEN CASE WHEN k < 20 THEN '401' WHEN k < 30 THEN '500' ELSE '200' END END AS f_status,
  CASE WHEN source = 'nginx.access' THEN CASE k % 4 WHEN 0 THEN '/login' WHEN 1 THEN '/api/v1/items' WHEN 2 THEN '/index.html' ELSE '/wp-login.php?x=1' END END AS f_path,
  CASE WHEN source = 'nginx.access' THEN CASE WHEN k % 3 = 0 THEN 'GET' ELSE 'POST' END END AS f_method,
  CASE WHEN source = 'firewall.edge' THEN CASE WHEN k % 2 = 0 THEN 'allow' ELSE 'deny' END END AS f_action,
  CASE WHEN source = 'firewall.edge' THEN dst END AS f_dst,
  CASE WHEN source = 'app.jsonl' THEN CASE WHEN k < 10 THEN 'error' WHEN k < 40 THEN 'warn' ELSE 'info' END END AS f_level,
  CASE WHEN source = 'app.jsonl' THEN CASE WHEN k % 5 = 0 THEN 'report.export' ELSE 'request' END END AS f_event,
  CASE WHEN source = 'app.jsonl' THEN CAST(k * 200 AS VARCHAR) END AS f_rows,
  CASE WHEN source = 'syslog' THEN 'sshd' END AS f_program,
  CASE WHEN source = 'syslog' THEN CASE WHEN k < 50 THEN 'Failed' ELSE 'Accepted' END END AS f_result FROM e0),
e2 AS (SELECT *, CASE source WHEN 'nginx.access' THEN f_method || ' ' || f_path || ' ' || f_status
  WHEN 'firewall.edge' THEN CASE WHEN k % 2 = 0 THEN 'allowed tcp to ' ELSE 'denied tcp to ' END || f_dst
  WHEN 'app.jsonl' THEN f_event || ' took ' || f_k || ' ms' ELSE f_result || ' password for ' || "user" END AS msg FROM e1),
ev AS (SELECT *, source || ' ' || "user" || ' ' || host || ' ' || f_src_ip || ' ' || msg AS raw, epoch(ts)::BIGINT AS epoch,
  CASE WHEN source = 'nginx.access' THEN CASE f_status WHEN '500' THEN 'high' WHEN '401' THEN 'medium' ELSE 'info' END
  WHEN source = 'app.jsonl' THEN CASE f_level WHEN 'error' THEN 'high' WHEN 'warn' THEN 'medium' ELSE 'info' END
  WHEN f_action = 'deny' OR f_result = 'Failed' THEN 'medium' ELSE 'info' END AS sev FROM e2),
ent AS (SELECT DISTINCT id, id_seq, ts, epoch, source, source_id, file, e FROM (SELECT *, unnest([f_src_ip, f_dst, "user", host, CASE WHEN lb THEN 'lb-0' END]) AS e FROM ev) WHERE e IS NOT NULL)
"""
