"""Registered queries: formats and sources over text made from the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import EMAIL, every
from emberlog.operators import cases, normalize
from emberlog.sources import delimited, fingerprint, lines, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
YEAR, LATEST = 2024, "2030-01-01"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("id_seq", "raw"))
    return own.where(F.trim("raw") != "").select("file", F.col("id_seq").cast("long").alias("id_seq"), "raw")


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an access log."""
    e = _table(spark, sf_dir, "events").where("ts IS NOT NULL")
    raw = F.format_string('45.83.%d.%d - %s [%s +0000] "%s /item/%d HTTP/1.1" %d %d "-" "agent/1.0" rt=%d', (F.col("user_id") % 200).cast("long"), (F.col("user_id") % 50).cast("long"), F.concat(F.lit("u"), "user_id"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "GET").otherwise("POST"), F.col("event_id") % 17, F.when(F.col("event_type") == "error", 500).otherwise(200), F.col("event_id") % 1000, F.col("event_id") % 9)
    return e.select(F.concat(F.lit("access"), F.col("event_id") % 3).alias("file"), F.col("event_id").alias("id_seq"), F.when(F.col("event_id") % 101 == 7, F.lit("not a log line")).otherwise(raw).alias("raw"))


@query("""SELECT 'access' || (event_id % 3) AS file, event_id AS id_seq, CASE WHEN bad THEN NULL ELSE date_trunc('second', ts) END AS ts, CASE WHEN bad THEN '' ELSE 'u' || user_id END AS "user",
  CASE WHEN bad THEN 'not a log line' ELSE m || ' /item/' || (event_id % 17) || ' ' || s END AS msg, CASE WHEN bad THEN NULL ELSE '45.83.' || (user_id % 200) || '.' || (user_id % 50) END AS src_ip, CASE WHEN bad THEN NULL ELSE CAST(event_id % 9 AS VARCHAR) END AS rt, CASE WHEN bad THEN 'unmatched' END AS parse_error
  FROM (SELECT *, event_id % 101 = 7 AS bad, CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS m, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS s FROM events WHERE ts IS NOT NULL)""")
def parse_access_log(spark, sf_dir):
    f = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return lines.access_log(access_lines(spark, sf_dir), YEAR, LATEST).select("file", "id_seq", "ts", "user", "msg", f("src_ip"), f("rt"), f("parse_error"))


@query("""SELECT CASE WHEN event_type = 'error' AND event_id % 101 <> 7 THEN 'high' ELSE 'info' END AS sev, count(*) AS n, count(*) FILTER (WHERE event_id % 101 = 7) AS errors FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def normalize_access_log(spark, sf_dir):
    events = normalize.normalize(lines.access_log(access_lines(spark, sf_dir), YEAR, LATEST), "nginx.access")
    return events.groupBy("sev").agg(F.count("*").alias("n"), F.count_if(F.map_contains_key("fields", F.lit("parse_error"))).alias("errors"))


@query("""SELECT event_id AS id_seq, date_trunc('second', ts) AS ts, 'host-' || (user_id % 5) AS host, 'u' || user_id AS "user", CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Accepted' END AS result, '10.0.' || (user_id % 200) || '.7' AS src_ip, '4' AS facility FROM events WHERE ts IS NOT NULL""")
def parse_syslog(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("ts IS NOT NULL")
    raw = F.format_string("<38>1 %s host-%d sshd %d - - %s password for u%d from 10.0.%d.7 port %d ssh2", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("user_id") % 5, F.col("event_id") % 9999, F.when(F.col("event_type") == "error", "Failed").otherwise("Accepted"), "user_id", F.col("user_id") % 200, F.col("event_id") % 60000 + 1024)
    parsed = lines.syslog(e.select(F.lit("auth.log").alias("file"), F.col("event_id").alias("id_seq"), raw.alias("raw")), YEAR, LATEST)
    f = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return parsed.select("id_seq", "ts", "host", "user", f("result"), f("src_ip"), f("facility"))


@query("""SELECT event_id AS id_seq, date_trunc('second', ts) AS ts, event_type || CASE WHEN user_id >= 1000 THEN ' rows=' || (user_id // 1000) || ',' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') ELSE ' rows=' || user_id END AS msg, 'u' || user_id AS "user", regexp_extract(props, '([0-9]+)', 1) AS k FROM events WHERE ts IS NOT NULL""")
def parse_json_lines(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("ts IS NOT NULL")
    raw = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("event"), F.concat(F.lit("u"), "user_id").alias("actor"), F.col("user_id").alias("rows"), F.from_json("props", "k int").alias("props")))
    parsed = records.json_lines(e.select(F.lit("app.jsonl").alias("file"), F.col("event_id").alias("id_seq"), raw.alias("raw")), YEAR, LATEST)
    return parsed.select("id_seq", "ts", "msg", "user", F.try_element_at("fields", F.lit("props.k")).alias("k"))


@query("""SELECT o_orderkey AS id_seq, date_trunc('second', o_orderdate) AS ts, c_name AS customer, n_name AS nation, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def table_to_events(spark, sf_dir):
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    own = orders.join(customer.select("c_custkey", "c_nationkey"), orders["o_custkey"] == F.col("c_custkey")).drop("c_custkey")
    parsed = records.table_to_events(own, "orders", "o_orderkey", "o_orderdate", {"o_custkey": (customer, "c_custkey", "c_name"), "c_nationkey": (nation, "n_nationkey", "n_name")})
    f = lambda k, name: F.try_element_at("fields", F.lit(k)).alias(name)
    return parsed.select("id_seq", "ts", f("o_custkey.label", "customer"), f("c_nationkey.label", "nation"), f("o_orderstatus", "status"))


_LINES = "WITH l AS (SELECT 'doc' || doc_id AS file, unnest(range(len(string_split(text, chr(10))))) AS id_seq, unnest(string_split(text, chr(10))) AS raw FROM documents), s AS (SELECT * FROM l WHERE trim(raw) <> '')"


@query(_LINES + """, c AS (SELECT file, d.delimiter, length(raw) - length(replace(raw, d.delimiter, '')) AS k FROM s, (VALUES (','), (chr(9)), (';'), ('|')) d(delimiter)),
f AS (SELECT file, delimiter, k, count(*) AS f FROM c WHERE k >= 2 GROUP BY ALL), t AS (SELECT file, count(*) AS n FROM s GROUP BY 1), r AS (SELECT file, delimiter, k, f / n * (1 + least(k, 8) / 10.0) AS score FROM f JOIN t USING (file))
SELECT file, delimiter, (k + 1)::INT AS columns, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY file ORDER BY round(score, 9) DESC, k DESC, delimiter DESC) = 1""")
def delimiter_guess(spark, sf_dir):
    return delimited.delimiter_guess(document_lines(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT 't' || (event_id % 5) AS file, unnest([0, 1, 2, 3]) AS pos, unnest([strftime(ts, '%Y-%m-%d %H:%M:%S'), CASE WHEN user_id % 2 = 0 THEN 'ALLOW' ELSE event_type END, '10.0.0.' || (user_id % 256) || ':' || (event_id % 999), CAST(event_id AS VARCHAR)]) AS value FROM events WHERE ts IS NOT NULL)
SELECT file, pos, round(avg(CASE WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2} ') OR regexp_matches(value, '^[0-9]{10}$') THEN 1.0 ELSE 0 END), 6) AS ts, round(avg(CASE WHEN value = 'ALLOW' THEN 1.0 ELSE 0 END), 6) AS action, round(avg(CASE WHEN value LIKE '10.0.0.%' THEN 1.0 ELSE 0 END), 6) AS ip, round(avg(CASE WHEN regexp_matches(value, '^[0-9]+$') THEN 1.0 ELSE 0 END), 6) AS num FROM c GROUP BY ALL""")
def column_role_stats(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("ts IS NOT NULL")
    cells = F.array(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("user_id") % 2 == 0, "ALLOW").otherwise(F.col("event_type")), F.concat(F.lit("10.0.0."), F.col("user_id") % 256, F.lit(":"), F.col("event_id") % 999), F.col("event_id").cast("string"))
    own = e.select(F.concat(F.lit("t"), F.col("event_id") % 5).alias("file"), F.posexplode(cells).alias("pos", "value"))
    return delimited.role_statistics(own).select("file", "pos", "ts", "action", "ip", "num")


# Eight kinds of files: readable ones, ones that look like a format and do not parse, and mixed ones.
@query("""WITH l AS (SELECT event_id % 48 AS f, event_id // 48 AS n FROM events WHERE event_id // 48 < 200),
s AS (SELECT f, avg(CASE WHEN n % 10 < 8 THEN 1.0 ELSE 0 END) AS most, avg(CASE WHEN n % 4 < 3 THEN 1.0 ELSE 0 END) AS many, avg(CASE WHEN n % 5 < 2 THEN 1.0 ELSE 0 END) AS few FROM l GROUP BY f)
SELECT 'f' || f AS file, CASE f % 8 WHEN 0 THEN 'app.jsonl' WHEN 1 THEN 'syslog' WHEN 2 THEN 'delimited' WHEN 5 THEN 'app.jsonl' WHEN 6 THEN 'delimited' ELSE 'text' END AS parser,
  round(CASE f % 8 WHEN 3 THEN 0.2 WHEN 4 THEN 0.2 WHEN 5 THEN most WHEN 6 THEN many WHEN 7 THEN round(0.2 + 0.3 * few, 3) ELSE 1.0 END, 6) AS confidence,
  CASE WHEN f % 8 = 5 AND most < 0.9 THEN 'REVIEW' WHEN f % 8 = 6 AND many < 0.9 THEN 'MAP' ELSE 'READY' END AS state,
  CASE f % 8 WHEN 4 THEN 'app.jsonl' WHEN 7 THEN 'app.jsonl,syslog' ELSE '' END AS demoted FROM s""")
def format_fingerprint(spark, sf_dir):
    e, kind, n = _table(spark, sf_dir, "events"), F.col("event_id") % 8, F.floor(F.col("event_id") / 48)
    good, line, cells, words = F.concat(F.lit('{"a": '), "user_id", F.lit("}")), F.lit("Jan  2 03:04:05 host prog[1]: text"), F.concat(F.lit("x|y|"), "user_id"), F.lit("only words here")
    broken = F.concat(F.lit('{"a": oops "'), "user_id", F.lit('}'))
    raw = F.when(kind == 0, good).when(kind == 1, line).when(kind == 2, cells).when(kind == 3, words).when(kind == 4, broken)
    raw = raw.when(kind == 5, F.when(n % 10 < 8, good).otherwise(words)).when(kind == 6, F.when(n % 4 < 3, cells).otherwise(words)).otherwise(F.when(n % 5 < 2, line).otherwise(broken))
    own = e.select(F.concat(F.lit("f"), F.col("event_id") % 48).alias("file"), n.alias("id_seq"), raw.alias("raw"))
    return fingerprint.fingerprint(own, YEAR).withColumn("demoted", F.array_join("demoted", ","))


@query(_LINES + " SELECT file, id_seq AS line, substr(raw, 1, 2000) AS text FROM s WHERE contains(lower(raw), 'license') ORDER BY file, id_seq LIMIT 100 OFFSET 5")
def raw_file_page(spark, sf_dir):
    return cases.file_page(document_lines(spark, sf_dir), "LICENSE", 5, 100)


@query(r"""SELECT file, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(raw, '\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b')) AS with_mail FROM (SELECT 'doc' || doc_id AS file, unnest(string_split(text, chr(10))) AS raw FROM documents) WHERE trim(raw) <> '' GROUP BY file""")
def raw_landing(spark, sf_dir):
    landed = lines.raw_events(document_lines(spark, sf_dir), YEAR, LATEST)
    return landed.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.size(every(F.col("raw"), EMAIL)) > 0).alias("with_mail"))
