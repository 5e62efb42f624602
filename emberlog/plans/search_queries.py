"""Registered queries: search, counts, facets, histograms, normalization and rules, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import network, text, timestamps
from emberlog.operators import bursts, cases, facets, normalize, rules, search
from emberlog.plans.views import EVENTS_SQL, log_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, events: bool = True):
    """Registers the function that it decorates; it gets the event table, or with ``events=False`` session and folder."""

    def add(fn):
        name = fn.__name__
        QUERIES[name] = (lambda spark, sf_dir: fn(log_events(spark, sf_dir))) if events else fn
        if sql:
            SQL[name] = (EVENTS_SQL if events else "") + sql
        return fn

    return add


def _rows(found: DataFrame) -> DataFrame:
    return found.select("id", "ts", "source", "user", "host", "sev", "msg")


_COLS = 'id, ts, source, "user", host, sev, msg'
_FREE = "(" + " OR ".join(f"contains(lower({c}), '{{0}}')" for c in ("msg", "raw", "host", '"user"', "source", "file", "id", "coalesce(f_src_ip,'')", "coalesce(f_dst,'')", "coalesce(f_path,'')", "coalesce(f_event,'')", "coalesce(f_program,'')", "coalesce(f_level,'')", "coalesce(f_action,'')", "coalesce(f_result,'')")) + ")"


@query(f"SELECT {_COLS} FROM ev WHERE " + _FREE.format("wp-login"))
def search_free_text(ev):
    return _rows(search.where(ev, "WP-Login"))


@query(f"SELECT {_COLS} FROM ev WHERE f_status = '401' AND f_method = 'POST'")
def search_field_eq(ev):
    return _rows(search.where(ev, "http.status:401 http.method:post"))


@query(f"""SELECT {_COLS} FROM ev WHERE (sev IN ('high', 'critical') OR contains(lower(msg), 'denied')) AND NOT coalesce(f_action = 'deny' OR contains(f_action, 'deny'), false) AND source <> 'syslog'""")
def search_bool_not(ev):
    return _rows(search.where(ev, "(sev:high,critical OR msg:denied) NOT action:deny -source:syslog"))


@query(f"""SELECT {_COLS} FROM ev WHERE "user" LIKE 'svc!_%1%' ESCAPE '!' AND sev = 'medium'""")
def search_wildcard(ev):
    return _rows(search.where(ev, "user:svc_*1* AND severity:medium"))


@query(f"SELECT {_COLS} FROM ev WHERE id IN (SELECT id FROM ent WHERE e = '45.83.1.2') ")
def search_entity_exact(ev):
    return _rows(search.where(ev, 'entity:"45.83.1.2"'))


@query(f"SELECT {_COLS} FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 12:00:00'")
def search_time_window(ev):
    return _rows(search.where(ev, start="2024-01-05T00:00:00Z", end="2024-01-09T12:00:00Z"))


@query(f"SELECT {_COLS} FROM ev WHERE source = 'syslog' OR file = 'log2.log'")
def search_source_filter(ev):
    return _rows(search.where(ev, sources=["syslog", "log2.log"]))


@query(f"SELECT {_COLS} FROM ev WHERE sev IN ('high', 'medium')")
def search_sev_filter(ev):
    return _rows(search.where(ev, sevs=["high", "medium"]))


@query(f"SELECT {_COLS} FROM ev WHERE contains(lower(host), 'host-3') ORDER BY ts DESC NULLS LAST, id_seq DESC LIMIT 50 OFFSET 20")
def search_page_desc(ev):
    return _rows(search.page(search.where(ev, "host:host-3"), 20, 50))


def _case_set(ev: DataFrame) -> DataFrame:
    return ev.where("id_seq % 97 = 5").select(F.col("id").alias("event_id"))


@query(f"SELECT {_COLS} FROM ev WHERE id_seq % 97 = 5 AND source = 'nginx.access'")
def search_case_scope(ev):
    return _rows(search.where(ev, "source:nginx.access", case_set=_case_set(ev)))


@query("""SELECT count(*) AS total FROM ev WHERE sev = 'high' OR contains(lower("user"), 'svc_')""")
def count_events(ev):
    return search.count(search.where(ev, "sev:high OR user:svc_"))


@query("SELECT w.id, (SELECT count(*) FROM ev WHERE ev.id = w.id) > 0 AS found FROM (VALUES ('e1'), ('e2a'), ('nope'), ('effffffff')) w(id)")
def get_by_ids_missing(ev):
    found, missing = search.get_by_ids(ev, ["e1", "e2a", "nope", "effffffff", "e1"])
    return found.select("id", F.lit(True).alias("found")).unionByName(missing.withColumn("found", F.lit(False)))


@query("""SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY ts NULLS LAST, id_seq) - 1 AS pos, count(*) OVER () AS total FROM ev WHERE source = 'app.jsonl')
  WHERE pos IN (SELECT CAST(floor(i * total / 12.0) AS BIGINT) FROM range(12) r(i))""")
def spread_sample(ev):
    return search.spread_sample(search.where(ev, sources=["app.jsonl"]), 12).select("id", F.col("pos").cast("long").alias("pos"))


_AGG = "count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts"


@query(f"SELECT source AS value, {_AGG} FROM ev GROUP BY 1")
def aggregate_by_source(ev):
    return facets.aggregate(ev, "source")


@query(f"""SELECT "user" AS value, {_AGG} FROM ev WHERE sev = 'high' GROUP BY 1 ORDER BY n DESC, value LIMIT 25""")
def aggregate_by_user_first_last(ev):
    return facets.aggregate(search.where(ev, "sev:high"), "user", 25)


@query(f"SELECT e AS value, {_AGG} FROM ent GROUP BY 1 ORDER BY n DESC, value LIMIT 40")
def aggregate_by_entity(ev):
    return facets.aggregate(ev, "entity", 40)


@query(f"SELECT f_path AS value, {_AGG} FROM ev WHERE f_path IS NOT NULL GROUP BY 1")
def aggregate_by_field(ev):
    return facets.aggregate(ev, "HTTP.Path")


@query("SELECT count(*) AS without_field FROM ev WHERE f_path IS NULL")
def aggregate_without_field(ev):
    return facets.without_field(ev, "http.path")


@query("SELECT f_status AS value, count(*) AS n FROM ev WHERE f_status IS NOT NULL GROUP BY 1")
def distinct_values(ev):
    return facets.distinct_values(ev, "http.status")


_PAIRS = "UNION ALL ".join(f"SELECT '{n}' AS name, {c} AS value FROM ev WHERE {c} IS NOT NULL " for n, c in [("source", "source"), ("file", "file"), ("host", "host"), ("user", '"user"'), ("sev", "sev"), ("k", "f_k"), ("src_ip", "f_src_ip"), ("bytes", "f_bytes"), ("http.status", "f_status"), ("http.path", "f_path"), ("http.method", "f_method"), ("action", "f_action"), ("dst", "f_dst"), ("level", "f_level"), ("event", "f_event"), ("rows", "f_rows"), ("program", "f_program"), ("result", "f_result")])


@query(f""", pairs AS ({_PAIRS}), c AS (SELECT name, value, count(*) AS n FROM pairs GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY name)::BIGINT AS events, count(*) OVER (PARTITION BY name) AS distinct_values FROM c)
  SELECT name, value, n, rank::INT AS rank, events, distinct_values FROM r WHERE rank <= 5""")
def facets_topk(ev):
    return facets.facets(ev, 5)


@query("SELECT date_trunc('day', ts) AS bucket, count(*) AS n FROM ev GROUP BY 1")
def histogram_day(ev):
    return facets.histogram(ev, "day")


@query("""SELECT to_timestamp(epoch - epoch % step)::TIMESTAMP AS bucket, count(*) AS n FROM ev,
  (SELECT CASE WHEN max(epoch) - min(epoch) <= 10800 THEN 60 WHEN max(epoch) - min(epoch) <= 432000 THEN 3600 ELSE 86400 END AS step FROM ev WHERE sev = 'high') WHERE sev = 'high' GROUP BY 1""")
def histogram_auto(ev):
    return facets.histogram(search.where(ev, "sev:high"))


@query("SELECT id, sev FROM ev")
def infer_severity(ev):
    return ev.select("id", "sev")


_GAPS = ", g AS (SELECT *, CASE WHEN id_seq % 3 = 0 THEN ts END AS known FROM ev)"


@query(_GAPS + """ SELECT id, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY file ORDER BY id_seq ROWS UNBOUNDED PRECEDING),
  first_value(known IGNORE NULLS) OVER (PARTITION BY file ORDER BY id_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ts FROM g""")
def forward_fill_ts(ev):
    return normalize.forward_fill(ev.withColumn("ts", F.when(F.col("id_seq") % 3 == 0, F.col("ts")))).select("id", "ts")


@query(""", b AS (SELECT file, lag(epoch) OVER (PARTITION BY file ORDER BY hash_order) - epoch AS back FROM (SELECT *, (id_seq * 7919) % 10007 AS hash_order FROM ev) WHERE epoch IS NOT NULL)
  SELECT file, greatest(0, coalesce(max(back), 0))::BIGINT AS skew_seconds FROM b GROUP BY file""")
def clock_skew(ev):
    return normalize.clock_skew(ev.withColumn("id_seq", F.col("id_seq") * 7919 % 10007))


@query("SELECT source_id, count(*) AS records, count(*) FILTER (WHERE k < 5) AS errors, round((count(*) - count(*) FILTER (WHERE k < 5)) / count(*), 6) AS coverage FROM ev GROUP BY 1")
def parse_coverage(ev):
    marked = ev.withColumn("fields", F.when(F.col("fields")["k"].cast("int") < 5, F.map_concat("fields", F.create_map(F.lit("parse_error"), F.lit("unmatched")))).otherwise(F.col("fields")))
    return normalize.parse_coverage(marked, "source_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _found(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(text.every(F.col("text"), pattern))).alias("value"))


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b', 1)) AS value FROM documents", events=False)
def extract_emails(spark, sf_dir):
    return _found(_documents(spark, sf_dir), text.EMAIL)


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b([a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b', 1)) AS value FROM documents", events=False)
def extract_hashes(spark, sf_dir):
    return _found(_documents(spark, sf_dir), text.HASH)


@query(r"""SELECT DISTINCT doc_id, t AS value FROM (SELECT doc_id, unnest(string_split_regex(text, '[^0-9.]+')) AS t FROM documents)
  WHERE regexp_full_match(t, '(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}')""", events=False)
def extract_ipv4(spark, sf_dir):
    return _found(_documents(spark, sf_dir), network.IPV4)


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages", events=False)
def url_host(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", network.url_host(F.col("url")).alias("host"))


_IPS = "SELECT DISTINCT (custkey % 256) || '.' || (custkey * 3 % 256) || '.' || (custkey * 5 % 256) || '.' || (custkey % 7) AS ip FROM (SELECT c_custkey AS custkey FROM customer)"


@query(f"""WITH ips AS ({_IPS}), p AS (SELECT ip, CAST(string_split(ip, '.')[1] AS INT) AS a, CAST(string_split(ip, '.')[2] AS INT) AS b, CAST(string_split(ip, '.')[3] AS INT) AS c, CAST(string_split(ip, '.')[4] AS INT) AS d FROM ips)
  SELECT ip, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10)))
    OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS public FROM p""", events=False)
def is_public_ip(spark, sf_dir):
    k = F.col("c_custkey")
    ip = F.concat_ws(".", k % 256, k * 3 % 256, k * 5 % 256, k % 7)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(ip.alias("ip")).distinct().select("ip", network.is_public_ip(F.col("ip")).alias("public"))


@query(r"SELECT source_id, substr(regexp_replace(msg, '[0-9]+|\b[0-9a-f]{6,}\b', '#', 'g'), 1, 80) AS template, count(*) AS n FROM ev GROUP BY ALL")
def template_counts(ev):
    return normalize.template_counts(ev)


@query("""SELECT o_orderkey, to_timestamp(epoch(o_orderdate)::BIGINT + o_orderkey % 1000)::TIMESTAMP AS ts FROM orders WHERE epoch(o_orderdate) >= 631152000""", events=False)
def epoch_decode(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.unix_timestamp("o_orderdate") >= timestamps.LOW)
    s = (F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 1000).cast("decimal(38,0)")
    way = F.col("o_orderkey") % 6
    coded = F.when(way == 0, s).when(way == 1, s * 10**3).when(way == 2, s * 10**6).when(way == 3, s * 10**9).when(way == 4, (s + 11_644_473_600) * 10**6).otherwise((s + 62_135_596_800) * 10**7)
    return orders.select("o_orderkey", timestamps.ts_from_number(coded).alias("ts"))


@query("SELECT id FROM ev WHERE contains(lower(msg), 'post') AND f_status IN ('401', '500') AND try_cast(f_bytes AS DOUBLE) > 1000000")
def rule_conditions_and(ev):
    conditions = [("msg", "contains", "post"), ("http.status", "in", "401, 500"), ("bytes", "gt", "1,000,000")]
    return ev.where(rules.conditions(conditions)).select("id")


@query("SELECT id FROM ev WHERE coalesce(f_action <> 'deny', true) AND coalesce(f_status NOT IN ('200'), true) AND NOT contains(lower(host), '-1') AND source LIKE '%e%'")
def rule_conditions_negative(ev):
    conditions = [("action", "not_equals", "deny"), ("http.status", "not_in", "200"), ("host", "not_contains", "-1")]
    return ev.where(rules.conditions(conditions, sources="e")).select("id")


@query("SELECT id FROM ev WHERE regexp_matches(msg, '(?i)(denied|failed).*(u[0-9]+5|svc)') OR regexp_matches(raw, '(?i)(denied|failed).*(u[0-9]+5|svc)')")
def rule_regex_any(ev):
    return ev.where(rules.regex_rule("(denied|failed).*(u[0-9]+5|svc)", ignore_case=True)).select("id")


_BURST = """, k AS (SELECT {key} AS key, id, id_seq, epoch FROM ev WHERE {where} AND epoch IS NOT NULL AND {key} IS NOT NULL AND {key} <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch, id_seq) AS rn FROM k),
c AS (SELECT *, min(rn) OVER (PARTITION BY key ORDER BY epoch RANGE BETWEEN {window} PRECEDING AND CURRENT ROW) AS f FROM n),
b AS (SELECT *, rn - f + 1 AS cnt FROM c),
bursts AS (SELECT b.key, b.id, b.epoch, b.cnt AS count, n.id AS first_id, n.epoch AS first_epoch FROM b JOIN n ON n.key = b.key AND n.rn = b.f
  WHERE cnt >= {least} QUALIFY row_number() OVER (PARTITION BY b.key ORDER BY cnt DESC, b.rn) = 1)
"""


def burst_sql(key: str, where: str, window: int, least: int) -> str:
    return _BURST.format(key=key, where=where, window=window, least=least)


_ALL = "SELECT key, id, epoch, count, first_id, first_epoch FROM bursts"


@query(burst_sql("f_src_ip", "f_status IN ('401', '500')", 604_800, 3) + _ALL)
def rule_threshold(ev):
    return rules.threshold_rule(ev, rules.conditions([("http.status", "in", "401,500")]), 3, 604_800, "src_ip")


@query(burst_sql("f_src_ip", "f_status = '401'", 86_400, 2) + _ALL)
def burst_401(ev):
    return bursts.find_bursts(ev.where(F.col("fields")["http.status"] == "401"), F.col("fields")["src_ip"], 86_400, 2)


@query(burst_sql("f_path", "f_status LIKE '5%'", 86_400, 5) + _ALL)
def burst_5xx(ev):
    return bursts.find_bursts(ev.where(F.col("fields")["http.status"].startswith("5")), F.substring(F.col("fields")["http.path"], 1, 40), 86_400, 5)


@query(burst_sql("f_src_ip", "f_action = 'deny'", 86_400, 2) + _ALL)
def burst_deny(ev):
    return bursts.find_bursts(ev.where(F.col("fields")["action"] == "deny"), F.col("fields")["src_ip"], 86_400, 2)


@query(""", lo AS (SELECT source_id, min(epoch) AS lo, count(*) AS total FROM ev WHERE epoch IS NOT NULL GROUP BY 1), b AS (SELECT id, source_id, floor((epoch - lo) / 86400.0) AS bin, total FROM ev JOIN lo USING (source_id) WHERE epoch IS NOT NULL),
  c AS (SELECT source_id, bin, count(*) AS in_bin FROM b GROUP BY ALL), m AS (SELECT source_id, median(in_bin)::DOUBLE AS median, count(*) AS bins FROM c GROUP BY 1)
  SELECT id, source_id, in_bin, median, round(in_bin / median, 6) AS ratio FROM b JOIN c USING (source_id, bin) JOIN m USING (source_id) WHERE total >= 30 AND bins >= 3""")
def burst_ratio(ev):
    return bursts.burst_ratio(ev, 86_400).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT source_id, file, source, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY ALL""")
def source_listing(ev):
    return facets.sources(ev)


@query("""SELECT count(*) AS events, count(*) FILTER (WHERE sev = 'critical') AS critical, count(*) FILTER (WHERE sev = 'high') AS high, count(*) FILTER (WHERE sev = 'medium') AS medium, count(*) FILTER (WHERE sev = 'low') AS low, count(*) FILTER (WHERE sev = 'info') AS info,
  min(ts) AS first_ts, max(ts) AS last_ts, 0::BIGINT AS detections, (SELECT count(DISTINCT e) FROM ent WHERE id_seq % 97 = 5) AS entities FROM ev WHERE id_seq % 97 = 5""")
def case_snapshot(ev):
    return facets.case_snapshot(search.where(ev, case_set=_case_set(ev)))


@query("""SELECT file, substr(sha1(raw), 1, 16) AS raw_hash, 'old' || id_seq AS old_id, (SELECT arg_min(b.id, b.id_seq) FROM ev b WHERE b.file = ev.file AND b.raw = ev.raw) AS event_id FROM ev WHERE id_seq % 97 = 5""")
def reanchor_entries(ev):
    entries = ev.where("id_seq % 97 = 5").select("file", text.raw_hash(F.col("raw")).alias("raw_hash"), F.concat(F.lit("old"), "id_seq").alias("old_id"))
    return cases.reanchor(entries, ev)


@query("""SELECT 'source' AS facet, source AS value, count(*) AS n FROM ev WHERE id IN (SELECT id FROM ent WHERE e = 'host-3') GROUP BY ALL UNION ALL SELECT 'sev', sev, count(*) FROM ev WHERE id IN (SELECT id FROM ent WHERE e = 'host-3') GROUP BY ALL
  UNION ALL SELECT 'mentions', source, count(*) FROM ev WHERE contains(raw, 'host-3') GROUP BY ALL""")
def entity_profile(ev):
    found = facets.entity_profile(ev, "host-3")
    parts = [found[name].select(F.lit(name).alias("facet"), "value", "n") for name in ("source", "sev")]
    return parts[0].unionByName(parts[1]).unionByName(found["mentions"].select(F.lit("mentions").alias("facet"), F.col("source").alias("value"), F.col("mentions").alias("n")))
