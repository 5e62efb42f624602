"""Registered queries: record formats, files and archives, written from the given tables and read back, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import facets, normalize
from emberlog.operators.durable import shared_dir, stored
from emberlog.plans.source_queries import LATEST, YEAR, access_lines
from emberlog.sources import binary, delimited, lines, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _dealt(table: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks, as a file of few row groups is read by as few."""
    return table.repartition(key)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _field(name: str, alias: str = "") -> Column:
    return F.try_element_at("fields", F.lit(name)).alias(alias or name)


def _iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


_TS = "date_trunc('second', ts) AS ts"


@query(f"""SELECT event_id AS id_seq, {_TS}, CASE event_id % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN '' WHEN 2 THEN 'u' || user_id ELSE 'm' || user_id END AS "user",
  CASE event_id % 4 WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'opened' ELSE 'closed' END WHEN 3 THEN 'Invalid' END AS result, CASE WHEN event_id % 4 = 0 THEN '/bin/cat /etc/' || user_id END AS command,
  CASE WHEN event_id % 4 = 1 THEN '/home/' || user_id END AS path, CASE WHEN event_id % 4 = 3 THEN '10.0.' || (user_id % 200) || '.7' END AS src_ip, CASE WHEN event_id % 4 = 1 THEN 'unlink' END AS op FROM events""")
def parse_syslog_programs(spark, sf_dir):
    """What sudo, auditd, PAM and sshd say, in the older form, the journal's and the newer one; lines without time stay."""
    k, u = F.col("event_id") % 4, F.col("user_id")
    program = F.when(k == 0, "sudo").when(k == 1, "auditd").otherwise("sshd")
    said = (
        F.when(k == 0, F.format_string("u%d : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/cat /etc/%d", u, u))
        .when(k == 1, F.format_string('type=PATH msg=audit(1.2:3): op=unlink name="/home/%d" res=1', u))
        .when(k == 2, F.format_string("pam_unix(x:session): session %s for user u%d(uid=0) by (uid=0)", F.when(u % 2 == 0, "opened").otherwise("closed"), u))
        .otherwise(F.format_string("Invalid user m%d from 10.0.%d.7 port 22", u, u % 200))
    )
    newer = F.format_string("<86>1 %s h %s 7 - - %s", F.coalesce(_iso(), F.lit("-")), program, said)
    journal = F.format_string("%s h %s[7]: %s", _iso(), program, said)
    raw = F.when((F.col("event_id") % 3 == 0) & F.col("ts").isNotNull(), journal).otherwise(newer)
    parsed = lines.syslog(_events(spark, sf_dir).select(F.lit("sys.log").alias("file"), F.col("event_id").alias("id_seq"), raw.alias("raw")), YEAR, LATEST)
    return parsed.select("id_seq", "ts", "user", *[_field(n) for n in ("result", "command", "path", "src_ip", "op")])


def _calls() -> Column:
    return F.struct(
        _iso().alias("eventTime"), F.element_at(F.array(*map(F.lit, ["ConsoleLogin", "ListBuckets", "DeleteTrail"])), (F.col("event_id") % 3 + 1).cast("int")).alias("eventName"),
        F.concat(F.lit("eu-"), F.col("user_id") % 3).alias("awsRegion"), F.concat(F.lit("45.83.1."), F.col("user_id") % 200).alias("sourceIPAddress"),
        F.struct(F.lit("IAMUser").alias("type"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).alias("userName"), F.concat(F.lit("arn:aws:iam::1:user/a"), "user_id").alias("arn")).alias("userIdentity"),
        F.when(F.col("event_type") == "error", "AccessDenied").alias("errorCode"), F.struct(F.lit("Yes").alias("MFAUsed")).alias("additionalEventData"),
    )


_CALLS_SQL = f"""SELECT {{0}}{_TS}, 'eu-' || (user_id % 3) AS host, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'a' || user_id END AS "user", CASE WHEN event_type = 'error' OR event_id % 3 IN (0, 2) THEN 'medium' END AS sev,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result, 'yes' AS mfa, CASE WHEN event_type = 'error' THEN 'AccessDenied' ELSE '—' END AS error FROM events"""


def _told_calls(parsed: DataFrame, *also: str) -> DataFrame:
    return parsed.select(*also, "ts", "host", "user", "sev", _field("result"), _field("MFAUsed", "mfa"), _field("errorCode", "error"))


@query(_CALLS_SQL.format("event_id AS id_seq, "))
def parse_cloud_trail(spark, sf_dir):
    return _told_calls(records.cloud_trail(_events(spark, sf_dir).select(F.lit("trail.json").alias("file"), F.col("event_id").alias("id_seq"), F.to_json(_calls()).alias("raw")), YEAR, LATEST), "id_seq")


@query(f"SELECT * FROM ({_CALLS_SQL.format('')})")
def parse_json_documents(spark, sf_dir):
    """Whole files: arrays of calls under ``Records``, written as text and unwrapped again."""
    path = _folder(spark)
    _events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 50)).agg(F.collect_list(_calls()).alias("Records")).select(F.to_json(F.struct("Records")).alias("value")).write.partitionBy().option("lineSep", "\n").text(path)
    one_a_line = spark.read.text(path).select(F.sha1("value").alias("file"), "value")
    return _told_calls(records.cloud_trail(records.unwrap(one_a_line), YEAR, LATEST))


@query(f"""SELECT event_id AS id_seq, {_TS}, 'u' || user_id AS "user", 'ns' || (user_id % 3) AS host, CASE WHEN event_id % 2 = 0 THEN 'pods/exec' ELSE 'secrets' END AS resource, CASE WHEN event_type = 'error' THEN '403' ELSE '200' END AS status,
  '10.0.0.' || (user_id % 200) AS src_ip, CASE WHEN event_id % 2 = 0 OR event_type = 'error' THEN 'medium' END AS sev FROM events""")
def parse_cluster_audit(spark, sf_dir):
    two = F.col("event_id") % 2 == 0
    record = F.struct(
        F.lit("Event").alias("kind"), _iso().alias("requestReceivedTimestamp"), F.lit("create").alias("verb"), F.struct(F.concat(F.lit("u"), "user_id").alias("username")).alias("user"),
        F.struct(F.when(two, "pods").otherwise("secrets").alias("resource"), F.when(two, "exec").alias("subresource"), F.concat(F.lit("ns"), F.col("user_id") % 3).alias("namespace"), F.lit("n-1").alias("name")).alias("objectRef"),
        F.array(F.concat(F.lit("10.0.0."), F.col("user_id") % 200), F.lit("1.2.3.4")).alias("sourceIPs"), F.struct(F.when(F.col("event_type") == "error", 403).otherwise(200).alias("code")).alias("responseStatus"),
    )
    parsed = records.cluster_audit(_dealt(_events(spark, sf_dir), "event_id").select(F.lit("audit.jsonl").alias("file"), F.col("event_id").alias("id_seq"), F.to_json(record).alias("raw")), YEAR, LATEST)
    return parsed.select("id_seq", "ts", "user", "host", _field("resource"), _field("responseStatus", "status"), _field("src_ip"), "sev")


@query(f"""SELECT {_TS}, 'WS' || (user_id % 9) AS host, CASE WHEN user_id % 3 = 0 THEN 'sub' ELSE 'u' || user_id END AS "user", CASE WHEN event_id % 2 = 0 THEN '4625' ELSE '4688' END AS event,
  CASE WHEN event_id % 2 = 0 THEN 'medium' ELSE 'info' END AS sev, CASE WHEN event_id % 2 = 0 THEN 'network' ELSE 'interactive' END AS logon, CAST(event_id AS VARCHAR) AS number FROM events""")
def parse_event_xml(spark, sf_dir):
    data = lambda name, value: F.concat(F.lit(f'<Data Name="{name}">'), value, F.lit("</Data>"))
    two = F.col("event_id") % 2 == 0
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/><EventID>'), F.when(two, "4625").otherwise("4688"), F.lit("</EventID><Level>0</Level>"),
        F.coalesce(F.concat(F.lit('<TimeCreated SystemTime="'), _iso(), F.lit('"/>')), F.lit("")), F.lit("<Channel>Security</Channel><Computer>WS"), (F.col("user_id") % 9).cast("string"), F.lit("</Computer></System><EventData>"),
        data("TargetUserName", F.when(F.col("user_id") % 3 == 0, "WS1$").otherwise(F.concat(F.lit("u"), "user_id"))), data("SubjectUserName", F.lit("sub")), data("LogonType", F.when(two, "3").otherwise("2")), data("Number", F.col("event_id").cast("string")), F.lit("</EventData></Event>"),
    )
    own = _events(spark, sf_dir).select(F.lit("Security.xml").alias("file"), F.col("event_id").alias("id_seq"), xml.alias("raw"))
    return records.event_elements(own, YEAR, LATEST).select("ts", "host", "user", _field("EventID", "event"), "sev", _field("LogonTypeName", "logon"), _field("Number", "number"))


@query(f"""SELECT {_TS}, 'h' || (user_id % 9) AS host, 'u' || user_id AS "user", event_type || ', "quoted"' || chr(10) || 'and more' AS msg, CAST(event_id AS VARCHAR) AS number FROM events""")
def parse_csv_header(spark, sf_dir):
    """A table with header, quoted cells and line ends within cells; the delimiter is found out."""
    path = _folder(spark)
    own = _events(spark, sf_dir).select(_iso().alias("Event Time"), F.concat(F.lit("h"), F.col("user_id") % 9).alias("src_host"), F.concat(F.lit("u"), "user_id").alias("User Name"), F.concat("event_type", F.lit(', "quoted"\nand more')).alias("Message"), F.col("event_id").alias("number"))
    own.write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(path)
    return delimited.with_header(spark, path, None, YEAR, LATEST).select("ts", "host", "user", "msg", _field("number"))


@query(f"""SELECT event_id AS id_seq, {_TS}, CASE WHEN user_id % 2 = 0 THEN 'DENY' ELSE 'ALLOW' END AS action, '10.0.0.' || (user_id % 200) AS src, CAST(event_id % 999 AS VARCHAR) AS src_port, '45.83.1.' || (user_id % 50) AS dst,
  CAST(event_id AS VARCHAR) AS len, CASE WHEN user_id % 2 = 0 THEN 'low' END AS sev FROM events WHERE ts IS NOT NULL""")
def parse_headerless(spark, sf_dir):
    """Pipe-delimited flows whose column names come from their values' statistics."""
    e = _events(spark, sf_dir).where("ts IS NOT NULL")
    raw = F.concat_ws("|", _iso(), F.when(F.col("user_id") % 2 == 0, "DENY").otherwise("ALLOW"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200, F.lit(":"), F.col("event_id") % 999), F.concat(F.lit("45.83.1."), F.col("user_id") % 50, F.lit(":443")), F.concat(F.lit("len="), "event_id"))
    own = e.select(F.lit("fw.log").alias("file"), F.col("event_id").alias("id_seq"), raw.alias("raw"))
    cells = delimited.sampled(own).select("file", F.posexplode(F.split("raw", "[|]")).alias("pos", "value"))
    names = delimited.guess_roles(delimited.role_statistics(cells).collect())  # one row a column
    return delimited.headerless(own, "|", names, YEAR, LATEST).select("id_seq", "ts", *[_field(n) for n in ("action", "src", "src_port", "dst", "len")], "sev")


@query(f"""SELECT event_id AS id_seq, {_TS}, 'user ' || user_id || ' did it' AS msg, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM events WHERE ts IS NOT NULL""")
def parse_plain_text(spark, sf_dir):
    raw = F.format_string("%s user %d did it", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "user_id")
    own = _events(spark, sf_dir).where("ts IS NOT NULL").select(F.lit("x.txt").alias("file"), F.col("event_id").alias("id_seq"), F.concat(raw, F.when(F.col("event_type") == "error", " [ERROR]").otherwise(" [info]")).alias("raw"))
    return lines.plain_text(own, YEAR, LATEST).select("id_seq", "ts", F.regexp_replace("msg", r" \[\w+\]$", "").alias("msg"), _field("level"))


@query("""SELECT doc_id, 'a' || doc_id || '@x.org' AS "user", CASE WHEN doc_id % 5 = 0 THEN 'high' WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN 'medium' END AS sev, CASE WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS spf,
  CASE WHEN doc_id % 2 = 0 THEN 'true' END AS reply_to_mismatch, '8.8.4.' || (doc_id % 200) AS src_ip, 'https://t.io/' || doc_id AS url, lang || ' note' AS subject FROM (SELECT *, lang FROM documents)""")
def parse_mail(spark, sf_dir):
    """Documents as mail with an attachment."""
    d, odd = _dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id"), F.col("doc_id")
    text = F.concat(
        F.format_string("From: A <a%d@x.org>\nTo: b@y.org\nReply-To: c@%s\nSubject: %s note\n", odd, F.when(odd % 2 == 0, "z.org").otherwise("x.org"), "lang"),
        F.format_string("Received: from r ([10.0.0.1]) by q; from s ([8.8.4.%d])\nAuthentication-Results: q; spf=%s\nContent-Type: multipart/mixed; boundary=B\n\n", odd % 200, F.when(odd % 3 == 0, "fail").otherwise("pass")),
        F.format_string("--B\nContent-Type: text/plain\n\nsee https://t.io/%d\n--B\nContent-Disposition: attachment; filename=\"%s\"\n\nabc\n--B--\n", odd, F.when(odd % 5 == 0, "run.exe").otherwise("a.txt")),
    )
    files = d.select(odd.cast("string").alias("file"), text.cast("binary").alias("content"))
    return binary.mail(files).select(F.col("file").cast("long").alias("doc_id"), "user", "sev", *[_field(n) for n in ("spf", "reply_to_mismatch", "src_ip", "url", "subject")])


@query("""SELECT doc_id, v.raw, v.byte_at::VARCHAR AS "offset", v.encoding, CASE WHEN v.odd THEN 'medium' ELSE 'info' END AS sev FROM documents, LATERAL (VALUES ('first string ' || doc_id, 2, 'ascii', false), ('wide-run', 17 + length(doc_id::VARCHAR), 'utf-16le', false), ('cmd.exe /c dir ' || doc_id, 35 + length(doc_id::VARCHAR), 'ascii', true)) v(raw, byte_at, encoding, odd)""")
def binary_strings(spark, sf_dir):
    """Strings between bytes that are none: two bytes, a text, two bytes, a two-byte text, two bytes, a text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = b"".join(bytes([c, 0]) for c in b"wide-run")
    gap = F.lit(bytearray(b"\x00\x01"))
    content = F.concat(gap, F.concat(F.lit("first string "), "doc_id").cast("binary"), gap, F.lit(bytearray(wide)), gap, F.concat(F.lit("cmd.exe /c dir "), "doc_id").cast("binary"))
    found = binary.strings(d.select(F.col("doc_id").cast("string").alias("file"), content.alias("content")))
    return found.select(F.col("file").cast("long").alias("doc_id"), "raw", _field("offset"), _field("encoding"), "sev")


@query("SELECT 'line ' || event_id AS raw FROM events")
def expand_archives(spark, sf_dir):
    """Compressed text files, written and opened again as archives."""
    path = _folder(spark)
    _events(spark, sf_dir).select(F.concat(F.lit("line "), "event_id").alias("value")).write.option("compression", "gzip").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.col("path").alias("file"), "content")
    return binary.text_lines(binary.expand_archives(files)).select("raw")


@query("""SELECT key AS name, count(*) AS n FROM (SELECT unnest(['src_ip', 'http.method', 'http.path', 'http.proto', 'http.status', 'bytes', 'user_agent', 'user.name', 'rt']) AS key FROM events WHERE ts IS NOT NULL AND event_id % 101 <> 7
  UNION ALL SELECT 'parse_error' FROM events WHERE ts IS NOT NULL AND event_id % 101 = 7) GROUP BY 1""")
def field_vocabulary(spark, sf_dir):
    return facets.field_vocabulary(normalize.normalize(lines.access_log(access_lines(spark, sf_dir), YEAR, LATEST), "nginx.access"))


@query("""SELECT e AS entity, count(*) AS n FROM (SELECT unnest(['45.83.' || (user_id % 200) || '.' || (user_id % 50), 'u' || user_id]) AS e FROM events WHERE ts IS NOT NULL AND event_id % 101 <> 7) GROUP BY 1""")
def extract_entities(spark, sf_dir):
    events = stored(normalize.normalize(lines.access_log(access_lines(spark, sf_dir), YEAR, LATEST), "nginx.access"), "normalized")
    return events.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
