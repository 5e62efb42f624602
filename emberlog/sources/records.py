"""Structured formats: JSON lines and documents, cloud trails, cluster audits, event XML, and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.timestamps import parse_ts, ts_from_number
from emberlog.sources.lines import put, shaped

# Under which keys records say what.
TS_KEYS = ["ts", "timestamp", "@timestamp", "time", "eventTime", "requestReceivedTimestamp", "date", "datetime"]
LEVEL_KEYS = ["level", "severity", "log.level", "lvl"]
MSG_KEYS = ["msg", "message", "event", "log", "text", "action"]
HOST_KEYS = ["host", "hostname", "svc", "service", "host.name", "node"]
USER_KEYS = ["user", "username", "user.name", "actor", "user.username", "principal"]
NOTABLE = ["rows", "status", "duration_ms", "dest", "path"]
ARRAYS = ["Records", "events", "items", "logs", "entries", "value", "results"]
#: So many levels of objects and lists become dotted keys; what lies deeper stays JSON.
LEVELS = 8


def _opened(entry: Column) -> Column:
    """The (key, value) pairs within a pair: an object's by name, those of a list of objects or lists by number."""
    inside = F.try_variant_get(entry["value"], "$", "map<string,variant>")
    items = F.try_variant_get(entry["value"], "$", "array<variant>")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    named = F.transform(F.map_entries(inside), lambda e: pair(F.concat(entry["key"], F.when(entry["key"] == "", "").otherwise("."), e["key"]), e["value"]))
    numbered = F.transform(items, lambda v, i: pair(F.concat(entry["key"], F.lit("["), i.cast("string"), F.lit("]")), v))
    nested = F.exists(items, lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))
    return F.when(inside.isNotNull(), named).when(nested, numbered).otherwise(F.array(pair(entry["key"], entry["value"])))


def flatten_json(text: Column) -> Column:
    """A JSON object of unknown shape as a flat map of texts; null where the text is none, or names a key twice.

    Lists of plain values are joined by commas; nulls and empty texts are left out.
    """
    root = F.try_parse_json(text)
    first = F.array(F.struct(F.lit("").alias("key"), root.alias("value")))
    pairs = F.aggregate(F.array_repeat(F.lit(0), LEVELS), first, lambda found, _: F.flatten(F.transform(found, _opened)))
    plain = lambda v: F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    said = lambda v: F.coalesce(F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), plain), ","), plain(v))
    told = F.filter(F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), said(e["value"]).alias("value"))), lambda e: e["value"] != "")
    once = lambda es: F.filter(es, lambda e, i: F.array_position(F.transform(es, lambda x: x["key"]), e["key"]) == i + 1)
    flat = F.map_from_entries(F.get(F.transform(F.array(told), once), 0))
    return F.when(F.schema_of_variant(root).startswith("OBJECT"), flat)


def _first(fields: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.when(F.try_element_at(fields, F.lit(k)) != "", F.try_element_at(fields, F.lit(k))) for k in keys])


def json_lines(lines: DataFrame, year: int, latest: str | None = None) -> DataFrame:
    """One object a line; time, level, message, host and user by the first key that is there."""
    own = lines.withColumn("f", flatten_json(F.col("raw")))
    f = F.col("f")
    said = _first(f, MSG_KEYS)
    extra = F.array_join(F.array_compact(F.array(*[F.when(F.try_element_at(f, F.lit(k)).isNotNull(), F.concat(F.lit(f"{k}="), _thousands(k, F.try_element_at(f, F.lit(k))))) for k in NOTABLE])), " ")
    wrong = F.create_map(F.lit("parse_error"), F.lit("json"))
    return shaped(
        own, ts=parse_ts(_first(f, TS_KEYS), year, latest), host=F.coalesce(_first(f, HOST_KEYS), F.lit("")), user=F.coalesce(_first(f, USER_KEYS), F.lit("")),
        sev=_first(f, LEVEL_KEYS), msg=F.when(said.isNotNull(), F.trim(F.concat_ws(" ", said, extra))).otherwise(F.substring("raw", 1, 200)), fields=F.coalesce(f, wrong),
    )


def _thousands(key: str, value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{1,18}$"), F.format_number(value.try_cast("bigint"), 0)).otherwise(value) if key == "rows" else value


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Records (file, id_seq, raw) of whole JSON files."""
    return unwrap(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def unwrap(texts: DataFrame) -> DataFrame:
    """Records of JSON documents (file, value): a top-level array, a list under a usual key or the only list, else the document."""
    parsed = texts.withColumn("v", F.try_parse_json("value"))
    lists = [F.try_variant_get("v", "$", "array<variant>"), *[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ARRAYS]]
    only = F.try_variant_get("v", "$", "map<string,variant>")
    single = F.filter(F.transform(F.map_values(only), lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda a: a.isNotNull())
    records = F.coalesce(*lists, F.when(F.size(single) == 1, F.get(single, F.lit(0))), F.array("v"))
    return parsed.select("file", F.posexplode(records).alias("id_seq", "r")).select("file", F.col("id_seq").cast("long").alias("id_seq"), F.to_json("r").alias("raw"))


# Fixed value: calls that deserve a look.
SENSITIVE = ["ConsoleLogin", "CreateAccessKey", "DeleteTrail", "StopLogging", "UpdateTrail", "DeleteFlowLogs", "PutEventSelectors", "CreateUser", "CreateLoginProfile", "AttachUserPolicy", "PutUserPolicy", "AuthorizeSecurityGroupIngress", "AssumeRole", "GetSecretValue", "DeleteLogGroup", "PutBucketPolicy"]


def cloud_trail(records: DataFrame, year: int, latest: str | None = None) -> DataFrame:
    """Cloud API records: who, from where, what, with what result."""
    own = records.withColumn("f", flatten_json(F.col("raw")))
    f = lambda k: F.try_element_at("f", F.lit(k))
    arn = F.element_at(F.split(f("userIdentity.arn"), "/"), -1)
    user = F.coalesce(f("userIdentity.userName"), f("userIdentity.sessionContext.sessionIssuer.userName"), arn, f("userIdentity.type"), F.lit(""))
    error = f("errorCode")
    login = F.lower(f("responseElements.ConsoleLogin"))
    result = F.when(error.isNotNull(), "failure").otherwise(F.coalesce(login, F.lit("success")))
    fields = put(F.col("f"), src_ip=f("sourceIPAddress"), result=result, MFAUsed=F.lower(f("additionalEventData.MFAUsed")), accessKeyId=F.coalesce(f("responseElements.accessKey.accessKeyId"), f("userIdentity.accessKeyId")), errorCode=F.coalesce(error, F.lit("—")))
    return shaped(
        own, ts=parse_ts(f("eventTime"), year, latest), host=F.coalesce(f("awsRegion"), F.lit("")), user=user,
        sev=F.when(f("eventName").isin(SENSITIVE) | error.isNotNull(), "medium"), msg=F.concat_ws(" ", f("eventName"), F.lit("by"), user, F.lit("from"), f("sourceIPAddress"), F.when(error.isNotNull(), F.concat(F.lit("("), error, F.lit(")")))),
        fields=F.coalesce(fields, F.create_map(F.lit("parse_error"), F.lit("json"))),
    )


def cluster_audit(lines: DataFrame, year: int, latest: str | None = None) -> DataFrame:
    """Cluster audit records: verb, resource and answer."""
    own = lines.withColumn("f", flatten_json(F.col("raw")))
    f = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    resource = F.concat_ws("/", F.when(f("objectRef.resource") != "", f("objectRef.resource")), F.when(f("objectRef.subresource") != "", f("objectRef.subresource")))
    code = f("responseStatus.code")
    fields = put(F.col("f"), verb=f("verb"), resource=resource, namespace=f("objectRef.namespace"), pod=F.when(f("objectRef.resource") == "pods", f("objectRef.name")), responseStatus=code, src_ip=F.get(F.split(f("sourceIPs"), ","), F.lit(0)), command=F.regexp_replace(F.regexp_extract(f("requestURI"), r"[?&](command=.*)$", 1), "&?command=", " "))
    sev = F.when(resource == "pods/exec", "medium").when(code.rlike("^(401|403)$"), "medium").when(code.rlike("^5"), "high")
    return shaped(
        own, ts=parse_ts(F.coalesce(F.try_element_at("f", F.lit("requestReceivedTimestamp")), F.try_element_at("f", F.lit("stageTimestamp"))), year, latest), user=f("user.username"), host=f("objectRef.namespace"), sev=sev,
        msg=F.concat_ws(" ", f("user.username"), f("verb"), resource, F.when(f("objectRef.name") != "", f("objectRef.name")), F.when(code != "", F.concat(F.lit("-> "), code))), fields=F.coalesce(fields, F.create_map(F.lit("parse_error"), F.lit("json"))),
    )


# What event ids mean.
EVENT_NAMES = {"1102": "Audit log cleared", "4624": "Logon", "4625": "Logon failed", "4634": "Logoff", "4648": "Logon with explicit credentials", "4672": "Special privileges assigned", "4688": "Process created", "4720": "Account created", "4728": "Added to global group", "4732": "Added to local group", "4756": "Added to universal group"}
EVENT_LEVELS = {"1102": "high", "4625": "medium", "4672": "low", "4720": "medium", "4728": "medium", "4732": "medium", "4756": "medium"}
LOGON_TYPES = {"2": "interactive", "3": "network", "4": "batch", "5": "service", "7": "unlock", "8": "network cleartext", "9": "new credentials", "10": "remote interactive", "11": "cached interactive"}
_EVENT_XML = "System struct<EventID: string, Level: string, Channel: string, Computer: string, Provider: struct<_Name: string>, TimeCreated: struct<_SystemTime: string>>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"


def event_xml(spark: SparkSession, path: str, year: int = 1970, latest: str | None = None) -> DataFrame:
    """Windows event XML files, a record an Event element."""
    rows = spark.read.format("xml").option("rowTag", "Event").option("ignoreNamespace", "true").schema(_EVENT_XML).load(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id_seq"))
    return _event_records(rows.withColumn("raw", F.to_json(F.struct("System", "EventData"))), year, latest)


def event_elements(elements: DataFrame, year: int = 1970, latest: str | None = None) -> DataFrame:
    """The same of Event elements that are texts already (file, id_seq, raw); what is none has all its fields empty."""
    parsed = F.from_xml("raw", _EVENT_XML, {"ignoreNamespace": "true"})
    return _event_records(elements.withColumn("x", parsed).select("file", "id_seq", "raw", "x.*"), year, latest)


def _event_records(rows: DataFrame, year: int, latest: str | None) -> DataFrame:
    data = F.map_from_entries(F.transform(F.filter("EventData.Data", lambda d: d["_Name"].isNotNull()), lambda d: F.struct(d["_Name"], F.coalesce(d["_VALUE"], F.lit("")))))
    own = rows.withColumn("f", F.coalesce(data, F.create_map().cast("map<string,string>")))
    f = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    code = F.col("System.EventID")
    lookup = lambda table, key, other: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], other)
    user = F.when((f("TargetUserName") != "") & ~f("TargetUserName").endswith("$"), f("TargetUserName")).otherwise(f("SubjectUserName"))
    level = F.get(F.array(*map(F.lit, ["info", "critical", "high", "medium", "info", "info"])), F.col("System.Level").try_cast("int"))
    fields = put(F.col("f"), EventID=code, Channel=F.col("System.Channel"), Computer=F.col("System.Computer"), Provider=F.col("System.Provider._Name"), src_ip=F.when(f("IpAddress") != "-", f("IpAddress")), LogonTypeName=lookup(LOGON_TYPES, f("LogonType"), F.lit("")))
    return shaped(
        own, ts=parse_ts(F.col("System.TimeCreated._SystemTime"), year, latest), host=F.coalesce(F.col("System.Computer"), F.lit("")), user=user, sev=lookup(EVENT_LEVELS, code, level),
        msg=F.concat_ws(" ", lookup(EVENT_NAMES, code, F.concat(F.lit("Event "), code)), F.when(user != "", F.concat(F.lit("user "), user)), F.when(f("LogonType") != "", F.concat(F.lit("type "), f("LogonType")))), fields=fields,
    )


def table_to_events(df: DataFrame, name: str, key: str, ts: str, labels: dict[str, tuple[DataFrame, str, str]] | None = None, label_bound: int = 1_000_000) -> DataFrame:
    """Rows of a table as parsed records: time column, widest text as message, foreign keys with their labels.

    ``labels`` maps a foreign-key column to (table, its key, its label). A label table within ``label_bound`` rows is
    broadcast, a larger one joined by shuffle.
    """
    own = df
    for column, (other, other_key, label) in (labels or {}).items():
        side = other.select(F.col(other_key).alias(f"_{column}"), F.col(label).cast("string").alias(f"{column}.label"))
        small = side.limit(label_bound + 1).count() <= label_bound
        own = own.join(F.broadcast(side) if small else side, F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
    kind = dict(df.dtypes)[ts]
    when = F.col(ts).cast("timestamp") if kind.startswith(("timestamp", "date")) else ts_from_number(F.col(ts)) if kind != "string" else parse_ts(F.col(ts), 1970)
    shown = [c for c in own.columns if c != ts]
    quoted = {c: F.col(f"`{c}`").cast("string") for c in shown}
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, shown)), F.array(*quoted.values())), lambda _, v: v.isNotNull() & (v != ""))
    words = F.concat_ws(" ", F.lit(name), *[F.concat(F.lit(f"{c}="), v) for c, v in quoted.items()])
    return shaped(own.withColumn("file", F.lit(name)).withColumn("id_seq", F.col(key).cast("long")).withColumn("raw", words), ts=F.date_trunc("second", when), msg=F.substring(words, 1, 200), fields=fields)


def timestamp_column(df: DataFrame, sample: int = 60) -> str | None:
    """The column that most likely holds times: by name, then by how many sampled values can be read as such."""
    ranks = ["timestamp", "ts", "time", "date", "created", "visit", "start"]
    named = sorted((next((i for i, r in enumerate(ranks) if r in c.lower()), 99), c) for c in df.columns)
    head = df.limit(sample)
    for _, column in named:
        kind = dict(df.dtypes)[column]
        if kind.startswith(("timestamp", "date")):
            return column
        seen = ts_from_number(F.col(column).try_cast("decimal(38,9)")) if kind != "string" else parse_ts(F.col(column), 1970)
        row = head.agg(F.count(column).alias("n"), F.count(seen).alias("k")).first()
        if row["n"] and row["k"] >= 0.6 * row["n"]:
            return column
    return None
