"""Parsed records to events: times, severity, entities, coverage, and stable ids over re-parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import network, severity, text

# Fields that hold addresses, accounts, hosts and indicators, in the order in which they count.
IP_FIELDS = ["src_ip", "src", "dst", "dst_ip", "sourceIPAddress", "IpAddress", "client_ip", "remote_addr", "ip", "sourceIPs", "source.ip", "destination.ip", "client.ip", "server.ip"]
USER_FIELDS = ["user", "user.name", "username", "userName", "TargetUserName", "SubjectUserName", "actor", "userIdentity.userName", "user.username", "principal", "account", "remote_user", "uid_name"]
HOST_FIELDS = ["host", "hostname", "Computer", "computer", "svc", "service", "node", "instance"]
IOC_FIELDS = ["url", "email", "domain", "onion", "registry_key"]
STOP = ["", "-", "—", "unknown", "none", "null", "n/a", "root?"]
NO_ADDRESS = ["0.0.0.0", "127.0.0.1", "255.255.255.255"]
NAME_LENGTH, ENTITY_LENGTH, IOC_ITEMS = 64, 128, 5


#: Records of a file that are scanned together; what one segment hands to the next is one row of a small table.
SEGMENT = 1 << 17


def _segment() -> Column:
    """The segment of a record within its file; records without number come first."""
    return F.coalesce(F.floor(F.col("id_seq") / SEGMENT), F.lit(-1).cast("bigint"))


def _edges(df: DataFrame, at: Column) -> DataFrame:
    """(file, segment, head, tail): the first and the last known time of each segment, by partial aggregates.

    Unknown times are left out by the order, not by a filter: a filter would be pushed below the parser and spell it out.
    """
    own = df.select("file", _segment().alias("segment"), F.coalesce("id_seq", F.lit(-1).cast("bigint")).alias("place"), at.alias("at"))
    known = F.when(F.col("at").isNotNull(), F.struct("place", "at"))
    return own.groupBy("file", "segment").agg(F.min_by("at", known).alias("head"), F.max_by("at", known).alias("tail"))


def forward_fill(df: DataFrame) -> DataFrame:
    """The time of the record before, per file in record order; leading blanks take the file's first time.

    A segmented scan: records are filled within segments of ``SEGMENT`` record numbers, so a file of any size spreads,
    and each segment's blanks at its start take the last known time of the segments before it.
    """
    before = W.partitionBy("file").orderBy("segment")
    carried = F.last("tail", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1))
    first = F.first("head", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    small = _edges(df, F.col("ts")).select(F.col("file").alias("_file"), F.col("segment").alias("_segment"), F.coalesce(carried, first).alias("_carried"))
    within = F.last("ts", ignorenulls=True).over(W.partitionBy("_own_file", "_own").orderBy("id_seq").rowsBetween(W.unboundedPreceding, 0))
    own = df.withColumn("_own_file", F.col("file")).withColumn("_own", _segment()).withColumn("ts", within)
    met = own.join(small, F.col("_own_file").eqNullSafe(F.col("_file")) & (F.col("_own") == F.col("_segment")), "left")
    return met.withColumn("ts", F.coalesce("ts", "_carried")).select(*df.columns)


def clock_skew(df: DataFrame) -> DataFrame:
    """Largest backward jump in record order, in seconds, per file: within segments, and from each to the next.

    Records of one number follow each other by time, so there is no jump between them.
    """
    at, zero = F.unix_timestamp("ts"), F.lit(0).cast("bigint")
    earlier = lambda c, order: F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    own = df.select("file", _segment().alias("segment"), "id_seq", at.alias("at"))
    inner = own.select("file", "at", (earlier("at", W.partitionBy("file", "segment").orderBy("id_seq", "at")) - F.col("at")).alias("back"))
    between = _edges(df, at).select("file", F.col("head").alias("at"), (earlier("tail", W.partitionBy("file").orderBy("segment")) - F.col("head")).alias("back"))
    jumps = [x.groupBy("file").agg(F.max("at").alias("at"), F.max("back").alias("back")) for x in (inner, between)]
    found = jumps[0].unionByName(jumps[1]).groupBy("file").agg(F.greatest(zero, F.coalesce(F.max("back"), zero)).alias("skew_seconds"), F.max("at").alias("at"))
    return found.where("at IS NOT NULL").drop("at")


def skew_note(skews: DataFrame) -> DataFrame:
    late = F.col("skew_seconds") > 0
    return skews.agg(F.when(F.count_if(late) == 0, "no skew detected").otherwise(F.format_string("%d skews, max %ds", F.count_if(late), F.max("skew_seconds"))).alias("note"))


def _values(fields: Column, names: list[str], fit=lambda v: F.lit(True)) -> Column:
    """The non-empty values of the named fields, in the names' order."""
    found = F.array(*[F.try_element_at(fields, F.lit(n)) for n in names])
    return F.filter(found, lambda v: v.isNotNull() & (v != "") & fit(v))


def extract_entities(fields: Column, raw: Column, user: Column, host: Column) -> Column:
    """Addresses, accounts, hosts, keys, pods, processes and indicators of a record, in this order, each once.

    The arguments are bound to a lambda's variable, once each: a filter that the optimizer makes of the result, as an
    explode does, would else spell out all that they are made of wherever they are used.
    """
    given = F.array(F.struct(fields.alias("fields"), raw.alias("raw"), user.alias("user"), host.alias("host")))
    return F.transform(given, lambda g: _entities(g["fields"], g["raw"], g["user"], g["host"]))[0]


def _entities(fields: Column, raw: Column, user: Column, host: Column) -> Column:
    empty = F.array().cast("array<string>")
    short = lambda v: (F.length(v) < NAME_LENGTH) & ~v.contains(" ")
    addresses = F.flatten(F.transform(_values(fields, IP_FIELDS), lambda v: F.concat(network.find_ipv4(v), network.find_ipv6(v))))
    in_text = F.filter(network.find_ipv4(raw), lambda v: ~v.isin(NO_ADDRESS))
    pod = F.get(_values(fields, ["pod", "objectRef.name", "kubernetes.pod_name"]), F.lit(0))
    base = F.regexp_replace(pod, "(-[a-f0-9]{4,10})?(-[a-z0-9]{5})?$", "")
    pid, program = F.get(_values(fields, ["pid", "process.pid"]), F.lit(0)), F.get(_values(fields, ["program"]), F.lit(0))
    process = F.when(pid.rlike("^[0-9]+$"), F.concat(program, F.lit("["), pid, F.lit("]")))
    items = F.flatten(F.transform(_values(fields, IOC_FIELDS), lambda v: F.slice(F.split(v, ","), 1, IOC_ITEMS)))
    # Text is searched for keys only where one can be: the patterns are lazy behind a plain substring test.
    keys = F.when(raw.contains("AKIA") | raw.contains("ASIA"), text.every(raw, text.ACCESS_KEY)).otherwise(empty)
    prints = F.when(raw.contains("SHA256:"), text.every(raw, text.KEY_PRINT)).otherwise(empty)
    every = F.concat(
        addresses, in_text, F.array(user), _values(fields, USER_FIELDS, short), F.array(host), _values(fields, HOST_FIELDS, short),
        keys, prints, F.array(pod, F.when((base != "") & (base != pod), base), process), items,
    )
    trimmed = F.transform(every, lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & ~F.lower(v).isin(STOP) & (F.length(v) <= ENTITY_LENGTH)))


def normalize(parsed: DataFrame, source: str | Column, source_id: Column | None = None) -> DataFrame:
    """Parsed records (file, id_seq, raw, msg, ts, host, user, sev, fields) as events."""
    fields = F.map_filter("fields", lambda _, v: v.isNotNull() & (v != ""))
    filled = forward_fill(parsed.withColumn("fields", F.coalesce(fields, F.create_map().cast("map<string,string>"))))
    sid = source_id if source_id is not None else F.concat(F.lit("s"), F.substring(F.sha1("file"), 1, 8))
    msg = F.when(F.coalesce(F.col("msg"), F.lit("")) == "", F.substring("raw", 1, 200)).otherwise(F.col("msg"))
    user, host = (F.coalesce(F.col(c), F.lit("")) for c in ("user", "host"))
    named = filled.select("id_seq", F.date_trunc("second", "ts").alias("ts"), "file", host.alias("host"), user.alias("user"), msg.alias("msg"), F.coalesce("raw", F.lit("")).alias("raw"), "fields", "sev")
    return named.select(
        F.concat(F.lit("l"), F.substring(F.sha1("file"), 1, 8), F.lower(F.hex("id_seq"))).alias("id"),
        "id_seq", "ts", (source if isinstance(source, Column) else F.lit(source)).alias("source"), sid.alias("source_id"), "file", "host", "user", "msg",
        severity.infer_severity(F.col("sev"), F.col("fields"), F.col("msg")).alias("sev"),
        "raw", "fields", extract_entities(F.col("fields"), F.col("raw"), F.col("user"), F.col("host")).alias("entities"),
        F.array().cast("array<struct<id:string,name:string,level:string>>").alias("detections"),
    )


def parse_coverage(events: DataFrame, *by: str) -> DataFrame:
    """Records, parse errors and the share that was understood."""
    wrong = F.count_if(F.map_contains_key("fields", F.lit("parse_error")))
    return events.groupBy(*by).agg(F.count("*").alias("records"), wrong.alias("errors"), F.round((F.count("*") - wrong) / F.count("*"), 6).alias("coverage"))


def template_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id", text.template_of(F.col("msg")).alias("template")).agg(F.count("*").alias("n"))


def keep_ids(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-parsed events with the ids that their records had, and the old ids that no new record takes over.

    Sources whose record count is unchanged keep ids by record number; in others a record takes the id of the first old
    record of equal raw text (numbered among its likes), and new ones keep their own id.
    """
    sizes = old.groupBy("source_id").agg(F.count("*").alias("a")).join(new.groupBy("source_id").agg(F.count("*").alias("b")), "source_id", "full")
    same = sizes.select("source_id", (F.col("a") == F.col("b")).alias("_same"))
    rank = F.row_number().over(W.partitionBy("source_id", "raw").orderBy("id_seq"))
    mark = lambda df: df.withColumn("_rank", rank).join(same, "source_id")
    left = mark(new).alias("n")
    right = mark(old.select("source_id", "id_seq", "raw", F.col("id").alias("_old"))).alias("o")
    by_number = (F.col("n._same")) & (F.col("n.id_seq") == F.col("o.id_seq"))
    by_text = (~F.col("n._same")) & (F.col("n.raw") == F.col("o.raw")) & (F.col("n._rank") == F.col("o._rank"))
    first = left.where("_same").join(right.where("_same"), (F.col("n.source_id") == F.col("o.source_id")) & by_number, "left")
    second = left.where("NOT _same OR _same IS NULL").join(right.where("NOT _same"), (F.col("n.source_id") == F.col("o.source_id")) & by_text, "left")
    out = [d.select(*[F.col(f"n.{c}").alias(c) if c != "id" else F.coalesce(F.col("o._old"), F.col("n.id")).alias("id") for c in new.columns]) for d in (first, second)]
    kept = out[0].unionByName(out[1])
    lost = old.select("id").join(kept.select("id"), "id", "left_anti")
    return kept, lost
