"""The typed entity graph: nodes and relations of events, aggregates, selection, neighbourhoods and paths.

A node is ``type:value``. Extraction is one pass of column expressions; aggregation is partial and final, by node and by
edge. Iterations (core, neighbourhood, path) write each round to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import network, text
from emberlog.functions.severity import sev_name, sev_rank
from emberlog.functions.text import any_of
from emberlog.operators.durable import compiled, stored

NODE_TYPES = ["ip", "user", "host", "process", "pid", "file", "hash", "domain", "url", "port", "email", "key", "session", "pod", "service", "registry", "other"]
RELATIONS = ["auth_from", "connected_to", "ran", "spawned", "wrote", "read", "deleted", "resolved", "requested", "used_key", "on_host", "session", "co_occurred"]
INFRASTRUCTURE = ["port", "pid", "session"]

# Which fields hold what.
SRC_IP = ["src_ip", "src", "sourceIPAddress", "IpAddress", "client_ip", "remote_addr", "source.ip", "client.ip", "sourceIPs", "srcip", "source_ip", "clientip", "c_ip", "SourceAddress", "src_addr", "ipAddress"]
DST_IP = ["dst_ip", "dst", "destination.ip", "server.ip", "dstip", "dest_ip", "destination_ip", "d_ip", "DestAddress", "dst_addr", "remote_ip", "target_ip"]
DST_PORT = ["dst_port", "dport", "destination.port", "dstport", "DestPort", "d_port", "port", "server_port", "target_port"]
USER = ["user", "user.name", "username", "userName", "TargetUserName", "SubjectUserName", "actor", "userIdentity.userName", "userIdentity.arn", "user.username", "principal", "account", "remote_user", "uid_name", "acct", "login", "AccountName", "sAMAccountName", "requestor", "identity"]
HOST = ["host", "hostname", "Computer", "computer", "node", "instance", "WorkstationName", "device", "hostName", "agent.hostname", "host.name", "machine", "server", "src_host", "dst_host", "dest_host", "device_name"]
PROCESS = ["process", "process.name", "process_name", "program", "ProcessName", "NewProcessName", "Image", "exe", "app", "application", "comm", "process.command_line", "CommandLine", "commandline"]
PARENT = ["ParentProcessName", "ParentImage", "parent_process", "parent"]
PID = ["pid", "process.pid", "ProcessId", "NewProcessId", "process_id"]
PARENT_PID = ["ppid", "ParentProcessId", "parent_pid", "process.parent.pid"]
FILE = ["file", "file.path", "path", "filename", "file_name", "TargetFilename", "ObjectName", "target_path", "dest", "destination", "filepath", "TargetObject", "object", "name", "key"]
HASHES = ["hash", "sha256", "sha1", "md5", "file.hash", "Hashes", "file_hash", "imphash"]
DOMAIN = ["domain", "query", "dns.question.name", "qname", "hostname_queried", "fqdn", "server_name", "sni", "dns_query"]
URLS = ["url", "uri", "http.url", "request_uri", "cs_uri", "target_url", "location"]
EMAILS = ["email", "mail", "sender", "recipient", "from", "to", "mail_from", "rcpt_to"]
SESSION = ["session", "session_id", "sessionId", "logon_id", "LogonId", "TargetLogonId", "sid", "SessionId", "session.id", "request_id", "requestID", "correlation_id", "trace_id"]
KEYS = ["accessKeyId", "access_key", "key_id", "api_key_id", "AccessKeyId"]
PODS = ["pod", "objectRef.name", "kubernetes.pod_name", "pod_name"]
SERVICES = ["svc", "service", "service_name", "app_name"]
ACTIONS = ["action", "eventName", "event", "op", "operation", "verb", "type", "EventID", "event_id", "outcome", "result", "status", "http.status", "auth", "level", "method", "http.method", "disposition"]
STOP = ["", "-", "—", "?", "unknown", "none", "null", "n/a", "na", "root?", "0", "0.0.0.0", "127.0.0.1", "255.255.255.255", "::", "::1", "localhost", "system", "anonymous logon", "*", "true", "false"]
SUCCESS = ["success", "accepted", "allow", "allowed", "permit", "ok", "200", "201", "204", "302", "granted", "logon", "4624"]
FAILURE = ["fail", "failed", "invalid", "denied", "reject", "rejected", "block", "blocked", "drop", "401", "403", "4625", "unauthorized", "forbidden", "error", "refused"]
AUTH_WORDS = ["login", "logon", "auth", "signin", "sign-in", "password", "credential", "sshd", "session opened", "consolelogin", "assumerole", "getsessiontoken", "kerberos", "ntlm", "pam_unix", "su:", "sudo:"]
WRITE_WORDS = ["write", "wrote", "create", "created", "modif", "put", "upload", "export", "save", "copy", "cp ", "mv ", "rename"]
READ_WORDS = ["read", "open", "get", "download", "cat ", "type ", "less ", "more ", "view", "access"]
DELETE_WORDS = ["delet", "remove", "unlink", "rm ", "del ", "truncat", "wipe", "shred", "purge"]
DENIED_WORDS = ["denied", "forbidden", "403", "block"]
DNS_WORDS = ["query", "resolv", "dns"]
USER_HINTS = ["user", "sudo:", "account", "failed", "accepted"]
NO_PROCESS = ["t", "line", "col"]
AUTH_RULES = ["SIGMA-AUTH", "SIGMA-LNX-0012", "SIGMA-LNX-0045", "SIGMA-WIN-0140"]
#: Longer values are no names of anything.
VALUE_LENGTH = 200


_NAMED_FIELDS = sorted({n for names in (SRC_IP, DST_IP, DST_PORT, USER, HOST, PROCESS, PARENT, PID, PARENT_PID, FILE, HASHES, DOMAIN, URLS, EMAILS, SESSION, KEYS, PODS, SERVICES, ACTIONS) for n in names})


def _bare(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\x0b\f\r'\""))


def _values(names: list[str]) -> Column:
    """Values of the named fields in the names' order, out of ``known``, the entries of all fields that any list names.

    Order and repeats are only looked at where there are two values; most events have one of a list, or none.
    """
    place = lambda e: F.struct(F.array_position(F.array(*map(F.lit, names)), e["key"]).alias("at"), e["value"].alias("value"))
    value = lambda x: x["value"]
    several = lambda own: F.array_distinct(F.transform(F.array_sort(F.transform(own, place)), value))
    return text.once(F.filter("known", lambda e: e["key"].isin(names)), lambda own: F.when(F.size(own) > 1, several(own)).otherwise(F.transform(own, value)))


def _clean(values: Column) -> Column:
    """Values that can name a node, each once."""
    bare = F.transform(values, _bare)
    return F.array_distinct(F.filter(bare, lambda v: v.isNotNull() & ~F.lower(v).isin(STOP) & (F.length(v) <= VALUE_LENGTH)))


def _in_text(pattern: str, hints: list[str] | Column, group: int = 1, low: bool = False) -> Column:
    """Matches in an event's text, looked for only where a plain substring, or a given condition, says that there can be some."""
    where = F.col("low" if low else "raw")
    likely = hints if isinstance(hints, Column) else any_of([where.contains(h) for h in hints])
    return F.when(likely, text.every(F.col("raw"), pattern, group)).otherwise(F.array().cast("array<string>"))


def _with(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


def extract(events: DataFrame) -> DataFrame:
    """Events with an array column for each type of entity, and flags that decide about relations.

    Done in three narrow steps, as one would be too large for a compiled stage: the fields that say anything, what fields
    and text hold, and what follows from both.
    """
    about = ["id", "id_seq", "ts", "source", "file", "msg", "rank", "hits"]
    entry = lambda e: F.struct(e["key"].alias("key"), _bare(e["value"]).alias("value"))
    known = F.filter(F.transform(F.filter(F.map_entries("fields"), lambda e: e["key"].isin(_NAMED_FIELDS)), entry), lambda e: ~F.lower(e["value"]).isin(STOP))
    first = compiled(events).select(
        "id", "id_seq", "ts", "source", "file", "msg", "host", "user", "raw", F.lower("raw").alias("low"), sev_rank(F.col("sev")).alias("rank"), F.size("detections").alias("hits"),
        F.exists("detections", lambda d: any_of([d["id"].startswith(r) for r in AUTH_RULES])).alias("auth_hit"), known.alias("known"),
    )
    ips = lambda v: F.filter(network.find_ipv4(v), network.plausible_ip)
    v6 = lambda v: F.when(v.contains(":"), network.find_ipv6(v)).otherwise(F.array().cast("array<string>"))
    labelled = lambda values: F.transform(values, text.proc_label)
    tagged = F.when(F.col("raw").contains("["), F.filter(F.arrays_zip(text.every(F.col("raw"), text.PROC_PID, 1).alias("name"), text.every(F.col("raw"), text.PROC_PID, 2).alias("pid")), lambda x: ~F.lower(x["name"]).isin(NO_PROCESS))).otherwise(F.array().cast("array<struct<name:string,pid:string>>"))
    number = lambda v: v.rlike("^[0-9]+$")
    port = F.coalesce(F.get(_values(DST_PORT), F.lit(0)), F.get(_in_text(text.ENDPOINT, [":"], 2), F.lit(0)))
    action = F.lower(F.concat_ws(" ", F.array_join(_values(ACTIONS), " "), F.substring("msg", 1, 200)))
    second = first.withColumn("tagged", tagged).select(
        *about, "low", "auth_hit", "host", action.alias("action"),
        F.flatten(F.transform(_values(SRC_IP), lambda v: F.concat(ips(v), v6(v)))).alias("src"),
        F.flatten(F.transform(_values(DST_IP), ips)).alias("dst"),
        F.when(F.col("raw").contains("."), ips(F.col("raw"))).otherwise(F.array().cast("array<string>")).alias("text_ip"),
        F.transform(F.array_distinct(_with(F.array("user"), _values(USER), _in_text(text.USER_IN_TEXT, USER_HINTS, low=True))), text.clean_user).alias("user"),
        F.filter(_with(F.array("host"), _values(HOST)), lambda v: text.plausible_host(v) & ~v.rlike(f"^{network.IPV4}$")).alias("hosts"),
        labelled(_with(_values(PROCESS), F.transform("tagged", lambda x: x["name"]))).alias("process"),
        labelled(_values(PARENT)).alias("parent"),
        F.filter(_with(_values(PID), F.transform("tagged", lambda x: x["pid"]), _in_text(text.PID_PAIR, ["pid", "process"], low=True)), number).alias("pid"),
        F.filter(_values(PARENT_PID), number).alias("parent_pid"),
        F.filter(_with(_values(FILE), _in_text(text.WIN_PATH, [":\\"]), _in_text(text.UNIX_PATH, ["/"])), lambda v: (F.length(v) > 2) & ~number(v) & ~v.rlike(f"^{network.IPV4}$") & ~text.noise_file(v)).alias("path"),
        F.transform(_with(F.flatten(F.transform(_values(HASHES), lambda v: text.every(v, text.HASH))), text.every(F.col("raw"), text.HASH)), F.lower).alias("hash"),
        _with(_values(URLS), _in_text(text.URL, ["http"], low=True)).alias("urls"),
        _with(_values(DOMAIN), _in_text(text.DOMAIN, F.col("raw").rlike(text.DOMAIN_END))).alias("names"),
        F.transform(_with(F.filter(_values(EMAILS), lambda v: v.rlike(f"^{text.EMAIL}$")), _in_text(text.EMAIL, ["@"])), F.lower).alias("email"),
        F.array(F.when(port.rlike("^[0-9]{1,5}$") & (port.try_cast("int") < 65536), port)).alias("port"),
        _with(_values(KEYS), _in_text(text.ACCESS_KEY, ["AKIA", "ASIA"]), _in_text(text.KEY_PRINT, ["SHA256:"])).alias("key"),
        F.filter(_values(SESSION), lambda v: F.length(v).between(3, 80)).alias("session"),
        F.slice(_values(PODS), 1, 1).alias("pod"), F.slice(_values(SERVICES), 1, 1).alias("service"),
        _in_text(text.REGISTRY, ["hk"], low=True).alias("registry"),
    )
    words = lambda column, some: any_of([F.col(column).contains(w) for w in some])
    won, lost = words("action", SUCCESS), words("action", FAILURE)
    outcome = F.when(won & lost, "mixed").when(lost & words("action", DENIED_WORDS), "denied").when(lost, "failure").when(won, "success").otherwise("")
    domains = _clean(F.transform(F.concat("names", F.transform("urls", network.url_host)), network.clean_domain))
    arrays = ["dst", "user", "process", "parent", "pid", "parent_pid", "path", "hash", "email", "port", "key", "session", "pod", "registry"]
    third = second.select(
        *about, *[_clean(F.col(c)).alias(c) for c in arrays], _clean(F.col("src")).alias("src"), _clean(F.array_except("text_ip", F.concat("src", "dst"))).alias("text_ip"),
        _clean(F.col("hosts")).alias("host"), _clean(F.array_except("service", F.array("host"))).alias("service"), domains.alias("domain"), (F.size("urls") > 0).alias("web"),
        (words("low", AUTH_WORDS) | F.col("auth_hit")).alias("auth"), (F.lower("source").contains("dns") | words("low", DNS_WORDS)).alias("dns_words"), outcome.alias("outcome"), words("low", WRITE_WORDS).alias("writes"),
        F.when(words("low", DELETE_WORDS), "deleted").when(words("low", WRITE_WORDS), "wrote").when(words("low", READ_WORDS), "read").otherwise("co_occurred").alias("access"),
    )
    return third.withColumn("dns", F.col("dns_words") & (F.size("domain") > 0)).drop("dns_words")


NODE_COLUMNS = [("ip", "src"), ("ip", "dst"), ("ip", "text_ip"), ("user", "user"), ("host", "host"), ("process", "process"), ("process", "parent"), ("pid", "pid"), ("pid", "parent_pid"), ("file", "path"), ("hash", "hash"), ("domain", "domain"), ("port", "port"), ("email", "email"), ("key", "key"), ("session", "session"), ("pod", "pod"), ("service", "service"), ("registry", "registry")]


def _named(kind: str, column: str) -> Column:
    return F.transform(column, lambda v: F.concat(F.lit(f"{kind}:"), v))


def event_nodes(extracted: DataFrame) -> DataFrame:
    """One row for each event and node."""
    every = F.array_distinct(F.flatten(F.array(*[_named(kind, c) for kind, c in NODE_COLUMNS])))
    return extracted.select("id", "id_seq", "ts", "source", "file", "rank", "hits", F.explode(every).alias("node"))


def event_edges(extracted: DataFrame) -> DataFrame:
    """One row for each event and relation (src, dst, rel, why).

    Ends are crossed by exploding one side and then the other, so no row holds a cross product. An event whose entities
    have no relation of their own links its first two anchors with what else is there, domains only as what was asked for.
    """
    n = {c: F.col(c) for _, c in NODE_COLUMNS}
    empty = F.array().cast("array<string>")
    some = lambda c: F.size(c) > 0
    first = lambda *names: reduce(lambda rest, c: F.when(some(c), n[c]).otherwise(rest), reversed(names), empty)
    host = F.slice(n["host"], 1, 1)
    dns, auth = F.col("dns"), F.col("auth")
    actor, access = first("process", "user"), F.col("access")
    # (condition, starts, ends, relation, why)
    table = [
        (auth, n["user"], first("src", "text_ip"), "auth_from", F.concat(F.lit("authentication "), F.when(F.col("outcome") == "", "attempt").otherwise(F.col("outcome")))),
        (None, n["src"], n["dst"], "connected_to", "network flow"),
        (some("src"), n["dst"], n["port"], "connected_to", "listening port"),
        (~some("dst") & ~auth, n["src"], host, "connected_to", "request to host"),
        (None, n["user"], n["process"], "ran", "process run by account"),
        (None, n["process"], host, "on_host", "process on host"),
        (None, n["process"], n["pid"], "session", "process id"),
        (None, n["parent"], n["process"], "spawned", "parent and child process"),
        (None, n["parent_pid"], n["pid"], "spawned", "parent and child process id"),
        (None, actor, n["path"], access, F.when(access == "co_occurred", "file referenced").otherwise(F.concat(F.lit("file "), access))),
        (None, n["path"], n["hash"], "session", "file hash"),
        (~some("process") & ~some("user"), n["path"], host, "on_host", "file on host"),
        (None, actor, n["registry"], F.when(F.col("writes"), "wrote").otherwise("read"), "registry key"),
        (dns, reduce(lambda rest, c: F.when(some(c[0]), c[1]).otherwise(rest), [("text_ip", n["text_ip"]), ("host", host), ("src", n["src"])], empty), n["domain"], "resolved", "name lookup"),
        (~dns & F.col("web"), reduce(lambda rest, c: F.when(some(c[0]), c[1]).otherwise(rest), [("host", host), ("text_ip", n["text_ip"]), ("user", n["user"]), ("src", n["src"])], empty), n["domain"], "requested", "web request"),
        (None, n["user"], n["key"], "used_key", "credential"),
        (None, n["key"], first("src", "text_ip"), "auth_from", "key used from"),
        (None, n["user"], n["session"], "session", "session id"),
        (None, n["session"], n["src"], "auth_from", "session source"),
        (None, n["user"], n["pod"], "ran", "action on pod"),
        (None, n["pod"], n["service"], "on_host", "pod of service"),
        (None, n["user"], host, "on_host", "account seen on host"),
        (None, n["text_ip"], host, "co_occurred", "address seen on host"),
        (None, n["user"], n["email"], "session", "email address"),
    ]
    text_of = lambda x: x if isinstance(x, Column) else F.lit(x)
    side = lambda a, b, rel, why: F.struct(a.alias("srcs"), b.alias("dsts"), text_of(rel).alias("rel"), text_of(why).alias("why"))
    # Values of a column are distinct, so two ends are one node only if each is a single value.
    apart = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(a) > 1) | (F.size(b) > 1) | (F.get(a, F.lit(0)) != F.get(b, F.lit(0))))
    linked = [F.coalesce(apart(a, b) if c is None else c & apart(a, b), F.lit(False)) for c, a, b, *_ in table]
    anchors = F.slice(F.concat(host, n["user"], n["src"], n["text_ip"]), 1, 2)
    others = F.slice(F.array_except(F.flatten(F.array(*[v for c, v in n.items() if c != "domain"])), anchors), 1, 6)
    fallback = [side(anchors, others, "co_occurred", "seen together"), side(anchors, F.slice(n["domain"], 1, 6), "requested", "seen with")]
    sides = [F.when(fit, side(a, b, rel, why)) for fit, (_, a, b, rel, why) in zip(linked, table, strict=True)]
    about = ["id", "id_seq", "ts", "source", "file", "rank", "outcome"]
    # Names are made once, in a step of their own; sides that do not hold are never built.
    named = extracted.select(*about, "dns", "auth", "access", "writes", "web", *[_named(kind, c).alias(c) for kind, c in NODE_COLUMNS])
    sided = named.select(*about, F.inline(F.array_compact(F.array(*sides, *[F.when(~any_of(linked), f) for f in fallback]))))
    started = sided.select(*about, F.explode("srcs").alias("src"), "dsts", "rel", "why")
    return started.select(*about, "src", F.explode("dsts").alias("dst"), "rel", "why").where("src <> dst")


def _tally(long: DataFrame, key: list[str], by: str) -> DataFrame:
    """A map from each value of ``by`` to its count, per key: aggregated twice, so that no list of rows is gathered."""
    return long.groupBy(*key, by).agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(f"by_{by}"))


def nodes(per_event: DataFrame, by: tuple[str, ...] = ("source", "file")) -> DataFrame:
    """Aggregated nodes: count, range, severity, hits, and counts by the columns of ``by`` (as by_source, by_file).

    Events are counted by node and the first of these columns, from which both the figures and the counts by it follow;
    each further column takes another pass.
    """
    head, rest = list(by[:1]), list(by[1:])
    once = per_event.groupBy("node", *head).agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("rank").alias("rank"), F.sum("hits").alias("hits"), F.min("id_seq").alias("first_seq"))
    if head:
        tally = F.map_from_entries(F.array_sort(F.collect_list(F.struct(*head, F.col("count").alias("n")))))
        once = once.groupBy("node").agg(F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("rank").alias("rank"), F.sum("hits").alias("hits"), F.min("first_seq").alias("first_seq"), tally.alias(f"by_{head[0]}"))
    joined = reduce(lambda found, column: found.join(_tally(per_event, ["node"], column), "node"), rest, once)
    return joined.select("node", F.substring_index("node", ":", 1).alias("type"), F.expr("substring(node, instr(node, ':') + 1)").alias("value"), "count", "first_ts", "last_ts", sev_name(F.col("rank")).alias("sev"), "rank", "hits", "first_seq", *[f"by_{c}" for c in by])


def edges(per_event: DataFrame, sample: int = 20) -> DataFrame:
    """Aggregated edges: count, range, severity, outcomes, commonest reason, files and the first ``sample`` events (event_ids).

    Events of an edge with one file, outcome and reason are counted first, which needs no state but numbers; the sets and
    the commonest reason come from these few rows. Without a ``sample`` there is no event_ids, and no event is sorted.
    """
    key = ["src", "dst", "rel"]
    range_ = lambda first, last: [F.min(first).alias("first_ts"), F.max(last).alias("last_ts"), F.max("rank").alias("rank")]
    alike = per_event.groupBy(*key, "why", "file", "outcome").agg(F.count("*").alias("n"), *range_("ts", "ts"))
    reasons = alike.groupBy(*key, "why").agg(F.sum("n").alias("n"), *range_("first_ts", "last_ts"), F.collect_set("outcome").alias("outcomes"), F.collect_set("file").alias("files"))
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    once = reasons.groupBy(*key).agg(
        F.sum("n").alias("count"), *range_("first_ts", "last_ts"), F.array_sort(F.array_remove(every("outcomes"), "")).alias("outcomes"),
        F.min_by("why", F.when(F.col("why").isNotNull(), F.struct(-F.col("n"), "why"))).alias("why"), F.array_sort(every("files")).alias("files"),
    ).withColumn("sev", sev_name(F.col("rank")))
    if not sample:
        return once
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.col("ts").asc_nulls_last(), "id_seq"))
    few = per_event.withColumn("place", place).where(F.col("place") <= sample).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("event_ids"))
    return once.join(few, key)


def _both(edge_rows: DataFrame) -> DataFrame:
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edge_rows.where("src <> dst").select("src", "dst").distinct().select(F.inline(ends)).distinct()


def degree(edge_rows: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, whatever the direction, itself excluded."""
    return _both(edge_rows).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def ranked(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes with degree and rank order: hits that lead somewhere, then what is no infrastructure, hits, degree, count, first seen."""
    joined = node_rows.join(degree(edge_rows), "node", "left").fillna({"degree": 0})
    keys = [((F.col("hits") > 0) & (F.col("degree") > 0)).desc(), F.col("type").isin(INFRASTRUCTURE), F.desc("hits"), F.desc("degree"), F.desc("count"), F.asc("first_seq"), F.asc("node")]
    return joined.withColumn("order", F.struct(~((F.col("hits") > 0) & (F.col("degree") > 0)), F.col("type").isin(INFRASTRUCTURE), -F.col("hits"), -F.col("degree"), -F.col("count"), F.col("first_seq"), F.col("node"))).orderBy(*keys)


def select(node_rows: DataFrame, edge_rows: DataFrame, types=(), files=(), query: str = "", min_count: int = 1, relations=(), limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A slice of the graph whose edges end within it: nodes by rank (matches of a text first, then their neighbours)."""
    own = ranked(node_rows, edge_rows)
    if types:
        own = own.where(F.col("type").isin(list(types)))
    if files:
        own = own.where(F.arrays_overlap(F.map_keys("by_file"), F.array(*map(F.lit, files))))
    links = edge_rows.where(F.col("count") >= min_count)
    if relations:
        links = links.where(F.col("rel").isin(list(relations)))
    tier = F.lit(0)
    if query:
        match = own.where(F.lower("value").contains(query.lower())).select("node")
        near = _both(links).join(F.broadcast(match.withColumnRenamed("node", "src").limit(2000)), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("_near", F.lit(True))
        own = own.join(near, "node", "left")
        tier = F.when(F.lower("value").contains(query.lower()), 0).when(F.col("_near"), 1)
        own = own.where(tier.isNotNull())
    top = own.withColumn("tier", tier).orderBy("tier", "order").limit(min(limit, 2000))
    inside = top.select(F.col("node").alias("src"))
    closed = links.join(F.broadcast(inside), "src", "left_semi").join(F.broadcast(inside.withColumnRenamed("src", "dst")), "dst", "left_semi")  # at most 2000 rows
    return top.drop("tier", "_near"), closed


def core_numbers(edge_rows: DataFrame, cap: int | None = None, most_rounds: int = 2000) -> DataFrame:
    """(node, core): the largest k such that the node is left when nodes with fewer than k neighbours are taken away.

    Every node starts from its number of neighbours and takes, round by round, the H-index of its neighbours' values: the
    largest h such that h of them are at least h. The values only fall, and the fixed point is the core number, for all k
    at once. A node's neighbours are counted by value before they are shuffled (never gathered), so a hub is a short
    histogram. ``cap`` bounds the values where only one k matters. Raises if nothing has come to rest after ``most_rounds``.
    """
    links = stored(_both(edge_rows.where("src <> dst").select("src", "dst")).select("src", "dst").distinct(), "links")
    bounded = (lambda c: F.least(c, F.lit(cap).cast("bigint"))) if cap is not None else (lambda c: c)
    values = stored(links.groupBy(F.col("src").alias("node")).agg(bounded(F.count("*")).alias("core")), "cores")
    total = values.agg(F.sum("core")).first()[0]
    for _ in range(most_rounds):
        if total is None:
            return values
        near = links.join(values.select(F.col("node").alias("dst"), "core"), "dst").groupBy(F.col("src").alias("node"), "core").agg(F.count("*").alias("n"))
        above = F.sum("n").over(W.partitionBy("node").orderBy(F.desc("core")))
        index = near.withColumn("least", F.least("core", above)).groupBy("node").agg(F.max("least").alias("index"))
        values = stored(values.join(index, "node").select("node", F.least("core", "index").alias("core")), "cores")
        before, total = total, values.agg(F.sum("core")).first()[0]
        if total == before:  # values never rise, so an equal sum is the same values
            return values
    raise RuntimeError("core numbers did not come to rest")


def k_core(edge_rows: DataFrame, least: int, most_rounds: int = 2000) -> DataFrame:
    """What is left of the edges once nodes with fewer than ``least`` neighbours are taken away until none is."""
    kept = core_numbers(edge_rows, least, most_rounds).where(F.col("core") >= least).select("node")
    own = edge_rows.where("src <> dst").select("src", "dst").distinct()
    return own.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def neighbourhood(edge_rows: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """(node, hop) of everything within ``hops`` (at most four) of a node."""
    links = stored(_both(edge_rows), "links")
    seen = edge_rows.sparkSession.createDataFrame([(start, 0)], "node string, hop int")
    frontier = seen
    for hop in range(1, min(hops, 4) + 1):
        reached = links.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = stored(reached.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edge_rows: DataFrame, start: str, goal: str, most_hops: int = 4) -> DataFrame:
    """(step, src, dst, rel, count) of a shortest path, the strongest edge of each step; empty if there is none.

    Breadth first by joins; a node remembers its smallest parent, so the path is always the same one.
    """
    spark = edge_rows.sparkSession
    links, most_hops = stored(_both(edge_rows), "links"), min(most_hops, 8)
    frontier = spark.createDataFrame([(start, None, 0)], "node string, parent string, hop int")
    seen, hop = frontier, 0
    while hop < most_hops and not seen.where(F.col("node") == goal).limit(1).count():
        hop += 1
        step = links.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = stored(step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    steps, at = [], goal
    for _ in range(most_hops):  # one lookup a hop, at most eight
        row = seen.where((F.col("node") == at) & F.col("parent").isNotNull()).select("parent").first()
        if row is None:
            break
        steps.append((row["parent"], at))
        at = row["parent"]
    if at != start or not steps:
        steps = []
    plan = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(reversed(steps))], "step int, a string, b string")
    either = edge_rows.join(F.broadcast(plan), ((F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))) | ((F.col("src") == F.col("b")) & (F.col("dst") == F.col("a"))))
    return either.groupBy("step").agg(F.max_by(F.struct("src", "dst", "rel", "count"), F.struct("count", "rel", "src")).alias("e")).select("step", "e.*")


def node_detail(node_rows: DataFrame, edge_rows: DataFrame, per_event: DataFrame, node: str, most_neighbours: int = 60, most_events: int = 50) -> dict[str, DataFrame]:
    """A node's figures, its neighbours by severity and count, and its last events."""
    touching = edge_rows.where((F.col("src") == node) | (F.col("dst") == node))
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    near = touching.groupBy(other.alias("node")).agg(F.sum("count").alias("count"), F.max("rank").alias("rank"), F.array_sort(F.collect_set("rel")).alias("relations"))
    return {
        "node": node_rows.where(F.col("node") == node),
        "neighbours": near.orderBy(F.desc("rank"), F.desc("count"), "node").limit(most_neighbours),
        "events": per_event.where(F.col("node") == node).orderBy(F.col("ts").desc_nulls_last(), F.desc("id_seq")).limit(most_events),
    }


def find_nodes(ranked_nodes: DataFrame, needle: str, kind: str = "", limit: int = 20) -> DataFrame:
    own = ranked_nodes.where(F.lower("value").contains(needle.lower()))
    return (own.where(F.col("type") == kind) if kind else own).orderBy("order").limit(limit)


def coverage(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Entities and relations seen in each file."""
    by_node = node_rows.select(F.explode(F.map_keys("by_file")).alias("file")).groupBy("file").agg(F.count("*").alias("entities"))
    by_edge = edge_rows.select(F.explode("files").alias("file")).groupBy("file").agg(F.count("*").alias("relations"))
    return by_node.join(by_edge, "file", "full").fillna(0)


def overlay(node_rows: DataFrame, edge_rows: DataFrame, own_nodes: DataFrame, own_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds authored nodes (node, type, value) and edges (src, dst, rel): new ones only, and edges only between known nodes."""
    fresh = own_nodes.dropDuplicates(["node"]).join(node_rows.select("node"), "node", "left_anti")
    every = node_rows.unionByName(fresh, allowMissingColumns=True)
    known = every.select("node")
    closed = own_edges.dropDuplicates(["src", "dst", "rel"]).join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return every, edge_rows.unionByName(closed.join(edge_rows.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti").select("src", "dst", "rel"), allowMissingColumns=True)


def stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Counts by node type and by relation."""
    return node_rows.groupBy(F.lit("type").alias("of"), F.col("type").alias("name")).agg(F.count("*").alias("n")).unionByName(edge_rows.groupBy(F.lit("relation").alias("of"), F.col("rel").alias("name")).agg(F.count("*").alias("n")))
