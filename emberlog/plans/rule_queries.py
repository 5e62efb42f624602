"""Registered queries: every built-in detection over a second event table, whose rows reach all families of rules.

Each column of that table is one expression that Spark and DuckDB both understand, so the SQL is the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.severity import infer_severity
from emberlog.operators import detections
from emberlog.operators.durable import stored
from emberlog.plans.detect_queries import named_bursts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PICK = lambda by, *values: f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"
_OF = lambda family, expression: f"CASE WHEN source = '{family}' THEN {expression} END"
_IP = "CASE WHEN user_id % 4 = 0 THEN '10.0.0.' || (user_id % 200) ELSE '45.83.' || (user_id % 200) || '.' || (user_id % 50 + 1) END"

#: First the columns that others are made of, then the fields by their names, then the texts.
BASE = {
    "id": "'e' || event_id",
    "id_seq": "event_id",
    "epoch_ts": "date_trunc('second', ts)",
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "source": _PICK("event_id % 6", "aws.cloudtrail", "windows.evtx", "k8s.audit", "syslog", "app.jsonl", "nginx.access"),
    "file": "'file' || (event_id % 6)",
    "host": "CASE WHEN event_id % 6 = 2 THEN 'eu' ELSE 'host-' || (user_id % 7) END",
    "user": "CASE WHEN event_id % 6 = 3 AND user_id % 3 = 0 THEN 'root' WHEN user_id % 10 = 0 THEN 'svc_' || user_id WHEN event_id % 6 = 2 AND user_id % 7 = 1 THEN 'system:node' ELSE 'u' || user_id END",
    "user_id": "user_id",
}
FIELDS = {
    "eventName": _OF("aws.cloudtrail", _PICK("k % 8", "ConsoleLogin", "CreateAccessKey", "DeleteTrail", "CreateUser", "AttachUserPolicy", "AuthorizeSecurityGroupIngress", "AssumeRole", "ListBuckets")),
    "MFAUsed": _OF("aws.cloudtrail", "CASE WHEN k < 60 THEN 'no' ELSE 'yes' END"),
    "userIdentity.type": _OF("aws.cloudtrail", "CASE WHEN k % 10 = 0 THEN 'Root' ELSE 'IAMUser' END"),
    "sourceIPAddress": _OF("aws.cloudtrail", _IP),
    "result": f"CASE source WHEN 'aws.cloudtrail' THEN CASE WHEN k % 3 = 0 THEN 'failure' ELSE 'success' END WHEN 'syslog' THEN {_PICK('k % 3', 'Accepted', 'Failed', 'Invalid')} END",
    "EventID": _OF("windows.evtx", _PICK("k % 8", "4624", "4672", "1102", "4720", "4688", "4732", "4625", "4634")),
    "LogonType": _OF("windows.evtx", "CASE WHEN k % 3 = 0 THEN '3' ELSE '2' END"),
    "AuthenticationPackageName": _OF("windows.evtx", "CASE WHEN k % 16 = 0 THEN 'NTLM V2' ELSE 'Kerberos' END"),
    "SubjectUserName": _OF("windows.evtx", _PICK("user_id % 5", "SYSTEM", "WS1$", "alice", "bob", "carol")),
    "PrivilegeList": _OF("windows.evtx", "CASE WHEN k % 5 = 0 THEN 'SeShutdownPrivilege' ELSE 'SeDebugPrivilege' END"),
    "CommandLine": _OF("windows.evtx", "CASE WHEN k % 3 = 0 THEN 'powershell.exe -enc AAA' ELSE 'notepad.exe' END"),
    "TargetUserName": _OF("windows.evtx", "CASE WHEN k % 16 = 5 THEN 'Domain Admins' ELSE 'Users' END"),
    "IpAddress": _OF("windows.evtx", _IP),
    "resource": _OF("k8s.audit", _PICK("k % 4", "pods/exec", "secrets", "pods", "configmaps")),
    "verb": _OF("k8s.audit", _PICK("k % 3", "create", "list", "get")),
    "namespace": _OF("k8s.audit", "CASE WHEN user_id % 2 = 0 THEN 'payments' ELSE 'dev' END"),
    "responseStatus": _OF("k8s.audit", "CASE WHEN k < 30 THEN '403' ELSE '200' END"),
    "program": _OF("syslog", _PICK("k % 5", "sshd", "sudo", "auditd", "useradd", "bash")),
    "op": _OF("syslog", "CASE WHEN k % 10 = 2 THEN 'unlink' WHEN k % 10 = 7 THEN 'read' END"),
    "src_ip": f"CASE WHEN source IN ('syslog', 'nginx.access') THEN {_IP} END",
    "event": _OF("app.jsonl", "CASE WHEN k % 5 = 0 THEN 'report.export' ELSE 'request' END"),
    "rows": _OF("app.jsonl", "CAST(k * 200 AS VARCHAR(9))"),
    "dest": _OF("app.jsonl", "CASE WHEN k % 2 = 0 THEN 's3://out' END"),
    "http.status": _OF("nginx.access", _PICK("k % 4", "401", "200", "503", "302")),
    "http.method": _OF("nginx.access", "CASE WHEN k % 3 = 0 THEN 'GET' ELSE 'POST' END"),
    "http.path": _OF("nginx.access", _PICK("k % 5", "/login", "/.git/config", "/item", "/oauth/token", "/a")),
    "user_agent": _OF("nginx.access", "CASE WHEN k % 25 = 3 THEN 'sqlmap/1.7' ELSE 'agent/1' END"),
}
_MSG = "CASE source WHEN 'app.jsonl' THEN CASE WHEN k % 4 = 1 THEN 'login failed for user' ELSE 'request done' END ELSE source || ' event' END"
_RAW = (
    "CASE source WHEN 'aws.cloudtrail' THEN CASE WHEN k % 16 = 4 THEN 'policy/AdministratorAccess' WHEN k % 16 = 5 THEN 'cidr 0.0.0.0/0' ELSE 'call' END "
    "WHEN 'k8s.audit' THEN CASE WHEN k % 8 = 2 THEN '{\"privileged\": true}' ELSE '{}' END "
    "WHEN 'syslog' THEN CASE WHEN k % 5 IN (2, 4) AND k % 3 = 0 THEN 'rm /home/x/.bash_history' WHEN k % 10 = 1 THEN 'COMMAND=/bin/bash' ELSE 'line' END ELSE source || ' line' END"
)

RULES = detections.catalogue(
    SIGMA_WEB_0042={"window": 604_800, "threshold": 2},
    SIGMA_WEB_0063={"window": 86_400, "threshold": 3},
    SIGMA_AUTH_0111={"within": 604_800},
    SIGMA_WIN_0140={"window": 604_800, "threshold": 2},
    SIGMA_LNX_0045={"window": 604_800, "threshold": 2},
    SIGMA_K8S_0025={"window": 604_800, "threshold": 2},
    SIGMA_APP_0061={"window": 86_400, "threshold": 3},
)


def other_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = e.select(*[F.expr(sql).alias(name) for name, sql in BASE.items()]).withColumnRenamed("epoch_ts", "ts")
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.expr(sql).alias("value")) for n, sql in FIELDS.items()]), lambda x: x["value"].isNotNull())
    own = own.withColumn("fields", F.map_from_entries(entries)).withColumn("msg", F.expr(_MSG)).withColumn("raw", F.expr(_RAW))
    none = F.array().cast("array<struct<id:string,name:string,level:string>>")
    return own.select("id", "id_seq", "ts", "source", F.col("file").alias("source_id"), "file", "host", "user", "msg", infer_severity(F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"), F.lit("")).alias("sev"), "raw", "fields", F.array("user", "host").alias("entities"), none.alias("detections"))


_FIELD = lambda name: "f_" + name.replace(".", "_")
EVENTS_SQL = (
    "WITH b AS (SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in BASE.items()) + " FROM events), f AS (SELECT *, epoch_ts AS ts, epoch(epoch_ts)::BIGINT AS epoch, "
    + ", ".join(f"{sql} AS {_FIELD(name)}" for name, sql in FIELDS.items()) + f", {_MSG} AS msg, {_RAW} AS raw FROM b), ev AS (SELECT * FROM f)"
)
_PUBLIC = "NOT starts_with({0}, '10.')"
_LOGIN = "f_http_path IN ('/login', '/oauth/token')"
#: rule, level, condition of the rules that look at one event.
_ALONE = [
    ("WEB-0050", "medium", "f_user_agent LIKE 'sqlmap%'"),
    ("WEB-0058", "medium", "f_http_path = '/.git/config'"),
    ("AWS-0007", "critical", "f_eventName = 'ConsoleLogin' AND f_MFAUsed = 'no' AND f_result = 'success'"),
    ("AUTH-0203", "high", f"starts_with(\"user\", 'svc_') AND ((f_eventName = 'ConsoleLogin' AND f_MFAUsed = 'no' AND f_result = 'success') OR (f_http_status = '200' AND f_http_method = 'POST' AND {_LOGIN}))"),
    ("AWS-0044", "high", "f_eventName = 'DeleteTrail'"),
    ("AWS-0052", "high", "f_eventName = 'CreateUser' OR (f_eventName = 'AttachUserPolicy' AND contains(raw, 'AdministratorAccess'))"),
    ("AWS-0060", "high", "f_userIdentity_type = 'Root'"),
    ("AWS-0071", "medium", "f_eventName = 'AuthorizeSecurityGroupIngress' AND contains(raw, '0.0.0.0/0')"),
    ("WIN-0088", "medium", "f_EventID = '4624' AND f_LogonType = '3' AND f_AuthenticationPackageName LIKE 'NTLM%'"),
    ("WIN-0091", "high", "f_EventID = '4672' AND f_PrivilegeList = 'SeDebugPrivilege' AND f_SubjectUserName IN ('alice', 'bob', 'carol')"),
    ("WIN-0104", "high", "f_EventID = '1102'"),
    ("WIN-0120", "medium", "f_EventID = '4720'"),
    ("WIN-0133", "high", "f_EventID = '4688' AND f_CommandLine LIKE 'powershell%'"),
    ("WIN-0150", "high", "f_EventID = '4732' AND f_TargetUserName = 'Domain Admins'"),
    ("LNX-0012", "high", "f_program = 'sshd' AND f_result = 'Accepted' AND \"user\" = 'root'"),
    ("LNX-0030", "high", "source = 'syslog' AND contains(raw, '.bash_history') AND (f_program <> 'auditd' OR coalesce(f_op = 'unlink', false))"),
    ("LNX-0041", "medium", "f_program = 'sudo' AND contains(raw, '/bin/bash')"),
    ("LNX-0050", "medium", "f_program = 'useradd'"),
    ("K8S-0011", "medium", "f_resource = 'secrets' AND f_verb IN ('list', 'get') AND NOT starts_with(\"user\", 'system:')"),
    ("K8S-0017", "high", "f_resource = 'pods' AND f_verb = 'create' AND contains(raw, 'privileged')"),
    ("APP-0055", "critical", "f_event = 'report.export' AND CAST(f_rows AS BIGINT) >= 10000"),
]
_BURSTS = [
    ("web", "WEB-0042", "high", "f_src_ip", "f_http_status = '401'", 604_800, 2),
    ("err", "WEB-0063", "medium", "f_http_path", "f_http_status = '503'", 86_400, 3),
    ("win", "WIN-0140", "high", "f_IpAddress", "f_EventID = '4625'", 604_800, 2),
    ("ssh", "LNX-0045", "medium", "f_src_ip", "f_program = 'sshd' AND f_result IN ('Failed', 'Invalid')", 604_800, 2),
    ("k8s", "K8S-0025", "medium", '"user"', "f_responseStatus = '403'", 604_800, 2),
    ("app", "APP-0061", "medium", "host", "source = 'app.jsonl' AND msg LIKE 'login failed%'", 86_400, 3),
]
HITS_SQL = EVENTS_SQL + "".join(named_bursts(name, *rest) for name, _, _, *rest in _BURSTS) + f""", attackers AS (SELECT key AS ip, arg_min(reason, stage) AS reason FROM (SELECT key, '401 burst' AS reason, 1 AS stage FROM web_bursts UNION ALL SELECT f_src_ip, 'scanner', 2 FROM ev WHERE f_user_agent LIKE 'sqlmap%') GROUP BY 1),
hits AS ({" UNION ALL ".join(f"SELECT id, 'SIGMA-{rule}' AS rule_id, '{level}' AS level FROM ev WHERE {where}" for rule, level, where in _ALONE)}
  UNION ALL {" UNION ALL ".join(f"SELECT id, 'SIGMA-{rule}', '{level}' FROM {name}_bursts" for name, rule, level, *_ in _BURSTS)}
  UNION ALL SELECT DISTINCT ev.id, 'SIGMA-AUTH-0111', 'critical' FROM ev JOIN web_bursts b ON b.key = f_src_ip WHERE f_http_status = '200' AND f_http_method = 'POST' AND {_LOGIN} AND ev.epoch BETWEEN b.epoch AND b.epoch + 604800
  UNION ALL SELECT id, 'SIGMA-AWS-0031', CASE WHEN {_PUBLIC.format('f_sourceIPAddress')} OR reason IS NOT NULL THEN 'critical' ELSE 'high' END FROM ev LEFT JOIN attackers ON ip = f_sourceIPAddress WHERE f_eventName = 'CreateAccessKey' AND f_result = 'success'
  UNION ALL SELECT id, 'SIGMA-K8S-0004', CASE WHEN f_namespace = 'payments' THEN 'critical' ELSE 'high' END FROM ev WHERE f_resource = 'pods/exec' AND f_verb = 'create')
"""  # fmt: skip


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(stored(other_events(spark, sf_dir), "events"))
        SQL[fn.__name__] = sql
        return fn

    return add


@query(HITS_SQL + "SELECT id, rule_id, level FROM hits")
def detections_other_families(ev):
    return detections.hits(ev, RULES).select("id", "rule_id", "level")


@query(HITS_SQL + "SELECT rule_id, count(*) AS hits FROM hits GROUP BY 1")
def rule_hit_counts(ev):
    from emberlog.operators.rules import hit_counts

    return hit_counts(detections.detect(ev, RULES))


@query(HITS_SQL + """, has AS (SELECT id, list(rule_id) AS r FROM hits GROUP BY 1), burst AS (SELECT id, max(count) AS n FROM (SELECT id, count FROM web_bursts UNION ALL SELECT id, count FROM err_bursts UNION ALL SELECT id, count FROM win_bursts UNION ALL SELECT id, count FROM ssh_bursts UNION ALL SELECT id, count FROM k8s_bursts UNION ALL SELECT id, count FROM app_bursts) GROUP BY 1)
SELECT ev.id, CASE WHEN list_contains(r, 'SIGMA-LNX-0030') THEN 'shell history file truncated — ' || msg
    WHEN list_contains(r, 'SIGMA-AUTH-0111') THEN f_http_method || ' ' || f_http_path || ' 200 — first success from ' || f_src_ip
    WHEN list_contains(r, 'SIGMA-APP-0055') THEN 'bulk export completed — ' || format('{:,}', CAST(f_rows AS BIGINT)) || ' customer records' || coalesce(' to ' || f_dest, '')
    WHEN list_contains(r, 'SIGMA-WEB-0042') THEN f_http_method || ' ' || f_http_path || ' 401' ELSE msg END AS msg,
  CAST(n AS VARCHAR) AS burst_count, CASE WHEN list_contains(r, 'SIGMA-WEB-0042') THEN '604800s' END AS burst_window, CASE WHEN list_contains(r, 'SIGMA-AWS-0031') THEN 'yes' END AS persistence,
  CASE WHEN list_contains(r, 'SIGMA-AWS-0044') OR list_contains(r, 'SIGMA-LNX-0030') THEN 'defense evasion' END AS tactic, CASE WHEN list_contains(r, 'SIGMA-AUTH-0111') THEN 'not_presented' END AS mfa,
  CASE WHEN list_contains(r, 'SIGMA-APP-0055') THEN 'yes' END AS pii, CASE WHEN list_contains(r, 'SIGMA-WIN-0088') THEN 'NTLM' END AS package, reason AS reputation
FROM ev LEFT JOIN has USING (id) LEFT JOIN burst USING (id) LEFT JOIN attackers ON ip = f_sourceIPAddress""")
def detection_effects(ev):
    """What hits change on events: messages (a burst's without its count and span) and fields."""
    found = detections.detect(ev, RULES)
    f = lambda k, name: F.try_element_at("fields", F.lit(k)).alias(name)
    msg = F.when(F.exists("detections", lambda d: d["id"] == "SIGMA-WEB-0042"), F.regexp_extract("msg", "^(.* 401) — [0-9]+ attempts in [0-9]+s from .+$", 1)).otherwise(F.col("msg"))
    return found.select("id", msg.alias("msg"), f("burst.count", "burst_count"), f("burst.window", "burst_window"), f("persistence", "persistence"), f("tactic", "tactic"), f("mfa", "mfa"), f("pii", "pii"), f("AuthPackage", "package"), f("src.reputation", "reputation"))
