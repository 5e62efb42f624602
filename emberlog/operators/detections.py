"""The built-in detection catalogue and its evaluation as one job.

Stateless rules are conditions collected into an array column; burst rules mark the event that ends a key's densest
window; follow-up rules join against the addresses that earlier rules found. Attackers accumulate in stages: web bursts
and scanners first, which is what cloud rules see, then failed Windows and SSH logins, which is what network rules see;
port scans come after them. Events without time take no part in bursts.
"""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.network import is_public_ip
from emberlog.functions.severity import sev_name, sev_rank
from emberlog.functions.text import any_of, fmt_bytes, fmt_span, once
from emberlog.operators.bursts import find_bursts
from emberlog.operators.durable import compiled, stored
from emberlog.operators.quantiles import percentile
from emberlog.operators.rules import Rule

# Patterns of the catalogue.
SCANNER_AGENT = r"sqlmap|nikto|nmap|masscan|zgrab|dirbuster|gobuster|wpscan|nuclei|acunetix"
ATTACK_PATH = r"\.\./|/etc/passwd|cmd=|;wget|;curl|\bunion\b.*\bselect\b|<script|\.php\?|/wp-login|/\.env|/\.git/"
SUSPICIOUS_PROCESS = (
    r"powershell.*(-enc|-e |downloadstring|iex|frombase64)|certutil.*(-urlcache|-decode)|mimikatz|procdump|"
    r"whoami|net\s+user\s+\S+\s+/add|net\s+localgroup\s+administrators|wmic.*process\s+call\s+create|"
    r"rundll32.*comsvcs|vssadmin.*delete|bitsadmin|mshta|regsvr32.*/i:http|ntdsutil|reg\s+save\s+hklm\\sam"
)
HISTORY = r"\.bash_history|\.zsh_history|history\s+-c|unset\s+HISTFILE|HISTFILESIZE=0|HISTSIZE=0"
HISTORY_REMOVAL = r"trunc|unlink|remov|rm |history -c|unset"
ROOT_SHELL = r"COMMAND=(?:/usr)?/bin/(?:ba|z|da)?sh\b|COMMAND=/bin/su\b|COMMAND=(?:/usr)?/bin/su\b"
USER_ADDED = r"\b(useradd|adduser)\b.*(new user|name=|:\s+\S+)"
LOGIN_PATH = r"/(login|signin|sign-in|auth|authenticate|session|token|oauth/token)\b"
AUTH_FAILURE = r"(login|auth|authentication|password).*(fail|invalid|denied|rejected)|invalid (credentials|password)|auth(entication)? failure"
ALLOW = ["allow", "accept", "permit", "allowed", "pass"]
DENY = ["deny", "drop", "reject", "block", "denied", "blocked"]

# The catalogue.
RULES = {
    r.id: r
    for r in [
        Rule("SIGMA-WEB-0042", "401 burst from one address", "high", {"statuses": ["401"], "window": 90, "threshold": 50}),
        Rule("SIGMA-WEB-0050", "Scanner user agent", "medium", {"pattern": SCANNER_AGENT}),
        Rule("SIGMA-WEB-0058", "Attack pattern in request path", "medium", {"pattern": ATTACK_PATH}),
        Rule("SIGMA-AUTH-0111", "Success after failure burst", "critical", {"loginPath": LOGIN_PATH, "methods": ["POST"], "successPrefix": "2", "within": 600}),
        Rule("SIGMA-AUTH-0203", "Interactive login by service account", "high", {"prefixes": ["svc_", "svc-", "sa_", "sa-"], "loginPath": LOGIN_PATH}),
        Rule("SIGMA-WEB-0063", "Server error burst", "medium", {"statusPrefix": "5", "window": 60, "threshold": 50}),
        Rule("SIGMA-AWS-0007", "Console login without second factor", "critical", {"eventName": "ConsoleLogin", "mfaValue": "no", "result": "success"}),
        Rule("SIGMA-AWS-0031", "Access key created", "high", {"eventName": "CreateAccessKey"}),
        Rule("SIGMA-AWS-0044", "Audit trail tampering", "high", {"eventNames": ["DeleteTrail", "StopLogging", "UpdateTrail", "DeleteFlowLogs", "PutEventSelectors", "DeleteLogGroup"]}),
        Rule("SIGMA-AWS-0052", "Privileged identity change", "high", {"eventNames": ["CreateUser", "CreateLoginProfile", "PutUserPolicy"], "policyEvent": "AttachUserPolicy", "policyMarker": "AdministratorAccess"}),
        Rule("SIGMA-AWS-0060", "Root identity used", "high", {"identityType": "Root"}),
        Rule("SIGMA-AWS-0071", "Ingress opened to the world", "medium", {"eventName": "AuthorizeSecurityGroupIngress", "cidrs": ["0.0.0.0/0"]}),
        Rule("SIGMA-WIN-0088", "Network logon by NTLM", "medium", {"eventId": "4624", "logonTypes": ["3"], "packages": ["NTLM"]}),
        Rule("SIGMA-WIN-0091", "Sensitive privileges assigned", "high", {"eventId": "4672", "privileges": ["SeDebugPrivilege", "SeBackupPrivilege", "SeTakeOwnershipPrivilege", "SeTcbPrivilege", "SeLoadDriverPrivilege", "SeRestorePrivilege"], "ignoreAccounts": ["system", "local service", "network service", "anonymous logon", "-"]}),
        Rule("SIGMA-WIN-0104", "Audit log cleared", "high", {"eventId": "1102"}),
        Rule("SIGMA-WIN-0120", "Account created", "medium", {"eventId": "4720"}),
        Rule("SIGMA-WIN-0133", "Suspicious process", "high", {"eventId": "4688", "pattern": SUSPICIOUS_PROCESS}),
        Rule("SIGMA-WIN-0150", "Added to privileged group", "high", {"eventIds": ["4728", "4732", "4756"], "groups": ["administrators", "domain admins", "enterprise admins", "schema admins"]}),
        Rule("SIGMA-WIN-0140", "Failed logon burst", "high", {"eventId": "4625", "window": 300, "threshold": 10}),
        Rule("SIGMA-LNX-0012", "Direct root login over SSH", "high", {"program": "sshd", "result": "Accepted", "users": ["root"]}),
        Rule("SIGMA-LNX-0030", "Shell history removed", "high", {"pattern": HISTORY, "removalPattern": HISTORY_REMOVAL, "auditOps": ["truncate", "unlink", "delete", "rename"]}),
        Rule("SIGMA-LNX-0041", "Interactive shell by sudo", "medium", {"program": "sudo", "pattern": ROOT_SHELL}),
        Rule("SIGMA-LNX-0050", "Local user added", "medium", {"programs": ["useradd", "adduser"], "pattern": USER_ADDED}),
        Rule("SIGMA-LNX-0045", "SSH failure burst", "medium", {"program": "sshd", "results": ["Failed", "Invalid"], "window": 300, "threshold": 10}),
        Rule("SIGMA-K8S-0004", "Exec into pod", "high", {"resource": "pods/exec", "verb": "create", "prodKeywords": ["prod", "payments", "prd", "live"]}),
        Rule("SIGMA-K8S-0011", "Secrets enumerated", "medium", {"resource": "secrets", "verbs": ["list", "get"], "ignoreUserPrefix": "system:"}),
        Rule("SIGMA-K8S-0017", "Pod that can reach its node", "high", {"resource": "pods", "verb": "create", "markers": ['"privileged":true', "hostPath"]}),
        Rule("SIGMA-K8S-0025", "Denied requests burst", "medium", {"status": "403", "window": 300, "threshold": 5}),
        Rule("SIGMA-APP-0055", "Bulk export", "critical", {"keywords": ["export", "dump", "download"], "minRows": 10_000}),
        Rule("SIGMA-APP-0061", "Application login failure burst", "medium", {"pattern": AUTH_FAILURE, "window": 300, "threshold": 20}),
        Rule("SIGMA-NET-0019", "Outbound to attacker", "high", {"allowActions": ALLOW}),
        Rule("SIGMA-NET-0022", "Large transfer to public address", "critical", {"allowActions": ALLOW, "minBytes": 104_857_600, "p99Multiplier": 50, "p99MinFlows": 20}),
        Rule("SIGMA-NET-0027", "Denied connections burst", "medium", {"denyActions": DENY, "window": 60, "threshold": 50}),
    ]
}
# The phase of an incident that each rule belongs to (0 recon, 1 access, 2 lateral, 3 egress).
PHASE_OF = {
    "SIGMA-WEB-0042": 0,
    "SIGMA-WEB-0050": 0,
    "SIGMA-WEB-0058": 0,
    "SIGMA-AUTH-0111": 1,
    "SIGMA-AUTH-0203": 1,
    "SIGMA-WEB-0063": 0,
    "SIGMA-AWS-0007": 1,
    "SIGMA-AWS-0031": 1,
    "SIGMA-AWS-0044": 3,
    "SIGMA-AWS-0052": 1,
    "SIGMA-AWS-0060": 1,
    "SIGMA-AWS-0071": 1,
    "SIGMA-WIN-0088": 2,
    "SIGMA-WIN-0091": 2,
    "SIGMA-WIN-0104": 3,
    "SIGMA-WIN-0120": 1,
    "SIGMA-WIN-0133": 2,
    "SIGMA-WIN-0150": 1,
    "SIGMA-WIN-0140": 0,
    "SIGMA-LNX-0012": 2,
    "SIGMA-LNX-0030": 3,
    "SIGMA-LNX-0041": 2,
    "SIGMA-LNX-0050": 1,
    "SIGMA-LNX-0045": 0,
    "SIGMA-K8S-0004": 2,
    "SIGMA-K8S-0011": 2,
    "SIGMA-K8S-0017": 2,
    "SIGMA-K8S-0025": 0,
    "SIGMA-APP-0055": 3,
    "SIGMA-APP-0061": 0,
    "SIGMA-NET-0019": 2,
    "SIGMA-NET-0022": 3,
    "SIGMA-NET-0027": 0,
}
HIT = "struct<id:string,name:string,level:string>"


#: The fields that rules look at; each is taken out of the map once.
FIELDS = [
    "src_ip", "src", "dst", "dst_ip", "http.status", "http.path", "http.method", "user_agent", "eventName", "MFAUsed", "result", "userIdentity.type",
    "EventID", "LogonType", "AuthenticationPackageName", "SubjectUserName", "PrivilegeList", "CommandLine", "NewProcessName", "TargetUserName", "program",
    "op", "resource", "verb", "namespace", "rows", "row_count", "records", "dest", "path", "name", "dst_port", "LmPackageName", "event", "action", "IpAddress", "responseStatus", "bytes", "sourceIPAddress",
]


def prepared(events: DataFrame) -> DataFrame:
    """Events with a column for each field that a rule looks at, empty where it is absent."""
    return compiled(events).withColumns({f"f_{n.replace('.', '_')}": F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in FIELDS})


def _spread_fields(events: DataFrame, where: Column | None = None) -> DataFrame:
    """``prepared`` where all of its columns are needed, and none is filtered by: they are null where ``where`` is not true.

    A map as read from Parquet decodes its keys again at each lookup, and as many lookups as there are fields make one
    method that is hardly compiled. So the few fields are copied first, and the columns are items of one array.
    """
    known = F.map_filter("fields", lambda k, _: k.isin(FIELDS))
    values = once(known, lambda m: F.transform(F.array(*map(F.lit, FIELDS)), lambda n: F.coalesce(F.try_element_at(m, n), F.lit(""))))
    own = compiled(events).withColumn("_values", values if where is None else F.when(where, values))
    return own.withColumns({f"f_{n.replace('.', '_')}": F.get("_values", F.lit(i)) for i, n in enumerate(FIELDS)}).drop("_values")


def _ready(events: DataFrame) -> DataFrame:
    """Prepared events without the map, written once: each rule then reads its own columns, instead of looking fields up in each of a dozen scans."""
    return stored(_spread_fields(events).select("id", "id_seq", "ts", "source", "user", "host", "msg", "raw", *[_f(n) for n in FIELDS]), "prepared")


def _f(name: str) -> Column:
    return F.col(f"f_{name.replace('.', '_')}")


def _is(value: Column, wanted) -> Column:
    wanted = [wanted] if isinstance(wanted, str) else wanted
    return F.lower(value).isin([w.lower() for w in wanted])


def _starts(value: Column, prefixes: list[str]) -> Column:
    return any_of([F.lower(value).startswith(p.lower()) for p in prefixes])


def _holds(value: Column, parts: list[str]) -> Column:
    return any_of([F.lower(value).contains(p.lower()) for p in parts])


def _like(value: Column, pattern: str) -> Column:
    return value.rlike("(?i)" + pattern)


def family(name: str) -> Column:
    plain = {"web": "nginx.access", "win": "windows.evtx", "lnx": "syslog", "k8s": "k8s.audit", "app": "app.jsonl", "ct": "aws.cloudtrail"}
    if name == "net":
        return any_of([F.col("source").startswith(p) for p in ("firewall", "delimited", "netflow", "fw")])
    return F.col("source") == plain[name]


def catalogue(**overrides: dict) -> dict[str, Rule]:
    """The rules with overrides by id (dots and dashes of the id as underscores)."""
    names = {r.replace("-", "_"): r for r in RULES}
    return RULES | {names[k]: RULES[names[k]].override(**v) for k, v in overrides.items()}


def _number(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def exported_rows() -> Column:
    """How many rows an application says it has given out."""
    said = F.coalesce(*[F.when(_f(k) != "", _f(k)) for k in ("rows", "row_count", "records")], F.lit(""))
    return F.coalesce(F.floor(F.regexp_replace(said, "[,_]", "").try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))


def _src() -> Column:
    """A flow's source: ``src``, or ``src_ip`` where a format has no ``src``."""
    return F.coalesce(*[F.when(_f(k) != "", _f(k)) for k in ("src", "src_ip")], F.lit(""))


def _dst() -> Column:
    return F.coalesce(*[F.when(_f(k) != "", _f(k)) for k in ("dst", "dst_ip")], F.lit(""))


def stateless(rules: dict[str, Rule]) -> dict[str, tuple[Column, Column]]:
    """Condition and level of each rule that looks at one event alone."""
    p = {k: r.params for k, r in rules.items()}
    level = {k: F.lit(r.level) for k, r in rules.items()}
    out: dict[str, Column] = {}

    def add(key: str, of: str, condition: Column) -> None:
        out[key] = family(of) & condition

    q = p["SIGMA-WEB-0050"]
    add("SIGMA-WEB-0050", "web", _like(_f("user_agent"), q["pattern"]))
    add("SIGMA-WEB-0058", "web", _like(_f("http.path"), p["SIGMA-WEB-0058"]["pattern"]))
    q = p["SIGMA-AWS-0007"]
    login = family("ct") & _is(_f("eventName"), q["eventName"]) & _is(_f("MFAUsed"), q["mfaValue"]) & _is(_f("result"), q["result"])
    out["SIGMA-AWS-0007"] = login
    a, s = p["SIGMA-AUTH-0111"], p["SIGMA-AUTH-0203"]
    web_login = family("web") & _f("http.status").startswith(a["successPrefix"]) & _like(_f("http.path"), s["loginPath"]) & _is(_f("http.method"), a["methods"])
    out["SIGMA-AUTH-0203"] = (web_login | login) & _starts(F.col("user"), s["prefixes"])
    add("SIGMA-AWS-0044", "ct", _is(_f("eventName"), p["SIGMA-AWS-0044"]["eventNames"]))
    q = p["SIGMA-AWS-0052"]
    add("SIGMA-AWS-0052", "ct", _is(_f("eventName"), q["eventNames"]) | (_is(_f("eventName"), q["policyEvent"]) & F.col("raw").contains(q["policyMarker"])))
    add("SIGMA-AWS-0060", "ct", _f("userIdentity.type") == p["SIGMA-AWS-0060"]["identityType"])
    q = p["SIGMA-AWS-0071"]
    add("SIGMA-AWS-0071", "ct", _is(_f("eventName"), q["eventName"]) & any_of([F.col("raw").contains(c) for c in q["cidrs"]]))
    event = _f("EventID")
    q = p["SIGMA-WIN-0088"]
    add("SIGMA-WIN-0088", "win", (event == q["eventId"]) & _starts(_f("LogonType"), q["logonTypes"]) & _holds(F.concat_ws(" ", _f("AuthenticationPackageName"), _f("LmPackageName")), q["packages"]))
    q = p["SIGMA-WIN-0091"]
    subject = _f("SubjectUserName")
    add("SIGMA-WIN-0091", "win", (event == q["eventId"]) & _holds(_f("PrivilegeList"), q["privileges"]) & ~_is(subject, q["ignoreAccounts"]) & ~subject.endswith("$"))
    for key in ("SIGMA-WIN-0104", "SIGMA-WIN-0120"):
        add(key, "win", event == p[key]["eventId"])
    q = p["SIGMA-WIN-0133"]
    add("SIGMA-WIN-0133", "win", (event == q["eventId"]) & _like(F.concat_ws(" ", _f("CommandLine"), _f("NewProcessName")), q["pattern"]))
    q = p["SIGMA-WIN-0150"]
    add("SIGMA-WIN-0150", "win", event.isin(q["eventIds"]) & _holds(_f("TargetUserName"), q["groups"]))
    q = p["SIGMA-LNX-0012"]
    add("SIGMA-LNX-0012", "lnx", _is(_f("program"), q["program"]) & _is(_f("result"), q["result"]) & _is(F.col("user"), q["users"]))
    q = p["SIGMA-LNX-0030"]
    removed = F.when(_is(_f("program"), ["audit", "auditd"]), _is(_f("op"), q["auditOps"])).otherwise(_like(F.col("raw"), q["removalPattern"]))
    add("SIGMA-LNX-0030", "lnx", _like(F.col("raw"), q["pattern"]) & removed)
    q = p["SIGMA-LNX-0041"]
    add("SIGMA-LNX-0041", "lnx", _is(_f("program"), q["program"]) & _like(F.col("raw"), q["pattern"]))
    q = p["SIGMA-LNX-0050"]
    add("SIGMA-LNX-0050", "lnx", _is(_f("program"), q["programs"]) | _like(F.col("raw"), q["pattern"]))
    q = p["SIGMA-K8S-0004"]
    add("SIGMA-K8S-0004", "k8s", (_f("resource") == q["resource"]) & (_f("verb") == q["verb"]))
    level["SIGMA-K8S-0004"] = F.when(_holds(_f("namespace"), q["prodKeywords"]) | _holds(F.col("host"), q["prodKeywords"]), "critical").otherwise(level["SIGMA-K8S-0004"])
    q = p["SIGMA-K8S-0011"]
    add("SIGMA-K8S-0011", "k8s", (_f("resource") == q["resource"]) & _f("verb").isin(q["verbs"]) & ~F.col("user").startswith(q["ignoreUserPrefix"]))
    q = p["SIGMA-K8S-0017"]
    add("SIGMA-K8S-0017", "k8s", (_f("resource") == q["resource"]) & (_f("verb") == q["verb"]) & any_of([F.regexp_replace("raw", r"\s", "").contains(m.replace(" ", "")) for m in q["markers"]]))
    q = p["SIGMA-APP-0055"]
    rows = exported_rows()
    add("SIGMA-APP-0055", "app", _holds(F.coalesce(F.when(_f("event") != "", _f("event")), _f("action")), q["keywords"]) & (rows >= q["minRows"]))
    return {k: (c, level[k]) for k, c in out.items()}


def detect_stateless(events: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Events, of a batch or a stream, with the hits of the rules that look at one event alone, and severity raised to the gravest.

    No shuffle and no state; bursts, follow-ups and reputations need ``detect`` over a written table, or
    ``streaming.ingest.burst_alerts``.
    """
    rules = rules or RULES
    marks = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("id"), F.lit(rules[k].name).alias("name"), level.alias("level"))) for k, (c, level) in stateless(rules).items() if rules[k].enabled]
    found = prepared(events).withColumn("_hits", F.array_compact(F.array(*marks)))
    fresh = F.filter("_hits", lambda h: ~F.exists("detections", lambda d: d["id"] == h["id"]))
    gravest = F.aggregate("_hits", F.lit(0), lambda top, h: F.greatest(top, sev_rank(h["level"])))
    out = {"detections": F.concat("detections", fresh), "sev": sev_name(F.greatest(sev_rank(F.col("sev")), gravest))}
    return found.select(*[out[c].alias(c) if c in out else c for c in events.columns])


def burst_rules(rules: dict[str, Rule]) -> dict[str, tuple[Column, Column]]:
    """Condition and key of each burst rule."""
    p = {k: r.params for k, r in rules.items()}
    path = F.when(_f("http.path") == "", "/").otherwise(F.substring(_f("http.path"), 1, 40))
    address = F.coalesce(F.when(_f("IpAddress") != "", _f("IpAddress")), _f("TargetUserName"))
    return {
        "SIGMA-WEB-0042": (family("web") & _f("http.status").isin(p["SIGMA-WEB-0042"]["statuses"]), _f("src_ip")),
        "SIGMA-WEB-0063": (family("web") & _f("http.status").startswith(p["SIGMA-WEB-0063"]["statusPrefix"]), path),
        "SIGMA-WIN-0140": (family("win") & (_f("EventID") == p["SIGMA-WIN-0140"]["eventId"]), address),
        "SIGMA-LNX-0045": (family("lnx") & _is(_f("program"), p["SIGMA-LNX-0045"]["program"]) & _is(_f("result"), p["SIGMA-LNX-0045"]["results"]), _f("src_ip")),
        "SIGMA-K8S-0025": (family("k8s") & (_f("responseStatus") == p["SIGMA-K8S-0025"]["status"]), F.col("user")),
        "SIGMA-APP-0061": (family("app") & _like(F.col("msg"), p["SIGMA-APP-0061"]["pattern"]), F.when(F.col("host") == "", "app").otherwise(F.col("host"))),
        "SIGMA-NET-0027": (family("net") & _is(_f("action"), p["SIGMA-NET-0027"]["denyActions"]), _src()),
    }


def bursts(events: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """All burst hits of prepared events: rule_id, key, id, epoch, count, first_id, first_epoch.

    One job for all rules: an event is listed under each rule that counts it, and seconds are scaled so that every rule's
    window is the same number of units. Rules whose windows have no common multiple of reasonable size go one by one.
    """
    own = {k: v for k, v in burst_rules(rules).items() if rules[k].enabled}
    units = lcm(*[rules[k].params["window"] for k in own], 1)
    if units > 10**9:
        single = [find_bursts(events.where(c), by, rules[k].params["window"], rules[k].params["threshold"]).withColumn("rule_id", F.lit(k)) for k, (c, by) in own.items()]
        return reduce(DataFrame.unionByName, single)
    mark = lambda k, by: F.struct(F.lit(k).alias("rule_id"), by.alias("by"), F.lit(units // rules[k].params["window"]).alias("scale"), F.lit(rules[k].params["threshold"]).alias("least"))
    marks = F.array_compact(F.array(*[F.when(c & (by != ""), mark(k, by)) for k, (c, by) in own.items()]))
    listed = events.where("ts IS NOT NULL").select("id", "id_seq", "ts", F.inline(marks))
    found = find_bursts(listed, F.concat_ws("|", "rule_id", "by"), units, F.col("least"), F.col("scale"))
    return found.withColumn("rule_id", F.substring_index("key", "|", 1)).withColumn("key", F.expr("substring(key, instr(key, '|') + 1)"))


def attackers(events: DataFrame, burst_hits: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Addresses with the reason and stage at which they became known; for one address the first reason counts."""
    scanners = events.where(family("web") & _like(_f("user_agent"), rules["SIGMA-WEB-0050"].params["pattern"])).select(_f("src_ip").alias("ip"), F.lit("scanner").alias("reason"), F.lit(2).alias("stage"))
    reasons = {"SIGMA-WEB-0042": ("401 burst", 1), "SIGMA-WIN-0140": ("4625 burst", 3), "SIGMA-LNX-0045": ("ssh brute force", 4), "SIGMA-NET-0027": ("port scan", 5)}
    reason = F.coalesce(*[F.when(F.col("rule_id") == k, F.lit(v[0])) for k, v in reasons.items()])
    stage = F.coalesce(*[F.when(F.col("rule_id") == k, F.lit(v[1])) for k, v in reasons.items()])
    own = burst_hits.where(F.col("rule_id").isin(list(reasons)) & ((F.col("rule_id") == "SIGMA-WEB-0042") | is_public_ip(F.col("key"))))
    every = scanners.unionByName(own.select(F.col("key").alias("ip"), reason.alias("reason"), stage.alias("stage"))).where("ip <> ''")
    return every.groupBy("ip").agg(F.min_by("reason", "stage").alias("reason"), F.min("stage").alias("stage"))


def host_p99(events: DataFrame, least_flows: int) -> DataFrame:
    """99th percentile of flow bytes of the hosts with enough flows."""
    flows = events.where(family("net")).select(_src().alias("src"), _number(_f("bytes")).alias("bytes"))
    found = percentile(flows.select(F.col("src").alias("key"), F.col("bytes").alias("value")), 0.99)
    return found.select(F.col("key").alias("src"), F.col("percentile").alias("p99"), F.col("n").alias("flows")).where(F.col("flows") >= least_flows)


def followed_logins(events: DataFrame, web_bursts: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Successful logins of an address within the time after its burst: an interval join, by address."""
    a = rules["SIGMA-AUTH-0111"].params
    tries = events.where(family("web") & _f("http.status").startswith(a["successPrefix"]) & _like(_f("http.path"), a["loginPath"]) & _is(_f("http.method"), a["methods"])).select("id", _f("src_ip").alias("ip"), F.unix_timestamp("ts").alias("at"))
    anchors = web_bursts.select(F.col("key").alias("ip"), "epoch")
    return tries.join(anchors, "ip").where(F.col("at").between(F.col("epoch"), F.col("epoch") + a["within"])).select("id")


def evaluate(events: DataFrame, rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """Hits of prepared events (see ``hits``), and the addresses that became known as attackers."""
    alone = stateless(rules)
    marks = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("rule_id"), level.alias("level"))) for k, (c, level) in alone.items() if rules[k].enabled]))
    columns = {"burst_count": "bigint", "burst_first_id": "string", "burst_span": "bigint", "burst_key": "string", "note": "string"}

    def hit(df: DataFrame, rule_id, level, **told) -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select("id", as_column(rule_id).alias("rule_id"), as_column(level).alias("level"), *[as_column(told.get(c)).cast(kind).alias(c) for c, kind in columns.items()])

    single = hit(events.select("id", F.inline(marks)), F.col("rule_id"), F.col("level"))
    # Bursts feed four later steps; written once, they are not computed again for each.
    burst_hits = stored(bursts(events, rules), "bursts")
    level_of = F.coalesce(*[F.when(F.col("rule_id") == k, F.lit(rules[k].level)) for k in burst_rules(rules)])
    span = F.col("epoch") - F.col("first_epoch")
    ended = hit(burst_hits, F.col("rule_id"), level_of, burst_count=F.col("count"), burst_first_id=F.col("first_id"), burst_span=span, burst_key=F.col("key"), note=F.concat(F.col("count"), F.lit(" events within "), fmt_span(span)))
    found = attackers(events, burst_hits, rules)
    web, net = found.where("stage <= 2"), found.where("stage <= 4")
    out = [single, ended]
    level = lambda key: rules[key].level
    if rules["SIGMA-AUTH-0111"].enabled:
        after = followed_logins(events, burst_hits.where("rule_id = 'SIGMA-WEB-0042'"), rules)
        out.append(hit(after.distinct(), "SIGMA-AUTH-0111", level("SIGMA-AUTH-0111")))
    if rules["SIGMA-AWS-0031"].enabled:
        made = events.where(family("ct") & _is(_f("eventName"), rules["SIGMA-AWS-0031"].params["eventName"]) & _is(_f("result"), "success")).select("id", F.coalesce(F.when(_f("sourceIPAddress") != "", _f("sourceIPAddress")), _f("src_ip")).alias("ip"))
        grave = made.join(web, "ip", "left")
        out.append(hit(grave, "SIGMA-AWS-0031", F.when(is_public_ip(F.col("ip")) | F.col("reason").isNotNull(), "critical").otherwise(level("SIGMA-AWS-0031")), note=F.col("reason")))
    flows = events.where(family("net"))
    if rules["SIGMA-NET-0019"].enabled:
        p = rules["SIGMA-NET-0019"].params
        reached = flows.where(_is(_f("action"), p["allowActions"])).select("id", _dst().alias("ip")).join(net, "ip")
        out.append(hit(reached, "SIGMA-NET-0019", level("SIGMA-NET-0019"), note=F.col("reason")))
    if rules["SIGMA-NET-0022"].enabled:
        p = rules["SIGMA-NET-0022"].params
        sent = flows.where(_is(_f("action"), p["allowActions"]) & is_public_ip(_dst())).select("id", _src().alias("src"), _number(_f("bytes")).alias("bytes"))
        judged = sent.join(host_p99(events, p["p99MinFlows"]), "src", "left")
        # A host's baseline can only lower nothing: the floor holds for every flow, the multiple only where it is higher.
        large = judged.where(F.col("bytes") >= F.greatest(F.lit(float(p["minBytes"])), F.coalesce(F.col("p99") * p["p99Multiplier"], F.lit(0.0))))
        out.append(hit(large, "SIGMA-NET-0022", level("SIGMA-NET-0022"), note=fmt_bytes(F.col("bytes"))))
    every = reduce(DataFrame.unionByName, out)
    names = F.create_map(*[F.lit(x) for k, r in rules.items() for x in (k, r.name)])
    return every.withColumn("name", F.try_element_at(names, F.col("rule_id"))), found


def hits(events: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The long table of hits: id (event), rule_id, name, level, burst_count, burst_first_id, burst_span, burst_key, note."""
    return evaluate(_ready(events), rules or RULES)[0]


def known_sources(events: DataFrame, found: DataFrame) -> DataFrame:
    """(id, reason) of cloud calls from addresses that web rules found."""
    calls = events.where(family("ct")).select("id", _f("sourceIPAddress").alias("ip"))
    return calls.join(found.where("stage <= 2").select("ip", "reason"), "ip").select("id", "reason")


def _effects(rules: dict[str, Rule]) -> tuple[Column, dict[str, Column], dict[str, Column]]:
    """What hits change on an event: its message, fields that are set, and fields that are set where they are absent.

    ``_rules`` has the event's rule ids, ``_web`` its burst of failed requests, ``_burst`` any burst's count, ``_dst`` and
    ``_src`` what its ends are known for. Null means no change.
    """
    has = lambda key: F.array_contains("_rules", key)
    given = lambda name, other: F.when(_f(name) != "", _f(name)).otherwise(other)
    history = F.coalesce(F.when(_f("path") != "", _f("path")), F.when(_f("name") != "", _f("name")), F.col("msg"))
    sent = fmt_bytes(_number(_f("bytes")))
    to = F.concat(_dst(), F.when(_f("dst_port") != "", F.concat(F.lit(":"), _f("dst_port"))).otherwise(""))
    where_to = F.coalesce(F.when(_f("dest") != "", _f("dest")), F.when(_f("path") != "", _f("path")))
    # The wording of rewritten messages and the names and values of the fields.
    msg = (
        F.when(has("SIGMA-WEB-0042"), F.concat_ws(" ", given("http.method", F.lit("-")), _f("http.path"), F.lit("401 —"), F.col("_web.burst_count"), F.lit("attempts in"), F.concat(F.greatest(F.lit(1), "_web.burst_span"), F.lit("s from")), F.col("_web.burst_key")))
        .when(has("SIGMA-AUTH-0111"), F.concat_ws(" ", given("http.method", F.lit("POST")), _f("http.path"), _f("http.status"), F.lit("— first success from"), _f("src_ip")))
        .when(has("SIGMA-LNX-0030") & ~F.col("msg").startswith("shell history"), F.concat(F.lit("shell history file truncated — "), history))
        .when(has("SIGMA-APP-0055"), F.concat(F.lit("bulk export completed — "), F.format_number(exported_rows(), 0), F.lit(" customer records"), F.coalesce(F.concat(F.lit(" to "), where_to), F.lit(""))))
        .when(has("SIGMA-NET-0022"), F.concat(given("action", F.lit("ALLOW")), F.lit(" "), _src(), F.lit(" → "), to, F.lit(" — "), sent))
    )
    sets = {
        "burst.count": F.col("_burst").cast("string"),
        "burst.window": F.when(has("SIGMA-WEB-0042"), f"{rules['SIGMA-WEB-0042'].params['window']}s"),
        "persistence": F.when(has("SIGMA-AWS-0031"), "yes"),
        "tactic": F.when(has("SIGMA-AWS-0044") | has("SIGMA-LNX-0030"), "defense evasion"),
        "AuthPackage": F.when(has("SIGMA-WIN-0088"), "NTLM"),
        "dst.reputation": F.col("_dst"),
        "bytes_human": F.when(has("SIGMA-NET-0022"), sent),
    }
    defaults = {
        "mfa": F.when(has("SIGMA-AUTH-0111"), "not_presented"),
        "pii": F.when(has("SIGMA-APP-0055"), "yes"),
        "direction": F.when(has("SIGMA-NET-0019") | has("SIGMA-NET-0022"), "outbound"),
        "src.reputation": F.col("_src"),
    }
    return msg, sets, defaults


def detect(events: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Events with the rules' hits attached, each rule once, severity raised to the gravest hit's, messages and fields as the hits tell."""
    rules, ready = rules or RULES, _ready(events)
    own, found = evaluate(ready, rules)
    one = F.struct("rule_id", "name", "level")
    only = lambda key, column: F.max(F.when(F.col("rule_id") == key, column))
    per_event = own.repartition("id").dropDuplicates(["id", "rule_id"]).groupBy("id").agg(
        F.sort_array(F.collect_list(one)).alias("_hits"), F.max(sev_rank(F.col("level"))).alias("_rank"), F.max("burst_count").alias("_burst"),
        only("SIGMA-WEB-0042", F.struct("burst_count", "burst_span", "burst_key")).alias("_web"), only("SIGMA-NET-0019", F.col("note")).alias("_dst"),
    )
    told = per_event.join(known_sources(ready, found).withColumnRenamed("reason", "_src"), "id", "full").withColumn("_rules", F.transform(F.coalesce("_hits", F.array().cast("array<struct<rule_id:string,name:string,level:string>>")), lambda h: h["rule_id"]))
    hit = F.col("_rules").isNotNull()
    joined = _spread_fields(events.join(told, "id", "left"), hit)
    added = F.transform(F.coalesce("_hits", F.array().cast("array<struct<rule_id:string,name:string,level:string>>")), lambda h: F.struct(h["rule_id"].alias("id"), h["name"].alias("name"), h["level"].alias("level")))
    kept = F.filter("detections", lambda d: ~F.exists(added, lambda a: a["id"] == d["id"]))
    raised = sev_name(F.greatest(sev_rank(F.col("sev")), F.coalesce("_rank", F.lit(0))))
    msg, sets, defaults = _effects(rules)
    entries = lambda named: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named.items()]), lambda e: e["value"].isNotNull()))
    changed = joined.withColumn("_set", F.when(hit, entries(sets))).withColumn("_default", F.when(hit, entries(defaults)))
    left = F.map_filter("fields", lambda k, _: ~F.map_contains_key("_set", k))
    fresh = F.map_filter("_default", lambda k, _: ~F.map_contains_key("fields", k))
    fields = F.when(F.col("_rules").isNull(), F.col("fields")).otherwise(F.map_concat(left, F.col("_set"), fresh))
    out = {"detections": F.concat(kept, added), "sev": raised, "fields": fields, "msg": F.coalesce(msg, F.col("msg"))}
    return changed.select(*[out[c].alias(c) if c in out else c for c in events.columns])


def anomalies(detected: DataFrame, samples: int = 5) -> DataFrame:
    """Hits by rule: count, range, sources, first samples; gravest and commonest first."""
    long = detected.select("id", "id_seq", "ts", "source", F.explode("detections").alias("d"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("ts", "id_seq", "id"))), 1, samples)
    ranked = long.groupBy(F.col("d.id").alias("rule_id"), F.col("d.name").alias("name")).agg(
        F.max(sev_rank(F.col("d.level"))).alias("rank"), F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_set("source")).alias("sources")
    )
    row = F.row_number().over(W.partitionBy("d.id").orderBy(F.col("ts").asc_nulls_last(), "id_seq"))
    few = long.withColumn("row", row).where(F.col("row") <= samples)
    shown = few.groupBy(F.col("d.id").alias("rule_id")).agg(first.alias("f")).select("rule_id", F.transform("f", lambda x: x["id"]).alias("samples"))
    return ranked.join(shown, "rule_id").withColumn("level", sev_name(F.col("rank"))).orderBy(F.desc("rank"), F.desc("hits"), "rule_id").drop("rank")
