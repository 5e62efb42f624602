"""Line formats: raw landing, access logs, syslog and plain text, parsed by column expressions into the common shape.

Every reader takes a DataFrame of numbered lines (file, id_seq, raw) and returns ``schema.PARSED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.timestamps import anywhere_ts, leading_ts, parse_ts
from emberlog.schema import PARSED

_PAIR = r"([A-Za-z_][\w.\-]*)=(\"[^\"]*\"|'[^']*'|[^\s,;]+)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files with their number."""
    return number_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw")))


def number_lines(own: DataFrame) -> DataFrame:
    """(file, id_seq, raw) of (file, block, raw): numbers follow file order, as a split's place in its file is known.

    Lines are numbered within their split, splits by the sum of those before; no window spans a whole file.
    """
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("mono"))
    inner = own.withColumn("mono", F.monotonically_increasing_id()).withColumn("place", place)
    sizes = inner.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    return inner.join(before, ["file", "block"]).where(F.trim("raw") != "").select("file", (F.col("before") + F.col("place") - 1).alias("id_seq"), "raw")


def pairs(text: Column) -> Column:
    """key=value pairs of a text as a map, the last of equal keys; quotes are taken off."""
    keys = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2)), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    entries = F.arrays_zip(keys.alias("key"), values.alias("value"))
    last = F.filter(entries, lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - i)
    return F.map_from_entries(last)


_CUT = "\x01"


def groups(text: Column, pattern: str, count: int) -> Column:
    """A pattern's groups 1 to ``count`` in a text, by number, from one match; without a match the array is shorter."""
    found = F.regexp_replace(text, rf"(?s)^{'' if pattern.startswith('^') else '.*?'}{pattern.removeprefix('^').removesuffix('$')}{'' if pattern.endswith('$') else '.*'}$", "".join(f"{_CUT}${i}" for i in range(1, count + 1)))
    return F.split(found, _CUT)


def put(fields: Column, **values: Column) -> Column:
    """Adds values (double underscores in names stand for dots) where they are not empty and not there yet."""
    fresh = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k.replace("__", ".")) for k in values]), F.array(*values.values())), lambda k, v: v.isNotNull() & (v != ""))
    kept = F.map_filter(fields, lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_concat(kept, fresh)


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {"ts": F.lit(None).cast("timestamp"), "host": F.lit(""), "user": F.lit(""), "sev": F.lit(None).cast("string"), "msg": F.substring("raw", 1, 200), "fields": F.create_map().cast("map<string,string>")}
    every = empty | columns
    names = [part.split(" ")[0] for part in PARSED.split(", ")]
    return df.select(*[(every[n] if n in every else F.col(n)).alias(n) for n in names])


def raw_events(lines: DataFrame, year: int, latest: str | None = None) -> DataFrame:
    """Phase one of ingest: lines as they are, with a leading time if there is one."""
    return shaped(lines, ts=leading_ts(F.col("raw"), year, latest), sev=F.lit("info"))


# Fixed value: the combined and common access log.
ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([A-Z]+) ([^" ]*)(?: ([^"]*))?" ([0-9]{3}) (\S+)(?: "([^"]*)" "([^"]*)")?(.*)$'


def access_log(lines: DataFrame, year: int = 1970, latest: str | None = None) -> DataFrame:
    """Combined and common access logs, with trailing key=value pairs; other lines are marked as errors."""
    lines = lines.withColumn("g", groups(F.col("raw"), ACCESS, 12))  # one match a line
    g, ok = [F.get("g", F.lit(i)) for i in range(13)], F.size("g") == 13
    dash = lambda c, to="": F.when(c == "-", to).otherwise(c)
    fields = put(pairs(g[12]), src_ip=g[1], http__method=g[5], http__path=g[6], http__proto=g[7], http__status=g[8], bytes=dash(g[9], "0"), referer=dash(g[10]), user_agent=dash(g[11]), user__name=dash(g[3]))
    wrong = F.create_map(F.lit("parse_error"), F.lit("unmatched"))
    return shaped(
        lines,
        ts=F.when(ok, parse_ts(g[4], year, latest)).otherwise(leading_ts(F.col("raw"), year, latest)),
        user=F.when(ok, dash(g[3])).otherwise(""),
        msg=F.when(ok, F.concat_ws(" ", g[5], g[6], g[8])).otherwise(F.substring("raw", 1, 200)),
        fields=F.when(ok, fields).otherwise(wrong),
    )


# Syslog forms and the messages that are understood further.
RFC5424 = r"^<([0-9]{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|\[.*?\]) ?(.*)$"
RFC3164 = r"^(?:<([0-9]{1,3})>)?([A-Z][a-z]{2}\s+[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}) (\S+) ([^\s:\[]+)(?:\[([0-9]+)\])?: ?(.*)$"
JOURNAL = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T\S+) (\S+) ([^\s:\[]+)(?:\[([0-9]+)\])?: ?(.*)$"
SSH = r"(Accepted|Failed) (\S+) for (?:invalid user )?(\S+) from (\S+) port ([0-9]+)(?: ssh2)?(?:: \S+ (SHA256:\S+))?"
SSH_INVALID = r"(Invalid) user (\S*) from (\S+)(?: port ([0-9]+))?"
SUDO = r"^\s*(\S+) : .*?USER=(\S+)\s*;\s*COMMAND=(.*)$"
PAM = r"session (opened|closed) for user ([^\s(]+)"
_LEVELS = ["critical", "critical", "critical", "high", "medium", "low", "info", "info"]


def syslog(lines: DataFrame, year: int, latest: str | None = None) -> DataFrame:
    """The newer and the older syslog form and the journal's, tried in this order, and what well-known programs say."""
    # One match for each form that is tried, and one for each program.
    forms = lines.withColumn("new", groups(F.col("raw"), RFC5424, 7))
    forms = forms.withColumn("old", F.when(F.size("new") < 8, groups(F.col("raw"), RFC3164, 6)))
    forms = forms.withColumn("iso", F.when((F.size("new") < 8) & (F.size("old") < 7), groups(F.col("raw"), JOURNAL, 5)))
    new, old, iso = F.size("new") == 8, F.coalesce(F.size("old") == 7, F.lit(False)), F.coalesce(F.size("iso") == 6, F.lit(False))
    pick = lambda a, b, c: F.when(new, F.get("new", F.lit(a)) if a else F.lit("")).when(old, F.get("old", F.lit(b)) if b else F.lit("")).when(iso, F.get("iso", F.lit(c)) if c else F.lit("")).otherwise("")
    cut = forms.select(*lines.columns, pick(1, 1, 0).alias("pri"), pick(2, 2, 1).alias("when"), pick(3, 3, 2).alias("at"), pick(4, 4, 3).alias("program"), pick(5, 5, 4).alias("pid"), pick(7, 6, 5).alias("said"), (new | old | iso).alias("ok"))
    said, none = F.col("said"), F.array().cast("array<string>")
    # Fixed words of a message say which pattern can match it at all.
    cut = cut.withColumns({
        "ssh": F.when(said.contains(" from "), groups(said, SSH, 6)).otherwise(none), "invalid": F.when(said.contains("Invalid user"), groups(said, SSH_INVALID, 4)).otherwise(none),
        "sudo": F.when(F.col("program") == "sudo", groups(said, SUDO, 3)).otherwise(none), "pam": F.when(said.contains("session "), groups(said, PAM, 2)).otherwise(none),
    })
    pri = F.col("pri").try_cast("int")
    names = {SSH: ("ssh", 7), SSH_INVALID: ("invalid", 5), SUDO: ("sudo", 4), PAM: ("pam", 3)}
    m = lambda rx, i: F.get(names[rx][0], F.lit(i))
    is_ssh, invalid, is_sudo, is_pam = (F.size(column) == size for column, size in names.values())
    audit = F.col("program").isin("audit", "auditd") | said.contains("type=")
    dashless = lambda c: F.when(F.col(c) == "-", "").otherwise(F.col(c))
    base = put(F.when(audit, pairs(F.col("said"))).otherwise(F.create_map().cast("map<string,string>")), program=dashless("program"), pid=dashless("pid"), facility=F.floor(pri / 8).cast("string"))
    user = F.when(is_pam, m(PAM, 2)).when(is_ssh, m(SSH, 3)).when(invalid, m(SSH_INVALID, 2)).when(is_sudo, m(SUDO, 1)).otherwise("")
    result = F.when(is_pam, m(PAM, 1)).when(is_ssh, m(SSH, 1)).when(invalid, m(SSH_INVALID, 1)).otherwise("")
    fields = put(
        base, result=result, user=user, method=F.when(is_ssh, m(SSH, 2)), src_ip=F.when(is_ssh, m(SSH, 4)).when(invalid, m(SSH_INVALID, 3)),
        port=F.when(is_ssh, m(SSH, 5)).when(invalid, m(SSH_INVALID, 4)), key__fp=F.when(is_ssh, m(SSH, 6)), command=F.when(is_sudo, m(SUDO, 3)), path=F.when(audit, F.regexp_extract("said", r"\bname=\"?([^\s\"]+)", 1)),
    )
    return shaped(
        cut,
        ts=parse_ts(F.col("when"), year, latest), host=dashless("at"), user=user, sev=F.get(F.array(*map(F.lit, _LEVELS)), pri % 8),
        msg=F.when(F.col("ok"), F.concat_ws(": ", F.col("program"), F.col("said"))).otherwise(F.substring("raw", 1, 200)),
        fields=F.when(F.col("ok"), fields).otherwise(F.create_map(F.lit("parse_error"), F.lit("unmatched"))),
    )


def plain_text(lines: DataFrame, year: int, latest: str | None = None) -> DataFrame:
    """Any text: the first time in it, a level word, and the message without its leading time."""
    level = F.lower(F.regexp_extract("raw", r"(?i)\b(emerg|fatal|critical|crit|alert|panic|error|err|severe|warning|warn|notice|info|debug|trace)\b", 1))
    fields = F.when(level != "", F.create_map(F.lit("level"), level)).otherwise(F.create_map().cast("map<string,string>"))
    msg = F.substring(F.trim(F.regexp_replace("raw", r"^\W*[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.,]+\s*(Z|[+\-][0-9:]+)?\W*", "")), 1, 300)
    return shaped(lines, ts=anywhere_ts(F.substring("raw", 1, 400), year, latest), msg=F.when(msg == "", F.substring("raw", 1, 300)).otherwise(msg), fields=fields)
