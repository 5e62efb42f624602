"""Delimited formats: finding the delimiter and the columns' roles, tables with and without header."""

from __future__ import annotations

import csv
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.network import IPV4
from emberlog.functions.timestamps import EPOCH, ISO, parse_ts
from emberlog.sources.lines import shaped

DELIMITERS = [",", "\t", ";", "|"]
SAMPLE_LINES = 200
# Names of columns by role, and words in action and protocol columns.
ROLES = {
    "ts": ["timestamp", "ts", "time", "datetime", "date", "event_time", "eventtime", "@timestamp", "start_time"],
    "host": ["host", "hostname", "computer", "device", "machine", "server"],
    "user": ["user", "username", "account", "login", "actor"],
    "msg": ["message", "msg", "description", "event", "text", "details"],
    "sev": ["level", "severity", "priority"],
}
ACTIONS = ["allow", "accept", "permit", "allowed", "pass", "deny", "drop", "reject", "block", "denied", "blocked"]
PROTOCOLS = ["tcp", "udp", "icmp", "http", "https", "dns", "ssh", "tls"]
DENY = ACTIONS[5:]


def sampled(lines: DataFrame, per_file: int = SAMPLE_LINES) -> DataFrame:
    """The first lines of each file: line numbers are known, so no ranking is needed."""
    return lines.where(F.col("id_seq") < per_file)


def delimiter_guess(lines: DataFrame) -> DataFrame:
    """(file, delimiter, columns, score): how often the commonest count of a delimiter occurs in all lines, weighted by that count.

    Guesses are ordered by the score in whole numbers (times ten, and the file's lines), where equal scores are equal.
    """
    total = lines.groupBy("file").agg(F.count("*").alias("n"))
    counts = F.array(*[F.struct(F.lit(d).alias("delimiter"), (F.length("raw") - F.length(F.replace(F.col("raw"), F.lit(d), F.lit("")))).alias("k")) for d in DELIMITERS])
    freq = lines.select("file", F.inline(counts)).where("k >= 2").groupBy("file", "delimiter", "k").agg(F.count("*").alias("f"))
    scored = freq.join(total, "file").withColumn("score", F.col("f") / F.col("n") * (1 + F.least(F.col("k"), F.lit(8)) / 10))
    whole = (F.col("f") * (10 + F.least(F.col("k"), F.lit(8)))).alias("whole")
    best = scored.groupBy("file").agg(F.max_by(F.struct("delimiter", (F.col("k") + 1).alias("columns"), "score"), F.struct(whole, "k", "delimiter")).alias("b"))
    return best.select("file", "b.*")


def role_statistics(cells: DataFrame) -> DataFrame:
    """Shares of values that look like a time, action, protocol, address, key=value pair, number or host, by file and column.

    ``cells`` has file, pos and value. One aggregate; its result has a row a column.
    """
    v, low = F.col("value"), F.lower(F.trim("value"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return cells.groupBy("file", "pos").agg(
        share(v.rlike("^" + ISO) | v.rlike(EPOCH)).alias("ts"), share(low.isin(ACTIONS)).alias("action"), share(low.isin(PROTOCOLS)).alias("proto"),
        share(v.rlike(rf"^{IPV4}(:[0-9]+)?$")).alias("ip"), share(v.rlike(r"^[A-Za-z_][\w.\-]*=")).alias("kv"), share(v.rlike(r"^[0-9]+$")).alias("num"),
        share(v.rlike(r"^[A-Za-z][A-Za-z0-9\-]*[0-9-][A-Za-z0-9.\-]*$")).alias("host"),
    )


def guess_roles(statistics: list) -> dict[int, str]:
    """Column names out of one file's statistics, from left to right, each role once (addresses: source, then target)."""
    names: dict[int, str] = {}
    for row in sorted(statistics, key=lambda r: r["pos"]):
        taken = set(names.values())
        tests = [("ts", row["ts"] > 0.8), ("action", row["action"] > 0.6), ("proto", row["proto"] > 0.6), ("src", row["ip"] > 0.7), ("dst", row["ip"] > 0.7), ("", row["kv"] > 0.7), ("bytes", row["num"] > 0.8), ("host", row["host"] > 0.8)]
        for name, fits in tests:
            if fits and name not in taken:
                if name:
                    names[row["pos"]] = name
                break
        else:
            names[row["pos"]] = f"col{row['pos']}"
    return names


def headerless(lines: DataFrame, delimiter: str, names: dict[int, str], year: int = 1970, latest: str | None = None) -> DataFrame:
    """Delimited lines without header as flow records: named cells, key=value cells, addresses parted from ports."""
    own = lines.withColumn("cells", F.split("raw", re.escape(delimiter)))
    cell = lambda i: F.trim(F.get("cells", F.lit(i)))
    rx = r"^([A-Za-z_][\w.\-]*)=(.*)$"
    entries = F.transform("cells", lambda c, i: F.when(c.rlike(rx), F.struct(F.regexp_extract(c, rx, 1).alias("key"), F.regexp_extract(c, rx, 2).alias("value"))).otherwise(F.struct(F.coalesce(*[F.when(i == k, F.lit(n)) for k, n in names.items()], F.concat(F.lit("col"), i)).alias("key"), F.trim(c).alias("value"))))
    ends = {n: i for i, n in names.items() if n in ("src", "dst")}
    with_ports = lambda e: F.flatten(F.transform(e, lambda x: F.when(x["key"].isin("src", "dst") & x["value"].rlike(r"^[0-9.]+:[0-9]+$"), F.array(F.struct(x["key"].alias("key"), F.substring_index(x["value"], ":", 1).alias("value")), F.struct(F.concat(x["key"], F.lit("_port")).alias("key"), F.substring_index(x["value"], ":", -1).alias("value")))).otherwise(F.array(x))))
    listed = with_ports(entries)
    once = F.filter(listed, lambda x, i: (x["value"] != "") & (F.array_position(F.transform(listed, lambda y: y["key"]), x["key"]) == i + 1))
    place = {n: i for i, n in names.items()}
    get = lambda n: cell(place[n]) if n in place else F.lit("")
    action = F.lower(get("action"))
    msg = F.concat_ws(" ", F.when(action != "", F.upper(action)), *[get(n) for n in ("proto",) if n in place], *[get(n) for n in ends]) if ends else F.substring("raw", 1, 200)
    return shaped(own, ts=parse_ts(get("ts"), year, latest), host=get("host"), msg=msg, sev=F.when(action.isin(DENY), "low"), fields=F.map_from_entries(once))


def role_names(columns: list[str]) -> dict[str, str]:
    """Which column has which role, by name: an exact match first, then one that starts or ends with the role's name."""
    plain = {c: re.sub(r"[^a-z0-9@]+", "_", c.strip().lower()).strip("_") for c in columns}
    found: dict[str, str] = {}
    for role, names in ROLES.items():
        exact = [c for n in names for c in columns if plain[c] == n]
        part = [c for n in names for c in columns if plain[c].endswith("_" + n) or plain[c].startswith(n + "_")]
        for c in exact + part:
            if c not in found.values():
                found[role] = c
                break
    return found


def rename_fields(names: list[str], known: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """User-given column names: normalised, through aliases, and snapped to a known name equal apart from case and marks."""
    plain = lambda x: re.sub(r"[^a-z0-9]+", "", x.lower())
    by_plain = {plain(k): k for k in reversed(known)}
    out = [(aliases or {}).get(n.strip().lower(), n.strip()) for n in names]
    return [by_plain.get(plain(n), re.sub(r"\s+", "_", n)) for n in out]


def header_delimiter(spark: SparkSession, path: str, sampled_lines: int = SAMPLE_LINES) -> str:
    """The delimiter under which the first lines fall into most cells a row, most of the rows being of one width."""
    head = [row["value"] for row in spark.read.text(path).limit(sampled_lines).collect()]

    def fit(delimiter: str) -> tuple[float, int]:
        widths = Counter(len(row) for row in csv.reader(head, delimiter=delimiter) if row)
        width, rows = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        return (rows / widths.total() if width > 1 else 0.0, width)

    return max(DELIMITERS, key=fit)


def looks_like_header(names: list[str]) -> bool:
    """Whether cells can be column names: filled, all different, none a number, a time or an address."""
    plain = [n.strip() for n in names]
    value = re.compile(rf"[0-9.,:/\-+TZ ]+|{IPV4}")
    return len(plain) > 1 and all(plain) and len(set(plain)) == len(plain) and not any(value.fullmatch(n) for n in plain)


def with_header(spark: SparkSession, path: str, delimiter: str | None = ",", year: int = 1970, latest: str | None = None) -> DataFrame:
    """Tables with a header; quoted cells may hold line ends. Without a delimiter it is found out.

    A first line that cannot be one of names is data: its columns are called col0, col1 and so on.
    """
    delimiter = delimiter or header_delimiter(spark, path)
    df = spark.read.csv(path, sep=delimiter, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    if not looks_like_header(df.columns):
        df = spark.read.csv(path, sep=delimiter, header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
        df = df.withColumnsRenamed({c: f"col{i}" for i, c in enumerate(df.columns)})
    roles, names = role_names(df.columns), df.columns
    col = lambda role: F.coalesce(F.trim(F.col(f"`{roles[role]}`")), F.lit("")) if role in roles else F.lit("")
    own = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_seq"), F.concat_ws(delimiter, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]).alias("_raw"))
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.trim(F.col(f"`{c}`")) for c in names])), lambda _, v: v.isNotNull() & (v != ""))
    looks: Column = F.coalesce(*[F.when(F.length(F.col(f"`{c}`")) < 40, parse_ts(F.col(f"`{c}`"), year, latest)) for c in names])
    ts = parse_ts(col("ts"), year, latest) if "ts" in roles else looks
    return shaped(own.withColumnsRenamed({"_file": "file", "_seq": "id_seq", "_raw": "raw"}), ts=ts, host=col("host"), user=col("user"), msg=F.when(col("msg") != "", col("msg")).otherwise(F.substring("raw", 1, 200)), sev=F.when(col("sev") != "", col("sev")), fields=fields)
