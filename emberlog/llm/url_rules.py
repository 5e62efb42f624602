"""URL filters by a sort-merge range join.

A host's canonical key is its labels in reverse order, each followed by a dot: a rule's host and all its subdomains are
the keys with the rule's key as prefix, an interval of the sorted order. The order is cut into ranges at the quantiles
of a sample of the urls (it decides about sizes only); a url goes to its range, a rule to each range that its interval
meets, in one shuffle. A sweep over each range's sorted rows keeps a stack of the rules' hosts whose interval is open.
Such intervals nest, so a url's rules are the stack. Neither rules nor urls pass through the driver.

The deepest fitting host wins, within it the longest fitting path, among equals ``block``. Without a fitting rule the
verdict is the default's. Hot hosts, and even a repeated url, are split over ranges, as path and a hash of the row's
place belong to the sort key.

Nulls and edges. A null url, or one without ``://``, has empty host and path. Page ids may be of any type; null ones and
repeated rows are judged row by row. Without any rule all verdicts are the default's; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import lower_ascii, map_arrow, table

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (action, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """The stack of open hosts: (key, {path: (action, rule)}, lengths of those paths)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []

    def to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, path: str, action: str, rule: str) -> None:
        self.to(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, set()))
        _, paths, lengths = self.stack[-1]
        if paths.get(path, ("",))[0] != "block":
            paths[path] = (action, rule)
        lengths.add(len(path))

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        self.to(key)
        for _, paths, lengths in reversed(self.stack):
            for n in sorted(lengths, reverse=True):
                if n <= len(path) and (found := paths.get(path[:n])):
                    return found
        return None


def boundaries(keys: DataFrame, ranges: int, sampled: int = 50) -> list[tuple]:
    """At most ``ranges`` - 1 cuts of ``keys`` (key, path, salt) into ranges of about equal size, from ``sampled`` rows for each."""
    total = keys.count()
    own = keys if total <= ranges * sampled else keys.sample(ranges * sampled / total, 1)
    drawn = sorted(map(tuple, own.limit(2 * ranges * sampled).collect()))
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row; rules have action, host and path."""
    rule = rules.where(F.col("host").isNotNull()).select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    rule = rule.select(host_key(F.col("host")).alias("key"), "path", "host", "action")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.select(host_key(F.col("host")).alias("key"), "path", F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "page_id", "host")
    cuts = boundaries(urls.select("key", "path", "salt"), 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    id_type = pages.schema["page_id"].dataType.simpleString()
    names = ["part", "key", "kind", "path", "salt", "page_id", "host", "action"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, path, salt, page_id, host = batch.columns
            part = [bisect_right(cuts, row) for row in zip(key.to_pylist(), path.to_pylist(), salt.to_pylist(), strict=True)]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), key, pa.array([1] * n, pa.int32()), path, salt, page_id, host, pa.nulls(n, pa.string())], names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, path, host, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Keys with this one as prefix end before the key whose last dot is replaced by the next character.
                part = range(bisect_right(cuts, (key, "", -(1 << 63))), bisect_left(cuts, (key[:-1] + "/", "", -(1 << 63))) + 1)
                n = len(part)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(part, pa.int32()), "key": [key] * n, "kind": pa.array([0] * n, pa.int32()), "path": [path] * n, "salt": pa.array([0] * n, pa.int64()), "host": [host] * n, "action": [action] * n}
                )

    dealt = "part int, key string, kind int, path string, salt long, page_id {}, host string, action string"
    spread_rules = map_arrow(rule, spread, "part int, key string, kind int, path string, salt long, host string, action string").withColumn("page_id", F.lit(None).cast(id_type))
    both = map_arrow(urls, placed, dealt.format(id_type)).unionByName(spread_rules)
    swept = both.repartition("part").sortWithinPartitions("part", "key", "kind", "path", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now = Sweep(), None
        for batch in batches:
            own, rows = [], []
            for i, (part, key, kind, path, host, action) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
                if part != now:
                    sweep, now = Sweep(), part
                if kind:
                    found = sweep.best(key, path)
                    own.append(i)
                    rows.append((host, path, found[1] if found else None, found[0] if found else default))
                else:
                    sweep.add(key, path, action, host + path)
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(6).take(pa.array(own, pa.int64())), *[pa.array(list(c), pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    return map_arrow(swept.select("part", "key", "kind", "path", "host", "action", "page_id"), run, f"page_id {id_type}, host string, path string, rule string, verdict string")


def op7_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "action string, host string, path string"))


#: The same verdicts by plain string comparison; rules of one host are told apart by their path's length.
OP7_SQL = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
fits AS (SELECT n, max_by(struct_pack(a := r.action, t := r.host || r.path), length(r.host) * 1000 + length(r.path)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, best.t AS rule, coalesce(best.a, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""
