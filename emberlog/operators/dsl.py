r"""The search language, compiled to column expressions over the event table.

``free text``, ``field:value``, quoted phrases, ``AND``, ``OR``, ``NOT`` (or a leading minus), brackets; ``*`` in a
field's value is a wildcard; a backslash makes the next character literal. Everything is case-insensitive. An empty
query, and one whose brackets do not close where they should, matches everything. A missing field matches nothing, so
its negation matches: every predicate is made two-valued before it is negated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import all_of, any_of
from emberlog.schema import SEVERITIES

# Other names of fields, and where some fields are looked up besides.
ALIASES = {
    "severity": "sev", "level": "sev", "src": "source", "parser": "source", "hostname": "host", "username": "user",
    "message": "msg", "text": "msg", "ip": "_ip", "entity": "_entity",
}
HOST_KEYS = ["host", "Computer"]
USER_KEYS = ["user", "user.name", "TargetUserName", "SubjectUserName", "actor", "userIdentity.userName"]
IP_KEYS = ["src_ip", "src", "dst", "sourceIPAddress", "IpAddress"]

_LEX = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<field>[\w.\-]+):"(?P<value>(?:[^"\\]|\\.)*)"|"(?P<phrase>(?:[^"\\]|\\.)*)"|(?P<word>(?:\\.|[^\s()])+))', re.S)


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def lex(query: str) -> list:
    """Terms, and the marks ``(``, ``)``, ``AND``, ``OR`` and ``NOT``."""
    out: list = []
    for m in _LEX.finditer(query.strip()):
        if m["open"] or m["close"]:
            out.append(m[0].strip())
        elif m["field"] is not None:
            out.append(Term(unescape(m["value"]), m["field"]))
        elif m["phrase"] is not None:
            out.append(Term(unescape(m["phrase"])))
        else:
            word = m["word"]
            if word.upper() in ("AND", "OR", "NOT"):
                out.append(word.upper())
                continue
            if word.startswith("-") and len(word) > 1:
                out.append("NOT")
                word = word[1:]
            named = re.match(r"((?:\\.|[^\\:])+):(.+)$", word, re.S)
            out.append(Term(unescape(named[2]).strip('"'), unescape(named[1])) if named else Term(unescape(word)))
    return out


def parse(query: str):
    """A nested tuple tree: ("or", ...), ("and", ...), ("not", x), a Term, or None for everything."""
    marks = lex(query or "")
    at = 0

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(marks) and marks[at] == "OR":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def sequence():
        nonlocal at
        parts = []
        while at < len(marks) and marks[at] not in ("OR", ")"):
            if marks[at] == "AND":
                at += 1
                continue
            parts.append(single())
        return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)

    def single():
        nonlocal at
        mark = marks[at]
        at += 1
        if mark == "NOT":
            return ("not", single()) if at < len(marks) and marks[at] not in (")", "OR", "AND") else None
        if mark == "(":
            inside = alternatives()
            if at < len(marks) and marks[at] == ")":
                at += 1
            return inside
        return mark

    tree = alternatives() if marks else None
    return None if at < len(marks) else tree


def _has(column: Column, needle: str) -> Column:
    return F.lower(column).contains(needle)


def free_text(needle: str) -> Column:
    """Substring of any text of the event, its entities, detections, field names or values."""
    needle = needle.lower()
    plain = [_has(F.col(c), needle) for c in ("msg", "raw", "host", "user", "source", "file", "id")]
    nested = [
        F.exists("entities", lambda x: _has(x, needle)),
        F.exists("detections", lambda d: _has(d["id"], needle) | _has(d["name"], needle)),
        F.exists(F.map_entries("fields"), lambda e: _has(e["key"], needle) | _has(e["value"], needle)),
    ]
    return F.coalesce(any_of([F.coalesce(p, F.lit(False)) for p in plain + nested]), F.lit(False))


def field_value(name: str) -> Column:
    """A dynamic field: by exact name, else by the first name that is equal apart from case; null if there is none."""
    exact = F.try_element_at("fields", F.lit(name))
    like = F.get(F.map_values(F.map_filter("fields", lambda k, _: F.lower(k) == name.lower())), F.lit(0))
    return F.coalesce(exact, like)


def _matcher(value: str, field: str):
    value = value.lower()
    if "*" in value:
        pattern = "(?s)^" + ".*".join(re.escape(p) for p in value.split("*")) + "$"
        return lambda c: F.coalesce(F.lower(c).rlike(pattern), F.lit(False))
    if len(value) >= 3 and field not in ("sev", "id"):
        return lambda c: F.coalesce(_has(c, value), F.lit(False))  # equality is a substring match as well
    return lambda c: F.coalesce(F.lower(c) == value, F.lit(False))


def _keys(names: list[str]) -> list[Column]:
    return [F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")) for k in names]


def field_match(field: str, value: str) -> Column:
    field = ALIASES.get(field.lower(), field)
    name, match, low = field.lower(), _matcher(value, field.lower()), value.lower()
    if name == "sev":
        wanted = [s for s in low.split(",") if s in SEVERITIES]
        return F.coalesce(F.col("sev").isin(wanted), F.lit(False)) if wanted else F.lit(False)
    if name == "source":
        return any_of([match(F.col(c)) for c in ("source", "file", "source_id")])
    if name == "host":
        return any_of([match(c) for c in (F.col("host"), *_keys(HOST_KEYS))])
    if name == "user":
        return any_of([match(c) for c in (F.col("user"), *_keys(USER_KEYS))])
    if name == "file":
        return match(F.col("file"))
    if name == "id":
        return F.coalesce(F.lower("id") == low, F.lit(False))
    if name in ("msg", "raw"):
        return F.coalesce(_has(F.col(name), low), F.lit(False))
    if name == "_ip":
        return F.coalesce(F.exists("entities", match), F.lit(False)) | any_of([match(c) for c in _keys(IP_KEYS)])
    if name == "_entity":
        exact = match if "*" in low else lambda x: F.lower(x) == low
        return F.coalesce(F.exists("entities", exact), F.lit(False))
    if name in ("detection", "rule", "sigma"):
        return F.coalesce(F.exists("detections", lambda d: match(d["id"]) | match(d["name"])), F.lit(False))
    if name == "ts":
        return F.coalesce(F.lower(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).startswith(low), F.lit(False))
    return match(field_value(field))


def to_column(query: str) -> Column:
    """The predicate of a query. Catalyst sees plain expressions, so what can reach the scan does."""

    def build(node) -> Column:
        if node is None:
            return F.lit(True)
        if isinstance(node, Term):
            return free_text(node.text) if node.field is None else field_match(node.field, node.text)
        kind, *parts = node
        if kind == "not":
            return ~build(parts[0])
        return (any_of if kind == "or" else all_of)([build(p) for p in parts])

    return build(parse(query))


def node_query(value: str) -> str:
    """The query for exactly the events that carry an entity."""
    escaped = value.replace("\\", "\\\\").replace('"', '\\"')
    return f'entity:"{escaped}"'
