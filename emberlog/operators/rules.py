"""User rules: typed conditions, regexes and thresholds, validated and compiled to column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import all_of, any_of
from emberlog.operators.bursts import find_bursts
from emberlog.operators.dsl import ALIASES, IP_KEYS, field_value

OPERATORS = {
    "equals": "equals", "not_equals": "does not equal", "contains": "contains", "not_contains": "does not contain",
    "starts_with": "starts with", "ends_with": "ends with", "regex": "matches the regex", "in": "is one of",
    "not_in": "is none of", "gt": "is greater than", "lt": "is less than", "exists": "is present",
}
NEGATIVE = {"not_equals", "not_contains", "not_in"}
MOST_CONDITIONS, LONGEST_WINDOW = 20, 7 * 86_400


class RuleError(ValueError):
    """A rule that cannot be saved."""


def condition_values(name: str) -> Column:
    """Every non-empty text that a condition on a field is compared with."""
    plain = ALIASES.get(name.strip().lower(), name.strip())
    low = plain.lower()
    if low in ("msg", "raw", "host", "user", "source", "file", "id", "sev"):
        values = F.array(F.col(low))
    elif low == "ts":
        values = F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    elif low in ("detection", "rule", "sigma"):
        values = F.flatten(F.transform("detections", lambda d: F.array(d["id"], d["name"])))
    elif low in ("_entity", "entities"):
        values = F.col("entities")
    elif low == "_ip":
        values = F.concat("entities", F.array(*[F.try_element_at("fields", F.lit(k)) for k in IP_KEYS]))
    else:
        values = F.array(field_value(plain))
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def _number(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "[,_]", "").try_cast("double")


def condition(name: str, op: str, value: str = "") -> Column:
    """One condition; any value may satisfy a positive operator, all must a negative one, which holds for no value at all."""
    if op not in OPERATORS:
        raise RuleError(f"unknown operator {op!r}")
    values, low = condition_values(name), value.strip().lower()
    listed = [x.strip().lower() for x in value.split(",") if x.strip()]
    if op == "exists":
        return F.size(values) > 0
    if op in ("gt", "lt"):
        bound = float(value.replace(",", "").replace("_", ""))
        return F.exists(values, lambda v: F.coalesce(_number(v) > bound if op == "gt" else _number(v) < bound, F.lit(False)))
    tests = {
        "equals": lambda v: F.lower(v) == low,
        "contains": lambda v: F.lower(v).contains(low),
        "starts_with": lambda v: F.lower(v).startswith(low),
        "ends_with": lambda v: F.lower(v).endswith(low),
        "regex": lambda v: v.rlike("(?i)" + value.strip()),
        "in": lambda v: F.lower(v).isin(listed) if listed else F.lit(False),
    }
    if op in NEGATIVE:
        positive = tests[op.removeprefix("not_")]
        return F.forall(values, lambda v: ~positive(v))
    return F.exists(values, tests[op])


def conditions(parts: list[tuple], combine: str = "and", sources: str = "") -> Column:
    """Conditions joined by and / or, within sources whose name or file contains a text."""
    if not 0 < len(parts) <= MOST_CONDITIONS:
        raise RuleError(f"1 to {MOST_CONDITIONS} conditions")
    joined = (any_of if combine.lower() == "or" else all_of)([condition(*p) for p in parts])
    return joined & _from(sources)


def _from(sources: str) -> Column:
    low = sources.strip().lower()
    return F.lower("source").contains(low) | F.lower("file").contains(low) if low else F.lit(True)


def regex_rule(pattern: str, where: str = "any", ignore_case: bool = False, multiline: bool = False, sources: str = "") -> Column:
    """A regex over message, text and all field values, or over one field."""
    screen_regex(pattern)
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    rx = (f"(?{flags})" if flags else "") + pattern
    if where == "any":
        found = F.col("msg").rlike(rx) | F.col("raw").rlike(rx) | F.exists(F.map_values("fields"), lambda v: v.rlike(rx))
    else:
        found = F.exists(condition_values(where), lambda v: v.rlike(rx))
    return F.coalesce(found, F.lit(False)) & _from(sources)


def threshold_rule(events: DataFrame, predicate: Column, count: int, window: int, group_by: str = "") -> DataFrame:
    """Bursts of matching events by the first value of a field, or of all together."""
    if count < 1 or not 0 < window <= LONGEST_WINDOW:
        raise RuleError("count of 1 or more, window of up to seven days")
    key = F.get(condition_values(group_by), F.lit(0)) if group_by else F.lit("all")
    return find_bursts(events.where(predicate), key, window, count)


def rule_test(events: DataFrame, predicate: Column, sample: int = 20) -> tuple[DataFrame, DataFrame]:
    """How many events a rule would hit, and the first of them."""
    found = events.where(predicate)
    return found.agg(F.count("*").alias("hits")), found.orderBy(F.col("ts").asc_nulls_last(), "id_seq").limit(sample)


def trigger_text(parts: list[tuple], combine: str = "and", count: int = 0, window: int = 0, group_by: str = "") -> str:
    """A rule in words."""
    said = f" {combine} ".join(" ".join(filter(None, [name, OPERATORS[op], value and f'"{value}"'])) for name, op, value in ((*p, "")[:3] for p in parts))
    return f"{said}, {count} times within {window} s" + (f" by {group_by}" if group_by else "") if count else said


#: What an unbounded repetition within another repetition looks like, and two adjacent ones over the same characters.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)(?:[+*]|\{\d+,\})")
_ALTERNATED = re.compile(r"\(([^()|\\]+)(?:\|\1[^()|]*)+\)(?:[+*]|\{\d+,\})")
_ADJACENT = re.compile(r"(\.|\\[wsdWSD]|\[[^\]]+\])[+*]\1[+*]")


def screen_regex(pattern: str, longest: int = 1000) -> str:
    """Refuses patterns that do not compile, are too long, or can take exponential time."""
    if not pattern or len(pattern) > longest:
        raise RuleError("empty or too long")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(f"does not compile: {e}") from e
    for risk in (_NESTED, _ALTERNATED, _ADJACENT):
        if risk.search(pattern):
            raise RuleError("repetition within repetition can take exponential time")
    return pattern


def parse_param(kind: str, value: str):
    """A rule parameter by kind: values, regex, text, int, seconds or bytes."""
    text = str(value).strip()
    if kind == "values":
        found = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
        if not found:
            raise RuleError("at least one value")
        return found
    if kind == "regex":
        return screen_regex(text)
    if kind in ("int", "seconds", "bytes"):
        scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30} if kind == "bytes" else {"m": 60, "h": 3600, "d": 86_400} if kind == "seconds" else {}
        m = re.fullmatch(r"([0-9][0-9_,]*)\s*([a-z]?)(?:i?b|s|in|our|ay)?s?", text.lower())
        if not m or (m[2] and m[2] not in {*scale, "s", "b"}):
            raise RuleError(f"not a number of {kind}: {value!r}")
        number = int(re.sub("[,_]", "", m[1])) * scale.get(m[2], 1)
        if number < 1:
            raise RuleError("must be positive")
        return number
    if kind == "text" and text:
        return text
    raise RuleError(f"not {kind}: {value!r}")


@dataclass(frozen=True)
class Rule:
    """A rule of the catalogue: what it is called, how grave a hit is, and its parameters."""

    id: str
    name: str
    level: str
    params: dict = field(default_factory=dict)
    enabled: bool = True

    def override(self, name: str = "", level: str = "", enabled: bool | None = None, **params) -> Rule:
        unknown = set(params) - set(self.params)
        if unknown:
            raise RuleError(f"{self.id} has no parameter {', '.join(sorted(unknown))}")
        return replace(self, name=name or self.name, level=level or self.level, enabled=self.enabled if enabled is None else enabled, params=self.params | params)


def strip_rule(events: DataFrame, rule_id: str) -> DataFrame:
    """Takes one rule's hits away, before it is applied anew."""
    return events.withColumn("detections", F.filter("detections", lambda d: d["id"] != rule_id))


def hit_counts(events: DataFrame) -> DataFrame:
    return events.select(F.explode("detections").alias("d")).groupBy(F.col("d.id").alias("rule_id")).agg(F.count("*").alias("hits"))
