"""Severity ranks and the inference of a record's severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schema import SEVERITIES

# What a level word means.
LEVELS = {
    "critical": ["emerg", "emergency", "fatal", "crit", "critical", "alert", "panic"],
    "high": ["err", "error", "severe"],
    "medium": ["warn", "warning"],
    "low": ["notice"],
    "info": ["info", "information", "informational", "debug", "trace", "verbose"],
}
# Words that raise a message without level or status.
WORDS_HIGH = r"(?i)\b(denied|failed|failure|unauthorized|forbidden|invalid|attack|malware|exploit|breach|compromise|segfault|panic|kill(?:ed)?)\b"
WORDS_MEDIUM = r"(?i)\b(warn(?:ing)?|retry|timeout|timed out|deprecated|refused|throttl|rate.?limit|slow)\b"


def sev_rank(sev: Column) -> Column:
    """0 for info to 4 for critical; unknown words rank as info."""
    ranked = F.when(sev == SEVERITIES[1], F.lit(1))
    for rank in (2, 3, 4):
        ranked = ranked.when(sev == SEVERITIES[rank], F.lit(rank))
    return ranked.otherwise(F.lit(0))


def sev_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def max_sev(*sevs: Column) -> Column:
    return sev_name(F.greatest(*map(sev_rank, sevs)))


def level_severity(level: Column) -> Column:
    """The severity of a level word, null for an unknown one."""
    level, chain = F.lower(level), None
    for sev, words in LEVELS.items():
        chain = F.when(level.isin(words), sev) if chain is None else chain.when(level.isin(words), sev)
    return chain


def _filled(column: Column) -> Column:
    return F.when(column != "", column)


def infer_severity(explicit: Column, fields: Column, msg: Column) -> Column:
    """Explicit severity, else status from 400, else level, else any status, else words of the message."""
    own = F.lower(explicit)
    explicit_sev = F.when(own.isin(*SEVERITIES), own).otherwise(level_severity(own))
    level = level_severity(F.coalesce(*[_filled(F.try_element_at(fields, F.lit(k))) for k in ("level", "severity", "log.level")]))
    status = F.coalesce(*[_filled(F.try_element_at(fields, F.lit(k))) for k in ("http.status", "status")])
    code = F.when(status.rlike("^[0-9]+$"), status.try_cast("bigint"))
    by_status = F.when(code >= 500, "high").when(code.isin(401, 403), "medium").when(code >= 400, "low")
    by_words = F.when(msg.rlike(WORDS_HIGH), "medium").when(msg.rlike(WORDS_MEDIUM), "low").otherwise("info")
    return F.coalesce(explicit_sev, by_status, level, F.when(code.isNotNull(), F.lit("info")), by_words)
