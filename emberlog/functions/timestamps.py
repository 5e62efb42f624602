"""Timestamps out of text and numbers. All results are UTC and of second precision; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,][0-9]+)?\s*(Z|[+\-][0-9]{2}:?[0-9]{2})?"
NGINX = r"([0-9]{1,2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+\-][0-9]{4})"
SYSLOG = r"([A-Z][a-z]{2})\s+([0-9]{1,2}) ([0-9]{2}:[0-9]{2}:[0-9]{2})"
KIBANA = r"([A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4} @ [0-9]{2}:[0-9]{2}:[0-9]{2})"
EPOCH = r"^[0-9]{10}(?:[0-9]{3})?(?:\.[0-9]+)?$"
#: Further formats that are tried last, instead of guessing.
EXTRA_FORMATS = ["yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss"]

#: Second ranges in which a number can be a time: 1990 to 2100.
LOW, HIGH = 631_152_000, 4_102_444_800


def _iso(text: Column) -> Column:
    zone = F.regexp_extract(text, ISO, 3)
    zone = F.when(zone.isin("", "Z"), "+00:00").otherwise(F.regexp_replace(zone, r"^([+\-][0-9]{2}):?([0-9]{2})$", "$1:$2"))
    whole = F.concat_ws(" ", F.regexp_extract(text, ISO, 1), F.concat(F.regexp_extract(text, ISO, 2), zone))
    return F.try_to_timestamp(F.when(text.rlike(ISO), whole), F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def _syslog(text: Column, year: int) -> Column:
    parts = [F.regexp_extract(text, SYSLOG, i) for i in (1, 2, 3)]
    return F.try_to_timestamp(F.when(text.rlike(SYSLOG), F.concat_ws(" ", F.lit(str(year)), *parts)), F.lit("yyyy MMM d HH:mm:ss"))


def _plausible(ts: Column, latest: str | None) -> Column:
    bound = F.lit(latest).cast("timestamp") if latest else F.current_timestamp() + F.expr("INTERVAL 2 DAYS")
    return F.when((F.year(ts) >= 1990) & (ts <= bound), ts)


def parse_ts(text: Column, year: int, latest: str | None = None) -> Column:
    """ISO, access-log, syslog (of ``year``), export and epoch forms, then a fixed list; implausible times are null.

    ``latest`` is the latest time to be believed, two days from now unless given.
    """
    text = F.regexp_replace(F.trim(text), "^[\"'\\[]+|[\"'\\]]+$", "")
    number = F.when(text.rlike(EPOCH), text.try_cast("double"))
    epoch = F.timestamp_seconds(F.floor(F.when(number >= 1e12, number / 1000).otherwise(number)))
    forms = [
        F.when(text.rlike("^" + ISO), _iso(text)),
        F.try_to_timestamp(F.when(text.rlike("^" + NGINX), F.regexp_extract(text, NGINX, 1)), F.lit("d/MMM/yyyy:HH:mm:ss Z")),
        F.when(text.rlike("^" + SYSLOG), _syslog(text, year)),
        F.try_to_timestamp(F.when(text.rlike("^" + KIBANA), F.regexp_extract(text, KIBANA, 1)), F.lit("MMM d, yyyy @ HH:mm:ss")),
        epoch,
        *[F.try_to_timestamp(F.regexp_replace(text, "^[A-Z][a-z]{2}, ", ""), F.lit(form)) for form in EXTRA_FORMATS],
    ]
    return _plausible(F.date_trunc("second", F.coalesce(*forms)), latest)


def leading_ts(line: Column, year: int, latest: str | None = None) -> Column:
    """A time within the first 48 characters of a line, or an access log's within the first 120."""
    head = F.substring(line, 1, 48)
    found = F.coalesce(
        F.when(head.rlike(r"^\W*" + ISO), _iso(head)),
        F.try_to_timestamp(F.when(head.rlike(r"^\W*" + KIBANA), F.regexp_extract(head, KIBANA, 1)), F.lit("MMM d, yyyy @ HH:mm:ss")),
        F.when(head.rlike(r"^(<[0-9]+>)?\W*" + SYSLOG), _syslog(head, year)),
        F.try_to_timestamp(F.regexp_extract(F.substring(line, 1, 120), r"\[" + NGINX + r"\]", 1), F.lit("d/MMM/yyyy:HH:mm:ss Z")),
    )
    return _plausible(F.date_trunc("second", found), latest)


def anywhere_ts(text: Column, year: int, latest: str | None = None) -> Column:
    """The first time of any known form in a text."""
    found = F.coalesce(
        _iso(text),
        F.try_to_timestamp(F.when(text.rlike(NGINX), F.regexp_extract(text, NGINX, 1)), F.lit("d/MMM/yyyy:HH:mm:ss Z")),
        F.try_to_timestamp(F.when(text.rlike(KIBANA), F.regexp_extract(text, KIBANA, 1)), F.lit("MMM d, yyyy @ HH:mm:ss")),
        _syslog(text, year),
    )
    return _plausible(F.date_trunc("second", found), latest)


def ts_from_number(number: Column) -> Column:
    """The time that a number stands for: Julian day, s, ms, us or ns since 1970, us since 1601, or 100 ns since year 1."""
    n = number.cast("decimal(38,9)")
    seconds = (
        F.when(n.between(2_447_892, 2_488_070), (n - F.lit("2440587.5").cast("decimal(38,9)")) * 86_400)
        .when(n.between(LOW, HIGH), n)
        .when(n.between(LOW * 10**3, HIGH * 10**3), n / 10**3)
        .when(n.between(LOW * 10**6, HIGH * 10**6), n / 10**6)
        .when(n.between((LOW + 11_644_473_600) * 10**6, (HIGH + 11_644_473_600) * 10**6), n / 10**6 - 11_644_473_600)
        .when(n.between((LOW + 62_135_596_800) * 10**7, (HIGH + 62_135_596_800) * 10**7), n / 10**7 - 62_135_596_800)
        .when(n.between(LOW * 10**9, F.lit(str(HIGH * 10**9)).cast("decimal(38,0)")), n / 10**9)
    )
    return F.timestamp_seconds(F.floor(seconds))
