"""Which format a file has: every format scores the file's first lines, and the winner's parser has to read them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.timestamps import leading_ts
from emberlog.operators.durable import stored
from emberlog.sources import records
from emberlog.sources.delimited import DELIMITERS, sampled
from emberlog.sources.lines import ACCESS, JOURNAL, RFC3164, RFC5424, access_log, syslog

READY = 0.9
#: A parser that fails on more than this share of the sampled records loses the file.
MOST_WRONG = 0.5
#: What plain text scores: this, and this much more if all lines begin with a time.
PLAIN_LEAST, PLAIN_TIMES = 0.2, 0.3
MAPPABLE = ["delimited"]


def line_tests() -> dict[str, Column]:
    """Whether a line looks like each format. Narrow formats come before wide ones: the first of equal scores wins."""
    raw = F.col("raw")
    count = lambda d: F.length(raw) - F.length(F.replace(raw, F.lit(d), F.lit("")))
    brace = F.ltrim(raw).startswith("{")
    return {
        "k8s.audit": brace & raw.contains('"apiVersion"') & raw.contains("audit.k8s.io"),
        "aws.cloudtrail": raw.contains('"eventSource"') & raw.contains('"eventName"'),
        "nginx.access": raw.rlike(ACCESS),
        "syslog": raw.rlike(RFC5424) | raw.rlike(RFC3164) | raw.rlike(JOURNAL),
        "app.jsonl": brace & F.rtrim(raw).endswith("}") & raw.rlike(r'"\s*:'),
        "windows.evtx": raw.contains("<Event ") | raw.contains("<Event>") | raw.contains("<System>"),
        "delimited": F.greatest(*[count(d) for d in DELIMITERS]) >= 2,
    }


def trials(year: int = 2000) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """What reads each format's lines for the trial: parsed records, those that it could not read marked by parse_error.

    Formats whose records may span lines are tried on lines that hold a whole record; a file without one has no verdict.
    """
    raw = F.col("raw")
    whole = F.ltrim(raw).startswith("{") & F.rtrim(F.rtrim(raw), F.lit(",")).endswith("}")
    wrong = lambda failed: F.when(failed, F.create_map(F.lit("parse_error"), F.lit("unmatched"))).otherwise(F.create_map().cast("map<string,string>"))

    def elements(lines: DataFrame) -> DataFrame:
        parsed = records.event_elements(lines.where(raw.contains("</Event>")), year)
        return parsed.withColumn("fields", wrong(F.try_element_at("fields", F.lit("EventID")).isNull()))

    return {
        "k8s.audit": lambda lines: records.cluster_audit(lines.where(whole), year),
        "aws.cloudtrail": lambda lines: records.cloud_trail(lines.where(whole), year),
        "nginx.access": lambda lines: access_log(lines, year),
        "syslog": lambda lines: syslog(lines, year),
        "app.jsonl": lambda lines: records.json_lines(lines, year),
        "windows.evtx": elements,
        "delimited": lambda lines: lines.withColumn("fields", wrong(~line_tests()["delimited"])),
    }


def fingerprint(lines: DataFrame, year: int = 2000) -> DataFrame:
    """(file, parser, confidence, state, demoted): the best-scoring format whose own parser can read the file's first lines.

    Formats are ranked by the share of lines that look like theirs. Each parser then reads the same lines of the files
    where its format scores more than plain text does; one that fails on more than half of the records loses the file to
    the next, and is named in ``demoted`` in the order of rank. Plain text fails on nothing and takes what is left.
    """
    tests = line_tests()
    sample = stored(sampled(lines).where(F.trim("raw") != "").select("file", "id_seq", "raw"), "sample")
    stamped = F.avg(leading_ts(F.col("raw"), year).isNotNull().cast("int"))
    scores = sample.groupBy("file").agg(*[F.avg(c.cast("int")).alias(name) for name, c in tests.items()], F.round(PLAIN_LEAST + PLAIN_TIMES * stamped, 3).alias("text"))
    ranked = F.array(*[F.struct(F.col(f"`{n}`").alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(tests)])
    listed = scores.select("file", "text", F.explode(F.filter(ranked, lambda r: r["score"] > F.col("text"))).alias("r")).select("file", "text", "r.*")

    def tried(name: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
        own = sample.join(listed.where(F.col("name") == name).select("file"), "file", "left_semi")
        failed = F.map_contains_key("fields", F.lit("parse_error")).cast("int")
        return parse(own).groupBy("file").agg(F.avg(failed).alias("wrong")).withColumn("name", F.lit(name))

    verdicts = reduce(DataFrame.unionByName, [tried(name, parse) for name, parse in trials(year).items()])
    judged = listed.join(verdicts, ["file", "name"], "left").withColumn("lost", F.coalesce(F.col("wrong") > MOST_WRONG, F.lit(False)))
    place = F.row_number().over(W.partitionBy("file").orderBy(F.desc("score"), F.desc("order")))
    won = F.min(F.when(~F.col("lost"), F.struct("place", "name", "score")))
    best = judged.withColumn("place", place).groupBy("file").agg(won.alias("won"), F.array_sort(F.collect_list(F.when(F.col("lost"), F.struct("place", "name")))).alias("lost"))
    met = scores.select("file", "text").join(best, "file", "left")
    before = F.filter(F.coalesce("lost", F.array().cast("array<struct<place:int,name:string>>")), lambda x: F.col("won").isNull() | (x["place"] < F.col("won.place")))
    parser, confidence = F.coalesce("won.name", F.lit("text")), F.round(F.coalesce("won.score", "text"), 6)
    own = met.select("file", parser.alias("parser"), confidence.alias("confidence"), F.transform(before, lambda x: x["name"]).alias("demoted"))
    return own.select("file", "parser", "confidence", source_state(F.col("parser"), F.col("confidence")).alias("state"), "demoted")


def source_state(parser: Column, confidence: Column) -> Column:
    """READY, or REVIEW (a guess to look at), or MAP (columns need names); plain text is always READY."""
    return F.when((parser == "text") | (confidence >= READY), "READY").when(parser.isin(MAPPABLE), "MAP").otherwise("REVIEW")
