"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and a raw multinomial, in DataFrame functions only.

Method. Pieces of a text (runs of letters and digits, runs of other visible characters) give unigrams and bigrams, each
hashed into one of ``buckets`` cells. Two add-half smoothed multinomials are fitted: over trusted documents and over the
whole raw corpus. A document's score is its log-likelihood ratio per n-gram; it is kept if the score reaches a fixed
threshold. Nothing is sampled: equal texts get equal verdicts.

Nulls and edges. A null text, or one without a word, has zero counts, score 0 and fails the base rules. Repeated rows
are judged one by one. Ids are of any type. Characters beyond U+FFFF count as marks, not letters, in pieces. Extra columns
of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import WORD_PATTERN, bounded_ids, table

BUCKETS = 1 << 14
#: At most this many trusted documents are taken for the target multinomial (the raw one covers every document).
TRUSTED_BOUND = 50_000
#: Documents whose log ratio per n-gram is under this are rejected.
THRESHOLD = -0.4
PIECE_PATTERN = r"[0-9A-Za-z_\u0080-￿]+|[^\s0-9A-Za-z_\u0080-￿]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def _upto(last: Column, first: int = 0) -> Column:
    """first..last, empty where last < first."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def _covered(marked: Column) -> Column:
    """Words under the windows of three that start at the ascending positions ``marked``."""
    steps = F.aggregate(
        _upto(F.size(marked) - 1, 1), F.lit(0), lambda total, k: total + F.least(F.lit(3), F.get(marked, k) - F.get(marked, k - 1))
    )
    return F.when(F.size(marked) == 0, F.lit(0)).otherwise(steps + 3)


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    windows = F.sort_array(
        F.transform(
            _upto(F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )

    def marked(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    return _let(windows, lambda s: _let(marked(s), _covered))


def base_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_repeat_words, n_symbols and n_dup_lines."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_PATTERN))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).cast("long").alias("n_repeat_words"),
    )
    return F.struct(
        _let(words, of_words).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def _piece_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE_PATTERN), F.lit(0)), lambda p: F.xxhash64(p))


def _pair(u: Column, i: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.get(u, i), F.get(u, i + 1)), F.lit(buckets)).cast("int")


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The hash cells of a text's unigrams and bigrams."""
    return _let(
        _piece_hashes(text),
        lambda u: F.concat(
            F.transform(u, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
            F.transform(_upto(F.size(u) - 2), lambda i: _pair(u, i, buckets)),
        ),
    )


def fit_log_ratio(docs: DataFrame, trusted: Column, buckets: int = BUCKETS) -> list[float]:
    """log(trusted share / raw share) of each cell. Counts are partial aggregates; only ``buckets`` sums reach the driver."""
    counted = (
        docs.select(trusted.cast("long").alias("t"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
        .collect()
    )
    raw, target = [0.5] * buckets, [0.5] * buckets
    for row in counted:
        raw[row["b"]] += row["raw"]
        target[row["b"]] += row["target"]
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def log_ratio(text: Column, model: list[float]) -> Column:
    """Mean of the model over a text's n-grams, 0 for a text without any. The model is a constant of bounded size."""
    cells = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    buckets = len(model)
    one = lambda u: F.aggregate(u, F.lit(0.0), lambda a, x: a + F.get(cells, F.pmod(x, F.lit(buckets)).cast("int")))
    two = lambda u: F.aggregate(_upto(F.size(u) - 2), F.lit(0.0), lambda a, i: a + F.get(cells, _pair(u, i, buckets)))
    mean = lambda u: F.when(F.size(u) == 0, F.lit(0.0)).otherwise((one(u) + two(u)) / (2 * F.size(u) - 1))
    return _let(_piece_hashes(text), mean)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_bound: int = TRUSTED_BOUND) -> DataFrame:
    """Base statistics, score and verdict of every document; trusted documents are those labelled of good quality."""
    docs = docs.select("doc_id", "text")
    good = bounded_ids(labels.where(F.col("quality") == 1), "doc_id", trusted_bound)
    chosen = docs.sparkSession.createDataFrame([(x,) for x in sorted(good)], f"trusted_id {labels.schema['doc_id'].dataType.simpleString()}")
    marked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("trusted_id"), "left")  # at most trusted_bound rows
    model = fit_log_ratio(marked, F.col("trusted_id").isNotNull())
    judged = docs.select("doc_id", base_statistics(F.col("text")).alias("base"), log_ratio(F.col("text"), model).alias("log_ratio"))
    n, repeated = F.col("base.words.n_words"), F.col("base.words.n_repeat_words")
    failed = (n < 50) | (100 * repeated > 50 * n)
    return judged.select(
        "doc_id",
        n.alias("n_words"),
        F.col("base.words.word_chars").alias("word_chars"),
        F.col("base.n_symbols").alias("n_symbols"),
        F.col("base.n_dup_lines").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        "log_ratio",
        (~failed & (F.col("log_ratio") >= threshold)).alias("kept"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
