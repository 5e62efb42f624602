"""Quality rules and importance resampling against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import importance, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
PIECES = re.compile(r"[0-9A-Za-z_\u0080-\uffff]+|[^\s0-9A-Za-z_\u0080-\uffff]+", re.ASCII).findall


def base(text):
    text = text or ""
    words = WORDS(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def cells(text, buckets):
    u = [xxhash.xxh64_intdigest(p.encode(), 42) for p in PIECES(text or "")]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    return [signed(h) % buckets for h in u] + [signed(pair(a, b)) % buckets for a, b in zip(u, u[1:], strict=False)]


def test_base_statistics(spark, small, odd_docs):
    both = small.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    got = both.select("text", quality_rules.base_statistics(F.col("text")).alias("b")).collect()
    for row in got:
        b = row["b"]
        assert (b["words"]["n_words"], b["words"]["word_chars"], b["n_symbols"], b["n_dup_lines"], b["words"]["n_repeat_words"]) == base(row["text"])


def test_log_ratio_against_brute_force(spark, small, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    buckets = quality_rules.BUCKETS
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        own = cells(t, buckets)
        raw.update(own)
        if i in good:
            target.update(own)
    a, b = sum(raw.values()) + buckets / 2, sum(target.values()) + buckets / 2
    model = [math.log((target[k] + 0.5) / b) - math.log((raw[k] + 0.5) / a) for k in range(buckets)]
    for row in quality_rules.judge(small, labels).collect():
        own = cells(texts[row["doc_id"]], buckets)
        expected = sum(model[k] for k in own) / len(own) if own else 0.0
        n_words, *_, repeated = base(texts[row["doc_id"]])
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        assert row["log_ratio"] == pytest.approx(expected, abs=1e-9)
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and row["log_ratio"] >= quality_rules.THRESHOLD)


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "some words here"), ("b", "other words")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int")
    assert sorted(r["doc_id"] for r in quality_rules.judge(docs, labels).collect()) == ["a", "b"]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(odd_docs, labels).collect()
    assert len(rows) == 11
    assert {r["doc_id"]: r["log_ratio"] for r in rows}[1] == 0 and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality_rules.judge(no_docs, labels).count() == 0
    assert importance.resample(no_docs, {4}).count() == 0
    drawn = importance.resample(odd_docs, {4}).collect()
    assert len(drawn) == 11
    assert len({(r["key"], r["kept"]) for r in drawn if r["doc_id"] == 4}) == 1
    assert all(r["kept"] for r in importance.resample(odd_docs, set()).collect())
    kept = importance.keep_resampled(odd_docs, {4})
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in drawn)


def test_importance_weights_against_brute_force(spark, small, sf):
    good = importance.good_ids(spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"].encode() for r in small.collect()}
    size = importance.BUCKETS
    raw, folds = np.zeros(size), np.zeros((2, size))
    for i, t in texts.items():
        own = np.bincount(importance.features(t), minlength=size)
        raw += own
        if i in good:
            folds[zlib.crc32(str(i).encode()) % 2] += own
    p = (raw + 0.5) / (raw.sum() + 0.5 * size)
    prior = importance.PRIOR * size
    models = [np.log((own + prior * p) / (own.sum() + prior) / p) for own in folds[::-1]]
    expected = {}
    for i, t in texts.items():
        own = (sum(models) / 2 if i not in good else models[zlib.crc32(str(i).encode()) % 2])[importance.features(t)]
        expected[i] = importance.LENGTH * own.mean() if len(own) else 0.0
    rows = importance.resample(small, good, k=50).collect()
    for r in rows:
        assert r["log_weight"] == pytest.approx(expected[r["doc_id"]], abs=1e-6)
    top = sorted((r["key"] for r in rows), reverse=True)[:50]
    assert sorted((r["key"] for r in rows if r["kept"]), reverse=True) == top
    share = importance.resample(small, good, target_share=0.9).collect()
    keys = sorted((r["key"] for r in share if r["doc_id"] in good), reverse=True)
    bar = keys[math.ceil(0.9 * len(keys)) - 1]
    assert all(r["kept"] == (r["key"] >= bar) for r in share)


def test_draws_follow_weights(spark):
    """Gumbel top-k draws in proportion to the weights: of two equal halves, one e times likelier."""
    ratio = np.zeros(4)
    keys = [importance.document_key(i, b"", ratio, 0)[2] + (i % 2) for i in range(20_000)]
    first = sum(keys[2 * i + 1] > keys[2 * i] for i in range(10_000)) / 10_000
    assert first == pytest.approx(math.e / (1 + math.e), abs=0.02)


def test_inclusion_follows_the_fitted_weights(spark):
    """Over 200 seeds, documents are drawn as often as their fitted weights say, and near the border it is the draw that decides."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = importance.good_ids(spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    rows = importance.resample(docs, good).collect()
    weights = {r["doc_id"]: r["log_weight"] for r in rows}
    ids = sorted(weights)
    w, k, seeds = np.array([weights[i] for i in ids]), sum(r["kept"] for r in rows), 200
    by_weight = set(np.array(ids)[np.argsort(-w)[:k]].tolist())
    assert by_weight != {r["doc_id"] for r in rows if r["kept"]}  # without noise, other documents
    drawn, expected = np.zeros(len(ids)), np.zeros(len(ids))
    for seed in range(1, seeds + 1):
        keys = w + np.array([importance.gumbel(i, texts[i], seed) for i in ids])
        least = np.sort(keys)[-k]
        drawn += keys >= least
        expected += 1 - np.exp(-np.exp(w - least))  # the chance that Gumbel noise lifts a weight over the bar
    drawn, expected = drawn / seeds, expected / seeds
    assert np.all(np.abs(drawn - expected) <= 5 * np.sqrt(expected * (1 - expected) / seeds) + 0.02)
    open_ones = (expected > 0.05) & (expected < 0.95)
    assert open_ones.sum() >= 10
    assert np.corrcoef(drawn[open_ones], expected[open_ones])[0, 1] > 0.95


def test_kth_largest(spark):
    values = spark.createDataFrame([(float(x),) for x in [5, 3, 3, 3, -1, 1e18, 7, 7]], "v double")
    ordered = sorted([5, 3, 3, 3, -1, 1e18, 7, 7], reverse=True)
    for k in range(1, 9):
        assert importance.kth_largest(values, "v", k) == ordered[k - 1]
    assert importance.kth_largest(values.limit(0), "v", 1) is None


@pytest.mark.parametrize("half", [0, 1])
def test_held_out_quality(spark, half):
    """Good documents stay, junk goes, whichever half of the labels is learned from."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.where(F.col("doc_id") % 2 == half)
    for judged in (importance.resample(docs, importance.good_ids(known)), quality_rules.judge(docs, known).where("not base_failed")):
        rates = {r["quality"]: r["rate"] for r in judged.join(labels.where(F.col("doc_id") % 2 != half), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
        assert rates[1] > 0.95 and rates[0] < 0.3


def test_registered_query_on_labels(spark):
    judged = importance.op1_importance_resampling(spark, "/root/testdata/sf0.01")
    rates = {r["quality"]: r["rate"] for r in judged.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.3


def test_text_ids(spark, odd_docs):
    named = odd_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert importance.resample(named, {"d4", "d9"}).count() == 11
    kept = importance.keep_resampled(named, {"d4", "d9"})
    assert kept.columns == named.columns and {"d4"} <= {r["doc_id"] for r in kept.collect()}


def test_all_labelled_documents_are_learned_from(spark):
    """The fitted counts are those of every good document, however many there are: 60,000 here."""
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    raw, *folds = importance.feature_counts(docs, importance.good(labels))
    assert raw.sum() == 120_000 and sum(folds).sum() == 60_000
    assert importance.importance_keys(docs, importance.good(labels), np.zeros((2, 10))).where("is_target").count() == 60_000


def test_many_doubtful_documents_are_joined(spark, small, sf):
    """Rows near the border are told apart by a join where they are too many to be told to every task."""
    good = importance.good(spark.read.parquet(f"{sf}/labels.parquet"))
    expected = {r["doc_id"] for r in importance.resample(small, good, target_share=0.5).where("kept").collect()}
    for bound in (0, importance.DOUBTFUL):
        assert {r["doc_id"] for r in importance.keep_resampled(small, good, target_share=0.5, doubtful_bound=bound).collect()} == expected
