"""The corpus pipeline, stage by stage, against brute force; odd rows, extra columns and empty tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import importance, language, packing


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def groups(rows):
    """Components over pairs of texts of a Jaccard similarity of 0.8 or more; texts without words are copies only of equal ones."""
    sets, up = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i]["text"] == rows[j]["text"] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9):
                up[top(i)] = top(j)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[top(i)].append(r["doc_id"])
    return out.values()


@pytest.fixture(scope="module")
def stages(spark, sf, small):
    """Each stage's name with its input and output; documents carry columns of names that the code uses itself."""
    docs, out = small.withColumn("class", F.col("doc_id") % 3).withColumn("kept", F.lit("x")).withColumn("least", F.lit(None).cast("string")), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        rows = got.collect()
        out.append((name, docs.collect(), rows, got.columns, docs.columns))
        docs = spark.createDataFrame(rows, got.schema)
    return {name: rest for name, *rest in out}


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]


def test_filters_keep_rows_whole(stages):
    for name in ("quality", "language", "near_duplicates"):
        before, after, columns, given = stages[name]
        assert columns == given and set(after) <= set(before) and len(set(after)) == len(after)


def test_quality(spark, sf, small, stages):
    before, after, *_ = stages["quality"]
    good = importance.good_ids(spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in importance.resample(small, good).where("kept").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r["doc_id"] for r in after}
    assert sum(i in left for i, q in labels.items() if q == 1) >= 0.9 * sum(q == 1 for q in labels.values())


def test_language(spark, stages):
    before, after, *_ = stages["language"]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in before], "doc_id long, text string, lang string")
    model = language.train(docs)
    judged = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert {r["doc_id"] for r in after} == {i for i, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= 0.35}


def test_near_duplicates(stages):
    before, after, *_ = stages["near_duplicates"]
    assert sorted(r["doc_id"] for r in after) == sorted(min(g) for g in groups(before))


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after, *_ = stages["packing"]
    own, pieces = Tokenizer.from_file(packing.vocabulary_path()), defaultdict(list)
    for r in after:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {r["doc_id"] for r in before}
    for r in before:
        n = len(own.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        assert sorted(x for p in pieces[r["doc_id"]] for x in range(p["start"], p["start"] + p["length"])) == list(range(n))


def test_odd_and_empty(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:3]:
            got = stage(spark, docs, sf)
            assert got.columns == docs.columns and got.count() <= docs.count()
        assert (stage_rows := corpus_pipeline.STAGES[3][1](spark, docs, sf).count()) >= docs.count() and (stage_rows > 0) == (docs.count() > 0)


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text, "c"), (None, text, "d"), (3, None, "e"), (4, None, "f"), (None, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    from emberlog.llm.simhash import drop_near_copies

    assert sorted(map(tuple, drop_near_copies(docs).collect()), key=str) == sorted([(1, text, "a"), (3, None, "e")], key=str)
