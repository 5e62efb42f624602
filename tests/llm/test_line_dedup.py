"""Line dedup against plain dictionaries, its filters against sets, and insertions against deletions."""

import random

import numpy as np
import pytest

from emberlog.llm import line_dedup as L

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    owner = {}
    for i, text in docs:
        for line in (text or "").split("\n") if i is not None else ():
            owner[key(line)] = min(i, owner.get(key(line), i))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or i == owner[key(x)]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(store, docs):
    return sorted(map(tuple, L.deduplicated(store, docs).collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def invented(seed, n):
    rng = random.Random(seed)
    lines = [f"shared line number {k}" for k in range(12)] + ["Shared  LINE", "  Shared Line Number 3\t", "short", "", "ÜBER zehn Zeichen", "über zehn Zeichen", "漢字漢字漢字漢字漢字", "漢字漢字漢字"]
    return [(k, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"own line of document {k}-{j}" for j in range(rng.randrange(6)))) for k in range(n)]


def test_filters_are_sets_that_forget():
    rng = np.random.default_rng(2)
    shard, known = L.Shard([]), rng.integers(0, 2**63, 30_000).astype(np.uint64)
    for part in np.array_split(known, 7):
        shard.insert(part)
    shard = L.Shard(shard.tables())
    assert shard.contains(known).all() and len(shard.filters) < 7
    other = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    assert shard.contains(other).mean() < 0.005
    shard.remove(known[:20_000])
    assert shard.contains(known[20_000:]).all() and shard.contains(known[:20_000]).mean() < 0.01
    shard.remove(known[20_000:])
    assert all(not f.slots.any() for f in shard.filters)
    L.Shard([]).insert(np.zeros(0, np.uint64))
    same = L.Shard([])
    same.insert(np.full(40, 7, np.uint64))  # more equal fingerprints than two buckets hold
    same.remove(np.full(39, 7, np.uint64))
    assert same.contains(np.array([7], np.uint64)).all()


def test_odd_documents(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(L.inserted(odd_docs), odd_docs) == expected(docs)
    assert found(L.inserted(no_docs), no_docs) == []


@pytest.mark.parametrize("batches", [1, 3])
def test_batches_do_not_matter(spark, batches):
    docs = invented(batches, 120)
    df = frame(spark, docs)
    assert found(L.inserted(df, batches), df) == expected(docs)


def test_deletions_undo_insertions(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_SHARD", 24)
    docs = invented(9, 150)
    first, second = docs[:90], docs[90:]
    store = L.empty_store(spark).insert(L.references(frame(spark, first)))
    before = {r["key"]: tuple(r)[1:] for r in store.current().collect()}
    both = store.insert(L.references(frame(spark, second)))
    assert both.shards > store.shards
    assert found(both, frame(spark, docs)) == expected(docs)
    after = both.delete(frame(spark, second).unionByName(frame(spark, [(10_000, "")])).select("doc_id"))
    assert {r["key"]: tuple(r)[1:] for r in after.current().collect()} == before
    # The smallest holder of a line goes: its next holder owns it, and has it again.
    gone = after.delete(frame(spark, first[:45]).select("doc_id"))
    assert found(gone, frame(spark, first[45:])) == expected(first[45:])
    again = gone.insert(L.references(frame(spark, first[:45])))
    assert found(again, frame(spark, first)) == expected(first)
    nothing = again.delete(frame(spark, first).select("doc_id"))
    assert not nothing.current().count()
    assert not any(any(t) for r in nothing.filters.collect() for t in r["tables"])


def test_a_line_of_every_document(spark):
    docs = [(k, f"a line that everyone has\nline of {k} alone") for k in range(500)]
    df = frame(spark, docs)
    assert found(L.inserted(df), df) == expected(docs)
