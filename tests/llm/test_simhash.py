"""SimHash links, components and near-copy removal against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from emberlog.llm import simhash
from emberlog.operators import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = WORDS((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, edges):
    least = {n: n for n in nodes}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def check(rows, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    edges = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = brute_components(list(prints), edges)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


def test_documents(spark, small):
    check(simhash.near_duplicates(small).collect(), {r["doc_id"]: r["text"] for r in small.collect()})


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[5]["component_id"] == 4
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 4, 6, 7, None, 8, 9], key=str)
    assert simhash.drop_near_copies(no_docs).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 40])
def test_links_are_complete(spark, dense):
    """Random fingerprints with planted neighbours: components of all pairs within two bits, by pairs and by one-bit entries."""
    draw = random.Random(7)
    prints = set()
    for _ in range(30):
        centre = draw.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    edges = {(r["a"], r["b"]) for r in simhash.links(frame, dense).collect()}
    pairs = {tuple(sorted((signed[a], signed[b]))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2}
    assert {tuple(sorted(e)) for e in edges} <= pairs
    assert brute_components(list(signed.values()), edges) == brute_components(list(signed.values()), pairs)


def test_components(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1100)]
    some = [(2000 + draw.randrange(150), 2000 + draw.randrange(150)) for _ in range(120)]
    edges = chain + star + some + [(5, 5), (None, 6), (2, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components(sorted({x for e in real for x in e}), real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_majority_by_adders():
    draw = np.random.default_rng(5)
    for n in (1, 2, 47, 48, 49, 333):
        rows = draw.integers(0, 2**63, (n, 3)).astype(np.uint64)
        assert (simhash.counted_majority(rows) == simhash.majority(rows)).all()


def test_near_copies_at_point_eight(spark):
    """Edited copies of at least 0.8 are removed, unrelated texts stay, whatever the group's size."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts, base_of = {}, {}
    for b in range(30):
        base = [word() for _ in range(200)]
        for c in range(12 if b else 150):
            own = list(base)
            for _ in range(min(c, 3)):
                own[draw.randrange(200)] = word()
            texts[len(texts)] = " ".join(own)
            base_of[len(texts) - 1] = b
    frame = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    kept = [r["doc_id"] for r in simhash.drop_near_copies(frame).collect()]
    assert sorted({base_of[i] for i in kept}) == list(range(30))
    assert len(kept) == 30


def brute_kept(texts, similarity=0.8):
    """Smallest doc_id of each component over all pairs of five-word shingle sets."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in texts.items() for w in [t.split()]}
    edges = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    return sorted(set(brute_components(list(texts), edges).values()))


def kept_of(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.drop_near_copies(frame).collect())


def test_near_copies_meet_beyond_leaders(spark):
    """Stars of 250 copies that are near their original but not each other, and texts that share a long passage."""
    draw = random.Random(23)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts = {}
    for _ in range(2):
        base = [word() for _ in range(500)]
        rows = [list(base) for _ in range(251)]
        for own in rows[1:]:
            for at in draw.sample(range(500), 10):
                own[at] = word()
        draw.shuffle(rows)
        texts |= {len(texts) + k: " ".join(own) for k, own in enumerate(rows)}
    passage = [word() for _ in range(90)]
    for _ in range(60):
        own = [word() for _ in range(draw.randint(8, 30))]
        texts[len(texts)] = " ".join(passage + own)
        if draw.random() < 0.5:
            texts[len(texts)] = " ".join(passage + own[:-1] + [word()])
    assert kept_of(spark, texts) == brute_kept(texts)


def test_near_copies_are_decided_on_sets(spark):
    """Short texts at exactly 0.8 and just below, and long ones around 0.75, which fingerprints cannot tell apart."""
    draw = random.Random(29)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts = {}
    for n in (8, 7, 19, 18, 24, 23):  # 4 of 5, 3 of 4, 15 of 19 shingles, ...
        for more in (1, 4, 5):
            for _ in range(6):
                base = [word() for _ in range(n)]
                texts[len(texts)] = " ".join(base)
                texts[len(texts)] = " ".join(base + [word() for _ in range(more)])
    for edits in (10, 11, 12, 13, 14, 15):
        for _ in range(6):
            base = [word() for _ in range(500)]
            texts[len(texts)] = " ".join(base)
            for at in draw.sample(range(500), edits):
                base[at] = word()
            texts[len(texts)] = " ".join(base)
    assert kept_of(spark, texts) == brute_kept(texts)
