"""The filter audit against running every order over the documents."""

import random
import re
from itertools import permutations

from emberlog.llm import filter_audit as A


def expected(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    judged = {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        wrong = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        judged.setdefault(lang or "", []).append((i, {f for f in "ABCDE" if wrong[f]}))
    out = set()
    for part, own in judged.items():
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                redundant = sum(f in w for _, w in own) - len(gone)
                rows.append((part, "".join(order), step, len(kept), len(gone), redundant, sum(w == {f} for _, w in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
                shapley[f] += len(gone)
                left = kept
        out |= {(*r[:-1], shapley[r[-1]]) for r in rows}
    return out


def found(spark, docs, labels):
    return {tuple(r) for r in A.audit(A.tensors(A.judged(docs), labels)).collect()}


def test_odd_documents_in_every_order(spark, odd_docs):
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (5, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    assert found(spark, odd_docs, table) == expected(docs, labels)


def test_random_documents(spark):
    rng = random.Random(3)
    bits = ["word " * 210, " ".join(map(str, range(210))), "SHOUTING LOUDLY ", "a # b", "plain text here ", "\U0001f600 ", "x"]
    docs = [(k % 90, "".join(rng.choice(bits) for _ in range(rng.randrange(4))) or None, rng.choice(["en", "fr", None, ""])) for k in range(120)]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 90, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert found(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == expected(docs, labels)


def test_copies_of_a_third_of_all_rows(spark):
    docs = [(k, "the same text" if k % 3 == 0 else f"text {k}", "en") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = A.judged(df).where("failed % 2 = 1")
    assert sorted(r[0] for r in got.select("doc_id").collect()) == [k for k in range(3, 300, 3)]


def test_no_documents(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(A.tensors(A.judged(no_docs), labels)).count() == 0
