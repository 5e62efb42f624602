"""Conversation repair against an exhaustive search over whole edit strings."""

import hashlib
import random
from zlib import crc32

import pytest

from emberlog.llm import repair as R

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damaged(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        code = crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv_id, [])
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if code == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def cheapest(rows, seen_faults):
    """Whole strings in a dictionary by state: every insertion, everywhere."""
    known = {"": (0, "", ())}

    def inserted(states):
        states = dict(states)
        for _ in range(4):
            for s, (cost, text, made) in list(states.items()):
                role = "assistant" if s == "u" else "user"
                way = (cost + 5, text + "I", (*made, (role, "")))
                states[role[0]] = min(way, states.get(role[0], way), key=lambda w: w[:2])
        return states

    for (_, role, text), fault in zip(rows, seen_faults, strict=True):
        after = {}

        def offer(s, way):
            after[s] = min(way, after.get(s, way), key=lambda w: w[:2])

        for s, (cost, edits, made) in inserted(known).items():
            offer(s, (cost + 2, edits + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[:1] in NEXT[s]:
                offer(NEXT[s][role[:1]], (cost + more, edits + "K", (*made, (role, text))))
            for new in ("user", "assistant"):
                if new[0] in NEXT[s]:
                    offer(new[0], (cost + more + 1, edits + "R", (*made, (new, text))))
        known = after
    return min((way for s, way in inserted(known).items() if s in ("", "a")), key=lambda w: w[:2])


def expected(rows):
    out = {}
    for conv_id, own in damaged(rows).items():
        marks, seen = [], set()
        for _, role, text in own:
            bare = text.strip(SPACES)
            marks.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, made = cheapest(own, marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv_id] = (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def found(spark, rows, most=R.BLOCK, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    got = R.digests(R.repair(R.damage(df), df, most)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def invented(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "a. b", "Fine!  ", "Yes."]
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    return [(c, t + rng.randrange(2), rng.choice(roles), rng.choice(texts) + str(rng.randrange(3)) * rng.randrange(2)) for c in range(conversations) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("most", [R.BLOCK, 3, 1])
def test_against_exhaustive_search(spark, most):
    rows = invented(most, 150, 14)
    assert found(spark, rows, most) == expected(rows)


def test_long_conversation_spreads(spark):
    rows = [(7, t, r, x) for _, t, r, x in invented(5, 300, 9)] + invented(6, 20, 6)
    assert found(spark, rows, 16) == expected(rows)
    df = spark.createDataFrame([(7, t, "user", f"{t}.") for t in range(400)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = R.blocks(R.faults(R.damage(df)), 16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut.where("at < 0").count() >= 20 and cut.select("part").distinct().count() > 1


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in R.op12_conversation_repair(spark, sf).collect()}
    assert got == expected(rows)


def test_nulls_ties_repeats_and_odd_columns(spark):
    rows = [(None, None, None, None), (None, 2, "user", "Hi."), (1, None, "user", "x."), (1, None, "user", "x."), (1, 3, "", "y."), (1, 3, "assistant", None), (2, 1, "user", "a" * 20000 + "."), (2, 1, "assistant", "b.")]
    rows += [(3, 5, "user", "same.")] * 40 + [(4, t, "assistant", "same.") for t in range(30)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, copies int, path string")
    got = {r["conv_id"]: tuple(r)[1:] for r in R.digests(R.repair(R.damage(df), df)).collect()}
    want = expected([r for r in rows if r[2] != ""])
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in want.items() if k != 1}
    assert "R" in got[1][6] or "D" in got[1][6]
    none = spark.createDataFrame([], df.schema)
    assert R.digests(R.repair(R.damage(none), none)).count() == 0


def test_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_text_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "x."), ("a", 1, "assistant", "y.")], "conv_id string, turn int, role string, text string")
    assert R.digests(R.repair(df.withColumn("copies", R.F.lit(1)), df)).select("conv_id", "audit").collect() == [("a", "KK")]


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 3])
def test_order_of_edit_strings(modulus):
    """With a modulus of 3 nearly all hashes collide: the order still is that of the strings."""
    rng = random.Random(modulus)
    edits, nodes = R.Edits(modulus), [0]
    for _ in range(400):
        nodes.append(edits.add(rng.choice(nodes[-40:]), rng.choice("DIKR")))
    for _ in range(2000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert edits.less(a, b) == (edits.text(a) < edits.text(b))
