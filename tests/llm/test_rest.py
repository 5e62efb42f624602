"""Piece sampling, packing, suffix tree, chat, url rules, Matroska and language against brute force or round trips."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import chat, language, matroska, packing, pieces, suffix_tree, url_rules
from tests.llm.conftest import ODD

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


# Sentence pieces


def test_pieces_lossless_and_reproducible(spark, odd_docs, no_docs, small):
    path = pieces.vocabulary_path()
    got = pieces.encode_sampled(odd_docs, path)
    rows = got.collect()
    assert len(rows) == 11 and all(r["lossless"] for r in rows)
    assert sorted(((r["doc_id"], r["text"]) for r in pieces.decode(got, path).collect()), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)
    again = {r["doc_id"]: r["ids"] for r in pieces.encode_sampled(odd_docs.coalesce(1), path).collect()}
    assert all(r["ids"] == again[r["doc_id"]] for r in rows)
    assert all(r["lossless"] for r in pieces.encode_sampled(small, path).collect())
    assert pieces.encode_sampled(no_docs, path).count() == 0


def test_pieces_follow_the_lattice():
    """Frequencies of sampled paths against all paths' weights, enumerated."""
    own = pieces.lattice(pieces.vocabulary_path())
    weight = {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    by_id = dict(zip(own.ids.tolist(), own.weight.tolist(), strict=True))
    for i, w in by_id.items():
        weight[sp.id_to_piece(i).replace("▁", " ")] = (i, w)

    def paths(text):
        if not text:
            return [((), 1.0)]
        return [((weight[text[:n]][0], *p), weight[text[:n]][1] * w) for n in range(1, len(text) + 1) if text[:n] in weight for p, w in paths(text[n:])]

    every = dict(paths(" these"))
    total = sum(every.values())
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in own.sample(["these"] * n, list(range(n))))
    for path, w in every.items():
        p = w / total
        assert got[path] / n == pytest.approx(p, abs=5 * math.sqrt(p * (1 - p) / n) + 1e-3)
    assert set(got) <= set(every)


def test_long_runs_follow_the_lattice():
    """A run beyond SPAN is drawn as a short one is: the same draws where both ways apply, lossless where only one does."""
    own, span = pieces.lattice(pieces.vocabulary_path()), pieces.SPAN
    texts = ["abcdefgh" * 4 + "漢字" * 3 + "x\ny  z " + "q" * 30, " lead", "", "the end"]
    short = own.sample(texts, [1, 2, 3, 4])
    try:
        pieces.SPAN = 3
        longer = own.sample(texts, [1, 2, 3, 4])
    finally:
        pieces.SPAN = span
    assert [x.tolist() for x in short] == [x.tolist() for x in longer]
    draw = random.Random(5)
    run = "".join(draw.choice("abcde漢") for _ in range(9000))
    assert own.decode(own.sample([run], [1])[0]) == run.encode()
    # Pieces reach over where any cut would be: a place in a long run is an inner one of a piece as often as elsewhere.
    inner = Counter()
    for ids in own.sample(["these" * 40] * 200, list(range(200))):
        at = 0
        for i in ids.tolist():
            inner.update(x % 5 for x in range(at + 1, at + len(own.spelled[i].decode())))
            at += len(own.spelled[i].decode())
    assert set(inner) == set(range(5))


def test_parts_of_a_text_are_exact():
    own = pieces.lattice(pieces.vocabulary_path())
    text = "lorem  ipsum\n\n dolor " * 400
    parts = own.sample([text], [3], block=500)[0]
    assert own.decode(parts) == text.encode()
    assert parts.tolist() == own.sample(["x", text, "y"], [1, 3, 2], block=500)[1].tolist()


# Packing


@pytest.mark.parametrize("seed", range(5))
def test_pack_is_exact(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([1, draw.randint(1, 300), draw.randint(1, 9000)]) for _ in range(draw.randint(0, 200))]
    placed = packing.pack(lengths, 256)
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for doc, at, n, seq, offset in placed:
        assert n > 0
        per_doc[doc].append((at, n))
        per_seq[seq].append((offset, n))
    for doc, n in enumerate(lengths):
        end = 0
        for at, size in sorted(per_doc[doc]):
            assert at == end
            end += size
        assert end == n
    for own in per_seq.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end == 256 or end & (end - 1) == 0
    assert sorted(per_seq) == list(range(len(per_seq)))


def test_pack_balances_cost():
    draw = random.Random(1)
    placed = packing.pack([draw.randint(20, 400) for _ in range(3000)])
    spent = Counter()
    for _, _, n, seq, _ in placed:
        spent[seq] += packing.cost(n)
    full = sorted(spent.values())[len(spent) // 20 :]
    assert full[-1] < 1.15 * full[0]


def test_packed_ids(spark, odd_docs, no_docs, small):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary_path())
    special = small.limit(1).selectExpr("-7L AS doc_id", "'a<|endoftext|>b <|startoftext|>\n<|ENDOFTEXT|> <| endoftext|> it<|endoftext|>\\'s' AS text")
    for docs in (small, odd_docs, special):
        rows = packing.pack_documents(docs, packing.vocabulary_path()).collect()
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r["doc_id"]].append([*own.encode(r["text"] or "", add_special_tokens=False).ids, 1])
        found = defaultdict(Counter)
        for r in rows:
            ids = texts[r["doc_id"]][0]
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
            found[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        for key, copies in texts.items():
            assert found[key] == Counter({k: len(copies) for k in range(len(copies[0]))})
    assert packing.pack_documents(no_docs, packing.vocabulary_path()).count() == 0


# Suffix tree


def test_scores_against_brute_force(spark, small, odd_docs, no_docs, monkeypatch):
    assert suffix_tree.score(no_docs).count() == 0
    for docs in (small, odd_docs):
        rows = docs.select("doc_id", "text").collect()
        train = [r for r in rows if crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10]
        counts = Counter(w for r in train for w in suffix_tree.tokens((r["text"] or "").encode()))
        n, v = sum(counts.values()), len(counts)
        got = sorted(suffix_tree.score(docs).collect(), key=lambda r: (str(r["doc_id"]), r["base_score"]))
        expected = []
        for r in rows:
            own = suffix_tree.tokens((r["text"] or "").encode())
            expected.append((r["doc_id"], len(own), sum(w in counts for w in own), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
        expected.sort(key=lambda x: (str(x[0]), x[3]))
        for g, e in zip(got, expected, strict=True):
            assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (*e[:3], n)
            assert g["base_score"] == pytest.approx(e[3], rel=1e-9, abs=1e-9)


class Brute:
    """The tree by its definition: dictionaries of all strings, probabilities by recursion."""

    def __init__(self, train, depth):
        self.counts, self.depth = Counter(), depth
        for x in train:
            for n in range(1, depth + 2):
                self.counts.update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
        words = {s[0]: c for s, c in self.counts.items() if len(s) == 1}
        self.total, self.vocabulary = sum(words.values()), len(words)
        self.next = defaultdict(dict)
        for s, c in self.counts.items():
            if len(s) > 1 and c >= 4:
                self.next[s[:-1]][s[-1]] = c
        self.stays = {}
        for context in sorted(self.next, key=len):
            n, listed = self.counts[context], self.next[context]
            parent = {x: self.p(x, context[1:]) for x in listed}
            left, free = n - sum(listed.values()), max(1e-12, 1 - sum(parent.values()))
            gain = sum(c * math.log(c / n / parent[x]) for x, c in listed.items()) + (left * math.log(left / n / free) if left else 0)
            if gain >= suffix_tree.DIVERGENCE * math.log(n) * len(listed):
                self.stays[context] = (n, (left / free + suffix_tree.SMOOTHING) / (n + suffix_tree.SMOOTHING))

    def p(self, x, context):
        while context and context not in self.stays:
            context = context[1:]
        if not context:
            return (self.counts[(x,)] + 0.1) / (self.total + 0.1 * (self.vocabulary + 1))
        parent, (n, rest) = self.p(x, context[1:]), self.stays[context]
        c = self.next[context].get(x)
        return rest * parent if c is None else (c + suffix_tree.SMOOTHING * parent) / (n + suffix_tree.SMOOTHING)


@pytest.mark.parametrize("head", [1 << 20, 300, 0])
def test_score_against_brute_force(spark, small, odd_docs, head):
    """All lengths of contexts, wherever the border between broadcast and joined terms lies."""
    docs = small.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    texts = [suffix_tree.tokens((r["text"] or "").encode()) for r in rows]
    tree = Brute([x for r, x in zip(rows, texts, strict=True) if not suffix_tree.is_held_out(r["doc_id"])], suffix_tree.DEPTH)
    assert {len(c) for c in tree.stays} == set(range(1, suffix_tree.DEPTH + 1))
    expected = sorted((str(r["doc_id"]), sum(math.log10(tree.p(w, tuple(x[max(0, i - suffix_tree.DEPTH) : i]))) for i, w in enumerate(x))) for r, x in zip(rows, texts, strict=True))
    got = sorted((str(r["doc_id"]), r["score"]) for r in suffix_tree.score(docs, least=4, head_strings=head).collect())
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose([g[1] for g in got], [e[1] for e in expected], rtol=1e-6, atol=1e-6)
    if head:
        return
    words = [s[0] for s in tree.counts if len(s) == 1]
    for context in sorted(tree.stays, key=lambda c: (-len(c), c))[:20]:
        unseen = 1 - sum(tree.p(x, ()) for x in words)
        given = sum(tree.p(x, context) for x in words)
        far = math.prod(tree.stays[context[i:]][1] for i in range(len(context)) if context[i:] in tree.stays)
        assert given + unseen * far == pytest.approx(1, abs=1e-6)


def test_keys_tell_contexts_and_counts_are_packed(spark, small, monkeypatch):
    """Frequent strings by dictionaries of keys, although no row of a shuffle names a context or one string."""
    train = [r["text"] for r in small.collect() if not suffix_tree.is_held_out(r["doc_id"])]
    every = np.full(1 << 13, 255, np.uint8)
    own = suffix_tree.Strings([suffix_tree.tokens((t or "").encode()) for t in train], 5, every, None)
    counts = Counter()
    for n in range(2, 6):
        at, keys = own.ends[n - 1], own.keys[n - 1]
        contexts = own.at(n - 1, at - 1)
        shorter = own.at(n - 2, at - 1) if n > 2 else contexts
        assert (suffix_tree.suffixes(keys, contexts, shorter, n) == own.at(n - 1, at)).all()
        bits = 32 - suffix_tree._length_bits(4)
        counts.update(zip(keys.view(np.int64).tolist(), [n] * len(keys), (contexts & np.uint64((1 << bits) - 1)).tolist(), strict=True))
    monkeypatch.setattr(suffix_tree, "HELD_COUNTS", 20_000)  # several times a task
    monkeypatch.setattr(suffix_tree, "BLOCK", 100_000)
    total, docs = len(own.x), small.repartition(3)
    got = {(r["key"], r["length"], r["hint"]): r["n"] for r in suffix_tree.frequent_strings(docs, every, every, 4, total, 3).collect()}
    assert got == {k: n for k, n in counts.items() if n >= 3}
    cells = {r["key"] for r in suffix_tree.frequent_pairs(docs, every, total, 3).collect()}
    width = max(27, math.ceil(math.log2(8 * total + 1)))
    summed = Counter()
    for (key, n, _), times in counts.items():
        if n == 2:
            summed[key & (1 << width) - 1] += times
    assert cells == {c for c, times in summed.items() if times >= 3}
    parts = [(np.unique(own.keys[2]), np.ones(len(np.unique(own.keys[2])), np.int32))]
    rows = pa.Table.from_batches(suffix_tree._dealt(parts, 58))
    assert rows.num_rows == 64 and (np.concatenate([np.cumsum(x) + np.uint64(r << 58) for x, r in zip(suffix_tree._read(rows["keys"], np.uint64), rows["range"].to_pylist(), strict=True)]) == parts[0][0]).all()


def test_text_ids_and_depth(spark, odd_docs):
    named = odd_docs.withColumn("doc_id", odd_docs["doc_id"].cast("string"))
    for depth in (1, 5):
        got = {r["doc_id"] for r in suffix_tree.score(named, depth=depth, least=2).collect()}
        assert got == {None, *map(str, range(1, 10))}


def test_tree_beats_unigrams_on_held_out(spark):
    held = suffix_tree.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > held[1]


# Chat


def test_chat_against_sql(spark, sf):
    got = chat.op6_chat_parts(spark, sf).collect()
    conversations = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()  # noqa: F841
    expected = duckdb.sql(chat.OP6_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "[OUT]\\</s>"), (2, 0, "to\nol</s>", "<|image|> \\\\ [/ROLE]"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie")]
    turns = chat.plain_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\n\nx\n") and got[1]["loss_chars"] == 0
    assert got[None]["loss_sha256"] == sha("[OUT]\\</s>")
    assert got[2]["turns_sha256"] == sha("assistant\ntie\nassistant\ntie\nto\nol</s>\n<|image|> \\\\ [/ROLE]\n")
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
    for row in chat.format_turns(turns).collect():
        inner = row["formatted"][row["loss_start"] : row["loss_end"]]
        assert not any(mark in inner for mark in chat.CONTROLS)


def test_typed_parts(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [part(type="text", text="see "), part(type="image", ref="a.png", width=56, height=30), part(type="audio", ref="b.wav", seconds=1.5), part(type="document", ref="c.pdf", pages=2), part(type="video", ref="d"), part(type="text", text=" <|image|>")]
    row = chat.format_turns(spark.createDataFrame([(1, 0, "user", parts)], chat.TURNS)).first()
    assert row["formatted"] == "<s>[INST]see <|image|><|audio|><|document|><|attachment|> <\\|image|>[/INST]"
    assert [tuple(a) for a in row["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 2048), ("video", "d", 0)]


def test_odd_parts_and_text_ids(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [None, part(type="audio", seconds=float("nan")), part(type="audio", seconds=float("inf")), part(type="image", width=-3, height=9), part(type="document"), part(), part(type="text")]
    turns = spark.createDataFrame([("c1", 0, "user", parts), ("c1", 1, "user", None), (None, 0, "user", [None])], chat.TURNS.replace("conv_id long", "conv_id string"))
    rows = {(r["conv_id"], r["turn_no"]): r for r in chat.format_turns(turns).collect()}
    assert [a["tokens"] for a in rows["c1", 0]["attachments"]] == [0] * 5
    assert rows["c1", 1]["formatted"] == "[INST][/INST]" and rows[None, 0]["formatted"] == "<s>[INST][/INST]"
    plain = chat.plain_turns(spark.createDataFrame([("x", 0, "user", "hi")], "conv_id string, turn long, role string, text string"))
    assert [(r["conv_id"], r["n_turns"]) for r in chat.read_back(chat.format_turns(plain)).collect()] == [("x", 1)]


# Url rules


def test_url_rules_against_sql(spark, sf):
    got = url_rules.op7_url_sweep(spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").toPandas()  # noqa: F841
    cut = duckdb.sql(url_rules.OP7_SQL).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in cut) or sorted(map(str, map(tuple, got))) == sorted(map(str, cut))


def test_url_rules_nested_and_odd(spark):
    draw = random.Random(2)
    labels, paths = ["a", "b", "c", "com"], ["/", "/x", "/x/y", "", "/y/"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    rules = list({(h, p): (draw.choice(["allow", "block"]), h, p) for h, p in ((host(), draw.choice(paths)) for _ in range(60))}.values())
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.com?x", "x://y://z/x#q", "http://a.b\n.com/x\ny"] + [f"http://{host()}{draw.choice(paths)}{draw.choice(['', 'z', '?q', '#f'])}" for _ in range(400)] + ["http://c.com/x"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    frame = spark.createDataFrame(rules, "action string, host string, path string")
    assert url_rules.judge(pages.limit(0), frame).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, frame.limit(0)).collect()} == {"allow"}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, frame).collect()}
    for k, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        h = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(h) :])[0]
        h = h.lower()
        fits = [(len(rh.split(".")), len(rp), rh + rp, action) for action, rh, rp in rules if (h == rh or h.endswith("." + rh)) and path.startswith(rp)]
        best = max(fits, default=None)
        assert got[k] == (h, path, best[2] if best else None, best[3] if best else "allow")


# Matroska


def test_matroska_round_trip(spark, odd_docs, no_docs):
    rows = matroska.read_back(matroska.store(odd_docs)).collect()
    assert len(rows) == 11
    for r in rows:
        text = dict((i, t) for i, t in ODD)[r["doc_id"]] or ""
        payload = text.encode() + b" " * (-len(text.encode()) % 192 if text else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-16:]))
        assert r["feature"].endswith("error=-")
    assert matroska.read_back(matroska.store(no_docs)).count() == 0
    packets = matroska.packet_table(matroska.store(odd_docs.where("doc_id = 9"))).orderBy("packet").collect()
    assert [p["ms"] for p in packets] == [10.0 * k for k in range(27)] and sum(p["length"] for p in packets) == 27 * 192


def test_matroska_lacing_groups_and_unknown_sizes():
    m, draw = matroska, random.Random(4)
    frames = [bytes([draw.randrange(256)]) * draw.choice([1, 60, 254, 255, 256, 700, 20_000]) for _ in range(9)]
    same = [b"ab"] * 4
    unknown = bytes([0x01]) + b"\xff" * 7
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.laced_block([b"p"], 7, 0)) + m.number(0xFB, 1))
    cluster = lambda ticks, *blocks: m.CLUSTER.to_bytes(4, "big") + unknown + m.number(m.CLUSTER_TIMESTAMP, ticks) + b"".join(blocks)
    track = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1) + m.number(m.DEFAULT_DURATION, 2_000_000)))
    body = (
        m.element(0xEC, b"void") + track
        + cluster(1000, m.element(m.SIMPLE_BLOCK, m.laced_block(frames, 5, m.XIPH)), m.element(m.SIMPLE_BLOCK, m.laced_block(frames, -5, m.LACED_EBML)))
        + cluster(2000, m.element(m.SIMPLE_BLOCK, m.laced_block(same, 0, m.FIXED)), group)
    )
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska")) + m.SEGMENT.to_bytes(4, "big") + unknown + body
    found = m.parse(data)
    assert found.error is None and found.clusters == 2
    assert [data[a : a + n] for _, _, a, n, _, _ in found.packets] == frames + frames + same + [b"p"]
    assert [p[1] for p in found.packets][:3] == [1005, 1007, 1009] and found.packets[-1][1] == 2007
    assert found.packets[0][4] and not found.packets[-1][4]
    assert m.parse(data[:-20]).error and m.parse(b"").packets == [] and m.parse(b"\x00junk").error
    whole = m.parse(m.mux(bytes(192 * 600)))
    assert len(whole.cues) == 3 and all(m.mux(bytes(192 * 600))[at : at + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, at in whole.cues)


# Language


def test_gradient_against_differences():
    model = language.ByteTagger.fresh(["a", "b", "c"], 5)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    runs = [b"abc", b"de", b"f", b"ghij"]
    cells, reach, inner = language.padded(runs)
    answer = np.array([0, 1, 2, 1])[inner]
    grad, _ = model.gradient(cells, reach, answer)
    draw = np.random.default_rng(0)
    for name, g in grad.items():
        w = model.weights[name]
        spots = [tuple(x) for x in np.argwhere(np.abs(g) > np.abs(g).max() / 10)]
        for spot in [spots[i] for i in draw.integers(0, len(spots), 4)]:
            eps, old = 1e-3, w[spot]
            w[spot] = old + eps
            up = model.gradient(cells, reach, answer)[1]
            w[spot] = old - eps
            down = model.gradient(cells, reach, answer)[1]
            w[spot] = old
            assert g[spot] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4)


def test_language_held_out_and_odd(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.98 * len(rows)
    odd = language.identify(odd_docs, model).collect()
    assert len(odd) == 11 and {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {1, 2, 3, 8}
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert len({(r["lang_pred"], r["score"]) for r in odd if r["doc_id"] in (4, 5)}) == 1
    kept = language.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {r["doc_id"] for r in kept.collect()} & {1, 2, 3, 8}
    assert language.identify(no_docs, language.train(no_docs)).count() == 0
    assert all(r["lang_pred"] == "und" for r in language.identify(odd_docs, language.train(no_docs)).collect())
    assert language.keep_identified(no_docs, model).count() == 0


def test_texts_are_read_as_one_by_one():
    model = language.ByteTagger.fresh(["a", "b"], 6)
    texts = [b"abc", b"x, 12", b"yz \xc3\xa9" * 90, b"", b"abc"]
    together, letters = model.letter_sums(texts, block=2)
    assert letters.tolist() == [3, 1, 360, 0, 3]
    for k, text in enumerate(texts):
        assert np.allclose(together[k], model.letter_sums([text])[0][0], atol=1e-4)
        assert len(model.label_positions(text)) == len(text)
    assert not np.allclose(together[1], model.letter_sums([b"x, 99 other"])[0][0])
    # A window's neighbours are read: its first labels are those of a reading that begins CONTEXT bytes before.
    text = bytes(97 + k * k % 26 for k in range(300))
    cells, reach, _ = language.padded([text[128 - 16 : 256 + 16]])
    assert model.label_positions(text)[128:256] == [model.languages[i] for i in model.positions(cells, reach)[16:144, :, 0].argmax(axis=1)]
