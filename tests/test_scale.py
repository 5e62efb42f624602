"""What spreads a hot file, key or string over tasks gives what the plain form gives."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.operators import bursts, cases, correlate, detections, durable, graph, iocs, needles, normalize, quantiles, search, snapshots
from emberlog.plans import detect_queries
from emberlog.schema import EVENT
from emberlog.sources import delimited, lines
from tests.test_operators import event


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("segment", [3, 50, 1 << 17])
def test_segmented_fill_and_skew(spark, monkeypatch, segment):
    monkeypatch.setattr(normalize, "SEGMENT", segment)
    draw = random.Random(segment)
    rows = [("a", i, draw.choice([None, None, None, 1000 + draw.randrange(500)])) for i in range(60)]
    rows += [("b", i, None if i < 25 else 2000 + i) for i in range(40)] + [("c", i, None) for i in range(5)] + [(None, i, 5 if i == 2 else None) for i in range(4)]
    frame = spark.createDataFrame(rows, "file string, id_seq long, at long").select("file", "id_seq", F.timestamp_seconds("at").alias("ts"))
    want, skews = [], {}
    for name in ("a", "b", "c", None):
        own = [at for file, _, at in rows if file == name]
        known = [at for at in own if at is not None]
        last = known[0] if known else None
        for i, at in enumerate(own):
            last = at if at is not None else last
            want.append((name, i, last))
        if known:
            skews[name] = max(0, *(a - b for a, b in zip(known, known[1:], strict=False)), 0)
    got = normalize.forward_fill(frame).select("file", "id_seq", F.unix_timestamp("ts")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["file"]: r["skew_seconds"] for r in normalize.clock_skew(frame).collect()} == skews


@pytest.mark.parametrize("scan", [1, 7, 60, 1 << 20])
def test_grams_of_many_texts_at_once(monkeypatch, scan):
    monkeypatch.setattr(needles, "SCAN_BYTES", scan)
    draw = random.Random(scan)
    texts = [draw.choice([None, "", "".join(draw.choice("ab\u00e90") for _ in range(draw.randrange(30)))]) for _ in range(50)]
    sieve = np.array([draw.random() < 0.5 for _ in range(1 << 12)], np.uint8)
    monkeypatch.setattr(needles, "SLOT_BITS", 12)
    for lengths in ([], [1], [2, 6], [1, 3, 4, 5, 6]):
        rows, grams = needles._postings(pa.array(texts, pa.string()).slice(2), lengths, sieve)
        plain = [(i, int(g)) for i, x in enumerate(texts[2:]) for n in lengths for g in needles._grams((x or "").encode(), n) if sieve[needles._slots(np.array([g]), 12)[0]]]
        assert sorted(zip(rows.tolist(), grams.tolist(), strict=True)) == sorted(plain)


@pytest.mark.parametrize("turned", [False, True])
def test_skew_of_records_of_one_number(spark, turned):
    rows = [("a", 1, 100), ("a", 1, 900), ("a", 2, 880), ("a", 2, 950), ("a", 3, None), ("a", 3, 1000)]
    frame = spark.createDataFrame(rows[::-1] if turned else rows, "file string, id_seq long, at long").coalesce(1)
    assert normalize.clock_skew(frame.select("file", "id_seq", F.timestamp_seconds("at").alias("ts"))).first()["skew_seconds"] == 20


def test_one_file_spreads(spark, monkeypatch):
    monkeypatch.setattr(normalize, "SEGMENT", 1000)
    frame = spark.range(20_000).select(F.lit("one").alias("file"), F.col("id").alias("id_seq"), F.timestamp_seconds(F.when(F.col("id") % 700 == 5, F.col("id"))).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in normalize.forward_fill(frame.repartition(4)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 12_000


@pytest.mark.parametrize("window", [0, 5, 40])
def test_bursts_of_one_key_over_many_slices(spark, window):
    draw = random.Random(window)
    rows = [(i, 1000 + draw.randrange(900)) for i in range(700)]
    frame = spark.createDataFrame([event(i, e, user="hot") for i, e in rows], EVENT)
    own, best = sorted((e, i) for i, e in rows), None
    for n, (e, i) in enumerate(own):
        inside = [x for x in own[: n + 1] if x[0] >= e - window]
        if len(inside) >= 2 and (best is None or len(inside) > best[2]):
            best = (f"e{i}", e, len(inside), f"e{inside[0][1]}", inside[0][0])
    assert pairs(bursts.find_bursts(frame, F.col("user"), window, 2)) == [("hot", *best)]
    assert pairs(bursts.find_bursts(frame, F.col("user"), window * 10, F.lit(2), F.lit(10))) == [("hot", *best)]


def peeled(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        k = max(k, min(map(len, near.values())))
        for node in [n for n, x in near.items() if len(x) <= k]:
            core[node] = k
            for other in near.pop(node):
                if other in near:
                    near[other].discard(node)
    return core


def test_core_numbers_equal_peeling(spark):
    draw = random.Random(4)
    edges = [(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for _ in range(150)] + [(f"p{i}", f"p{i + 1}") for i in range(12)] + [("hub", f"leaf{i}") for i in range(30)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    want = peeled(edges)
    assert {r["node"]: r["core"] for r in graph.core_numbers(frame).collect()} == want
    for least in (2, 4):
        assert {x for r in graph.k_core(frame, least).collect() for x in r} == {n for n, k in want.items() if k >= least}
    with pytest.raises(RuntimeError):
        graph.core_numbers(frame, most_rounds=1)
    assert graph.core_numbers(frame.limit(0)).count() == 0


NEEDLES = ["u1", "u12", "12", "a", "é", "long needle text", "needle", "http://x.example/path", "漢字", "not there at all", "\x00", "zz"]


@pytest.mark.parametrize("way", ["automaton", "grams"])
def test_needles(spark, way):
    draw = random.Random(1)
    texts = [(i, "".join(draw.choice([*NEEDLES[:9], " ", "x", "y"]) for _ in range(draw.randrange(8)))) for i in range(200)] + [(900, None), (901, ""), (902, "x" * 30_000 + "zz"), (903, "\x00")]
    want = sorted((i, n) for i, t in texts for n in NEEDLES if t and n in t)
    frame = spark.createDataFrame(texts, "id long, text string").repartition(3)
    if way == "automaton":
        got = needles.by_automaton(frame, [*NEEDLES, ""])
    else:
        given = spark.createDataFrame([("", n) for n in [*NEEDLES, ""]] + [(None, "x"), ("elsewhere", "x")], "scope string, needle string")
        got = needles.by_grams(frame.withColumn("scope", F.lit("")), given).select("id", "needle")
    assert pairs(got) == want


@pytest.mark.parametrize("most_bytes", [needles.AUTOMATON_BYTES, 0])
def test_indicators_both_ways(spark, most_bytes):
    rows = [event(i, raw=f"from 10.0.{i % 7}.{i} u{i}", msg="login" if i % 2 else "", fields={"p": f"/x/{i}", "n": None}, entities=[f"u{i % 5}", "lb"]) for i in range(60)]
    frame = spark.createDataFrame(rows, EVENT)
    given = [("ip", "10.0.3"), ("user", "u3"), ("path", "/x/1"), ("other", "u3"), ("msg", "login"), ("ent", "lb"), ("none", "zzz"), ("empty", ""), ("null", None)]
    manual = spark.createDataFrame(given * 2, "kind string, value string")
    want = sorted((r[0], k, v) for r in rows for k, v in given if v and (v in r[10] or v in r[8] or any(x and v in x for x in r[11].values()) or v in r[12]))
    assert pairs(iocs.locate(frame, manual, most_bytes).select("id", "kind", "value")) == want


def test_a_hundred_thousand_indicators(spark):
    frame = spark.createDataFrame([event(i, raw=f"client node-{i * 37:07d} asked") for i in range(300)], EVENT)
    manual = spark.range(100_000).select(F.lit("node").alias("kind"), F.format_string("node-%07d", "id").alias("value"))
    assert iocs.locate(frame, manual).count() == 300
    assert iocs.locate(frame, manual, 0).count() == 300


def test_locations(spark):
    rows = [event(0, raw="alpha beta"), event(1, raw="  gamma delta "), event(2, raw="cut " + "y" * 500), event(3, raw="gone"), event(4, raw=""), event(5, raw="alpha"), event(6, raw="other file", file="b.log")]
    numbered = [("a.log", 1, "prefix alpha beta suffix"), ("a.log", 2, "alpha beta"), ("a.log", 3, "gamma delta"), ("a.log", 4, "<1> cut " + "y" * 600), ("a.log", 5, ""), ("a.log", 6, "alpha beta"), ("a.log", 7, "other file")]
    got = cases.locate(spark.createDataFrame(rows, EVENT), spark.createDataFrame(numbered, "file string, id_seq long, raw string"))
    assert pairs(got) == [("e0", 2, True), ("e1", 3, True), ("e2", 4, False), ("e5", 1, False)]


def test_positions_are_written_once(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x" * 50).alias("wide"))
    got = search.positions(frame.repartition(5), [F.col("v")]).select("v", "pos").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["pos"])] == sorted(r["v"] for r in got) and len({r["pos"] for r in got}) == 5000


def test_delimiters_of_all_lines(spark):
    rows = [("f", i, "a,b,c") for i in range(200)] + [("f", i, "a;b;c;d") for i in range(200, 700)]
    guess = delimited.delimiter_guess(spark.createDataFrame(rows, "file string, id_seq long, raw string")).first()
    assert (guess["delimiter"], guess["columns"]) == (";", 4)


def test_exploding_entities_of_unwritten_events(spark):
    """The filter that an explode implies must not spell out the parser for every use of a field."""
    raw = F.format_string('10.0.0.%d - u%d [10/Aug/2026:03:09:41 +0000] "GET /x HTTP/1.1" 200 5 "-" "agent"', F.col("id") % 9, F.col("id") % 9)
    log = spark.range(200).select(F.lit("f").alias("file"), F.col("id").alias("id_seq"), raw.alias("raw"))
    exploded = normalize.normalize(lines.access_log(log, 2026), "nginx.access").select(F.explode("entities").alias("e"))
    began = time.perf_counter()
    assert len(exploded._jdf.queryExecution().optimizedPlan().toString()) < 150_000
    assert Counter(r["e"] for r in exploded.collect())["u3"] == 22
    assert time.perf_counter() - began < 40


@pytest.mark.parametrize("seed,listed", [(0, 6), (1, 6), (2, 2)])
def test_related_events_against_all_pairs(spark, monkeypatch, seed, listed):
    """Posting lists cut by a bound give the ranking of all pairs, wide events and events without time included."""
    monkeypatch.setattr(correlate, "LISTED_ENTITIES", listed)
    monkeypatch.setattr(correlate, "LIST_SLICE", 40)
    draw = random.Random(seed)
    rows = []
    for i in range(160):
        names = sorted({f"e{draw.choice([0, 0, 0, 1, 1, 2, 3, 4, 5, 6, 7])}" for _ in range(draw.randrange(5))})
        hits = sorted({draw.choice(["R1", "R2", "R3"]) for _ in range(draw.choice([0, 0, 1, 2]))})
        rows.append(event(i, draw.choice([None, 1000 + draw.randrange(600), 1000 + draw.randrange(20)]), sev=draw.choice(["info", "high", "high", "low"]), entities=names, hits=hits))
    frame = spark.createDataFrame(rows, EVENT)
    count = Counter(e for r in rows for e in r[12])
    generic = {e for e, n in count.items() if n > 0.5 * len(rows)}
    rank = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
    seen = [(r[0], None if r[2] is None else r[2].timestamp(), set(r[12]) - generic, {h[0] for h in r[13]}, rank[r[9]]) for r in rows]
    want = []
    for f in seen[::5]:
        found = []
        for o in seen:
            if o[0] == f[0]:
                continue
            shares, same = len(f[2] & o[2]), int(bool(f[3] & o[3]))
            dt = None if f[1] is None or o[1] is None else abs(f[1] - o[1])
            if shares or same or (dt is not None and dt <= 90):
                found.append((-(2 * shares + 3 * bool(o[3]) + same), -o[4], (dt is None, dt or 0), o[0], shares))
        want += [(f[0], o, place, -score, shares) for place, (score, _, _, o, shares) in enumerate(sorted(found)[:7], 1)]
    got = correlate.correlations(frame, frame.where("id_seq % 5 = 0")).select("event", "other", "place", "score", "shares")
    assert pairs(got) == sorted(want)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_percentiles_by_narrowing(spark, p):
    draw = random.Random(1)
    rows = [("hot", draw.choice([draw.random() * 1e9, float(draw.randrange(5)), -3.5])) for _ in range(3000)] + [("same", 7.0)] * 400 + [("few", float(i)) for i in range(10)] + [("one", 1.5), (None, 2.0), ("few", None)]
    frame = spark.createDataFrame(rows, "key string, value double").repartition(4)
    want = {r["key"]: (r["v"], r["n"]) for r in frame.where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.percentile("value", p).alias("v"), F.count("*").alias("n")).collect()}
    for few in (50, 100_000):
        got = {r["key"]: (r["percentile"], r["n"]) for r in quantiles.percentile(frame, p, few).collect()}
        assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()}
        assert all(got[k][0] == pytest.approx(want[k][0], rel=1e-12) for k in want)


def test_versions_of_several_sources(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    rows = lambda *own: spark.createDataFrame([(s, i, t) for s, n, t in own for i in range(n)], "source_id string, id long, text string")
    seen = lambda v=None: {(r["source_id"], r["text"]): r["count"] for r in snapshots.read(spark, path, v).groupBy("source_id", "text").count().collect()}
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    assert snapshots.commit(rows(("a", 3, "old"), ("b", 2, "old"), ("c", 1, "old")), path) == 1
    opened = snapshots.read(spark, path)
    assert snapshots.commit(rows(("a", 5, "new"), ("b", 4, "new")), path) == 2
    assert seen() == {("a", "new"): 5, ("b", "new"): 4, ("c", "old"): 1}
    assert seen(1) == {("a", "old"): 3, ("b", "old"): 2, ("c", "old"): 1} and opened.count() == 6
    # A commit that dies while it writes its rows, and one that dies while it writes its manifest.
    broken = rows(("a", 9, "lost"), ("b", 9, "lost")).withColumn("text", F.when(F.col("source_id") == "b", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        snapshots.commit(broken, path)
    (tmp_path / "events/manifests/3").mkdir()
    assert snapshots.versions(spark, path) == [1, 2] and seen() == {("a", "new"): 5, ("b", "new"): 4, ("c", "old"): 1}
    assert snapshots.commit(rows(("d", 1, "new")).limit(0), path, removed=["a"]) == 4
    assert seen() == {("b", "new"): 4, ("c", "old"): 1}
    assert snapshots.commit(rows(("c", 2, "new")), path) == 5
    assert len(snapshots.vacuum(spark, path, 1)) == 3 and snapshots.versions(spark, path) == [5]
    assert seen() == {("b", "new"): 4, ("c", "new"): 2}


def test_rule_fields_are_looked_up_once(spark):
    """Rules read columns that were written once; no scan of the many looks fields up in the map again."""
    rows = [(f"e{i}", i, None, "firewall", "h", "u", "m", "m", "info", {"src_ip": "9.9.9.9", "action": "allow", "bytes": "7"}, []) for i in range(5)]
    frame = spark.createDataFrame(rows, "id string, id_seq long, ts timestamp, source string, host string, user string, msg string, raw string, sev string, fields map<string,string>, detections array<struct<id:string,name:string,level:string>>")
    found = detections.hits(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "fields#" not in plan and "prepared" in "".join(found.inputFiles())
    assert found.count() == 0


def test_wide_projections_are_small_methods(spark):
    """A session's default is changed once, a user's own limit never."""
    key, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        spark.conf.set(key, "65535")
        durable.compiled(spark.range(1))
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "12345")
        durable.compiled(spark.range(1))
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.set(key, before)


def linked_events(spark):
    """Events of two hosts, accounts and files, with outcomes and reasons that differ within an edge."""
    draw = random.Random(5)
    words = ["Accepted password for {}", "Failed password for {}", "wrote /tmp/{}", "read /tmp/{}"]
    rows = [event(i, 1_700_000_000 + draw.randrange(50), draw.choice(["syslog", "app"]), user=(u := draw.choice(["ann", "bob"])), host=draw.choice(["web-1", "web-2"]), msg=(m := draw.choice(words).format(u)), raw=m, fields=draw.choice([{}, {"src_ip": "45.83.1.2"}, {"src_ip": "45.83.1.2", "dst": "45.83.1.2", "program": "sshd"}])) for i in range(300)]
    return spark.createDataFrame(rows, EVENT).withColumn("file", F.concat(F.lit("f"), F.col("id_seq") % 3))


def test_figures_of_nodes_and_edges_from_counts(spark):
    """Nodes and edges by counts of alike events are those of the events themselves; what is not asked for is not made."""
    extracted = graph.extract(linked_events(spark)).cache()
    per_node, per_edge = graph.event_nodes(extracted).collect(), graph.event_edges(extracted).collect()
    by_node, by_edge = {}, {}
    for r in per_node:
        by_node.setdefault(r["node"], []).append(r)
    for r in per_edge:
        by_edge.setdefault((r["src"], r["dst"], r["rel"]), []).append(r)
    figures = lambda own: (len(own), min(r["ts"] for r in own), max(r["ts"] for r in own), max(r["rank"] for r in own))
    want = {n: (*figures(own), min(r["id_seq"] for r in own), dict(Counter(r["file"] for r in own)), dict(Counter(r["source"] for r in own))) for n, own in by_node.items()}
    full, lean, one = (graph.nodes(graph.event_nodes(extracted), by=by) for by in (("source", "file"), (), ("file",)))
    part = lambda r: tuple(r[c] for c in ("count", "first_ts", "last_ts", "rank", "first_seq"))
    assert {r["node"]: (*part(r), r["by_file"], r["by_source"]) for r in full.collect()} == want
    assert {r["node"]: part(r) for r in lean.collect()} == {n: w[:5] for n, w in want.items()} and not {"by_file", "by_source"} & set(lean.columns)
    assert {r["node"]: (*part(r), r["by_file"]) for r in one.collect()} == {n: w[:6] for n, w in want.items()}
    reason = lambda own: min(Counter(r["why"] for r in own).items(), key=lambda x: (-x[1], x[0]))[0]
    first = lambda own: [r["id"] for r in sorted(own, key=lambda r: (r["ts"], r["id_seq"]))[:20]]
    want = {e: (*figures(own), sorted({r["outcome"] for r in own} - {""}), reason(own), sorted({r["file"] for r in own}), first(own)) for e, own in by_edge.items()}
    assert any(len(w[4]) > 1 for w in want.values()) and len({w[5] for w in want.values()}) > 4
    told = lambda r: (*(r[c] for c in ("count", "first_ts", "last_ts", "rank", "outcomes", "why", "files")),)
    assert {(r["src"], r["dst"], r["rel"]): (*told(r), r["event_ids"]) for r in graph.edges(graph.event_edges(extracted)).collect()} == want
    lean = graph.edges(graph.event_edges(extracted), sample=0)
    assert {(r["src"], r["dst"], r["rel"]): told(r) for r in lean.collect()} == {e: w[:7] for e, w in want.items()}
    assert "Window" not in lean._jdf.queryExecution().optimizedPlan().toString()
    extracted.unpersist()


@pytest.mark.parametrize("name", ["graph_find", "graph_rank_top", "graph_coverage_by_file"])
def test_graph_queries_make_no_figures_in_vain(spark, sf, monkeypatch, name):
    """Ranks need neighbours, not figures of edges; files of edges need no first events; nodes are made once."""
    made, nodes, edges = [], graph.nodes, graph.edges
    monkeypatch.setattr(graph, "nodes", lambda *a, **how: made.append("nodes") or nodes(*a, **how))
    monkeypatch.setattr(graph, "edges", lambda *a, **how: made.append(f"edges, {how.get('sample', 20)} events each") or edges(*a, **how))
    assert detect_queries.QUERIES[name](spark, sf).count() > 0
    assert made == (["nodes", "edges, 0 events each"] if name == "graph_coverage_by_file" else ["nodes"])


def test_fields_of_rules_from_one_copy(spark, tmp_path):
    """All fields of rules from one copy of a map, as looked up one by one; null where they are not asked for."""
    draw = random.Random(3)
    names = [*detections.FIELDS[:6], "k", "other"]
    rows = [event(i, 1_700_000_000, fields=None if i == 5 else {n: draw.choice(["", "x", "401"]) for n in names if draw.random() < 0.5}) for i in range(60)]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "events"))
    frame, even = spark.read.parquet(str(tmp_path / "events")), F.col("id_seq") % 2 == 0
    own = lambda df: {r["id"]: tuple(r[f"f_{n.replace('.', '_')}"] for n in detections.FIELDS) for r in df.collect()}
    plain, none = own(detections.prepared(frame)), (None,) * len(detections.FIELDS)
    assert own(detections._spread_fields(frame)) == plain and len(set(plain.values())) > 20
    assert own(detections._spread_fields(frame, even)) == {k: v if int(k[1:]) % 2 == 0 else none for k, v in plain.items()}
    assert detections._spread_fields(frame).drop(*[f"f_{n.replace('.', '_')}" for n in detections.FIELDS]).columns == frame.columns
