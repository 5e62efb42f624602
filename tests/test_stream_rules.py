"""Rules on a stream: alerts in several batches, out of order and late, against the batch rules."""

import os
import random

from emberlog.operators import detections
from emberlog.operators.bursts import SLICE_WINDOWS
from emberlog.schema import EVENT
from emberlog.streaming import rules
from tests.test_operators import event

DELAY = 40
RULES = detections.catalogue(SIGMA_WEB_0042={"window": 10, "threshold": 3}, SIGMA_AUTH_0111={"within": 30})


def failed(i, at, ip):
    return event(i, at, "nginx.access", fields={"src_ip": ip, "http.status": "401", "http.path": "/x", "http.method": "GET"})


def login(i, at, ip):
    return event(i, at, "nginx.access", fields={"src_ip": ip, "http.status": "200", "http.path": "/login", "http.method": "POST"})


def arrivals(seed):
    """Batches that move on in time, each mixed, with some rows that come far too late."""
    draw, batches, i = random.Random(seed), [], 0
    for k in range(5):
        batch = []
        for _ in range(70):
            at = 1_786_000_000 + 60 * k + draw.randrange(75) - (150 if draw.random() < 0.06 else 0)
            ip = draw.choice(["hot", "hot", "hot", "b", "c"])
            batch.append((login if draw.random() < 0.2 else failed)(i, at, ip))
            i += 1
        batches.append(batch)
    return batches


def written(spark, batches, path):
    """A file for each batch, in the order of their times of writing."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENT).coalesce(1).write.parquet(f"{path}/batch={k}")
        for name in os.listdir(f"{path}/batch={k}"):
            os.utime(f"{path}/batch={k}/{name}", (1_700_000_000 + k,) * 2)
    return f"{path}/batch=*"


def on_time(batches):
    """The rows that are later than the watermark of the batches before theirs, and the others."""
    good, late, top = [], [], None
    for batch in batches:
        for row in batch:
            at = row[2].timestamp()
            (late if top is not None and at <= top - DELAY else good).append(row)
        top = max(row[2].timestamp() for row in batch) if top is None else max(top, *(row[2].timestamp() for row in batch))
    return good, late


def batch_hits(spark, rows):
    found = detections.bursts(detections.prepared(spark.createDataFrame(rows, EVENT)), RULES)
    columns = ["rule_id", "key", "id", "epoch", "count", "first_id", "first_epoch"]
    return found.select(columns), columns


def test_replayed_alerts_are_the_batch_hits_and_late_rows_are_named(spark, tmp_path):
    batches = arrivals(1)
    good, late = on_time(batches)
    assert late
    path = written(spark, batches, str(tmp_path / "in"))
    alerts = rules.replay(spark, path, EVENT, str(tmp_path / "out"), lambda ev: rules.burst_alerts(ev, RULES, f"{DELAY} seconds"), files=1)
    want, columns = batch_hits(spark, good)
    assert sorted(map(tuple, rules.densest(alerts).select(columns).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r["id"] for r in alerts.where("kind = 'late'").collect()) == sorted(row[0] for row in late)
    # Read in one batch, nothing is late.
    whole = rules.replay(spark, path, EVENT, str(tmp_path / "whole"), lambda ev: rules.burst_alerts(ev, RULES, f"{DELAY} seconds"))
    assert sorted(map(tuple, rules.densest(whole).select(columns).collect())) == sorted(map(tuple, batch_hits(spark, [r for b in batches for r in b])[0].collect()))


def test_logins_after_a_burst_join_on_the_stream(spark, tmp_path):
    batches = arrivals(3)
    good, _ = on_time(batches)
    path = written(spark, batches, str(tmp_path / "in"))
    pairs = rules.replay(spark, path, EVENT, str(tmp_path / "out"), lambda ev: rules.followed_logins(ev, RULES, f"{DELAY} seconds"), files=1)
    hits, _ = batch_hits(spark, good)
    anchors = {r["key"]: r["epoch"] for r in hits.where(hits["rule_id"] == rules.ANCHOR).collect()}
    follows = lambda rows: {r[0] for r in rows if r[11]["http.status"] == "200" and r[11]["src_ip"] in anchors and 0 <= r[2].timestamp() - anchors[r[11]["src_ip"]] <= 30}
    got = {r["id"] for r in rules.settled_logins(pairs, hits).collect()}
    assert follows(good) and follows(good) <= got <= follows([r for b in batches for r in b])


def test_logins_join_alerts_that_were_written_and_are_watched_in_few_groups(spark, tmp_path):
    """The alerts' state is kept once, and a login is no group of its own."""
    batches = arrivals(5)
    rows = [r for b in batches for r in b]
    path = written(spark, batches, str(tmp_path / "in"))
    delay = f"{DELAY} seconds"
    alerts = rules.replay(spark, path, EVENT, str(tmp_path / "alerts"), lambda ev: rules.burst_alerts(ev, RULES, delay, [rules.ANCHOR]))
    before = rules.written_alerts(spark, str(tmp_path / "alerts"))
    pairs = rules.replay(spark, path, EVENT, str(tmp_path / "logins"), lambda ev: rules.followed_logins(ev, RULES, delay, before))
    hits, _ = batch_hits(spark, rows)
    anchors = {r["key"]: r["epoch"] for r in hits.where(hits["rule_id"] == rules.ANCHOR).collect()}
    want = sorted(r[0] for r in rows if r[11]["http.status"] == "200" and r[11]["src_ip"] in anchors and 0 <= r[2].timestamp() - anchors[r[11]["src_ip"]] <= 30)
    assert want and sorted(r["id"] for r in rules.settled_logins(pairs, rules.densest(alerts)).collect()) == want
    assert pairs.count() == pairs.distinct().count()
    marked = rules.listed(spark.createDataFrame([login(k, 1_786_000_000 + 8 * k, "a") for k in range(100)], EVENT), RULES)
    groups = marked.selectExpr("key", f"floor(unix_timestamp(ts) / (window * {SLICE_WINDOWS}))").distinct().count()
    assert marked.count() == 100 and groups <= 11


def test_slices_are_forgotten_and_odd_rows_pass(spark, tmp_path):
    ago = 1_786_000_000
    batches = [[failed(k * 1000 + j, ago + k * 1000 + j, f"k{j % 3}") for j in range(30)] for k in range(6)]
    batches[0] += [failed(9001, None, "k0"), failed(9002, ago, ""), event(9003, ago + 1, "nginx.access"), event(9004, ago + 1, "other", fields=None)]
    path = written(spark, batches, str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    with rules.timer_state(spark):
        query = rules.burst_alerts(stream, RULES, f"{DELAY} seconds").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.conf.get(rules.STATE_STORE, None) != rules.ROCKSDB
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= max(held[0], 1) * 2  # six batches of the same size: only the open slices are left
    empty = tmp_path / "none"
    spark.createDataFrame([], EVENT).write.parquet(str(empty))
    assert rules.replay(spark, str(empty), EVENT, str(tmp_path / "out"), lambda ev: rules.burst_alerts(ev, RULES)).count() == 0
