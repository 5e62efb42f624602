"""Burst rules and their follow-ups on a stream of events.

A stream cannot know a key's densest window before its end, so alerts are improvements: each one is the densest window of a
slice of the key's time line so far. The last word on a key is the densest of its alerts, and that is the batch hit
(``densest``), whatever the order of arrival, as long as no row came later than the watermark allows. Rows that did are
named as alerts of kind ``late`` and count nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.operators.bursts import SLICE_WINDOWS
from emberlog.operators.detections import _f, _is, _like, burst_rules, family, prepared
from emberlog.operators.rules import Rule

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The first rule whose bursts are followed, and the rule that follows them.
ANCHOR, FOLLOW_UP = "SIGMA-WEB-0042", "SIGMA-AUTH-0111"
ALERT = "kind string, rule_id string, key string, id string, ts timestamp, epoch long, count long, first_id string, first_epoch long"
#: State of a slice: its seconds in order, with the first and last event of each in record order, and the best window yet.
SECONDS = "epoch array<long>, n array<long>, at array<long>, head_seq array<long>, head array<string>, tail_seq array<long>, tail array<string>, best_count long, best_epoch long"
_COLUMNS = ["epoch", "n", "at", "head_seq", "head", "tail_seq", "tail"]


@contextmanager
def timer_state(spark: SparkSession):
    """While queries are started: state with timers needs the state store on local disk (RocksDB)."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _logins(rules: dict[str, Rule]) -> Column:
    a = rules[FOLLOW_UP].params
    return family("web") & _f("http.status").startswith(a["successPrefix"]) & _like(_f("http.path"), a["loginPath"]) & _is(_f("http.method"), a["methods"])


def listed(events: DataFrame, rules: dict[str, Rule], only: list[str] | None = None) -> DataFrame:
    """A row for each rule that counts an event: rule_id, key, window, least, id, id_seq, ts.

    ``least`` is null for logins, which are watched for lateness only; their ``window`` is that of the bursts, as it cuts
    the groups that the state's tasks are called for.
    """
    own = {k: v for k, v in burst_rules(rules).items() if rules[k].enabled and k in (only or rules)}
    mark = lambda k, by, p: F.struct(F.lit(k).alias("rule_id"), by.alias("key"), F.lit(p.get("window", 1)).cast("long").alias("window"), F.lit(p.get("threshold")).cast("long").alias("least"))
    marks = [F.when(c & (by != ""), mark(k, by, rules[k].params)) for k, (c, by) in own.items()]
    if rules[FOLLOW_UP].enabled and ANCHOR in own:
        marks.append(F.when(_logins(rules) & (_f("src_ip") != ""), mark(FOLLOW_UP, _f("src_ip"), {"window": rules[ANCHOR].params["window"]})))
    return prepared(events).where("ts IS NOT NULL").select("id", "id_seq", "ts", F.inline(F.array_compact(F.array(*marks))))


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Parts of seconds as whole seconds: the first and last event by record number, then by id."""
    heads = rows.sort_values(["epoch", "head_seq", "head"]).groupby("epoch")[["head_seq", "head"]].first()
    tails = rows.sort_values(["epoch", "tail_seq", "tail"]).groupby("epoch")[["tail_seq", "tail"]].last()
    sums = rows.groupby("epoch").agg(n=("n", "sum"), at=("at", "max"))
    return sums.join(heads).join(tails).reset_index()[_COLUMNS]


class DensestWindow(StatefulProcessor):
    """The densest window of one slice of a key's time line; a timer ends the slice once the watermark is past it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds = handle.getValueState("seconds", SECONDS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule, name, number, window = key
        mark = timerValues.getCurrentWatermarkInMs()
        late, parts, least = [], [], None
        for batch in rows:  # a hot key's batches are folded one at a time
            behind = batch["at"] <= mark
            named = batch[behind & batch["own"]]
            late += [("late", rule, name, i, pd.Timestamp(mark + 1, unit="ms"), e, None, None, None) for i, e in zip(named["id"], named["epoch"], strict=True)]
            batch = batch[~behind]
            if len(batch) and batch["least"].notna().all():
                least = int(batch["least"].iloc[0])
                new = batch.assign(n=1, head_seq=batch["id_seq"], head=batch["id"], tail_seq=batch["id_seq"], tail=batch["id"])
                parts = [_folded(pd.concat([*parts, new[_COLUMNS]]))]
        if late:
            yield _alerts(late)
        if parts:
            found = self._improve(parts[0], rule, name, int(window), least)
            if found:
                yield _alerts([found])
            self.handle.registerTimer((number + 1) * window * SLICE_WINDOWS * 1000)

    def _improve(self, new: pd.DataFrame, rule: str, name: str, window: int, least: int):
        """Takes new seconds into the state and returns the best window if it is a better one."""
        best = (0, 0)
        line = new
        if self.seconds.exists():
            kept = self.seconds.get()
            best = (kept[len(_COLUMNS)], kept[len(_COLUMNS) + 1])
            line = _folded(pd.concat([pd.DataFrame(dict(zip(_COLUMNS, kept, strict=False))), new]))
        epochs, upto = line["epoch"].to_numpy(), np.concatenate([[0], np.cumsum(line["n"].to_numpy())])
        start = np.searchsorted(epochs, epochs - window)
        counts = np.where(epochs >= new["epoch"].min(), upto[1:] - upto[start], 0)  # earlier windows are as they were
        k = int(counts.argmax())  # the earliest of equals
        found = None
        if counts[k] >= least and (counts[k] > best[0] or (counts[k] == best[0] and epochs[k] < best[1])):
            best = (int(counts[k]), int(epochs[k]))
            last, first = line.iloc[k], line.iloc[start[k]]
            found = ("burst", rule, name, last["tail"], pd.Timestamp(int(last["at"]), unit="ms"), best[1], best[0], first["head"], int(first["epoch"]))
        self.seconds.update((*[line[c].tolist() for c in _COLUMNS], *best))
        return found

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seconds.clear()
        yield _alerts([])

    def close(self) -> None:
        pass


def _alerts(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"ts": "datetime64[ns]", "epoch": "Int64", "count": "Int64", "first_epoch": "Int64"}
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ALERT.split(", ")]).astype(kinds)


def burst_alerts(events: DataFrame, rules: dict[str, Rule], delay: str = "10 minutes", only: list[str] | None = None) -> DataFrame:
    """Alerts of the burst rules on a stream of normalized events (``kind`` is ``burst`` or ``late``); rows without time take no part.

    A slice of a key's time line is eight windows and the one before it, so a key with all rows is dealt over many tasks
    when a backlog is read, and state is bounded by the seconds of open slices: the batch rule's cut. To be started
    within ``timer_state``, in append mode. A late row's ``ts`` is when it was found, its ``epoch`` its own time.
    """
    own = listed(events.withWatermark("ts", delay), rules, only)
    # Without the watermarked column in its input Spark hands on late rows, which the processor names, instead of dropping them.
    placed = own.withColumn("at", F.unix_millis("ts")).withColumn("epoch", F.unix_timestamp("ts")).drop("ts").withColumn("mine", F.floor(F.col("epoch") / (F.col("window") * SLICE_WINDOWS)))
    halo = F.when(F.col("least").isNotNull() & (F.col("epoch") >= ((F.col("mine") + 1) * SLICE_WINDOWS - 1) * F.col("window")), F.col("mine") + 1)
    sliced = placed.withColumn("slice", F.explode(F.array_compact(F.array("mine", halo)))).withColumn("own", F.col("slice") == F.col("mine")).drop("mine")
    return sliced.groupBy("rule_id", "key", "slice", "window").transformWithStateInPandas(DensestWindow(), ALERT, "append", "eventTime", eventTimeColumnName="ts")


def followed_logins(events: DataFrame, rules: dict[str, Rule], delay: str = "10 minutes", alerts: DataFrame | None = None) -> DataFrame:
    """Successful logins within the time after an alert of the same address: a stream-stream interval join.

    id, ip, at, and the alert's end (anchor_epoch). Both sides forget what the watermark has passed by the interval.
    ``settled_logins`` keeps those whose alert stayed the address's densest. Logins behind the watermark of the batch before
    are dropped here; ``burst_alerts`` names them. ``alerts`` is a stream of what ``burst_alerts`` wrote; without it they are made here.
    """
    within = rules[FOLLOW_UP].params["within"]
    alerts = burst_alerts(events, rules, delay, [ANCHOR]) if alerts is None else alerts.withWatermark("ts", delay)
    # An address's time line is cut into slots of the interval, so that its logins are dealt over many tasks: an alert reaches into two.
    slot = lambda at: F.floor(at / max(within, 1))
    anchors = alerts.where((F.col("kind") == "burst") & (F.col("rule_id") == ANCHOR)).select(F.col("key").alias("ip"), F.col("ts").alias("anchor_ts"), F.col("epoch").alias("anchor_epoch"))
    anchors = anchors.withColumn("slot", F.explode(F.sequence(slot(F.col("anchor_epoch")), slot(F.col("anchor_epoch") + within))))
    tries = prepared(events.withWatermark("ts", delay)).where(_logins(rules)).select("id", _f("src_ip").alias("login_ip"), F.col("ts").alias("login_ts"), F.unix_timestamp("ts").alias("at"))
    tries = tries.withColumn("login_slot", slot(F.col("at")))
    exact = F.col("at").between(F.col("anchor_epoch"), F.col("anchor_epoch") + within)
    # Whole seconds decide; the times of the events, a second wider, tell Spark what it may forget.
    near = F.expr(f"login_ts >= anchor_ts - INTERVAL 1 SECOND AND login_ts <= anchor_ts + INTERVAL {within + 1} SECONDS")
    return anchors.join(tries, (F.col("ip") == F.col("login_ip")) & (F.col("slot") == F.col("login_slot")) & exact & near).select("id", "ip", "at", "anchor_epoch")


def densest(alerts: DataFrame) -> DataFrame:
    """The batch hits of alerts as written: rule_id, key, id, epoch, count, first_id, first_epoch."""
    best = alerts.where("kind = 'burst'").groupBy("rule_id", "key").agg(F.max_by(F.struct("id", "epoch", "count", "first_id", "first_epoch"), F.struct("count", -F.col("epoch"))).alias("b"))
    return best.select("rule_id", "key", "b.*")


def settled_logins(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """The logins, as written, whose alert is the densest of its address: id."""
    anchors = hits.where(F.col("rule_id") == ANCHOR).select(F.col("key").alias("ip"), F.col("epoch").alias("anchor_epoch"))
    return pairs.join(anchors, ["ip", "anchor_epoch"], "left_semi").select("id").distinct()


def written_alerts(spark: SparkSession, out: str) -> DataFrame:
    """A stream of the alerts that a replay has written; all of them come first, so none is late for the events beside it."""
    return spark.readStream.schema(ALERT).parquet(f"{out}/rows")


def replay(spark: SparkSession, path: str, schema, out: str, run, files: int = 1000) -> DataFrame:
    """Reads a written event table as a stream, ``files`` at a time, through ``run``, and returns what was written."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    with timer_state(spark):
        query = run(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
