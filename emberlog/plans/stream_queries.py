"""Registered queries: rules on the replayed event table, held against the SQL of the batch rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.operators.durable import shared_dir
from emberlog.plans.detect_queries import HITS_SQL, RULES
from emberlog.plans.views import log_events
from emberlog.streaming import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query over the written event table, which it replays: a name, a job, and the names of replays whose alerts the job reads as well."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            at = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
            events = log_events(spark, sf_dir, spread=True)
            events.write.parquet(f"{at}/events")

            def replayed(name: str, job: Callable[..., DataFrame], *earlier: str) -> DataFrame:
                alerts = [rules.written_alerts(spark, f"{at}/{e}") for e in earlier]
                return rules.replay(spark, f"{at}/events", events.schema, f"{at}/{name}", lambda ev: job(ev, *alerts))

            return fn(replayed)

        QUERIES[fn.__name__], SQL[fn.__name__] = run, sql
        return fn

    return add


@query(HITS_SQL + "SELECT id, rule_id, burst_count FROM hits WHERE burst_count IS NOT NULL")
def stream_bursts(replayed):
    hits = rules.densest(replayed("alerts", lambda ev: rules.burst_alerts(ev, RULES)))
    return hits.select("id", "rule_id", hits["count"].alias("burst_count"))


@query(HITS_SQL + "SELECT id FROM followed")
def stream_success_after_burst(replayed):
    alerts = replayed("alerts", lambda ev: rules.burst_alerts(ev, RULES, only=[rules.ANCHOR]))
    pairs = replayed("logins", lambda ev, before: rules.followed_logins(ev, RULES, alerts=before), "alerts")
    return rules.settled_logins(pairs, rules.densest(alerts))
