"""The search language against a plain predicate in Python, on events and on a truth table."""

import random

import pytest

from emberlog.operators import dsl
from emberlog.schema import EVENT

EVENTS = [
    ("e1", 0, None, "nginx.access", "s1", "a.log", "edge-lb-01", "svc_deploy", "POST /api/v2/login 200", "critical", "45.83.140.22 POST /api/v2/login 200", {"src_ip": "45.83.140.22", "http.status": "200"}, ["45.83.140.22", "svc_deploy"], [("AUTH-0111", "Success after burst", "critical")]),
    ("e2", 1, None, "syslog", "s2", "b.log", "bastion-1", "alice", "Accepted publickey for alice", "info", "sshd[7]: Accepted publickey for alice", {"Program": "sshd", "port": "10.0.0.9:3001"}, ["45.83.140.220", "alice"], []),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, EVENT).cache()


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("", {"e1", "e2"}), ("   ", {"e1", "e2"}), ("login", {"e1"}), ("LOGIN", {"e1"}), ("sev:critical", {"e1"}), ("severity:critical,info", {"e1", "e2"}), ("sev:crit", set()),
        ("user:svc_deploy AND sev:critical", {"e1"}), ("user:svc_deploy sev:info", set()), ("user:svc_deploy OR user:alice", {"e1", "e2"}), ("NOT user:alice", {"e1"}), ("-user:alice", {"e1"}), ("not missing:x", {"e1", "e2"}), ("missing:x", set()),
        ("user:svc_*", {"e1"}), ("user:*e", {"e2"}), ("user:al", set()), ("user:ali", {"e2"}), ("entity:45.83.140.22", {"e1"}), ("entity:45.83.140.*", {"e1", "e2"}), ("ip:45.83.140.22", {"e1", "e2"}), ("program:sshd", {"e2"}),
        ("HTTP.STATUS:200", {"e1"}), ('"publickey for"', {"e2"}), ('"user:alice"', set()), (r"10.0.0.9\:3001", {"e2"}), ("(login OR publickey) -alice", {"e1"}), ("detection:auth-0111", {"e1"}), ("rule:burst", {"e1"}), ("file:b.log", {"e2"}), ("id:E2", {"e2"}),
        ("a OR b) sev:info", {"e1", "e2"}), ("msg:POST", {"e1"}), ('host:"edge-lb-01"', {"e1"}), ("port:10.0.0.9:3001", {"e2"}), ("and", {"e1", "e2"}), ("%", set()), ("_ploy", set()),
    ],
)
def test_truth_table(events, query, expected):
    assert {r["id"] for r in events.where(dsl.to_column(query)).select("id").collect()} == expected


def plain(tree, event):
    if tree is None:
        return True
    if isinstance(tree, dsl.Term):
        if tree.field:
            value = event["user"] if tree.field == "user" else event["sev"]
            v = tree.text.lower()
            return value in v.split(",") if tree.field == "sev" else (value == v or (len(v) >= 3 and v in value))
        return tree.text.lower() in event["msg"].lower() or tree.text.lower() in event["user"] or tree.text.lower() in "s1 f.log h "
    kind, *parts = tree
    if kind == "not":
        return not plain(parts[0], event)
    return (any if kind == "or" else all)(plain(p, event) for p in parts)


def test_random_queries(spark):
    draw = random.Random(7)
    rows = [{"user": draw.choice(["ann", "annette", "bob"]), "sev": draw.choice(["high", "low"]), "msg": draw.choice(["red fox", "blue fox", "red whale"])} for _ in range(60)]
    frame = spark.createDataFrame([(f"#{i}", i, None, "s1", "s1", "f.log", "h", r["user"], r["msg"], r["sev"], r["msg"], {}, [], []) for i, r in enumerate(rows)], EVENT).cache()
    atoms = ["red", "fox", "user:ann", "user:bob", "sev:high", "sev:low,high", "whale", "-blue"]
    for _ in range(25):
        query = " ".join(draw.choice(["", "NOT "]) + draw.choice(atoms) + draw.choice(["", " AND", " OR"]) for _ in range(draw.randint(1, 4))).rstrip("ANDOR ")
        tree = dsl.parse(query)
        assert {r["id"] for r in frame.where(dsl.to_column(query)).select("id").collect()} == {f"#{i}" for i, r in enumerate(rows) if plain(tree, r)}, query


def test_node_query_round_trip(events):
    assert dsl.parse(dsl.node_query('a"b\\c')) == dsl.Term('a"b\\c', "entity")
