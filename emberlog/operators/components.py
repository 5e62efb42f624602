"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.durable import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``edges(u, v)`` with u > v.

    Large star: every larger neighbour of a node is linked to the node's smallest neighbour (itself included).
    Small star: every smaller neighbour is. Minima are partial aggregates; no neighbour list is gathered.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.where(F.col("u") != F.col("v")).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of a small edge table ``edges(u, v)`` by union-find in one task: the smaller root stays a root."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
                low, high = sorted((root(u), root(v)))
                above[high] = low
        nodes = list(above)
        yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]})

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(join, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, small: int = 0) -> DataFrame:
    """``(node, component)`` for every node of ``edges``, component being the smallest node reachable.

    Nodes are comparable values (numbers are compared as such). Null ends and self loops are ignored; an empty edge
    table gives an empty result. Every round is written to the shared folder, so that lineage stays short. An edge table
    of at most ``small`` rows, counted first, goes through one task instead: there a round's jobs cost more than the work.
    """
    edges = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges, before = stored(edges, "edges"), None
    if small and edges.count() <= small:
        return _at_once(edges)
    for _ in range(most_rounds):
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
