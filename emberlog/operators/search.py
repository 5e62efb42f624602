"""Search over the event table: filters, pages, counts, fetches and samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.operators.dsl import to_column
from emberlog.operators.durable import stored

MOST_ROWS = 5000


def time_order(newest: bool = False) -> list[Column]:
    """Events by time, unstamped ones last, record number as tie-break: a total order within a source."""
    return [F.col("ts").desc_nulls_last(), F.col("id_seq").desc(), F.col("id").desc()] if newest else [F.col("ts").asc_nulls_last(), F.col("id_seq"), F.col("id")]


def where(
    events: DataFrame,
    query: str = "",
    start: str | None = None,
    end: str | None = None,
    sources: Iterable[str] = (),
    sevs: Iterable[str] = (),
    case_set: DataFrame | None = None,
) -> DataFrame:
    """The events that match. Time, source and severity are plain comparisons of columns, so Parquet can skip by them.

    A bound that is no time is ignored; an event without time matches no bounded window. ``case_set`` has event ids in
    its column ``event_id``.
    """
    low, high = (F.try_to_timestamp(F.lit(x)) if x else None for x in (start, end))
    out = events
    if low is not None:
        out = out.where(low.isNull() | (F.col("ts") >= low))
    if high is not None:
        out = out.where(high.isNull() | (F.col("ts") <= high))
    if sources := list(sources):
        out = out.where(F.col("source").isin(sources) | F.col("source_id").isin(sources) | F.col("file").isin(sources))
    if sevs := list(sevs):
        out = out.where(F.col("sev").isin(sevs))
    if case_set is not None:
        out = out.join(case_set.select(F.col("event_id").alias("id")), "id", "left_semi")
    return out.where(to_column(query)) if query.strip() else out


def page(found: DataFrame, offset: int = 0, limit: int = 200, newest: bool = True) -> DataFrame:
    """One page in time order; ``TakeOrderedAndProject``, no full sort."""
    return found.orderBy(*time_order(newest)).offset(offset).limit(min(limit, MOST_ROWS))


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def get_by_ids(events: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The events of the given ids, and the ids that no event has."""
    wanted = events.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], "id string")
    return events.join(F.broadcast(wanted), "id", "left_semi"), wanted.join(events.select("id"), "id", "left_anti")


def positions(found: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Numbers rows from 0 in a global order without bringing them to one task.

    Rows are range-partitioned, numbered within their partition and written, so that both readers see the same ranges;
    each partition's first number is the sum of the partitions' sizes before it, and only those sizes are ordered in one
    place.
    """
    ranged = found.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inner = stored(ranged.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order))), "positions")
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")
    return inner.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")  # a row a partition


def spread_sample(found: DataFrame, n: int) -> DataFrame:
    """At most n events at even distances over the time order: positions floor(i * total / n)."""
    total = found.count()
    numbered = positions(found, time_order())
    if total <= n:
        return numbered
    # pos is floor(i * total / n) for some i exactly if ceil(pos * n / total) * total / n, rounded down, is pos
    step = F.ceil(F.col("pos") * n / total)
    return numbered.where((step < n) & (F.floor(step * total / n) == F.col("pos")))
