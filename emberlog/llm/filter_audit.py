"""Filter interaction audit: what each filter of a sequence removes, in every order, from one pass over the texts.

Five filters judge every document. Within a part (a language), documents are counted by the set of filters that they
fail: 32 counts, which reshape to a 2x2x2x2x2 tensor with one axis a filter (index 0 passes, 1 fails). Whatever an order
of filters keeps, removes or would have removed at a step is a contraction of that tensor: each axis is met by one of
the vectors pass = (1, 0), fail = (0, 1) or all = (1, 1). One ``einsum`` answers all steps of all orders of a part; the
texts are never judged again.

Exact copies are found without gathering a group: the least id of a text is a partial minimum by digest, and a document
is that first one if (digest, id) meets it. That join is on the pair, so a text that a third of all rows hold spreads.

Nulls and edges. A null text is the empty text, a null language the empty part. A row without id is no copy and no
original. Rows of one id and text are no copies of each other. A document is good or toxic if one of its label rows says
so; labels without a document are ignored. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import WORD_PATTERN, map_arrow, stored, table

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: What is counted of the documents that fail a set of filters.
MEASURES = ("n", "good", "toxic")
RESULT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (short), B (few distinct words), C (capitals), D (symbols)."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"))
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("u")))[0]
    return [
        counts["n"] < 200,
        100 * counts["u"] < 50 * counts["n"],
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def _bits(failures: list[Column]) -> Column:
    """One bit a filter, that of A the highest: the place in the flattened tensor."""
    return reduce(lambda a, b: a + b, (F.when(failed, 1 << (len(FILTERS) - 1 - k)).otherwise(0) for k, failed in enumerate(failures)))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed): the set of filters that each document fails, as bits."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    own = stored(own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(text_failures(F.col("text"))).alias("failed")), "judged")
    first = own.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = own.join(first, ["digest", "doc_id"], "left")
    return met.select("doc_id", "part", (F.col("failed") + F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1).otherwise(0)).alias("failed"))


def tensors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: for each measure, the 32 counts of documents by the set of filters that they fail."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for m, c in (("good", "quality"), ("toxic", "toxic"))])
    counted = failed.join(marks, "doc_id", "left").groupBy("part", "failed").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES[1:]])
    cells = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("failed", F.struct(*MEASURES)))).alias("cells"))
    places = range(2 ** len(FILTERS))
    return cells.select("part", *[F.array(*[F.coalesce(F.col("cells")[k][m], F.lit(0)).cast("long") for k in places]).alias(m) for m in MEASURES])


def selectors() -> dict[str, np.ndarray]:
    """For each question, the vector of every order and step along every axis: arrays of (orders * steps, filters, 2)."""
    asked = {"kept": [], "removed": [], "failing": [], "alone": []}
    for order in ORDERS:
        for step, own in enumerate(order):
            before = order[:step]
            asked["kept"].append([PASS if f in before or f == own else ALL for f in FILTERS])
            asked["removed"].append([FAIL if f == own else PASS if f in before else ALL for f in FILTERS])
            asked["failing"].append([FAIL if f == own else ALL for f in FILTERS])
            asked["alone"].append([FAIL if f == own else PASS for f in FILTERS])
    return {name: np.array(rows, np.int64) for name, rows in asked.items()}


def contract(counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Contracts every tensor of ``counts`` (measures, 32) with every row of ``chosen``: (measures, rows)."""
    tensor = counts.reshape(-1, *[2] * len(FILTERS))
    return np.einsum("mabcde,na,nb,nc,nd,ne->mn", tensor, *np.moveaxis(chosen, 1, 0))


def audit(counted: DataFrame) -> DataFrame:
    """One row a part, order and step, from the counts of ``tensors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = selectors()
        orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
        for batch in batches:
            for part, *measures in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.array(measures, np.int64)
                found = {name: contract(counts, chosen) for name, chosen in asked.items()}
                removed = found["removed"]
                shapley = np.array([removed[0][own == f].sum() for f in range(len(FILTERS))])[own]
                columns = [found["kept"][0], removed[0], found["failing"][0] - removed[0], found["alone"][0], removed[1], removed[2], shapley]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), pa.array(orders, pa.string()), pa.array(steps), *map(pa.array, columns)], RESULT)

    return map_arrow(counted, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in RESULT[3:]))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(tensors(judged(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 16 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 8 ELSE 0 END
  + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 2 ELSE 0 END + CASE WHEN doc_id > first_id THEN 1 ELSE 0 END AS failed
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM j GROUP BY part, failed),
f AS (SELECT * FROM (VALUES ('A', 16), ('B', 8), ('C', 4), ('D', 2), ('E', 1)) t(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, own,
  sum(n) FILTER (WHERE failed & (own | before) = 0) AS kept, sum(n) FILTER (WHERE failed & own > 0 AND failed & before = 0) AS removed,
  sum(n) FILTER (WHERE failed & own > 0 AND failed & before > 0) AS redundant, sum(n) FILTER (WHERE failed = own) AS unique_fails,
  sum(good) FILTER (WHERE failed & own > 0 AND failed & before = 0) AS good_lost, sum(toxic) FILTER (WHERE failed & own > 0 AND failed & before = 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r
"""
