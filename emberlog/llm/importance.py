"""Quality classifier: importance resampling between a raw and a target distribution of hashed n-grams.

Method. Pieces of a lower-cased text give hashed unigrams and bigrams (a piece that repeats its predecessor is one
feature of its own). Smoothed bag-of-n-gram generative models are fitted: raw on every document, target on the labelled
good documents (all of them), twice, each time without one of its two folds. A document's log importance weight is
the mean over its n-grams of log p_target - log p_raw, times ``LENGTH``: the weight of a paragraph of so many n-grams of
the document's mix, so that long texts neither win nor lose by length. ``LENGTH`` is the temperature of the draw: the
noise has a deviation of 1.28, so a document whose mean lies ``1.28 / LENGTH`` above or below the border is drawn in
some seeds and not in others, while junk, ten times as far off, is not drawn in any. Target documents are weighed by the model that has
not seen their fold, all others by the mean of both, which have not seen them either. Adding Gumbel noise, seeded by the
document, and keeping the k largest keys draws k documents without replacement in proportion to their weights.

``k`` is given, or it is the least number whose draw holds ``target_share`` of the target documents: a plain quantile of
their keys at any size. The k-th key is found by narrowing histograms, never by gathering rows; ties at the k-th key are
all kept.

Nulls and edges. A null or empty text has no n-grams: weight 0. Equal (doc_id, text) rows get equal keys and verdicts.
An empty table gives an empty result; without any target document every weight is 0 and everything is kept. Ids may be
of any type, one for documents and labels. Other columns are carried along by ``keep_resampled`` under any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from emberlog.llm.common import bounded_ids, by_bytes, crc_words, in_filter, key_filter, map_arrow, stored, table, utf8_values

BUCKETS = 10_000
#: ``good_ids`` gives at most this many ids as a set; a frame of ids has no bound.
TARGET_BOUND = 50_000
#: Up to so many target documents near the border are told to the tasks that draw; more are joined.
DOUBTFUL = 100_000
#: The share of the target documents that the drawn sample holds.
TARGET_SHARE = 0.995
#: n-grams of the paragraph that stands for a document; less of them, more of the verdicts are left to the draw.
LENGTH = 50
FOLDS = 2
#: Pseudo-counts a cell with which the raw distribution smooths the target's: cells of little evidence weigh little.
PRIOR = 10.0
_REPEAT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def features(text: bytes | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hash cells of a text's unigrams and bigrams."""
    one = crc_words(text or b"")
    two = np.where(one[1:] == one[:-1], _REPEAT, (one[:-1] << np.uint64(32)) | one[1:])
    return (_mix(np.concatenate([one + np.uint64(1), two])) % np.uint64(buckets)).astype(np.int64)


def fold(doc_id) -> int:
    return crc32(str(doc_id).encode()) % FOLDS


def target_ids(docs: DataFrame, target: set | DataFrame) -> DataFrame:
    """The distinct ids of a target, given as a set or as a frame whose first column has them."""
    if isinstance(target, set):
        kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)])
        return docs.sparkSession.createDataFrame([(x,) for x in sorted(target)], kind)
    return target.select(F.col(target.columns[0]).alias("doc_id")).where("doc_id IS NOT NULL").distinct()


def marked(rows: DataFrame, ids: DataFrame, key: str = "doc_id", mark: str = "is_target") -> DataFrame:
    """``rows`` and whether each one's key is among the ids."""
    own = ids.select(F.col("doc_id").alias(mark)).hint("shuffle_hash")
    return rows.join(own, F.col(key) == F.col(mark), "left").withColumn(mark, F.col(mark).isNotNull())


def of_target(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the target's rows. Only rows that a bit filter of bounded size lets through are shuffled; the join decides."""
    hashed = F.xxhash64("doc_id").alias("key")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(ids.select(hashed)))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = in_filter(bits.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(held)).select(["doc_id", "text"])

    own = docs.select("doc_id", "text")
    return map_arrow(own.select("doc_id", "text", hashed), likely, own.schema).join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def feature_counts(docs: DataFrame, target: set | DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of every cell over all documents (row 0) and over each fold of the target. A task sends one row a cell at most."""

    def counted(rows: DataFrame, parts: int, part_of: Callable[[object], int]) -> np.ndarray:
        names = [f"part{k}" for k in range(parts)]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, buckets), np.int64)
            for batch in by_bytes(batches, 1):
                for key, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True):
                    sums[part_of(key)] += np.bincount(features(text, buckets), minlength=buckets)
            some = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(x[some]) for x in sums]], ["cell", *names])

        out = np.zeros((parts, buckets))
        schema = "cell int, " + ", ".join(f"{n} long" for n in names)
        for cell, *n in map_arrow(rows, count, schema).groupBy("cell").agg(*map(F.sum, names)).collect():
            out[:, cell] = n
        return out

    raw = counted(docs.select("doc_id", "text"), 1, lambda _: 0)
    return np.concatenate([raw, counted(of_target(docs, target_ids(docs, target)), FOLDS, fold)])


def fit_log_ratios(docs: DataFrame, target: set | DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each cell; row k is fitted without fold k of the target.

    The target's counts are smoothed with the raw distribution, the raw ones evenly.
    """
    raw, *folds = feature_counts(docs, target, buckets)
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
    prior = PRIOR * buckets
    others = [sum(folds) - own for own in folds]
    return np.array([np.log((good + prior * p_raw) / (good.sum() + prior)) - np.log(p_raw) for good in others])


def gumbel(doc_id, text: bytes | None, seed: int) -> float:
    """The row's own Gumbel noise."""
    draw = xxhash.xxh64_intdigest(text or b"", xxhash.xxh64_intdigest(f"{seed}:{doc_id}"))
    return -math.log(-math.log(((draw >> 11) + 0.5) / 2**53))


def document_key(doc_id, text: bytes | None, log_ratio: np.ndarray, seed: int) -> tuple[int, float, float]:
    """Number of n-grams, log importance weight, and the weight plus the row's own Gumbel noise."""
    n, (weight,) = document_weights(text, log_ratio)
    return n, weight, weight + gumbel(doc_id, text, seed)


def document_weights(text: bytes | None, *log_ratios: np.ndarray) -> tuple[int, list[float]]:
    """Number of n-grams, and the log importance weight by each model."""
    cells = features(text, len(log_ratios[0]))
    return len(cells), [LENGTH * float(m[cells].mean()) if len(cells) else 0.0 for m in log_ratios]


def importance_keys(docs: DataFrame, target: set | DataFrame, models: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, number of n-grams, log importance weight and Gumbel-perturbed key of every row, whether it is of the target, and its key if it were not.

    A row is weighed both ways, as a target document by the model that has not seen its fold, and as another one; which
    of them counts is joined to these few columns, so that no text is shuffled for it.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = models.mean(axis=0)
        for batch in by_bytes(batches, 1):
            ids, texts = batch.column(0).to_pylist(), utf8_values(batch.column(1))
            found = [document_weights(x, models[fold(i)], both) for i, x in zip(ids, texts, strict=True)]
            noise = [gumbel(i, x, seed) for i, x in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), *[pa.array([w[k] for _, w in found], pa.float64()) for k in (0, 1)], pa.array(noise, pa.float64())],
                ["doc_id", "n_ngrams", "as_target", "as_other", "noise"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = map_arrow(docs.select("doc_id", "text"), weigh, f"doc_id {kind}, n_ngrams long, as_target double, as_other double, noise double")
    own = marked(weighed, target_ids(docs, target)).withColumn("log_weight", F.when(F.col("is_target"), F.col("as_target")).otherwise(F.col("as_other")))
    return own.select("doc_id", "n_ngrams", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"), "is_target", (F.col("as_other") + F.col("noise")).alias("other_key"))


def kth_largest(values: DataFrame, column: str, k: int, cells: int = 4096) -> float | None:
    """The k-th largest of a double column, exactly: histograms of ``cells`` cells narrow the range until it is one value."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = (high - low) / cells
        cell = F.least(F.lit(cells - 1), F.floor((F.col(column) - low) / width)) if width > 0 else F.lit(0)
        counts = values.where(F.col(column).between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for row in sorted(counts, key=lambda r: -r["c"]):
            if k <= row["n"]:
                low, high = row["a"], row["b"]
                break
            k -= row["n"]
        else:
            return low
        if len(counts) == 1 and width == 0:
            break
    return low


def least_key(keys: DataFrame, target_share: float = TARGET_SHARE) -> float | None:
    """The least key, of written ones, of the smallest draw that holds ``target_share`` of the target documents."""
    own = keys.where("is_target")
    return kth_largest(own, "key", math.ceil(target_share * own.count()))


def resample(docs: DataFrame, target: set | DataFrame, k: int | None = None, target_share: float = TARGET_SHARE, seed: int = 0) -> DataFrame:
    """``importance_keys`` plus ``kept``: whether the row is among the k drawn."""
    keys = stored(importance_keys(docs, target, fit_log_ratios(docs, target), seed), "importance")
    least = least_key(keys, target_share) if k is None else kth_largest(keys, "key", k)
    return keys.drop("is_target", "other_key").withColumn("kept", F.lit(True) if least is None else F.col("key") >= least)


def good_ids(labels: DataFrame, bound: int = TARGET_BOUND) -> set:
    return bounded_ids(labels.where(F.col("quality") == 1), "doc_id", bound)


def good(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good."""
    return labels.where(F.col("quality") == 1).select("doc_id")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), good(table(spark, sf_dir, "labels")))


def keep_resampled(docs: DataFrame, target: set | DataFrame, target_share: float = TARGET_SHARE, seed: int = 0, doubtful_bound: int = DOUBTFUL) -> DataFrame:
    """The rows of ``docs``, all columns, that ``resample`` draws."""
    models = fit_log_ratios(docs, target)
    keys = stored(importance_keys(docs, target, models, seed), "importance")
    least = least_key(keys, target_share)
    if least is None:
        return docs
    # A target document is another matter only where its two keys lie on either side of the border.
    doubtful = keys.where(F.col("is_target") & ((F.col("key") >= least) != (F.col("other_key") >= least))).select("doc_id").distinct()
    few = [row[0] for row in doubtful.limit(doubtful_bound + 1).collect()]
    known, mark = set(few) if len(few) <= doubtful_bound else None, "doubtful"
    while mark in docs.columns:
        mark += "_"
    key_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = models.mean(axis=0)
        for batch in by_bytes(batches, text_at):
            ids = batch.column(key_at).to_pylist()
            own = [i in known for i in ids] if known is not None else batch.column(batch.num_columns - 1).to_pylist()
            drawn = [document_key(i, x, models[fold(i)] if of else both, seed)[2] >= least for i, x, of in zip(ids, utf8_values(batch.column(text_at)), own, strict=True)]
            yield batch.filter(pa.array(drawn, pa.bool_())).select(names)

    names = docs.columns
    return map_arrow(docs if known is not None else marked(docs, doubtful, mark=mark), run, docs.schema)
