"""Helpers shared by the training-data operators: reading, tokens, durable intermediate tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.durable import shared_dir as shared_dir
from emberlog.operators.durable import stored as stored

#: Words of the contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN.encode()).findall
#: Runs of letters, digits and non-ASCII bytes, or runs of other visible characters.
PIECES = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+").findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_values(array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, nulls as None."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_binary()).to_pylist()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of a text column, at least one row each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


#: Rows of an Arrow batch where the session leaves Spark's default: texts are large, and workers hold whole batches.
BATCH_ROWS = 1000
_ROWS_KEY, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over small batches; a worker gives memory that it no longer needs back at a task's end."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY, _ROWS_DEFAULT) == _ROWS_DEFAULT:
        conf.set(_ROWS_KEY, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def crc_words(text: bytes) -> np.ndarray:
    """CRC-32 of each piece of a lower-cased text."""
    found = PIECES(text.lower())
    return np.fromiter(map(crc32, found), np.uint64, len(found))


def crc32_mod(column: Column, divisor: int) -> Column:
    """``crc32(column as text) mod divisor``; a null column counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_ids(df: DataFrame, key: str, bound: int) -> set:
    """At most ``bound`` distinct non-null keys, those of smallest hash, so that the choice depends on neither order nor partitioning."""
    rows = df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(bound).collect()
    return {row[0] for row in rows}


#: Logarithms of the least and most bits of a filter.
FILTER_BITS = (16, 27)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def key_filter(keys: DataFrame, key: str = "key") -> np.ndarray:
    """Bits of which those at the keys' low bits are set: eight for each key, within FILTER_BITS."""
    low, high = FILTER_BITS
    size = min(high, max(low, math.ceil(math.log2(8 * keys.count() + 1))))
    cell = F.col(key).bitwiseAND((1 << size) - 1)
    words = keys.select(F.shiftright(cell, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(63).cast("int")).alias("bit"))
    set_bits = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** high / 64 rows
    out = np.zeros(1 << size - 6, "<i8")
    out[set_bits["at"].to_numpy()] = set_bits["bits"].to_numpy()
    return out.view(np.uint8)
