"""Which texts hold which of many given strings.

Two exact ways to the same pairs. Needles of a proven size (``AUTOMATON_BYTES`` of text in all) become one Aho-Corasick
automaton that is broadcast; each text is read once, however many needles there are. Beyond that size, needles and texts
are joined: a needle is listed under its rarest gram of ``GRAM`` bytes (a shorter needle under itself), a text under
those of its grams that some needle is listed under, and pairs that meet are verified. Which gram is the rarest comes
from a bounded sample of texts and decides about speed only. Texts' grams are sieved before the shuffle by a bitmap of
fixed size, so that a text without a needle's gram emits nothing.

Needles meet only texts of their ``scope`` (a null scope meets nothing). Empty needles and null texts meet nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.durable import stored

try:
    import ahocorasick
except ImportError:  # the join serves needles of any number
    ahocorasick = None

#: Needles of at most so many bytes in all are broadcast: the automaton takes some forty times as much in a worker.
AUTOMATON_BYTES = 2 << 20
GRAM, SLOT_BITS, COUNT_BITS, SAMPLE_TEXTS = 6, 24, 20, 5000
#: Bytes of text whose grams are made together, and rows of one batch that a task hands on.
SCAN_BYTES, POSTED_ROWS = 1 << 20, 10_000

_automata: dict[str, object] = {}


def _automaton(name: str, needles: list[str]):
    """A worker's automaton of these needles; it keeps the last one."""
    if name not in _automata:
        made = ahocorasick.Automaton()
        for needle in needles:
            made.add_word(needle, needle)
        made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return _automata[name]


def _grams(text: bytes, length: int) -> np.ndarray:
    """The distinct grams of ``length`` bytes of a text as numbers; the length is part of the number."""
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(data) < length:
        return np.zeros(0, np.int64)
    value = np.full(len(data) - length + 1, length, np.int64)
    for k in range(length):
        value = value << 8 | data[k : len(data) - length + 1 + k]
    return np.unique(value)


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _postings(column: pa.Array, lengths: list[int], sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the grams of the given lengths that the sieve lets through, each once a row.

    Texts are read together, some ``SCAN_BYTES`` at a time, as one run of bytes; a gram across two texts is none.
    """
    data = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    found, start = [], 0
    while start < len(data):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SCAN_BYTES, side="right")) - 1)
        own = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[start] : offsets[stop]]
        sizes = np.diff(offsets[start : stop + 1])
        row = np.repeat(np.arange(start, stop), sizes)
        left = np.repeat(offsets[start + 1 : stop + 1] - offsets[start], sizes) - np.arange(len(own))
        value = np.zeros(len(own), np.int64)
        for n in range(1, max(lengths, default=0) + 1):
            if len(own) < n:
                break
            value = value[: len(own) - n + 1] << 8 | own[n - 1 :]
            if n in lengths:
                grams = value | n << 8 * n
                at = np.flatnonzero((left[: len(grams)] >= n) & (sieve[_slots(grams, SLOT_BITS)] > 0))
                order = np.lexsort((grams[at], row[at]))
                rows, kept = row[at][order], grams[at][order]
                fresh = np.ones(len(rows), bool)
                fresh[1:] = (rows[1:] != rows[:-1]) | (kept[1:] != kept[:-1])
                found.append((rows[fresh], kept[fresh]))
        start = stop
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *(r for r, _ in found)]), np.concatenate([empty, *(g for _, g in found)])


def _types(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def by_automaton(texts: DataFrame, needles: list[str]) -> DataFrame:
    """(the columns of ``texts`` but for ``text``, needle): each pair once a row of ``texts``; ``needles`` is of proven size."""
    spark, name, kept = texts.sparkSession, uuid.uuid4().hex, [c for c in texts.columns if c != "text"]
    shared = spark.sparkContext.broadcast([x for x in set(needles) if x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(name, shared.value) if shared.value else None
        for batch in batches:
            hits = [{x for _, x in found.iter(text)} if found is not None and text else () for text in batch.column(batch.num_columns - 1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in hits]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(kept))), pa.array([x for own in hits for x in own], pa.string())], [*kept, "needle"])

    return texts.select(*kept, "text").mapInArrow(run, f"{_types(texts, *kept)}, needle string")


def _common(texts: DataFrame) -> np.ndarray:
    """How often grams of full length occur in a bounded sample of texts, by slot of a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for text in _utf8(batch.column(0)):
                counts[_slots(_grams(text, GRAM), COUNT_BITS)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    rows = texts.select("text").limit(SAMPLE_TEXTS).coalesce(1).mapInArrow(run, "counts binary").collect()
    return sum((np.frombuffer(r["counts"], np.uint32).astype(np.int64) for r in rows), np.zeros(1 << COUNT_BITS, np.int64))


def by_grams(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(the columns of ``texts`` but for ``text``, those of ``needles``) of every pair of one ``scope``, each once a row."""
    spark, kept, own = texts.sparkSession, [c for c in texts.columns if c not in ("scope", "text")], needles.columns
    common = spark.sparkContext.broadcast(_common(texts))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = []
            for needle in _utf8(batch.column(own.index("needle"))):
                values = _grams(needle, min(GRAM, len(needle)))
                grams.append(int(values[np.argmin(common.value[_slots(values, COUNT_BITS)])]) if len(needle) > GRAM else int(values[0]))
            slots = _slots(np.array(grams, np.int64), SLOT_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grams, pa.int64()), pa.array(slots, pa.int64())], [*own, "gram", "slot"])

    listed = needles.where((F.col("needle") != "") & F.col("scope").isNotNull()).select(*own).distinct()
    listed = stored(listed.mapInArrow(choose, f"{_types(needles, *own)}, gram long, slot long"), "needles")
    # 2^SLOT_BITS bits in rows of 4 KB: a fixed size, whatever the number of needles. Spark numbers bits from 1.
    place = F.col("slot") + 1
    bits = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for row in listed.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        part = np.frombuffer(row["bits"], np.uint8)
        bits[(row["bucket"] - 1) * len(part) : row["bucket"] * len(part)] = part
    lengths = sorted(r[0] for r in listed.select(F.least(F.octet_length("needle"), F.lit(GRAM)).alias("n")).distinct().collect())
    sieve = spark.sparkContext.broadcast(np.unpackbits(bits, bitorder="little"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams = _postings(batch.column(batch.num_columns - 1), lengths, sieve.value)
            for k in range(0, len(rows), POSTED_ROWS):  # a text is repeated for each of its grams
                some = pa.array(rows[k : k + POSTED_ROWS], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(some) for c in batch.columns), pa.array(grams[k : k + POSTED_ROWS], pa.int64())], [*kept, "scope", "text", "gram"])

    posted = texts.select(*kept, "scope", "text").mapInArrow(emit, f"{_types(texts, *kept, 'scope', 'text')}, gram long").alias("t")
    listed = listed.drop("slot").alias("n")
    met = posted.join(listed, (F.col("t.scope") == F.col("n.scope")) & (F.col("t.gram") == F.col("n.gram")) & F.col("t.text").contains(F.col("n.needle")))
    return met.select(*[F.col(f"t.{c}") for c in kept], *[F.col(f"n.{c}") for c in own])
