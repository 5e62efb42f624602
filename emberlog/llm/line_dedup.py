"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A store knows every line of its documents by a 128-bit digest of its key (the line without white space at both ends, A-Z
lower-cased; shorter keys than ``SHORTEST`` count for nothing). It has three tables.

* ``refs``: (key, doc_id), one row for each key of a document row: what a deletion goes by.
* ``counts``: (key, refs, owner): the exact number of references to a key and the smallest document that holds it. A
  change appends new rows under a higher version; the highest one of a key counts, and no references mean none is left.
* ``filters``: cuckoo filters of the keys with references, by shard of the key. A key's fingerprint is in one of two
  buckets of four, so membership takes two looks, and, unlike in a Bloom filter, keys can be taken out again.

``insert`` asks the filters first: a key that they do not know is new for sure, and only the others meet the exact counts.
``delete`` takes a document's references away, finds the next owner of each line it held, and takes keys without
references out of the filters. So any sequence of insertions and deletions leaves what one insertion of the remaining
documents would. A document loses each line whose key is owned by a smaller document.

Scale. Counts are partial sums by key and the filters see each key once, so a line that a third of all documents hold is
one row a task. References meet hot keys, of which there are at most ``HOT_KEYS``, by a broadcast; every other key has too
few to matter. A shard holds about ``PER_SHARD`` keys: the number of shards grows with the store, and filters are made anew from
the counts then. A full filter is followed by another one of its shard.

Nulls and edges. A null text is the empty text, which is one empty line. A row without id is no document of a store: it
owns nothing and loses nothing. Rows of one id are one document. Extra columns are ignored; an empty table gives an
empty store and an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import by_bytes, map_arrow, stored, table, utf8_values

SPACES = b" \t\n\x0b\x0c\r"
SHORTEST = 10
PER_SHARD = 1 << 19
SLOTS, LOAD, KICKS = 4, 0.84, 400
#: Keys with over one in so many of all references: at most as many, so they are broadcast.
HOT_KEYS = 10_000
#: The query inserts its table in so many batches, as documents arrive over time.
BATCHES = 2


class CuckooFilter:
    """16-bit fingerprints in buckets of four; 0 is an empty slot. Works on arrays of 64-bit hashes."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, SLOTS)

    @classmethod
    def sized(cls, items: int) -> CuckooFilter:
        """An empty filter with room for ``items``."""
        return cls(np.zeros(SLOTS << max(4, int(np.ceil(np.log2(max(1, items) / (SLOTS * LOAD))))), np.uint16))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        return np.where(prints, prints, np.uint16(1)), (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint, from either of its two."""
        spread = (prints.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(17)
        return at ^ (spread & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, at = self._places(hashes)
        return (self.slots[at] == prints[:, None]).any(1) | (self.slots[self._other(prints, at)] == prints[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """Puts hashes in; returns which of them found no room (they are left out)."""
        prints, at = self._places(hashes)
        own, before = np.arange(len(hashes)), self.slots.copy()
        for kick in range(KICKS):
            if not len(own):
                return own
            order = np.argsort(at, kind="stable")
            own, prints, at = own[order], prints[order], at[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.slots == 0
            fits = nth < free[at].sum(1)
            # The nth newcomer of a bucket takes its nth free slot.
            slot = np.argmax(free[at[fits]].cumsum(1) == nth[fits, None] + 1, axis=1)
            self.slots[at[fits], slot] = prints[fits]
            own, prints, at, nth = own[~fits], prints[~fits], at[~fits], nth[~fits]
            if kick > 1:  # both buckets are full: one newcomer a bucket takes another's place, which goes to its second one
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                slot = (kick + first) % SLOTS
                self.slots[at[first], slot], prints[first] = prints[first].copy(), self.slots[at[first], slot].copy()
            at = self._other(prints, at)
        if len(own):  # what is homeless now need not be a newcomer: take the batch back, and let half of it in
            self.slots[:] = before
            half = len(hashes) // 2
            return np.arange(len(hashes)) if not half else np.r_[self.insert(hashes[:half]), np.arange(half, len(hashes))]
        return own

    def remove(self, hashes: np.ndarray) -> np.ndarray:
        """Takes one copy of each hash out; returns which of them were not there."""
        prints, at = self._places(hashes)
        missing = []
        for k, (mark, first, second) in enumerate(zip(prints.tolist(), at.tolist(), self._other(prints, at).tolist(), strict=True)):
            for bucket in (self.slots[first], self.slots[second]):
                there = np.flatnonzero(bucket == mark)
                if len(there):
                    bucket[there[0]] = 0
                    break
            else:
                missing.append(k)
        return np.array(missing, np.int64)


class Shard:
    """The filters of one shard, each opened when those before it were full."""

    def __init__(self, tables: list[bytes]):
        self.filters = [CuckooFilter(np.frombuffer(t, np.uint16).copy()) for t in tables]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for f in self.filters:
            found |= f.contains(hashes)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        if self.filters and (room := int(self.filters[-1].slots.size * LOAD) - int((self.filters[-1].slots != 0).sum())) > 0:
            rest = self.filters[-1].insert(hashes[:room])
            hashes = np.r_[hashes[rest], hashes[room:]]
        while len(hashes):
            # As large as what is there already, so that a shard's filters stay few.
            self.filters.append(CuckooFilter.sized(max(len(hashes), sum(int((f.slots != 0).sum()) for f in self.filters))))
            hashes = hashes[self.filters[-1].insert(hashes)]

    def remove(self, hashes: np.ndarray) -> None:
        for f in self.filters:
            hashes = hashes[f.remove(hashes)]

    def tables(self) -> list[bytes]:
        return [f.slots.tobytes() for f in self.filters]


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, or None if the key is too short."""
    key = line.strip(SPACES).lower()
    if len(key) < SHORTEST or not key.isascii() and len(key.decode()) < SHORTEST:
        return None
    return blake2b(key, digest_size=16).digest()


def references(docs: DataFrame) -> DataFrame:
    """(key, doc_id): one row for each distinct key of every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            found = [{k for line in text.split(b"\n") if (k := line_key(line))} if text else () for text in utf8_values(batch.column(1))]
            rows = np.repeat(np.arange(batch.num_rows), [len(keys) for keys in found])
            keys = pa.array([k for keys in found for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, batch.column(0).take(pa.array(rows))], ["key", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), run, f"key binary, doc_id {kind}")


def _hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit(11))


@dataclass(frozen=True)
class LineStore:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int = 0
    version: int = 0

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def current(self) -> DataFrame:
        """(key, refs, owner) of every key that some document holds."""
        latest = self.counts
        if self.version > 1:
            latest = latest.groupBy("key").agg(F.max_by(F.struct("refs", "owner"), "version").alias("c")).select("key", "c.*")
        return latest.select("key", "refs", "owner").where("refs > 0")

    def _with_filters(self, keys: DataFrame, fn: Callable, out: str) -> DataFrame:
        """``fn(shard, hashes, rows of keys, tables)`` for every shard, as rows of schema ``out``."""

        def run(own: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            tables = list(filters["tables"].iloc[0]) if len(filters) else []
            shard = int((own if len(own) else filters)["shard"].iloc[0])
            return fn(shard, own["hash"].to_numpy(np.int64).view(np.uint64) if len(own) else np.zeros(0, np.uint64), own, tables)

        marked = keys.withColumn("shard", self._shard()).withColumn("hash", _hash(F.col("key")))
        return marked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(run, out)

    def _probed(self, held: DataFrame) -> DataFrame:
        """``held`` with ``known``: whether the filters may have a key (what they do not have is new for sure)."""
        kind = held.schema["owner"].dataType.simpleString()

        def ask(shard: int, hashes: np.ndarray, own: pd.DataFrame, tables: list[bytes]) -> pd.DataFrame:
            return pd.DataFrame({"key": own["key"], "refs": own["refs"], "owner": own["owner"], "known": Shard(tables).contains(hashes)})

        return self._with_filters(held, ask, f"key binary, refs long, owner {kind}, known boolean")

    def _changed(self, keys: DataFrame, insert: bool) -> DataFrame:
        """The filters once the given keys are in, or out."""

        def change(shard: int, hashes: np.ndarray, own: pd.DataFrame, tables: list[bytes]) -> pd.DataFrame:
            filters = Shard(tables)
            (filters.insert if insert else filters.remove)(hashes)
            return pd.DataFrame({"shard": [shard], "tables": [filters.tables()]})

        return stored(self._with_filters(keys.select("key"), change, "shard int, tables array<binary>"), "line-filters")

    def _grown(self, keys: int) -> LineStore:
        """The store with enough shards for so many keys; filters are made anew from the exact counts."""
        needed = 1 << max(0, (keys - 1) // PER_SHARD).bit_length()
        if needed <= self.shards:
            return self
        wider = replace(self, shards=needed, filters=self.filters.limit(0))
        return replace(wider, filters=wider._changed(self.current(), True)) if self.version else wider

    def insert(self, refs: DataFrame) -> LineStore:
        """The store with more documents, given by their ``references``."""
        held = refs.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("owner"))
        own = self._grown(self.counts.count() + refs.count())
        if own.version:
            probed = stored(own._probed(held), "line-probes")
            before = own.current().select("key", F.col("refs").alias("had"), F.col("owner").alias("of"))
            met = probed.where("known").join(before, "key", "left")
            met = met.select("key", (F.col("refs") + F.coalesce("had", F.lit(0))).alias("refs"), F.least("owner", "of").alias("owner"), F.col("had").isNull().alias("fresh"))
            held = probed.where("NOT known").select("key", "refs", "owner").withColumn("fresh", F.lit(True)).unionByName(met)
        else:
            held = held.withColumn("fresh", F.lit(True))
        touched = stored(held.withColumn("version", F.lit(own.version + 1)), "line-counts")
        filters = own._changed(touched.where("fresh"), True)
        counts = touched.drop("fresh")
        return replace(own, refs=own.refs.unionByName(refs) if own.version else refs, counts=own.counts.unionByName(counts) if own.version else counts, filters=filters, version=own.version + 1)

    def delete(self, ids: DataFrame) -> LineStore:
        """The store without the documents of ``ids`` (doc_id); ids that it does not have change nothing."""
        if not self.version:
            return self
        gone = ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
        left = stored(self.refs.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-refs")
        lost = self.refs.join(gone, "doc_id", "left_semi").select("key").distinct()
        now = left.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("owner"))
        touched = lost.join(now, "key", "left").select("key", F.coalesce("refs", F.lit(0)).alias("refs"), "owner").withColumn("version", F.lit(self.version + 1))
        touched = stored(touched, "line-counts")
        filters = self._changed(touched.where("refs = 0"), False)
        return replace(self, refs=left, counts=self.counts.unionByName(touched), filters=filters, version=self.version + 1)


def empty_store(spark: SparkSession, doc_id: str = "bigint") -> LineStore:
    made = [spark.createDataFrame([], s) for s in (f"key binary, doc_id {doc_id}", f"key binary, refs bigint, owner {doc_id}, version int", "shard int, tables array<binary>")]
    return LineStore(*made)


def deduplicated(store: LineStore, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): documents of the store without the lines that smaller documents own."""
    shared = stored(store.current().where("refs >= 2"), "line-shared")
    often = F.col("refs") > store.refs.count() / HOT_KEYS
    hot, rest = (shared.where(x).select("key", "owner") for x in (often, ~often))
    met = store.refs.join(F.broadcast(hot), "key").unionByName(store.refs.join(F.broadcast(hot), "key", "left_anti").join(rest, "key"))
    dropped = met.where("doc_id > owner").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    met = docs.select("doc_id", "text").join(dropped, "doc_id", "left").select("doc_id", "text", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            kept, lines, less = [], [], []
            for text, keys in zip(utf8_values(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = (text or b"").split(b"\n")
                gone = set(keys or ())
                left = [line for line in own if line_key(line) not in gone] if gone else own
                kept.append(b"\n".join(left))
                lines.append(len(own))
                less.append(len(own) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(less, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(met, run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def inserted(docs: DataFrame, batches: int = BATCHES) -> LineStore:
    """A store of all documents, inserted in so many batches; the result does not depend on their number."""
    refs = stored(references(docs), "line-refs")
    store = empty_store(docs.sparkSession, docs.schema["doc_id"].dataType.simpleString())
    for k in range(batches):
        store = store.insert(refs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return store


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicated(inserted(docs), docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS nth FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, FALSE)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT coalesce(gone, FALSE)), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""
