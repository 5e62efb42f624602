"""LM scoring with a probabilistic suffix tree over words.

Symbols are words (runs of anything but ASCII white space, A-Z lower-cased) and one end mark a document. The tree's root
is the smoothed unigram distribution of the training part; its other nodes are contexts of one to ``DEPTH`` words.

Learning. Every string of up to ``DEPTH`` + 1 symbols that occurs at least ``LEAST`` times in training, at any size of the
input, is counted, so the tree grows with it. A string can only be that frequent if its parts are: the first pass counts
words, the second pairs of frequent words, the third longer strings of frequent pairs. Which are frequent is told to the
workers by bit filters of bounded size; what a filter lets through in vain is counted as well and falls short. The second pass
only makes such a filter, so it counts cells of keys, more of them the larger the input; the third counts whole keys. Both
deal sorted, packed counts to ranges of keys. A key and some bits of its context's tell the context, the last symbol and the
string without the first one (``suffixes``), so that frequent strings alone carry these. A context stays if its next-symbol distribution diverges from its parent's (the longest shorter context that stays):
n * KL must exceed ``DIVERGENCE`` * log(n) for each next symbol that it tells apart. These symbols keep their counts,
smoothed with ``SMOOTHING`` times the parent's distribution; the rest share what is left in proportion to the parent's.
The tests are grouped aggregations and joins of written tables, one round for each length.

Scoring. The longest context that stays gives a token's probability. Its logarithm is the unigram one plus one term for
each context on the way and one for each listed next symbol, so a document's score is a sum over strings in any order.
The commonest strings and words (as many as ``HEAD_STRINGS`` and 1 / ``P_HEAD``) are broadcast, the others meet their values
in a shuffled join, pre-summed by document; where the border lies does not change a result.

Nulls and edges. A null or empty text is one end mark. Repeated rows are scored one by one. Ids may be of any type.
Without any training row all counts are zero and every token has probability 1 (0.1 / 0.1).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import FILTER_BITS, WORDS, in_filter, key_filter, map_arrow, stored, table, utf8_values

#: Words of the longest context, and how often a string must occur in training to be told apart.
DEPTH = 4
LEAST = 64
DIVERGENCE = 1.0
SMOOTHING = 5.0
#: What is broadcast: words of at least this share of the training positions, so many strings.
P_HEAD = 2e-6
HEAD_STRINGS = 1 << 20
END = b" "
#: Documents of about so many bytes are counted together; a task sends its word counts once it holds so many words.
BLOCK = 3 << 20
HELD_WORDS = 250_000
#: A task sends its counts of pairs and strings once it holds so many; a range has so many cells of pairs (logarithm), or some strings for so many tokens.
HELD_COUNTS = 1 << 20
RANGE_BITS, RANGE_TOKENS = 22, 1 << 19
#: Words have no spaces, so this marks a string's key among words.
_STRING = b" s"


def is_held_out(doc_id) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def tokens(text: bytes | None) -> list[bytes]:
    return [*WORDS((text or b"").lower()), END]


def _blocks(batches: Iterator[pa.RecordBatch], train_only: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Document ids and token lists of about BLOCK bytes of text at a time."""
    ids, found, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True):
            if train_only and is_held_out(doc_id):
                continue
            ids.append(doc_id)
            found.append(tokens(text))
            size += len(text or b"")
            if size >= BLOCK:
                yield ids, found
                ids, found, size = [], [], 0
    if ids:
        yield ids, found


_ODD, _STEP = 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(29))


def _unmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))) * np.uint64(pow(_ODD, -1, 1 << 64))
    return h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))


def _longer(contexts: np.ndarray, last: np.ndarray, n: np.ndarray | np.uint64) -> np.ndarray:
    """Keys of strings of n symbols from those of their contexts and of their last symbols."""
    return _mix(contexts * np.uint64(_STEP) + last + n)


def suffixes(keys: np.ndarray, contexts: np.ndarray, context_suffixes: np.ndarray, n: int) -> np.ndarray:
    """Keys of strings of n symbols without their first one; of no string where the context is another's."""
    last = _unmix(keys) - contexts * np.uint64(_STEP) - np.uint64(n)
    return last if n == 2 else _longer(context_suffixes, last, np.uint64(n - 1))


class Strings:
    """A block's tokens as numbers of its distinct words, and the strings that can be frequent by the filters of words and pairs.

    ``ends[n - 1]`` has the tokens at which such strings of n symbols end, in order, ``keys[n - 1]`` their keys, and ``at``
    looks a key up by length and token. A string's context, the string without its last symbol, is the one of length
    n - 1 that ends at the token before; the string without its first symbol the one of length n - 1 at the same token.
    """

    def __init__(self, found: list[list[bytes]], longest: int, words: np.ndarray, pairs: np.ndarray | None):
        local: dict[bytes, int] = {}
        put = local.setdefault
        self.x = np.fromiter((put(w, len(local)) for own in found for w in own), np.int64)
        self.words = list(local)
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.words), np.uint64, len(self.words))
        self.known = in_filter(words, self.codes)
        first = np.zeros(len(self.x), bool)
        first[self.starts] = True
        one = self.known[self.x]
        self.ends, self.keys, self._at = [np.flatnonzero(one)], [self.codes[self.x[one]]], []
        self._keep()
        two = np.flatnonzero(one[1:] & one[:-1] & ~first[1:]) + 1
        for n in range(2, longest + 1):
            before = self.at(n - 1, two - 1)
            some = two if n == 2 else two[before != 0]
            key = _longer(before[before != 0], self.codes[self.x[some]], np.uint64(n))
            if n == 2 and pairs is not None:
                likely = in_filter(pairs, key)
                some, key = some[likely], key[likely]
            two = some if n == 2 else two
            self.ends.append(some)
            self.keys.append(key)
            self._keep()

    def _keep(self) -> None:
        full = np.zeros(len(self.x), np.uint64)
        full[self.ends[-1]] = self.keys[-1]
        self._at.append(full)

    def at(self, n: int, tokens: np.ndarray) -> np.ndarray:
        """Keys of the strings of n symbols that end at the given tokens, 0 where there is no likely one."""
        return self._at[n - 1][tokens]

    def followed(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that follow a string of n symbols within its document, and that string's keys."""
        after = self.ends[n - 1] + 1
        last = np.zeros(len(self.x) + 1, bool)
        last[self.starts + self.lengths] = True
        inside = ~last[after]
        return after[inside], self.keys[n - 1][inside]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            listed = list(words)
            for at in range(0, len(listed), 50_000):
                part = listed[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([words[w] for w in part], pa.int64())], ["word", "n"])
            words.clear()

        for _, found in _blocks(batches, True):
            for own in found:
                words.update(own)
            if len(words) >= HELD_WORDS:
                yield from sent()
        yield from sent()

    return map_arrow(docs.select("doc_id", "text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _planes(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each range's numbers as bytes, those of one place together, so that the shuffle's compression meets runs."""
    size = values.dtype.itemsize
    return [values[a:b].view(np.uint8).reshape(-1, size).T.tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]


def _read(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel() for x in column.to_pylist()]


def _summed(keys: np.ndarray, n: np.ndarray, hints: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys in order, their summed counts, and the hint of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first, dtype=n.dtype) if len(first) else n, None if hints is None else hints[order[first]]


def _dealt(parts: list[tuple], shift: int) -> Iterator[pa.RecordBatch]:
    """Rows (range, keys, n, hints) of a task's counts: a range has the keys of equal bits above ``shift``, as steps from one to the next."""
    if not parts:
        return
    keys, n, hints = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]) if len(parts[0]) > 2 else None)
    if not len(keys):
        return
    ranges = keys >> np.uint64(shift)
    start = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[start] = keys[start] - (ranges[start] << np.uint64(shift))
    ends, at = np.append(start[1:], len(keys)), 0
    while at < len(ends):
        # About 250,000 keys a batch.
        stop = max(at + 1, int(np.searchsorted(ends, start[at] + 250_000, side="right")))
        a, b, own = start[at], ends[stop - 1], ends[at:stop] - start[at]
        told = [pa.nulls(stop - at, pa.binary())] if hints is None else [pa.array(_planes(hints[a:b], own), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(ranges[start[at:stop]].view(np.int64)), pa.array(_planes(steps[a:b], own), pa.binary()), pa.array(_planes(n[a:b], own), pa.binary()), *told], ["range", "keys", "n", "hints"])
        at = stop


def _counted(docs: DataFrame, shift: int, keys_of) -> DataFrame:
    """(range, keys, n, hints) over the training documents; ``keys_of`` gives the counted keys of a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, found in _blocks(batches, True):
            for part in keys_of(found):
                parts.append(part)
                held += len(part[0])
            if held >= HELD_COUNTS:
                yield from _dealt(parts, shift)
                parts, held = [], 0
        yield from _dealt(parts, shift)

    return map_arrow(docs.select("doc_id", "text"), count, "range long, keys binary, n binary, hints binary")


def frequent_pairs(docs: DataFrame, words: np.ndarray, total: int, least: int) -> DataFrame:
    """(key): the low bits of the keys of the pairs of likely words that ``least`` occurrences can have, over the training documents.

    Eight cells for each training token, and as many as a filter has; pairs that share a cell count together, so none is missed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    bits = max(FILTER_BITS[1], math.ceil(math.log2(8 * total + 1)))

    def keys_of(found: list[list[bytes]]) -> Iterator[tuple]:
        cells, n = np.unique(Strings(found, 2, shared.value, None).keys[1] & np.uint64((1 << bits) - 1), return_counts=True)
        yield cells, n.astype(np.int32)

    def whole(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << RANGE_BITS, np.int64)
        for steps, n in zip(_read(table["keys"], np.uint64), _read(table["n"], np.int32), strict=True):
            sums[np.cumsum(steps).view(np.int64)] += n  # a row has a cell once
        cells = np.flatnonzero(sums >= least) + (table["range"][0].as_py() << RANGE_BITS)
        return pa.table({"key": pa.array(cells, pa.int64())})

    return _counted(docs, RANGE_BITS, keys_of).groupBy("range").applyInArrow(whole, "key long")


def _length_bits(depth: int) -> int:
    """Of a number of 32 bits that has a string's length and, in the others, the low bits of its context's key."""
    return (depth + 1).bit_length()


def frequent_strings(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, depth: int, total: int, least: int) -> DataFrame:
    """(key, length, hint, n) of the strings of two to ``depth`` + 1 symbols that occur ``least`` times in the training documents; ``hint`` has the low bits of the context's key."""
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs))
    length_bits = _length_bits(depth)
    shift = 64 - max(6, math.ceil(math.log2(total / RANGE_TOKENS + 1)))

    def keys_of(found: list[list[bytes]]) -> Iterator[tuple]:
        own = Strings(found, depth + 1, *shared.value)
        for n in range(2, depth + 2):
            keys, first, many = np.unique(own.keys[n - 1], return_index=True, return_counts=True)
            contexts = own.at(n - 1, own.ends[n - 1][first] - 1)
            yield keys, many.astype(np.int32), (contexts << np.uint64(length_bits) | np.uint64(n)).astype(np.uint32)  # the low 32 bits

    def whole(table: pa.Table) -> pa.Table:
        start = np.uint64(table["range"][0].as_py() << shift)
        keys = np.concatenate([np.cumsum(x) + start for x in _read(table["keys"], np.uint64)])
        keys, n, hints = _summed(keys, np.concatenate(_read(table["n"], np.int32)).astype(np.int64), np.concatenate(_read(table["hints"], np.uint32)))
        often = n >= least
        hints = hints[often].astype(np.int64)
        return pa.table({"key": keys[often].view(np.int64), "length": (hints & (1 << length_bits) - 1).astype(np.int32), "hint": hints >> length_bits, "n": n[often]})

    return _counted(docs, shift, keys_of).groupBy("range").applyInArrow(whole, "key long, length int, hint long, n long")


def root_probability(c: Column, total: int, vocabulary: int) -> Column:
    return (c + 0.1) / (total + 0.1 * (vocabulary + 1))


def _suffix_column(length: int):
    def suffix(keys: pd.Series, contexts: pd.Series, context_suffixes: pd.Series) -> pd.Series:
        return pd.Series(suffixes(*(c.to_numpy().view(np.uint64) for c in (keys, contexts, context_suffixes)), length).view(np.int64))

    return F.pandas_udf(suffix, "long")


def grow(words: DataFrame, strings: DataFrame, total: int, vocabulary: int, depth: int) -> DataFrame:
    """(key, is_context, value, n): the terms of all strings whose context stays, and of these contexts.

    ``words`` (key, n) and ``strings`` (key, length, hint, n) have the frequent ones. A string meets all contexts of its hint; with
    another's than its own it has a suffix that no string has. The term of a context is log10 of what a symbol that it does
    not list gets over the parent's probability; a listed symbol adds the rest of its own ratio.
    """
    shorter = words.select("key", "n", root_probability(F.col("n"), total, vocabulary).alias("p"), F.lit(0).cast("long").alias("suffix"))
    out = []
    for length in range(2, depth + 2):
        contexts = shorter.select(F.col("key").bitwiseAND((1 << 32 - _length_bits(depth)) - 1).alias("hint"), F.col("key").alias("context"), F.col("n").alias("of"), F.col("suffix").alias("context_suffix"))
        own = strings.where(F.col("length") == length).select("key", "hint", "n").join(contexts, "hint")
        own = own.select("key", "context", _suffix_column(length)("key", "context", "context_suffix").alias("suffix"), "n", "of")
        own = own.join(shorter.select(F.col("key").alias("suffix"), F.col("p").alias("parent")), "suffix")
        told = own.groupBy("context").agg(
            F.first("of").alias("of"), F.sum("n").alias("seen"), F.count("*").alias("symbols"), F.sum("parent").alias("known"),
            F.sum(F.col("n") * F.log(F.col("n") / F.col("of") / F.col("parent"))).alias("gain"),
        )
        left, free = F.col("of") - F.col("seen"), F.greatest(F.lit(1e-12), 1 - F.col("known"))
        gain = F.col("gain") + F.when(left > 0, left * F.log(left / F.col("of") / free)).otherwise(0.0)
        rest = F.log10((left / free + SMOOTHING) / (F.col("of") + SMOOTHING))
        stays = told.where(gain >= DIVERGENCE * F.log("of") * F.col("symbols")).select("context", rest.alias("rest"), F.col("of").alias("context_n"))
        judged = own.join(stays, "context", "left")
        p = F.when(F.col("rest").isNull(), F.col("parent")).otherwise((F.col("n") + SMOOTHING * F.col("parent")) / (F.col("of") + SMOOTHING))
        shorter = stored(judged.withColumn("p", p), f"strings{length}")
        kept = shorter.where(F.col("rest").isNotNull())
        out.append(kept.select("key", F.lit(False).alias("is_context"), (F.log10(F.col("p") / F.col("parent")) - F.col("rest")).alias("value"), "n"))
        out.append(kept.select(F.col("context").alias("key"), F.lit(True).alias("is_context"), F.col("rest").alias("value"), F.col("context_n").alias("n")).dropDuplicates(["key"]))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return stored(whole, "terms")


class Terms:
    """Values by key: sorted keys behind a table of where each slot of their top bits begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, len(keys).bit_length()))
        slots = np.arange((1 << 64 - int(self.shift)) + 1)
        self.slot = np.searchsorted((self.keys >> self.shift).astype(np.int64), slots).astype(np.int32)
        self.crowd = int(np.diff(self.slot).max(initial=0))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        out, known = np.zeros(len(keys)), np.zeros(len(keys), bool)
        slot = (keys >> self.shift).astype(np.int64)
        place, end = self.slot[slot].astype(np.int64), self.slot[slot + 1]
        live = np.flatnonzero(place < end)
        for _ in range(self.crowd):
            if not len(live):
                break
            hit = self.keys[place[live]] == keys[live]
            out[live[hit]], known[live[hit]] = self.values[place[live[hit]]], True
            live = live[~hit]
            place[live] += 1
            live = live[place[live] < end[live]]
        return out, known


class Model:
    """What workers are told: numbers and logs of head words, filters, head terms of strings and contexts, filter of the others."""

    def __init__(self, index, logs, filters, heads, tails, depth):
        self.index, self.logs, self.filters, self.heads, self.tails, self.depth = index, logs, filters, heads, tails, depth

    def gains(self, own: Strings) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
        """Summed head terms at each token, and (tokens, keys, kind) of those that may have a term elsewhere."""
        gain, elsewhere = np.zeros(len(own.x)), []
        for length in range(2, self.depth + 2):
            for kind, (at, keys) in enumerate(((own.ends[length - 1], own.keys[length - 1]), own.followed(length - 1))):
                values, known = self.heads[kind].get(keys)
                gain[at] += values
                if self.tails[kind] is not None:
                    rest = ~known
                    rest[rest] = in_filter(self.tails[kind], keys[rest])
                    if rest.any():
                        elsewhere.append((at[rest], keys[rest], kind))
        return gain, elsewhere


def learn(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, head_strings: int = HEAD_STRINGS) -> tuple[DataFrame, Model, int, int]:
    """What joins by ``word`` (word, c, value): counts of all words and the terms that are not broadcast; the model; training tokens and distinct ones."""
    words = stored(count_words(docs), "words")
    vocabulary, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    frequent = words.where(F.col("c") >= least).select(F.xxhash64("word").alias("key"), F.col("c").alias("n"))
    word_bits = key_filter(frequent)
    pairs = stored(frequent_pairs(docs, word_bits, total, least), "pairs")
    filters = (word_bits, key_filter(pairs))
    strings = stored(frequent_strings(docs, *filters, depth, total, least), "strings")
    terms = grow(frequent, strings, total, vocabulary, depth)
    # The head ends at the least count that keeps it within its bound.
    border, many = least, 0
    for row in sorted(terms.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("many")).collect(), reverse=True):
        if (many := many + row["many"]) > head_strings:
            border = row["n"] + 1
            break
    heads, tails = [], []
    for is_context in (False, True):
        own = terms.where(F.col("is_context") == is_context)
        head = own.where(F.col("n") >= border).select("key", "value").toArrow()  # both at most head_strings rows
        heads.append(Terms(head["key"].to_numpy().view(np.uint64), head["value"].to_numpy()))
        tails.append(key_filter(own.where(F.col("n") < border).select("key")) if border > least else None)
    top = words.where(F.col("c") >= max(2, math.ceil(P_HEAD * total))).toArrow()  # at most 1 / P_HEAD rows
    index = {w: i for i, w in enumerate(top["word"].to_pylist())}
    named = F.concat(F.lit(bytearray(_STRING)), F.when(F.col("is_context"), F.lit(bytearray(b"c"))).otherwise(F.lit(bytearray(b"s"))), F.to_binary(F.lpad(F.hex("key"), 16, "0"), F.lit("hex")))
    joined = words.select("word", "c", F.lit(None).cast("double").alias("value"))
    joined = joined.unionByName(terms.where(F.col("n") < border).select(named.alias("word"), F.lit(None).cast("long").alias("c"), "value"))
    return joined, Model(index, np.log10(top["c"].to_numpy() + 0.1), filters, heads, tails, depth), total, vocabulary


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, head_strings: int = HEAD_STRINGS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    joined, model, total, vocabulary = learn(docs, depth, least, head_strings)
    norm = math.log10(total + 0.1 * (vocabulary + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType
    names = ["row", "word", "n", "doc_id", "n_tokens", "heads", "head_log", "gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        part, row, id_kind = TaskContext.get().partitionId() << 33, 0, None

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_kind
            for batch in batches:
                id_kind = batch.schema.field(0).type
                yield batch

        for ids, found in _blocks(typed(batches), False):
            own = Strings(found, known.depth + 1, *known.filters)
            numbers = np.fromiter((known.index.get(w, -1) for w in own.words), np.int64, len(own.words))
            inside = numbers[own.x] >= 0
            logs = np.where(numbers >= 0, known.logs[numbers] if len(known.logs) else 0.0, 0.0)[own.x]
            gain, elsewhere = known.gains(own)
            summed, heads, gains = (np.add.reduceat(c, own.starts) for c in (logs, inside.astype(np.int64), gain))
            size = len(found)
            rows = np.arange(part + row, part + row + size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array([b" %d" % r for r in rows.tolist()], pa.binary()), pa.array(np.zeros(size, np.int64)), pa.array(ids, id_kind), pa.array(own.lengths), pa.array(heads), pa.array(summed), pa.array(gains)],
                names,
            )
            doc = np.repeat(np.arange(size), own.lengths)

            def met(at: np.ndarray, what: np.ndarray, spelled) -> Iterator[pa.RecordBatch]:
                """Rows (document, what, times) of the given tokens."""
                order = np.lexsort((what, doc[at]))
                who, what = doc[at][order], what[order]
                first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])])) if len(who) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(who)))
                for k in range(0, len(first), 100_000):
                    some = first[k : k + 100_000]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who[some] + part + row), pa.array(spelled(what[some]), pa.binary()), pa.array(times[k : k + n]), pa.nulls(n, id_kind), *[pa.nulls(n, pa.int64())] * 2, *[pa.nulls(n, pa.float64())] * 2],
                        names,
                    )

            outside = np.flatnonzero(~inside)
            yield from met(outside, own.x[outside], lambda some: [own.words[i] for i in some.tolist()])
            for at, keys, kind in elsewhere:
                yield from met(at, keys, lambda some, mark=_STRING + (b"c" if kind else b"s"): [mark + k.to_bytes(8, "big") for k in some.tolist()])
            row += size

    listed = map_arrow(docs.select("doc_id", "text"), run, f"row long, word binary, n long, doc_id {id_type.simpleString()}, n_tokens long, heads long, head_log double, gain double")
    met = listed.join(joined, "word", "left")  # a document's own row has a word that no text has
    is_word = F.col("n_tokens").isNull() & ~F.startswith("word", F.lit(bytearray(_STRING)))
    per_row = met.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "n_tokens", "heads", "head_log", "gain")],
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.when(is_word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).otherwise(0.0)).alias("tail_log"),
        F.sum(F.coalesce(F.col("n") * F.col("value"), F.lit(0.0))).alias("tail_gain"),
    )
    base = F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * F.lit(norm)
    return per_row.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"),
        "n_tokens",
        (F.col("heads") + F.col("tail_known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + F.col("tail_gain")).alias("score"),
    )


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
