"""Cost-balanced packing of documents into training sequences.

Every document becomes token ids by a public tokenizer, then an end id. A document is cut into pieces of at most
``capacity`` ids. A piece of n ids costs ``LINEAR`` * n + ``QUADRATIC`` * n * n to attend over. A task packs its own
documents, a block of about ``BLOCK_TOKENS`` ids at a time: the block's pieces go, dearest first, each to the sequence
of least cost so far among those that still have room for it. There are just as many sequences as the block's ids fill;
a piece that fits nowhere is cut once more, into the sequences of most room. The last sequence of a block, which its ids
cannot fill, is cut into sequences whose lengths are powers of two, which need no padding.

No row is shuffled: memory is bounded by a block, a hot key cannot gather anywhere, and a lost task packs the same rows
again. Sequence numbers start with the task's number, so they follow the input's splits.

Nulls and edges. A null or empty text is the end id alone. Repeated rows are packed each. An empty table gives an empty
result. A document longer than a block is a block of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack as pack_ids
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.common import by_bytes, map_arrow, table

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
BLOCK_TOKENS = 1 << 20
BLOCK_BYTES = 8 << 20

# Texts of these characters alone go word by word: case folding and composition leave each such character by itself.
_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]+").fullmatch
#: str.split() takes these four for white space, the vocabulary's rule does not.
_SEPARATORS = re.compile("[\x1c-\x1f]").search
_SPACES = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def _byte_letters() -> list[str]:
    """The visible stand-in of each byte in byte-level vocabularies: itself where it is visible, else the next from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


#: A worker keeps the ids of so many words, and of so many of their pieces, from block to block; then it starts anew.
HELD_WORDS, HELD_PIECES = 400_000, 300_000


class WordTokenizer:
    """Token ids of texts, each distinct word of a block encoded once, and few of them again in the next.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its words. A word of plain
    Latin characters is cut as the tokenizer's own split rule does and given to its model; any other word, and one that
    may hold a special token's string, goes through the whole tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_SPACES(text) if _SEPARATORS(text) else text.split() for text in texts]
        if len(self.words) > HELD_WORDS:
            self.words.clear()
        if len(self.pieces) > HELD_PIECES:
            self.pieces.clear()
        ids, known = self.words, self.pieces
        fresh = set().union(*split).difference(ids)
        odd = [w for w in fresh if "<|" in w or not _PLAIN(w)]
        for w, e in zip(odd, self.whole.encode_batch(odd, add_special_tokens=False), strict=True):
            ids[w] = np.array(e.ids, np.uint32).tobytes()
        for w in fresh.difference(odd):
            parts = _SPLIT(w.lower())
            for p in parts:
                if p not in known:
                    text = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
                    found = [t.id for t in self.model.tokenize(text)]
                    known[p] = pack_ids(f"<{len(found)}I", *found)
            ids[w] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        return [np.frombuffer(b"".join([ids[w] for w in own]), np.uint32) for own in split]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of the given lengths.

    All sequences are full but those at the end, whose lengths are powers of two.
    """
    full, left = divmod(sum(lengths), capacity)
    room = [capacity] * full + [1 << bit for bit in range(capacity.bit_length() - 1, -1, -1) if left >> bit & 1]
    pieces = [(min(capacity, n - at), doc, at) for doc, n in enumerate(lengths) for at in range(0, n, capacity)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    spent, placed = [0.0] * len(room), []
    used = [0] * len(room)

    def put(seq: int, doc: int, at: int, n: int) -> None:
        placed.append((doc, at, n, seq, used[seq]))
        used[seq] += n
        spent[seq] += cost(n)

    # Cheapest first; a sequence without room for this piece has none for dearer ones, yet may take later, shorter ones.
    waiting = [(0.0, s) for s in range(len(room))]
    heapify(waiting)
    tight: dict[int, list[int]] = {}
    over = []
    for n, doc, at in pieces:
        # Sequences set aside come back when pieces get as short as their room.
        for size in [s for s in tight if s >= n] if tight else ():
            for seq in tight.pop(size):
                heappush(waiting, (spent[seq], seq))
        found = None
        while waiting:
            _, seq = heappop(waiting)
            free = room[seq] - used[seq]
            if free >= n:
                found = seq
                break
            if free:
                tight.setdefault(free, []).append(seq)
        if found is None:
            over.append((n, doc, at))
            continue
        put(found, doc, at, n)
        heappush(waiting, (spent[found], found))
    rest = sorted(((room[s] - used[s], s) for s in range(len(room)) if room[s] > used[s]), key=lambda x: (x[0], -x[1]))
    for n, doc, at in over:
        while n:
            free, seq = rest.pop()
            part = min(n, free)
            put(seq, doc, at, part)
            n, at = n - part, at + part
            if part < free:
                rest.append((free - part, seq))
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 33

        def packed(keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal first
            placed = pack([len(x) for x in ids], capacity)
            own = [ids[doc][at : at + n].astype("<u4") for doc, at, n, _, _ in placed]
            columns = [
                pa.array([keys[p[0]] for p in placed], kind),
                *[pa.array(x, pa.int64()) for x in ([p[1] for p in placed], [p[2] for p in placed], [crc32(x) for x in own], [len(ids[p[0]]) for p in placed], [first + p[3] for p in placed], [p[4] for p in placed])],
            ]
            if with_ids:
                flat = np.concatenate(own) if own else np.zeros(0, "<u4")
                columns.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), pa.array(flat.astype(np.int32))))
            first += max([p[3] for p in placed], default=-1) + 1
            return pa.RecordBatch.from_arrays(columns, names)

        end, keys, ids, size, kind = np.array([END_ID], np.uint32), [], [], 0, pa.int64()

        def blocks() -> Iterator[tuple[list, list[str]]]:
            """Keys and texts of about BLOCK_BYTES: the more texts at once, the fewer words are encoded again."""
            nonlocal kind
            some, texts, held = [], [], 0
            for batch in by_bytes(batches, 1, BLOCK_BYTES):
                kind = batch.column(0).type
                some += batch.column(0).to_pylist()
                texts += [x or "" for x in batch.column(1).to_pylist()]
                held += batch.column(1).nbytes
                if held >= BLOCK_BYTES:
                    yield some, texts
                    some, texts, held = [], [], 0
            yield some, texts

        for some, texts in blocks():
            for key, own in zip(some, encoder.encode(texts), strict=True):
                keys.append(key)
                ids.append(np.concatenate([own, end]))
                size += len(own) + 1
                if size >= BLOCK_TOKENS:
                    yield packed(keys, ids)
                    keys, ids, size = [], [], 0
        if ids:
            yield packed(keys, ids)

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
