"""Sampled segmentations over a sentence-piece lattice: forward filtering, backward sampling, lossless decoding.

Every way to write a text as a row of vocabulary pieces is a path of its lattice. A piece of rank r has weight
1 / (r + 2.7) to the power ``temper``; a character that no piece covers is spelled in bytes. Forward filtering sums the
weights of all paths to each position; backward sampling draws the last piece in proportion, then the one before it, and
so on, which samples whole paths in proportion to their weights. Draws are hashes of the row's key, the piece run's place
in the text and the position, so the same row always gets the same segmentation.

No piece of the vocabulary holds a line end, or a space after another character (asserted when it is read), so the
lattice falls apart at such places into runs. The distinct runs of up to ``SPAN`` characters of a block are filtered at
once, step by step, and sampled at all their occurrences. A longer run is filtered by itself, whole: the weights of what
ends at each position are looked up by blocks, forwards and once more backwards, so that only one number a character is
kept. Texts are read in parts that end between runs, so memory does not grow with a text, but for its longest run.

Decoding joins the pieces' bytes and drops the one space put before the text, so it gives the text back to the byte.

Nulls and edges. A null or empty text has no ids and decodes to the empty text. Repeated rows (equal key) get equal
segmentations, a null key is one key. The piece mark U+2581 within a text is spelled in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.common import by_bytes, map_arrow, table

SPAN = 48
TEMPER = 1.5
BLOCK_CHARS = 1 << 20
#: Positions of a long run that are looked up together.
LOOKUP = 4096
_CUT = re.compile(r" +[^ \n]*|[^ \n]+|\n").findall
_PART_END = re.compile(r"(?<=[^ ])(?= )|(?<=\n)").search
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Lattice:
    """A vocabulary's pieces by hash, and what is needed to sample and decode."""

    def __init__(self, path: str, temper: float = TEMPER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.spelled, self.byte_ids = [b""] * size, np.zeros(256, np.int32)
        pieces, ids = [], []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)], self.spelled[i] = i, bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append(piece.replace("▁", " "))
                ids.append(i)
                self.spelled[i] = pieces[-1].encode()
        self.longest = max(map(len, pieces))
        assert not any("\n" in p or " " in p.lstrip(" ") for p in pieces), "pieces that reach over a cut"
        rank = np.arange(len(pieces)) + 2.7
        self.ids, self.weight = np.array(ids, np.int32), rank**-temper / (rank**-temper).sum()
        self.spell_weight = float(self.weight.min()) * 1e-3
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        assert len(np.unique(keys)) == len(keys)
        self.keys, self.ids, self.weight = keys[order], self.ids[order], self.weight[order]
        # First key of each slot of the top bits; slots are so many that few keys share one.
        self.slot = np.searchsorted(self.keys >> np.uint64(46), np.arange(_SLOTS + 1)).astype(np.int32)
        self.crowd = int(np.diff(self.slot).max())

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _PRIME + np.uint64(ord(c) + 1)
        return _mix(h)[0]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, -1 if it is none of them."""
        slot = (h >> np.uint64(46)).astype(np.int64)
        place, end = self.slot[slot].astype(np.int64), self.slot[slot + 1]
        found = np.full(len(h), -1)
        live = np.flatnonzero(place < end)
        for _ in range(self.crowd):
            if not len(live):
                break
            hit = self.keys[place[live]] == h[live]
            found[live[hit]] = place[live[hit]]
            live = live[~hit]
            place[live] += 1
            live = live[place[live] < end[live]]
        return found

    def filter(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of all runs at once, step by step from their starts.

        Runs are ranked by falling length, so those that reach a step are the first ones: every step works on slices.
        Cell ``base[step] + rank`` has a run's character at a step. Returns ranks, bases, characters, and for each cell
        the summed shares, by length, of the pieces that end there, and those pieces' places among the keys.
        """
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(runs), np.int64)
        rank[order] = np.arange(len(runs))
        text = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = (np.cumsum(length) - length)[order]
        reach = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        base = np.concatenate([[0], np.cumsum(reach)])
        share = np.zeros((len(text), self.longest), np.float32)
        place = np.full((len(text), self.longest), -1, np.int32)
        chars = np.empty(len(text), np.uint32)
        hashes: list[np.ndarray] = []  # of what starts at each of the last steps, up to here
        alpha = [np.ones(len(runs))]  # weight of all paths to each of the last steps
        for t, m in enumerate(reach.tolist()):
            cell = slice(base[t], base[t] + m)
            chars[cell] = text[first[:m] + t]
            c = chars[cell].astype(np.uint64) + np.uint64(1)
            hashes = [h[:m] * _PRIME + c for h in hashes[-(self.longest - 1) :]] + [c]
            weights, total = [], np.zeros(m)
            for size in range(1, len(hashes) + 1):
                found = self._find(_mix(hashes[-size]))
                hit = np.flatnonzero(found >= 0)
                own = np.zeros(m)
                own[hit] = self.weight[found[hit]] * alpha[-size][hit]
                place[cell, size - 1] = found
                if size == 1:
                    bare = np.flatnonzero(found < 0)
                    own[bare] = self.spell_weight * alpha[-1][bare]
                total += own
                weights.append(total.copy())
            for size, summed in enumerate(weights[:-1]):
                share[cell, size] = summed / total
            share[cell, len(weights) - 1 :] = 1
            alpha = [x[:m] for x in alpha[-(self.longest - 1) :]] + [total]
            if t % self.longest == self.longest - 1:  # only ratios count: keep them near one
                top = np.maximum.reduce(alpha)
                alpha = [x / top for x in alpha]
        return rank, base, chars, share, place

    def _endings(self, codes: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights (positions, lengths) of the pieces that end at the positions from ``begin`` to ``end``."""
        place, weight = np.full((end - begin, self.longest), -1, np.int32), np.zeros((end - begin, self.longest))
        h, power = np.zeros(end - begin, np.uint64), np.ones(1, np.uint64)
        for size in range(1, self.longest + 1):
            own = np.arange(max(begin, size - 1), end)
            h[own - begin] += (codes[own - size + 1] + np.uint64(1)) * power
            power *= _PRIME
            found = self._find(_mix(h[own - begin]))
            place[own - begin, size - 1] = found
            weight[own - begin, size - 1] = np.where(found >= 0, self.weight[found], self.spell_weight * (size == 1))
        return place, weight

    def _filter_long(self, codes: np.ndarray) -> np.ndarray:
        """Log weight of all paths to each position of a run, 0 before its start, after ``longest`` places of -inf."""
        size = self.longest
        alpha = np.full(size + len(codes) + 1, -np.inf)
        alpha[size] = 0
        for begin in range(0, len(codes), LOOKUP):
            _, weight = self._endings(codes, begin, min(len(codes), begin + LOOKUP))
            for t, w in enumerate(weight[:, ::-1], size + begin + 1):
                before = alpha[t - size : t]
                top = before.max()
                alpha[t] = top + np.log(w @ np.exp(before - top))
        return alpha

    def _sample_long(self, codes: np.ndarray, alpha: np.ndarray, seed: np.uint64) -> tuple[list[int], list[int]]:
        """Places of a run's pieces, and the position of each one's last character, drawn backwards."""
        size, at, begin, places, lasts = self.longest, len(codes), len(codes), [], []
        while at:
            if at <= begin:
                begin = (at - 1) // LOOKUP * LOOKUP
                place, weight = self._endings(codes, begin, at)
                draw = ((_mix(seed + np.arange(begin + 1, at + 1).astype(np.uint64) * _PRIME) >> np.uint64(40)) / 2.0**24).astype(np.float32)
            before = alpha[at : at + size][::-1]
            share = np.cumsum(weight[at - 1 - begin] * np.exp(before - before.max()))
            step = min(int((share / share[-1] <= draw[at - 1 - begin]).sum()), size - 1)
            places.append(int(place[at - 1 - begin, step]))
            lasts.append(at - 1)
            at -= step + 1
        return places[::-1], lasts[::-1]

    def sample(self, texts: list[str], keys: list, block: int = BLOCK_CHARS) -> list[np.ndarray]:
        """Piece ids of each text, drawn backwards from each run's end."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts, seeds, of, held = [], [], [], 0

        def drawn() -> None:
            for k, ids in zip(of, self._sample(parts, seeds), strict=True):
                out[k].append(ids)

        for k, text in enumerate(texts):
            whole, at = " " + text if text else "", 0
            while at < len(whole):
                cut = _PART_END(whole, at + block) if len(whole) - at > block else None
                end = cut.start() if cut else len(whole)
                parts.append(whole[at:end])
                seeds.append(crc32(repr((keys[k], at) if at else keys[k]).encode()))
                of.append(k)
                held, at = held + end - at, end
                if held >= block:
                    drawn()
                    parts, seeds, of, held = [], [], [], 0
        drawn()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def _sample(self, parts: list[str], seeds: list[int]) -> list[np.ndarray]:
        index: dict[str, int] = {}
        put = index.setdefault
        found = [[put(run, len(index)) for run in _CUT(part)] for part in parts]
        count = np.array([len(x) for x in found], np.int64)
        if not count.sum():
            return [np.zeros(0, np.int32) for _ in parts]
        runs = list(index)
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        short = np.flatnonzero(length <= SPAN)
        ranks, base, chars, share, place = self.filter([runs[i] for i in short])
        rank = np.zeros(len(runs), np.int64)
        rank[short] = ranks
        own = np.fromiter((r for x in found for r in x), np.int64, int(count.sum()))
        seed = np.repeat(np.array(seeds, np.uint64) << np.uint64(32), count)
        seed += (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        seed = _mix(seed)
        at, ranks, live, steps, drawn = length[own], rank[own], np.flatnonzero(length[own] <= SPAN), [], np.zeros(len(own), np.int64)
        while len(live):
            here = base[at[live] - 1] + ranks[live]
            u = ((_mix(seed[live] + at[live].astype(np.uint64) * _PRIME) >> np.uint64(40)) / 2.0**24).astype(np.float32)
            size = np.minimum((share[here] <= u[:, None]).sum(axis=1), self.longest - 1)
            steps.append((live, place[here, size], here))
            drawn[live] += 1
            at[live] -= size + 1
            live = live[at[live] > 0]
        filtered, longer, first = {}, [], len(chars)
        for who in np.flatnonzero(length[own] > SPAN).tolist():
            run = int(own[who])
            if run not in filtered:
                codes = np.frombuffer(runs[run].encode("utf-32-le", "surrogatepass"), np.uint32)
                filtered[run] = (codes.astype(np.uint64), self._filter_long(codes.astype(np.uint64)), first)
                chars, first = np.concatenate([chars, codes]), first + len(codes)
            codes, alpha, start = filtered[run]
            places, lasts = self._sample_long(codes, alpha, seed[who])
            longer.append((who, places, np.array(lasts) + start))
            drawn[who] = len(places)
        ends = np.cumsum(drawn)
        piece, last = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int64)
        for k, (who, what, here) in enumerate(steps):
            to = ends[who] - 1 - k
            piece[to], last[to] = what, here
        for who, what, here in longer:
            piece[ends[who] - len(what) : ends[who]], last[ends[who] - len(what) : ends[who]] = what, here
        ids, odd = self.ids[piece], np.flatnonzero(piece < 0)
        sizes = np.add.reduceat(np.append(drawn, 0), np.minimum(np.cumsum(count) - count, len(drawn))) * (count > 0)
        if len(odd):
            spelled = [np.frombuffer(chr(int(c)).encode("utf-8", "surrogatepass"), np.uint8) for c in chars[last[odd]]]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(s) for s in spelled]
            to = np.cumsum(times) - times
            rows = np.repeat(np.arange(len(parts)), sizes)
            sizes = np.bincount(np.repeat(rows, times), minlength=len(parts))
            ids = np.repeat(ids, times)
            for k, s in zip(to[odd].tolist(), spelled, strict=True):
                ids[k : k + len(s)] = self.byte_ids[s]
        return np.split(ids, np.cumsum(sizes)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))[1:]


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def encode_sampled(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, sampled piece ids, and whether they decode to the text's very bytes, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model_path)
        for batch in by_bytes(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = own.sample(texts, batch.column(0).to_pylist())
            good = [own.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())), pa.array(good)], ["doc_id", "ids", "lossless"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model_path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int32)).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return encode_sampled(table(spark, sf_dir, "documents"), vocabulary_path()).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")
