"""Language identification: a bidirectional gated recurrent network over bytes.

Method. A text's UTF-8 bytes (A-Z lower-cased), all of them, are read in windows of ``WINDOW`` positions, with
``CONTEXT`` more on either side that warm the states up and get no label here, so that every position is labelled once,
with words on both sides in sight. In each window a forward and a backward gated recurrent unit run over the bytes; a
softmax over both states labels every position. The network is trained in numpy by backpropagation through time on a
bounded sample of labelled documents. A document's probabilities are the mean of its letters' ones (A-Z and bytes beyond
ASCII); the most likely language and its probability are returned.

Memory. Texts are read in slices of about two megabytes and windows in blocks of ``BLOCK``, so a task's memory does not
grow with a batch or a text.

Nulls and edges. A null text, or one without a letter, is ``und`` with score 0. Rows without a language are predicted but
never learned from; without any labelled row everything is ``und``. Ties go to the language that sorts first. Repeated
rows are judged alike; ``keep_identified`` carries other columns along under any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import by_bytes, crc32_mod, map_arrow, stored, table, utf8_values

HIDDEN = 8
WINDOW, CONTEXT = 128, 16
BLOCK = 1024
#: Training sample, for each language: at most so many documents, and so many windows of theirs.
SAMPLE_DOCS = 1000
SAMPLE_WINDOWS = 1500
EPOCHS = 5
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), *range(128, 256)]] = True


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (re.search(rb"[A-Za-z]", text) is not None or any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def windows(size: int) -> list[tuple[int, int, int, int]]:
    """(first byte, first labelled byte, end of the labelled bytes, end) of each window of a text of ``size`` bytes."""
    return [(max(0, at - CONTEXT), at, min(size, at + WINDOW), min(size, at + WINDOW + CONTEXT)) for at in range(0, size, WINDOW)]


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs as a (longest, n) matrix of bytes, longest run first; how many runs reach each step; the order taken."""
    length = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    cells = np.zeros((len(runs), longest), np.uint8)
    cells[np.arange(longest) < length[order][:, None]] = np.frombuffer(b"".join([runs[i] for i in order]), np.uint8)
    reach = (length[:, None] > np.arange(longest)).sum(axis=0)
    return np.ascontiguousarray(cells.T), reach, order


@dataclass
class ByteTagger:
    """Weights: for each direction input table (3h, 256), recurrence (3h, h), output (languages, h); a bias.

    States are (h, n) for n runs at a step, gates stacked in the order keep, reset, candidate.
    """

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> ByteTagger:
        draw = np.random.default_rng(seed)
        w = {"bias": np.zeros(len(languages), np.float32)}
        for way in "fb":
            w[f"x{way}"] = draw.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            w[f"u{way}"] = draw.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
            w[f"o{way}"] = draw.normal(0, hidden**-0.5, (len(languages), hidden)).astype(np.float32)
        return cls(languages, w)

    def _states(self, way: str, cells: np.ndarray, reach: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (steps, h, n) of one direction; ``keep`` gets what the way back needs."""
        x, u = self.weights[f"x{way}"], self.weights[f"u{way}"]
        size, (steps, n) = u.shape[1], cells.shape
        out = np.zeros((steps, size, n), u.dtype)
        h = np.zeros((size, n), u.dtype)
        for t in range(steps) if way == "f" else reversed(range(steps)):
            m = int(reach[t])
            given, before = x.take(cells[t, :m], axis=1, out=np.empty((3 * size, m), x.dtype), mode="clip"), h[:, :m]
            recur = u @ before
            gates = given[: 2 * size]
            gates += recur[: 2 * size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:size], gates[size:]
            new = r * recur[2 * size :]
            new += given[2 * size :]
            np.tanh(new, out=new)
            after = out[t, :, :m]
            np.subtract(before, new, out=after)
            after *= z
            after += new
            if keep is not None:
                keep.append((t, m, before.copy(), z, r, new, recur[2 * size :]))
            h[:, :m] = after
        return out

    def positions(self, cells: np.ndarray, reach: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Language probabilities (steps, languages, n) of every position; beyond a run's end they are zero."""
        p = np.zeros((len(cells), len(self.languages), cells.shape[1]), self.weights["bias"].dtype)
        p += self.weights["bias"][:, None]
        for way in "fb":
            states = self._states(way, cells, reach, None if keep is None else keep.setdefault(way, []))
            p += self.weights[f"o{way}"] @ states
            if keep is not None:
                keep[f"states{way}"] = states
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p *= (np.arange(cells.shape[1]) < reach[:, None])[:, None, :]
        return p

    def gradient(self, cells: np.ndarray, reach: np.ndarray, answer: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean cross entropy of all positions, backwards through time; and that mean."""
        keep: dict = {}
        p = self.positions(cells, reach, keep)
        runs = np.arange(len(answer))
        live, total = runs < reach[:, None], int(reach.sum())
        loss = -np.log(np.maximum(p[:, answer, runs][live], 1e-9)).mean()
        d = p
        d[:, answer, runs] -= live
        d /= total
        grad = {"bias": d.sum(axis=(0, 2))}
        for way in "fb":
            u, o = self.weights[f"u{way}"], self.weights[f"o{way}"]
            size = u.shape[1]
            grad[f"o{way}"] = np.einsum("tln,thn->lh", d, keep[f"states{way}"], optimize=True)
            grad[f"x{way}"], grad[f"u{way}"] = np.zeros_like(self.weights[f"x{way}"]), np.zeros_like(u)
            back, read, into = np.zeros((size, cells.shape[1]), u.dtype), [], []
            for t, m, before, z, r, new, recur_n in reversed(keep[way]):
                dh = back[:, :m] + o.T @ d[t, :, :m]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * recur_n * r * (1 - r)
                read.append(cells[t, :m])
                into.append(np.concatenate([dz, dr, dn]))
                over = np.concatenate([dz, dr, dn * r])
                grad[f"u{way}"] += over @ before.T
                back[:, :m] = dh * z + u.T @ over
            read, into = np.concatenate(read), np.concatenate(into, axis=1)
            for k in range(3 * size):
                grad[f"x{way}"][k] = np.bincount(read, into[k], 256)
        return grad, float(loss)

    def fit(self, runs: list[bytes], answer: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        draw, first, second, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        steps = epochs * -(-len(runs) // batch)
        for _ in range(epochs):
            order, epoch = draw.permutation(len(runs)), []
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                cells, reach, inner = padded([runs[i] for i in own])
                grad, loss = self.gradient(cells, reach, answer[own][inner])
                step += 1
                epoch.append(loss)
                for k, g in grad.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                    pace = rate * (1 - step / (steps + 1)) / (1 - 0.9**step)
                    self.weights[k] -= (pace * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            losses.append(float(np.mean(epoch)))
        return losses

    def label_positions(self, text: bytes) -> list[str]:
        """The language of each byte of a text."""
        text, out = text.lower(), []
        for first, begin, end, stop in windows(len(text)):
            cells, reach, _ = padded([text[first:stop]])
            out += [self.languages[i] for i in self.positions(cells, reach)[begin - first : end - first, :, 0].argmax(axis=1)]
        return out

    def letter_sums(self, texts: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its letters' probabilities (texts, languages), and the number of its letters."""
        sums, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        cut = [(i, *w) for i, text in enumerate(texts) for w in windows(len(text))]
        for at in range(0, len(cut), block):
            own = cut[at : at + block]
            cells, reach, inner = padded([texts[i][first:stop] for i, first, _, _, stop in own])
            of, first, begin, end, _ = np.array(own)[inner].T
            step = np.arange(len(cells))[:, None]
            counted = _LETTERS[cells] & (step >= begin - first) & (step < end - first)
            p = np.einsum("tln,tn->nl", self.positions(cells, reach), counted, optimize=True)
            np.add.at(sums, of, p)
            np.add.at(letters, of, counted.sum(axis=0))
        return sums, letters


def training_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """(lang, bytes) of a bounded sample: for each language the documents of smallest hash, and of their windows again those."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_mod(F.col("doc_id"), 4) != 2))
    languages = sorted(row["lang"] for row in labelled.select("lang").distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True):
                part = [text.lower()[begin:end] for _, begin, end, _ in windows(len(text))]
                found += part
                langs += [lang] * len(part)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    # One ordered limit a language: no language's documents or windows have to meet in one task.
    pick = lambda df, k, *order: reduce(DataFrame.unionByName, [df.where(F.col("lang") == x).orderBy(*order).limit(k) for x in languages], df.limit(0))
    ids = pick(labelled.select("doc_id", "lang").distinct(), sample_docs, F.xxhash64("doc_id"), "doc_id")
    own = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # at most sample_docs rows a language
    drawn = stored(map_arrow(own.select("lang", "text"), cut, "lang string, window binary"), "windows")
    return pick(drawn, sample_windows, F.xxhash64("window"), "window")


def train(docs: DataFrame, hidden: int = HIDDEN, epochs: int = EPOCHS) -> ByteTagger:
    rows = sorted((row["lang"], bytes(row["window"])) for row in training_windows(docs).collect())  # at most SAMPLE_WINDOWS for each language
    languages = sorted({lang for lang, _ in rows})
    model = ByteTagger.fresh(languages, hidden)
    if len(languages) > 1:
        model.fit([window for _, window in rows], np.array([languages.index(lang) for lang, _ in rows]), epochs)
    return model


def pooled(model: ByteTagger, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums, letters = model.letter_sums([(text or b"").lower() for text in texts])
    names, scores = [], []
    for text, own, n in zip(texts, sums, letters, strict=True):
        known = bool(n) and has_letter(text)
        best = int(own.argmax())
        names.append(model.languages[best] if known else "und")
        scores.append(min(1.0, float(own[best] / n)) if known else 0.0)
    return names, scores


def identify(docs: DataFrame, model: ByteTagger) -> DataFrame:
    """The columns of ``docs`` named doc_id and text, with lang_pred and score, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            names, scores = pooled(model, utf8_values(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def op10_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: ByteTagger, least_score: float = 0.35) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has letters and a language of at least ``least_score``."""
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_at):
            found, scores = pooled(model, utf8_values(batch.column(text_at)))
            yield batch.filter(pa.array([name != "und" and score >= least_score for name, score in zip(found, scores, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
