"""Conversation structure repair with an audit of the cheapest edits.

A repaired conversation's roles are nothing, or an optional system turn and then user and assistant in turn. Rows are
kept (K), given another role (R), deleted (D), or empty turns are inserted (I); of the cheapest edits the ASCII-least
string of initials is the audit.

Method. A dynamic program over four states (nothing yet, after system, after user, after assistant) keeps, for each
state, its cost and its edits so far as a node of a tree: nodes link to the edit before, so prefixes are shared, and
carry a rolling hash and binary-lifting ancestors. Where costs tie, the strings' longest common prefix is searched by the
ancestors' hashes, and the letters after it decide. Equal hashes are verified letter by letter until the chains meet; a
collision falls back to the letters. An insertion never stands before a deletion (the other order costs the same and is
ASCII-less), so strings that end at the same row never are prefixes of one another.

A conversation of any length is spread over tasks. Rows are ordered by range partitioning and cut into blocks of at most
``BLOCK`` rows. A block's program runs from every state in which it may start, and leaves for each start and end the cost,
the edits, and the ends' ASCII order: four by four numbers, enough to go on, as the order of two whole strings is decided
by their first blocks that differ. A second, small pass goes through each conversation's blocks, picks the states between
them, and every block then knows its edits. Reading the result back for digests streams a conversation in order.

Nulls and edges. A null turn comes first; a null role or text is one space; a null ``conv_id`` is a conversation. Rows of
equal turn go by role, then text; equal rows are counted and travel as one. A row whose role is empty has no initial, so
it cannot be kept. A conversation without rows keeps its line, with zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import crc32_mod, map_arrow, stored, table

BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What an initial leads to from each.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The only role that may be put into, or given in, a state, and the edits that end a conversation from it.
FITTING = ["user", "user", "assistant", "user"]
ENDING = ["", "II", "I", ""]


def _after(state: int, letter: str, initial: str) -> int | None:
    return NEXT[state].get(initial) if letter == "K" else NEXT[state][FITTING[state][0]]


def _moves(initial: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of the cheapest ways to take in a row without deleting it; ties ASCII-least."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, inserts, letter in product(range(4), range(3), "KR"):
        at = start
        for _ in range(inserts):
            at = _after(at, "I", "")
        if (to := _after(at, letter, initial)) is not None:
            way = (INSERT * inserts + REROLE * (letter == "R"), "I" * inserts + letter)
            best[start, to] = min(way, best.get((start, to), way))
    return [(start, to, *way) for (start, to), way in best.items()]


MOVES = {initial: _moves(initial) for initial in ("s", "u", "a", "")}


class Edits:
    """Edit strings as linked nodes; node 0 is the empty string."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus = modulus
        self.letters, self.times, self.depths, self.hashes, self.ups = [""], [0], [0], [0], [[]]

    def add(self, before: int, letter: str, times: int = 1) -> int:
        ups, step = [before], 0
        while step < len(self.ups[ups[step]]):
            ups.append(self.ups[ups[step]][step])
            step += 1
        self.letters.append(letter)
        self.times.append(times)
        self.depths.append(self.depths[before] + 1)
        self.hashes.append((self.hashes[before] * 1_000_003 + ord(letter)) % self.modulus)
        self.ups.append(ups)
        return len(self.letters) - 1

    def extend(self, node: int, letters: str) -> int:
        for letter in letters:
            node = self.add(node, letter)
        return node

    def text(self, node: int) -> str:
        parts = []
        while node:
            parts.append(self.letters[node] * self.times[node])
            node = self.ups[node][0]
        return "".join(reversed(parts))

    def _lift(self, node: int, depth: int) -> int:
        gap = self.depths[node] - depth
        while gap:
            step = gap.bit_length() - 1
            node, gap = self.ups[node][step], gap - (1 << step)
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two strings of one length whose hashes are equal are equal."""
        while a != b:
            if self.letters[a] != self.letters[b]:
                return False
            a, b = self.ups[a][0], self.ups[b][0]
        return True

    def _by_letters(self, a: int, b: int) -> bool:
        least = min(self.depths[a], self.depths[b])
        x, y, less = self._lift(a, least), self._lift(b, least), self.depths[a] < self.depths[b]
        while x != y:
            if self.letters[x] != self.letters[y]:
                less = self.letters[x] < self.letters[y]
            x, y = self.ups[x][0], self.ups[y][0]
        return less

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` is ASCII-less than ``b``."""
        least = min(self.depths[a], self.depths[b])
        x, y = self._lift(a, least), self._lift(b, least)
        if self.hashes[x] == self.hashes[y]:
            return self.depths[a] < self.depths[b] if self._same(x, y) else self._by_letters(a, b)
        for step in reversed(range(len(self.ups[x]))):
            if step < len(self.ups[x]):
                p, q = self.ups[x][step], self.ups[y][step]
                if self.hashes[p] != self.hashes[q]:
                    x, y = p, q
        if not self._same(self.ups[x][0], self.ups[y][0]):
            return self._by_letters(a, b)
        return self.letters[x] < self.letters[y]


class Block:
    """The program over the rows of one block, from every state in which it may start."""

    def __init__(self, starts: range, modulus: int = (1 << 61) - 1):
        self.edits = Edits(modulus)
        self.best = {start: {start: (0, 0)} for start in starts}

    def take(self, initial: str, fault: str, copies: int) -> None:
        for start, known in self.best.items():
            self.best[start] = self._step(known, initial, fault, copies)

    def _step(self, known: dict[int, tuple[int, int]], initial: str, fault: str, copies: int) -> dict[int, tuple[int, int]]:
        if fault in ("blank", "duplicate"):
            return {s: (cost + DELETE * copies, self.edits.add(node, "D", copies)) for s, (cost, node) in known.items()}
        ways: dict[int, list[tuple[int, int, str]]] = {s: [(cost + DELETE, node, "D")] for s, (cost, node) in known.items()}
        for s, to, cost, letters in MOVES.get(initial, MOVES[""]):
            if s in known:
                ways.setdefault(to, []).append((known[s][0] + cost + TRUNCATED * (fault == "truncated"), known[s][1], letters))
        after = {}
        for to, found in ways.items():
            cost = min(way[0] for way in found)
            least = None
            for _, node, letters in (way for way in found if way[0] == cost):
                node = self.edits.extend(node, letters)
                if least is None or self.edits.less(node, least):
                    least = node
            after[to] = (cost, least)
        if copies > 1:
            after = {s: (cost + DELETE * (copies - 1), self.edits.add(node, "D", copies - 1)) for s, (cost, node) in after.items()}
        return after

    def paths(self) -> list[tuple[int, int, int, int, str]]:
        """(start, end, cost, place among the start's ends in ASCII order, edits)."""
        out = []
        for start, known in self.best.items():
            texts = sorted((self.edits.text(node), end, cost) for end, (cost, node) in known.items())
            out += [(start, end, cost, place, text) for place, (text, end, cost) in enumerate(texts)]
        return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that their key calls for, and how many of each there are (``copies``)."""
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], crc32_mod(key, 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.where("code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and their first fault: blank, duplicate, truncated or none (empty).

    The first row of a role and text within a conversation is a minimum by key; rows meet it by their whole key, so a
    conversation, or a text, of any size is spread.
    """
    key = F.unhex(F.sha2("text", 256))
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", key)
    first = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    first = first.select("conv_id", "role", "digest", F.col("at.turn").alias("turn"), F.lit(True).alias("first"))
    met = own.alias("o").join(first.alias("f"), F.expr("o.conv_id <=> f.conv_id AND o.turn <=> f.turn AND o.role = f.role AND o.digest = f.digest"), "left")
    seen = F.rtrim(F.col("o.text"), F.lit(SPACES))
    fault = F.when(seen == "", "blank").when(F.col("f.first").isNull(), "duplicate").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return met.select("o.conv_id", "o.turn", "o.role", "o.text", "o.copies", fault.alias("fault"))


PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("edits", pa.string())])


def blocks(faulty: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows in order, cut into blocks (part, block), each block with one more row (``at`` -1) that has its ``paths``."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = faulty.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64)).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "copies", "fault")
    key, turn = (faulty.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    names = ["conv_id", "part", "block", "at", "turn", "role", "text", "copies", "fault", "paths"]
    kinds = [None, pa.int32(), pa.int64(), pa.int64(), None, pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(PATH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, current, own, part = -1, 0, None, None, None
        types = list(kinds)

        def header() -> tuple:
            return (current, part, number, -1, None, None, None, None, None, [dict(zip(PATH.names, p, strict=True)) for p in own.paths()])

        for batch in batches:
            types[0], types[4] = batch.column(0).type, batch.column(2).type
            out = []
            for conv_id, part, turn_no, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv_id != current or at >= most:
                    # A partition's first conversation may have begun in the one before, and what is cut goes on from any state.
                    anew = own is not None and conv_id != current
                    if own is not None:
                        out.append(header())
                    number, at, current, own = number + 1, 0, conv_id, Block(range(1) if anew else range(4))
                own.take(role[:1], fault, copies)
                out.append((conv_id, part, number, at, turn_no, role, text, copies, fault, None))
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(header(), types, strict=True)], names)

    schema = f"conv_id {key}, part int, block long, at long, turn {turn}, role string, text string, copies long, fault string, paths array<struct<start: int, end: int, cost: long, place: int, edits: string>>"
    return stored(map_arrow(ranged, run, schema), "blocks")


def chain(headers: DataFrame) -> DataFrame:
    """(part, block, start, end, ending): the states between which each block's edits run, from blocks' costs and orders alone."""
    small = headers.select("conv_id", "part", "block", F.transform("paths", lambda p: F.struct(p["start"], p["end"], p["cost"], p["place"])).alias("paths"))
    ordered = small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    names, kinds = ["part", "block", "start", "end", "ending"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, taken = None, {}, []

        def close() -> list[tuple]:
            end = min(known, key=lambda s: (known[s][0] + INSERT * len(ENDING[s]), known[s][1]))
            out, ending = [], ENDING[end]
            for part, block, came in reversed(taken):
                out.append((part, block, came[end], end, ending))
                end, ending = came[end], ""
            return out

        for batch in batches:
            out = []
            for conv_id, part, block, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not taken or conv_id != current:
                    if taken:
                        out += close()
                    current, known, taken = conv_id, {0: (0, 0)}, []
                after, came = {}, {}
                for p in map(list, (x.values() for x in paths)):
                    start, end, cost, place = p
                    if start in known:
                        way = (known[start][0] + cost, (known[start][1], place))
                        if end not in after or way < after[end]:
                            after[end], came[end] = way, start
                ranks = {order: k for k, order in enumerate(sorted({way[1] for way in after.values()}))}
                known = {end: (cost, ranks[order]) for end, (cost, order) in after.items()}
                taken.append((part, block, came))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if taken:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*close(), strict=True), kinds, strict=True)], names)

    return map_arrow(ordered, run, "part int, block long, start int, end int, ending string")


def repair(rows: DataFrame, conversations: DataFrame, most: int = BLOCK) -> DataFrame:
    """One row an edit, in order within a conversation: its initial, the row that it meets, and the repaired role and text.

    ``rows`` are damaged rows with their copies; ``conversations`` names every conversation. One without rows has a row
    without an edit. Rows of a conversation come one after the other within a partition.
    """
    cut = blocks(faults(rows), most)
    headers = cut.where("at < 0")
    picked = F.filter("paths", lambda p: (p["start"] == F.col("start")) & (p["end"] == F.col("end")))[0]["edits"]
    paths = headers.join(chain(headers), ["part", "block"]).select("conv_id", "part", "block", "at", F.concat(picked, "ending").alias("edits"))
    every = conversations.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("at"))
    united = cut.where("at >= 0").drop("paths").unionByName(paths, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    ordered = united.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "at").select("conv_id", "part", "at", "turn", "role", "text", "copies", "fault", "edits")
    key, turn = (cut.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    names = ["conv_id", "edit", "turn", "old_role", "fault", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, edits, place, state, empty, begun = None, "", 0, 0, True, False

        def inserts() -> Iterator[tuple]:
            nonlocal place, state
            while place < len(edits) and edits[place] == "I":
                yield (current, "I", None, None, None, FITTING[state], "")
                state, place = _after(state, "I", ""), place + 1

        def close() -> Iterator[tuple]:
            yield from inserts()
            if begun and empty:
                yield (current, "", None, None, None, None, None)

        for batch in batches:
            types = [batch.column(0).type, pa.string(), batch.column(3).type, *[pa.string()] * 4]
            out: list[tuple] = []
            for conv_id, part, at, turn_no, role, text, copies, fault, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:  # the first row of each conversation
                    out += close()
                    current, edits, place, state, empty, begun = conv_id, "", 0, 0, True, True
                    continue
                if at < 0:  # the first row of each block; what is left of the one before are no edits
                    edits, place = path, 0
                    continue
                empty = False
                # A deletion never follows an insertion, so insertions here belong to this row.
                out += inserts()
                for copy in range(copies):
                    letter, said = edits[place], fault if not copy or fault == "blank" else "duplicate"
                    place += 1
                    if letter == "D":
                        out.append((conv_id, "D", turn_no, role, said, None, None))
                        continue
                    out.append((conv_id, letter, turn_no, role, said, role if letter == "K" else FITTING[state], text))
                    state = _after(state, letter, role[:1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)
        if begun and (out := list(close())):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)

    return map_arrow(ordered, run, f"conv_id {key}, edit string, turn {turn}, old_role string, fault string, role string, text string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def digests(edits: DataFrame) -> DataFrame:
    """One row a conversation, from the rows of ``repair`` in the order they come in."""
    key = edits.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, done = None, False, []
        counts, audit, sha, said, last, first_turn, last_turn, turns = {}, [], None, False, None, None, None, 0

        def close() -> None:
            gaps = last_turn - first_turn + 1 - turns if turns else 0
            done.append((current, gaps, *[counts[c] for c in COUNTS[1:]], "".join(audit), sha.hexdigest()))

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.column(0).type
            for conv_id, edit, turn, old_role, fault, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != current:
                    if begun:
                        close()
                    current, begun = conv_id, True
                    counts, audit, sha, said, last, first_turn, last_turn, turns = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False, None, None, None, 0
                audit.append(edit)
                counts["cost"] += {"I": INSERT, "D": DELETE, "R": REROLE}.get(edit, 0)
                if edit not in ("", "I"):
                    if fault:
                        counts[fault] += 1
                    if edit != "D" and fault == "truncated":
                        counts["cost"] += TRUNCATED
                    if last is not None and last + old_role[:1] not in ("su", "ua", "au"):
                        counts["illegal"] += 1
                    last = old_role[:1]
                    if turn is not None and turn != last_turn:
                        first_turn, last_turn, turns = turn if first_turn is None else first_turn, turn, turns + 1
                if role is not None:
                    sha.update(f"{chr(10) * said}{role}:{text}".encode())
                    said = True
            if len(done) >= 10_000:
                yield batch_of(kind)
                done = []
        if begun:
            close()
        if done:
            yield batch_of(kind)

    return map_arrow(edits, run, f"conv_id {key}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return digests(repair(damage(conversations), conversations))
