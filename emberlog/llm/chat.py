"""Chat formatting with typed content parts.

A turn's content is a list of typed parts; a visitor flattens text, image, audio and document parts, in order, into text
with one placeholder for each attachment, and records the attachments' references and the tokens they expand to. Turns
are then marked by a template. Control strings within texts are escaped (a backslash goes after their first character,
backslashes are doubled), so they never occur there, and reading back is exact. The loss mask covers assistant texts.

The result has a row a turn: a conversation's text is its turns' texts in order, each with its offset. Turns are
partitioned by conversation, sorted and streamed, so a conversation of any length takes constant memory.

Nulls and edges. Null text counts as empty, null role as the empty role, a null conv_id is a conversation. Rows of equal
turn number are ordered by role, then text. Unknown part types become a placeholder of no tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import map_arrow, table

#: The template: what stands before and after a turn's text, by role; other roles are named within [ROLE] marks.
START = "<s>"
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
UNKNOWN = "<|attachment|>"
CONTROLS = [START, *(m for pair in MARKS.values() for m in pair), *OTHER, *PLACEHOLDERS.values(), UNKNOWN]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"(?s)(?:\[INST\](?P<user>.*?)\[/INST\]|\[OUT\](?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[/TURN\])")

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
TURNS = f"conv_id long, turn long, role string, parts array<{PART}>"
ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

#: What attachments expand to: image patches of this side, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def _size(value: float | None) -> float:
    """A size that counts: nothing, a negative and an endless one, and what is no number, are 0."""
    return value if value is not None and 0 <= value < math.inf else 0


class Flatten:
    """Visits a turn's parts; afterwards ``text`` is its escaped text and ``attachments`` its attachments in order."""

    def __init__(self) -> None:
        self.text, self.attachments = "", []

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text += escape(part["text"] or "")

    def _attach(self, kind: str, mark: str, part: dict, tokens: int) -> None:
        self.text += mark
        self.attachments.append({"kind": kind, "ref": part["ref"], "tokens": tokens})

    def visit_image(self, part: dict) -> None:
        self._attach("image", PLACEHOLDERS["image"], part, math.ceil(_size(part["width"]) / PATCH) * math.ceil(_size(part["height"]) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", PLACEHOLDERS["audio"], part, math.ceil(_size(part["seconds"]) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", PLACEHOLDERS["document"], part, _size(part["pages"]) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self._attach(part["type"] or "unknown", UNKNOWN, part, 0)


def plain_turns(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as turns of one text part each."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *nothing)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.array(part).alias("parts"))


def marked(role: str, text: str) -> tuple[str, int]:
    """A turn's text within its marks, and where the text starts."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    return f"{before}{text}{after}", len(before)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row a turn, in order within a conversation: formatted text, its offset, the loss span within it, attachments."""
    names = ["conv_id", "turn_no", "formatted", "offset", "loss_start", "loss_end", "attachments"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(ATTACHMENT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, offset, begun = None, 0, 0, False
        for batch in batches:
            out = []
            for conv_id, role, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != current:
                    current, number, offset, begun = conv_id, 0, 0, True
                flat = Flatten()
                for part in parts or []:
                    flat.visit(part)
                formatted, start = marked(role or "", flat.text)
                if not number:
                    formatted, start = START + formatted, start + len(START)
                end = start + len(flat.text) if role == "assistant" else start
                out.append((conv_id, number, formatted, offset, start, end, flat.attachments))
                number, offset = number + 1, offset + len(formatted)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), [batch.column(0).type, *kinds], strict=True)], names)

    ordered = turns.withColumn("tie", F.coalesce(F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit("")))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "role", "parts")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, turn_no long, formatted string, offset long, loss_start long, loss_end long, attachments array<struct<kind: string, ref: string, tokens: long>>"
    return map_arrow(ordered, run, schema)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = _TURN.fullmatch(formatted.removeprefix(START))
    if not found:
        raise ValueError("not a formatted turn")
    for role in MARKS:
        if found[role] is not None:
            return role, unescape(found[role])
    return unescape(found["role"]), unescape(found["text"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the rows of ``format_turns`` in the order they come in."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        done: list = []

        def close() -> None:
            conv_id, n, turns, chars, loss, size = state
            done.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for conv_id, number, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not number:
                    if state:
                        close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_turn(text)
                learned = unescape(text[start:end])
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(text)
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), [kind, *kinds], strict=True)], names)
                done = []
        if state:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), [kind, *kinds], strict=True)], names)

    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_arrow(formatted.select("conv_id", "turn_no", "formatted", "loss_start", "loss_end"), run, schema)


def op6_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(plain_turns(table(spark, sf_dir, "conversations")).unionByName(plain_turns(added))))


def _escape_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in CONTROLS:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP6_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (length('<s>') + sum(length({_escape_sql("text")}) + CASE role WHEN 'user' THEN length('[INST][/INST]') WHEN 'assistant' THEN length('[OUT]</s>')
    ELSE length('[ROLE][/ROLE][/TURN]') + length({_escape_sql("role")}) END))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
