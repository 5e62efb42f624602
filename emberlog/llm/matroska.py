"""Media columns: Matroska files in a binary column, parsed into packet tables.

``parse`` walks the variable-length EBML elements of a file: tracks, clusters (of known or unknown size), simple blocks
and block groups with no, Xiph, fixed or EBML lacing, and cues. Each frame becomes a packet with its track, timestamp and
byte range in the file. ``mux`` writes 8-bit PCM audio the same way, with cues, changing the lacing from block to block.

Nulls and edges. A null file has no packets and a null error; a damaged one gives the packets before the damage and an
error text. A null text is stored as an empty one. Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.common import by_bytes, map_arrow, table, utf8_values

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TOP_LEVEL = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

FRAME = 192
SAMPLE_RATE = 19_200
FRAME_MS = FRAME * 1000 // SAMPLE_RATE
BLOCK_FRAMES = 8
CLUSTER_FRAMES = 256
XIPH, FIXED, LACED_EBML = 1, 2, 3


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; ``width`` bytes, or as few as hold it (all ones means unknown and is not used)."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(code: int, value: int) -> bytes:
    return element(code, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced_block(frames: list[bytes], ticks: int, lacing: int, track: int = 1) -> bytes:
    """A simple block's body: track, ticks after the cluster's timestamp, flags, lace sizes, frames."""
    if len(frames) == 1:
        lacing = 0
    sizes = [len(f) for f in frames[:-1]]
    head = b""
    if lacing:
        head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif lacing == LACED_EBML:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:], strict=False):
            width = next(n for n in range(1, 9) if abs(b - a) < 1 << 7 * n - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    elif lacing == FIXED and len({*sizes, len(frames[-1])}) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return vint(track) + struct.pack(">hB", ticks, 0x80 | lacing << 1) + head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit mono PCM track that holds ``payload`` (a multiple of FRAME bytes)."""
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
    body = [element(INFO, number(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, element(TRACK_ENTRY, track + element(AUDIO, audio)))]
    at, cues = sum(map(len, body)), []
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    for first in range(0, len(frames), CLUSTER_FRAMES):
        own = frames[first : first + CLUSTER_FRAMES]
        blocks = [
            element(SIMPLE_BLOCK, laced_block(own[k : k + BLOCK_FRAMES], k * FRAME_MS, k // BLOCK_FRAMES % 3 + 1)) for k in range(0, len(own), BLOCK_FRAMES)
        ]
        body.append(element(CLUSTER, number(CLUSTER_TIMESTAMP, first * FRAME_MS) + b"".join(blocks)))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    head = element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(body))


@dataclass
class Parsed:
    tracks: list[dict] = field(default_factory=list)
    #: (track, timestamp in ms, first byte, bytes, keyframe, cluster)
    packets: list[tuple[int, float, int, int, bool, int]] = field(default_factory=list)
    #: (time in ms, track, first byte of the cluster)
    cues: list[tuple[float, int, int]] = field(default_factory=list)
    clusters: int = 0
    error: str | None = None


def _vint(data: bytes, at: int, mask: bool = True) -> tuple[int, int]:
    """The variable-length number at ``at`` and the place after it; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if mask:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def _children(data: bytes, at: int, end: int, open_ended: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, first byte of the body, end) of the elements between two places."""
    while at < end:
        start = at
        code, at = _vint(data, at, False)
        if open_ended and code in TOP_LEVEL:
            yield code, start, start, start
            return
        size, at = _vint(data, at)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {code:x} at byte {start} goes beyond byte {end}")
        yield code, start, at, stop if size >= 0 else -stop
        at = stop


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, ticks, flags and byte ranges of a block's frames."""
    track, at = _vint(data, at)
    ticks, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, ticks, flags, [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == LACED_EBML and count > 1:
        size, at = _vint(data, at)
        sizes = [size]
        for _ in range(count - 2):
            start = at
            step, at = _vint(data, at)
            size += step - (1 << 7 * (at - start) - 1) + 1
            sizes.append(size)
    elif lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"fixed lacing of {end - at} bytes in {count}")
        sizes = [(end - at) // count] * (count - 1)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise ValueError(f"laced frames go beyond byte {end}")
    return track, ticks, flags, [*out, (at, end - at)]


def parse(data: bytes) -> Parsed:
    """Tracks, packets and cues of a Matroska file."""
    out, scale = Parsed(), 1e6
    durations: dict[int, float] = {}  # of a frame, in milliseconds
    samples: dict[int, float] = {}  # bytes a millisecond of uncompressed tracks: their frames last as long as they are

    def block(at: int, end: int, cluster_ticks: int, key: bool | None) -> None:
        track, ticks, flags, frames = _frames(data, at, end)
        time = (cluster_ticks + ticks) * scale / 1e6
        for first, size in frames:
            out.packets.append((track, time, first, size, bool(flags & 0x80) if key is None else key, out.clusters))
            time += durations.get(track) or size / samples.get(track, math.inf)

    def cluster(at: int, end: int, open_ended: bool) -> int:
        ticks = 0
        for code, start, body, stop in _children(data, at, end, open_ended):
            if body == start:
                return start
            if code == CLUSTER_TIMESTAMP:
                ticks = _uint(data, body, stop)
            elif code == SIMPLE_BLOCK:
                block(body, stop, ticks, None)
            elif code == BLOCK_GROUP:
                inner = [*_children(data, body, stop)]
                for c, _, b, e in inner:
                    if c == BLOCK:
                        block(b, e, ticks, all(x[0] != 0xFB for x in inner))
        return end

    def segment(at: int, end: int) -> None:
        nonlocal scale
        base = at
        while at < end:
            for code, start, body, stop in _children(data, at, end):
                at = abs(stop)
                if code == INFO:
                    for c, _, b, e in _children(data, body, at):
                        if c == TIMESTAMP_SCALE:
                            scale = float(_uint(data, b, e))
                elif code == TRACKS:
                    for _, _, b, e in _children(data, body, at):
                        track: dict = {}
                        for c, _, x, y in _children(data, b, e):
                            if c == AUDIO:
                                for c2, _, x2, y2 in _children(data, x, y):
                                    if c2 == SAMPLING_FREQUENCY:
                                        track["rate"] = struct.unpack(">d" if y2 - x2 == 8 else ">f", data[x2:y2])[0]
                                    elif c2 in (CHANNELS, BIT_DEPTH):
                                        track["channels" if c2 == CHANNELS else "bits"] = _uint(data, x2, y2)
                            elif c == CODEC_ID:
                                track["codec"] = data[x:y].decode("ascii", "replace")
                            elif c in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                                track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[c]] = _uint(data, x, y)
                        out.tracks.append(track)
                        durations[track.get("number", 0)] = track.get("default_duration", 0) / 1e6
                        pace = track.get("channels", 1) * track.get("bits", 8) / 8 * track.get("rate", 0) / 1000
                        if track.get("codec", "").startswith("A_PCM") and pace > 0:
                            samples[track.get("number", 0)] = pace
                elif code == CLUSTER:
                    at = cluster(body, at, stop < 0)
                    out.clusters += 1
                    if stop < 0:
                        break  # go on where the cluster of unknown size turned out to end
                elif code == CUES:
                    for _, _, b, e in _children(data, body, at):
                        time, where = 0, []
                        for c, _, x, y in _children(data, b, e):
                            if c == CUE_TIME:
                                time = _uint(data, x, y)
                            elif c == CUE_TRACK_POSITIONS:
                                where.append({c2: _uint(data, x2, y2) for c2, _, x2, y2 in _children(data, x, y)})
                        out.cues += [(time * scale / 1e6, w.get(CUE_TRACK, 0), base + w.get(CUE_CLUSTER_POSITION, 0)) for w in where]

    try:
        for code, _, body, stop in _children(data, 0, len(data)):
            if code == SEGMENT:
                segment(body, abs(stop))
    except (ValueError, IndexError, struct.error) as e:
        out.error = str(e)
    return out


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes, filled with spaces up to a positive multiple of FRAME."""
    raw = text or b""
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, number of text bytes, and the text's payload as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            texts = [x or b"" for x in utf8_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(payload_of(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row a packet of the files in the column ``media``: doc_id, packet, track, ms, start, length, keyframe, cluster."""
    names = ["doc_id", "packet", "track", "ms", "start", "length", "keyframe", "cluster"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parse(data or b"").packets
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
                    columns = [pa.array(list(c), kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), batch.column(0).type), pa.array(range(at, at + len(part)), pa.int64()), *columns], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_arrow(media.select("doc_id", "media"), run, f"doc_id {kind}, packet long, track long, ms double, start long, length long, keyframe boolean, cluster long")


def read_back(media: DataFrame) -> DataFrame:
    """Digests and a feature text of each stored file, from its packets' byte ranges."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(data: bytes | None) -> tuple:
        data = data or b""
        found = parse(data)
        payload = b"".join([data[first : first + size] for _, _, first, size, _, _ in found.packets])
        samples = np.frombuffer(payload, np.uint8)
        spread = f"{samples.mean():.4f}±{samples.std():.4f}" if len(samples) else "-"
        codec = ",".join(t.get("codec", "?") for t in found.tracks) or "-"
        end = found.packets[-1][1] + FRAME_MS if found.packets else 0
        feature = f"{codec};packets={len(found.packets)};clusters={found.clusters};cues={len(found.cues)};ms={end:.0f};samples={spread};error={found.error or '-'}"
        return len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [digest(x.as_py()) for x in batch.column(2)]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
