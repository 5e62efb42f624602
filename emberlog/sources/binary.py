"""Binary inputs: mail, printable strings, and archives. Bytes are opened within tasks; what follows is columns again."""

from __future__ import annotations

import bz2
import email
import email.policy
import gzip
import hashlib
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import text
from emberlog.functions.network import find_ipv4, is_public_ipv4
from emberlog.sources.lines import shaped

#: Archive limits: nesting, members, and bytes in all and for one member.
DEPTH, MEMBERS, TOTAL_BYTES, MEMBER_BYTES = 3, 5000, 512 << 20, 256 << 20
RISKY = [".exe", ".scr", ".js", ".vbs", ".bat", ".cmd", ".ps1", ".jar", ".hta", ".lnk", ".iso", ".docm", ".xlsm"]
MOST_URLS, MOST_STRINGS, LEAST_LENGTH = 25, 200_000, 6
#: Rows go back to Spark in frames of at most so many, and of about so many bytes.
FRAME_ROWS, FRAME_BYTES = 2000, 4 << 20


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def members(name: str, data: bytes, depth: int = 0, budget: list[int] | None = None) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, bytes, error) of a file's members, names joined by ``!``; a file that is no archive is its own member."""
    budget = budget if budget is not None else [MEMBERS, TOTAL_BYTES]

    def inner(member: str, body: bytes) -> Iterator:
        if member.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", member):
            yield f"{name}!{member}", None, "path leads out of the archive"
            return
        budget[0], budget[1] = budget[0] - 1, budget[1] - len(body)
        if budget[0] < 0 or budget[1] < 0:
            yield f"{name}!{member}", None, "archive is too large"
        else:
            yield from members(f"{name}!{member}", body, depth + 1, budget)

    try:
        if depth < DEPTH and data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    if info.file_size > MEMBER_BYTES or budget[0] <= 0:
                        yield f"{name}!{info.filename}", None, "member is too large" if info.file_size > MEMBER_BYTES else "archive is too large"
                    else:
                        yield from inner(info.filename, z.read(info))
            return
        if depth < DEPTH and data[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for info in t:
                    if info.isfile():
                        if info.size > MEMBER_BYTES:
                            yield f"{name}!{info.name}", None, "member is too large"
                        else:
                            yield from inner(info.name, t.extractfile(info).read())
            return
        for magic, opener, suffix in ((b"\x1f\x8b", gzip.open, ".gz"), (b"BZh", bz2.open, ".bz2"), (b"\xfd7zXZ\x00", lzma.open, ".xz")):
            if depth < DEPTH and data.startswith(magic):
                with opener(io.BytesIO(data)) as f:
                    body = f.read(MEMBER_BYTES + 1)
                if len(body) > MEMBER_BYTES:
                    yield name, None, "member is too large"
                else:
                    yield from inner(re.split(r"[\\/!]", name)[-1].removesuffix(suffix) or "data", body)
                return
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, RuntimeError) as e:
        yield name, None, f"damaged: {e}"
        return
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        data = data.decode("utf-16", "replace").encode()
    yield name, data, None


def expand_archives(files: DataFrame) -> DataFrame:
    """(file, content, error) of all members of all files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["file"], part["content"], strict=True):
                for row in members(name, bytes(data)):
                    yield pd.DataFrame([row], columns=["file", "content", "error"])

    return files.mapInPandas(run, "file string, content binary, error string")


def text_lines(content: DataFrame) -> DataFrame:
    """Numbered non-blank lines of (file, content)."""
    own = content.where("content IS NOT NULL").select("file", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("id_seq", "raw"))
    return own.where(F.trim("raw") != "").select("file", F.col("id_seq").cast("long").alias("id_seq"), "raw")


def _grouped(rows: Iterator[tuple[object, int]]) -> Iterator[list]:
    """Rows, given with their sizes in bytes, in lists of at most FRAME_ROWS and about FRAME_BYTES: a frame for each row costs more than the row."""
    held, size = [], 0
    for row, own in rows:
        held.append(row)
        size += own
        if len(held) >= FRAME_ROWS or size >= FRAME_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _message(data: bytes) -> dict:
    m = email.message_from_bytes(data, policy=email.policy.compat32)
    addresses = lambda *names: [a.lower() for _, a in getaddresses([str(v) for n in names for v in m.get_all(n, [])]) if "@" in a]
    try:
        when = parsedate_to_datetime(m["Date"]).timestamp() if m["Date"] else None
    except (TypeError, ValueError):
        when = None
    parts, hashes, names = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        if part.get_filename():
            names.append(str(part.get_filename()))
            hashes.append(hashlib.sha256(body).hexdigest())
        elif part.get_content_maintype() == "text":
            parts.append(body.decode("utf-8", "replace"))
    return {
        "at": when, "sender": ",".join(addresses("From")), "recipients": ",".join(addresses("To", "Cc")), "reply_to": ",".join(addresses("Reply-To")),
        "subject": str(m["Subject"] or ""), "received": "\n".join(reversed([str(v) for v in m.get_all("Received", [])])), "auth": " ".join(str(v) for v in m.get_all("Authentication-Results", [])),
        "body": "\n".join(parts), "attachments": ",".join(names), "hashes": ",".join(hashes), "message_id": str(m["Message-ID"] or ""),
    }


def split_mbox(data: bytes) -> list[bytes]:
    parts = re.split(rb"(?m)^From [^\n]*\n", data)
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", p) for p in parts if p.strip()] if data.startswith(b"From ") else [data]


_MAIL = "file string, id_seq long, at double, sender string, recipients string, reply_to string, subject string, received string, auth string, body string, attachments string, hashes string, message_id string"


def mail(content: DataFrame) -> DataFrame:
    """Mail and mailbox files (file, content): headers, addresses, route, checks, links and attachments."""

    def rows(part: pd.DataFrame) -> Iterator[tuple[dict, int]]:
        for name, data in zip(part["file"], part["content"], strict=True):
            for i, m in enumerate(split_mbox(bytes(data))):
                yield {"file": name, "id_seq": i, **_message(m)}, len(m)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in _grouped(rows(part)):
                yield pd.DataFrame(some)

    m = content.where("content IS NOT NULL").select("file", "content").mapInPandas(run, _MAIL)
    urls = F.slice(F.array_distinct(text.every(F.col("body"), text.URL)), 1, MOST_URLS)
    route = F.array_distinct(F.filter(find_ipv4(F.col("received")), is_public_ipv4))
    domain = lambda c: F.regexp_extract(c, r"@([^,\s]+)", 1)
    check = lambda n: F.lower(F.regexp_extract("auth", rf"(?i)\b{n}=([a-z]+)", 1))
    odd_reply = (F.col("reply_to") != "") & (domain(F.col("reply_to")) != domain(F.col("sender")))
    risky = F.exists(F.split(F.lower("attachments"), ","), lambda a: text.any_of([a.endswith(x) for x in RISKY]))
    failed = text.any_of([check(n).isin("fail", "softfail", "permerror") for n in ("spf", "dkim", "dmarc")])
    values = {"email": F.concat_ws(",", F.when(F.col("sender") != "", F.col("sender")), F.when(F.col("recipients") != "", F.col("recipients"))), "sender": F.col("sender"), "recipient": F.col("recipients"), "subject": F.col("subject"), "domain": domain(F.col("sender")), "src_ip": F.array_join(route, ","), "url": F.array_join(urls, ","), "spf": check("spf"), "dkim": check("dkim"), "dmarc": check("dmarc"), "attachment": F.col("attachments"), "sha256": F.col("hashes"), "message_id": F.col("message_id"), "reply_to_mismatch": F.when(odd_reply, "true")}
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())), lambda _, v: v.isNotNull() & (v != ""))
    own = m.withColumn("raw", F.concat_ws("\n", "subject", "received", "auth", "body"))
    return shaped(own, ts=F.timestamp_seconds(F.floor("at")), user=F.get(F.split("sender", ","), F.lit(0)), sev=F.when(risky, "high").when(failed | odd_reply, "medium"), msg=F.concat_ws(" ", F.lit("mail from"), "sender", F.lit("to"), "recipients", "subject"), fields=fields)


# What makes a string found in a binary suspicious.
SUSPICIOUS = {
    "powershell": r"(?i)powershell.*(-enc|-nop|-w hidden|iex|downloadstring)", "cmd": r"(?i)cmd(\.exe)?\s+/c", "credential-tool": r"(?i)mimikatz|sekurlsa|procdump|lsass", "download": r"(?i)certutil.*urlcache|bitsadmin|curl\s+http|wget\s+http",
    "persistence": r"(?i)\\currentversion\\run|schtasks.*\/create|crontab -", "shadow-copies": r"(?i)vssadmin.*delete|wbadmin.*delete|bcdedit.*recoveryenabled", "reverse-shell": r"(?i)/dev/tcp/|nc\s+-e|bash\s+-i",
    "injection": r"VirtualAlloc|WriteProcessMemory|CreateRemoteThread|NtMapViewOfSection", "packer": r"UPX[0-9!]|\.themida|\.vmp0", "key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "cloud-key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", "wallet": r"\bbc1[a-z0-9]{25,60}\b",
    "onion": r"(?i)\b[a-z2-7]{16,56}\.onion\b", "ransom": r"(?i)your files (have been|are) encrypted|decrypt", "registry": r"(?i)HKLM\\|HKEY_LOCAL_MACHINE", "base64": text.BASE64_BLOB, "user-agent": r"Mozilla/[45]\.0", "pdb": r"(?i)[a-z]:\\.*\.pdb",
}


def strings_of(data: bytes) -> list[tuple[int, str, str]]:
    """(offset, encoding, text) of printable runs, one-byte and two-byte, in order of offset."""
    ascii_runs = ((m.start(), "ascii", m[0].decode("ascii")) for m in re.finditer(rb"[\x20-\x7e\t]{%d,}" % LEAST_LENGTH, data))
    wide_runs = ((m.start(), "utf-16le", m[0].decode("utf-16le")) for m in re.finditer(rb"(?:[\x20-\x7e]\x00){%d,}" % LEAST_LENGTH, data))
    return sorted([*ascii_runs, *wide_runs])[:MOST_STRINGS]


def is_junk(value: Column) -> Column:
    """One character over and over, few different ones, or mostly punctuation."""
    chars = F.size(F.array_distinct(F.split(value, "")))
    marks = F.regexp_count(value, F.lit(r"[^A-Za-z0-9\s]"))
    return (chars <= 2) | ((F.length(value) >= 12) & (chars <= 4)) | (marks > 0.5 * F.length(value))


def strings(content: DataFrame) -> DataFrame:
    """Printable strings of binaries, with indicator fields and tags of what looks suspicious."""

    def rows(part: pd.DataFrame) -> Iterator[tuple[tuple, int]]:
        for name, data in zip(part["file"], part["content"], strict=True):
            for i, f in enumerate(strings_of(bytes(data))):
                yield (name, i, *f), len(f[2])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in _grouped(rows(part)):
                yield pd.DataFrame(some, columns=["file", "id_seq", "offset", "encoding", "raw"])

    own = content.where("content IS NOT NULL").select("file", "content").mapInPandas(run, "file string, id_seq long, offset long, encoding string, raw string").where(~is_junk(F.col("raw")))
    tags = F.array_compact(F.array(*[F.when(F.col("raw").rlike(rx), F.lit(tag)) for tag, rx in SUSPICIOUS.items()]))
    values = {"offset": F.col("offset").cast("string"), "encoding": F.col("encoding"), "tags": F.array_join(tags, ","), "url": F.array_join(text.every(F.col("raw"), text.URL), ","), "email": F.array_join(text.every(F.col("raw"), text.EMAIL), ","), "onion": F.array_join(text.every(F.col("raw"), text.ONION), ","), "registry_key": F.array_join(text.every(F.col("raw"), text.REGISTRY), ","), "path": F.array_join(text.every(F.col("raw"), text.WIN_PATH), ",")}
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())), lambda _, v: v != "")
    return shaped(own, sev=F.when(F.size(tags) > 0, "medium").otherwise("info"), fields=fields)
