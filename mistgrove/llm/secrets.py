"""Secrets in texts: an Aho-Corasick pass finds keywords, anchored expressions look only at the hits, checksums decide.

Texts are scanned as UTF-8 bytes with A-Z lower-cased, one byte per character to the automaton, so that offsets
agree; only documents with hits pay for the change to code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import pieces

# Keywords, expressions and least lengths that define the kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Tokens whose last six characters are the CRC-32 of the 30 before, in base 62.
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(rb"(gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "checked")

#: Bytes that are hex digits become 1, others 0: a run of 1s marks a hex string without an expression.
HEX_CLASS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))

OUTPUT = "key long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_WORDS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body: bytes) -> bytes:
    """CRC-32 in base 62, six digits."""
    value, digits = zlib.crc32(body), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return "".join(reversed(digits)).encode()


def spans(text: bytes, keywords) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, by start and kind, of a UTF-8 text."""
    lowered = text.lower()
    hits = [(end + 1 - length, kind) for end, (kind, length) in keywords.iter(lowered.decode("latin-1"))]
    found, until = [], dict.fromkeys(KINDS, 0)
    for start, kind in sorted(hits):
        if start < until[kind]:  # inside an earlier match of its kind
            continue
        match = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)
        if not match:
            continue
        until[kind] = match.end()
        if (len(match[2]) >= ASSIGN_LEAST if kind == "assign" else
                match.end() - start >= ACCESS_LEAST if kind == "access" else checksum(match[2]) == match[3]):
            found.append((start, kind, match.end()))
    flags, run, at = text.translate(HEX_CLASS), b"\x01" * HEX_LEAST, 0
    while (at := flags.find(run, at)) >= 0:
        end = HEX.match(text, at).end()
        found.append((at, "hex", end))
        at = end
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def in_code_points(text: bytes, found: list[tuple[int, str, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) with offsets counted in code points."""
    points, done, count = {}, 0, 0
    for at in sorted({x for start, _, end in found for x in (start, end)}):
        count += len(text[done:at].decode("utf-8", "replace"))
        points[at], done = count, at
    return [(kind, points[start], points[end]) for start, kind, end in found]


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in pieces(batches, 1):
        out = []
        for text in batch.column(1).to_pylist():
            text = text or b""
            found = in_code_points(text, spans(text, keywords))
            counts = [sum(x[0] == kind for x in found) for kind in KINDS]
            listed = [f"{kind}:{start}:{end}" for kind, start, end in found]
            base = ",".join(x for x in listed if not x.startswith("checked:"))
            out.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(listed)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array([x[i] for x in out], kinds[i]) for i in range(6)],
            names=["key", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by kind, the digest of its base spans and all spans (offsets in code points).

    Matches of a kind are leftmost and don't overlap; those too short or of a wrong checksum are dropped after
    that. Null and empty texts have no spans (the digest is that of empty text); texts of any length are
    scanned whole, about 8 MB of texts at a time; repeated rows give repeated rows; an empty table gives an empty one.
    """
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(scanned, OUTPUT).withColumnRenamed("key", key)
