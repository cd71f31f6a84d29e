"""Secret scan with structural confirmation.

Three pattern kinds (assign, access, hex) are reported as they match. Candidates in base64 or hex
are decoded, and reported as ``key`` only if they parse as a key encoding: DER whose nested lengths
agree and whose first members are those of PKCS#1, PKCS#8 or SEC1, or an OpenSSH container. A
dotted triple is reported as ``token`` only if its header decodes to a JSON object naming an
algorithm and its body to JSON.

Defined results: a null or empty text has no spans. Spans of different kinds may overlap; those of
one kind never do. Positions are code points, end exclusive. Repeated rows are scanned alike, and
columns of clashing names are replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import small_batches, widened, without

KINDS = ("assign", "access", "hex", "key", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE64_KEY = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M|b3BlbnNza)[A-Za-z0-9+/_-]{31,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,20})PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]|\\+[nr]){16,}?)-----END \1PRIVATE KEY-----")
#: Where a key may be wrapped: a line end, real or escaped.
WRAP = re.compile(r"[ \t]*(?:\r\n?|\n|\\+r\\+n|\\+[nr])[ \t]*")
CHARS = re.compile(r"[A-Za-z0-9+/_-]*")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
INTEGER, BIT_STRING, OCTETS, OID, SEQUENCE = 2, 3, 4, 6, 0x30


def _members(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill a range exactly; None if lengths disagree."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, size = data[start], data[start + 1]
        start += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size = int.from_bytes(data[start : start + n], "big")
            start += n
        if start + size > end:
            return None
        out.append((tag, start, start + size))
        start += size
    return out


def is_key(data: bytes) -> bool:
    """Whether bytes are a private or public key encoding, by structure."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    outer = _members(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inner = _members(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == INTEGER:
        small = inner[0][2] - inner[0][1] == 1
        if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:
            return small
        if tags[1] == OCTETS:
            return small and data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] >= 16
        if tags[1] == SEQUENCE and len(tags) >= 3 and tags[2] == OCTETS:
            named = _members(data, inner[1][1], inner[1][2])
            return small and bool(named) and named[0][0] == OID
        if tags == [INTEGER] * 6:  # DSA
            return small and data[inner[0][1]] == 0 and inner[1][2] - inner[1][1] >= 64
        return tags == [INTEGER, INTEGER] and inner[0][2] - inner[0][1] >= 64
    if tags == [SEQUENCE, BIT_STRING] or tags == [SEQUENCE, OCTETS] and inner[1][2] - inner[1][1] >= 16:  # the latter is encrypted PKCS#8
        named = _members(data, inner[0][1], inner[0][2])
        return bool(named) and named[0][0] == OID
    return False


def _base64(text: str) -> bytes | None:
    text = "".join(re.sub(r"\\+[nr]", "", text).split()).rstrip("=").translate({45: 43, 95: 47})
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _wrapped(text: str, start: int) -> tuple[int, int] | None:
    """The span of a DER key in base64 that is wrapped over lines: as many characters as its outer length tells."""
    head = _base64(text[start : start + 8]) or b""
    if len(head) < 6 or head[0] != SEQUENCE:
        return None
    more = head[1] & 127 if head[1] > 127 else 0
    if more > 4:
        return None
    need = ((2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])) * 4 + 2) // 3
    at, lines = start, []
    while need and need <= len(text) - at:
        line = CHARS.match(text, at)[0][:need]
        lines.append(line)
        at, need = at + len(line), need - len(line)
        if need:
            wrap = WRAP.match(text, at)
            if not line or not wrap:
                return None
            at = wrap.end()
    if need or CHARS.match(text, at)[0] or not is_key(_base64("".join(lines)) or b""):
        return None
    return start, re.compile("={0,2}").match(text, at).end()


def _is_signed(head: str, body: str) -> bool:
    try:
        header = json.loads(_base64(head) or b"")
        json.loads(_base64(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as in KINDS."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    keys = []
    if "-----BEGIN" in text:
        keys += [m.span() for m in PEM.finditer(text) if (d := _base64(m[2])) and is_key(d)]
    for pattern, decode in ((BASE64_KEY, _base64), (HEX_KEY, lambda x: bytes.fromhex(x[: len(x) // 2 * 2]))):
        for m in pattern.finditer(text):
            if any(a < m.end() and m.start() < b for a, b in keys):
                continue
            if (d := decode(m[0])) and is_key(d):
                keys.append(m.span())
            elif pattern is BASE64_KEY and (wrapped := _wrapped(text, m.start())):
                keys.append(wrapped)
    found += [(*s, 3) for s in keys]
    if "eyJ" in text:
        found += [(*m.span(), 4) for m in SIGNED.finditer(text) if _is_signed(m[1], m[2])]
    return [(a, b, KINDS[k]) for a, k, b in sorted((a, k, b) for a, b, k in found)]


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each maximal covered stretch replaced by a mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out.append(text[at:a] if end < 0 else text[end:a])
            out.append(mark)
            end = b
        end = max(end, b)
    return "".join(out) + text[max(end, 0) :]


def scan(docs: DataFrame, *, text: str = "text", redact: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``secret_spans``; with ``redact`` their text is replaced by a mark
    (the column keeps its place, null stays null)."""
    data = without(docs, "secret_spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            i = batch.schema.get_field_index(text)
            texts = batch.column(i).to_pylist()
            found = [spans_of(t) for t in texts]
            columns = list(batch.columns)
            if redact:
                columns[i] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)], columns[i].type)
            spans = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, spans], [*batch.schema.names, "secret_spans"])

    return data.mapInArrow(work, widened(data.schema, secret_spans="array<struct<kind:string,start:bigint,end:bigint>>"))
