"""Secret scans with structural confirmation.

Three base patterns are reported as they match. Beyond them, base64, base64url and hex runs are only
candidates: they are decoded and reported if the bytes have the structure of a key. That is a DER
sequence whose nested lengths all fit and whose items are those of a private key (der), an SSH key,
public or private, whose length-prefixed fields end where the blob ends (sshkey), or a signed token
whose header is JSON that names an algorithm (jwt). Certificates and DER public keys hold no secret
and are not reported. Base64 may be wrapped into lines of one width, with or without BEGIN and END
lines; header lines after BEGIN are skipped, and where they declare encryption, whole cipher blocks
are the structure. Scanning is a map over whole texts; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.llm import shared as sh

#: Fixed by the contract of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "jwt", "der", "sshkey")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_HINTS = ("passw", "secret", "token", "api")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Base64 of "{" and a blank, line feed, tab or carriage return.
_BLANK_HEADS = ("eyA", "ewo", "ewk", "ew0")
_BLANK_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:eyA|ewo|ewk|ew0)[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]++)-----((?:[^-]|-(?!----))*+)-----END \1-----")
_BREAK = re.compile(r"\r?\n|(?:\\r)?\\n")
_HEADER = re.compile(r"\s*[A-Za-z][A-Za-z0-9-]*:")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){24,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){24,}(?![0-9A-Za-z])")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
OUT = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 or base64url text, with or without padding."""
    text = re.sub(r"\s|\\n", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(raw: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, int]] | None:
    """(tag, length) of every nested item if all lengths fit exactly, else None."""
    end = len(raw) if end is None else end
    out: list[tuple[int, int]] = []
    while at < end:
        if end - at < 2 or depth > 12:
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or raw[at] == 0:
                return None
            n = int.from_bytes(raw[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        out.append((tag, n))
        if tag & 0x20:
            inner = der_items(raw, at, at + n, depth + 1)
            if inner is None:
                return None
            out += inner
        at += n
    return out


def _children(items: list[tuple[int, int]]) -> list[int]:
    """Tags of the items directly below the first, each followed by a 6 if it is a sequence that begins with an object identifier."""
    out, at, left = [], 1, items[0][1]
    while left > 0:
        tag, n = items[at]
        out.append(tag)
        if tag == 0x30 and n and items[at + 1][0] == 0x06:
            out.append(0x06)
        left -= _size(n)
        at, below = at + 1, n if tag & 0x20 else 0
        while below > 0:
            if not items[at][0] & 0x20:
                below -= _size(items[at][1])
            else:  # its own head only: what it holds follows
                below -= _size(items[at][1]) - items[at][1]
            at += 1
    return out


def _size(n: int) -> int:
    """Bytes of a DER item with n bytes of content."""
    return n + 2 + (0 if n < 0x80 else (n.bit_length() + 7) // 8)


def is_der_key(raw: bytes) -> bool:
    """One sequence that spans all bytes, with 16 bytes or more of key material and the items of a private key.

    Those are three or more integers and nothing else (two are a public key); a version, an algorithm
    and an octet string; a version and an octet string; or, encrypted, an algorithm and an octet string.
    """
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    items = der_items(raw)
    if not items or _size(items[0][1]) != len(raw) or not any(t in (0x02, 0x04) and n >= 16 for t, n in items):
        return False
    tags = _children(items)
    return (len(tags) >= 3 and set(tags) == {0x02}) or tags[:4] == [0x02, 0x30, 0x06, 0x04] or tags[:2] == [0x02, 0x04] or tags == [0x30, 0x06, 0x04]


def _fields(raw: bytes, at: int = 0) -> list[bytes] | None:
    out = []
    while at < len(raw):
        if at + 4 > len(raw):
            return None
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if at + n > len(raw):
            return None
        out.append(raw[at : at + n])
        at += n
    return out


def is_ssh_key(raw: bytes) -> bool:
    """A private key file's magic, or length-prefixed fields whose first names a key type and which end with the bytes."""
    if raw.startswith(b"openssh-key-v1\0"):
        return len(raw) > 40
    if len(raw) < 24 or raw[:2] != b"\0\0":
        return False
    fields = _fields(raw)
    return bool(fields) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def is_signed_token(text: str) -> bool:
    """Header and payload are JSON objects and the header names an algorithm; a signature may be missing only for "none"."""
    head, body, signature = text.split(".", 2)
    try:
        header, claims = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    if not (isinstance(header, dict) and isinstance(claims, dict) and isinstance(header.get("alg"), str)):
        return False
    return bool(signature) or header["alg"].lower() == "none"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping by kind; end exclusive, code points."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]  # a maximal run of [0-9a-f]: runs that are shorter fail
    return out


def _pem_kind(body: str) -> int | None:
    """The kind that the lines between BEGIN and END confirm, after header lines."""
    lines = _BREAK.split(body)
    head = 0
    while head < len(lines) and (not lines[head].strip() or _HEADER.match(lines[head])):
        head += 1
    raw = unbase64("".join(lines[head:]))
    if not raw:
        return None
    if is_der_key(raw):
        return 4
    if is_ssh_key(raw):
        return 5
    return 4 if "ENCRYPTED" in "".join(lines[:head]) and len(raw) >= 24 and len(raw) % 8 == 0 else None


def _wrapped_spans(text: str):
    """(start, kind, end) of keys whose base64 stands in several lines: lines of one width and at most one shorter last one."""
    for m in _WRAPPED.finditer(text):
        lines, at = [], m.start()
        for br in [*_BREAK.finditer(text, m.start(), m.end()), None]:
            end = m.end() if br is None else br.start()
            while text[at] in " \t":
                at += 1
            lines.append((at, end))
            at = end if br is None else br.end()
        k = 0
        while k < len(lines):
            width, last = lines[k][1] - lines[k][0], k + 1
            while last < len(lines) and lines[last][1] - lines[last][0] == width:
                last += 1
            tail = last + 1 if last < len(lines) and lines[last][1] - lines[last][0] < width else last
            for stop in dict.fromkeys((tail, last)):
                if width < 40 or stop - k < 2:
                    continue
                raw = unbase64("".join(text[a:b] for a, b in lines[k:stop]))
                kind = None if raw is None else 4 if is_der_key(raw) else 5 if is_ssh_key(raw) else None
                if kind:
                    yield lines[k][0], kind, lines[stop - 1][1]
                    last = stop
                    break
            k = last


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of decoded candidates whose structure holds."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if any(h in text for h in _BLANK_HEADS):
        out += [(m.start(), 3, m.end()) for m in _BLANK_JWT.finditer(text) if is_signed_token(m[0])]
    taken: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            kind = _pem_kind(m[2])
            if kind:
                out.append((m.start(), kind, m.end()))
                taken.append((m.start(), m.end()))
    runs = list(_BASE64.finditer(text))
    for span in _wrapped_spans(text) if runs else ():
        if not any(a <= span[0] < b for a, b in taken):
            out.append(span)
            taken.append((span[0], span[2]))
    for found, decode in ((runs, unbase64), (_ANY_HEX.finditer(text), bytes.fromhex)):
        for m in found:
            if any(a <= m.start() < b for a, b in taken):
                continue
            raw = decode(m[0])
            if raw is None:
                continue
            if is_der_key(raw):
                out.append((m.start(), 4, m.end()))
            elif is_ssh_key(raw):
                out.append((m.start(), 5, m.end()))
    return out


def scan_text(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind as listed in KINDS."""
    if not text:
        return []
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(set(base_spans(text) + confirmed_spans(text)))]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive), a row for each row of docs.

    A null or empty text has no spans; a null doc_id stays null; equal rows are scanned each. A very
    long text is scanned whole, in time in proportion to its length. Further columns of docs, also
    one named spans, are ignored. An empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"doc_id": batch["doc_id"], "spans": pa.array([scan_text(t) for t in batch["text"].to_pylist()], pa.list_(SPAN))})

    return sh.map_batches(sh.id_text(docs, doc_id, text), work, OUT)


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of scan() replaced by the mark; overlapping spans become one. All columns stay; null texts stay null."""
    schema = docs.schema
    names = [f.name for f in schema.fields]

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        merged: list[list[int]] = []
        for s in scan_text(t):
            if merged and s["start"] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["end"])
            else:
                merged.append([s["start"], s["end"]])
        for a, b in merged:
            out += [t[at:a], mark]
            at = b
        return "".join([*out, t[at:]]) if merged else t

    def work(batch: pa.RecordBatch) -> pa.Table:
        k = names.index(text)
        done = pa.array([clean(t) for t in batch.column(k).to_pylist()], pa.string())
        return pa.table([done if i == k else batch.column(i) for i in range(len(names))], names=names)

    return sh.map_batches(docs, work, schema)
