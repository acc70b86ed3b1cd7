"""Secret scans with structural confirmation.

Base patterns (assign, access, hex) are taken as they match. Encoded candidates are reported only if their
structure holds: a signed token's header must decode to a JSON object that names an algorithm and its payload
to a JSON object; a PEM or bare base64 or hex body must be DER whose nested lengths fill it exactly, begin
with a SEQUENCE and hold an INTEGER or an object identifier; an SSH key body must be length-prefixed fields
that fill it, the first naming the key type. Line ends within PEM and base64 bodies may be real or escaped, as in JSON.

Defined results: null or empty text has no spans; places are code points, the end exclusive; equal rows give
equal results; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "pem", "ssh", "der")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)(?:PRIVATE KEY|CERTIFICATE)-----((?:[A-Za-z0-9+/=\s]|\\+[nrt])+)-----END [A-Z0-9 ]*(?:PRIVATE KEY|CERTIFICATE)-----")
BREAKS = re.compile(r"(?:\s|\\+[nrt])+")
BODY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
LINE_END = re.compile(r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*")
LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{LINE_END.pattern}[A-Za-z0-9+/_-]+)+={{0,2}}")
#: what a text must hold to have any span at all; a wider net than the patterns
NET = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN |[A-Za-z0-9+/_-]{32}|[A-Za-z0-9+/_-]{16}[ \t]*[\r\n\\]|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{4,}\."


def decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes, at: int, end: int, depth: int) -> list[int] | None:
    """Tags of the items that fill data[at:end] exactly, nested ones included; None if they do not."""
    tags: list[int] = []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > end:
                return None
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + size > end:
            return None
        tags.append(tag)
        if tag & 0x20:
            inner = _der_items(data, at, at + size, depth + 1)
            if inner is None:
                return None
            tags += inner
        at += size
    return tags


def is_der(data: bytes | None) -> bool:
    if not data or len(data) < 16 or data[0] != 0x30:
        return False
    tags = _der_items(data, 0, len(data), 0)
    return bool(tags) and tags.count(0x30) >= 1 and (0x02 in tags or 0x06 in tags) and len(tags) >= 3


def is_ssh(data: bytes | None) -> bool:
    """Fields of a four-byte length each, the first a key type."""
    if not data or len(data) < 20:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and bool(re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[\x21-\x7e]{3,60}", fields[0]))


def confirmed(body: str) -> str | None:
    raw = bytes.fromhex(body) if len(body) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", body) else decoded(body)
    return "ssh" if is_ssh(raw) else "der" if is_der(raw) else None


def _after_escape(text: str, at: int) -> int:
    """Where a body begins that a pattern found at this place: the letter of an escaped line end is not its own."""
    return at + 1 if at and text[at - 1] == "\\" and text[at] in "nrt" else at


def wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """Base64 bodies over two or more lines. DER's length names the line that ends it, as do the fields of an SSH key."""
    for m in LINES.finditer(text):
        cuts = [(x.start(), x.end()) for x in LINE_END.finditer(text, m.start(), m.end())]
        begins = [_after_escape(text, m.start()), *[b for _, b in cuts]]
        ends = [*[a for a, _ in cuts], m.end()]
        chars = [0]
        for a, b in zip(begins, ends, strict=True):
            chars.append(chars[-1] + len(text[a:b].rstrip("=")))
        last_with = {n: k for k, n in enumerate(chars)}
        done = 0
        for k, at in enumerate(begins):
            if k < done or ends[k] - at < 16:
                continue
            head = decoded(text[at : at + 16]) or b""
            stops: list[int] = []
            if head[:1] == b"\x30":
                wide = head[1] & 0x7F if head[1] >= 0x80 else 0
                if wide <= 4:
                    size = 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])
                    stops = [last_with.get(chars[k] + (size * 4 + 2) // 3, 0)]
            elif head.startswith(b"openssh-key"):
                stop = k + 1
                while stop < len(begins) and chars[stop + 1] - chars[stop] == chars[k + 1] - chars[k]:
                    stop += 1
                stops = [min(stop + 1, len(begins)) if stop < len(begins) and chars[stop + 1] - chars[stop] < chars[k + 1] - chars[k] else stop]
            elif re.match(rb"\0\0\0.(ssh-|ecdsa-|sk-)", head, re.S):
                whole = "".join(text[a:b] for a, b in zip(begins[k:], ends[k:], strict=True)).rstrip("=")
                data, place = decoded(whole[: len(whole) - (len(whole) % 4 == 1)]) or b"", 0
                while place + 4 <= len(data):
                    place += 4 + int.from_bytes(data[place : place + 4], "big")
                    stops.append(last_with.get(chars[k] + (place * 4 + 2) // 3, 0))
            for stop in sorted({x for x in stops if x > k + 1}, reverse=True):
                kind = confirmed("".join(text[a:b] for a, b in zip(begins[k:stop], ends[k:stop], strict=True)))
                if kind:
                    yield at, ends[stop - 1], kind
                    done = stop
                    break


def is_jwt(head: str, body: str) -> bool:
    try:
        h, b = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(b, dict) and isinstance(h.get("alg"), str)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret of a text, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_jwt(m[1], m[2])]
    pem = []
    for m in PEM.finditer(text):
        raw = decoded(BREAKS.sub("", m[2]))
        if is_der(raw) or is_ssh(raw):
            pem.append((m.start(), m.end(), "pem"))
    out += pem
    joined = [x for x in wrapped(text) if not any(s <= x[0] < e for s, e, _ in pem)]
    out += joined
    for m in BODY.finditer(text):
        if any(s <= m.start() < e for s, e, _ in pem + joined):
            continue
        for at in sorted({m.start(), _after_escape(text, m.start())}):
            kind = confirmed(text[at : m.end()])
            if kind:
                out.append((at, m.end(), kind))
                break
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """docs and a column of array<struct<start long, end long, kind string>>."""

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def scan(texts):
        column = pa.array(texts, pa.large_string())
        some = pc.fill_null(pc.match_substring_regex(column, NET), False).to_numpy(zero_copy_only=False)
        none: list = []
        return texts.where(some, None).map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in spans(t)] if isinstance(t, str) else none)

    return docs.withColumn(out_col, scan(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret, overlapping ones together, replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def run(texts):
        column = pa.array(texts, pa.large_string())
        some = pc.fill_null(pc.match_substring_regex(column, NET), False).to_numpy(zero_copy_only=False)

        def clean(t: str) -> str:
            out, at = [], 0
            for a, b, k in spans(t):
                if a >= at:
                    out += [t[at:a], f"[{k}]"]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return texts.where(~some, texts.where(some, "").map(clean))

    return docs.withColumn(text_col, run(F.col(text_col)))
