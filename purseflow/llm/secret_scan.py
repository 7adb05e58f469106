"""Secret scan: patterns, and candidates confirmed by what they decode to."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from purseflow.llm.arrow import chunks, texts

# The base patterns. Kinds in the order in which spans with one start are listed.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh", "encoded")

# Texts with none of these hold nothing to report: a keyword, or a long run of the characters that
# keys, hex and encoded data are written in.
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"eyj", b"-----begin")
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")

_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
# The body may hold headers with dashes, but not five in a row.
_PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----)){16,}?)-----END \1-----"
)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_LONG_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){24,}(?![0-9A-Za-z])")
# Encoded data over several lines, of which only the last may be short.
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{32,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}(?![A-Za-z0-9+/=_-])"
)
_HEX_ONLY = re.compile(r"(?:[0-9a-fA-F]{2})+")
# How often an encoding inside an encoding is followed.
NESTED = 4


def decode_base64(text: str) -> bytes | None:
    """The bytes of a base64 text in either alphabet, padded or not; None if it is none."""
    body = text.translate(str.maketrans("-_", "+/")).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, first, end) of the DER element at ``at``; None if its length does not fit."""
    if at + 2 > len(data):
        return None
    tag, length, first = data[at], data[at + 1], at + 2
    if length & 0x80:
        more = length & 0x7F
        if not 1 <= more <= 4 or first + more > len(data):
            return None
        length = int.from_bytes(data[first : first + more], "big")
        first += more
        if length < 0x80:
            return None
    return (tag, first, first + length) if first + length <= len(data) else None


def _children(data: bytes, first: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while first < end:
        item = _element(data, first)
        if item is None or item[2] > end:
            return None
        found.append(item)
        first = item[2]
    return found


def is_private_der(data: bytes) -> bool:
    """A private key in DER: one sequence that fills the data, with the parts of a known form."""
    whole = _element(data, 0)
    if whole is None or whole[0] != 0x30 or whole[2] != len(data):
        return False
    parts = _children(data, whole[1], whole[2])
    if not parts:
        return False
    tags = [tag for tag, _, _ in parts]
    if tags[:2] == [0x30, 0x04] and len(parts) == 2:  # encrypted: algorithm and cipher text
        inner = _children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[0] != 0x02 or data[parts[0][1] : parts[0][2]] not in (b"\0", b"\1"):
        return False
    if tags == [0x02] * 9 or tags == [0x02] * 6:  # RSA and DSA: numbers only
        return all(end > first for _, first, end in parts)
    if tags[1] == 0x04:  # EC: secret, then tagged parameters and public key
        size = parts[1][2] - parts[1][1]
        return 16 <= size <= 72 and all(tag in (0xA0, 0xA1) for tag in tags[2:])
    if tags[1:3] == [0x30, 0x04]:  # any algorithm: its id, then the key in an octet string
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and parts[2][2] - parts[2][1] >= 16
    return False


_SSH_MAGIC = b"openssh-key-v1\0"


def is_private_ssh(data: bytes) -> bool:
    """An OpenSSH private key: its marker, then strings whose lengths nest up to the end."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return data[at - size : at] if at <= len(data) else None

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or any(string() is None for _ in range(keys)):
        return False
    return string() is not None and at == len(data)


def is_token(header: str, payload: str) -> bool:
    """A signed token: header and payload are JSON objects, and the header names an algorithm."""
    found = []
    for part in (header, payload):
        raw = decode_base64(part)
        try:
            found.append(json.loads(raw.decode("utf-8")) if raw else None)
        except (UnicodeDecodeError, ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in found) and isinstance(found[0].get("alg"), str)


def decodings(text: str) -> Iterator[bytes]:
    """What a text is as hex and as base64, if it is."""
    if _HEX_ONLY.fullmatch(text):
        yield bytes.fromhex(text)
    data = decode_base64(text)
    if data:
        yield data


def confirmed_kind(data: bytes, depth: int = 0) -> str | None:
    """What decoded bytes are: a private key, text that itself holds a secret, or, as often as
    NESTED, an encoding of one."""
    if is_private_der(data):
        return "der"
    if is_private_ssh(data):
        return "ssh"
    if not data or not all(32 <= b < 127 or b in (9, 10, 13) for b in data):
        return None
    inner = data.decode("ascii")
    if any(base_spans(inner)[kind] for kind in ("assign", "access")) or armoured(inner):
        return "encoded"
    packed = "".join(inner.split())
    if depth < NESTED and len(packed) >= 20:
        for more in decodings(packed):
            kind = confirmed_kind(more, depth + 1)
            if kind:
                return kind
    return None


def armoured(text: str) -> list[tuple[int, int]]:
    """Spans of armoured private keys whose body decodes to one.

    An old-style encrypted body is no DER: its headers say so, and it is whole cipher blocks.
    """
    found = []
    for m in _PEM.finditer(text):
        lines = m[2].split("\n")
        heads = [line for line in lines if ":" in line]
        data = decode_base64("".join("".join(line.split()) for line in lines if ":" not in line))
        locked = any("ENCRYPTED" in h for h in heads) and any(h.startswith("DEK-Info") for h in heads)
        if data and (is_private_der(data) or is_private_ssh(data) or (locked and len(data) % 8 == 0)):
            found.append(m.span())
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base patterns: leftmost, non-overlapping per kind, short ones dropped."""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]],
        "access": [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]],
        "hex": [m.span() for m in _HEX.finditer(text) if len(m[0]) >= LEAST["hex"]],
    }


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded contents were confirmed."""
    found = [("jwt", *m.span()) for m in _JWT.finditer(text) if is_token(m[1], m[2])]
    keys = armoured(text)
    found += [("pem", *span) for span in keys]
    for m in _LONG_HEX.finditer(text):
        kind = confirmed_kind(bytes.fromhex(m[0]))
        if kind:
            found.append((kind, *m.span()))
    for m in _BASE64.finditer(text):
        data = decode_base64(m[0])
        kind = confirmed_kind(data) if data else None
        if kind:
            found.append((kind, *m.span()))
    for m in _WRAPPED.finditer(text):
        if any(start <= m.start() and m.end() <= end for start, end in keys):
            continue
        kinds = (confirmed_kind(data) for data in decodings("".join(m[0].split())))
        kind = next((k for k in kinds if k), None)
        if kind:
            found.append((kind, *m.span()))
    return found


def _listed(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


_NOTHING = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def scan_text(body: bytes) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256 and spans of one text."""
    low = body.lower()
    if not _RUN.search(body) and not any(word in low for word in _KEYWORDS):
        return _NOTHING
    text = body.decode("utf-8", "replace")
    base = base_spans(text)
    spans = [(kind, start, end) for kind, found in base.items() for start, end in found]
    digest = hashlib.sha256(_listed(spans).encode()).hexdigest()
    counts = (len(base["assign"]), len(base["access"]), len(base["hex"]))
    return (*counts, digest, _listed(spans + structural_spans(text)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Base kinds are assignments, access keys and hex digits by pattern. The method adds signed
    tokens (jwt), armoured private keys (pem, encrypted ones by their headers), base64 or hex, on one
    line or wrapped over several, of a private key (der, ssh) and of a text that holds a secret
    (encoded), also encoded more than once; each only if its decoded structure fits. Spans are
    kind:start:end in code points, end exclusive, ordered by start, then kind as in KINDS.
    Null texts are empty; repeated rows each get their row; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            columns = list(zip(*(scan_text(t) for t in texts(part, "text"))))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *arrays],
                names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    return rows.mapInArrow(
        run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    ).withColumnRenamed("id", id_col)
