"""Secrets in texts: pattern candidates, and structural confirmation of encoded keys and signed tokens.

Base kinds are plain patterns. The structural kinds decode a candidate and parse it before it is reported:

* ``jwt``: three dot-joined base64url parts, the first a JSON object with a string ``alg``; the second or the third may be
  empty, as in unsigned and detached tokens;
* ``der``: base64 whose bytes are one ASN.1 SEQUENCE that starts with a version INTEGER, as private keys do, with exact
  lengths down to the leaves; where an algorithm follows the version, its OCTET STRING is parsed too; or an encrypted
  key: the algorithm of a password scheme and octets;
* ``hexder``: the same in hex, anywhere in a run of hex digits;
* ``sshkey``: base64 of the OpenSSH private key container, with its length-prefixed fields intact.

Base64 is read on through line breaks, indents, blanks and escaped line breaks, as in key files, YAML, wrapped lines and
JSON. It may go on into what follows a key: a word on the next line, or the dashes of a footer. So a key ends where its
outer header says, which must be the end of a piece, and begins where a piece does. Keys have ``MAX_KEY`` bytes at most,
more than twice what the longest in use have, so that a text full of beginnings costs a bounded look at each.

Spans are code point offsets, end exclusive, of the whole match. Defined cases: a null or empty text has no spans;
repeated rows are each scanned; a text is scanned whole, however long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsieve.session import ship

KINDS = ("assign", "access", "hex", "jwt", "der", "hexder", "sshkey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18
#: The head of a token is base64 of ``{`` and a quote or white space.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{6,}\.(?:[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*|\.[A-Za-z0-9_-]{2,})")
#: Where a key's base64 may begin: the first byte of a SEQUENCE, or the OpenSSH magic, at the start of a piece.
KEY_HEAD = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=-----))(?:M[A-P](?=[A-Za-z0-9+/_-]{2})|b3BlbnNzaC1rZXktdjEA)")
#: A piece of base64, and what may stand between two; a row of dashes ends all.
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
BETWEEN = re.compile(r"(?:(?:\\r)?\\n|[ \t]*\r?\n[ \t]*|[ \t]+)+(?=[A-Za-z0-9+/_-])(?!-----)")
DASHES = re.compile(r"-{5,}")
PADDING = re.compile(r"={0,2}")
HEX_BYTES = re.compile(r"[0-9A-Fa-f]{64,}")
#: A SEQUENCE that begins with a small version, or with an algorithm of a password scheme.
HEX_HEAD = re.compile(r"(?=30(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4})(?:02010[0-3]|30(?:[0-7][0-9a-f]|81[0-9a-f]{2})06))", re.IGNORECASE)
MAX_KEY = 32 << 10
#: The object identifiers of password schemes, as their bytes begin.
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SSH_MAGIC = b"openssh-key-v1\0"
#: Values in values that are followed; keys have four levels.
MAX_DEPTH = 16


def _unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the ASN.1 value at ``at``; None if its length doesn't fit."""
    if at + 2 > end:
        return None
    tag, first, at = data[at], data[at + 1], at + 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _parts(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The ASN.1 values that fill data[at:end], whose constructed ones are filled likewise; None if something is amiss."""
    out = []
    while at < end:
        part = _tlv(data, at, end)
        if not part or part[0] & 0x20 and (depth == MAX_DEPTH or _parts(data, part[1], part[2], depth + 1) is None):
            return None
        out.append(part)
        at = part[2]
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills ``data`` down to the leaves: a version from 0 to 3, then numbers or octets (RSA, DSA, EC), or
    an algorithm and the key's own value in octets (PKCS #8); or a password scheme and octets (encrypted PKCS #8)."""
    top = _parts(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _parts(data, top[0][1], top[0][2]) or []
    if len(parts) == 2 and parts[0][0] == 0x30 and parts[1][0] == 0x04:
        scheme = (_parts(data, *parts[0][1:]) or [(0, 0, 0)])[0]
        return scheme[0] == 0x06 and data[scheme[1] : scheme[2]].startswith(PASSWORD_SCHEMES)
    if len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 3:
        return False
    if parts[1][0] != 0x30:
        return parts[1][0] in (0x02, 0x04)
    return len(parts) > 2 and parts[2][0] == 0x04 and len(_parts(data, *parts[2][1:]) or []) == 1


def ssh_size(read, most: int) -> int:
    """Bytes of the OpenSSH container of which ``read(place, n)`` gives bytes: cipher, KDF, KDF options, key count, public
    keys, one private block. 0 if there is none, or one of over ``most`` bytes."""
    at = len(SSH_MAGIC)
    if read(0, at) != SSH_MAGIC:
        return 0

    def number() -> int | None:
        word = read(at, 4)
        return struct.unpack(">I", word)[0] if len(word) == 4 else None

    def field() -> bool:
        nonlocal at
        n = number()
        if n is None or at + 4 + n > most:
            return False
        at += 4 + n
        return True

    if not (field() and field() and field()) or (n := number()) is None:
        return 0
    at += 4
    return at if 1 <= n <= 16 and all(field() for _ in range(n + 1)) else 0


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH container that fills ``data``."""
    return bool(data) and ssh_size(lambda at, n: data[at : at + n], len(data)) == len(data)


def _key_kind(data: bytes | None) -> tuple[int, str] | None:
    if data and is_der_key(data):
        return 4, "der"
    return (6, "sshkey") if data and is_ssh_key(data) else None


def _size_at(joined: str, at: int) -> int:
    """Bytes that the key whose base64 starts at ``at`` says it has; 0 if its header is no key's."""
    if joined[at] == "M":
        head = _unbase64(joined[at : at + 16]) or b""
        top = _tlv(head + bytes(2), 0, 1 << 40)
        return top[2] if top and (head[top[1] : top[1] + 2] == b"\x02\x01" or head[top[1] : top[1] + 1] == b"\x30") else 0

    def read(place: int, n: int) -> bytes:
        skip = place % 3
        part = joined[at + place // 3 * 4 : at - (-(place + n) // 3 * 4)]
        return (_unbase64(part[: len(part) - (len(part) % 4 == 1)]) or b"")[skip : skip + n]

    return ssh_size(read, MAX_KEY)


def _chain(text: str, at: int) -> tuple[str, dict[int, int], dict[int, int], int]:
    """The pieces of base64 from ``at`` on, joined; the place of each piece's start in it, by its place in the text; the
    end of each piece in the text, by its end in the joined text; and where the chain ends."""
    parts, starts, ends, size = [], {}, {}, 0
    while True:
        end = PIECE.match(text, at).end()
        row = DASHES.search(text, at, end)
        stop = row.start() if row else end
        starts[at] = size
        parts.append(text[at:stop])
        size += stop - at
        ends[size] = PADDING.match(text, stop).end()
        then = None if row else BETWEEN.match(text, ends[size])
        if not then:
            return "".join(parts), starts, ends, end
        at = then.end()


def keys(text: str) -> list[tuple[int, int, str, int]]:
    """The encoded keys of a text. Every chain is joined once; a place in it costs a look at its header, and only where the
    end that this tells is the end of a piece is the key decoded."""
    out, joined, starts, ends, reached, used = [], "", {}, {}, -1, -1
    for m in KEY_HEAD.finditer(text):
        x = m.start()
        if x < used:
            continue
        if x >= reached:
            joined, starts, ends, reached = _chain(text, x)
        at = starts.get(x)
        size = _size_at(joined, at) if at is not None else 0
        stop = (at or 0) - (-size * 8 // 6)
        if 0 < size <= MAX_KEY and stop in ends and (kind := _key_kind(_unbase64(joined[at:stop]))):
            out.append((x, *kind, ends[stop]))
            used = ends[stop]
    return out


def hex_keys(text: str) -> list[tuple[int, int, str, int]]:
    """Keys in runs of hex digits, whatever digits stand around them."""
    out = []
    for run in HEX_BYTES.finditer(text):
        used = 0
        for m in HEX_HEAD.finditer(text, *run.span()):
            at = m.start()
            top = _tlv(bytes.fromhex(text[at : at + 8]) + bytes(2), 0, 1 << 40)
            if at < used or not top or top[2] > MAX_KEY or at + 2 * top[2] > run.end():
                continue
            if is_der_key(bytes.fromhex(text[at : at + 2 * top[2]])):
                used = at + 2 * top[2]
                out.append((at, 5, "hexder", used))
    return out


def is_token(text: str) -> bool:
    head = _unbase64(text.split(".")[0])
    try:
        head = json.loads(head or b"0")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def scan(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, kind's number, kind, end) of all spans, in report order."""
    if not text:
        return []
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    out += [(m.start(), 3, "jwt", m.end()) for m in JWT.finditer(text) if is_token(m[0])]
    out += keys(text) + hex_keys(text)
    return sorted(out)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and the spans found, as array<struct<kind, start, end>>."""
    ship(docs.sparkSession)
    schema = docs.select(F.col(key)).schema.simpleString()[7:-1] + ",spans:array<struct<kind:string,start:int,end:int>>"

    def found(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, _, k, e in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[key, "spans"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(found, schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts per base kind, hash of the base spans, all spans as text."""
    found = spans(docs, key, text)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        key, *counts, F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans")
    )


def _of(kind: str):
    return lambda s: s["kind"] == kind

