"""Keys and tokens as they are carried by other formats, and texts made to hold a scan up."""

import base64
import json
import struct
import time

import pytest

from packsieve.llm import secrets
from tests.llm.test_operators import b64url, der

FIELD = lambda x: struct.pack(">I", len(x)) + x
RSA = der(b"\x02\x01\x00", b"\x02\x82\x01\x01" + b"\x00" + b"\x9a" * 256, b"\x02\x03\x01\x00\x01")
SSH = b"openssh-key-v1\0" + FIELD(b"none") * 2 + FIELD(b"") + struct.pack(">I", 1) + FIELD(b"k" * 51) + FIELD(b"p" * 137)
PBES2 = der(der(b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d", b"\x30\x03\x02\x01\x01"), b"\x04\x30" + bytes(range(48)))
KEYS = {"der": [RSA, PBES2], "sshkey": [SSH]}


def wrap(x, sep, size=64):
    x = base64.b64encode(x).decode()
    return sep.join(x[k : k + size] for k in range(0, len(x), size))


CARRIERS = {
    "pem": lambda k: "-----BEGIN KEY-----\n" + wrap(k, "\n") + "\n-----END KEY-----\n", "dos": lambda k: "-----BEGIN KEY-----\r\n" + wrap(k, "\r\n") + "\r\n-----END KEY-----",
    "json": lambda k: json.dumps({"key": "-----BEGIN KEY-----\n" + wrap(k, "\n") + "\n-----END KEY-----\n"}), "json dos": lambda k: json.dumps({"key": "-----BEGIN KEY-----\r\n" + wrap(k, "\r\n") + "\r\n-----END KEY-----"}),
    "yaml": lambda k: "key: |\n    -----BEGIN KEY-----\n    " + wrap(k, "\n    ") + "\n    -----END KEY-----\nother: 1\n", "tabs": lambda k: "\t" + wrap(k, "\n\t"), "blanks": lambda k: "-----BEGIN KEY----- " + wrap(k, " ") + " -----END KEY-----",
    "one line": lambda k: "KEY=" + wrap(k, "", 1 << 20), "glued": lambda k: "-----BEGIN KEY-----" + wrap(k, "", 1 << 20) + "-----END KEY-----", "words after": lambda k: wrap(k, "\n") + "\nwords that follow\n", "words before": lambda k: "Many words before\n" + wrap(k, "\n"),
    "url safe": lambda k: "x " + wrap(k, "\n").replace("+", "-").replace("/", "_") + " y",
}


@pytest.mark.parametrize("carrier", CARRIERS)
@pytest.mark.parametrize("kind", KEYS)
def test_carriers(carrier, kind):
    for key in KEYS[kind]:
        text = "é " + CARRIERS[carrier](key)
        found = [x for x in secrets.scan(text) if x[2] in ("der", "sshkey")]
        assert [x[2] for x in found] == [kind]
        told = "".join(c for c in text[found[0][0] : found[0][3]].replace("\\r\\n", "").replace("\\n", "") if not c.isspace())
        assert secrets._unbase64(told) == key


@pytest.mark.parametrize("before, after", [("", ""), ("a", ""), ("", "b"), ("ab1", "c2"), ("30", "30"), ("308201", "")])
def test_hex_in_longer_runs(before, after):
    text = f"x {before}{RSA.hex()}{after} {PBES2.hex().upper()}"
    assert [(a, b) for a, _, k, b in secrets.scan(text) if k == "hexder"] == [(2 + len(before), 2 + len(before) + 2 * len(RSA)), (len(text) - 2 * len(PBES2), len(text))]


def test_tokens():
    head, body, sig = b64url(b'{"alg":"none"}'), b64url(b"not json"), b64url(b"signature")
    for token in (f"{head}.{body}.{sig}", f"{head}.{body}.", f"{head}..{sig}", f"{head}.{b64url(b'{}')}.{sig}"):
        assert [(a, k, b) for a, _, k, b in secrets.scan(f"Bearer {token} end")] == [(7, "jwt", 7 + len(token))]
    for text in (f"{head}.", f"{head}..", f"{head}.{body}", head, f"{b64url(b'{x')}.{body}.{sig}", f"{b64url(b'[1]  ')}.{body}.{sig}"):
        assert not [x for x in secrets.scan(text) if x[2] == "jwt"]


def test_what_is_no_private_key():
    public = der(der(b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01", b"\x05\x00"), b"\x03\x21" + bytes(33))
    other = der(der(b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x07\x01", b"\x05\x00"), b"\x04\x20" + bytes(32))
    for data in (public, other, PBES2[:-1] + b"", RSA[:-1], SSH[:-1]):
        assert not [x for x in secrets.scan(base64.b64encode(data).decode() + " " + data.hex()) if x[2] in ("der", "sshkey", "hexder")]


HOSTILE = {
    "ssh heads": "b3BlbnNzaC1rZXktdjEAAAAABG5vbmU\n" * 300_000, "der heads": "MIIf/QIBAAKB\n" * 700_000, "far ends": "MIIX9wIBAAIBAAIB" * 1 + "\n" + "MIIX9wIBAAIBAAIBAAIB\n" * 450_000, "hex heads": "3082010002010002" * 600_000,
    "one run": "MIIE" * 2_500_000, "blanks": "MA MB MC " * 1_000_000, "tokens": "eyJhbGciOiJ" * 900_000, "escapes": "MIIB\\n" * 1_500_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_ten_hostile_megabytes(name):
    began = time.process_time()
    secrets.scan(HOSTILE[name])
    assert time.process_time() - began < 30


def test_cost_grows_with_the_text():
    def seconds(n):
        began = time.process_time()
        secrets.scan("b3BlbnNzaC1rZXktdjEAAAAABG5vbmU\n" * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.2


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_an_item_in_half_of_the_texts(spark, monkeypatch, limit):
    """One benchmark item held by half of all documents, with items broadcast whole or the heaviest only."""
    from packsieve.llm import decontam, shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(shared, "HOT", 1)
    item, other = " ".join(f"w{k}" for k in range(20)), " ".join(f"x{k}" for k in range(9))
    docs = [(n, f"text {n} " + (item if n % 2 else other if n % 10 == 0 else "nothing here at all")) for n in range(300)]
    got = decontam.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, other), (3, item), (4, None)], "item_id long, text string"))
    assert {r.doc_id: r.item_ids for r in got.collect()} == {n: "1,3" if n % 2 else "2" if n % 10 == 0 else "" for n, _ in docs}


def test_words_are_encoded_again_beyond_the_bound(spark, monkeypatch):
    from packsieve.llm import bpe

    docs = spark.createDataFrame([(n, f"some words {n} and {n % 7} more words") for n in range(200)], "doc_id long, text string")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 300)
    want = {tuple(r) for r in bpe.report(docs).collect()}
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 0)
    assert {tuple(r) for r in bpe.report(docs).collect()} == want
