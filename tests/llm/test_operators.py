"""Each operator against brute force, with nulls, empty and repeated rows, empty tables and clashing column names."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import string
import struct

import pytest
from pyspark.sql import functions as F

from packsieve.llm import shared
from packsieve.llm import bpe, decontam, linededup, minhash, quality, repeats, secrets, toxicity, urlfilter, warc
from packsieve.llm.shared import Workspace

DOCS = "doc_id long, text string, lang string, source string, h string, d string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[n], "x", "y", n) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(seed, n):
    return " ".join(hashlib.md5(f"{seed}{k}".encode()).hexdigest()[:6] for k in range(n))


EDGES = [(900, None), (901, ""), (902, "  \n\t "), (903, "é"), (None, "no id at all " * 50), (904, "twin row"), (904, "twin row")]


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


# joins with hot keys


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_joins_with_few(spark, monkeypatch, limit):
    """Broadcast whole, or the heaviest keys only: the same rows as a plain join."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(shared, "HOT", 2)
    rows = [(n, "hot" if n % 2 else f"k{n % 7}" if n % 5 else None) for n in range(200)]
    many = spark.createDataFrame(rows, "id long, k string")
    few = spark.createDataFrame([("hot", 1, 100), ("k1", 2, 10), ("k2", 3, 10), ("k3", None, 10), ("none", 5, 0)], "k string, v int, n long")
    plain = {"hot": 1, "k1": 2, "k2": 3, "k3": None, "none": 5}
    got = shared.attach_few(many, few, "k", "id", "n").collect()
    assert sorted((r.id, str(r.k), str(r.v)) for r in got) == sorted((i, str(k), str(plain.get(k))) for i, k in rows)
    got = shared.join_few(many, few, "k", 10, "n").collect()
    assert sorted((r.id, r.k, str(r.v)) for r in got) == sorted((i, k, str(plain[k])) for i, k in rows if k in plain)


# repeats


def repeats_expected(texts, depth=400):
    seen = collections.Counter(t[k : k + depth] for t in texts for k in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - depth + 1):
            if seen[t[k : k + depth]] > 1:
                gone[k : k + depth] = b"\1" * depth
        runs = sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1]))
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def test_repeats(spark):
    passage, other = sentence("p", 90), sentence("o", 70)
    exact = sentence("q", 200)[:400]
    texts = [
        *EDGES, (1, sentence("a", 80) + passage + sentence("b", 80)), (2, passage + sentence("c", 90)), (3, sentence("d", 10) + passage[5:]),
        (4, other + " x " + other), (5, "a line that repeats itself, again and again.\n" * 40), (6, "a line that repeats itself, again and again.\n" * 12 + sentence("e", 80)),
        (7, "z" * 399), (8, "z" * 900), (9, "z" * 399), (10, exact), (11, "!" + exact + "!"), (12, exact[:-1] + "#" + exact[1:]), (13, "ü" * 300 + passage[:402]), (14, sentence("a", 80)),
    ]
    df = frame(spark, texts)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(df).collect())
    assert got == sorted(repeats_expected([(t or "").encode() for _, t in texts]))
    assert repeats.report(df.limit(0)).count() == 0


def test_repeats_on_a_whole_table(spark):
    """All documents of the table, with every window of 400 bytes in one dictionary."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(docs).collect()}
    assert got == dict(zip(texts, repeats_expected(list(texts.values())), strict=True)) and sum(x[1] > 0 for x in got.values()) > 100


def test_passages_of_words(spark):
    """Words that lost a byte, else words in runs of 51 that another document holds, under other white space too."""
    rng = random.Random(3)
    long, short, own = sentence("l", 70), sentence("s", 50), sentence("w", 60)
    texts = [
        *EDGES, (1, sentence("a", 30) + " " + long), (2, long.replace(" ", "\n ") + " " + sentence("b", 40)), (3, sentence("c", 20) + " " + short), (4, short + " " + sentence("d", 60)),
        (5, own + " " + own), (6, " ".join(long.split()[10:61])), (7, " ".join(long.split()[10:60])), (8, sentence("e", 90)), (9, sentence("e", 90)), (10, long.upper()),
    ]
    base = sentence("z", 400).split()
    for n in range(20):  # pieces of one long text, some of them too short
        at, size = rng.randrange(340), rng.randrange(30, 90)
        texts.append((20 + n, " ".join([*sentence(f"r{n}", 20).split(), *base[at : at + size], *sentence(f"t{n}", 20).split()])))
    words = [WORD.findall(t or "") for _, t in texts]
    holders = collections.defaultdict(set)
    for n, w in enumerate(words):
        for k in range(len(w) - 50):
            holders[tuple(w[k : k + 51])].add(n)
    whole = [(t or "").encode() for _, t in texts]
    seen = collections.Counter(t[k : k + 400] for t in whole for k in range(len(t) - 399))
    want = []
    for (i, t), w, b in zip(texts, words, whole, strict=True):
        gone = {k + j for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1 for j in range(400)}
        held = {k + j for k in range(len(w) - 50) if len(holders[tuple(w[k : k + 51])]) > 1 for j in range(51)}
        ends = [(len((t or "")[: m.start()].encode()), len((t or "")[: m.end()].encode())) for m in WORD.finditer(t or "")]
        want.append((str(i), sum(any(x in gone for x in range(*e)) for e in ends) if gone else len(held)))
    got = [(str(r.doc_id), r.n_repeated_words) for r in repeats.report(frame(spark, texts)).collect()]
    assert sorted(got) == sorted(want) and sum(n > 0 for _, n in want) >= 12


# near duplicates


def minhash_expected(texts, width, threshold):
    sets = []
    for _, t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    comp = {i: i for i, _ in texts}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, (i, _) in enumerate(texts):
        for b, (j, _) in enumerate(texts[:a]):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both) and None not in (i, j):
                p, q = find(i), find(j)
                comp[max(p, q)] = min(p, q)
    return sorted((i is None, i or 0, len(s), (find(i) if i is not None else 0)) for (i, _), s in zip(texts, sets))


def test_near_duplicates(spark):
    base = sentence("m", 120).split()
    texts = list(EDGES)
    for n in range(30):  # copies that are like the original, and less like each other
        w = list(base)
        w[(n * 4) % 120] = f"edit{n}"
        w[(n * 4 + 60) % 120] = f"edit{n}b"
        texts.append((100 + n, " ".join(w)))
    texts += [(50, " ".join(base)), (51, " ".join(base).upper()), (60, sentence("other", 100)), (61, sentence("other", 90) + " tail"), (62, "two words"), (63, "Two  Words")]
    df = frame(spark, texts)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash.report(df).collect())
    assert got == minhash_expected(texts, 3, 85)
    assert minhash.report(df.limit(0)).count() == 0


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0, r.kept) for r in df.collect())


def test_near_duplicates_shared_and_null_ids(spark):
    """Rows are linked as their own text is, whatever other rows share their id."""
    a, b = sentence("a", 60), sentence("b", 60)
    texts = [(1, a), (1, b), (3, b + " y"), (None, b), (None, "alone and without an id"), (4, "unlike the others"), (None, None), (5, a)]
    got = rows_of(minhash.report(frame(spark, texts)))
    want = [(False, 1, 58, False, 1, True)] * 2 + [(False, 3, 59, False, 1, False), (True, 0, 58, False, 1, False), (True, 0, 3, True, 0, True)]
    want += [(False, 4, 1, False, 4, True), (True, 0, 0, True, 0, True), (False, 5, 58, False, 1, False)]
    assert got == sorted(want)


def test_near_duplicates_at_random(spark, monkeypatch):
    """Groups of copies with edits at many distances, so that pivots settle some members and not others."""
    monkeypatch.setattr(minhash, "PAIRS_A_SALT", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    rng, texts = random.Random(5), []
    for g in range(4):
        base = sentence(f"g{g}", 150).split()
        for n in range(25):
            w = list(base)
            for k in range(rng.randrange(9)):
                w[rng.randrange(150)] = f"e{g}.{n}.{k}"
            texts.append((100 * g + n, " ".join(w[: rng.randrange(125, 151)])))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash.report(frame(spark, texts)).collect())
    assert got == minhash_expected(texts, 3, 85)


def test_near_duplicates_on_a_whole_table(spark):
    """All documents of the table against exact pairs, found by the shingles that they share."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, WORD.findall("".join(c.lower() if c.isascii() else c for c in r.text or ""))) for r in docs.collect()]
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set() for i, w in rows}
    holders = collections.defaultdict(list)
    for i, x in sets.items():
        for sh in x:
            holders[sh].append(i)
    both = collections.Counter((a, b) for ids in holders.values() if len(ids) > 1 for k, a in enumerate(ids) for b in ids[:k])
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            p, q = find(a), find(b)
            group[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.report(docs).collect()}
    assert got == {i: (len(x), find(i)) for i, x in sets.items()} and sum(i != c for i, (_, c) in got.items()) > 40


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A chain whose ends are not alike, with its buckets cut into blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = sentence("f", 100).split()
    texts = [(n, " ".join(base[n * 2 : n * 2 + 80])) for n in range(10)]  # a chain: neighbours alike, ends not
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash.report(frame(spark, texts)).collect())
    assert got == minhash_expected(texts, 3, 85)


# archives


def test_warc_round_trip(spark):
    rows = [(3, "u", "abc"), (1, "u", "abc"), (2, None, None), (4, "u\r\nX: y", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "abc"), (1, "u", "abc"), (6, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        kept = i == first.get(h, i)
        want.append((str(i), len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if kept else "revisit", None if kept else first[h]))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    named = pages.withColumn("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")))
    assert sorted((str(r.page_id), str(r.refers_to)) for r in warc.round_trip(named).collect()) == sorted((w[0] if w[0] == "None" else f"p{w[0]}", "None" if w[4] is None else f"p{w[4]}") for w in want)


def test_normaliser_makes_members(spark):
    pages = spark.createDataFrame([(n, "u", f"page {n}") for n in range(20)], "page_id long, url string, html string").coalesce(1)
    with Workspace(spark, "test") as work:
        raw = work.table(warc.write_archives(pages, work, f"{work.path}/a"), "raw")
        done = work.table(warc.normalise(raw, f"{work.path}/a"), "done")
        r = done.first()
        disk, root = warc._open(f"{work.path}/a")
        with disk.open_input_stream(f"{root}/{r["index"]}") as f:
            index = [json.loads(x) for x in f.read().splitlines()]
        assert r.records == 20 == len(index)
        assert [a for a, _, _ in index][1:] == [a + n for a, n, _ in index][:-1]


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc._records([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"]))
    with pytest.raises(ValueError):
        list(warc._records([b"GET / HTTP/1.1\r\n\r\n"]))


# URL filter


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?q#f", "https://a.b.example.org/en/12", "https://xexample.org/es/", "https://org", "https://org/", "x://com/de/../", "https://m.example.com/fr/", "s://a.example.org?x", "https://example.org:80/es/", "a://b://c.com/de/"]
    pages = spark.createDataFrame([(n, u, 0) for n, u in enumerate(urls + urls[4:6])], "page_id long, url string, host int")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

    def want(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rules_frame(spark, rules)).collect()}
    assert got == {n: want(u) for n, u in enumerate(urls + urls[4:6])}
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, urlfilter.rules_frame(spark, [])).collect()} == {"allow"}


# secrets


def der(*parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x81, size]) if size < 256 else b"\x82" + size.to_bytes(2, "big")
    return b"\x30" + head + body


def b64url(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_secrets(spark):
    key = der(b"\x02\x01\x00", b"\x02\x81\x81" + b"\x00" + b"\x9a" * 128, b"\x02\x03\x01\x00\x01")
    field = lambda x: struct.pack(">I", len(x)) + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(b"k" * 51) + field(b"p" * 136)
    token = b64url(b'{"alg":"HS256"}') + "." + b64url(b'{"sub":"1"}') + ".c2ln"
    texts = [
        *EDGES, (1, "Password: 'abcdefghijkl' é token=short API_KEY=0123456789abcdef0"), (2, "AKIA" + "A" * 14 + " AKIA123 0123456789abcdef"), (3, base64.b64encode(key).decode()),
        (4, "x " + key.hex() + " y"), (5, base64.b64encode(ssh).decode()), (6, "Bearer " + token), (7, base64.b64encode(key[:-1]).decode()), (8, "eyJhbGciOjF9.e30.x"),
        (9, "password: token: abcdefghijklmnop"),
    ]
    got = by_id(secrets.report(frame(spark, texts)))
    assert [got[i][0].spans.split(":")[0] for i in (3, 5, 6)] == ["der", "sshkey", "jwt"]
    assert got[4][0].spans == "hex:2:{0},hexder:2:{0}".format(2 + 2 * len(key))
    assert got[7][0].spans == got[8][0].spans == got[9][0].spans == ""
    assert (got[2][0].n_access, got[2][0].n_hex) == (1, 1)
    assert got[900][0].spans == "" and len(got[904]) == 2
    for i, t in texts:
        check_base(got[i][0], t)


def base_spans(text):
    """Base spans found character by character, without regular expressions."""
    out, low, n = [], (text or "").lower() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text or ""), len(text or "")
    value, at = set(string.ascii_letters + string.digits + "+/_.=-"), 0
    while at < n:
        best = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                k = at + len(name)
                k += low[k : k + 1] in ("'", '"') and k < n
                while low[k : k + 1] == " ":
                    k += 1
                if low[k : k + 1] not in (":", "=") or k >= n:
                    continue
                k += 1
                while low[k : k + 1] == " ":
                    k += 1
                k += k < n and low[k] in "'\""
                end = k
                while end < n and text[end] in value:
                    end += 1
                if end > k:
                    best = (at, 0, "assign", end, end - k >= 12)
                    break
        if best:
            out += [best[:4]] if best[4] else []
            at = best[3]
        else:
            at += 1
    for kind, order, head, chars, least in (("access", 1, "AKIA", string.ascii_uppercase + string.digits, 18), ("hex", 2, "", "0123456789abcdef", 16)):
        at = 0
        while at < n:
            end = at + len(head)
            while text.startswith(head, at) and end < n and text[end] in chars:
                end += 1
            if text.startswith(head, at) and end > at + len(head):
                out += [(at, order, kind, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    return sorted(out)


def check_base(row, text):
    want = base_spans(text)
    counts = [sum(k == kind for _, _, k, _ in want) for kind in ("assign", "access", "hex")]
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
    assert ([row.n_assign, row.n_access, row.n_hex], row.base_sha256) == (counts, digest)
    assert set(f"{k}:{a}:{b}" for a, _, k, b in want) <= set(row.spans.split(","))


def test_base_spans_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(9)
    bits = ["token", "api_key", "APIKEY", "secret", "passwd", "'", '"', " ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "İ", "\n", "a1.b2-c3_d4/e5", "-"]
    made = {10_000 + n: "".join(rng.choices(bits, k=rng.randrange(1, 30))) for n in range(3000)}
    rows = secrets.report(spark.createDataFrame(list((texts | made).items()), "doc_id long, text string")).collect()
    for r in rows:
        check_base(r, (texts | made)[r.doc_id])
    assert len(rows) == len(texts) + len(made) and sum(r.n_assign for r in rows) > 50


def test_structures_are_parsed_to_the_leaves():
    spaced = b64url(b'{ "alg": "HS256"}') + "." + b64url(b'{"sub":"1"}') + ".c2ln"
    broken = b64url(b'{\n "alg": "none"}') + "." + b64url(b'{}') + "."
    assert [x[2] for x in secrets.scan(f"a {spaced} b {broken}x c")] == ["jwt", "jwt"]
    assert not secrets.scan(b64url(b'{"typ":"x"}') + "." + b64url(b"{}") + ".c2ln")
    algorithm, rsa = b"\x30\x05\x06\x03\x2b\x65\x70", der(b"\x02\x01\x00", b"\x02\x20" + b"\x7a" * 32)
    for inner, fits in ((rsa, True), (rsa[:-1], False), (rsa + b"\0", False), (b"\x04\x20" + bytes(32), True), (bytes([0x30, 34, 0x04, 0x21]) + bytes(32), False)):
        data = der(b"\x02\x01\x00", algorithm, bytes([0x04, len(inner)]) + inner)
        assert secrets.is_der_key(data) == fits
        assert bool(secrets.scan(base64.b64encode(data).decode())) == fits
    assert not secrets.is_der_key(der(b"\x02\x01\x00", b"\x30\x06" + algorithm[2:], b"\x04\x22\x04\x20" + bytes(32)))  # an algorithm cut short
    deep = b""
    for _ in range(40):
        deep = der(deep)
    assert not secrets.is_der_key(der(b"\x02\x01\x00", deep))


def test_keys_with_text_around():
    def pem(x, end="\n"):
        return end.join(x[k : k + 64] for k in range(0, len(x), 64))

    field = lambda x: struct.pack(">I", len(x)) + x
    ed25519 = der(b"\x02\x01\x00", b"\x30\x05\x06\x03\x2b\x65\x70", b"\x04\x22\x04\x20" + bytes(range(32)))
    assert len(ed25519) == 48
    found = [("der", ed25519)] + [("der", der(b"\x02\x01\x00", b"\x02\x82\x01" + bytes([n]) + b"\x9a" * (256 + n))) for n in range(3)]
    found += [("sshkey", b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + struct.pack(">I", 1) + field(b"k" * 51) + field(b"p" * (136 + n))) for n in range(3)]
    for kind, key in found:
        plain = base64.b64encode(key).decode()
        for body in {plain, pem(plain), pem(plain, "\r\n"), plain.rstrip("="), pem(plain.rstrip("="))}:
            around = [
                ("", ""), ("-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----\n"), ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"),
                ("key: ", "\nnext words follow"), ("x" * 40 + "\n", "\nword\nand/more"), ("a b\n", "\r\n-----END"),
            ]
            for before, after in around:
                spans = [(k, a, b) for a, _, k, b in secrets.scan(before + body + after) if k in ("der", "sshkey")]
                assert spans == [(kind, len(before), len(before) + len(body))], (kind, len(key), before, after)
        bare = plain.rstrip("=")
        assert [x[2] for x in secrets.scan(f"{bare}\n{bare}\nend") if x[2] != "hex"] == [kind, kind]
        assert not [x for x in secrets.scan(f"{bare[:-4]}\n-----END") + secrets.scan(f"{bare}AAAA\nword") if x[2] == kind]


# byte-level BPE


def test_bpe(spark, monkeypatch):
    encoding, _ = bpe.load("byte_bpe_50k.tiktoken")
    texts = [*EDGES, (1, "it's 12  apples\n\n\tand  'll \x1c\x85\u2003x \u200b漢字🙂🙂"), (2, "word " * 500), (3, "<|endoftext|>")]
    out = by_id(bpe.report(frame(spark, texts)))
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        assert (out[i][0].n_tokens, out[i][0].ids_sha256, out[i][0].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    with Workspace(spark, "test") as work:
        rows = {r.doc_id: r.ids for r in bpe.encode(frame(spark, texts), work, ids=True).collect()}
        assert rows[1] == encoding.encode_ordinary(dict(texts)[1]) and rows[900] == []
    named = bpe.report(frame(spark, texts[-3:]).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string"))))
    assert sorted((r.doc_id, r.n_tokens) for r in named.collect()) == sorted((f"k{i}", out[i][0].n_tokens) for i, _ in texts[-3:])
    assert bpe.report(frame(spark, texts).limit(0)).count() == 0


# toxicity


def test_toxicity_model():
    toxic = [(sentence(f"t{n}", 40) + " you absolute scumbag idiotface " + sentence("common", 20), 1) for n in range(120)]
    plain = [(sentence(f"p{n}", 40) + " " + sentence("common", 20), 0) for n in range(400)]
    model = toxicity.train(toxic + plain + [(None, 0)])
    assert model.score("hello scumbag there, idiotface") > 0.5 > model.score(sentence("new", 60))
    assert 0 <= model.score(None) <= 1 and model.score("") == model.score("1234 !!")
    assert toxicity.train([]).score("anything") == 0.0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    tp = sum(r.predicted and r.toxic for r in rows)
    assert tp / sum(r.toxic for r in rows) > 0.7 and tp / sum(r.predicted for r in rows) > 0.85
    empty = toxicity.report(frame(spark, EDGES), labels.limit(0)).collect()
    assert len(empty) == len(EDGES) and {r.predicted for r in empty} == {0}


# line dedup


def test_line_dedup(spark):
    notice, rare = "All rights reserved.", "seen on few sites"
    texts = [(n, f"own {n}\n {notice} \n{notice}\nend {n}" + (f"\n{rare}" if n < 9 else "")) for n in range(14)] + EDGES
    sources = [f"site{n}" for n in range(14)] + ["e"] * len(EDGES)
    got = by_id(linededup.report(frame(spark, texts, sources)))
    assert [got[n][0].n_removed for n in range(14)] == [1] + [2] * 13
    assert got[5][0].kept_sha256 == hashlib.sha256(f"own 5\nend 5\n{rare}".encode()).hexdigest()
    assert got[0][0].kept_sha256 == hashlib.sha256(f"own 0\n {notice} \nend 0\n{rare}".encode()).hexdigest()
    assert got[900][0].n_lines == 0 and len(got[904]) == 2
    edge = by_id(linededup.report(frame(spark, texts[:10], sources[:10])))  # just at the threshold
    assert edge[4][0].n_removed == 2 and linededup.report(frame(spark, texts).limit(0)).count() == 0


# quality


def test_quality_counts(spark):
    phrase = "one two three four five six"
    texts = [*EDGES, (1, f"{phrase} x {phrase} y {phrase}"), (2, "a b c d e f\n# $\n# $\n\n"), (3, "w " * 60), (4, sentence("z", 30))]
    got = by_id(quality.judge(frame(spark, texts)))
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(frame(spark, texts).limit(0)).count() == 0


def js(p, q):
    p, q = ([x / (sum(v) or 1) for x in v] for v in (p, q))
    return sum(x * math.log2(2 * x / (a + b)) / 2 for a, b in zip(p, q, strict=True) for x in (a, b) if x) ** 0.5


def prose(seed, lang, n):
    """Made-up words with the common words of a language among them, the first ones oftener."""
    rng, common = random.Random(f"{seed}{lang}"), quality.COMMON_WORDS[lang]
    return " ".join(rng.choices(common, range(8, 0, -1))[0] if rng.random() < 0.3 else "".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n))


def test_quality_words(spark):
    rows = [(100 * k + n, prose(n, lang, 60 + 12 * n), lang) for k, lang in enumerate(quality.COMMON_WORDS) for n in range(30)]
    wrong = [(1000 + k, prose(k, a, 200), b) for k, (a, b) in enumerate((a, b) for a in quality.COMMON_WORDS for b in quality.COMMON_WORDS if a != b)]
    rng = random.Random(1)
    salad = [(2000 + k, " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(200)), lang) for k, lang in enumerate(quality.COMMON_WORDS)]
    other = [(3000 + n, salad[0][1][n:], "zz") for n in range(25)]  # a language whose common words aren't known
    docs = rows + wrong + salad + other
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert [(i, got[i].js_chars, got[i].js_words) for i, _, _ in rows + other if not got[i].kept] == []
    assert not any(got[i].kept or got[i].base_failed for i, _, _ in wrong + salad)
    bins = {i: [t.split().count(w) for w in quality.COMMON] for i, t, _ in docs}
    for lang in quality.COMMON_WORDS:
        mine = [i for i, _, x in docs if x == lang]
        ref = [sum(c) for c in zip(*(bins[i] for i in mine), strict=True)]
        assert all(got[i].js_words == pytest.approx(js(bins[i], ref) if any(bins[i]) else 1.0, abs=1e-9) for i in mine)
    assert all(quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), guard_docs=1000).where("not base_failed").select("kept").toPandas()["kept"])


def classes(text):
    """Letters, white space, symbols, digits, punctuation, and bytes beyond one a character."""
    marks = (lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in "#*$%&|<>", lambda c: c in string.digits, lambda c: c in ".,;:!?'\"()[]{}-_/\\+=@^~`")
    counted = [sum(map(m, text)) for m in marks]
    return [len(text) - sum(counted), *counted, len(text.encode()) - len(text)]


def test_quality_characters_on_a_whole_table(spark):
    """The distance of character classes and the verdict it gives, for every document of the table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: (r.text or "", r.lang if r.lang in quality.COMMON_WORDS else "other") for r in docs.collect()}
    refs, held = {}, collections.Counter()
    for t, lang in rows.values():
        if len(WORD.findall(t)) >= quality.GUARD_WORDS:
            refs[lang] = [a + b for a, b in zip(refs.get(lang, [0] * 6), classes(t))]
            held[lang] += 1
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    rejected = 0
    for i, (t, lang) in rows.items():
        judged = len(WORD.findall(t)) >= quality.GUARD_WORDS and held[lang] >= quality.GUARD_DOCS
        far = js(classes(t), refs[lang]) if judged else 0.0
        assert got[i].js_chars == pytest.approx(far, abs=1e-9)
        rejected += far > quality.MAX_CHAR_DISTANCE
        assert not (got[i].kept and far > quality.MAX_CHAR_DISTANCE + 1e-9) and not (got[i].kept and got[i].base_failed)
    assert rejected > 10


# decontamination


def test_decontamination(spark):
    items = [(1, sentence("i", 30)), (2, "three short words"), (3, None), (4, ""), (5, sentence("j", 12)), (1, sentence("i", 30))]
    hay = sentence("hay", 300)
    w = items[0][1].split()
    texts = [
        *EDGES, (10, hay + " " + items[0][1].upper() + " " + hay), (11, hay), (12, "say Three, short: words!"), (13, " ".join(w[:28]) + " " + hay), (14, " ".join(w[:20])), (15, " ".join(w[:15] + ["gap"] + w[15:])),
    ]
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = by_id(decontam.judge(frame(spark, texts), table))

    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return w, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for i, t in texts:
        hits = set()
        for item, x in items:
            iw, need = shingles(x)
            if len(iw) >= 5 and len(need & shingles(t)[1]) >= 0.8 * len(need) - 1e-9 or 0 < len(iw) < 5 and f" {' '.join(iw)} " in f" {' '.join(shingles(t)[0])} ":
                hits.add(item)
        assert (got[i][0].n_items, got[i][0].item_ids, got[i][0].kept) == (len(hits), ",".join(map(str, sorted(hits))), not hits)
    assert decontam.judge(frame(spark, texts), table.limit(0)).where("kept").count() == len(texts)
    assert decontam.judge(frame(spark, texts).limit(0), table).count() == 0
