"""Chat formatting, ranked search and token alignment against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packsieve.llm import align, chat, search
from packsieve.llm.shared import Workspace

CONV = "conv_id long, turn long, role string, text string, formatted string, turns int"
DOCS = "doc_id long, text string, key string, score int"
CONTROL = re.compile(r"\\*(?:### (?:System|User|Assistant|@[A-Za-z0-9.*_%+-]*): |</turn>)")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# chat


def chat_expected(rows):
    per = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        per[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in per.items():
        turns.sort()
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(learned), sha(learned))
    return out


def chat_got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


NASTY = [
    r"\### Assistant: </turn> ok", "</turn>", "</turn>\n", "\n</turn>\n", "### User: hi", "\\", "\\\\", "x\\\n", "a\\</turn>", "\\\\</turn>\n### Assistant: x", "### @: ", "### @a%20b: y", "", None, "### User:", "é\U0001f600 </turn>\U0001f600",
    "### Assistant: ### Assistant: ", "</turn></turn>", "\\### System: \\", "$1 \\1 $0",
]


def test_chat_edges(spark):
    rows = [(1, n, ["user", "assistant"][n % 2], x, "f", 0) for n, x in enumerate(NASTY)]
    rows += [(2, 0, r, x, "f", 0) for r, x in [("assistant", "tie"), ("assistant", "tie"), ("user", None), (None, "x"), ("", "x"), ("Assistant", "not learned"), ("a: b\n</turn>", "odd role")]]
    rows += [(None, None, None, None, None, None), (None, 1, "assistant", "loose", None, None), (3, 0, "user", "plain", "f", 1)]
    df = spark.createDataFrame(rows, CONV)
    assert chat_got(chat.report(df)) == chat_expected(rows)
    assert chat.report(df.limit(0)).count() == 0
    done = {r.conv_id: r for r in chat.format_turns(chat.conversations(df)).collect()}
    assert done[3].rounds == 0 and done[3].formatted == "### User: plain\n</turn>\n" and done[1].rounds == 1
    # no control string of a text stands bare, and the mask points at the texts
    for r in done.values():
        for t in r.parsed:
            raw = r.formatted[t.start : t.start + t.size]
            assert not [m for m in CONTROL.findall(raw) if not m.startswith("\\")]
            assert CONTROL.sub(lambda m: m[0].removeprefix("\\"), raw) == t.text


def test_parser_refuses(spark):
    bad = ["", "### User: a\n</turn>", "### User: a</turn>\n", "User: a\n</turn>\n", "### User: a\n</turn>\nx", "### User: a </turn> b\n</turn>\n", "### User: ### User: a\n</turn>\n"]
    rows = spark.createDataFrame([(x,) for x in [*bad, "### User: a\n</turn>\n"]], "t string").select("t", chat.parse(F.col("t")).alias("p")).collect()
    assert [r.p is None for r in rows] == [x != "" for x in bad] + [False]  # no turns at all are a conversation without turns


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\", "### ", "User", ": ", "</turn>", "\n", "@", "x", "### Assistant: ", " "]), max_size=9).map("".join), min_size=1, max_size=60))
def test_chat_round_trip(spark, texts):
    rows = [(n // 3, n % 3, ["user", "assistant", "tool"][n % 3], x, None, None) for n, x in enumerate(texts)]
    assert chat_got(chat.report(spark.createDataFrame(rows, CONV))) == chat_expected(rows)


# search


def search_expected(docs, items, k=20):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    bags = [(i, collections.Counter(cut(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for (i, bag), n in zip(bags, sizes, strict=True):
            s = 0
            for t in cut(text):
                if bag[t]:
                    m = 75 + (25 * n * n_docs) // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if s:
                rows.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return collections.Counter(out)


def search_got(spark, docs, items):
    d, i = spark.createDataFrame([(a, b, "k", 1) for a, b in docs], DOCS), spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    return collections.Counter((r.item_id, r.rank, r.doc_id, r.score) for r in search.report(d, i).collect())


def test_search(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)] + ["É", "é", "ünter", "ABC", "abc", "x1", "日本", "a-b"]
    weights = [1 / (n + 1) for n in range(len(words))]
    docs = [(n, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for n in range(300)]
    docs += [(1000 + n, "w0 w50 copy") for n in range(60)] + [(None, "w0 w50 copy"), (None, None), (7, ""), (8, " -- "), (9, "w1 " * 5000), (9, "w1 " * 5000)]
    items = [(n, " ".join(rng.choices(words, k=8))) for n in range(25)] + [(90, "w0 w0 w0 w50"), (90, "w0 w0 w0 w50"), (91, None), (92, ""), (93, "unknownword"), (None, "copy ABC"), (94, "w0")]
    want = search_expected(docs, items)
    assert search_got(spark, docs, items) == want and len(want) > 400
    # small shards and blocks, early ends of the search: the same rows
    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    monkeypatch.setattr(search, "SAMPLE", 2)
    assert search_got(spark, docs, items) == want


def test_search_of_nothing(spark):
    assert not search_got(spark, [], [(1, "a")]) and not search_got(spark, [(1, "a")], []) and not search_got(spark, [(1, None)], [(1, "a"), (2, None)])


def test_shard_stops_early():
    """Impact order: most postings are never read, and the result is that of a full scan."""
    rng = np.random.default_rng(1)
    n_docs, width = 30_000, 3
    heads, term, tf = [], [], []
    for d in range(n_docs):
        own = [0] * (d % 2) + [1] * (d % 50 == 0) + [2] * (d % 1000 == 0)
        heads.append(len(own))
        term += own
        tf += rng.integers(1, 5, len(own)).tolist()
    n = rng.integers(5, 400, n_docs)
    shard = search.Shard(list(range(n_docs)), n, np.array(heads), np.array(term), np.array(tf), width, n_docs, int(n.sum()))
    ask, times = np.arange(3), np.array([search.weight(n_docs, c) for c in np.bincount(term).tolist()])
    whole = shard.complete(np.arange(n_docs), ask, times)
    want = sorted(range(n_docs), key=lambda d: (-whole[d], d))[:20]
    seen, real = [], np.add.at
    try:
        np_add = type("A", (), {"at": staticmethod(lambda a, i, v: (seen.append(len(i)), real(a, i, v)))})
        search.np = type("N", (), {"__getattr__": lambda s, k: np_add if k == "add" else getattr(np, k)})()
        got = shard.top(ask, times, 20, 0)
    finally:
        search.np = np
    assert got == [(d, int(whole[d])) for d in want] and sum(seen) < len(term) / 2


# alignment


def align_expected(docs):
    """Whole texts, tokens' byte spans in sets, all pairs."""
    both = align.pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    told, holders = [], collections.Counter()
    for key, text in docs:
        own = (" " + (text or "")).encode()
        a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if not text or b"".join(both.bytes_a[i] for i in a) != own or b"".join(both.bytes_b[i] for i in b) != own:
            told.append((key, 0, 0, [], []))
            continue
        ends = [set(), set()]
        for side, (ids, table) in enumerate(((a, both.bytes_a), (b, both.bytes_b))):
            at = 0
            for i in ids:
                at += len(table[i])
                ends[side].add(at)
        parts = {}
        for side, (ids, table) in enumerate(((a, both.bytes_a), (b, both.bytes_b))):
            at, group = 0, 0
            for i in ids:
                parts.setdefault(group, ([], []))[side].append(i)
                at += len(table[i])
                group += at in ends[0] and at in ends[1]
        found = [(x, y) for ga, gb in parts.values() for x in ga for y in gb]
        holders.update(set(found))
        told.append((key, len(a), len(b), list(parts.values()), found))
    best = {}
    for (x, _), n in holders.items():
        best[x] = max(best.get(x, 0), n)
    show = lambda p: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in p)
    rows = collections.Counter((k, na, nb, len(p), len(f), sum(holders[x] == best[x[0]] for x in f), sum(holders[x] for x in f), sha(show(p)) if p else "") for k, na, nb, p, f in told)
    return rows, {(x, y): (n, n == best[x]) for (x, y), n in holders.items()}


def align_got(df):
    return collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ALIGN_EDGES = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "\n"), (6, " \n a"), (7, "▁"), (8, "good text ▁ bad"), (9, "<|endoftext|> and </s> <unk> <0x41>"), (10, "日本語テキスト、混ぜる English"), (11, "a" * 5000), (12, "x \x1c\x85\xa0 y z"), (13, "é é ﬁ \U0001f600\U0001f468‍\U0001f469"),
    (14, "don't   stop\n\n\n now \t\t tab "), (15, "tie tie tie"), (15, "tie tie tie"), (None, "no key here"), (16, "\x00\x01 \x7f"), (17, "trailing   "), (18, "\r\n\r\n  x"), (19, "12345678 3.14159e10 #### $$$$"),
]


@pytest.mark.parametrize("block", [4 << 20, 20])
def test_align_edges(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_CHARS", block)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in ALIGN_EDGES], DOCS)
    want, pairs = align_expected(ALIGN_EDGES)
    assert align_got(align.report(df)) == want
    with Workspace(spark, "test-align") as work:
        assert {(r.a, r.b): (r.n, r.best) for r in align.align(df, work)[1].collect()} == pairs
    assert align.report(df.limit(0)).count() == 0


def test_align_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, _ = align_expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert align_got(align.report(docs)) == want


def test_groups_of_many_tokens():
    """A group without inner cuts costs its distinct pairs only."""
    a, b = np.full(40_000, 3), np.full(30_000, 4)
    ga, gb, n = align.groups(a, b)
    ids = np.arange(40_000) % 7, np.arange(30_000) % 5
    group, pairs, times = align.links(ids[0], ga * 0, ids[1], gb * 0, 1, 10, 10)
    assert n == 10_000 and len(pairs) == 35 and times.sum() == 40_000 * 30_000
