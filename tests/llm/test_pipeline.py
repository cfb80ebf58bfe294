"""The pipeline's stages, one by one and together, against brute force on a made corpus."""

import hashlib
import random
import re

import pytest

from packsieve.llm import bpe

pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
INSULTS = ["scumbag", "idiotface", "dirtbrain"]


def words(seed, n):
    return " ".join(hashlib.md5(f"{seed}{k}".encode()).hexdigest()[:5] for k in range(n))


def row(i, text, source="s0"):
    return (i, text, "en", source, len(text or ""))


# what each stage should keep, in plain Python


def lines_expected(rows, min_sites=10):
    """Sites are counted by line; long lines by sites and documents."""
    where = {}
    for n, (i, t, _, s, _) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                where.setdefault(line.strip(" \t\n\x0b\x0c\r"), []).append(((i is None, i or 0, hashlib.md5((t or "").encode()).digest()), k, s, n))
    gone = {}
    for line, at in where.items():
        sites, docs = {s for _, _, s, _ in at}, {d for d, *_ in at}
        long = len(WORD.findall(line)) > 50
        if len(sites) >= min_sites or long and (len(sites) >= 2 or len(docs) >= 10):
            first = min(d for d, *_ in at), min(k for d, k, *_ in at if d == min(d for d, *_ in at))
            for d, k, _, n in at:
                if (d, k) != first:
                    gone.setdefault(n, set()).add(k)
    out = []
    for n, (i, t, lang, s, size) in enumerate(rows):
        if n in gone:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[n])
            if not WORD.search(t):
                continue
            size = len(t)
        out.append((i, t, lang, s, size))
    return out


def near_expected(rows, width=5, percent=80):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    best = {}
    for n, r in enumerate(rows):
        best.setdefault(find(n), []).append((r[0] is None, r[0] or 0, n))
    return [rows[min(g)[2]] for g in best.values()]


def clean_expected(rows, items, share=0.8):
    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    asked = [shingles(t) for _, t in items]
    return [r for r in rows if not any(x and len(x & shingles(r[1])) >= share * len(x) - 1e-9 for x in asked)]


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("corpus")
    rng, rows, labels = random.Random(4), [], []
    common = words("common", 40).split()
    prose = lambda seed, n: " ".join(w if k % 3 else rng.choice(common) for k, w in enumerate(words(seed, n).split()))
    for n in range(330):
        text = prose(f"p{n}", 60)
        if toxic := n % 5 == 0:
            w = text.split()
            for at in (10, 25, 40):
                w.insert(at, rng.choice(INSULTS))
            text = " ".join(w)
        rows.append(row(n, text, f"s{n % 12}"))
        labels.append((n, int(n % 2), int(toxic)))
    notice, passage = "All rights reserved by the site", prose("passage", 60)
    rows += [row(1000 + n, f"{prose(f'n{n}', 40)}\n{notice}\n{prose(f'm{n}', 20)}", f"t{n}") for n in range(13)]
    rows += [row(1100 + n, f"{prose(f'o{n}', 70)}\n {passage} ", "one") for n in range(11)] + [row(1120, passage, "two"), row(1121, notice, "two")]
    base = prose("base", 120).split()
    for n in range(12):
        w = list(base)
        w[9 * n] = f"edit{n}"
        rows.append(row(1200 + n, " ".join(w)))
    items = [(k, prose(f"item{k}", 30)) for k in range(3)] + [(9, None)]
    rows += [row(1300 + k, f"{prose(f'h{k}', 80)} {items[k][1]} {prose(f't{k}', 80)}") for k in range(3)] + [row(1310, " ".join(items[0][1].split()[:15]))]
    rows += [row(1400, None), row(1400, None), row(1401, ""), row(1402, " \n "), row(None, prose("nobody", 30)), row(None, prose("nobody", 30)), row(1403, prose("twin", 30)), row(1403, prose("twin", 30))]
    rows += [row(1404, prose("shared a", 30)), row(1404, prose("shared b", 30)), row(1405, "two words"), row(1406, prose("long", 20_000))]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, items


def test_stages_and_run(spark, corpus, tmp_path):
    """Every stage on all that its predecessor kept, then run() as a whole."""
    where, rows, items = corpus
    want = [r for r in rows if not set(INSULTS) & set((r[1] or "").split())]
    steps = [lambda x: want, lines_expected, near_expected, lambda x: clean_expected(x, items)]
    docs, now = spark.read.parquet(f"{where}/documents.parquet"), rows
    for n, ((_, stage), expect) in enumerate(zip(pipeline.STAGES, steps)):
        before, now = now, expect(now)
        stage(spark, docs, where).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.schema.simpleString() == spark.read.parquet(f"{where}/documents.parquet").schema.simpleString()
        assert sorted(map(tuple, docs.collect()), key=key) == sorted(now, key=key)
        assert len(now) < len(before) or now != before  # each stage has something to do
    encoding, _ = bpe.load("byte_bpe_50k.tiktoken")
    told = []
    for i, t, *_ in now:
        ids = encoding.encode_ordinary(t or "")
        told.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in pipeline.run(spark, where).collect()]
    assert sorted(got, key=lambda r: key(r[:4])) == sorted(told, key=lambda r: key(r[:4]))


def test_stages_take_empty_tables_and_other_columns(spark, corpus):
    where, *_ = corpus
    docs = spark.createDataFrame([(*row(n, words(n, 30)), n, "x", 0.9, "y") for n in range(3)], f"{COLUMNS}, _row int, _key string, _score double, _text string")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), where).count() == 0
        assert sorted(map(tuple, stage(spark, docs, where).collect())) == sorted(map(tuple, docs.collect())), name
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), where).count() == 0


def test_passages_on_few_sites(spark):
    many = lambda seed, n: " ".join(f"{seed}{k}" for k in range(n))
    lines = {  # line: sites of its documents
        many("two", 51): ["a", "b"], many("nine", 60): list("abcdefghi"), many("hot", 80): ["h"] * 10, many("cool", 80): ["h"] * 9, many("fifty", 50): list("abcdefghi"),
        many("ten", 5): list("abcdefghij"), many("short", 5): ["h"] * 30, many("nulls", 51): [None, "a"], many("alone", 70): ["a"],
    }
    rows, gone = [], {}
    for line, sites in lines.items():
        enough = len(set(sites)) >= 10 or len(line.split()) > 50 and (len(set(sites)) >= 2 or len(sites) >= 10)
        for n, site in enumerate(sites):
            i = len(rows)
            rows.append((i, f"own {i}\n  {line}\nend {i}", "en", site, 0))
            gone[i] = enough and n > 0
    rows.append((len(rows), "\n".join([many("self", 51)] * 12), "en", "a", 0))  # twelve times in one document only
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r.text for r in pipeline.drop_boilerplate(spark, docs, D).collect()}
    assert got == {i: f"own {i}\nend {i}" if gone.get(i) else t for i, t, *_ in rows}
