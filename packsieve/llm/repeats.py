"""Repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if it lies in a string of ``DEPTH`` bytes that starts anywhere else too. Suffixes are ordered by passes over
ever deeper digits, and only the groups that a pass leaves with two members or more go on; after the last pass equal
groups are exactly the repeated windows. To order 1 in 170 suffixes only, windows are gathered by the suffix inside them
whose first ``GRAM`` bytes hash least (leftmost on ties): equal windows choose equal suffixes.

* Pass 1, ``GRAM`` bytes: chosen suffixes whose first bytes occur once leave.
* Pass 2, about 370 bytes: the windows around a suffix are dealt by their offset into steps of ``STEP``. All windows of
  a step share an inner string; steps whose inner string occurs once leave. Steps whose outer string, the union of the
  windows, occurs twice are settled: all their windows repeat.
* Pass 3, ``DEPTH`` bytes: the windows of what remains, one by one; of equal outer strings one stands for all.

Texts that lose no byte are searched with words as tokens too (``passages``), for runs of ``PASSAGE`` words or more that
another document holds, whatever the white space in them: such a run may be shorter than ``DEPTH``. Windows of words are gathered by the least of their ``WORD_GRAM``-word suffixes; those
whose suffix lies in one text only leave, and equal windows of different texts are passages.

Texts are known by their digest, so copies are sorted once; a text of ``DEPTH`` bytes or more that has a copy goes whole.
Digits are compared by 128-bit hashes (pass 1: 64-bit, as a sieve only). No pass sends more than the surviving
suffixes of a text to one task, and counts of equal digits are reduced inside each task first.

Defined cases: a null or empty text has no bytes; shorter texts than ``DEPTH`` lose nothing; repeated rows are copies of
each other; ids may be null or repeat; a text is worked on whole in one task, with some 60 bytes of arrays a byte of the
longest text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsieve.llm.kernel import BASES, TABLE, TABLE2, powers, prefix_sums, runs, span_hash, word_spans
from packsieve.llm.shared import BROADCAST_BYTES, Workspace, join_few, settle
from packsieve.session import ship

DEPTH = 400
GRAM = 64
STEP = 32
#: Words of a passage, and of the suffix that stands for its windows.
PASSAGE, WORD_GRAM = 51, 8
#: Bytes of a row when it is broadcast: a window's hash, and a text's digest.
WINDOW_BYTES, DIGEST_BYTES = 64, 48
SPACES = "\t\n\x0b\x0c\r"


def _least_leftmost(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, the leftmost on ties."""
    n = len(h) - width + 1
    value, place = h, np.arange(len(h), dtype=np.int32)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = value[:-step], value[step:]
        take = right < left
        place = np.where(take, place[step:], place[:-step])
        value = np.where(take, right, left)
        reach += step
    return place[:n]


def chosen(n: int, sums: np.ndarray, gram: int = GRAM, depth: int = DEPTH) -> np.ndarray:
    """For each window of ``depth`` of a text's n tokens, the suffix that stands for it."""
    starts = np.arange(n - gram + 1)
    return _least_leftmost(span_hash(sums, starts, starts + gram), depth - gram + 1)


def _texts(column: pa.Array):
    for first, data, offsets in runs(column):
        for k in range(len(offsets) - 1):
            yield first + k, data[offsets[k] : offsets[k + 1]]


def _wide_hash(data: np.ndarray, starts: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of data[s:s + size] for each start."""
    return tuple(span_hash(prefix_sums(data, t, b), starts, starts + size, b).view(np.int64) for t, b in ((TABLE, BASES[0]), (TABLE2, BASES[1])))


def _pass1(batches):
    """Rows (d, gram, places): the suffixes that stand for a text's windows, those that begin alike in one row."""
    for b in batches:
        digests, grams, places, sizes = [], [], [], []
        ids = b.column(0).to_pylist()
        for i, data in _texts(b.column(1)):
            if len(data) < DEPTH:
                continue
            sums = prefix_sums(data)
            at = np.unique(chosen(len(data), sums))
            gram = span_hash(sums, at, at + GRAM).view(np.int64)
            order = np.argsort(gram, kind="stable")
            distinct, counts = np.unique(gram, return_counts=True)
            places.append(at[order])
            grams.append(distinct)
            sizes.append(counts)
            digests += [ids[i]] * len(distinct)
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.concatenate(grams)), _lists(np.concatenate(places), np.concatenate(sizes))], names=["d", "gram", "places"])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _steps(data: np.ndarray, places: np.ndarray):
    """Steps of the windows that the suffixes ``places`` stand for: (suffix, step, first window, windows)."""
    sums = prefix_sums(data)
    anchor = chosen(len(data), sums)
    window = np.flatnonzero(np.isin(anchor, places))
    step = (anchor[window] - window) // STEP
    new = np.flatnonzero(np.r_[True, (anchor[window][1:] != anchor[window][:-1]) | (step[1:] != step[:-1])]) if len(window) else window
    return anchor[window][new], step[new], window[new], np.diff(np.r_[new, len(window)])


def _pass2(batches):
    """Rows (d, step, n, windows, i1, i2, o1, o2): hashes of a step's inner and outer strings, and the first windows of
    all places of the text that agree in them. The outer ones are null where the text ends before the outer string
    does; such places are not put together."""
    names = ["d", "step", "n", "windows", "i1", "i2", "o1", "o2"]
    for b in batches:
        ids, wanted = b.column(0).to_pylist(), b.column(2)
        for i, data in _texts(b.column(1)):
            suffix, step, window, n = _steps(data, np.asarray(wanted[i].values))
            if not len(suffix):
                continue
            last = suffix - STEP * step
            i1, i2 = _wide_hash(data, last, DEPTH - STEP + 1)
            first = last - STEP + 1
            fits = (first >= 0) & (last + DEPTH <= len(data))
            o1, o2 = _wide_hash(data, np.where(fits, first, 0), np.where(fits, DEPTH + STEP - 1, 0))
            keys = np.stack([i1, i2, step, o1, o2, np.where(fits, -1, window)])
            order = np.lexsort(keys)
            new = np.r_[True, (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(axis=0)]
            head = order[new]
            sizes = np.diff(np.r_[np.flatnonzero(new), len(order)])
            # equal outer strings hold equal windows; the longest count stands for a group cut off by an end
            most = np.maximum.reduceat(n[order], np.flatnonzero(new))
            arrays = [pa.array([ids[i]] * len(head), pa.binary()), pa.array(step[head].astype(np.int32)), pa.array(most.astype(np.int32)), _lists(window[order], sizes)]
            arrays += [pa.array(i1[head]), pa.array(i2[head]), *(pa.array(o[head], mask=~fits[head]) for o in (o1, o2))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _ranges(parts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """First windows and counts of a list of (windows, n)."""
    rows = parts.values
    lists, n = rows.field("windows"), np.asarray(rows.field("n"))
    return np.asarray(lists.flatten()), np.repeat(n, np.asarray(lists.value_lengths()))


def _pass3(batches):
    """Rows (d, window, w1, w2) of the windows of the steps in (windows, n) lists."""
    for b in batches:
        ids = b.column(0).to_pylist()
        for i, data in _texts(b.column(1)):
            start, n = _ranges(b.column(2)[i])
            at = np.unique(np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))
            w1, w2 = _wide_hash(data, at, DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2)], names=["d", "window", "w1", "w2"])


def _cut(batches):
    """Rows (d, spans, rest, gone_words): the removed runs, the bytes left, and how many words lost bytes, from lists of runs
    of repeated windows."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        spans, rest, words = [], [], []
        for i, data in _texts(b.column(1)):
            start, n = _ranges(b.column(2)[i])
            edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + n - 1 + DEPTH, minlength=len(data) + 1)
            gone = np.cumsum(edge[: len(data)]) > 0
            change = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            spans.append([{"start": s, "end": e} for s, e in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)])
            rest.append(data[~gone].tobytes())
            first, stop, _ = word_spans(data, np.array([0, len(data)]))
            held = np.r_[0, np.cumsum(gone)]
            words.append(int(np.count_nonzero(held[stop] > held[first])))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(rest, pa.binary()), pa.array(words, pa.int64())], names=["d", "spans", "rest", "gone_words"])


def _word_sums(data: np.ndarray) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """How many words a text has, and the prefix sums of their hashes to either base."""
    starts, stops, _ = word_spans(data, np.array([0, len(data)]))
    words = span_hash(prefix_sums(data), starts, stops)
    return len(words), tuple(np.r_[np.uint64(0), np.cumsum(words * powers(b, len(words) + 1)[0][: len(words)], dtype=np.uint64)] for b in BASES)


def _word_pass1(batches):
    """Rows (d, grams): the suffixes that stand for the windows of words of a text."""
    for b in batches:
        digests, grams = [], []
        ids = b.column(0).to_pylist()
        for i, data in _texts(b.column(1)):
            n, (sums, _) = _word_sums(data)
            if n < PASSAGE:
                continue
            at = np.unique(chosen(n, sums, WORD_GRAM, PASSAGE))
            digests.append(ids[i])
            grams.append(np.unique(span_hash(sums, at, at + WORD_GRAM).view(np.int64)))
        if digests:
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(list(map(len, grams)))].astype(np.int32)), pa.array(np.concatenate(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), lists], names=["d", "grams"])


def _word_pass2(batches):
    """Rows (d, window, w1, w2) of the windows of words that the suffixes ``grams`` stand for."""
    for b in batches:
        ids = b.column(0).to_pylist()
        for i, data in _texts(b.column(1)):
            n, (sums, more) = _word_sums(data)
            at = chosen(n, sums, WORD_GRAM, PASSAGE)
            window = np.flatnonzero(np.isin(span_hash(sums, at, at + WORD_GRAM).view(np.int64), np.asarray(b.column(2)[i].values)))
            w1, w2 = (span_hash(x, window, window + PASSAGE, base).view(np.int64) for x, base in zip((sums, more), BASES, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(window), pa.binary()), pa.array(window.astype(np.int32)), pa.array(w1), pa.array(w2)], names=["d", "window", "w1", "w2"])


def _small(f, texts: int = 256):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, texts):
                yield from f([b.slice(at, texts)])

    return run


def repeated_spans(docs: DataFrame, work: Workspace, text: str = "text") -> DataFrame:
    """(d, spans, rest, gone_words) of every distinct text, known by its digest d, that holds repeated windows and has no copy."""
    ship(docs.sparkSession)
    texts = docs.select(F.unhex(F.md5(F.encode(F.col(text), "UTF-8"))).alias("d"), F.col(text).alias("t")).where(F.octet_length("t") >= DEPTH)
    suffixes = work.table(texts.mapInArrow(_small(_pass1), "d binary, gram long, places array<int>").dropDuplicates(["d", "gram"]), "suffixes")
    seen = F.xxhash64("d")
    twice = suffixes.groupBy("gram").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.max(F.size("places")).alias("most"))
    twice = twice.where("lo != hi or most > 1").select("gram")
    wanted = suffixes.join(twice, "gram").groupBy("d").agg(F.flatten(F.collect_list("places")).alias("places"))
    # the texts that stay are kept once; later passes read them only
    left = work.table(texts.join(wanted, "d").dropDuplicates(["d"]), "texts")
    steps = left.select("d", "t", "places").mapInArrow(_small(_pass2), "d binary, step int, n int, windows array<int>, i1 long, i2 long, o1 long, o2 long")
    steps = work.table(steps, "steps")
    # groups of equal inner strings, with equal outer strings as one row; places without outer strings stay apart
    outer = steps.withColumns({"alone": F.when(F.col("o1").isNull(), F.xxhash64("d", "windows")), "first": F.get("windows", F.lit(0)), "many": F.size("windows").cast("long")})
    outer = outer.groupBy("i1", "i2", "step", "o1", "o2", "alone").agg(F.sum("many").alias("c"), F.max_by(F.struct("d", "first", "n"), "n").alias("one"))
    outer = work.table(outer.drop("alone"), "outer")
    inner = outer.groupBy("i1", "i2", "step").agg(F.count("*").alias("outers")).where("outers > 1").select("i1", "i2", "step")
    settled = outer.where("o1 is not null and c > 1").select("i1", "i2", "step", "o1", "o2")
    sure = steps.join(settled, ["i1", "i2", "step", "o1", "o2"]).select("d", "windows", "n")
    open_ = outer.join(inner, ["i1", "i2", "step"])
    # a settled string takes part as one example, so that others can equal its windows
    asked = open_.select("one.*").groupBy("d").agg(F.collect_list(F.struct(F.array("first").alias("windows"), "n")).alias("parts"))
    windows = left.select("d", "t").join(asked, "d").mapInArrow(_small(_pass3), "d binary, window int, w1 long, w2 long")
    windows = work.table(windows, "windows")
    mark = F.xxhash64("d", "window")
    equal = windows.groupBy("w1", "w2").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo != hi").select("w1", "w2")
    found = windows.join(equal, ["w1", "w2"]).groupBy("d").agg(F.collect_list("window").alias("windows")).select("d", "windows", F.lit(1).alias("n"))
    per_text = sure.unionByName(found).groupBy("d").agg(F.collect_list(F.struct("windows", "n")).alias("parts"))
    return left.select("d", "t").join(per_text, "d").mapInArrow(_small(_cut), "d binary, spans array<struct<start:int,end:int>>, rest binary, gone_words long")


def passages(docs: DataFrame, work: Workspace, lost: DataFrame, text: str = "text") -> DataFrame:
    """(d, n_words) of every distinct text out of those in ``lost`` (d) that shares a passage with any other one: its words
    that lie in such passages."""
    ship(docs.sparkSession)
    texts = docs.select(F.unhex(F.md5(F.encode(F.col(text), "UTF-8"))).alias("d"), F.col(text).alias("t")).where(F.octet_length("t") >= 2 * PASSAGE - 1)
    suffixes = texts.mapInArrow(_small(_word_pass1), "d binary, grams array<long>").dropDuplicates(["d"])
    suffixes = suffixes.join(lost.select("d", F.lit(True).alias("lost")).hint("merge"), "d", "left").select("d", "grams", F.col("lost").isNull().alias("free"))
    suffixes = work.table(suffixes, "word-suffixes")
    each = suffixes.select("d", "free", F.explode("grams").alias("gram"))
    # suffixes of two texts or more, one of which has lost nothing yet
    twice = each.groupBy("gram").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.bool_or("free").alias("asked")).where("lo != hi and asked").select("gram")
    wanted = work.table(each.join(twice, "gram").groupBy("d").agg(F.collect_list("gram").alias("grams")), "word-wanted")
    if wanted.count() * DIGEST_BYTES <= BROADCAST_BYTES:  # few texts: the others need not be shuffled to find that out
        texts = texts.join(F.broadcast(wanted.select("d")), "d", "left_semi")
    windows = texts.join(wanted, "d").dropDuplicates(["d"]).select("d", "t", "grams").mapInArrow(_small(_word_pass2), "d binary, window int, w1 long, w2 long")
    windows = work.table(windows.select("d", "window", F.struct("w1", "w2").alias("w")), "word-windows")
    equal = windows.groupBy("w").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("w", "n")
    found = join_few(windows, work.table(equal, "word-equal"), "w", WINDOW_BYTES, "n").groupBy("d").agg(F.array_sort(F.collect_list("window")).alias("at"))
    gaps = F.transform(F.expr("slice(at, 2, size(at) - 1)"), lambda p, j: F.least(F.lit(PASSAGE), p - F.get(F.col("at"), j)))
    return found.select("d", F.aggregate(gaps, F.lit(PASSAGE), lambda a, x: a + x).cast("long").alias("n_words")).join(lost.hint("merge"), "d", "left_anti")


def remove_repeats(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words, and the spans (of copies: the
    whole text). ``n_repeated_words`` are words that lost a byte; of texts that lost none, and of copies, words in passages
    that another document holds too."""
    bytes_ = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    words = F.size(F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, " " * len(SPACES)), " "), ""))
    rows = docs.select(F.col(key), F.unhex(F.md5(bytes_)).alias("d"), F.length(bytes_).cast("long").alias("n_bytes"), F.sha2(bytes_, 256).alias("sha"), words.alias("words"))
    copies = rows.groupBy("d").agg(F.count("*").alias("copies")).where("copies > 1").select("d", F.lit(True).alias("copied"))
    # the tables of either search go before the other begins
    with Workspace(work.spark, "repeats-bytes") as own:
        cut = repeated_spans(docs, own, text).select("d", "spans", F.length("rest").alias("left"), F.sha2("rest", 256).alias("left_sha"), "gone_words")
        cut = work.table(cut, "cut")
    with Workspace(work.spark, "repeats-words") as own:
        lost = own.table(cut.select("d").unionByName(copies.select("d")).distinct(), "lost")
        shared = work.table(passages(docs, own, lost, text).select("d", F.col("n_words").alias("shared")), "shared")
    both = rows.join(copies, "d", "left").join(cut, "d", "left").join(shared, "d", "left")
    copied = F.coalesce("copied", F.lit(False))
    whole = copied & (F.col("n_bytes") >= DEPTH)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return both.select(
        key, "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("left"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(whole | (copied & (F.col("words") >= PASSAGE)), F.col("words")).otherwise(F.coalesce("gone_words", "shared", F.lit(0))).cast("long").alias("n_repeated_words"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``remove_repeats`` without the spans."""
    with Workspace(docs.sparkSession, "repeats") as work:
        return settle(remove_repeats(docs, work, key, text).drop("spans"))
