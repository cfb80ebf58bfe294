"""Ranked lexical search by impact-ordered postings, score at a time.

A term's impact in a document is its weight times a saturated count, all in integers, so equal impacts form groups. The
passes:

1. Documents are cut into terms once. Of each, the number of all its terms and its postings (term, occurrences) for terms
   that some query holds are kept in a table.
2. That table gives the corpus statistics: documents, terms, and documents of each term.
3. Its rows are gathered into shards of ``SHARD_POSTINGS``. In a shard each term's postings are ordered by impact and cut
   into groups of equal impact. A query takes the groups of all its terms from the highest contribution down and adds each
   to the scores of its documents. It stops once the groups that are left, at most one contribution a term, cannot lift a
   document that is no candidate to the k-th place; the candidates' scores are then completed from their own postings.
4. The best of all shards are ranked. A first search of one document in ``SAMPLE`` gives each query a score that k
   documents reach; shards return nothing below it, so what they return does not grow with their number.

Terms are known by 128 bits of two hashes. Queries are distinct texts; they go out in blocks of ``BLOCK_BYTES``, and every
block meets all documents.

Defined cases: a null or empty text has no terms, so it is never found, and as an item finds nothing; repeated documents
are each ranked, repeated items each get their rows; equal scores rank by ascending key, nulls first; an empty table gives
no rows; texts are cut whole; other columns are ignored.
"""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from packsieve.llm import kernel
from packsieve.llm.shared import Workspace, settle, small, text_key
from packsieve.session import ship

TOP = 20
#: Text bytes of a block of queries, postings of a shard, documents of which one is searched first, and candidates that are
#: completed at most before the search goes on (it is exact either way).
BLOCK_BYTES, SHARD_POSTINGS, SAMPLE, COMPLETED = 4 << 20, 2_000_000, 16, 4096
#: Fixed value: what terms are.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAPS = np.ones(256, bool)
GAPS[128:] = False
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    GAPS[_c] = False
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _second(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    table = kernel.TABLE2.copy()
    table[65:91] = kernel.TABLE2[97:123]
    return kernel.span_hash(kernel.prefix_sums(data, table, kernel.BASES[1]), starts, ends, kernel.BASES[1])


def _digests(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = kernel.word_spans(data, np.array([0, len(data)]), GAPS)
    return kernel.span_hash(kernel.prefix_sums(data, kernel.LOWER), starts, ends), _second(data, starts, ends)


def _postings(first: np.ndarray, second: np.ndarray, place: np.ndarray):
    """Pass 1. ``first`` are the ordered hashes of the queries' terms, with their second hashes and numbers."""
    width = len(first)

    def run(batches):
        for b in batches:
            n, heads, found, times = [], [], [], []
            for _, data, offsets in kernel.runs(b.column(1)):
                starts, ends, counts = kernel.word_spans(data, offsets, GAPS)
                h = kernel.span_hash(kernel.prefix_sums(data, kernel.LOWER), starts, ends)
                at = np.minimum(np.searchsorted(first, h), width - 1)
                hit = np.flatnonzero(first[at] == h)
                hit = hit[second[at[hit]] == _second(data, starts[hit], ends[hit])]
                doc = np.repeat(np.arange(len(counts)), counts)[hit]
                keys, tf = np.unique(doc * width + place[at[hit]], return_counts=True)
                n.append(counts)
                heads.append(np.bincount(keys // width, minlength=len(counts)))
                found.append(keys % width)
                times.append(tf)
            if not n:
                continue
            ends = pa.array(np.cumsum(np.concatenate([[0], *heads])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n).astype(np.int64)), *lists], names=["key", "n", "terms", "tf"])

    return run


class Shard:
    """Documents with their postings, forward and in impact order."""

    def __init__(self, keys: list, n: np.ndarray, heads: np.ndarray, term: np.ndarray, tf: np.ndarray, width: int, n_docs: int, n_terms: int):
        self.keys, self.width = keys, width
        m = 75 + (25 * n * n_docs) // max(n_terms, 1)
        doc = np.repeat(np.arange(len(n)), heads)
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        self.forward = doc * width + term  # ascending
        order = np.lexsort((-self.gain, term))
        self.doc, t, g = doc[order], term[order], self.gain[order]
        head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]) if len(t) else np.zeros(0, np.int64)
        self.start, self.end, self.level = head, np.r_[head[1:], len(t)].astype(np.int64), g[head]
        self.groups = np.searchsorted(t[head], np.arange(width + 1))  # groups of each term

    def complete(self, docs: np.ndarray, ask: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Exact scores of ``docs`` for terms ``ask``."""
        keys = docs[:, None] * self.width + ask[None, :]
        at = np.minimum(np.searchsorted(self.forward, keys), max(len(self.forward) - 1, 0))
        return (np.where(self.forward[at] == keys, self.gain[at], 0) * times[None, :]).sum(axis=1)

    def top(self, ask: np.ndarray, times: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(document, score) of the best ``k`` of the shard that score ``floor`` at least and above 0, best first."""
        first, last = self.groups[ask], self.groups[ask + 1]
        sizes = last - first
        own = np.repeat(np.arange(len(ask)), sizes)
        group = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        gives = self.level[group] * times[own]
        order = np.argsort(-gives, kind="stable")
        ends = np.cumsum((self.end - self.start)[group[order]])
        bounds = np.r_[gives, 0]
        base = np.r_[0, np.cumsum(sizes)[:-1]]
        score, done, batch = np.zeros(len(self.keys), np.int64), 0, 2048
        used = np.zeros(len(ask), np.int64)
        while True:
            # what one more document can still gain: each term's next group
            left = int(bounds[np.where(used < sizes, base + used, len(gives))].sum())
            reached = max(floor, 1)
            held = np.flatnonzero(score)
            if len(held) >= k:
                reached = max(reached, int(np.partition(score[held], len(held) - k)[len(held) - k]))
            if done == len(order):
                break
            if left < reached:
                held = held[score[held] + left >= reached]
                if len(held) <= COMPLETED:
                    score[held] = self.complete(held, ask, times)
                    break
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + batch, "right")))
            part, batch = order[done:to], batch * 2
            lens = (self.end - self.start)[group[part]]
            at = np.repeat(self.start[group[part]] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
            np.add.at(score, self.doc[at], np.repeat(gives[part], lens))
            used += np.bincount(own[part], minlength=len(ask))
            done = to
        held = held[score[held] >= max(floor, 1)]
        if len(held) > k:
            held = held[score[held] >= np.partition(score[held], len(held) - k)[len(held) - k]]
        best = sorted(held.tolist(), key=lambda d: (-score[d], self.keys[d] is not None, self.keys[d]))[:k]
        return [(d, int(score[d])) for d in best]


def _searcher(queries: list[tuple[np.ndarray, np.ndarray]], width: int, n_docs: int, n_terms: int, k: int, floors: list[int], kind: pa.DataType):
    """Pass 3: rows (query, key, score), the best of each shard."""

    def run(batches):
        def results(parts):
            keys = [x for p in parts for x in p[0]]
            shard = Shard(keys, *[np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3, 4)], width, n_docs, n_terms)
            rows = [(q, d, s) for q, (ask, times) in enumerate(queries) for d, s in shard.top(ask, times, k, floors[q])]
            q, d, s = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([keys[x] for x in d], kind), pa.array(s, pa.int64())], names=["query", "key", "score"])

        parts, held = [], 0
        for b in batches:
            used = np.flatnonzero(np.asarray(b.column("terms").value_lengths()) > 0)  # a document that shares no term is never found
            b = b.take(pa.array(used))
            sizes = np.asarray(b.column("terms").value_lengths())
            parts.append((b.column("key").to_pylist(), np.asarray(b.column("n")), sizes, np.asarray(b.column("terms").flatten()), np.asarray(b.column("tf").flatten())))
            held += int(sizes.sum())
            if held >= SHARD_POSTINGS:
                yield results(parts)
                parts, held = [], 0
        if held:
            yield results(parts)

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, texts: list, work: Workspace, name: str, k: int) -> DataFrame | None:
    """Search of a block of query texts: (query: its place in ``texts``, key, score, rank), or None where no text has terms."""
    words = sorted({w for t in texts for w in terms(t)})
    if not words:
        return None
    first, second = _digests(words)
    by_hash = np.argsort(first)
    field = docs.schema["key"].dataType
    table = docs.mapInArrow(_postings(first[by_hash], second[by_hash], by_hash), f"key {field.simpleString()}, n long, terms array<int>, tf array<int>")
    table = work.table(table, f"postings{name}")
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row a term of the block
    number = {w: i for i, w in enumerate(words)}
    queries = []
    for t in texts:
        asked = collections.Counter(number[w] for w in terms(t))
        ask = np.array(sorted(asked), np.int64)
        queries.append((ask, np.array([asked[i] * weight(n_docs, df.get(i, 0)) for i in ask.tolist()], np.int64)))

    def search(rows: DataFrame, floors: list[int]) -> DataFrame:
        run = _searcher(queries, len(words), n_docs, n_terms, k, floors, to_arrow_type(field))
        return _ranked(rows.mapInArrow(run, f"query int, key {field.simpleString()}, score long"), k)

    some = search(table.where(F.pmod(F.xxhash64("key", "n"), F.lit(SAMPLE)) == 0), [0] * len(texts))
    floors = [0] * len(texts)
    for q, low in some.where(F.col("rank") == k).select("query", "score").collect():  # a row a query
        floors[q] = low
    return work.table(search(table, floors), f"found{name}")


def search(docs: DataFrame, items: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """(item, rank, key, score): for each row of ``items`` its ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = items.select(F.col(item).alias("_item"), F.coalesce(F.col(item_text), F.lit("")).alias("_text")).withColumn("_query", text_key("_text"))
    queries = work.table(told.select("_query", "_text").dropDuplicates(["_query"]), "queries")
    size = F.octet_length("_text")
    total = queries.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("_query"), F.lit(blocks))
    found = None
    for b in range(blocks):
        texts = queries.where(part == b).select("_query", "_text").collect()  # about BLOCK_BYTES, or one longer text
        got = _block(rows, [r._text for r in texts], work, str(b), k)
        if got is not None:
            names = spark.createDataFrame([(n, r._query) for n, r in enumerate(texts)], "query int, _query binary")
            got = got.join(F.broadcast(names), "query").select("_query", "rank", "key", "score")
            found = got if found is None else found.unionByName(got)
    if found is None:
        found = rows.select(F.lit(None).cast("binary").alias("_query"), F.lit(0).alias("rank"), "key", F.lit(0).cast("long").alias("score")).limit(0)
    out = told.select("_query", "_item").join(small(found, 64), "_query")
    return out.select(F.col("_item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    with Workspace(docs.sparkSession, "search") as work:
        return settle(search(docs, items, work))


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
), sizes AS (SELECT row, count(*) AS n FROM doc_terms GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
item_terms AS (
  SELECT item_id, item, t, count(*) AS times FROM (
    SELECT item_id, item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT *, row_number() OVER () AS item FROM benchmark)
  ) GROUP BY ALL
), postings AS (SELECT doc_id, row, t, count(*) AS tf FROM doc_terms WHERE t IN (SELECT t FROM item_terms) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY t, docs),
gains AS (
  SELECT p.doc_id, p.row, p.t, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * s.n * z.docs) // z.terms))) AS g
  FROM postings p JOIN sizes s ON s.row = p.row JOIN weights w ON w.t = p.t, totals z
), scores AS (
  SELECT i.item_id, i.item, g.row, g.doc_id, sum(i.times * g.g)::BIGINT AS score FROM item_terms i JOIN gains g ON g.t = i.t GROUP BY ALL HAVING sum(i.times * g.g) > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
