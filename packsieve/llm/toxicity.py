"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into windows of words that
ordinary text doesn't share; each window is compressed with either dictionary, and the difference of the two lengths
says which kind of text it is like. Windows are counted by that difference and by how short the toxic dictionary makes
them; the counts, weighed by a logistic fit on training rows, give a score of 0 to 1, and 0.5 is the threshold. A window
is one word, twice, as blocks of a few bytes are stored raw; a word is compressed once a task, while ``CACHE`` lasts.
Windows of several words of running text were measured and tell less (README): the one word that matters changes such a
window's length less than its neighbours do.

Training takes a bounded sample: at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows, by hash of the id, none of
them held out. Of ordinary rows one half gives the common words, the other half the dictionary and the fit; of toxic rows
some are kept from the dictionary for the fit. Scores use the text alone.

Defined cases: a null or empty text, or one without letters, has no windows and gets the score of that; a null or
missing label is no training row; without training rows of both kinds every score is 0; repeated rows are each scored; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.session import ship

TOXIC_ROWS, ORDINARY_ROWS = 3000, 8000
DICTIONARY_BYTES = 16 << 10
#: An unusual word marks toxic text if so large a share of toxic rows has it, and two rows at least.
MARK_SHARE = 0.003
CACHE = 500_000
#: Differences counted, and compressed lengths (bytes) that bound the counts.
STEPS, LENGTHS = (1, 2, 3, 4, 5, 6), (11, 12, 13, 15, 1 << 30)
COMPRESSION = {"min_match": 3, "target_length": 999, "search_log": 6, "hash_log": 13, "chain_log": 13, "window_log": 15}
_WORD = re.compile(r"[^\W\d_]+")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def unusual(text: str, common: frozenset) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in common]


def window(word: str) -> bytes:
    w = word.encode()
    return b" %b %b" % (w, w)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary's content; too few samples to train on are its content themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Model:
    """Common words, the two dictionaries and the weights; pickles small."""

    def __init__(self, common: frozenset, ordinary: bytes, toxic: bytes):
        self.common, self.ordinary, self.toxic, self.weights = common, ordinary, toxic, None

    @functools.cached_property
    def _pair(self):
        out = []
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTULTRA, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=False, write_content_size=False, write_dict_id=False, **COMPRESSION
        )
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        return out

    @functools.cached_property
    def _known(self) -> dict[str, tuple[int, int]]:
        return {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_pair", "_known")}

    def features(self, text: str) -> list[float]:
        known = self._known
        grid = [[0] * len(LENGTHS) for _ in STEPS]
        n = 0
        for w in unusual(text, self.common):
            n += 1
            cell = known.get(w)
            if cell is None:
                if len(known) >= CACHE:
                    known.clear()
                plain, toxic = (len(c(window(w))) for c in self._pair)
                cell = known[w] = (sum(plain - toxic >= s for s in STEPS), sum(toxic > m for m in LENGTHS))
            for i in range(cell[0]):
                for j in range(cell[1], len(LENGTHS)):
                    grid[i][j] += 1
        cells = [c for row in grid for c in row]
        return [*[c / max(n, 1) for c in cells], *map(math.log1p, cells), math.log1p(n)]

    def fit(self, rows: list[list[float]], toxic: list[int]) -> None:
        """Logistic regression by Newton's method, with a small ridge and equal weight for the two kinds."""
        x, y = np.array(rows), np.array(toxic, float)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            ridge = 1e-3 * np.r_[0.0, w[1:]]
            hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(hessian, z.T @ (p - y) / len(y) + ridge)
        self.weights = (w[0] - float((w[1:] * mean / scale).sum()), *(w[1:] / scale).tolist())

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        s = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text or ""), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def train(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows."""
    rows = sorted(set((t or "", int(y)) for t, y in rows))
    random.Random(11).shuffle(rows)
    toxic = [t for t, y in rows if y == 1]
    plain = [t for t, y in rows if y == 0]
    if not toxic or not plain:
        return Model(frozenset(), b"", b"")
    half = len(plain) // 2
    seen: Counter = Counter()
    for t in plain[:half]:
        seen.update(set(_WORD.findall(t.lower())))
    common = frozenset(w for w, n in seen.items() if n >= 2)
    # toxic text to train on: its unusual words that several texts share and that ordinary text has not at all
    share = max(1, len(toxic) * 2 // 3)
    marks: Counter = Counter()
    for t in toxic[:share]:
        marks.update(set(unusual(t, common)))
    for t in plain[: half + half // 2]:
        for w in set(unusual(t, common)):
            marks.pop(w, None)
    least = max(2, round(MARK_SHARE * share))
    typical = [[w for w in unusual(t, common) if marks[w] >= least] for t in toxic[:share]]
    model = Model(
        common,
        _dictionary([window(w) for t in plain[half : half + half // 2] for w in unusual(t, common)]),
        _dictionary([window(w) for t in typical for w in t]),
    )
    fit = [(t, 0) for t in plain[half + half // 2 :]] + [(t, 1) for t in toxic[share:]] or rows
    model.fit([model.features(t) for t, _ in fit], [y for _, y in fit])
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The training rows (text, toxic): at most ``TOXIC_ROWS`` + ``ORDINARY_ROWS`` of them."""
    told = labels.select(key, "toxic").where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(key))).distinct()
    ids = []
    for y, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        ids += told.where(F.col("toxic") == y).orderBy(F.xxhash64(key), key).limit(n).collect()
    # bounded by the two sample sizes
    wanted = docs.sparkSession.createDataFrame(ids, told.schema)
    return docs.select(key, text).join(F.broadcast(wanted), key).select(text, "toxic")


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    return [(r[0], r[1]) for r in sample_rows(docs, labels, key, text).collect()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of a corpus. One task trains on the bounded sample, so that the driver gets the model and no texts."""
    ship(docs.sparkSession)

    def run(batches):
        rows = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])

    trained = sample_rows(docs, labels, key, text).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(trained[0][0]) if trained else train([])


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row of ``docs``."""
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches):
        model = pickle.loads(told.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, score double")


def attach(docs: DataFrame, model: Model, text: str = "text", score: str = "_score") -> DataFrame:
    """``docs`` with its rows' scores as a further column."""
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = docs.columns

    def run(batches):
        model = pickle.loads(told.value)
        for b in batches:
            scored = pa.array([model.score(t) for t in b.column(names.index(text)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scored], names=[*names, score])

    return docs.mapInArrow(run, docs.withColumn(score, F.lit(0.0)).schema)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted."""
    out = scores(docs, fit(docs, labels, key, text), key, text)
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
