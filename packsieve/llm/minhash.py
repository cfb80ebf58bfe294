"""Near-duplicate documents by circulant MinHash, banding and exact confirmation.

A shingle's hash goes through one permutation of 32 bits; a second permutation, shifted circularly by k, gives
coordinate k of the signature. Bands of ``ROWS`` coordinates are bucket keys: with ``BANDS`` bands a pair of similarity
0.85 shares no bucket with probability 4e-7; 40 bands do as much at 0.8.

Documents with equal shingle sets are one class, known by the digest of the set and linked at once. The classes of a
bucket are compared without a table of their pairs, and yet none of the links that join components is lost:

1. Each member is compared with the bucket's pivot, its member of least digest, by the exact intersection of the two
   sets. The pivot has been compared with everything then. Pairs repeat over bands and are compared once.
2. Members linked to the pivot form its component. A member outside of it at Jaccard distance d from the pivot can only
   be linked to members at a distance of ``d - (1 - threshold)`` or more, as the distance is a metric. Members that no
   outsider can reach are done; in a large group of copies these are all but a few.
3. What is left of a bucket, if it still lies in several components, is compared in full in tasks of bounded size, as
   products of 0/1 matrices; a task gives at most one link a member.

Bands are worked through in a few phases, and a phase takes only buckets whose members still lie in several components.
A pivot of many pairs is salted; light joins by bucket are left to adaptive skew handling.

Defined cases: a null text, or one without words, has an empty set and links with nothing, its component is its own id;
a row with a null id belongs to the component of its class, whose id is the least id there, null if there is none; rows
that share an id may have different texts, each is linked as its own text is; repeated rows repeat; a set is held whole
however long the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsieve.llm.graph import components
from packsieve.llm.kernel import mix, shingle_sets
from packsieve.llm.shared import Workspace, settle
from packsieve.session import ship

BANDS, ROWS = 25, 5
#: Phases end at these bands, and at the last one.
PHASES = (2, 8)
#: Members and shingles of what is left of a bucket that make a block; a task compares two blocks at most.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 19
#: Cells of a matrix held at once.
COLUMNS = 1 << 22
#: A pivot of more pairs is salted, into parts of so many. At most HOT_PIVOTS are, as the limit follows their number.
PAIRS_A_SALT, HOT_PIVOTS = 2000, 1000
TEXTS_A_BATCH = 256


def _permute(x: np.ndarray, m1: int, m2: int) -> np.ndarray:
    """A bijection of 32 bits, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(m1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(m2)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes: the k-th coordinate is the least pi(sigma(x) + k)."""
    x = _permute((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, _permute(x[None, at : at + 512] + shift, 0x21F0AAAD, 0x735A2D97).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h += rows[:, k]
        mix(h)
    return h.view(np.int64)


def _in_parts(batches, size: int = TEXTS_A_BATCH):
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _signed(width: int, n_bands: int):
    def run(batches):
        for b in _in_parts(batches):
            digest, n, bands = [], [], []
            for s in shingle_sets(b.column(2), width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s, n_bands * ROWS)) if len(s) else None)
            arrays = [b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "t", "digest", "n", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        for b in _in_parts(batches):
            sets = [s.view(np.int64) for s in shingle_sets(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["c", "set"])

    return run


def _linked(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links, as pairs of places, that join exactly the sets that are joined by 100 * intersection >= threshold * union."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.int64)
    width = max(1, COLUMNS // max(n, 1))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        # the counts of one product are below 2**24, which a float32 holds exactly
        both += (part @ part.T).astype(np.int64)
    similar = (100 + threshold) * both >= threshold * (sizes[:, None] + sizes[None, :])
    out, left = [], np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start], edge = False, [start]
        while edge:
            i = edge.pop()
            for j in np.flatnonzero(similar[i] & left).tolist():
                left[j] = False
                out.append((i, j))
                edge.append(j)
    return out


def _bucket_links(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        sets = [np.asarray(x.values).view(np.uint64) for c in group.column("set").chunks for x in c]
        ids = group.column("c").to_pylist()
        links = _linked(sets, threshold)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.binary()), "b": pa.array([ids[j] for _, j in links], pa.binary())})

    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The intersection size of each pair (c, n, p, pn), as (c, n, p, pn, both)."""
    total = pairs.count()
    limit = max(PAIRS_A_SALT, total // HOT_PIVOTS)
    # pivots over the limit: HOT_PIVOTS at most, whatever the table's size
    hot = pairs.groupBy("p").count().where(F.col("count") > limit).select("p", F.ceil(F.col("count") / PAIRS_A_SALT).cast("int").alias("k"))
    hot = F.broadcast(hot)
    salted = pairs.join(hot, "p", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("c"), F.col("k")), F.lit(0)).cast("int")).drop("k")
    pivots = sets.join(pairs.select("p").distinct().hint("merge"), F.col("c") == F.col("p"), "left_semi").select(F.col("c").alias("p"), F.col("set").alias("pset"))
    pivots = pivots.join(hot, "p", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    both = salted.join(sets.hint("merge"), "c").join(pivots.hint("merge"), ["p", "salt"])
    return both.select("c", "n", "p", "pn", F.size(F.array_intersect("set", "pset")).cast("long").alias("both"))


def _rest(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links among all ``members`` (bucket, c, n) of each bucket, as (a, b)."""
    k = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = members.groupBy("bucket").agg(k.alias("k"))
    placed = members.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    tasks = placed.select("c", "bucket", F.explode(others).alias("t")).select("c", "bucket", "t.i", "t.j")
    return tasks.join(sets.hint("merge"), "c").groupBy("bucket", "i", "j").applyInArrow(_bucket_links(threshold), "a binary, b binary")


class _Components:
    """Components of classes; links that come later join what there is."""

    def __init__(self, work: Workspace):
        self.work, self.labels, self.n = work, None, 0

    def of(self, df: DataFrame) -> DataFrame:
        """``df`` with the component of its column c as ``comp``."""
        if self.labels is None:
            return df.withColumn("comp", F.col("c"))
        return df.join(self.labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))

    def add(self, links: DataFrame) -> None:
        """Take in links (a, b), stated in classes."""
        self.n += 1
        if self.labels is not None:
            for end in ("a", "b"):
                links = links.join(self.labels.withColumnRenamed("c", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
        links = self.work.table(links.where("a != b").distinct(), f"links{self.n}")
        if links.isEmpty():
            return
        with Workspace(self.work.spark, "minhash-labels") as temporary:
            new = components(links, temporary).select(F.col("id").alias("old"), F.col("comp").alias("new"))
            if self.labels is None:
                out = new.select(F.col("old").alias("c"), F.col("new").alias("comp"))
            else:
                moved = self.labels.join(new, F.col("comp") == F.col("old"), "left").select("c", F.coalesce("new", "comp").alias("comp"))
                out = moved.unionByName(new.select(F.col("old").alias("c"), F.col("new").alias("comp")).join(self.labels, "c", "left_anti"))
            self.labels = self.work.table(out, f"comps{self.n}")


def _open(told: DataFrame, comps: _Components) -> DataFrame:
    """Rows (bucket, c, n, comp) of buckets that lie in several components, with their pivot (p, pn, pcomp)."""
    told = comps.of(told.select("bucket", "c", "n"))
    pivot = F.min(F.struct("c", "n", "comp")).alias("pivot")
    state = told.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot).where("lo != hi")
    state = state.select("bucket", F.col("pivot.c").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.comp").alias("pcomp"))
    return told.join(state, "bucket").where("c != p")


def _left(rows: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Members (bucket, c, n) that the comparison with the pivot has not settled, from rows of ``_open``."""
    rows = rows.join(known.select("c", "p", "both"), ["c", "p"], "left")
    # a pair that wasn't compared differs too much in size: that bounds its distance from below
    size = F.least("n", "pn") / F.greatest("n", "pn")
    rows = rows.withColumn("far", 1 - F.coalesce(F.col("both") / (F.col("n") + F.col("pn") - F.col("both")), size)).withColumn("out", F.col("comp") != F.col("pcomp"))
    near = rows.where("out").groupBy("bucket").agg(F.min("far").alias("near"))
    rows = rows.join(near, "bucket").where(F.col("out") | (F.col("far") >= F.col("near") - (1 - threshold / 100) - 1e-9))
    several = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    return rows.join(several, "bucket", "left_semi").select("bucket", "c", "n")


def near_duplicates(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", width: int = 3, threshold: int = 85, bands: int = BANDS) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``; ``threshold`` is a similarity in percent."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = work.table(texts.mapInArrow(_signed(width, bands), f"id {kind}, t long, digest binary, n long, bands array<long>"), "signed")
    one = F.min(F.struct("t", "id")).alias("one")
    classes = signed.where("digest is not null").groupBy(F.col("digest").alias("c")).agg(one, F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("id").alias("least"))
    classes = work.table(classes, "classes")
    # rows (band, bucket, c, n) of buckets with two classes or more
    rows = classes.select("c", "n", F.posexplode("bands").alias("band", "bucket"))
    crowd = rows.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("bucket")
    shared = work.table(rows.join(crowd, "bucket"), "shared")
    needed = classes.join(shared.select("c").distinct().hint("merge"), "c", "left_semi").select("c", "one.*").hint("merge")
    wanted = texts.join(needed.withColumnRenamed("id", "of"), (texts["t"] == needed["t"]) & texts["id"].eqNullSafe(F.col("of")))
    sets = work.table(wanted.select("c", "text").mapInArrow(_sets(width), "c binary, set array<long>").dropDuplicates(["c"]), "sets")
    comps, known = _Components(work), None
    ends = sorted({min(e, bands) for e in PHASES} | {bands})
    for phase, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)):
        told = shared.where(f"band >= {lo} and band < {hi}")
        pairs = _open(told, comps).select("c", "n", "p", "pn").where(100 * F.least("n", "pn") >= threshold * F.greatest("n", "pn")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("c", "p").hint("merge"), ["c", "p"], "left_anti")
        pairs = work.table(pairs, f"pairs{phase}")
        found = work.table(_compared(pairs, sets), f"compared{phase}")
        known = found if known is None else known.unionByName(found)
        comps.add(found.where((100 + threshold) * F.col("both") >= threshold * (F.col("n") + F.col("pn"))).select(F.col("c").alias("a"), F.col("p").alias("b")))
        comps.add(_rest(_left(_open(told, comps), known, threshold), sets, threshold))
    named = comps.of(classes.select("c", "least")).select("c", "comp", "least")
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    named = named.join(least, "comp").select(F.col("c").alias("digest"), "component")
    out = signed.select("id", "digest", "n").join(named, "digest", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, threshold: int = 85) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id and kept (the least id of its component; a row with a
    null id only if no row of its component has an id)."""
    with Workspace(docs.sparkSession, "minhash") as work:
        out = near_duplicates(docs, work, key, text, width, threshold)
        return settle(out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))
