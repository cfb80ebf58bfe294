"""Alignment of two tokenizers' tokens over the same bytes, and how often ids of both meet in the corpus.

Byte offsets where a token of A and a token of B both end cut a text into groups; tokens that share a group are linked.

1. Tasks gather documents into blocks of ``BLOCK_CHARS``. Texts are cut before white space that follows other characters:
   neither tokenizer has a token across such a place (checked against B's pieces, and a property of A's pattern), so it is
   a common cut, and each distinct piece of a block is encoded once. Ends are running sums of token bytes; the ends that
   both have are the cuts; each token's group is its place among the cuts; links come from repeating tokens of A by the
   tokens of B in their group. Repeated ids of a group are counted, so a group costs its distinct pairs.
2. Each block says in how many of its documents each id pair is linked. These counts are added up per pair and salt, then
   per pair, and each id of A gets its highest count.
3. Counts return to their blocks by pair, and each document's sums are made of its pieces'.

A block is one row of a table in the shared folder; what its task holds is bounded by the block size or one longer text.

Defined cases: a null or empty text, and one whose joined token bytes differ from its own under either tokenizer (as U+2581
does under B), has no tokens: zeros and an empty ``groups_sha256``; repeated rows count as documents each; ties of counts
are all best; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from packsieve.llm.shared import Workspace, settle, small
from packsieve.session import ship

BLOCK_CHARS = 4 << 20
#: Pieces that the libraries get at once, and parts that a pair's counts are added up in first.
CHUNK, SALTS = 4096, 16
#: Pieces whose tokens a task keeps from one block to the next.
MEMO_PIECES = 400_000
CUT = re.compile(r"(?<=\S)(?=[ \n].)", re.DOTALL)
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        place = lambda x: x if os.path.exists(x) else public_tokenizers.path(x)
        self.a = Tokenizer.from_file(place(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(b))
        letters = byte_level()
        size_a = self.a.get_vocab_size()
        words = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w in words]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.table_a, self.table_b = (Table(x) for x in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError(f"{b} has pieces across the places where texts are cut")

    def encode(self, pieces: list[str]):
        """(ids, ids of each piece) of both for pieces of texts that have a space in front already."""
        out = [], [], [], []
        for at in range(0, len(pieces), CHUNK):
            part = pieces[at : at + CHUNK]
            # B puts a space in front itself; one that begins with a line break gets its own token for that space
            got = self.b.encode([p[1:] if p[0] == " " else p for p in part], num_threads=1)
            both = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)], [ids if p[0] == " " else ids[1:] for p, ids in zip(part, got, strict=True)]
            for k, ids in enumerate(both):
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                out[2 * k].append(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum())))
                out[2 * k + 1].append(n)
        return [np.concatenate([*x, np.zeros(0, np.int64 if k % 2 else np.int32)]).astype(np.int64 if k % 2 else np.int32) for k, x in enumerate(out)]


class Memo:
    """Encoded pieces of a task's last blocks, ``MEMO_PIECES`` at most or those of one block."""

    def __init__(self, both: Pair):
        self.both, self.known, self.parts = both, {}, None

    def encode(self, pieces: list[str]):
        known = self.known
        new = [p for p in pieces if p not in known]
        if self.parts is None or len(known) + len(new) > MEMO_PIECES:
            known.clear()
            self.parts, new = None, pieces
        got = self.both.encode(new)
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.parts = got if self.parts is None else [np.concatenate(x) for x in zip(self.parts, got, strict=True)]
        ids_a, n_a, ids_b, n_b = self.parts
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        return ids_a[spread(_heads(n_a)[at], n_a[at])], n_a[at], ids_b[spread(_heads(n_b)[at], n_b[at])], n_b[at]


class Table:
    """Bytes of tokens by id."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.starts = _heads(self.sizes)[:-1]

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.starts[ids], self.sizes[ids])]

    def equal(self, ids: np.ndarray, n: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which pieces have tokens (``ids``, ``n`` a piece) whose bytes are the piece's own (``own``, ``sizes`` a piece)."""
        good = np.diff(_heads(self.sizes[ids])[_heads(n)]) == sizes
        wrong = self.join(ids[np.repeat(good, n)]) != own[np.repeat(good, sizes)]
        if wrong.any():
            good[np.flatnonzero(good)[np.searchsorted(_heads(sizes[good])[1:], np.flatnonzero(wrong), "right")]] = False
        return good


@functools.cache
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def _heads(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... ``sizes[0]`` of them, then those of starts[1]."""
    return np.repeat(starts - _heads(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def groups(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B over the same bytes, and how many groups there are."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)


def _counted(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(group * width + ids, return_counts=True)
    return key // width, key % width, n


def links(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, n_groups: int, width_a: int, width_b: int):
    """(group, pair, times) of all linked id pairs; a pair is the id of A times ``width_b`` plus the id of B."""
    ga, a, times_a = _counted(group_a, ids_a, width_a)
    gb, b, times_b = _counted(group_b, ids_b, width_b)
    per = np.bincount(gb, minlength=n_groups)
    first = _heads(per)[:-1]
    mine = np.repeat(np.arange(len(ga)), per[ga])
    other = spread(first[ga], per[ga])
    return ga[mine], a[mine] * width_b + b[other], times_a[mine] * times_b[other]


class Block:
    """Documents that share one list of distinct pieces."""

    def __init__(self):
        self.keys, self.docs, self.pieces, self.size = [], [], {}, 0

    def add(self, key, text: str | None) -> None:
        self.keys.append(key)
        seen, found = self.pieces, []
        if text:
            found = [seen.setdefault(p, len(seen)) for p in CUT.split(" " + text)]
            self.size += len(text)
        self.docs.append(np.array(found, np.int32))

    def aligned(self, memo: Memo) -> dict:
        both, pieces = memo.both, list(self.pieces)
        own_sizes = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        own = np.frombuffer("".join(pieces).encode(), np.uint8)
        ids_a, n_a, ids_b, n_b = memo.encode(pieces)
        self.pieces = pieces = None
        good = both.table_a.equal(ids_a, n_a, own, own_sizes) & both.table_b.equal(ids_b, n_b, own, own_sizes)
        at, heads_a, heads_b, extra = _heads(own_sizes), _heads(n_a), _heads(n_b), []
        docs = []
        for d in self.docs:
            if not good[d].all():
                whole = own[spread(at[d], own_sizes[d])]
                a, b = ids_a[spread(heads_a[d], n_a[d])], ids_b[spread(heads_b[d], n_b[d])]
                if np.array_equal(both.table_a.join(a), whole) and np.array_equal(both.table_b.join(b), whole):  # its pieces differ, it does not
                    d = np.array([len(n_a) + len(extra)], np.int32)
                    extra.append((a, b))
                else:
                    d = d[:0]
            docs.append(d)
        if extra:
            ids_a, ids_b = np.concatenate([ids_a, *[a for a, _ in extra]]), np.concatenate([ids_b, *[b for _, b in extra]])
            n_a, n_b = np.r_[n_a, [len(a) for a, _ in extra]], np.r_[n_b, [len(b) for _, b in extra]]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat, ends = np.concatenate(docs), _heads(sizes)
        keep = np.unique(flat)  # pieces of the texts that have tokens
        place = np.zeros(len(n_a), np.int32)
        place[keep] = np.arange(len(keep))
        flat, docs = place[flat], [place[d] for d in docs]
        ids_a, ids_b = ids_a[spread(_heads(n_a)[keep], n_a[keep])].astype(np.int64), ids_b[spread(_heads(n_b)[keep], n_b[keep])].astype(np.int64)
        n_a, n_b = n_a[keep], n_b[keep]
        group_a, group_b, n_groups = groups(both.table_a.sizes[ids_a], both.table_b.sizes[ids_b])
        # every piece ends in a common cut, so a group is in one piece
        last = group_a[_heads(n_a)[1:] - 1] + 1 if len(n_a) else np.zeros(0, np.int64)
        first = _heads(np.diff(last, prepend=0))[:-1] if len(last) else last
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        group, pairs, times = links(ids_a, group_a, ids_b, group_b, n_groups, len(both.bytes_a), both.width)
        owner = np.repeat(np.arange(len(keep)), last - first)[group] if len(keep) else group
        distinct, pairs = np.unique(pairs, return_inverse=True)
        key, where = np.unique(owner * max(len(distinct), 1) + pairs, return_inverse=True)
        weight = np.zeros(len(key), np.int64)
        np.add.at(weight, where, times)
        piece_pairs, heads = (key % max(len(distinct), 1)).astype(np.int32), np.searchsorted(key // max(len(distinct), 1), np.arange(len(keep) + 1))
        # in how many documents each pair is linked
        holders, per = np.zeros(len(distinct), np.int64), np.diff(heads)
        held = [np.unique(d, return_counts=True) for d in docs]
        for d, _ in held:
            holders[np.unique(piece_pairs[spread(heads[d], per[d])])] += 1
        shown = _shown(ids_a, ids_b, group_a, group_b, n_a, n_b)
        many = lambda x: np.diff(_heads(x[flat])[ends]).tolist() if len(x) else [0] * len(docs)
        links_of = np.diff(_heads(in_a * in_b)[np.r_[0, last]]) if len(keep) else last
        return {
            "keys": self.keys, "n_a": many(n_a), "n_b": many(n_b), "n_groups": many(last - first), "n_links": many(links_of),
            "groups_sha256": [hashlib.sha256(b";".join([shown[i] for i in d.tolist()])).hexdigest() if len(d) else "" for d in docs],
            "pairs": distinct, "holders": holders,
            "blob": zstandard.compress(pack([np.array([len(d) for d, _ in held]), np.concatenate([d for d, _ in held]), np.concatenate([n for _, n in held]), per, piece_pairs, weight]), 3),
        }


def _shown(ids_a, ids_b, group_a, group_b, n_a, n_b) -> list[bytes]:
    """The groups of each piece as text: ids of A, a bar, ids of B, and a semicolon between groups."""
    if not len(n_a):
        return []
    group, side = np.r_[group_a, group_b], np.r_[np.zeros(len(ids_a), bool), np.ones(len(ids_b), bool)]
    order = np.argsort(2 * group + side, kind="stable")
    ids, group, side = np.r_[ids_a, ids_b][order], group[order], side[order]
    digits = np.ones(len(ids), np.int64)
    for k in range(1, len(str(int(ids.max())))):
        digits += ids >= 10**k
    ends = np.cumsum(digits + 1)  # each id with what follows it
    out = np.full(int(ends[-1]), 44, np.uint8)
    out[ends[:-1] - 1] = np.where(group[1:] != group[:-1], 59, np.where(side[1:] != side[:-1], 124, 44))
    for k in range(int(digits.max())):
        has = digits > k
        out[ends[has] - 2 - k] = 48 + ids[has] // 10**k % 10
    data, stops = out.tobytes(), ends[_heads(n_a + n_b)[1:] - 1].tolist()
    return [data[a : b - 1] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def pack(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.astype(np.int32).tobytes() for x in arrays)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    ends = _heads(np.frombuffer(data, np.int64, n))
    flat = np.frombuffer(data, np.int32, int(ends[-1]), 8 * n).astype(np.int64)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _blocks(a: str, b: str, kind: pa.DataType):
    """Pass 1: a row a block."""

    def run(batches):
        from pyspark import TaskContext

        memo, task, made, block = Memo(pair(a, b)), TaskContext.get().taskAttemptId(), 0, Block()

        def row():
            got = block.aligned(memo)
            kinds = {"keys": kind, **{c: pa.int64() for c in COUNTS}, "groups_sha256": pa.string(), "pairs": pa.int64(), "holders": pa.int64()}
            arrays = [pa.array([got[c]], pa.list_(t)) for c, t in kinds.items()]
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), *arrays, pa.array([got["blob"]], pa.binary())], names=["block", *kinds, "blob"])

        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(key, text)
                if block.size >= BLOCK_CHARS:
                    yield row()
                    made, block = made + 1, Block()
        if block.keys:
            yield row()

    return run


def _sums(key: str, kind: pa.DataType):
    """Pass 3: a block's documents, with its counts by pair."""

    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        out = {c: [] for c in [key, *COUNTS, "n_best", "count_sum", "groups_sha256"]}
        place = np.argsort(np.asarray(counts.column("place")))
        n, best = (np.asarray(counts.column(c))[place] for c in ("n", "best"))
        for r in range(blocks.num_rows):
            sizes, own, times, per, piece_pairs, weight = unpack(zstandard.decompress(blocks.column("blob")[r].as_py()), 6)
            heads, ends = _heads(per), _heads(sizes)
            for name, value in (("n_best", best.astype(np.int64)), ("count_sum", n)):
                of_piece = np.diff(_heads(weight * value[piece_pairs])[heads]) if len(piece_pairs) else np.zeros(len(per), np.int64)
                out[name] += np.diff(_heads(times * of_piece[own])[ends]).tolist() if len(own) else [0] * len(sizes)
            for c in [*COUNTS, "groups_sha256"]:
                out[c] += blocks.column(c)[r].as_py()
            out[key] += blocks.column("keys")[r].as_py()
        kinds = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return run


def pair_counts(blocks: DataFrame, width_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of its A id has more."""
    rows = blocks.select(F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    part = rows.select("salt", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n")).groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    counts = part.groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.withColumn("a", F.floor(F.col("pair") / width_b).cast("int"))


def align(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[DataFrame, DataFrame]:
    """Two tables: per row of ``docs`` (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); and per id pair
    (a, b, n, best), the token map: in how many documents the two are linked, and whether that is the most for ``a``."""
    ship(docs.sparkSession)
    field = docs.select(key).schema[0]
    kind, arrow = field.dataType.simpleString(), to_arrow_type(field.dataType)
    width = pair(a, b).width
    lists = "".join(f", {c} array<long>" for c in COUNTS)
    blocks = docs.select(F.col(key), F.col(text)).mapInArrow(_blocks(a, b, arrow), f"block string, keys array<{kind}>{lists}, groups_sha256 array<string>, pairs array<long>, holders array<long>, blob binary")
    blocks = work.table(blocks, "blocks")
    counts = work.table(pair_counts(blocks, width), "counts")
    most = work.table(counts.groupBy("a").agg(F.max("n").alias("most")), "most")  # at most a row an id
    counts = counts.join(small(most, 16), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts.hint("merge"), "pair").select("block", "place", "n", "best")
    out = f"{key} {kind}, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"]) + ", groups_sha256 string"
    rows = blocks.select(*[F.col(c).alias(c) for c in blocks.columns if c not in ("pairs", "holders")])
    done = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_sums(key, arrow), out)
    return done, counts.select("a", (F.col("pair") % width).cast("int").alias("b"), "n", "best")


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    with Workspace(docs.sparkSession, "align") as work:
        return settle(align(docs, work, key)[0])
