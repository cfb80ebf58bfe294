"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Three passes, cut by tables in the shared folder:

1. Documents are cut into pre-tokens. Each task gathers documents into blocks of ``BLOCK_BYTES``; a block keeps, per
   document, the sequence of its pre-tokens as places in the block's list of distinct pre-tokens, in a file of its own,
   and deals that list into buckets by hash. A file's name carries the attempt of its task, and only files that the
   pass's table names are read.
2. Buckets are shuffled by number, so that a pre-token meets all its copies from all blocks in one task, which encodes
   it once. A very frequent word costs one entry a block, as every other word of the block does.
3. Encoded lists return to their blocks, where each document's ids are put together by position; the sequences are
   read from the block's file and never shuffled. Decoding looks every
   id up in the token-byte table, which has as many rows as the vocabulary.

White space never joins what precedes it, so runs of white space with the characters after them are cut once a block
and looked up afterwards. What tasks hold is bounded by the block size, the longest document, ``KNOWN_WORDS`` and the
vocabulary.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are each encoded; a document over
the block size is a block of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from packsieve.llm.shared import Workspace, settle
from packsieve.session import ship

BLOCK_BYTES = 32 << 20
#: Words of a bucket that a task keeps encoded; beyond that it starts anew, and words that come again are encoded again.
KNOWN_WORDS = 1_000_000
#: Fixed value: Unicode white space.
_WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


@functools.cache
def vocabulary(ranks_path: str, pattern: str):
    """(tiktoken encoding, token bytes by id) of a rank file."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def load(name: str):
    """A vocabulary by name from the installed package, or by the path of a rank file."""
    import public_tokenizers

    return vocabulary(name if os.path.exists(name) else public_tokenizers.path(name), public_tokenizers.PATTERN)


@functools.cache
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; joined they give the text again."""
    import public_tokenizers

    return _splitter(public_tokenizers.PATTERN).findall(text)


def _pack(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words), 3)


def _unpack(blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [data[a:b] for a, b in zip(starts, ends.tolist(), strict=False)] if n else []


class _Block:
    """Documents whose pre-tokens share one list."""

    def __init__(self):
        self.rows, self.places, self.words, self.units, self.size = [], [], {}, {}, 0

    def add(self, row: int, text: str) -> None:
        units, words = self.units, self.words
        found = []
        for u in _UNIT.findall(text):
            known = units.get(u)
            if known is None:
                known = units[u] = [words.setdefault(p, len(words)) for p in pretokens(u)]
            found += known
        self.rows.append(row)
        self.places.append(np.array(found, np.int32))
        self.size += len(text)


def _blocks(folder: str, buckets: int):
    """Pass 1: rows (block, bucket, n, blob), a bucket's share of a block's words; and the file of each block."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        disk, root = pafs.FileSystem.from_uri(folder)
        made = 0

        def emit(block, keys):
            nonlocal made
            name = f"{task}-{made}"
            made += 1
            sizes = np.fromiter(map(len, block.places), np.int32, len(block.places))
            blob = zstandard.compress(sizes.tobytes() + np.concatenate(block.places).tobytes(), 6)
            disk.create_dir(root, recursive=True)
            whole = pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(kind)), pa.array([blob], pa.binary())], names=["keys", "blob"])
            with disk.open_output_stream(f"{root}/{name}") as f, pa.ipc.new_stream(f, whole.schema) as out:
                out.write_batch(whole)
            words = [w.encode() for w in block.words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                share = order[cuts[k] : cuts[k + 1]]
                if len(share) or not k:  # a block without words has a row too
                    yield name, k, len(share), share.astype(np.int32).tobytes() + _pack([words[i] for i in share])

        def rows(keys, texts):
            nonlocal block, kept
            for key, text in zip(keys, texts, strict=True):
                block.add(len(kept), text or "")
                kept.append(key)
                if block.size >= BLOCK_BYTES:
                    done, names, block, kept = block, kept, _Block(), []
                    yield from emit(done, names)

        def frame(parts):
            name, bucket, n, blob = (list(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], names=["block", "bucket", "n", "blob"])

        block, kept, kind = _Block(), [], pa.int64()
        for b in batches:
            kind = b.column(0).type
            for parts in _grouped(rows(b.column(0).to_pylist(), b.column(1).to_pylist())):
                yield frame(parts)
        if kept:
            for parts in _grouped(emit(block, kept)):
                yield frame(parts)

    return run


def _grouped(rows, most: int = 64):
    parts = []
    for x in rows:
        parts.append(x)
        if len(parts) == most:
            yield parts
            parts = []
    if parts:
        yield parts


def _encoder(vocab: str):
    """Pass 2: within a bucket, words of all blocks to ids, each word once."""

    def run(batches):
        encoding, _ = load(vocab)
        one = encoding._encode_single_piece
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            out = []
            for n, blob in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                places, words = blob[: 4 * n], _unpack(blob[4 * n :])
                ids = []
                for w in words:
                    x = known.get(w)
                    if x is None:
                        x = known[w] = one(w)
                    ids.append(x)
                sizes = np.fromiter(map(len, ids), np.uint32, n)
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                out.append(zstandard.compress(places + sizes.tobytes() + flat.tobytes(), 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["block", "bucket", "n", "blob"])

    return run


def _assemble(folder: str, vocab: str, key: str, kind: pa.DataType, ids_too: bool):
    """Pass 3: a block's encoded words, with its file, to ids, digests and decoded bytes."""

    def run(lists: pa.Table) -> pa.Table:
        _, table = load(vocab)
        total = sum(lists.column("n").to_pylist())
        shown, back, count = [""] * total, [b""] * total, np.zeros(total, np.int64)
        found: list = [()] * total if ids_too else []
        for n, blob in zip(lists.column("n").to_pylist(), lists.column("blob").to_pylist(), strict=True):
            data = np.frombuffer(zstandard.decompress(blob), np.uint32)
            places, sizes = data[:n], data[n : 2 * n]
            count[places] = sizes
            ids, at = data[2 * n :].tolist(), 0
            for p, size in zip(places.tolist(), sizes.tolist(), strict=True):
                own = ids[at : at + size]
                at += size
                shown[p] = " ".join(map(str, own))
                back[p] = b"".join([table[i] for i in own])
                if ids_too:
                    found[p] = own
        disk, root = pafs.FileSystem.from_uri(folder)
        with disk.open_input_stream(f"{root}/{lists.column('block')[0].as_py()}") as f:
            whole = pa.ipc.open_stream(f).read_next_batch()
        keys = whole.column(0)[0].as_py()
        data = np.frombuffer(zstandard.decompress(whole.column(1)[0].as_py()), np.int32)
        sizes, body, at = data[: len(keys)], data[len(keys) :], 0
        out = {k: [] for k in ("n", "sha", "decoded", "ids")}
        for size in sizes.tolist():
            seq = body[at : at + size]
            at += size
            places = seq.tolist()
            out["n"].append(int(count[seq].sum()))
            out["sha"].append(hashlib.sha256(" ".join([shown[p] for p in places]).encode()).hexdigest())
            out["decoded"].append(hashlib.sha256(b"".join([back[p] for p in places])).hexdigest())
            if ids_too:
                out["ids"].append(np.fromiter((i for p in places for i in found[p]), np.int32, out["n"][-1]))
        columns = {key: pa.array(keys, kind), "n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["sha"], pa.string()), "decoded_sha256": pa.array(out["decoded"], pa.string())}
        if ids_too:
            ends = np.r_[0, np.cumsum(out["n"])].astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*out["ids"], np.zeros(0, np.int32)])))
        return pa.table(columns)

    return run


def encode(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", vocab: str = "byte_bpe_50k.tiktoken", ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``decoded_sha256`` is of the bytes that the token-byte table gives for the ids.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    field = docs.select(F.col(key)).schema[0]
    kind = field.dataType.simpleString()
    folder = f"{work.path}/block-files"
    shares = docs.select(F.col(key), F.col(text)).mapInArrow(_blocks(folder, buckets), "block string, bucket int, n int, blob binary")
    shares = work.table(shares, "shares").repartition(buckets, "bucket")
    coded = shares.mapInArrow(_encoder(vocab), "block string, bucket int, n int, blob binary")
    out = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    arrow = to_arrow_type(field.dataType)
    return coded.groupBy("block").applyInArrow(_assemble(folder, vocab, key, arrow, ids), out)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    with Workspace(docs.sparkSession, "bpe") as work:
        return settle(encode(docs, work, key, text, vocab))
