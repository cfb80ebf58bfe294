"""WARC archives: writing, normalising monolithic gzip files, and reading by index.

``write_archives`` writes one archive a task, as crawlers often leave them: the whole file one gzip stream.
``normalise`` inflates each such stream once, in bounded memory, rewrites every record as a gzip member of its own, and
writes a sidecar index of offsets. ``read_archives`` opens members at the offsets of an index.

Files go through ``pyarrow.fs``, so the folder may be any URI it knows. A file's name carries the attempt of its task,
and a stage's files are known by the rows of its table only, so a lost executor's half-written files are never read.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the least page id is a response and the
others are revisits without a payload; smaller ones are responses. The digest is a bare base32 SHA-1 of the payload.

Defined cases: a null payload is empty; a null page id revisits an equal payload that has an id, else is a response;
rows that repeat the least page id and its payload are all responses; an empty table gives no archives; other columns
are ignored. A record is held whole when it is written and read, however long its payload; a task holds one at a time.
Keys that are strings are kept as such.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from packsieve.llm.shared import Workspace, attach_few, settle
from packsieve.session import ship

LEVEL = 4
CHUNK = 1 << 20
CRLF = b"\r\n"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_head(page_id, url: str, kind: str, digest: str, size: int, block: int, refers_to) -> bytes:
    """The header of a record whose block has ``block`` bytes; the payload's own size stays known in a revisit."""
    url = "".join(c for c in url if c >= " ") or "about:blank"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF


def parse_head(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name:
            out[name.lower()] = value.strip()
    return out


def _urn(value: str | None) -> str | None:
    text = (value or "")[len("<urn:page:") : -1]
    return text or None


def plan(pages: DataFrame, work: Workspace, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows with the record type and the page a revisit refers to, found by digest and length."""
    body = F.coalesce(F.col(payload), F.lit(""))
    df = pages.select(F.col(key).alias("id"), F.coalesce(url, F.lit("")).alias("url"), body.alias("body"))
    df = df.withColumns({"digest": F.unhex(F.sha1(F.encode("body", "UTF-8"))), "size": F.octet_length("body").cast("long")})
    # a large group of equal payloads is reduced inside each task before the shuffle
    first = df.groupBy("digest", "size").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    groups = first.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("digest", "first", F.lit(True).alias("shared"), "n")
    groups = work.table(groups, "groups")
    # pages of the largest groups are dealt by their own id, as all bodies of one group would land in one task and archive
    out = attach_few(df, groups, "digest", "id", "n")
    return out.withColumn("revisit", F.coalesce("shared", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first")))


def _writer(folder: str):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        disk, root = _open(folder)
        name = f"raw-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, pack, n = None, None, 0
        for b in batches:
            for page_id, url, body, digest, revisit, first in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if out is None:
                    disk.create_dir(root, recursive=True)
                    out, pack = disk.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                payload = body.encode()
                block = b"" if revisit else payload
                head = record_head(page_id, url, "revisit" if revisit else "response", base64.b32encode(digest).decode(), len(payload), len(block), first)
                for piece in (head, block, CRLF + CRLF):
                    out.write(pack.compress(piece))
                n += 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return run


def write_archives(pages: DataFrame, work: Workspace, folder: str, **names) -> DataFrame:
    """Write one single-stream archive a task; a row (file, records) for each."""
    ship(pages.sparkSession)
    rows = plan(pages, work, **names).select("id", "url", "body", "digest", "revisit", "first")
    return rows.mapInArrow(_writer(folder), "file string, records long")


def _records(chunks):
    """(head, block) of each record in a stream of inflated bytes; holds one record and one chunk at most."""
    data = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        piece = next(chunks, None)
        if piece is None:
            return False
        data.extend(piece)
        return True

    while True:
        at = data.find(CRLF + CRLF)
        while at < 0:
            before = max(0, len(data) - 3)
            if not more():
                if data.strip():
                    raise ValueError("archive ends inside a record's header")
                return
            at = data.find(CRLF + CRLF, before)
        head = bytes(data[:at])
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        size = int(parse_head(head)["content-length"])
        end = at + 4 + size + 4
        while len(data) < end:
            if not more():
                raise ValueError("archive ends inside a record")
        yield head, bytes(data[at + 4 : at + 4 + size])
        del data[:end]


def _inflated(source):
    """Inflate a gzip file, whatever number of members it has, in chunks."""
    unpack = zlib.decompressobj(wbits=31)
    while piece := source.read(CHUNK):
        while piece:
            got = unpack.decompress(piece, CHUNK)
            if got:
                yield got
            if unpack.eof:
                piece = unpack.unused_data
                unpack = zlib.decompressobj(wbits=31)
            else:
                piece = unpack.unconsumed_tail
    rest = unpack.flush()
    if rest:
        yield rest


def _normaliser(folder: str):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        disk, root = _open(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                target = f"{name.removeprefix('raw-').removesuffix('.warc.gz')}-{task.taskAttemptId()}"
                offsets, at = [], 0
                with disk.open_input_stream(f"{root}/{name}", compression=None) as source, disk.open_output_stream(f"{root}/{target}.warc.gz", compression=None) as out, disk.open_output_stream(f"{root}/{target}.idx") as index:
                    for head, block in _records(_inflated(source)):
                        pack = zlib.compressobj(LEVEL, wbits=31)
                        member = pack.compress(head + CRLF + CRLF + block + CRLF + CRLF) + pack.flush()
                        out.write(member)
                        index.write(json.dumps([at, len(member), _urn(parse_head(head).get("warc-record-id"))]).encode() + b"\n")
                        offsets.append(at)
                        at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([f"{target}.warc.gz"]), pa.array([f"{target}.idx"]), pa.array([len(offsets)], pa.int64())], names=["file", "index", "records"])

    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of the table (file, ...) with a member a record; a row (file, index, records) for each."""
    ship(archives.sparkSession)
    spread = archives.select("file").repartition(max(1, archives.count()), "file")
    return spread.mapInArrow(_normaliser(folder), "file string, index string, records long")


def _reader(folder: str, key: str, integer: bool):
    def run(batches):
        disk, root = _open(folder)
        columns = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        number = (lambda x: None if x is None else int(x)) if integer else (lambda x: x)
        kind = pa.int64() if integer else pa.string()
        for b in batches:
            for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = {c: [] for c in columns}
                with disk.open_input_file(f"{root}/{name}") as f, disk.open_input_stream(f"{root}/{index}") as idx:
                    for line in idx.read().splitlines():
                        at, size, _ = json.loads(line)
                        f.seek(at)
                        member = zlib.decompress(f.read(size), wbits=31)
                        cut = member.index(CRLF + CRLF)
                        head = parse_head(member[:cut])
                        block = member[cut + 4 : cut + 4 + int(head["content-length"])]
                        response = head["warc-type"] == "response"
                        told = head["warc-payload-digest"].removeprefix("sha1:")
                        if response and base32_sha1(block) != told:
                            raise ValueError(f"{name} at {at}: payload doesn't match its digest")
                        out["id"].append(number(_urn(head["warc-record-id"])))
                        out["payload_bytes"].append(len(block) if response else int(head["x-payload-length"]))
                        out["payload_digest"].append(told)
                        out["record_type"].append(head["warc-type"])
                        out["refers_to"].append(None if response else number(_urn(head["warc-refers-to"])))
                        if len(out["id"]) == 4096:
                            yield batch(out, kind)
                            out = {c: [] for c in columns}
                if out["id"]:
                    yield batch(out, kind)

    def batch(out, kind):
        kinds = [kind, pa.int64(), pa.string(), pa.string(), kind]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=[key, *list(out)[1:]])

    return run


def read_archives(archives: DataFrame, folder: str, key: str = "page_id", integer: bool = True) -> DataFrame:
    """A row for each record of the normalised archives of the table (file, index, ...)."""
    ship(archives.sparkSession)
    kind = "long" if integer else "string"
    spread = archives.select("file", "index").repartition(max(1, archives.count()), "file")
    return spread.mapInArrow(_reader(folder, key, integer), f"{key} {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def round_trip(pages: DataFrame, key: str = "page_id", **names) -> DataFrame:
    """Write, normalise and read back the archives of ``pages``: a row per row, of what the archives say. Keys are whole
    numbers or strings."""
    with Workspace(pages.sparkSession, "warc") as work:
        folder = f"{work.path}/archives"
        raw = work.table(write_archives(pages, work, folder, key=key, **names), "raw")
        done = work.table(normalise(raw, folder), "done")
        return settle(read_archives(done, folder, key, integer=not isinstance(pages.schema[key].dataType, StringType)))
