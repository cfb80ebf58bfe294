"""Package metadata from dumps at rest, as a data source: ``spark.read.format("package_dumps").load(folder)``.

Files are JSON, an object a line or one array, plain or gzip; each is a partition. A condition on names goes to the reader,
which then builds rows of these names only. Names that no file has are absent. An array is read whole, so one of over
``MAX_BODY`` bytes is refused; lines are read one by one. A line or object that is no package is an error, or with the
option ``mode`` = ``DROPMALFORMED`` left out. Missing fields are null, missing lists empty.
"""

from __future__ import annotations

import gzip
import io
import json
import re

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

MAX_BODY, ROWS = 16 << 20, 2000
SCHEMA = (
    "name string, version string, package_base string, description string, maintainer string, votes int, popularity double, out_of_date long, first_submitted long, last_modified long, "
    "depends array<string>, makedepends array<string>, checkdepends array<string>, optdepends array<string>, provides array<string>"
)
#: What a dump calls the columns, in order.
FIELDS = ["Name", "Version", "PackageBase", "Description", "Maintainer", "NumVotes", "Popularity", "OutOfDate", "FirstSubmitted", "LastModified", "Depends", "MakeDepends", "CheckDepends", "OptDepends", "Provides"]


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.kind, self.options, self.names = schema, options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                asked = {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                asked = set(f.value)
            else:
                yield f
                continue
            self.names = asked if self.names is None else self.names & asked

    def _place(self):
        path = self.options["path"]
        return pafs.FileSystem.from_uri(path) if re.match("[a-z0-9+.-]+:", path) else (pafs.LocalFileSystem(), path)

    def partitions(self):
        disk, root = self._place()
        told = disk.get_file_info(root)
        found = disk.get_file_info(pafs.FileSelector(root, recursive=True)) if told.type == pafs.FileType.Directory else [told]
        return [File(f.path) for f in found if f.type == pafs.FileType.File and re.search(r"\.jsonl?(\.gz)?\Z", f.base_name)] or [File("")]

    def _objects(self, path: str):
        with self._place()[0].open_input_stream(path, compression=None) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)
            if stream.peek(1)[:1] == b"[":
                body = stream.read(MAX_BODY + 1)
                if len(body) > MAX_BODY:
                    raise ValueError(f"{path}: an array of over {MAX_BODY} bytes")
                yield from json.loads(body)
                return
            for line in stream:
                if line.strip():
                    try:
                        yield json.loads(line)
                    except ValueError:
                        yield line.decode(errors="replace")

    def read(self, partition):
        if not partition.path:
            return
        arrow, drop = to_arrow_schema(self.kind), str(self.options.get("mode", "")).upper() == "DROPMALFORMED"
        lists = [isinstance(f.dataType, ArrayType) for f in self.kind]
        rows = []
        for x in self._objects(partition.path):
            if not isinstance(x, dict) or not isinstance(x.get("Name"), str):
                if drop:
                    continue
                raise ValueError(f"{partition.path}: no package: {str(x)[:80]}")
            if self.names is not None and x["Name"] not in self.names:
                continue
            rows.append([x.get(k) or [] if many else x.get(k) for k, many in zip(FIELDS, lists, strict=True)])
            if len(rows) == ROWS:
                yield self._batch(rows, arrow)
                rows = []
        if rows:
            yield self._batch(rows, arrow)

    @staticmethod
    def _batch(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


class PackageDumps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_dumps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it hand conditions to readers."""
    from packsieve.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageDumps)
