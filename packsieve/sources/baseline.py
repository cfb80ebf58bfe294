"""The stored baseline of provenance: a table under a manifest that is swapped last.

Below a folder, ``state-<id>`` are tables of (package, record) and ``_current`` is a file with the name of the one that
holds. A new state is written whole before the file is replaced by a rename, so a reader sees the old state or the new one,
and a job that fails on the way leaves the old. The state before the last is kept for readers that are still at it. Of
two writers at once the one that ends last wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.operators import provenance

MANIFEST, RECORD_TYPE = "_current", "package string, record string"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the table that holds, None before the first."""
    hadoop, fs = _fs(spark, path)
    at = hadoop.Path(f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(state, rows that can't be read) as ``provenance.known_state`` has them; both empty before the first write."""
    name = current(spark, path)
    raw = spark.read.schema(RECORD_TYPE).parquet(f"{path}/{name}") if name else spark.createDataFrame([], RECORD_TYPE)
    return provenance.known_state(raw)


def _point_to(spark: SparkSession, path: str, name: str) -> None:
    hadoop, fs = _fs(spark, path)
    new = hadoop.Path(f"{path}/{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(name.encode())
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(hadoop.Path(f"{path}/{MANIFEST}")), how)


def save(state: DataFrame, path: str) -> str:
    """Write a state and make it the one that holds. Returns its name."""
    spark = state.sparkSession
    was, name = current(spark, path), f"state-{uuid.uuid4().hex}"
    provenance.stored(state).write.parquet(f"{path}/{name}")
    _point_to(spark, path, name)
    hadoop, fs = _fs(spark, path)
    for s in fs.listStatus(hadoop.Path(path)):
        old = s.getPath().getName()
        if old.startswith("state-") and old not in (name, was):
            fs.delete(s.getPath(), True)
    return name


def update(snapshots: DataFrame, path: str) -> bool:
    """Bring a stored baseline up to what a scan saw (``provenance.snapshots``); whether anything had changed. Nothing is
    written where every package is known with its digest."""
    spark = snapshots.sparkSession
    state, _ = load(spark, path)
    fresh = snapshots.select("package", "digest").join(state.select("package", "digest"), ["package", "digest"], "left_anti")
    if fresh.isEmpty():
        return False
    save(provenance.next_state(snapshots, state), path)
    return True


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """What could not be read of the state that holds, with its table's name."""
    return load(spark, path)[1].withColumn("state", F.lit(current(spark, path)))
