"""Tables that are written and read again, in the folder that the session shares.

That is the folder which ``spark.checkpoint.dir`` names; executors and driver both reach it. A folder of our own is set only
where that setting is empty and Spark runs in this machine alone, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder of this session."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="packsieve-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


class Workspace:
    """A run's own folder below the shared one. Use as a context manager to drop it at the end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: a stage boundary that survives lost executors."""
        where = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared folder. Spark removes the copy when the frame is garbage, if the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``; else it stays until the folder is cleared."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
