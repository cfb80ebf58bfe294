"""What keyed state in this package needs of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that has single values and times to live is kept by the RocksDB store: on the executors' disks, with its changes
    and snapshots below the query's checkpoint location, from which it is restored."""
    spark.conf.set(PROVIDER, ROCKSDB)
