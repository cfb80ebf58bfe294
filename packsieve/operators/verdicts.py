"""Verdict tables with a time to live and a size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packsieve.store import settle


def live(verdicts: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    return verdicts.where(F.col(expires) >= F.lit(now))


def evict_oldest(entries: DataFrame, max_size: int, size: str = "size", modified: str = "modified", shard: str = "shard", tie: str = "key") -> DataFrame:
    """What stays when each shard drops its oldest entries until it fits ``max_size``."""
    newest = Window.partitionBy(shard).orderBy(F.desc(modified), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("_held", F.sum(size).over(newest)).where(F.col("_held") <= max_size).drop("_held")


def evict_oldest_of_all(entries: DataFrame, max_size: int, size: str = "size", modified: str = "modified", tie: str = "key") -> DataFrame:
    """What stays when the whole table drops its oldest entries until it fits ``max_size``: the rows that one running total
    over all, newest first and then by ``tie``, keeps, without one task for all.

    Rows are dealt by range, newest first, and kept so. Each part's total gives the part where it starts; a part that starts
    beyond the limit goes as a whole, and the running total is taken inside the others. Null sizes count as 0; rows of
    equal ``modified`` are split by ``tie``, which should tell rows apart.
    """
    own = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(entries.repartitionByRange(parts, F.desc(modified), F.col(tie)).withColumns({"_part": F.spark_partition_id(), "_own": own}))
    totals = dealt.groupBy("_part").agg(F.sum("_own").alias("_total"))  # a row a part
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_part", before.alias("_before")).where(F.col("_before") <= max_size)
    newest = Window.partitionBy("_part").orderBy(F.desc(modified), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = dealt.join(F.broadcast(starts), "_part").withColumn("_held", F.col("_before") + F.sum("_own").over(newest))  # a row a part
    return held.where(F.col("_held") <= max_size).select(entries.columns)
