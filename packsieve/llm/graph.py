"""Connected components of a link table, by label propagation with pointer jumping over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsieve.llm.shared import Workspace


def components(links: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) of every id in ``links``; comp is the least id that can be reached.

    Each round costs two joins over the links and halves the distance at least; stars take two rounds. Repeated links
    and links of an id to itself change nothing; no links give no rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = work.table(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = work.table(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")), "labels0")
    n = 0
    while True:
        n += 1
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        low = labels.join(near, "u").select("u", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        jump = labels.select(F.col("u").alias("low"), F.col("comp").alias("next"))
        new = low.join(jump, "low").select("u", F.least("low", "next").alias("comp"), F.col("was"))
        new = work.table(new, f"labels{n}")
        if new.where("comp != was").limit(1).count() == 0:
            return new.select(F.col("u").alias("id"), "comp")
        labels = new.select("u", "comp")
