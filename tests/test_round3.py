"""What the findings of round 3 told: queries against their SQL on small tables that the given ones don't resemble."""

import datetime
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from packsieve.operators import graph, metadata
from packsieve.plans import queries as plans
from packsieve.store import settle


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over ``tables`` (name: columns and rows), counted."""
    db = duckdb.connect()
    for t, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return Counter(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).collect())), Counter(db.execute(plans.ORACLES[name]).fetchall())


def test_lookup_quota_takes_the_nearest_second(spark, tmp_path):
    """Times in fractions: 59.7 s belongs to the next minute, 0.5 and 1.5 s go to the even second."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(k, at(s)) for k, s in enumerate([0.0, 0.2, 0.5, 1.5, 1.2, 59.7, 59.4, 60.1, 60.2, 60.3, 61.0, 86399.6])]
    got, want = both(spark, tmp_path, "lookup_quota", events=("event_id long, ts timestamp_ntz", rows))
    assert got == want and 0 < len(want) < len(rows)


def test_base_fanout_is_whole(spark, tmp_path, monkeypatch):
    """Every name of a base gets each scan of it, also of bases whose names are dealt to several blocks."""
    monkeypatch.setattr(metadata, "NAMES_A_BLOCK", 2)
    orders, parts = [(97 * k,) for k in range(60)] + [(5,)], [(k,) for k in range(1, 400)]
    got, want = both(spark, tmp_path, "base_fanout", orders=("o_orderkey long", orders), part=("p_partkey long", parts))
    assert got == want == Counter((o, p) for (o,) in orders for (p,) in parts if o % 97 == 0 and o % 50 == p % 50)


def test_graph_tables_are_not_broadcast(spark, monkeypatch):
    """A table that is joined level after level would pass the driver as often."""
    plans_seen = []

    def keep(df, run=settle):
        out = run(df)
        plans_seen.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return out

    monkeypatch.setattr(graph, "settle", keep)
    n = spark.range(1, 200).select(F.col("id").alias("n"))
    edges = n.select(F.col("n").alias("parent"), F.floor(F.col("n") / 2).alias("child")).where("child > 0")
    roots = n.where("n % 50 = 49").select(F.col("n").alias("root"))
    found = graph.closures(edges, roots, 9, 50, n.where("n % 7 = 3").select(F.col("n").alias("name")))
    one = graph.closure(edges, roots, 9, None)
    info = n.select(F.col("n").alias("name"), F.lit("x").alias("maintainer"))
    for df in (graph.order(found, edges), graph.truncated(one, edges), graph.annotate(one, info, edges.withColumn("kind", F.lit("runtime")))):
        keep(df, lambda x: x.collect())
    assert len(plans_seen) > 20 and not [p for p in plans_seen if "Broadcast" in p.split("== Initial Plan")[0]]
