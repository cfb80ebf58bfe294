"""Dumps, stored baselines, eviction over a whole table, and rules on functions and variables."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from packsieve.operators import catalog, provenance, scan, verdicts
from packsieve.sources import baseline, dumps


def test_dumps(spark, tmp_path):
    dumps.register(spark)
    row = lambda n, **x: {"Name": n, "Version": "1", "PackageBase": n, **x}
    (tmp_path / "a.json").write_text(json.dumps([row("a", Depends=["x>=1"], NumVotes=3, Popularity=0.5), row("b", Maintainer=None)]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.jsonl.gz").write_bytes(gzip.compress("\n".join(json.dumps(row(f"c{k}")) for k in range(5000)).encode()))
    (tmp_path / "readme.txt").write_text("no dump")
    df = spark.read.format("package_dumps").load(str(tmp_path))
    assert df.count() == 5002 and df.rdd.getNumPartitions() == 2
    a = df.where("name = 'a'").first()
    assert (a.depends, a.makedepends, a.votes, a.popularity, a.maintainer) == (["x>=1"], [], 3, 0.5, None)
    few = df.where(F.col("name").isin("c7", "b", "unknown")).select("name", "package_base")
    assert sorted(r.name for r in few.collect()) == ["b", "c7"]
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan(few) and "Filter (" in plan(df.where("votes > 5"))  # the reader took the names: no filter is left above it
    assert df.where("name = 'a' and votes > 5").count() == 0 and df.where("name = 'a' or votes > 2").count() == 1
    (tmp_path / "bad.jsonl").write_text('{"Name": "d"}\n{broken\n["Name"]\n')
    with pytest.raises(Exception, match="no package"):
        spark.read.format("package_dumps").load(str(tmp_path)).count()
    assert spark.read.format("package_dumps").option("mode", "DROPMALFORMED").load(str(tmp_path)).where("name < 'c' or name = 'd'").count() == 3
    (tmp_path / "none").mkdir()
    assert spark.read.format("package_dumps").load(str(tmp_path / "none")).count() == 0


def test_stored_baseline(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame([(p, "pkgbuild", "PKGBUILD", t) for p, t in rows], "pkg_id string, file_type string, file string, content string")
    path, see = f"{tmp_path}/state", lambda at, *rows: provenance.snapshots(files(*rows), F.lit(at))
    assert baseline.load(spark, path)[0].count() == 0
    assert baseline.update(see("1", ("p", "make"), ("q", "eval x")), path)
    first = baseline.current(spark, path)
    assert not baseline.update(see("2", ("p", "make")), path) and baseline.current(spark, path) == first  # nothing new: nothing written
    broken = see("3", ("p", "curl x")).withColumn("markers", F.when(F.lit(True), F.raise_error(F.lit("lost"))).otherwise(F.col("markers")))
    with pytest.raises(Exception, match="lost"):
        baseline.update(broken, path)
    assert baseline.current(spark, path) == first and {r.package: r.last_seen for r in baseline.load(spark, path)[0].collect()} == {"p": "1", "q": "1"}
    assert baseline.update(see("4", ("p", "curl x")), path) and baseline.update(see("5", ("r", "make")), path)
    assert {r.package: (r.markers, r.last_seen) for r in baseline.load(spark, path)[0].collect()} == {"p": (["curl-net"], "4"), "q": (["eval"], "1"), "r": ([], "5")}
    kept = {p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("state-")}
    assert len(kept) == 2 and first not in kept and baseline.current(spark, path) in kept
    spark.createDataFrame([("z", "{no json")], baseline.RECORD_TYPE).write.mode("append").parquet(f"{path}/{baseline.current(spark, path)}")
    assert [(r.package, r.record) for r in baseline.quarantine(spark, path).collect()] == [("z", "{no json")]


@pytest.mark.parametrize("limit", [0, 300, 2500, 10**6])
def test_evict_oldest_of_all(spark, limit):
    rng = random.Random(limit)
    rows = [(k, rng.choice([0, 1, 5, 40, None]), rng.choice([7, 7, 7, rng.randrange(50)]), "x") for k in range(400)]
    df = spark.createDataFrame(rows, "key int, size int, modified int, _before string").withColumnRenamed("_before", "note")
    total, want = 0, set()
    for k, size, _, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        total += size or 0
        if total <= limit:
            want.add(k)
    got = verdicts.evict_oldest_of_all(df, limit)
    assert {r.key for r in got.collect()} == want and got.columns == df.columns
    assert verdicts.evict_oldest_of_all(df.limit(0), limit).count() == 0


def test_rules_on_functions_and_variables(spark):
    I = catalog.Inert  # noqa: E741
    rule = lambda i, files, *p, **x: catalog.Rule(i, "high", "persistence", files, None, i, p, **x)
    rules = [
        rule("F", "P", I("function", "^build$", r"MAKE\s+all")), rule("G", "PI", I("function", "^p")), rule("H", "I", I("function", "post_install", "npm")), rule("V", "PI", "unrelated", I("variable", "_url", "evil")), rule("W", "P", I("variable", "_URL")),
        rule("C", "P", I("function", "^BUILD$"), case_sensitive=True), rule("OFF", "P", I("function", "."), enabled=False), rule("X", "I", I("variable", "_url")),
    ]
    recipe = "pkgname=p\npkgver=1\npkgrel=1\n_url=http://EVIL.example\nbuild() {\n  # make none\n  echo 'make install'\n  make all\n}\npackage() {\n  # npm\n  make install\n}\n"
    hook = "post_install() {\n  npm install x\n}\npre_remove() {\n  true\n}\n"
    files = spark.createDataFrame([("p", "pkgbuild", "PKGBUILD", recipe), ("p", "install_script", "p.install", hook)], "pkg_id string, file_type string, file string, content string")
    ctx = scan.Context(files, rules=rules)
    got = sorted((r.id, r.file, r.line or 0, r.snippet, r.pat_idx) for r in scan.structure_matches(ctx.bodies, ctx.packages, rules).collect())
    assert got == [("F", "PKGBUILD", 5, "build", 0), ("G", "PKGBUILD", 10, "package", 0), ("G", "p.install", 1, "post_install", 0), ("G", "p.install", 4, "pre_remove", 0), ("H", "p.install", 1, "post_install", 0), ("V", "PKGBUILD", 0, "_url", 1)]
    assert {r.id for r in scan.findings(ctx, structures=True).collect()} >= {"F", "G", "H", "V"} and "F" not in {r.id for r in scan.findings(ctx).collect()}
    assert scan.structure_matches(ctx.bodies, ctx.packages, catalog.RULES).count() == 0
