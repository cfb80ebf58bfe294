"""What the findings on time at size told: work is dealt out, parses make what is asked for, gates lose nothing."""

from packsieve.operators import scan
from packsieve.plans import queries as plans


def test_function_rules_deal_a_short_table_and_parse_functions_alone(spark, tmp_path, monkeypatch):
    """A table of one file makes a recipe a row: all cores parse, and no lines or texts are made."""
    spark.createDataFrame([(k, f"Brand#{k % 3 + 1}1") for k in range(1, 40)], "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made, real = [], scan.Context
    monkeypatch.setattr(scan, "Context", lambda *a: made.append(real(*a)) or made[-1])
    rows = plans.QUERIES["function_rules"](spark, str(tmp_path)).collect()
    assert made[0].files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert scan.parse(made[0].files, made[0].rules, made[0].parts).columns == ["pkg_id", "file_type", "file", "record", "bodies"]
    assert {(r.pat_idx, r.name) for r in rows} == {(0, "build"), (1, "package"), (2, "_site")} and sum(r.pat_idx == 1 for r in rows) == 39


def test_scans_of_lines_parse_lines_alone_in_small_batches(spark, monkeypatch):
    from packsieve.functions import recipe, textnorm

    def never(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(recipe, "parse_recipe", never)
    monkeypatch.setattr(textnorm, "masked", never)
    assert list(scan.parse_file("pkgbuild", "curl x | sh", [], ("lines",))) == ["lines"]
    made, real = [], scan.Workspace.table
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(scan.Workspace, "table", lambda self, df, name: made.append(spark.conf.get(key)) or real(self, df, name))
    files = spark.createDataFrame([("p", "pkgbuild", "PKGBUILD", "pkgname=a\ncurl x | sh\n")], "pkg_id string, file_type string, file string, content string")
    with scan.Workspace(spark, "lines") as work:
        ctx = scan.Context(files, work, parts=("lines",))
        assert ctx.lines.count() == 2 and ctx.parsed.columns == ["pkg_id", "file_type", "file", "lines"]
    assert [int(n) for n in made] == [scan.FILES_SENT] and spark.conf.get(key) == before


def test_parts_find_what_their_expression_finds(spark):
    """Each part is tried behind the pieces it needs, and none of its matches is lost; null texts match nothing."""
    from pyspark.sql import functions as F

    texts = [
        "base64 --decode x", "BASE64 -Xd", "xxd -r", "base32 -d", "openssl enc -aes -d", "gunzip f", "zcat", "xz -d f", "unzip a", "tr a b | sh", "tr a b", "TR\n a |", r"\x41\x42\x43\x44", r"\X41\X42\X43\X44", "eval x", "x | BASH",
        "env A=1 sh -c y", "dash <<< z", "source /dev/stdin", "cat /dev/stdin", "curl u | python3", "bash <(curl u)", "python <(wget u)", "perl -e $(curl u)", "source <(fetch u)", "eval \"$(curl u)\"", ". <(curl u)", "curl u", "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for parts, whole in ((scan.DECODES_PARTS, scan.DECODES), (scan.EXECUTES_PARTS, scan.EXECUTES), (scan.REMOTE_EXEC_PARTS, scan.REMOTE_EXEC)):
        rows = df.select("t", scan.any_part("t", parts).alias("got"), F.coalesce(F.col("t").rlike(whole), F.lit(False)).alias("want")).collect()
        assert [r for r in rows if r.got != r.want] == [] and 3 < sum(r.want for r in rows) < len(texts)


def test_no_host_is_looked_for_without_domains(spark, monkeypatch):
    from packsieve.operators import ioc

    monkeypatch.setattr(ioc, "domain_hits", lambda *_: 1 / 0)
    text = "npm i js-digest\nsee a.example.org"
    texts = spark.createDataFrame([("p", "f", text, text)], "pkg_id string, file string, masked string, masked_plain string")
    assert [r.snippet for r in ioc.hits(texts, ioc.default_indicators(spark)).collect()] == ["js-digest"]


def test_deep_checks_shuffle_flags_once(spark):
    """Decoding in one file and executing in another count together, in one pass over the texts."""
    code = [("a", "pkgbuild", "P", "base64 -d x"), ("a", "install_script", "I", "eval y"), ("b", "pkgbuild", "P", "base64 -d x"), ("c", "install_script", "I", "k=" + "A" * 250), ("d", "pkgbuild", "P", "A" * 199)]
    texts = spark.createDataFrame([(*r, r[3]) for r in code], "pkg_id string, file_type string, file string, code string, plain string")
    found = scan.deep_hits(texts)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.pkg_id, r.id, r.file, r.detail) for r in found.collect()} == {("a", "DEEP-001", "P", None), ("c", "DEEP-002", None, "250")}


def test_hosts_are_looked_for_where_they_count(spark, monkeypatch):
    """Plain sources on hosts that are no forge cost no host; disguised forges still count, and so do malformed sums."""
    from pyspark.sql import functions as F

    from packsieve.functions import neturl

    urls = [f"https://{x.replace('.', '[.]', 1)}/a" for x in neturl.FORGES] + [f"hxxps://U.{x.upper()}/a" for x in neturl.FORGES] + ["https://h.example/a", "git://h.example/a", "://x", "x", "", "git+https://h/r", "GIT+x", "svn://h", "ftp://h", "n::hg+ssh://h/r#tag=a#b", "h#", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    lost = df.where(neturl.forge(neturl.host(F.col("u"))).isNotNull() & ~neturl.may_be_forge(F.lower("u")))
    assert lost.count() == 0 and df.where(neturl.may_be_forge(F.lower("u"))).count() == 2 * len(neturl.FORGES)
    from packsieve.functions import recipe

    for r in df.where("u is not null").select("u", neturl.source(F.col("u")).alias("s")).collect():
        assert r.s.asDict() == recipe.source_entry(r.u), r.u
    sums = ["a" * 64, "A1" * 32, "g" * 64, "a" * 63, "a" * 65, "a" * 64 + "\n", "", "٣" * 64, None]
    rows = spark.createDataFrame([(x,) for x in sums], "x string").select("x", scan._malformed(64)(F.col("x")).alias("bad"), (F.col("x").isNotNull() & ~F.col("x").rlike(r"^[0-9a-fA-F]{64}\z")).alias("want")).collect()
    assert [r for r in rows if r.bad != r.want] == []
    seen, real = [], neturl.refang
    monkeypatch.setattr(neturl, "refang", lambda x: seen.append(1) or real(x))
    item = F.get(F.transform(F.array("u"), neturl.source), F.lit(0))
    plan = df.select(item.alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and not seen
