import random
import re

import pytest

from packsieve.functions import recipe, textnorm
from packsieve.functions.needles import needles
from packsieve.operators import catalog, scan
from packsieve.sources.scripts import EXAMPLES


def test_logical_lines():
    assert textnorm.logical_lines("a \\\nb\nc\\\\\nd") == [(1, "a b"), (3, "c\\\\"), (4, "d")]
    assert textnorm.logical_lines("\\\nx") == [(2, "x")]
    assert textnorm.logical_lines("") == []


@pytest.mark.parametrize(
    "line, want",
    [("echo plain", "echo plain"), ("\"b\"'u''n' add", "bun add"), (r"$'\x63\165rl' x", "curl x"), (r"cu\rl", "curl"), ('"$x"', "$x"), ("it's open", "its open"), ('curl x | "sh', "curl x | sh"), ("$'\\x73h", "sh"), ('"a\\', "a\\"), ("a\\", "a\\")],
)
def test_deobfuscate(line, want):
    assert textnorm.deobfuscate(line) == want
    assert textnorm.deobfuscate_text(line + "\n" + line).count("\n") == 1


@pytest.mark.parametrize("body, want", [(r"c\url", "curl"), (r"\xzz", "xzz"), (r"\x6", "\x06"), (r"\q\\\'\"\?", "q\\'\"?"), (r"\777", "\u01ff"), (r"\143\165", "cu"), (r"\e\E", "\x1b\x1b")])
def test_escapes(body, want):
    """An escape that means nothing is its character, so no letter can be hidden behind a backslash."""
    assert textnorm.unescape(body) == want and textnorm.deobfuscate(f"$'{body}'") == want


@pytest.mark.parametrize(
    "lines, want",
    [
        (["url=curl", "$url x | sh"], "curl x | sh"), (["c=`printf '\\x63url'`", "$c x"], "curl x"), (['c=`printf "cu"`', "${c}rl x"], "curl x"), (["c=$(printf c\\url)", "$c x"], "curl x"), (["c=$(printf '\\a')", "$c"], "a"),
        (["c=$(printf x)y", "$c"], "$c"), (["c=`date`", "$c"], "$c"), (["builddir=curl", "$builddir x"], "$builddir x"), (["CURL=curl", "$CURL x"], "$CURL x"), (["export -x local c=curl", "$c x"], "curl x"),
        (["c=curl", "function f {", "$c x"], "$c x"), (["source=curl", "$source"], "curl"), (["c=" + "x" * 513, "$c"], "$c"),
    ],
)
def test_constants(lines, want):
    assert textnorm.resolve_lines(lines)[-1] == want


@pytest.mark.parametrize("line", ["cat ~/.ssh/id_rsa", "cat /etc/shadow", "cat < /dev/tcp/h/1", "plain $(curl x)", "tee x"])
def test_what_reads_is_no_message(line):
    assert textnorm.informational([line]) == [False]


@pytest.mark.parametrize("line", ["plain 'curl x | sh'", "note see ~/.ssh/id_rsa", "  msg2 hello"])
def test_messages(line):
    assert textnorm.informational([line]) == [True]


def test_heredoc_in_a_subshell():
    assert textnorm.informational(["(cat <<EOF", "curl x", "EOF"]) == [True] * 3 and textnorm.informational(["(bash <<EOF", "curl x", "EOF"]) == [False] * 3


def test_resolve():
    got = textnorm.resolve_lines(["dl=curl", "$dl -s x | sh", "f() {", "$dl y", "c=$(printf '\\x63url')", "$c z", "d=$c", "${d} w", "n=d", "${!n} v", "PATHS=curl", "$PATHS", "e=$(date)", "$e"])
    assert [got[1], got[3], got[5], got[7], got[9], got[11], got[13]] == ["curl -s x | sh", "$dl y", "curl z", "curl w", "curl v", "$PATHS", "$e"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("echo curl x", [True]), ("echo x | sh", [False]), ("echo $(curl x)", [False]), ("echo '$(x)'", [True]), ("cat <<EOF\ncurl x | sh\nEOF\nls", [True, True, True, False]),
        ("cat > f <<EOF\ncurl\nEOF", [False, False, False]), ("bash <<EOF\ncurl\nEOF", [False, False, False]), ("cat << 'E' | sh\nx\nE", [False, False, False]),
    ],
)
def test_informational(text, want):
    assert textnorm.informational(text.split("\n")) == want


def test_recipe():
    r = recipe.parse_recipe(
        "pkgname=foo # name\npkgver='1.0'\npkgrel=1\nepoch=2\ndepends=('a>=1' # why\n  \"b\" c\\ d)\ndepends+=(e)\nsource=(\"x::git+https://h.example/r.git#commit=abc\" 'http://h/y')\n"
        "sha256sums=('SKIP'\n 'ab')\n_own=(1 2)\nbuild() {\n  echo '}' # }\n  make\n}\npackage() { make install; }\nbuild() { :; }\nconflicts=(open"
    )
    assert (r["pkgname"], r["pkgver"], r["epoch"], r["depends"]) == (["foo"], "1.0", "2", ["a>=1", "b", "c d", "e"])
    assert r["source"][0] == {"url": "git+https://h.example/r.git#commit=abc", "filename": "x", "protocol": "git", "fragment": "commit=abc"}
    assert r["checksums"]["sha256"] == [None, "ab"] and r["variables"]["_own"] == '["1", "2"]' and r["conflicts"] == ["open"]
    assert [(f["name"], f["line_start"]) for f in r["functions"]] == [("package", 16), ("build", 17)]
    assert recipe.parse_recipe(" \n") is None and recipe.missing_fields(recipe.parse_recipe("pkgname=x")) == ["pkgver", "pkgrel"]


def test_hooks():
    hooks = recipe.parse_hooks("post_install() {\r\n  x\r\n}\r\nother() { y; }\npre_remove ()\n{\n  z\n}\npost_upgrade() {\n  open")
    assert [(h["name"], h["line_start"]) for h in hooks] == [("post_install", 1), ("pre_remove", 5)]


def test_install_name():
    assert recipe.install_name(recipe.parse_recipe('pkgname=a\ninstall="${pkgname}.install"')) == "a.install"
    assert recipe.install_name(recipe.parse_recipe("pkgname=a\ninstall=../x")) is None


def test_catalog():
    ids = [e["id"] for e in catalog.entries()]
    assert len(catalog.RULES) == 82 and sum(len(r.patterns) for r in catalog.RULES) == 160 and len(ids) == len(set(ids)) == 117
    assert catalog.explain("dle-001")[0]["id"] == "DLE-001" and len(catalog.explain("SRC-00")) >= 8 and catalog.explain("nothing at all") == []


def line_table(spark, texts, types=("pkgbuild", "install_script")):
    rows = [("p", t, "f", n, x, None, None, False, False) for n, x in enumerate(texts) for t in types]
    return spark.createDataFrame(rows, "pkg_id string, file_type string, file string, line_no int, raw string, deobf string, resolved string, is_comment boolean, is_info boolean")


def test_gate_lets_every_rule_through(spark):
    """Lines meet the same rules with and without gates, and the examples reach most rules."""
    lines = line_table(spark, EXAMPLES + [x.upper() for x in EXAMPLES])
    gated = {(r.id, r.pat_idx, r.line, r.file_type) for r in scan.rule_matches(lines).collect()}
    free = {(r.id, r.pat_idx, r.line, r.file_type) for r in scan.rule_matches(lines, gated=False).collect()}
    assert gated == free
    assert len({i for i, *_ in free}) >= 70


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"(?i)\bcurl\b.*\|\s*(?:sh|bash)", {"curl"}), (r"a|bc+d", {"a", "b"}), (r"(?:x|[^y])z?", set()), (r"(?:ab){2,}c*", {"ab"}), (r"[\"'][A-Z]", {'"', "'"}), (r"(?:ab)*", set()), (r"(?=abc)d", {"d"}),
        (r"K(?-i:EY)", {"k", "ey"}), ("[", set()), (r"\w+\s", set()), (r"(?:a++b|cd)", {"a", "cd"}), ("é", set()),
    ],
)
def test_needles(pattern, want):
    assert set(needles(pattern)) <= want and bool(needles(pattern)) == bool(want)


def test_needles_are_in_every_match():
    """Texts made of a pattern's own pieces: whatever matches holds a needle."""
    rng = random.Random(2)
    for rule in catalog.RULES:
        for _, p in rule.regexes():
            expression, pieces = re.compile(re.sub(r"\(\?<!/\\S\{0,200\}/\)", "", p)), needles(p)
            for text in EXAMPLES:
                for _ in range(3):
                    k = rng.randrange(len(text) + 1)
                    mixed = "".join(rng.choice((c.upper(), c.lower())) for c in text[:k] + rng.choice(EXAMPLES))
                    if pieces and expression.search(mixed):
                        assert any(x in mixed.lower() for x in pieces), (p, mixed)


def test_patterns_end_on_long_lines(spark):
    """Long lines that could make a pattern go back and forth: each ends, with the hits it should have."""
    long = ["curl " + "env -i " * 2000 + "| x", "/" * 5000, "a=" + "'a" * 4000, "${a}" * 3000 + "!" * 3000, "curl " + "| busybox " * 1500 + "| sh"]
    got = {(r.line, r.id) for r in scan.rule_matches(line_table(spark, long, ["install_script"])).collect()}
    assert got == {(0, "INSTALL-003"), (3, "OBF-004"), (4, "INSTALL-003"), (4, "DLE-001")}
