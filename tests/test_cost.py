"""Expressions that may take without end are refused, and what is accepted is fast in a backtracking engine."""

import re
import time

import pytest

from packsieve.functions import cost
from packsieve.operators import catalog, rulebook, scan

HOSTILE = [
    "(a+)+$", "(a*)*b", "(a|ab|b)*c", "(?:a?b?)*c", r"(\w+\s?)*$", "(x+x+)+y", "(.*a){12}", ".*" * 9 + "x", "(?>(a+)+)b", "(a{1,50})+b", "(a{70,})+b", r"^(([a-z])+.)+[A-Z]([a-z])+$", r"(a)\1+", "[", "(?=(a+)+b)x",
    r"(?:-\S+\s*)*<<<", "(a|aa)+$", r"([a-zA-Z]+)*$", r"(.+.+)*x", "(?i)(A|a)(a|A)*(A+)+b", "(a|a)*b", "(a|[ab])*c", "(?:ab|ab)+c", r"(\w|\d)*-", "(a||)*b",
]
SOUND = ["(?>a+)+$", "(a++)+$", "(?:a++b)*c", r"(\S+\s+)*x", r"([a-z]+\.)+[a-z]+", "a{2,5}b", r"(\d+)?(\d+)?(\d+)?x", "(?i)(foo|bar)+baz", r"\p{L}+x", r"(https?://)?\w+(\.\w+)*/", "(ab|cd)*(ab|ce)*x", r"(?<name>a)\z", "", "é+ü"]


@pytest.mark.parametrize("pattern", HOSTILE)
def test_refused(pattern):
    assert cost.judge(pattern)[1]


@pytest.mark.parametrize("pattern", SOUND)
def test_accepted(pattern):
    assert cost.judge(pattern)[1] is None


def test_catalog_is_sound(spark):
    assert not rulebook.broken(spark, catalog.RULES)
    assert max(cost.judge(p)[0] for r in catalog.RULES for _, p in r.regexes()) <= cost.MOST_LOOPS
    assert all(cost.judge(p)[1] is None for p in (scan.REMOTE_EXEC, scan.DECODES, scan.EXECUTES, scan.SPECIAL_MODE, scan.BLOB))


def test_refused_ones_are_slow_and_accepted_ones_are_not():
    """Against the clock: the engine of the standard library backtracks as well."""

    def seconds(pattern, text):
        began = time.time()
        re.search(pattern, text)
        return time.time() - began

    assert seconds("(?:a?b?)*c", "ab" * 9) > 20 * seconds("(?:a?b?)*c", "ab" * 4)
    for p in SOUND:
        if "\\p" not in p and "\\z" not in p:
            assert seconds(p, "a" * 200 + "!") < 0.5 and seconds(p, "ab" * 200 + " !") < 0.5


def test_here_strings_still_found():
    """The one expression of the catalog that was refused has the same matches in its new form."""
    old, new = re.compile(r"sh\b\s*(?:-\S+\s*)*<<<"), re.compile(r"sh\b\s*(?:-\S+\s+)*(?:-\S+)?<<<")
    for text in ("sh <<<", "sh -c <<< x", "sh -c<<< x", "sh -a -b--c  <<<", "sh-<<<", "sh - <<<", "sh -a b <<<", "sh -a\t-b<<<x", "sh --<<<<", "sh -<<<<"):
        assert bool(old.search(text)) == bool(new.search(text)), text


def test_costs_of_a_table(spark):
    rows = spark.createDataFrame([("a", "(a+)+$"), ("b", "a+"), ("c", None), ("a", "(a+)+$")], "id string, pattern string")
    assert sorted((r.id, r.loops, r.refused is None) for r in rulebook.costs(rows).collect()) == [("a", 0, False), ("a", 0, False), ("b", 1, True), ("c", 0, False)]
    hostile = catalog.Rule("H", "low", "persistence", "P", None, "h", ("(a+)+$",))
    assert list(rulebook.broken(spark, [hostile, *catalog.RULES])) == ["H"] and rulebook.sound(spark, [hostile]) == []
