"""Rules of one's own: TOML files and folders of them, checked when they are read, and put beside the catalog."""

from __future__ import annotations

import tomllib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from packsieve.functions import cost
from packsieve.functions.severity import CATEGORIES, SEVERITIES
from packsieve.operators.catalog import Inert, Literal, Rule
from packsieve.session import ship

LETTERS = {"pkgbuild": "P", "install_script": "I"}
RULE_TYPE = "id string, place int, kind string, pattern string, severity string, category string, enabled boolean"


def _pattern(told: dict):
    kind = told["type"]
    if kind == "regex":
        return told["pattern"]
    if kind == "literal":
        return Literal(told["text"], bool(told.get("case_sensitive", False)))
    if kind in ("function", "variable"):
        return Inert(kind, told["name"], told.get("body_pattern" if kind == "function" else "value_pattern"))
    raise ValueError(f"unknown pattern type {kind!r}")


def read_toml(text: str) -> list[Rule]:
    """The rules of one file's ``[[rule]]`` tables. A rule without file types looks at recipes and hooks."""
    out = []
    for r in tomllib.loads(text).get("rule", []):
        types = r.get("file_types") or list(LETTERS)
        if r["severity"] not in SEVERITIES or r["category"] not in CATEGORIES:
            raise ValueError(f"{r['id']}: unknown severity or category")
        out.append(
            Rule(
                r["id"], r["severity"], r["category"], "".join(LETTERS.get(t, "") for t in types), r.get("cwe_id"), r["name"], tuple(map(_pattern, r.get("patterns", []))),
                bool(r.get("case_sensitive", False)), bool(r.get("enabled", True)), r["recommendation"], r.get("description", ""),
            )
        )
    return out


def read_folder(folder: str) -> tuple[list[Rule], dict[str, str]]:
    """Rules of all ``*.toml`` files of a folder, by name, and the files that couldn't be read with the reason."""
    if not Path(folder).is_dir():
        raise FileNotFoundError(f"no folder of rules: {folder}")
    rules, bad = [], {}
    for path in sorted(Path(folder).glob("*.toml")):
        try:
            rules += read_toml(path.read_text())
        except (ValueError, KeyError, OSError) as e:
            bad[path.name] = f"{type(e).__name__}: {e}"
    return rules, bad


def read_folders(folders: list[str]) -> tuple[list[Rule], dict[str, str]]:
    """Rules of several folders in order, as a distribution, an administrator and a user each have one: later ones stand
    behind earlier ones, so that of one id the last counts (``by_id``). Folders that aren't there are passed by. Bad files are
    told with their path."""
    rules, bad = [], {}
    for folder in folders:
        if Path(folder).is_dir():
            more, wrong = read_folder(folder)
            rules += more
            bad |= {f"{folder}/{name}": why for name, why in wrong.items()}
    return rules, bad


def broken(spark: SparkSession, rules: list[Rule]) -> dict[str, str]:
    """Rules whose expressions the engine's dialect does not take, with its message, or may take without end (``cost``)."""
    compile_, out = spark._jvm.java.util.regex.Pattern.compile, {}
    for r in rules:
        extra = [p for x in r.patterns if isinstance(x, Inert) for p in (x.name if x.kind == "function" else None, x.value) if p]
        for p in [p for _, p in r.regexes()] + extra:
            try:
                compile_(p)
            except Exception as e:  # the JVM's PatternSyntaxException
                out[r.id] = str(getattr(e, "java_exception", e)).splitlines()[0]
                break
            reason = cost.judge(p)[1]
            if reason:
                out[r.id] = reason
                break
    return out


def sound(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    """The rules that can be used: one with a broken expression is left out, and the others stay."""
    bad = broken(spark, rules)
    return [r for r in rules if r.id not in bad]


def add(rules: list[Rule], more: list[Rule]) -> list[Rule]:
    """``rules`` with ``more`` behind them; disabled ones don't come in. Copies of one id all match lines."""
    return rules + [r for r in more if r.enabled]


def by_id(rules: list[Rule]) -> dict[str, Rule]:
    """What an id stands for: the last rule of that id."""
    return {r.id: r for r in rules}


def frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A row a pattern, of ``RULE_TYPE``: id, place, kind, pattern, severity, category, enabled."""
    rows = []
    for r in rules:
        for n, p in enumerate(r.patterns):
            kind, text = ("regex", p) if isinstance(p, str) else ("literal", p.text) if isinstance(p, Literal) else (p.kind, p.name)
            rows.append((r.id, n, kind, text, r.severity, r.category, r.enabled))
    return spark.createDataFrame(rows, RULE_TYPE)


def costs(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Rows of a rule table with ``loops``, the repeats in a row of an expression, and ``refused``, why it cannot be run (null
    if it can): for collections of rules that are tables themselves. A null expression is refused."""
    ship(patterns.sparkSession)
    schema = patterns.schema

    def run(batches):
        for b in batches:
            told = [cost.judge(p) if p is not None else (0, "no expression") for p in b.column(schema.names.index(pattern)).to_pylist()]
            made = [pa.array([t[0] for t in told], pa.int32()), pa.array([t[1] for t in told], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*schema.names, "loops", "refused"])

    return patterns.mapInArrow(run, StructType([*schema.fields, StructField("loops", IntegerType()), StructField("refused", StringType())]))
