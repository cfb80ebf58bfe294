"""Verdicts: thresholds, outcomes and policies as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.functions.severity import RANK, at_least

#: Letters and long names of a helper's operations, and of what makes a sync read only.
SYNC, UPGRADE = ("S", "sync"), ("U", "upgrade")
NO_INSTALL = [("Q", "query"), ("R", "remove"), ("F", "files"), ("D", "database"), ("T", "deptest"), ("V", "version"), ("G", "getpkgbuild"), ("P", "show")]
READ_ONLY_LETTERS, READ_ONLY = "silgcp", ["search", "info", "list", "groups", "clean", "print"]


def severity_gate(findings: DataFrame, fail_on: str = "high", key: str = "pkg_id") -> DataFrame:
    """Per package: its worst rank, number of findings, and whether it trips the gate."""
    return findings.groupBy(key).agg(F.min("sev_rank").cast("int").alias("worst"), F.count("*").alias("n_findings"), F.bool_or(at_least(F.col("sev_rank"), fail_on)).alias("tripped"))


def install_outcome(unscannable: Column, has_findings: Column, force: Column) -> Column:
    return F.when(unscannable, "block").when(has_findings & ~force, "block").when(has_findings & force, "override").otherwise("pass")


def hook_outcome(failed: Column, critical: Column, high: Column) -> Column:
    return F.when(failed, "abort").when(critical > 0, "abort").when(high > 0, "warn").otherwise("proceed")


def policy(worst: Column, interactive: Column, reviewed: Column) -> Column:
    """What a helper asks before it builds."""
    return (
        F.when(~reviewed, "block")
        .when(worst == RANK["critical"], F.when(interactive, "typed yes").otherwise("deny"))
        .when(worst == RANK["high"], F.when(interactive, "default no").otherwise("deny"))
        .otherwise("default yes")
    )


def _arguments(argv: Column) -> tuple[Column, Column, Column]:
    """(letters of short options, names of long options, operands) of a command's arguments."""
    argv = F.filter(F.coalesce(argv, F.array().cast("array<string>")), lambda x: x.isNotNull())
    stop = F.array_position(argv, "--").cast("int")
    own = F.when(stop > 0, F.slice(argv, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(argv)
    after = F.when(stop > 0, F.slice(argv, stop + 1, F.size(argv))).otherwise(F.array().cast("array<string>"))
    long = F.transform(F.filter(own, lambda x: F.startswith(x, F.lit("--"))), lambda x: F.substring_index(F.substring(x, 3, 1 << 30), "=", 1))
    short = F.filter(own, lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("--")))
    return F.array_join(F.transform(short, lambda x: F.substring(x, 2, 1 << 30)), ""), long, F.concat(F.filter(own, lambda x: ~F.startswith(x, F.lit("-"))), after)


def operands(argv: Column) -> Column:
    """What a helper's arguments name, in order: all that are no options, and all after ``--``."""
    return _arguments(argv)[2]


def operation(argv: Column) -> Column:
    """Whether a helper's arguments (an array) can install packages: ``install`` or ``pass``.

    All arguments count, short letters in any grouping, long names with or without a value. With something to install,
    only a read-only sync or another operation passes; flags that are unknown don't turn an install into a pass. Nothing
    named is a pass, as are null and empty arguments.
    """
    short, long, named = _arguments(argv)
    has = lambda letter, name: F.contains(short, F.lit(letter)) | F.array_contains(long, name)
    sync, upgrade = has(*SYNC), has(*UPGRADE)
    other, reads = F.lit(False), short.rlike(f"[{READ_ONLY_LETTERS}]")
    for x in NO_INSTALL:
        other = other | has(*x)
    for x in READ_ONLY:
        reads = reads | F.array_contains(long, x)
    installs = F.when(sync | upgrade, ~(sync & reads)).otherwise(~other & ~reads)
    return F.when((F.size(named) > 0) & installs, "install").otherwise("pass")


def membership(official: Column, lookup: Column) -> Column:
    """Whether a name is a community package; a failed lookup counts as one."""
    return F.when(official, False).otherwise(F.coalesce(lookup, F.lit(True)))


def risk_score(malicious: Column, suspicious: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100).cast("long"), F.floor((100 * malicious + 50 * suspicious) / total))).otherwise(F.lit(0).cast("long"))


def exit_code(outcome: Column) -> Column:
    """What a gate's outcome tells the caller's shell: 0 to go on, 1 to stop."""
    return F.when(outcome.isin("pass", "proceed", "warn", "override"), 0).otherwise(1)


def malicious(malicious_count: Column, suspicious_count: Column) -> Column:
    """Whether a verdict's counts make it a malicious one."""
    return (malicious_count > 0) | (suspicious_count > 2)


def check_outcome(tripped: Column, threshold: Column, failures: Column, declined: Column) -> Column:
    """A check fails if the gate trips, if a threshold was given and something couldn't be fetched, or if the user says no."""
    return F.when(tripped | (threshold.isNotNull() & (failures > 0)) | declined, "fail").otherwise("pass")


def consent(noconfirm: Column, tty: Column, answer: Column) -> Column:
    """Whether to go on: without asking if told so, by the answer at a terminal, never unasked elsewhere."""
    yes = F.lower(F.trim(F.coalesce(answer, F.lit("")))).isin("y", "yes")
    return F.when(noconfirm, "proceed").when(tty & yes, "proceed").otherwise("abort")


def transaction(targets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One outcome per transaction: the worst of its targets' (name) outcomes; a target without a verdict aborts."""
    rank = F.create_map(*[F.lit(x) for kv in {"proceed": 0, "warn": 1, "abort": 2}.items() for x in kv])
    told = targets.join(verdicts.select("name", "outcome"), "name", "left")
    worst = F.max(F.coalesce(rank[F.col("outcome")], F.lit(2)))
    return told.groupBy("transaction").agg(F.count("*").alias("n_targets"), F.element_at(F.array(F.lit("proceed"), F.lit("warn"), F.lit("abort")), worst + 1).alias("outcome"))
