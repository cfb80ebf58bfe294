"""Reputation: what a scan would ask about, within its budget, joined with a table of verdicts instead of a remote service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packsieve.functions import neturl

#: Lookups of one package's scan.
BUDGET = 20


def lookups(packages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(pkg_id, file, provider, subject): sums of downloaded artifacts, then their http URLs, each sorted and once, as many
    as the budget allows."""
    sums = F.transform("source", lambda s, i: F.when(~neturl.is_vcs(s), F.lower(F.trim(F.get("checksums.sha256", i)))))
    sums = F.array_sort(F.array_distinct(F.filter(sums, lambda x: x.isNotNull() & (F.length(x) == 64))))
    urls = F.transform(F.filter("source", lambda s: ~neturl.is_vcs(s) & s["protocol"].isin("http", "https")), lambda s: F.substring_index(s["url"], "#", 1))
    urls = F.array_sort(F.array_distinct(urls))
    asked = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("provider"), x.alias("subject")))
    both = F.slice(F.concat(asked("vt", sums), asked("urlhaus", urls)), 1, budget)
    return packages.select("pkg_id", "file", F.inline(both))


def hits(packages: DataFrame, verdicts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """TI-VT-001 and TI-URLHAUS-001: lookups whose verdict (provider, subject, malicious, suspicious) is malicious."""
    bad = verdicts.where((F.col("malicious") > 0) | (F.col("suspicious") > 2)).select("provider", "subject").distinct()
    rows = lookups(packages, budget).join(bad, ["provider", "subject"])
    vt = F.col("provider") == "vt"
    return rows.select(
        "pkg_id", F.when(vt, "TI-VT-001").otherwise("TI-URLHAUS-001").alias("id"), F.lit("critical").alias("severity"), "file", F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"), F.when(vt, F.concat(F.lit("sha256: "), "subject")).otherwise(F.col("subject")).alias("snippet"), F.lit(None).cast("string").alias("detail"),
        F.lit(0).alias("ord"),
    )


def within_quota(requests: DataFrame, a_minute: int = 4, a_day: int = 500) -> DataFrame:
    """Requests (at: seconds) that a provider's quota lets through, if each window of a minute and a day is counted from zero."""
    place = lambda part: F.row_number().over(Window.partitionBy(F.floor(F.col("at") / part)).orderBy("at", "subject"))
    first = requests.withColumn("_m", place(60)).where(F.col("_m") <= a_minute)
    return first.withColumn("_d", place(86400)).where(F.col("_d") <= a_day).drop("_m", "_d")
