"""Indicator tables: campaigns, merging, and joins with the texts of packages."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packsieve.functions import neturl

#: Known campaigns and their indicators.
CAMPAIGNS = [("atomic-arch-2026-06", "Atomic Arch"), ("chaos-rat-2025-07", "CHAOS RAT")]
INDICATORS = [
    ("npm", "atomic-lockfile", "atomic-arch-2026-06"), ("npm", "js-digest", "atomic-arch-2026-06"), ("npm", "lockfile-js", "atomic-arch-2026-06"),
    ("file", "scales.bpf.c", "atomic-arch-2026-06"),
    ("package", "librewolf-fix-bin", "chaos-rat-2025-07"), ("package", "firefox-patch-bin", "chaos-rat-2025-07"), ("package", "zen-browser-patched-bin", "chaos-rat-2025-07"),
]
#: Values of so many bytes in all are looked for one by one; domains of so many bytes are broadcast, and of more only the
#: bits of a sieve, SIEVE_BITS of them, which are 8 MB.
GATE_BYTES, DOMAIN_BYTES, SIEVE_BITS = 4096, 8 << 20, 1 << 26
#: What tokens are cut at: all but letters and digits of any script, and - _ . /
NOT_TOKEN = r"[^\p{IsAlphabetic}\p{N}\-_./]+"
INDICATOR_TYPE = "kind string, value string, campaign_id string"


def default_indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, INDICATOR_TYPE)


CAMPAIGN_TYPE = "id string, name string"


def default_campaigns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMPAIGNS, CAMPAIGN_TYPE)


def merge_campaigns(*tables: DataFrame) -> DataFrame:
    """Union of campaign tables; of one id the first table's row stays."""
    both = None
    for n, t in enumerate(tables):
        t = t.withColumn("_from", F.lit(n))
        both = t if both is None else both.unionByName(t)
    first = Window.partitionBy("id").orderBy("_from")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_from")


def with_campaigns(hits_: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Rows with a campaign_id, and the name of the campaign where it is known."""
    return hits_.join(campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign")), "campaign_id", "left")


def merge(*tables: DataFrame) -> DataFrame:
    """Union of indicator tables; of one kind and value the last table's row stays."""
    both = None
    for n, t in enumerate(tables):
        t = t.withColumn("_from", F.lit(n))
        both = t if both is None else both.unionByName(t)
    last = Window.partitionBy("kind", "value").orderBy(F.desc("_from"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_from")


def sieve(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows of ``hosts`` (value, ...) whose value may be one of ``domains`` (value): none that is one is lost.

    The domains' hashes are bits of a bitmap of ``SIEVE_BITS``, which is broadcast in pieces; a host of which no bit is set
    doesn't go into the shuffle of the join.
    """
    bit = lambda df: df.withColumn("_bit", F.pmod(F.xxhash64("value"), F.lit(SIEVE_BITS)))
    maps = bit(domains.select("value")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    told = bit(hosts).withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "_bucket")  # SIEVE_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.expr("substring(_map, cast(bitmap_bit_position(_bit) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return told.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_bit) % 8 as int))")) != 0).drop("_bit", "_bucket", "_map")


def domain_hits(lines: DataFrame, indicators: DataFrame) -> DataFrame:
    """Rows of ``lines`` (..., text), without the text, for each domain indicator that a host in the text is, or is below."""
    domains = indicators.where("kind = 'domain'").withColumn("shown", F.col("value")).withColumn("value", neturl.host_name(F.col("value"))).where("value != ''")
    below = lines.where("contains(text, '.') or contains(lower(text), 'dot')").withColumn("value", F.explode(F.array_distinct(F.flatten(F.transform(neturl.hosts_in(F.col("text")), neturl.above))))).drop("text")
    size = domains.agg(F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0))).first()[0]
    found = below.join(F.broadcast(domains), "value") if size <= DOMAIN_BYTES else sieve(below, domains).join(domains.hint("merge"), "value")
    return found.withColumn("value", F.col("shown")).drop("shown")


def hits(texts: DataFrame, indicators: DataFrame) -> DataFrame:
    """IOC-001: npm and file names as whole tokens, domains at label boundaries; once per line, kind and value."""
    lines = texts.select("pkg_id", "file", F.posexplode(F.split("masked", "\n")).alias("n", "text")).unionByName(
        texts.where("masked_plain != masked").select("pkg_id", "file", F.posexplode(F.split("masked_plain", "\n")).alias("n", "text"))
    )
    lines = lines.where("text != '' and not ltrim(text) like '#%'")
    # a few values are looked for in the lines before these are cut into tokens; a long list is not
    named = indicators.where("kind in ('npm', 'file')")
    size = named.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    if size <= GATE_BYTES:
        few = [r.value for r in named.select("value").collect()]  # of GATE_BYTES at most
        lines_ = lines.where(functools.reduce(lambda a, v: a | F.contains("text", F.lit(v)), few, F.lit(False)))
    else:
        lines_ = lines
    tokens = lines_.select("pkg_id", "file", "n", F.explode(F.array_distinct(F.split("text", NOT_TOKEN))).alias("value")).where("value != ''")
    found = tokens.join(named, "value")
    if not indicators.where("kind = 'domain'").isEmpty():  # else no line is cut into hosts
        found = found.unionByName(domain_hits(lines.select("pkg_id", "file", "n", "text"), indicators))
    found = found.dropDuplicates(["pkg_id", "file", "n", "kind", "value"])
    return found.select(
        "pkg_id", F.lit("IOC-001").alias("id"), F.lit("critical").alias("severity"), "file", (F.col("n") + 1).cast("int").alias("line"), F.lit(None).cast("int").alias("column"),
        F.col("value").alias("snippet"), F.concat_ws(" ", "kind", "campaign_id").alias("detail"), F.lit(0).alias("ord"),
    )


def check(indicators: DataFrame, value: str) -> DataFrame:
    """Rows of one value, whatever its kind but domains."""
    return indicators.where((F.col("value") == value) & (F.col("kind") != "domain"))


def stats(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("campaign_id").alias("campaigns"))
