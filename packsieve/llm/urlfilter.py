"""URL filter lists matched by hashed host-suffix and path-prefix expressions.

Every distinct URL is expanded into (host suffix, path prefix) expressions, as many as there are distinct label
counts and path lengths among the rules; no other expression could equal a rule. Expressions meet rules in an
equi-join on the first ``PREFIX_HEX`` hex digits of a SHA-256, then the full digest decides. The longest rule wins.

Pages meet the rules of their URL again without a hot task: rows of the most frequent URLs, and of null ones, are spread.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the default verdict; rules with
a null host or path never fit; of two fitting rules of equal length the one with the longer host wins, then block;
repeated rows are each judged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.llm.shared import Workspace, attach_few, settle, small

PREFIX_HEX = 8
#: Bytes of a row of a rule with its digest when it is broadcast.
RULE_BYTES = 320
RULE_SCHEMA = "verdict string, host string, path string"


def url_host(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    rest = _rest(url)
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Distinct non-null URLs of ``pages`` that some rule fits: url, rule, verdict, n_pages."""
    rules = rules.select("verdict", "host", "path").dropna()
    known = rules.select(
        F.lit(True).alias("_rule"), F.col("verdict").alias("_verdict"), F.concat("host", "path").alias("_name"),
        F.length("host").alias("_host_len"), F.length(F.concat("host", "path")).alias("_len"),
        _digest(F.col("host"), F.col("path")).alias("_digest"),
    ).withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    # bounded by the longest host (127 labels) and the longest rule path
    labels, lengths = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))), F.array_sort(F.collect_set(F.length("path")))
    ).first()
    known = small(known, RULE_BYTES)
    urls = pages.select(F.col(url).alias("url")).where("url is not null").groupBy("url").agg(F.count("*").alias("n_pages"))
    counts, sizes = (F.array(*map(F.lit, x)) if x else F.array().cast("array<int>") for x in (labels, lengths))
    hosts = (
        urls.withColumns({"_host": url_host(F.col("url")), "_path": url_path(F.col("url"))})
        .withColumn("_labels", F.size(F.split("_host", r"\.")))
        .withColumn("_k", F.explode(F.filter(counts, lambda k: k <= F.col("_labels"))))
        .withColumn("_n", F.explode(F.filter(sizes, lambda n: n <= F.length("_path"))))
    )
    digest = _digest(F.expr("substring_index(_host, '.', -_k)"), F.expr("substring(_path, 1, _n)"))
    hits = (
        hosts.select("url", "n_pages", digest.alias("_full"))
        .withColumn("_prefix", F.substring("_full", 1, PREFIX_HEX))
        .join(known, "_prefix")
        .where("_full = _digest")
    )
    best = F.max(F.struct("_len", "_host_len", (F.col("_verdict") == "block").alias("_block"), "_name", "_verdict"))
    out = hits.groupBy("url").agg(best.alias("_best"), F.first("n_pages").alias("n_pages"))
    return out.select("url", F.col("_best._name").alias("rule"), F.col("_best._verdict").alias("verdict"), "n_pages")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule (null where none fits) and verdict."""
    with Workspace(pages.sparkSession, "urlfilter") as work:
        found = work.table(match_rules(pages, rules, url), "found")
        rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("url"))
        out = attach_few(rows, found, "url", "_key", "n_pages")
        told = F.coalesce("url", F.lit(""))
        return settle(out.select(
            F.col("_key").alias(key), url_host(told).alias("host"), url_path(told).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
        ))
