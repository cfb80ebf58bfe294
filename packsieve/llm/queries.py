"""Registered queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packsieve.llm import align, bpe, chat, decontam, linededup, minhash, quality, repeats, search, secrets, toxicity, urlfilter, warc

#: The rules of the URL query, as (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_read(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(_read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_added(_read(spark, sf_dir, "conversations")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(_read(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


OP4_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, host, path) AS (VALUES {_values(URL_RULES)}
), hits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id AND h.n = 1
"""

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_minhash": op2_minhash,
    "op3_warc": op3_warc,
    "op4_url_filter": op4_url_filter,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_chat": op11_chat,
    "op12_search": op12_search,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op4_url_filter": OP4_SQL, "op8_line_dedup": linededup.ORACLE_SQL, "op10_decontamination": decontam.ORACLE_SQL, "op11_chat": chat.ORACLE_SQL, "op12_search": search.ORACLE_SQL}
