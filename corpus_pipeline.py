"""A corpus pipeline: toxic documents go, boilerplate lines go, one of each near-duplicate group stays, documents with
benchmark items go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. A stage's result is
written and read again before the next one. Every stage takes an empty table, and keeps columns it doesn't know, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.llm import bpe, decontam, linededup, minhash, toxicity
from packsieve.llm.shared import Workspace, settle, text_key

#: Similarity in percent, words of a shingle and bands of the near-duplicate stage.
SIMILARITY, SHINGLE, BANDS = 80, 5, 40


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with more underscores in front until ``docs`` has no such column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. A null or empty text has the score of a text without words; repeated
    rows are each judged; without labels of both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    score = _free("_score", docs)
    return toxicity.attach(docs, model, score=score).where(F.col(score) < 0.5).drop(score)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, passages on few sites included; one that has no other lines goes. Null and
    empty texts lose no lines and stay; rows that share an id lose their own lines only; repeated rows lose lines alike;
    ``n_chars`` is the new length where lines went."""
    with Workspace(spark, "stage-lines") as work:
        gone = settle(linededup.removals(docs, work, passages=True))
    out = linededup.apply_removals(docs, gone)
    left = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    size = F.when(F.col("_ld_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where((F.col("_ld_removed") == 0) | left).withColumn("n_chars", size).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of least id, ids before nulls, of rows that share that id any one.
    Texts without words are in no group, so null and empty texts all stay, repeated ones too."""
    with Workspace(spark, "stage-minhash") as work:
        # rows get an order that a lost executor can't change: it is written before it is used
        row, key = _free("_row", docs), _free("_key", docs)
        rows = work.table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias(key), "text")
        found = minhash.near_duplicates(keyed, work, key=key, width=SHINGLE, threshold=SIMILARITY, bands=BANDS)
        first = found.where(F.col(key) == F.col("component_id")).select(F.col(f"{key}.row").alias(row))
        return settle(rows.join(first.hint("merge"), row, "left_semi").select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null or empty text holds none; all rows with a text that holds one go."""
    with Workspace(spark, "stage-decontam") as work:
        gone = settle(decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work).select("_text").distinct())
    mark = _free("_text", docs)
    return docs.withColumn(mark, text_key("text")).join(gone.withColumnRenamed("_text", mark).hint("merge"), mark, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes; a null or empty text has none."""
    with Workspace(spark, "stage-bpe") as work:
        return settle(bpe.encode(docs, work, ids=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    with work:
        for n, (_, stage) in enumerate(STAGES[:-1]):
            docs = work.table(stage(spark, docs, sf_dir), f"stage{n}")
        return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the MinHash groups and the encoder have no SQL; tests/llm/test_pipeline.py holds every stage, and run(),
#: against brute force.
ORACLE_SQL = None
