"""Benchmark decontamination by size-partitioned MinHash containment search, in SQL functions only.

Items are short and documents long, so the search is asymmetric. Items are partitioned by size (number of distinct
shingles, in powers of two); the MinHash sketch of an item holds its ``k`` smallest shingle hashes, where ``k`` is one
more than the shingles that the largest item of its partition may lack at the threshold. A document that holds at
least the threshold's share of an item lacks fewer shingles than the sketch has, so it holds one of the sketch: the
search loses nothing. Candidates are then confirmed by counting all of the item's shingles in the document.

Text is lower-cased and cut at characters that are neither letters nor digits; shingles are ``SHINGLE`` words. An item
with fewer words is one shingle of its own length, and documents are cut into that length too. Hashes have 64 bits.

Only candidates are proved: a candidate is one pair of a text and an item, and its proof is the size of one array
intersection. Texts are known by their digest, so copies are searched once. Tables of items are broadcast while their
bytes are within the limit, and joined by a shuffle beyond it.

Defined cases: an item or document that is null or has no words matches nothing; repeated items and documents are
each reported; ties do not occur; a text is cut whole, however long; ids may be null or shared; empty tables give no
matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.llm.shared import Workspace, join_few, settle, small, text_key

SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of a row of two hashes when it is broadcast.
ROW_BYTES = 32


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(array: str, size: int) -> Column:
    first = F.expr(f"slice({array}, 1, greatest(size({array}) - {size - 1}, 0))")
    return F.transform(first, lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(F.col(array), i + k) for k in range(1, size)]))


def item_shingles(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct shingles of each item, with its size and word count: _item, _words, _size, _h."""
    df = items.select(F.col(item).alias("_item"), words(F.col(text)).alias("_w")).where("size(_w) > 0")
    whole = F.array(F.xxhash64(F.lit(0), F.col("_w")))
    for size in range(1, SHINGLE):
        whole = F.when(F.size("_w") == size, _shingles("_w", size)).otherwise(whole)
    sets = F.array_distinct(F.when(F.size("_w") >= SHINGLE, _shingles("_w", SHINGLE)).otherwise(whole))
    df = df.select("_item", F.least(F.size("_w"), F.lit(SHINGLE)).alias("_words"), sets.alias("_set"))
    # item ids may repeat: each row of the table is an item of its own
    return df.select(F.xxhash64("_item", "_set").alias("_row"), "_item", "_words", F.size("_set").alias("_size"), "_set").distinct()


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The MinHash sketch of each item row: _row, _h. Its length is set by the item's size partition."""
    part = F.floor(F.log2(F.col("_size").cast("double"))).cast("int")
    largest = F.pow(F.lit(2), part + 1).cast("int") - 1
    k = F.least(F.col("_size"), F.floor(largest * (1 - threshold) + 1e-9).cast("int") + 1)
    df = items.withColumn("_k", k).withColumn("_sorted", F.array_sort("_set"))
    return df.select("_row", F.explode(F.expr("slice(_sorted, 1, _k)")).alias("_h"))


def matches(docs: DataFrame, items: DataFrame, work: Workspace, text: str = "text", item: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """(_text, _item, _found, _size): the digest of each text that holds an item, the item's id, how many of its shingles
    were found, and its size."""
    sets = work.table(item_shingles(items, item), "items")
    lengths = [r[0] for r in sets.select("_words").distinct().collect()]  # at most SHINGLE values
    if not lengths:
        none = F.lit(None).cast(sets.schema["_item"].dataType)
        return docs.select(text_key(text).alias("_text"), none.alias("_item"), F.lit(0).alias("_found"), F.lit(0).alias("_size")).limit(0)
    sketch = small(work.table(sketches(sets, threshold).select("_h", "_row"), "sketch"), ROW_BYTES)
    df = docs.select(text_key(text).alias("_text"), words(F.col(text)).alias("_w"))
    hashes = F.concat(*[_shingles("_w", n) for n in sorted(lengths)])
    # what an item holds at all, which is all that a proof can count
    any_item = small(work.table(sets.select(F.explode("_set").alias("_h")).distinct(), "any"), ROW_BYTES)
    held = df.select("_text", F.explode(hashes).alias("_h")).join(any_item, "_h", "left_semi").distinct()
    held = work.table(held, "held")
    candidates = work.table(held.join(sketch, "_h").select("_text", "_row").distinct(), "candidates")
    # the proof takes candidates only: one intersection each
    asked = held.join(candidates.select("_text").distinct().hint("merge"), "_text", "left_semi").groupBy("_text").agg(F.collect_set("_h").alias("_held"))
    # one item may be in a large part of all texts: items go to the candidates, not candidates to the task of their item
    held_by = candidates.groupBy("_row").agg(F.count("*").alias("_n"))
    items_by_row = work.table(sets.join(held_by, "_row").select("_row", "_item", "_size", "_set", "_n"), "asked_items")
    row_bytes = 64 + 8 * (items_by_row.agg(F.max("_size")).first()[0] or 0)
    proof = join_few(candidates.join(asked, "_text"), items_by_row, "_row", row_bytes, "_n").withColumn("_found", F.size(F.array_intersect("_held", "_set")))
    return proof.where(F.col("_found") >= F.ceil(threshold * F.col("_size") - 1e-9)).select("_text", "_item", "_found", "_size")


def judge(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: key, number of items found, their ids, kept (no item found)."""
    with Workspace(docs.sparkSession, "decontam") as work:
        per_text = matches(docs, items, work, text, item).groupBy("_text").agg(F.array_sort(F.collect_set("_item")).alias("_ids"))
        both = docs.select(key, text_key(text).alias("_text")).join(per_text, "_text", "left")
        ids = F.coalesce("_ids", F.array().cast(both.schema["_ids"].dataType))
        return settle(both.select(key, F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("item_ids"), (F.size(ids) == 0).alias("kept")))


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4))) AS s FROM doc_words
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4))) AS s FROM item_words
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
found AS (
  SELECT d.doc_id, i.item_id FROM doc_shingles d JOIN item_shingles i ON d.s = i.s JOIN sizes z ON z.item_id = i.item_id
  GROUP BY d.doc_id, i.item_id, z.n HAVING count(*) >= ceil(0.8 * z.n - 1e-9)
), per_doc AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_items, 0) AS n_items, coalesce(p.item_ids, '') AS item_ids, p.doc_id IS NULL AS kept
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id
"""
