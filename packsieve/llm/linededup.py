"""Cross-site boilerplate lines, found by the distinct-site spread of each line, in SQL functions only.

A line is a ``\\n``-split piece of a text; its key is the hash of the piece without outer white space. Each key gets a
HyperLogLog sketch of the sites (``source``) that hold it; sketches merge by aggregation, first inside each task. A
key whose estimate lies clearly above ``MIN_SITES`` is boilerplate, one clearly below is not, and those near the
threshold (``BAND``) get exact distinct counts. Every copy of a boilerplate line goes but the first one (smallest
document id, nulls last, then smallest place), so what a site-wide notice says is kept once.

With ``passages``, a line of over ``PASSAGE_WORDS`` words is boilerplate too if it lies on two or more sites, or in
``PASSAGE_DOCS`` or more documents of one site; both are exact. The pipeline asks for that; the query ``op8_line_dedup``
has one threshold, as its SQL tells.

A line that a third of all documents hold meets its rows without a hot task: boilerplate lines are broadcast while they
are few, and beyond that the heaviest of them. Work within a document is linear in its lines.

Defined cases: lines of white space only are never boilerplate; a null text has no lines and stays null; a null site
counts as one site of its own; documents are told apart by id and text, so rows that share an id lose their own lines
only, and rows that repeat both keep or lose lines alike; a null id is an id like others, the last one; of documents
with one id the first copy stays in the one with the least text hash; a text is split whole, however long; an empty
table gives an empty result; other columns are kept by ``apply_removals`` and may have any names without a leading
``_ld``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.llm.shared import Workspace, join_few, settle

MIN_SITES = 10
PASSAGE_WORDS, PASSAGE_DOCS = 50, 10
BAND = 0.25
#: Bytes of a row when it is broadcast: a line's key and count; the same with a document.
KEY_BYTES, FOUND_BYTES = 32, 80
LG_K = 8
SPACES = "\t\n\x0b\x0c\r"


def _document(key: str, text: str) -> Column:
    """What tells documents apart, in the order of the first copies: ids with nulls last, then texts."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("text"))


def _exploded(docs: DataFrame, key: str, text: str, site: str, passages: bool = False) -> DataFrame:
    """A row for each line that is not blank: id, place, line hash, site hash; with ``passages`` whether it is a long one."""
    words = F.size(F.split(F.translate("_ld_line", SPACES, " " * len(SPACES)), " +"))
    long = [((F.length("_ld_line") > 2 * PASSAGE_WORDS) & (words > PASSAGE_WORDS)).alias("_ld_long")] if passages else []
    return (
        docs.select(_document(key, text).alias("_ld_id"), F.xxhash64(F.col(site)).alias("_ld_site"), F.posexplode(F.split(text, "\n")).alias("_ld_at", "_ld_line"))
        .withColumn("_ld_line", F.trim("_ld_line", F.lit(" " + SPACES)))
        .where("_ld_line != ''")
        .select("_ld_id", "_ld_at", F.xxhash64("_ld_line").alias("_ld_key"), "_ld_site", *long)
    )


def boilerplate(
    docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, passages: bool = False
) -> DataFrame:
    """Keys of boilerplate lines and the place of the copy that stays."""
    lines = _exploded(docs, key, text, site, passages)
    more = [F.max("_ld_long").alias("_long"), (F.min("_ld_site") < F.max("_ld_site")).alias("_two")] if passages else []
    spread = lines.groupBy("_ld_key").agg(F.hll_sketch_agg("_ld_site", LG_K).alias("_sketch"), F.min("_ld_id").alias("_ld_first"), F.count("*").alias("_rows"), *more)
    spread = spread.withColumn("_sites", F.hll_sketch_estimate("_sketch")).drop("_sketch")
    some, sure = F.col("_sites") >= min_sites * (1 - BAND), F.col("_sites") > min_sites * (1 + BAND)
    if passages:
        some, sure = some | (F.col("_long") & (F.col("_two") | (F.col("_rows") >= PASSAGE_DOCS))), sure | (F.col("_long") & F.col("_two"))
    spread = work.table(spread.where(some).withColumn("_sure", sure), "spread")
    near = spread.where("not _sure")
    counts, enough = [F.countDistinct("_ld_site").alias("_n")], F.col("_n") >= min_sites
    if passages:
        counts += [F.countDistinct("_ld_id").alias("_docs"), F.max("_ld_long").alias("_long")]
        enough = enough | (F.col("_long") & (F.col("_docs") >= PASSAGE_DOCS))
    exact = join_few(lines, near.select("_ld_key", "_rows"), "_ld_key", KEY_BYTES, "_rows").groupBy("_ld_key").agg(*counts).where(enough)
    known = spread.where("_sure").select("_ld_key", "_ld_first", "_rows")
    return work.table(known.unionByName(near.join(exact, "_ld_key", "left_semi").select("_ld_key", "_ld_first", "_rows")), "boilerplate")


def removals(
    docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, passages: bool = False
) -> DataFrame:
    """For each document (id and text) that loses lines: the places of those lines, in order."""
    found = boilerplate(docs, work, key, text, site, min_sites, passages)
    lines = _exploded(docs, key, text, site).select("_ld_id", "_ld_at", "_ld_key")
    hits = join_few(lines, found, "_ld_key", FOUND_BYTES, "_rows")
    # the first copy stays: the least place of the line within the first document; repeated rows give a place twice
    places = F.array_sort(F.collect_set("_ld_at"))
    per_line = hits.groupBy("_ld_id", "_ld_key").agg(places.alias("_at"), F.first("_ld_first").alias("_ld_first"))
    drop = F.when(F.col("_ld_first") == F.col("_ld_id"), F.expr("slice(_at, 2, size(_at))")).otherwise(F.col("_at"))
    per_doc = per_line.groupBy("_ld_id").agg(F.array_sort(F.flatten(F.collect_list(drop))).alias("_ld_drop"))
    return work.table(per_doc.where("size(_ld_drop) > 0"), "removals")


def _rest(text: Column, drop: Column) -> Column:
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.when(drop.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))


def apply_removals(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that ``removals`` lists, and the column ``_ld_removed``."""
    told = docs.withColumn("_ld_me", _document(key, text))
    # a row a document on either side, which grow alike: a merge join at every size
    both = told.join(gone.hint("merge"), F.col("_ld_me") == F.col("_ld_id"), "left").drop("_ld_me")
    return both.withColumns({text: _rest(F.col(text), F.col("_ld_drop")), "_ld_removed": F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long")}).drop("_ld_id", "_ld_drop")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, lines before, lines removed, hash of what is left (null text: empty)."""
    work = Workspace(docs.sparkSession, "linededup")
    with work:
        lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
        counted = docs.select(key, text, site, lines.alias("_ld_lines"))
        out = apply_removals(counted, removals(docs, work, key, text, site), key, text)
        return settle(out.select(key, F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("kept_sha256")))


#: The same rows in DuckDB SQL.
ORACLE_SQL = f"""
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS piece, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
), lines AS (
  SELECT doc_id, source, place, piece, trim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM pieces
), hot AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE line != '' GROUP BY line HAVING count(DISTINCT coalesce(source, '-')) >= {MIN_SITES}
), marked AS (
  SELECT l.*, h.line IS NOT NULL AND NOT (h.first_doc = l.doc_id AND row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY l.place) = 1) AS gone
  FROM lines l LEFT JOIN hot h ON l.line = h.line
)
SELECT doc_id, count(*) FILTER (line != '') AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(piece, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
