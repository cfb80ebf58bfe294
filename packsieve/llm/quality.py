"""Document quality rules with a distribution-divergence test, in SQL functions only.

Words are runs of characters other than U+0020 and U+0009 to U+000D. A document fails the base rules if it has fewer
than ``MIN_WORDS`` words, or if over 20 % of its words lie in five-word windows found twice or more in the text. The
divergence test compares a document's character-class and common-word histograms with those of its language, summed
over the whole corpus, by Jensen-Shannon distance. The word histogram has a bin for each common word of any language;
words that aren't common have a bin in languages that aren't listed only, as those may have no common words. A
document of a listed language without one common word has distance 1. The word threshold of a language comes from the
distribution of its distances in the whole corpus, less what sampling alone explains (``NOISE`` over the words counted,
as a square): the median and ``SPREAD`` times the way from the lowest tenth to the median. A document may lie over it by
``TAIL`` times its own noise, but never over ``MAX_WORD_DISTANCE``. The test is not applied to documents under
``GUARD_WORDS`` words or to languages with under ``GUARD_DOCS`` documents, a parameter of ``judge``.

Everything about one document is computed within its row, without a shuffle; only the histograms' sums per language
are aggregated. Languages other than those listed share one reference, so that table has a few rows.

Defined cases: a null text has no words; a null or unknown language counts as "other"; repeated rows are each judged;
a text is counted whole, however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.llm.shared import settle

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()[]{}-_/\\+=@^~`"
DIGITS = "0123456789"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
GUARD_WORDS = 50
GUARD_DOCS = 20
MAX_CHAR_DISTANCE = 0.30
#: Under the least distance between the references of two listed languages (0.80, es and fr on sf0.1).
MAX_WORD_DISTANCE = 0.78
MIN_WORD_CUT = 0.30
SPREAD = 4
#: Square of the distance expected of n words drawn from a reference of eight bins: 7 / (8 ln 2) / n.
NOISE, TAIL = 1.26, 4
#: Common words per language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for"],
    "fr": ["le", "la", "les", "des", "et", "que", "du", "une"],
    "de": ["der", "die", "und", "das", "den", "von", "mit", "ist"],
    "es": ["el", "los", "que", "las", "por", "con", "una", "del"],
}
COMMON = sorted({w for ws in COMMON_WORDS.values() for w in ws})
CLASSES = ["letters", "spaces", "symbols", "digits", "punctuation", "wide"]


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(df: DataFrame, words: str, out: str, size: int = 5) -> DataFrame:
    """Adds ``out``: how many words lie in ``size``-word windows that the array ``words`` holds twice or more."""
    # windows are compared by a 64-bit hash; only rows that hold an equal pair are sorted
    h = F.transform(
        F.expr(f"slice({words}, 1, greatest(size({words}) - {size - 1}, 0))"),
        lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, size)]),
    )
    df = df.withColumn("_h", h)
    has = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(has, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = F.filter(
        "_s",
        lambda e, j: F.coalesce(e["h"] == F.get(F.col("_s"), j - 1)["h"], F.lit(False))
        | F.coalesce(e["h"] == F.get(F.col("_s"), j + 1)["h"], F.lit(False)),
    )
    df = df.withColumn("_p", F.sort_array(F.transform(same, lambda e: e["i"])))
    gaps = F.transform(F.expr("slice(_p, 2, greatest(size(_p) - 1, 0))"), lambda p, j: F.least(F.lit(size), p - F.get(F.col("_p"), j)))
    total = F.aggregate(gaps, F.lit(size).cast("int"), lambda a, x: a + x)
    return df.withColumn(out, F.when(F.col("_p").isNull(), 0).otherwise(total).cast("long")).drop("_h", "_s", "_p")


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and histograms of every row, computed within the row."""
    known = F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise("other")
    df = docs.select(F.col(key), known.alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # one pass takes plain letters and spaces out; the other classes are counted in what is left
    df = df.withColumn("_rest", F.translate("_text", string.ascii_letters + " " + SPACES, ""))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_symbols": _count(F.col("_rest"), SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "spaces": (F.length("_text") - F.length(F.array_join("_words", ""))).cast("long"),
            "digits": _count(F.col("_rest"), DIGITS),
            "punctuation": _count(F.col("_rest"), PUNCTUATION),
            # bytes beyond one a character: how far a text is from plain letters of one byte
            "wide": (F.octet_length("_text") - F.length("_text")).cast("long"),
            "_chars": F.length("_text").cast("long"),
            "_common": F.filter("_words", lambda w: w.isin(*COMMON)),
        }
    )
    df = repeated_words(df, "_words", "n_repeat_words")
    rest = F.when(F.col("_lang") == "other", F.col("n_words") - F.size("_common")).otherwise(F.lit(0))
    bins = [F.size("_common") - F.size(F.array_remove("_common", w)) for w in COMMON]
    return df.select(
        key, "_lang", "n_words", (F.col("_chars") - F.col("spaces")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("_chars") - F.col("spaces") - F.col("n_symbols") - F.col("digits") - F.col("punctuation")).alias("letters"),
        "spaces", F.col("n_symbols").alias("symbols"), "digits", "punctuation", "wide",
        F.array(*[b.cast("long") for b in bins], rest.cast("long")).alias("_bins"), F.size("_common").alias("_n_common"),
    )


def _shares(columns: list[str], prefix: str) -> list[Column]:
    total = sum((F.col(prefix + c) for c in columns), F.lit(0)).cast("double")
    return [F.when(total > 0, F.col(prefix + c) / total).otherwise(0.0) for c in columns]


def js_distance(columns: list[str], left: str, right: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of columns with those prefixes."""
    out = F.lit(0.0)
    for p, q in zip(_shares(columns, left), _shares(columns, right), strict=True):
        for x in (p, q):
            out = out + F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0) / 2
    return F.sqrt(F.greatest(out, F.lit(0.0)))


def word_distance(bins: str, ref: str) -> Column:
    """Jensen-Shannon distance of two array columns of counts; 1 if only the first is empty, 0 if the second is."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    n, m = total(bins), total(ref)

    def part(x: Column, y: Column) -> Column:
        p, q = x / n, y / m
        one = lambda v: F.when(v > 0, v * F.log2(2 * v / (p + q))).otherwise(0.0) / 2
        return one(p) + one(q)

    out = F.aggregate(F.zip_with(bins, ref, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(m == 0, 0.0).when(n == 0, 1.0).otherwise(F.sqrt(F.greatest(out, F.lit(0.0))))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", guard_docs: int = GUARD_DOCS) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, the two distances and kept. A language needs ``guard_docs`` documents of
    ``GUARD_WORDS`` words for a reference: below that the sums say more about single documents than about the language, so
    none of its documents is judged by its distances."""
    counts = settle(base_counts(docs, key, text, lang))
    enough = F.col("n_words") >= GUARD_WORDS
    refs = counts.where(enough).groupBy(F.col("_lang").alias("_ref")).agg(
        F.count("*").alias("_docs"), *[F.sum(c).alias(f"ref_{c}") for c in CLASSES],
        F.array(*[F.sum(F.get("_bins", F.lit(k))) for k in range(len(COMMON) + 1)]).alias("_ref_bins"),
    )
    # a row for each listed language and one for all others, at most
    both = counts.join(F.broadcast(refs), F.col("_lang") == F.col("_ref"), "left")
    guarded = enough & (F.coalesce("_docs", F.lit(0)) >= guard_docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    both = both.withColumns(
        {
            "base_failed": failed,
            "js_chars": F.when(guarded, js_distance(CLASSES, "", "ref_")).otherwise(0.0),
            "js_words": F.when(guarded, word_distance("_bins", "_ref_bins")).otherwise(0.0),
        }
    )
    # distances are counted in steps of 0.001: the percentiles are exact and their state is bounded
    n = F.when(F.col("_lang") == "other", F.col("n_words")).otherwise(F.col("_n_common"))
    beyond = F.sqrt(F.greatest(F.lit(0.0), F.col("js_words") * F.col("js_words") - NOISE / n))
    spread = both.where(guarded & (n > 0)).groupBy(F.col("_lang").alias("_of")).agg(F.percentile(F.round(beyond, 3), F.array(F.lit(0.1), F.lit(0.5))).alias("_q"))
    low, mid = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    cuts = spread.select("_of", F.greatest(F.lit(MIN_WORD_CUT), mid + SPREAD * (mid - low)).alias("_cut"))
    both = both.join(F.broadcast(cuts), F.col("_lang") == F.col("_of"), "left")
    cut = F.when(n > 0, F.least(F.lit(MAX_WORD_DISTANCE), F.sqrt(F.col("_cut") * F.col("_cut") + TAIL * NOISE / n)))
    cut = F.coalesce(cut, F.lit(MAX_WORD_DISTANCE))
    kept = ~F.col("base_failed") & (F.col("js_chars") <= MAX_CHAR_DISTANCE) & (F.col("js_words") <= cut)
    return both.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "js_chars", "js_words"
    )
