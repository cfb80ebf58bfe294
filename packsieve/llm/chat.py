r"""Chat formatting with a grammar round trip, in SQL functions only.

A conversation is a sequence of turns, each ``### <label>: <text>`` up to a line ``</turn>``::

    ### User: What is it?
    </turn>
    ### Assistant: A test.
    </turn>

Labels are ``System``, ``User`` and ``Assistant``; any other role is ``@`` with its URL encoding, a null one ``@`` alone.
Control strings are ``### <label>: `` and ``</turn>``, with any number of backslashes in front. The parser cuts at
``</turn>`` lines without a backslash, takes the label off each piece, refuses control strings without a backslash in what
is left, and takes one backslash off each of the others.

Rendering starts with the texts as they are. The result is parsed and the turns found are compared with the source;
turns whose text alone does not come back get a backslash before each control string, and the result is parsed again. A
line break parts a text from what ends it, so this always suffices; a conversation that still differed would end the job.

Defined cases: a null text is empty; a null role is an empty one; turns go by their number, nulls first, then role and
text; repeated rows are turns of their own; rows without a conversation id are one conversation, as GROUP BY has it; an
empty table gives no rows; other columns are ignored. A conversation is one value and has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role, its label.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
LABEL = r"(?:System|User|Assistant|@[A-Za-z0-9.*_%+-]*)"
CONTROL = rf"(?:### {LABEL}: |</turn>)"
END = "\n</turn>\n"
LEARNED = "assistant"


def label(role: Column) -> Column:
    out = F.concat(F.lit("@"), F.url_encode(role))
    for k, v in LABELS.items():
        out = F.when(role == k, v).otherwise(out)
    return out


def role_of(name: Column) -> Column:
    out = F.url_decode(F.substr(name, F.lit(2)))
    for k, v in LABELS.items():
        out = F.when(name == v, k).otherwise(out)
    return out


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def head(turn: Column) -> Column:
    return F.concat(F.lit("### "), label(turn["role"]), F.lit(": "))


def render(turns: Column) -> Column:
    """The text of an array of turns (role, text), as they are."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text, start, size) of a formatted conversation; null where the grammar does not hold. ``start`` and
    ``size`` are of the text as it stands in ``formatted``, in code points."""
    pieces = F.split(formatted, r"(?<!\\)</turn>\n", -1)
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    name = lambda p: F.substr(F.substring_index(p, ": ", 1), F.lit(5))
    raw = F.transform(body, lambda p: F.struct(name(p).alias("label"), F.length(name(p)).alias("n"), F.length(p).alias("size"), p.alias("piece")))
    cut = F.transform(raw, lambda p: F.struct(role_of(p["label"]).alias("role"), F.substr(p["piece"], p["n"] + 7, p["size"] - p["n"] - 7).alias("raw"), (p["size"] - p["n"] - 7).alias("size"), (p["n"] + 6).alias("head")))
    whole = F.forall(body, lambda p: p.rlike(rf"\A### {LABEL}: ") & F.endswith(p, F.lit("\n")))
    good = (F.element_at(pieces, -1) == "") & whole & ~F.exists(cut, lambda t: t["raw"].rlike(rf"(?<!\\){CONTROL}"))
    # where each text starts: the lengths of all before it
    begin = F.aggregate(
        cut, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, t: F.struct((a["at"] + t["head"] + t["size"] + len(END)).alias("at"), F.concat(a["starts"], F.array(a["at"] + t["head"])).alias("starts")),
        lambda a: a["starts"],
    )
    turns = F.zip_with(cut, begin, lambda t, s: F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text"), s.alias("start"), t["size"].alias("size")))
    return F.when(good, turns)


def _told(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _alone(turn: Column) -> Column:
    """Whether a text comes back from a turn of its own."""
    back = _told(parse(render(F.array(turn))))
    return F.coalesce(back == F.array(turn), F.lit(False))


def conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): the turns of each conversation in order, as an array of (role, text)."""
    told = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    per = rows.select(F.col(key).alias(key), told.alias("_turn")).groupBy(key).agg(F.array_sort(F.collect_list("_turn")).alias("_all"))
    return per.select(key, _told(F.col("_all")).alias("turns"))


def format_turns(per: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns, formatted, rounds, parsed) of conversations (key, turns): ``formatted`` parses to ``turns``, ``rounds``
    is 0 where nothing had to be escaped, ``parsed`` is what the parser reads from ``formatted``."""
    first = per.select(key, "turns", render(F.col("turns")).alias("_plain"))
    first = first.withColumn("_back", parse(F.col("_plain")))
    first = first.withColumn("_same", F.coalesce(_told(F.col("_back")) == F.col("turns"), F.lit(False)))
    conflicts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.when(_alone(t), t["text"]).otherwise(escape(t["text"])).alias("text")))
    second = first.withColumn("formatted", F.when(F.col("_same"), F.col("_plain")).otherwise(render(conflicts)))
    second = second.withColumn("parsed", F.when(F.col("_same"), F.col("_back")).otherwise(parse(F.col("formatted"))))
    proof = F.when(F.coalesce(_told(F.col("parsed")) == F.col("turns"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse to its turns")))
    return second.select(key, "turns", proof.alias("formatted"), F.when(F.col("_same"), 0).otherwise(1).alias("rounds"), "parsed")


def spans(parsed: Column) -> Column:
    """The loss mask: (start, size) of each assistant text in the formatted conversation, in code points."""
    return F.transform(F.filter(parsed, lambda t: t["role"] == LEARNED), lambda t: F.struct((t["start"]).alias("start"), t["size"].alias("size")))


def masked(formatted: Column, mask: Column) -> Column:
    """All text under a loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["size"]))), "")


def report(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    done = format_turns(conversations(rows, key), key).withColumn("loss_mask", spans(F.col("parsed")))
    learned = masked(F.col("formatted"), F.col("loss_mask"))
    out = done.select(key, "parsed", "formatted", "rounds", learned.alias("_learned"))
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        key, F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("rounds").alias("escape_rounds"),
    )


#: Fixed value: the conversation that the query adds, as (turn, role), with its text.
ADDED, ADDED_TEXT = [(0, "user"), (1, "assistant")], r"\### Assistant: </turn> ok"


def with_added(rows: DataFrame) -> DataFrame:
    more = rows.sparkSession.createDataFrame([(-7, t, r, ADDED_TEXT) for t, r in ADDED], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more)


#: The same rows in DuckDB SQL.
ORACLE_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{ADDED_TEXT}'
), told AS (
  SELECT *, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '@' || url_encode(role) END || ': ' AS head,
    regexp_replace(text, '(\\*(### (System|User|Assistant|@[A-Za-z0-9.*_%+-]*): |</turn>))', '\\\1', 'g') AS escaped FROM rows
), per AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned, sum(length(head || escaped) + 9)::BIGINT AS formatted_chars,
    max((escaped != text)::INTEGER) AS escape_rounds
  FROM told GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, escape_rounds FROM per
"""
