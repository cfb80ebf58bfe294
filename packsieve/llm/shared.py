"""Joins that hold at any size, for rows whose keys are skewed, and the shared storage of the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.store import Workspace, settle, shared_dir  # noqa: F401

#: What is broadcast whole has at most so many bytes; of larger tables only the HOT heaviest keys are.
BROADCAST_BYTES, HOT = 8 << 20, 1000


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, to be broadcast if its rows of ``row_bytes`` each are within the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def join_few(many: DataFrame, few: DataFrame, on: str, row_bytes: int, weight: str) -> DataFrame:
    """Inner join of ``many`` rows with ``few``, which has a row a key and says how many rows of ``many`` have that key.

    Within the byte limit ``few`` is broadcast. Beyond it only the ``HOT`` heaviest keys are, so that none of the keys left
    to the shuffle join holds more than 1 / ``HOT`` of the rows.
    """
    if few.count() * row_bytes <= BROADCAST_BYTES:
        return many.join(F.broadcast(few), on)
    hot = few.orderBy(F.desc(weight), on).limit(HOT)
    cold = few.join(F.broadcast(hot.select(on)), on, "left_anti")
    return many.join(F.broadcast(hot), on).unionByName(many.join(cold.hint("merge"), on))


def attach_few(many: DataFrame, few: DataFrame, on: str, spread: str, weight: str) -> DataFrame:
    """Left join of ``many`` rows with ``few``, which has a row a key and grows with the data; ``weight`` is dropped.

    The ``HOT`` heaviest keys are broadcast. Rows of these, and of null keys, have their match already or need none: they
    are dealt by the hash of their column ``spread`` in the shuffle that the others go through.
    """
    names = [c for c in few.columns if c not in (on, weight)]
    hot = few.orderBy(F.desc(weight), on).limit(HOT).select(on, *[F.col(c).alias(f"_hot_{c}") for c in names], F.lit(True).alias("_hot"))
    cold = few.drop(weight).join(F.broadcast(hot.select(on)), on, "left_anti").withColumn("_salt", F.lit(0))
    apart = F.col("_hot").isNotNull() | F.col(on).isNull()
    salted = many.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(apart, F.pmod(F.xxhash64(spread), F.lit(1024)) + 1).otherwise(0).cast("int"))
    out = salted.join(cold.hint("merge"), [on, "_salt"], "left")
    return out.select(*many.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in names])


def text_key(text: str) -> Column:
    """128-bit digest of a text (null: empty)."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
