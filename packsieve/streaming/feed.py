"""Transactions of a package manager as a stream: targets come in, one outcome per transaction goes out."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from packsieve.operators import gates
from packsieve.session import ship
from packsieve.streaming.state import use_rocksdb


def outcomes(targets: DataFrame, verdicts: Callable[[], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Judge each batch of ``targets`` (transaction, name) against the verdict table as it is then, and append (transaction,
    n_targets, outcome) to Parquet at ``sink``. A transaction's targets arrive together.

    Batches are written below their number, so that one which is repeated after a failure replaces what it wrote.
    """

    def judge(batch: DataFrame, number: int) -> None:
        gates.transaction(batch, verdicts()).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return targets.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSION_OUT = "transaction string, names array<string>, late boolean"
#: ``held``: what is known of a bucket's transactions, as JSON: its targets, when its time is over, whether it is closed.
SESSION_STATE = "held string"
#: Buckets to which transactions are dealt; fixed for a checkpoint.
BUCKETS = 1024


def _sessions(gap_ms: int, keep_ms: int):
    """A bucket of transactions. Each has its targets so far, until no target has come for ``gap_ms`` of event time; then it is
    closed, once, and remembered as closed for ``keep_ms`` more, so that late targets are told apart.

    A call costs milliseconds whatever it is given, so one call serves all transactions of a bucket."""

    def step(key, rows, state):
        held = {t: x for t, *x in json.loads(state.get[0])} if state.exists else {}
        now, out = state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            fresh: dict[str, tuple[list[str], int]] = {}
            for f in rows:
                for t, n, ms in zip(f["transaction"].tolist(), f["name"].tolist(), f["ms"].tolist(), strict=True):
                    names, last = fresh.get(t, ([], 0))
                    names.append(str(n))
                    fresh[t] = names, max(last, ms)
            for t, (came, last) in fresh.items():
                names, until, closed = held.get(t, ([], 0, False))
                if closed:
                    out.append((t, sorted(came), True))
                else:
                    held[t] = sorted({*names, *came}), max(until, last + gap_ms), False
        for t, (names, until, closed) in list(held.items()):
            if until < now and closed:
                del held[t]
            elif until < now:
                out.append((t, names, False))
                held[t] = [], until + keep_ms, True
        if held:
            state.update((json.dumps([(t, *x) for t, x in held.items()]),))
            state.setTimeoutTimestamp(max(min(x[1] for x in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["transaction", "names", "late"])

    return step


def sessions(targets: DataFrame, gap_ms: int, delay: str = "0 seconds", keep_ms: int = 86_400_000) -> DataFrame:
    """(transaction, names, late) of a stream of targets (transaction, name, at), whatever batches they come in.

    A transaction gives one row with all its targets once the watermark, ``delay`` behind the latest event, is ``gap_ms``
    past its last target. Targets of a closed transaction, and those that are behind the watermark when they come, belong to
    no outcome: the former are rows with ``late`` set. What is known of a transaction goes after ``keep_ms``; the
    state has one value for each of ``BUCKETS`` buckets of transactions.
    """
    ship(targets.sparkSession)
    use_rocksdb(targets.sparkSession)
    told = targets.select(F.col("transaction").cast("string").alias("transaction"), F.col("name").cast("string").alias("name"), "at").withWatermark("at", delay)
    rows = told.withColumn("ms", F.unix_millis("at")).withColumn("bucket", F.pmod(F.xxhash64("transaction"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").applyInPandasWithState(_sessions(gap_ms, keep_ms), SESSION_OUT, SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_outcomes(targets: DataFrame, verdicts: Callable[[], DataFrame], sink: str, checkpoint: str, gap_ms: int, delay: str = "0 seconds", keep_ms: int = 86_400_000) -> StreamingQuery:
    """Judge each closed transaction of ``sessions`` against the verdict table as it is then: (transaction, n_targets,
    outcome) as Parquet below ``sink``/outcomes. A late target was never judged, so it is an outcome ``abort`` below
    ``sink``/late. Batches that are repeated after a failure replace what they wrote."""

    def judge(batch: DataFrame, number: int) -> None:
        names = F.explode("names").alias("name")
        batch = batch.persist()  # else each of the two would run the state again
        gates.transaction(batch.where("not late").select("transaction", names), verdicts()).write.mode("overwrite").parquet(f"{sink}/outcomes/batch={number}")
        batch.where("late").select("transaction", names, F.lit("abort").alias("outcome")).write.mode("overwrite").parquet(f"{sink}/late/batch={number}")
        batch.unpersist()

    return sessions(targets, gap_ms, delay, keep_ms).writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
