"""Keyed state over batches, restarts and time."""

import datetime
import time

import pandas as pd

from packsieve.streaming import feed, provenance

VERSIONS = "package string, version string, digest string, markers array<string>"
TARGETS = "transaction string, name string, at timestamp"


def test_advance():
    assert provenance.advance(None, [("1", "a", ["npm"])]) == (("a", ["npm"]), [])
    last, out = provenance.advance(("a", ["npm"]), [("3", "b", ["npm", "eval"]), ("2", "a", ["npm"])])
    assert out == [("3", ["eval"])] and last == ("b", ["eval", "npm"])
    assert provenance.advance(last, [("4", "b", ["npm"])]) == (last, []) and provenance.advance(None, []) == (None, [])


def run(spark, where, ttl=None):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not ttl).lower())  # else a stream with times to live never ends
    source = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    q = provenance.gained_stream(source, ttl).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination(90)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    return sorted((r.package, r.version, r.gained) for r in spark.read.parquet(f"{where}/out").collect())


def test_gained_over_batches_and_restarts(spark, tmp_path):
    add = lambda *rows: spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(("p", "1", "a", ["npm"]), ("q", "1", "x", []))
    add(("p", "3", "b", ["npm", "eval"]), ("p", "2", "a", ["npm"]))
    assert run(spark, tmp_path) == [("p", "3", ["eval"])]
    add(("p", "4", "b", ["npm", "eval"]), ("q", "2", "y", ["bun"]))  # a new query goes on from the stored state
    add(("p", "5", "c", ["curl-net"]))
    assert run(spark, tmp_path) == [("p", "3", ["eval"]), ("p", "5", ["curl-net"]), ("q", "2", ["bun"])]


def test_gained_forgets(spark, tmp_path):
    """A package that was not seen for its time to live starts anew."""
    add = lambda *rows: spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(("p", "1", "a", ["npm"]), ("q", "1", "a", ["npm"]))
    assert run(spark, tmp_path, 15_000) == []
    time.sleep(16)
    add(("p", "2", "b", ["npm", "eval"]))
    assert run(spark, tmp_path, 15_000) == []
    add(("p", "3", "c", ["npm", "eval", "bun"]))
    assert run(spark, tmp_path, 15_000) == [("p", "3", ["bun"])]


def test_transactions_over_batches(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    add = lambda *rows: spark.createDataFrame([(t, n, at(s)) for t, n, s in rows], TARGETS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    verdicts = lambda: spark.createDataFrame([("a", "proceed"), ("b", "warn"), ("c", "abort")], "name string, outcome string")

    def go():
        source = spark.readStream.schema(TARGETS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        feed.session_outcomes(source, verdicts, f"{tmp_path}/out", f"{tmp_path}/state", gap_ms=10_000).awaitTermination(90)
        told = lambda x: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/{x}").drop("batch").collect())
        return told("outcomes"), told("late")

    add(("t1", "a", 0), ("t2", "a", 1), ("t3", "a", 2))
    add(("t1", "b", 5), ("t1", "a", 6))  # the rest of t1 comes in another batch
    assert go() == ([], [])
    add(("t4", "x", 14))  # the watermark passes t2 and t3, not t1
    assert go() == ([("t2", 1, "proceed"), ("t3", 1, "proceed")], [])
    add(("t1", "c", 15), ("t2", "c", 15))  # t1 is still open, t2 is closed: its target is late
    add(("t5", "a", 60))
    outcomes, late = go()
    assert outcomes == [("t1", 3, "abort"), ("t2", 1, "proceed"), ("t3", 1, "proceed"), ("t4", 1, "abort")] and late == [("t2", "c", "abort")]
    assert go() == (outcomes, late)  # a restart without input gives nothing twice


class Held:
    """What a bucket's step sees of its state."""

    def __init__(self, get=None, now=0, out=False):
        self.get, self.exists, self.now, self.hasTimedOut = get, get is not None, now, out

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        self.at = at

    def remove(self):
        self.get, self.exists = None, False


def test_one_call_serves_a_bucket():
    step, rows = feed._sessions(10, 100), pd.DataFrame({"transaction": ["p", "q", None, "p"], "name": ["b", "a", "a", "a"], "ms": [1, 2, 50, 3]})
    first = Held()
    assert list(step((0,), [rows], first)) == [] and first.at == 12
    due = Held(first.get, 40, True)
    assert [tuple(r) for f in step((0,), [], due) for r in f.itertuples(index=False)] == [("p", ["a", "b"], False), ("q", ["a"], False)] and due.at == 60
    again = Held(due.get, 41)
    assert [tuple(r) for f in step((0,), [rows[:1]], again) for r in f.itertuples(index=False)] == [("p", ["b"], True)]
    gone = Held(again.get, 1000, True)
    assert len(list(step((0,), [], gone))) == 1 and gone.exists  # the one without a name is closed now
    assert list(step((0,), [], last := Held(gone.get, 2000, True))) == [] and not last.exists
