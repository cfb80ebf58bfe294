"""Behaviour gained, over a stream of package versions: keyed state instead of a window."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from packsieve.session import ship
from packsieve.streaming.state import use_rocksdb

OUT = "package string, version string, gained array<string>"
STATE = "digest string, markers array<string>"


def advance(last: tuple[str, list[str]] | None, rows: Iterable[tuple[str, str, list[str]]]) -> tuple[tuple[str, list[str]] | None, list[tuple[str, list[str]]]]:
    """The last changed snapshot (digest, markers) after versions (version, digest, markers), and what each of these gained."""
    out = []
    for version, digest, marks in sorted((v, d, sorted(m)) for v, d, m in rows):
        if last is None or digest != last[0]:
            gained = sorted(set(marks) - set(last[1])) if last else []
            if gained:
                out.append((version, gained))
            last = (digest, marks)
    return last, out


class Gained(StatefulProcessor):
    """One value a package: its last changed snapshot, which is forgotten ``ttl_ms`` after it was last written."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        was = self.last.get() if self.last.exists() else None
        last = (was[0], list(was[1])) if was else None
        told = ((v, d, list(m)) for f in rows for v, d, m in zip(f["version"], f["digest"], f["markers"], strict=True))
        last, out = advance(last, told)
        if last:
            self.last.update((last[0], last[1]))  # written even if unchanged: a package that is seen stays known
        yield pd.DataFrame([(key[0], v, g) for v, g in out], columns=["package", "version", "gained"])

    def close(self) -> None:
        pass


def gained_stream(versions: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (package, version, digest, markers) to a stream of gained markers; versions must arrive in order.

    With ``ttl_ms`` a package that is not seen for so long is forgotten, and its next version is a baseline again. A key
    costs one value of the state store. Times to live are of the clock, so batches without data go on for ever: a query that is
    to end with its input (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    ship(versions.sparkSession)
    use_rocksdb(versions.sparkSession)
    return versions.groupBy("package").transformWithStateInPandas(Gained(ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")
