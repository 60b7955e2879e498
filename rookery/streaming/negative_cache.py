"""Addresses that are gone, remembered for so long: keyed state with a time to live, driven by the stream's own clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GONE = ("404", "410", "empty")


class Gone(StatefulProcessor):
    """The state of an address: when it was last found gone. A later proof renews it, an answer clears it, trouble that may pass does neither; after `days` it is forgotten.

    Emits (url, state, at): 'gone' when an address enters, 'back' when it answers, 'forgotten' when its time is over.
    """

    def __init__(self, days: int):
        self.live_ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("at")
        known = self.at.get()[0] if self.at.exists() else None
        before = known
        for status, at in zip(frame["status"], frame["at"].astype("datetime64[ms]").astype("int64")):
            if status in GONE:
                known = int(at) if known is None else max(known, int(at))
            elif status == "ok" and (known is None or at >= known):
                known = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if known is None:
            self.at.clear()
        else:
            self.at.update((known,))
            self.handle.registerTimer(known + self.live_ms)
        if (before is None) != (known is None):
            yield pd.DataFrame({"url": [key[0]], "state": ["back" if known is None else "gone"], "at": [known or before]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        yield pd.DataFrame({"url": [key[0]], "state": ["forgotten"], "at": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def gone_boards(checks: DataFrame, days: int = 90, late: str = "1 hour") -> DataFrame:
    """(url, state, at in milliseconds) for each change of what is known of an address. `checks` has url, status and the time stamp at. Needs a state store that holds timers (RocksDB)."""
    named = checks.select(F.lower(F.regexp_replace("url", "/+$", "")).alias("url"), F.col("status").cast("string").alias("status"), "at").filter("url <> ''").withWatermark("at", late)
    return named.groupBy("url").transformWithStateInPandas(Gone(days), outputStructType="url string, state string, at long", outputMode="append", timeMode="EventTime")
