"""Actions held until their path has been quiet for some time, by the clock: no later event is needed to let the last one go."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SETTLED = "path string, action string, events long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settling(StatefulProcessor):
    """A path's last action (by ts and seq) and the number of its events, with a timer that each new event sets anew."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "action string, ts timestamp, seq long, events long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "seq"])
        action, ts, seq, events = new["action"].iloc[-1], new["ts"].iloc[-1].to_pydatetime(), int(new["seq"].iloc[-1]), len(new)
        if self.held.exists():
            before = self.held.get()
            self.handle.deleteTimer(before[4])
            events += before[3]
            if (before[1], before[2]) > (ts, seq):
                action, ts, seq = before[0], before[1], before[2]
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.held.update((action, ts, seq, events, due))
        self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        action, _, _, events, _ = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"path": [key[0]], "action": [action], "events": [events]})

    def close(self) -> None:
        pass


def settled(actions: DataFrame, quiet: float = 0.2) -> DataFrame:
    """On a stream of actions (ts, seq, action, path): path, action, events for each burst, once its path had no event for so
    many seconds. The state holds paths with an open burst alone. Start the query within rocks()."""
    own = actions.select("path", "ts", "seq", "action").groupBy("path")
    return own.transformWithStateInPandas(Settling(max(1, round(quiet * 1000))), SETTLED, "Update", "ProcessingTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in the store that timers need; the session's setting is as before at the end."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
