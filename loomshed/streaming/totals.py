"""Running totals per user, as an example of state that no built-in aggregate keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State processors need a store that keeps several variables per key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total of each user in every batch that has rows of theirs."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


class Totals(StatefulProcessor):
    """n and total of each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n bigint, total double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, total = self.state.get() or (0, 0.0)
        for r in rows:
            n, total = n + 1, total + (r.value or 0.0)
        self.state.update((n, total))
        yield Row(user_id=key[0], n=n, total=total)

    def close(self) -> None:
        pass


def processed_totals(events: DataFrame) -> DataFrame:
    """running_totals by transformWithState, rows in batches over all keys instead of a table for each; the session's state store becomes RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.select("user_id", "value").groupBy("user_id").transformWithState(Totals(), "user_id bigint, n bigint, total double", "update", "none")
