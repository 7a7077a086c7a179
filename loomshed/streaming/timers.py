"""Sessions of one's own: state of several open stretches per key, closed by a timer in event time.

Each look at the state is a message to the JVM, so a key has one value with all its open sessions, and one timer, for the first of
them that ends: a batch costs a key a few messages, however many sessions it opens and closes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .totals import PROVIDER

OUT = "user_id bigint, first bigint, last bigint, n bigint"


class Sessions(StatefulProcessor):
    """Open sessions of a key in order; rows may come in any order that the watermark allows. Moments are microseconds."""

    def __init__(self, minutes: int):
        self.gap = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first array<bigint>, last array<bigint>, n array<bigint>, timer bigint")

    def due(self, last: int) -> int:
        """Milliseconds by which no row can lengthen a session any more."""
        return -(-(last + self.gap) // 1000)

    def store(self, sessions: list[tuple[int, int, int]], timer: int | None) -> None:
        """timer: the one that is set, if any."""
        if not sessions:
            self.open.clear()
            return
        wanted = min(self.due(x[1]) for x in sessions)
        if timer not in (None, wanted):
            self.handle.deleteTimer(timer)
        if timer != wanted:
            self.handle.registerTimer(wanted)
        self.open.update((*(list(x) for x in zip(*sessions, strict=True)), wanted))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.open.get()
        before = list(zip(*state[:3], strict=True)) if state else []
        after: list[tuple[int, int, int]] = []
        for first, last, n in sorted([*before, *((r.moment, r.moment, 1) for r in rows)]):
            if after and first < after[-1][1] + self.gap:
                after[-1] = (after[-1][0], max(last, after[-1][1]), after[-1][2] + n)
            else:
                after.append((first, last, n))
        self.store(after, state[3] if state else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All that the watermark has passed, beside what the timer was set for; the timer itself is gone after this."""
        state, passed = self.open.get(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        sessions = list(zip(*state[:3], strict=True)) if state else []
        self.store([x for x in sessions if self.due(x[1]) > passed], None)
        for first, last, n in sessions:
            if self.due(last) <= passed:
                yield Row(user_id=key[0], first=first, last=last, n=n)

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """user_id, first, last, n of each session that the watermark has passed: a session ends `minutes` after its last row. Rows without a time are in none. The session's time zone has to be UTC."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("ts is not null").select("user_id", "ts", F.unix_micros("ts").alias("moment")).withWatermark("ts", delay)
    found = rows.groupBy("user_id").transformWithState(Sessions(minutes), OUT, "append", "eventTime")
    return found.select("user_id", *(F.timestamp_micros(c).alias(c) for c in ("first", "last")), "n")
