"""Late rows, lost batches, timers, and the source in Python."""

from __future__ import annotations

from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomshed.sources import ledger
from loomshed.sources.tables import scratch
from loomshed.streaming.replay import collected, event_stream, filed, restarted
from loomshed.streaming.timers import Sessions, timed_sessions
from loomshed.streaming.totals import Totals


def test_late_rows_are_dropped(spark):
    path, t = scratch(spark, "late"), datetime(2024, 1, 1)
    batches = [[(1, 0), (2, 5)], [(3, 120)], [(7, 121)], [(4, 1), (5, 119)], [(6, 300)]]
    for rows in batches:
        spark.createDataFrame([(i, t + timedelta(minutes=m)) for i, m in rows], "id int, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    counts = collected(stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")), "append")
    got = {(r.window.start - t) // timedelta(hours=1): r.n for r in counts.collect()}
    # a batch is held against the watermark of the one before: row 4 is two hours late, row 5's window is open yet
    assert got == {0: 2, 1: 1, 2: 2}


def parts(spark, batches):
    t, path = datetime(2024, 1, 1), scratch(spark, "parts")
    for rows in batches:
        spark.createDataFrame([(i, u, t + timedelta(minutes=m)) for i, u, m in rows], "id int, user_id bigint, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return t, spark.readStream.schema("id int, user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def test_lost_batches_are_run_again(spark):
    """State, offsets and rows are those of an unbroken run; a lost batch is written again under its number."""
    batches = [[(1, 1, 0), (2, 1, 5)], [(3, 1, 70), (1, 1, 0)], [(4, 2, 75)], [(5, 2, 300)], [(6, 2, 301)]]
    made = lambda s: s.withWatermark("ts", "30 minutes").groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n"))
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(collected(made(parts(spark, batches)[1]), "append"))
    got, order = restarted(made(parts(spark, batches)[1]), "append", (0, 2, 4))
    assert rows(got) == whole and len(whole) == 3
    assert order == [0, 0, 1, 2, 2, 3, 4, 4, *order[8:]] and order[8:] in ([], [5])
    assert restarted(made(parts(spark, batches)[1]), "append", ())[1] == sorted(set(order))


def test_own_errors_are_not_taken_for_losses(spark):
    stream = parts(spark, [[(1, 1, 0)]])[1].withColumn("bad", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(StreamingQueryException):
        restarted(stream, "append", (0,))


def test_sessions_closed_by_timers(spark):
    """Rows out of order that lengthen, join and open sessions; what is late or still open isn't put out."""
    t, stream = parts(spark, [[(1, 1, 0), (2, 1, 50), (3, 2, 10)], [(4, 1, 25), (5, 1, 51)], [(6, 1, 200), (7, 2, 36)], [(9, 3, 230)], [(8, 1, 1)], [(10, 1, 400)]])
    rows = collected(timed_sessions(stream, 30, "60 minutes"), "append").collect()
    got = sorted((r.user_id, (r.first - t).total_seconds() / 60, (r["last"] - t).total_seconds() / 60, r.n) for r in rows)
    # user 1: 0, 25, 50, 51 are joined by the row that came later; row 8 is late; 200 is closed by 400, as is user 3's
    assert got == [(1, 0, 51, 4), (1, 200, 200, 1), (2, 10, 36, 2), (3, 230, 230, 1)]


def test_ledger(spark):
    """Nothing of a failed write is read; nulls, empty tables, several writes, filters and a stream that goes on where it was."""
    ledger.register(spark)
    path, schema = scratch(spark, "ledger"), "id int, name string, at timestamp_ntz"
    rows = [(k, None if k % 3 == 0 else f"n{k}", datetime(2024, 1, 1) + timedelta(hours=k)) for k in range(20)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    read = lambda: spark.read.format("ledger").option("schema", schema).load(path)
    df.write.format("ledger").mode("append").save(path)
    assert sorted(map(str, read().collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="broken"):
        df.withColumn("id", F.when(F.col("id") == 19, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("id"))).write.format("ledger").mode("append").save(path)
    assert read().count() == 20
    df.limit(0).write.format("ledger").mode("append").save(path)
    df.where("id < 5").write.format("ledger").mode("append").save(path)
    assert read().count() == 25 and read().where("id >= 18 or name is null").count() == 10
    assert [r.id for r in read().where("id > 17 and name = 'n19'").collect()] == [19] and read().where("id in (1, 2)").select("name").count() == 4
    stream = spark.readStream.format("ledger").option("schema", schema).load(path)
    assert collected(stream, "append").count() == 25
    assert filed(stream, runs=3).count() == 25
    with pytest.raises(Exception, match="added to"):
        df.write.format("ledger").mode("overwrite").save(path)


def test_batches_follow_time(spark):
    """Ids that don't follow time make no row late; a row without a time stays."""
    folder, t = scratch(spark, "unordered"), datetime(2024, 1, 1)
    rows = [(k, t + timedelta(hours=h), 1, "view", 1.0) for k, h in enumerate([0, 9, 3, 30, 1, 20, 5, 40, 2, 12])] + [(10, None, 1, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    assert sorted(r.event_id for r in collected(event_stream(spark, folder).select("event_id"), "append").collect()) == list(range(11))
    found = collected(timed_sessions(event_stream(spark, folder)), "append").collect()
    assert sorted((r.first - t) // timedelta(hours=1) for r in found) == [0, 1, 2, 3, 5, 9, 12, 20, 30]


class Counted:
    """State and timers of one key, and how many messages went to them."""

    def __init__(self):
        self.value, self.timers, self.messages = None, set(), 0

    def getValueState(self, *_):
        return self

    def _said(self, f):
        self.messages += 1
        return f

    get = lambda self: self._said(self.value)
    update = lambda self, v: self._said(setattr(self, "value", v))
    clear = lambda self: self._said(setattr(self, "value", None))
    registerTimer = lambda self, t: self._said(self.timers.add(t))
    deleteTimer = lambda self, t: self._said(self.timers.remove(t))


def test_messages_do_not_grow_with_sessions():
    """A batch that opens 100 sessions, and a watermark that closes 60 of them, cost a few messages."""
    state, sessions, hour = Counted(), Sessions(30), 3_600_000_000
    sessions.init(state)
    list(sessions.handleInputRows((1,), iter([SimpleNamespace(moment=k * hour) for k in range(100)]), None))
    assert state.timers == {30 * 60_000} and state.messages <= 4
    state.timers.clear()  # Spark removes the timer that has expired
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 60 * 3_600_000, getExpiryTimeInMs=lambda: 30 * 60_000)
    out = list(sessions.handleExpiredTimer((1,), times, times))
    assert [r.first for r in out] == [k * hour for k in range(60)] and state.timers == {60 * 3_600_000 + 30 * 60_000} and state.messages <= 8
    list(sessions.handleInputRows((1,), iter([SimpleNamespace(moment=60 * hour + 60_000_000)]), None))
    assert state.timers == {60 * 3_600_000 + 31 * 60_000} and len(state.value[0]) == 40


def test_totals_ask_the_state_twice():
    state, totals = Counted(), Totals()
    totals.init(state)
    for values, want in (([1.0, None, 2.5], (3, 3.5)), ([4.0], (4, 7.5))):
        before = state.messages
        rows = list(totals.handleInputRows((1,), iter([SimpleNamespace(value=v) for v in values]), None))
        assert [(r.n, r.total) for r in rows] == [want] and state.messages - before == 2
