"""Event time: windows in batch and the same results from streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sessions import sessions
from ..sources.tables import scratch, table
from ..streaming.replay import collected, event_stream, filed, replayed, restarted
from . import query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def time_tumbling(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""
    SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR])::TIMESTAMP AS start FROM events) GROUP BY ALL
""")
def time_sliding(spark, d):
    """Windows of two hours that begin each hour: a row lies in two."""
    w = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_SESSIONS = """
    SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (
      SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT user_id, ts, CASE WHEN ts {} lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events))
    GROUP BY user_id, session
"""


@query(_SESSIONS.format(">="))
def time_session(spark, d):
    w = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return w.select("user_id", "first", "last", "n")


@query(_SESSIONS.format(">"))
def time_session_by_gap(spark, d):
    return sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes", bucket="5 days").select("user_id", "first", "last", "n")


@query("""
    SELECT hour, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts))::TIMESTAMP FROM events), (SELECT max(ts) FROM events), INTERVAL 1 HOUR)) AS hour)
    LEFT JOIN (SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS h, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) ON h = hour
""")
def time_gap_fill(spark, d):
    """Every hour from the first event's to the last, those without an error too."""
    hours = table(spark, d, "events").agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b")).select(F.explode(F.expr("sequence(a, b, INTERVAL 1 HOUR)")).alias("hour"))
    n = table(spark, d, "events").where("event_type = 'error'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """Complete mode: all windows as they stand after the last batch."""
    w = event_stream(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return collected(w, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    SELECT start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1)
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def stream_append(spark, d):
    """Append mode: only windows that the watermark has closed."""
    w = event_stream(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return collected(w, "append").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, d):
    """Every row sent twice; the second is dropped within the watermark."""
    e = event_stream(spark, d).select("event_id", "user_id", "ts")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return collected(twice.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "append")


@query("SELECT event_type, r_name, count(*) AS n FROM events JOIN region ON user_id % 5 = r_regionkey GROUP BY ALL")
def stream_static_join(spark, d):
    r = table(spark, d, "region")
    j = event_stream(spark, d).join(r, F.col("user_id") % 5 == F.col("r_regionkey")).groupBy("event_type", "r_name").agg(F.count("*").alias("n"))
    return collected(j, "complete")


@query("""
    SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE
""")
def stream_interval_join(spark, d):
    """Two streams whose rows wait for each other no longer than the interval and the watermarks need."""
    e = lambda kind, name: event_stream(spark, d).where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", "10 minutes")
    near = F.expr("view_user = click_user AND click_ts > view_ts AND click_ts <= view_ts + INTERVAL 30 MINUTES")
    return collected(e("view", "view").join(e("click", "click"), near).select("view_id", "click_id"), "append")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_custom_state(spark, d):
    """State of one's own: running totals per user, the last of each."""
    from ..streaming.totals import running_totals

    last = collected(running_totals(event_stream(spark, d)), "update")
    return last.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_foreach_batch(spark, d):
    """Batches written one by one by a function, each exactly once."""
    return collected(event_stream(spark, d).select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
    SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR])::TIMESTAMP AS start FROM events) GROUP BY start
""")
def stream_sliding(spark, d):
    w = event_stream(spark, d).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return collected(w, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, first, n FROM (" + _SESSIONS.format(">=") + ") WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_session(spark, d):
    """Append mode: sessions that the watermark has closed."""
    w = event_stream(spark, d).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    return collected(w, "append").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_update(spark, d):
    """Update mode puts out each group that a batch has changed; the last of them is how it stands."""
    u = collected(event_stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), "update")
    return u.groupBy("event_type").agg(F.max("n").alias("n"))


@query("SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_type = 'error'")
def stream_enrich(spark, d):
    """Rows of a stream beside a fixed table, without state."""
    e = event_stream(spark, d).where("event_type = 'error'")
    return collected(e.join(table(spark, d, "nation"), F.col("user_id") % 25 == F.col("n_nationkey")).select("event_id", "n_name"), "append")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_state_processor(spark, d):
    """The same totals by a state processor, whose state lies in RocksDB."""
    from ..streaming.totals import processed_totals

    last = collected(processed_totals(event_stream(spark, d)), "update")
    return last.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*) AS n FROM events WHERE event_type <> 'error' AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_late(spark, d):
    """Errors come only after all else, too late for their windows: the watermark drops them."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = e.agg(F.max("ts")).scalar()
    on_time = e.where((F.col("event_type") != "error") & (F.col("ts") < end - F.expr("INTERVAL 2 HOURS")))
    late = e.where((F.col("event_type") == "error") & (F.col("ts") < end - F.expr("INTERVAL 8 HOURS")))
    # the last event of all moves the watermark on before the late ones come
    parts = [on_time, e.where(F.col("ts") == end), e.where(F.col("ts") == end), late, e.where(F.col("ts") == end)]
    w = replayed(spark, [p.select("event_id", "ts") for p in parts]).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return collected(w, "append").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
    SELECT start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1)
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def stream_restart(spark, d):
    """The driver is lost in two batches, each written but not committed; state and offsets come from the checkpoint, and no window is counted twice."""
    twice = event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    w = twice.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return restarted(w, "append", (1, 2))[0].select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, event_type FROM events WHERE value > 10")
def stream_file_sink(spark, d):
    """Spark's file sink, started again from its checkpoint: each row once."""
    return filed(event_stream(spark, d).where("value > 10").select("event_id", "event_type"), runs=2)


@query("SELECT user_id, first, last, n FROM (" + _SESSIONS.format(">=") + ") WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_session_timers(spark, d):
    """Sessions by a state processor: map state for those that are open, timers in event time that close them."""
    from ..streaming.timers import timed_sessions

    found = collected(timed_sessions(event_stream(spark, d)), "append")
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")), "n")


@query("SELECT event_id, user_id, value FROM events")
def stream_python_source(spark, d):
    """A stream out of a source in Python whose offsets are its ledger's entries."""
    from ..sources import ledger

    ledger.register(spark)
    e, path = table(spark, d, "events").select("event_id", "user_id", "value"), scratch(spark, "ledger")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).write.format("ledger").mode("append").save(path)
    return collected(spark.readStream.format("ledger").option("schema", "event_id bigint, user_id bigint, value double").load(path), "append")
