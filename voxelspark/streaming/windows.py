"""Counts of events by windows of their time, and the timings of a stream's phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_counts(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """start of the window of ``length``, event_type, and the numbers of events and of users, of a table or a stream (ts, event_type, user_id). In a stream, events up to ``late`` behind the latest are waited for, and users are counted approximately."""
    events = events.withWatermark("ts", late) if late else events
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    counted = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "users")


def session_counts(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """start, end, user_id, and the numbers of events and clicks of each session of a table or a stream (ts, event_type, user_id): a user's events without a pause of ``gap`` or more. In a stream, sessions that an event joins together are merged, events up to ``late`` behind the latest are waited for, and later ones are left out."""
    events = events.withWatermark("ts", late) if late else events
    counted = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "clicks")


def phase_timings(query: StreamingQuery) -> list[tuple[int, str, int]]:
    """(batch, phase, milliseconds) of the latest batches of a stream, as it reports them."""
    return [(p["batchId"], phase, ms) for p in query.recentProgress for phase, ms in sorted(p["durationMs"].items())]
