"""Session-level statistics and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_stats(events: DataFrame, step_ms: int) -> DataFrame:
    """(session_id, first_ms, last_ms, n, interval_ms): the interval is the truncated median of positive gaps, else the step."""
    order = Window.partitionBy("session_id").orderBy("timestamp_ms")
    gap = F.col("timestamp_ms") - F.lag("timestamp_ms").over(order)
    return events.select("session_id", "timestamp_ms", gap.alias("gap")).groupBy("session_id").agg(
        F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.floor(F.median(F.when(F.col("gap") > 0, F.col("gap")))).cast("bigint"), F.lit(step_ms).cast("bigint")).alias("interval_ms"),
    )


def large_sessions(events: DataFrame, most: int) -> DataFrame:
    """(session_id): sessions of more than `most` rows; no more of them than rows / most."""
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("session_id")


def sliced_stats(events: DataFrame, step_ms: int, slice_ms: int) -> DataFrame:
    """session_stats without a task that has a session whole: gaps are found within slices of time and between them.

    Gaps are counted by their length, so the median is that of counts; a session's different lengths meet in one task.
    """
    cut = events.select("session_id", "timestamp_ms", F.floor(F.col("timestamp_ms") / slice_ms).alias("_slice"))
    before = F.lag("timestamp_ms").over(Window.partitionBy("session_id", "_slice").orderBy("timestamp_ms"))
    within = cut.withColumn("gap", F.col("timestamp_ms") - before).where("gap > 0").select("session_id", "gap")
    ends = cut.groupBy("session_id", "_slice").agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("z"), F.count(F.lit(1)).alias("n"))
    across = ends.withColumn("gap", F.col("a") - F.lag("z").over(Window.partitionBy("session_id").orderBy("_slice"))).where("gap > 0").select("session_id", "gap")
    lengths = within.unionByName(across).groupBy("session_id", "gap").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("session_id")
    upto, all_ = F.sum("c").over(own.orderBy("gap")), F.sum("c").over(own)
    middle = lengths.withColumns({"upto": upto, "all": all_}).where("upto > (all - 1) DIV 2 AND upto - c <= all DIV 2")
    interval = middle.groupBy("session_id").agg(F.floor((F.min("gap") + F.max("gap")) / 2).cast("bigint").alias("interval_ms"))
    whole = ends.groupBy("session_id").agg(F.min("a").alias("first_ms"), F.max("z").alias("last_ms"), F.sum("n").alias("n"))
    return whole.join(interval, "session_id", "left").select("session_id", "first_ms", "last_ms", "n", F.coalesce("interval_ms", F.lit(step_ms).cast("bigint")).alias("interval_ms"))


def filter_duration(events: DataFrame, min_seconds: float, max_seconds: float) -> DataFrame:
    """Events of sessions whose length is within both bounds, inclusive."""
    seconds = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0
    kept = events.groupBy("session_id").agg(seconds.alias("s")).where(F.col("s").between(min_seconds, max_seconds))
    return events.join(kept, "session_id", "left_semi")


def pending(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events of sessions that `done` (session_id) doesn't have."""
    return events.join(done.select("session_id").distinct(), "session_id", "left_anti")


def status_counts(sessions: DataFrame, done: DataFrame, labels: DataFrame, min_seconds: float, max_seconds: float) -> DataFrame:
    """(status, sessions): already processed, ignored (no known label), filtered by duration, ingested."""
    marked = sessions.join(done.select("session_id", F.lit(1).alias("_d")).distinct(), "session_id", "left").join(labels.select("vehicle_type", F.lit(1).alias("_l")), "vehicle_type", "left")
    status = F.when(F.col("_d").isNotNull(), "already_processed").when(F.col("_l").isNull(), "ignored").when(~F.col("seconds").between(min_seconds, max_seconds), "duration_filtered").otherwise("ingested")
    return marked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("sessions"))
