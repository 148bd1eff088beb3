"""Session-anchored sliding windows, trailing contexts and sampling gates.

Windows start at a session's first sample and repeat every step while they end by the last
sample plus the session's sampling interval. Which windows hold a row is arithmetic, so rows
are exploded to their windows; no range join is made.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_count(window_ms: int, step_ms: int) -> Column:
    return F.greatest(F.lit(0), F.floor((F.col("last_ms") + F.col("interval_ms") - F.col("first_ms") - window_ms) / step_ms) + 1).cast("bigint")


def window_grid(stats: DataFrame, window_ms: int, step_ms: int) -> DataFrame:
    """(session_id, window_start_ms, window_end_ms) of every window."""
    k = F.explode(F.when(F.col("k") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    starts = stats.withColumn("k", window_count(window_ms, step_ms)).select("session_id", "first_ms", k.alias("i")).withColumn("window_start_ms", F.col("first_ms") + F.col("i") * step_ms)
    return starts.select("session_id", "window_start_ms", (F.col("window_start_ms") + window_ms).alias("window_end_ms"))


def assign_windows(events: DataFrame, stats: DataFrame, window_ms: int, step_ms: int) -> DataFrame:
    """Events with window_start_ms and window_end_ms, one row for each window that holds the event."""
    at = F.col("timestamp_ms") - F.col("first_ms")
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((at - window_ms) / step_ms).cast("bigint") + 1)
    high = F.least(F.floor(at / step_ms).cast("bigint"), F.col("k") - 1)
    joined = events.join(stats.select("session_id", "first_ms", window_count(window_ms, step_ms).alias("k")), "session_id")
    held = joined.withColumn("_i", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("window_start_ms", F.col("first_ms") + F.col("_i") * step_ms)
    return held.withColumn("window_end_ms", F.col("window_start_ms") + window_ms).drop("_i", "first_ms", "k")


def assign_sliced(events: DataFrame, stats: DataFrame, window_ms: int, step_ms: int, slice_ms: int) -> DataFrame:
    """assign_windows for large sessions, with `slice`: the part of the session in which a window starts.

    Events are dealt by session and slice, and those behind a slice's end that its last windows still hold are
    copied to it. So a window's rows are in one task, and a session's rows are not; whoever groups by session, slice and
    window needs no further exchange. `stats`: a row for each of these sessions, sent to all tasks.
    """
    if slice_ms % step_ms:
        raise ValueError("a slice must be a number of steps")
    k = window_count(window_ms, step_ms).alias("k")
    at = F.col("timestamp_ms") - F.col("first_ms")
    least = F.greatest(F.lit(0).cast("bigint"), F.floor((at - window_ms) / step_ms).cast("bigint") + 1)
    most = F.least(F.floor(at / step_ms).cast("bigint"), F.col("k") - 1)
    each = slice_ms // step_ms
    joined = events.join(F.broadcast(stats.select("session_id", "first_ms", k)), "session_id").withColumns({"_low": least, "_high": most}).where("_low <= _high")
    copied = joined.withColumn("slice", F.explode(F.sequence(F.floor(F.col("_low") / each), F.floor(F.col("_high") / each))))
    # Windows are made behind the exchange.
    dealt = copied.repartition("session_id", "slice")
    own = F.sequence(F.greatest("_low", F.col("slice") * each), F.least("_high", (F.col("slice") + 1) * each - 1))
    held = dealt.withColumn("_i", F.explode(own)).withColumn("window_start_ms", F.col("first_ms") + F.col("_i") * step_ms)
    return held.withColumn("window_end_ms", F.col("window_start_ms") + window_ms).drop("_i", "_low", "_high", "first_ms", "k")


def with_contexts(rows: DataFrame, contexts_ms: list[int]) -> DataFrame:
    """Rows with context_ms, once for each trailing context of their window that holds them."""
    return rows.withColumn("context_ms", F.explode(F.array(*[F.lit(c).cast("bigint") for c in contexts_ms]))).where(F.col("timestamp_ms") >= F.col("window_end_ms") - F.col("context_ms"))


def quality_gate(rows: DataFrame, values: dict[str, str | tuple[str, ...]], contexts_ms: list[int], rates: dict[str, float] | None = None, max_gap_ms: int | None = None, of: tuple[str, ...] = ("session_id", "window_start_ms")) -> DataFrame:
    """(`of`, what names a window) of windows where every sensor has enough samples in every context, without long gaps.

    `rows`: with_contexts rows. `values`: sensor -> its column or columns; a sample counts if none is
    null. Without `rates` one sample is enough; gaps count to both edges of the context, a gap equal
    to the limit is good.
    """
    keys = [*of, "window_end_ms", "context_ms"]
    good, made = F.lit(True), []
    for sensor, value in values.items():
        some = reduce(and_, [F.col(c).isNotNull() for c in ((value,) if isinstance(value, str) else value)])
        own = F.when(some, F.col("timestamp_ms"))
        last = F.last(own, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("timestamp_ms").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn(f"_g_{sensor}", own - last)
        made += [F.count(own).alias(f"_n_{sensor}"), F.max(f"_g_{sensor}").alias(f"_m_{sensor}"), F.min(own).alias(f"_a_{sensor}"), F.max(own).alias(f"_z_{sensor}")]
        least = F.greatest(F.lit(1), F.ceil(F.col("context_ms") / 1000.0 * (rates or {}).get(sensor, 0.0)))
        good &= F.col(f"_n_{sensor}") >= least
        if max_gap_ms is not None:
            gap = F.greatest(F.coalesce(f"_m_{sensor}", F.lit(0)), F.col(f"_a_{sensor}") - (F.col("window_end_ms") - F.col("context_ms")), F.col("window_end_ms") - F.col(f"_z_{sensor}"))
            good &= F.coalesce(gap <= max_gap_ms, F.lit(False))
    each = rows.groupBy(*keys).agg(*made).withColumn("good", good)
    return each.groupBy(*of).agg(F.min("good").alias("good"), F.count(F.lit(1)).alias("c")).where(F.col("good") & (F.col("c") == len(contexts_ms))).select(*of)


def minimum_samples(rate: float, seconds: float) -> int:
    """Samples that a rate asks for in a window, 1 at least."""
    return max(1, math.ceil(rate * seconds))
