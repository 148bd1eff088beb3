"""Incremental ingest and feature building; a session is taken once, whole."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def _exists(spark: SparkSession, path: str) -> bool:
    fs, own = file_system(spark, path)
    return bool(fs.exists(own))


def processed_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct session ids of a dataset; one column is read. No dataset: none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "session_id string")
    return spark.read.parquet(path).where("session_id IS NOT NULL").select("session_id").distinct()


def append_new(batch: DataFrame, target: str, first_by: str | None = None) -> None:
    """Append the rows of sessions that the target lacks; of two files with one session the first name wins."""
    if first_by:
        files = batch.groupBy("session_id").agg(F.min(first_by).alias("_first"))
        batch = batch.join(files, "session_id").where(F.col(first_by) == F.col("_first")).drop("_first", first_by)
    batch.join(processed_sessions(batch.sparkSession, target), "session_id", "left_anti").write.mode("append").parquet(target)


def run_available(spark: SparkSession, in_dir: str, schema: StructType, target: str, checkpoint: str, form: str = "json", normalize: Callable[[DataFrame], DataFrame] | None = None, glob: str | None = None) -> None:
    """Take all files that came since the last run, append their new sessions, and stop; nothing at all so far is an error."""

    def each(batch: DataFrame, _: int) -> None:
        append_new(normalize(batch) if normalize else batch, target, "_file")

    reader = spark.readStream.schema(schema).format(form)
    stream = (reader.option("pathGlobFilter", glob) if glob else reader).load(in_dir).withColumn("_file", F.col("_metadata.file_path"))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if processed_sessions(spark, target).isEmpty():
        raise ValueError("ingestion produced no rows")


def build_pending(events: DataFrame, target: str, ledger: str, build: Callable[[DataFrame], DataFrame]) -> int:
    """Features of sessions that the ledger lacks, appended; sessions without any window are in the ledger too."""
    spark = events.sparkSession
    new = events.select("session_id").distinct().join(processed_sessions(spark, ledger), "session_id", "left_anti").join(processed_sessions(spark, target), "session_id", "left_anti")
    build(events.join(new, "session_id", "left_semi")).write.mode("append").parquet(target)
    before = processed_sessions(spark, ledger).count()
    events.select("session_id").distinct().join(processed_sessions(spark, ledger), "session_id", "left_anti").write.mode("append").parquet(ledger)
    return processed_sessions(spark, ledger).count() - before


def mark_of(marks: DataFrame, source: str, version: int = 1) -> str | None:
    """The source's mark; None where there is none, or none of this version: reading begins anew."""
    found = marks.where((F.col("source") == source) & (F.col("version") == version)).agg(F.max("sync_key")).first()
    return found[0]


def advance_mark(marks: DataFrame, source: str, seen: DataFrame, version: int = 1) -> DataFrame:
    """Marks (source, version, sync_key) with the source's moved to the largest key seen; never back, but for another version.

    A source's name says where it is read from (store, table and index), so another place has its own mark.
    """
    own = seen.agg(F.max("sync_key").alias("sync_key")).select(F.lit(source).alias("source"), F.lit(version).alias("version"), "sync_key")
    kept = marks.where((F.col("source") != source) | (F.col("version") == version))
    return kept.unionByName(own).groupBy("source", "version").agg(F.max("sync_key").alias("sync_key"))


def stream_windows(events: DataFrame, window_ms: int, step_ms: int, lateness: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """(session_id, window_start_ms, n, mean) of session-anchored windows as they close.

    `events`: a stream of session_id, timestamp_ms, v and event time ts. Rows are added to panes, the longest pieces of time that
    windows and steps are made of; a window is the sum of its panes once the watermark has passed it. Windows start at the
    session's first row, so rows before it that come late are dropped. A session's state is the count and sum of each open
    pane, however many rows there are; it goes when the watermark has passed the session's last row by `idle_ms`. Rows that
    still come after that begin a session anew.
    """
    pane = math.gcd(window_ms, step_ms)
    in_window, in_step = window_ms // pane, step_ms // pane

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, begun, last, *held = state.get if state.exists else (None, 0, None, [], [], [])
        panes = {k: (n, total) for k, n, total in zip(*held, strict=True)}
        mark = state.getCurrentWatermarkMs()
        if first is None:
            # Where a session's panes lie is known once its first rows are.
            batches = list(batches)
            first = min((int(b["timestamp_ms"].min()) for b in batches if len(b)), default=None)
        for b in batches:
            if not len(b):
                continue
            times, values = b["timestamp_ms"].to_numpy(np.int64), b["v"].to_numpy(np.float64)
            last = max(int(times.max()), last or 0)
            found, place = np.unique((times - first) // pane, return_inverse=True)
            for k, n, total in zip(found.tolist(), np.bincount(place).tolist(), np.bincount(place, values).tolist(), strict=True):
                if k >= begun * in_step:
                    before = panes.get(k, (0, 0.0))
                    panes[k] = (before[0] + n, before[1] + total)
        out = []
        while panes and first + begun * step_ms + window_ms <= mark:
            # Windows without rows are passed over at once.
            begun = max(begun, (min(panes) - in_window) // in_step + 1)
            if first + begun * step_ms + window_ms > mark:
                break
            own = [panes[k] for k in range(begun * in_step, begun * in_step + in_window) if k in panes]
            n = sum(x for x, _ in own)
            if n:
                out.append((key[0], first + begun * step_ms, n, sum(x for _, x in own) / n))
            begun += 1
            panes = {k: x for k, x in panes.items() if k >= begun * in_step}
        if last is None or not panes and last + idle_ms <= mark:
            state.remove()
        else:
            order = sorted(panes)
            state.update((first, begun, last, order, [panes[k][0] for k in order], [panes[k][1] for k in order]))
            state.setTimeoutTimestamp(max(mark + 1, first + begun * step_ms + window_ms if panes else last + idle_ms))
        yield pd.DataFrame(out, columns=["session_id", "window_start_ms", "n", "mean"])

    return events.withWatermark("ts", lateness).groupBy("session_id").applyInPandasWithState(
        update, "session_id string, window_start_ms long, n long, mean double", "first long, begun long, last long, panes array<long>, counts array<long>, sums array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
