"""Duration balancing and sample weights."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

_SESSION = ["session_id", "participant_id", "label"]


def session_durations(features: DataFrame) -> DataFrame:
    """(session_id, participant_id, label, seconds): length of the union of the session's windows."""
    before = Window.partitionBy("session_id").orderBy("window_start_ms", "window_end_ms").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("window_end_ms").over(before)
    new = F.greatest(F.lit(0), F.col("window_end_ms") - F.greatest(F.col("window_start_ms"), F.coalesce(reach, F.col("window_start_ms"))))
    return features.withColumn("_new", new).groupBy(*_SESSION).agg((F.sum("_new") / 1000.0).alias("seconds"))


def _bucket(df: DataFrame, column: str, length: int = 3) -> Column:
    """What follows the beginning that all values share: a bucket of few values whose order is that of the column."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    shared = len(os.path.commonprefix([low or "", high or ""]))
    return F.substring(column, shared + 1, length)


def select_sessions(durations: DataFrame, seed: int) -> DataFrame:
    """Whole sessions of each label, a round through its participants at a time, until the shortest label's total is reached.

    What comes before a session is the sum of earlier rounds, of earlier buckets of participants in its round, and of
    its bucket; so no task sees all sessions of a label, or of a round.
    """
    target = durations.groupBy("label").agg(F.sum("seconds").alias("s")).agg(F.min("s").alias("target"))
    key = S.shuffle_key(seed, "session_id")
    rounds = durations.withColumn("round", F.row_number().over(Window.partitionBy("label", "participant_id").orderBy(key, "session_id"))).withColumn("_b", _bucket(durations, "participant_id"))
    before = lambda keys, order: F.sum("_s").over(Window.partitionBy(*keys).orderBy(order)) - F.col("_s")
    buckets = rounds.groupBy("label", "round", "_b").agg(F.sum("seconds").alias("_s"))
    whole = buckets.groupBy("label", "round").agg(F.sum("_s").alias("_s")).select("label", "round", before(["label"], "round").alias("_rounds"))
    parts = buckets.select("label", "round", "_b", before(["label", "round"], "_b").alias("_buckets"))
    done = Window.partitionBy("label", "round", "_b").orderBy("participant_id").rowsBetween(Window.unboundedPreceding, -1)
    within = rounds.withColumn("_within", F.coalesce(F.sum("seconds").over(done), F.lit(0.0)))
    sofar = within.join(parts, ["label", "round", "_b"]).join(whole, ["label", "round"])
    # Sums of parts in another order differ in their last digits: lengths are whole milliseconds.
    reached = F.round(F.col("_rounds") + F.col("_buckets") + F.col("_within"), 3) < F.round("target", 3)
    return sofar.crossJoin(F.broadcast(target)).where(reached).select(*durations.columns, "round", "target")


def balance_durations(features: DataFrame, seed: int) -> DataFrame:
    """Source rows, and collector rows of the selected sessions."""
    collector = features.where("domain = 'collector'")
    chosen = select_sessions(session_durations(collector), seed)
    return features.where("domain <> 'collector'").unionByName(collector.join(chosen.select("session_id"), "session_id", "left_semi"))


def balance_report(features: DataFrame, seed: int) -> DataFrame:
    """(label, target, sessions, seconds) of the selection."""
    chosen = select_sessions(session_durations(features.where("domain = 'collector'")), seed)
    return chosen.groupBy("label").agg(F.first("target").alias("target"), F.count(F.lit(1)).alias("sessions"), F.sum("seconds").alias("seconds"))


def class_weights(features: DataFrame, factor: float = 1.0) -> DataFrame:
    """Rows with weight n / (labels * n of the label), times the factor for collector rows."""
    counts = features.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    both = F.broadcast(counts.crossJoin(F.broadcast(total)))
    scale = F.when(F.col("domain") == "collector", factor).otherwise(1.0)
    return features.join(both, "label").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n")) * scale).drop("_n", "_all", "_k")


def hierarchical_weights(features: DataFrame, factor: float = 1.0) -> DataFrame:
    """Rows with equal mass for each (domain, label), split over participants, sessions, rows; the mean weight is 1."""
    keys = ["domain", "label", "participant_id", "session_id"]
    sessions = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    people = sessions.groupBy(*keys[:3]).agg(F.count(F.lit(1)).alias("_sessions"))
    masses = people.groupBy(*keys[:2]).agg(F.count(F.lit(1)).alias("_people")).withColumn("_mass", F.when(F.col("domain") == "collector", factor).otherwise(1.0))
    total = masses.agg(F.sum("_mass").alias("_total")).crossJoin(sessions.agg(F.sum("_rows").alias("_all")))
    each = sessions.join(people, keys[:3]).join(F.broadcast(masses), keys[:2]).crossJoin(F.broadcast(total))
    weight = F.col("_mass") / F.col("_people") / F.col("_sessions") / F.col("_rows") * F.col("_all") / F.col("_total")
    return features.join(each.select(*keys, weight.alias("weight")), keys)
