"""Classification metrics from confusion counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .splits import numbered


def confusion(pred: DataFrame, labels: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, truth, prediction, n) over the whole grid of labels, zeros included."""
    spark = pred.sparkSession
    counts = pred.groupBy(*by, "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    side = spark.createDataFrame([(x,) for x in labels], "truth int")
    grid = side.crossJoin(side.withColumnRenamed("truth", "prediction"))
    if by:
        grid = counts.select(*by).distinct().crossJoin(F.broadcast(grid))
    on = [*by, "truth", "prediction"]
    return grid.join(counts, on, "left").select(*on, F.coalesce("n", F.lit(0)).alias("n"))


def normalized(conf: DataFrame) -> DataFrame:
    """Confusion counts with each truth's share; 0 for an empty truth."""
    rows = conf.groupBy("truth").agg(F.sum("n").alias("_s"))
    return conf.join(rows, "truth").select("truth", "prediction", "n", safe_div(F.col("n"), F.col("_s")).alias("share"))


def class_report(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support), zero where undefined."""
    both = conf.withColumn("label", F.explode(F.array_distinct(F.array("truth", "prediction"))))
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t, p = F.col("truth") == F.col("label"), F.col("prediction") == F.col("label")
    sums = both.groupBy(*by, "label").agg(hit(t & p).alias("tp"), hit(t).alias("support"), hit(p).alias("chosen"))
    return sums.select(
        *by, "label", safe_div(F.col("tp"), F.col("chosen")).alias("precision"), safe_div(F.col("tp"), F.col("support")).alias("recall"),
        safe_div(2.0 * F.col("tp"), F.col("chosen") + F.col("support")).alias("f1"), "support",
    )


def overall(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, accuracy, balanced_accuracy, macro_f1, minimum_class_recall, weighted_*): means over all labels."""
    report = class_report(conf, by)
    weighted = lambda c: safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return report.groupBy(*by).agg(
        weighted("recall").alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.min("recall").alias("minimum_class_recall"),
        F.avg("precision").alias("macro_precision"), weighted("precision").alias("weighted_precision"), weighted("f1").alias("weighted_f1"), F.sum("support").alias("rows"),
    )


def by_slice(pred: DataFrame, labels: list[int], columns: list[str]) -> DataFrame:
    """(slice, value, metrics) of all rows and of each value of each column, from one scan."""
    sliced = pred.withColumn("_s", F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])))
    rows = sliced.select("_s.slice", "_s.value", "truth", "prediction")
    return overall(confusion(rows, labels, ("slice", "value")), ("slice", "value"))


def session_vote(pred: DataFrame, labels: list[int], strict: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, truth, prediction, truths, carried): argmax of the mean probabilities, the first on ties.

    `pred` has `probabilities`, an array in the order of labels. truths is 1 unless a session mixes
    labels; with `strict` that is an error when it is met. `carried` columns are their smallest values.
    """
    means = [F.avg(F.get("probabilities", F.lit(i))).alias(f"_p{i}") for i in range(len(labels))]
    voted = pred.groupBy("session_id").agg(F.min("truth").alias("truth"), F.count_distinct("truth").alias("truths"), *means, *[F.min(c).alias(c) for c in carried])
    if strict:
        mixed = F.raise_error(F.concat(F.lit("more than one true label in session "), F.col("session_id")))
        voted = voted.withColumn("truth", F.when(F.col("truths") > 1, mixed.cast("int")).otherwise(F.col("truth")))
    all_ = F.array(*[F.col(f"_p{i}") for i in range(len(labels))])
    at = F.array_position(all_, F.array_max(all_)).cast("int") - 1
    return voted.select("session_id", "truth", F.get(F.array(*map(F.lit, labels)), at).alias("prediction"), "truths", *carried)


def counts(pred: DataFrame) -> DataFrame:
    """(rows, groups, sessions, participants) of predictions."""
    names = (("groups", "group_id"), ("sessions", "session_id"), ("participants", "participant_id"))
    return pred.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(n) for n, c in names if c in pred.columns])


def evaluation(pred: DataFrame, labels: list[int], iterations: int = 0, seed: int = 1, slices: tuple[str, ...] = ("phone_position", "participant_id")) -> DataFrame:
    """(level, slice, value, metric, x, upper): every figure of a run as one long table.

    Levels are windows and the votes of whole sessions. Figures are means, each class's
    (metric@label), counts and, with `iterations`, participants' bootstrap intervals (x to upper).
    """
    slices = tuple(c for c in slices if c in pred.columns)
    out = None
    carried = tuple(dict.fromkeys((*slices, *[c for c in ("participant_id", "group_id") if c in pred.columns])))
    for level, rows in (("window", pred), ("session", session_vote(pred, labels, strict=True, carried=carried))):
        sliced = rows.select("truth", "prediction", F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in slices])).alias("_s")).select("_s.*", "truth", "prediction")
        conf = confusion(sliced, labels, ("slice", "value"))
        means, each, all_ = overall(conf, ("slice", "value")), class_report(conf, ("slice", "value")), counts(rows)
        long = lambda df, names, suffix=F.lit(""): df.select(
            *(F.col(c) if c in df.columns else F.lit("all").alias(c) for c in ("slice", "value")), F.explode(F.array(*[F.struct(F.concat(F.lit(m), suffix).alias("metric"), F.col(m).cast("double").alias("x")) for m in names])).alias("_m")
        ).select("slice", "value", "_m.*", F.lit(None).cast("double").alias("upper"))
        parts = [long(means, means.columns[2:]), long(each, ("precision", "recall", "f1", "support"), F.concat(F.lit("@"), F.col("label").cast("string"))), long(all_, [c for c in all_.columns if c != "rows"])]
        if iterations and "participant_id" in rows.columns:
            ci = bootstrap_ci(rows, labels, iterations, seed)
            parts.append(ci.select(F.lit("all").alias("slice"), F.lit("all").alias("value"), F.concat(F.lit("ci95_"), "metric").alias("metric"), F.col("low").alias("x"), F.col("high").alias("upper")))
        for part in parts:
            own = part.select(F.lit(level).alias("level"), "slice", "value", "metric", "x", "upper")
            out = own if out is None else out.unionByName(own)
    return out


def draw(seed: int, iteration: Column, place: Column, n: Column) -> Column:
    """A number below n from the hash of (seed, iteration, place)."""
    text = F.concat_ws("-", F.lit(str(seed)), iteration.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def _drawn_here(named: DataFrame, groups: int, labels: list[int], iterations: int, seed: int) -> DataFrame:
    """(iteration, truth, prediction, n) of all draws, made in the tasks from counts by place that are sent to them."""
    at = {x: i for i, x in enumerate(labels)}
    table = np.zeros((groups, len(labels) ** 2), np.int64)
    for r in named.where(F.col("truth").isin(labels) & F.col("prediction").isin(labels)).select("i", "truth", "prediction", "n").collect():
        table[r["i"], at[r["truth"]] * len(labels) + at[r["prediction"]]] = r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["id"].to_pylist()
            found = np.zeros((len(own), table.shape[1]), np.int64)
            for k, iteration in enumerate(own):
                places = [int(hashlib.md5(f"{seed}-{iteration}-{p}".encode()).hexdigest()[:8], 16) % groups for p in range(groups)]
                found[k] = np.bincount(places, minlength=groups) @ table
            k, cell = np.nonzero(found)
            truth, prediction = np.array(labels)[cell // len(labels)], np.array(labels)[cell % len(labels)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(own, np.int64)[k]), pa.array(truth, pa.int32()), pa.array(prediction, pa.int32()), pa.array(found[k, cell])], names=["iteration", "truth", "prediction", "n"])

    return named.sparkSession.range(iterations).mapInArrow(run, "iteration long, truth int, prediction int, n long")


def bootstrap_ci(pred: DataFrame, labels: list[int], iterations: int, seed: int, group: str = "participant_id", sent: int = 2_000_000) -> DataFrame:
    """(metric, low, high): 2.5 and 97.5 percentiles over draws of whole groups with replacement.

    Only group-level confusion counts are drawn. Up to `sent` of them (groups x labels^2), they are sent to the tasks, which
    share the iterations: nothing is exchanged for the draws. With more of them, draws are rows that
    are joined, iterations x groups at most.
    """
    spark = pred.sparkSession
    counts = pred.groupBy(F.col(group).cast("string").alias("grp"), "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    named = numbered(counts, "grp", seed).withColumnRenamed("place", "i")
    groups = counts.select("grp").distinct().count()
    side = spark.createDataFrame([(x,) for x in labels], "truth int")
    if groups * len(labels) ** 2 <= sent:
        conf = _drawn_here(counts.join(F.broadcast(named), "grp"), groups, labels, iterations, seed)
    else:
        draws = spark.range(iterations).withColumnRenamed("id", "iteration").crossJoin(named.select(F.col("i").alias("place"), F.col("of").alias("groups")))
        drawn = draws.withColumn("i", draw(seed, F.col("iteration"), F.col("place"), F.col("groups"))).join(named, "i").groupBy("iteration", "grp").agg(F.count(F.lit(1)).alias("times"))
        conf = drawn.join(counts, "grp").groupBy("iteration", "truth", "prediction").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    grid = spark.range(iterations).withColumnRenamed("id", "iteration").crossJoin(F.broadcast(side.crossJoin(side.withColumnRenamed("truth", "prediction"))))
    conf = grid.join(conf, ["iteration", "truth", "prediction"], "left").select("iteration", "truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))
    each = overall(conf, ("iteration",))
    rows = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("accuracy", "balanced_accuracy", "macro_f1", "minimum_class_recall")])).alias("m")).select("m.*")
    recalls = class_report(conf, ("iteration",)).where("support > 0").select(F.concat(F.lit("recall_"), F.col("label").cast("string")).alias("metric"), F.col("recall").alias("x"))
    bounds = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))
    return rows.unionByName(recalls).groupBy("metric").agg(F.get(bounds, F.lit(0)).alias("low"), F.get(bounds, F.lit(1)).alias("high"))
