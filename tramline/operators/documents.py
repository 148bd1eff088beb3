"""Metrics documents of runs: nested JSON put together from grouped frames, one value a run.

A document names a run and holds a section for each set of predictions: scores, a report by mode,
the confusion matrix, the same by phone position and participant, intervals, and the votes of sessions. What is
grouped are confusion counts, labels squared for each run and slice, so predictions are counted
once and never gathered. Predictions of many runs can be put into documents at once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .digest import json_text

#: Slices of a section, and the column of each.
SLICES = {"by_phone_position": "phone_position", "by_participant": "participant_id"}
SCORES = ("accuracy", "balanced_accuracy", "macro_f1", "minimum_class_recall")
_ALL = "all"


def _object(parts: dict[str, Column]) -> Column:
    """The text of a JSON object of values that are JSON text; those that are null are left out."""
    entries = [F.concat(F.lit(f"{json.dumps(k)}: "), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}"))


def _number(x: Column) -> Column:
    return x.cast("string")


def _entries(key: Column, value: Column, order: Column) -> Column:
    """An object of a group's rows, keys in order."""
    sorted_ = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.concat(json_text(key), F.lit(": "), value).alias("e"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(sorted_, lambda x: x["e"]), ", "), F.lit("}"))


def _named(modes: dict[str, int], label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for mode, n in modes.items() for x in (n, mode)]), label)


def base(conf: DataFrame, modes: dict[str, int], by: tuple[str, ...]) -> DataFrame:
    """(by, parts): scores, report, matrix and classes of each group's confusion counts, as text of an object's inside."""
    each = metrics.class_report(conf, by).withColumn("mode", _named(modes, F.col("label")))
    of = lambda f1: F.to_json(F.struct("precision", "recall", F.col("f1").alias(f1), F.col("support")))
    classes = each.groupBy(*by).agg(_entries(F.col("mode"), of("f1-score"), F.col("label")).alias("_report"), _entries(F.col("mode"), of("f1"), F.col("label")).alias("_classes"))
    means = metrics.overall(conf, by)
    mean = lambda p, r, f: F.to_json(F.struct(F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1-score"), F.col("rows").alias("support")))
    means = means.select(*by, *SCORES, mean("macro_precision", "balanced_accuracy", "macro_f1").alias("_macro"), mean("weighted_precision", "accuracy", "weighted_f1").alias("_weighted"))
    line = conf.groupBy(*by, "truth").agg(F.transform(F.sort_array(F.collect_list(F.struct("prediction", "n"))), lambda x: x["n"]).alias("line"))
    matrix = line.groupBy(*by).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("truth", "line"))), lambda x: x["line"])).alias("_matrix"))
    summary = _object({"accuracy": _number(F.col("accuracy")), "macro avg": F.col("_macro"), "weighted avg": F.col("_weighted")})
    # Modes first, then their summary: one object.
    report = F.concat(F.expr("substr(_report, 1, length(_report) - 1)"), F.lit(", "), F.substring(summary, 2, 1 << 30))
    parts = {**{s: _number(F.col(s)) for s in SCORES}, "classification_report": report, "confusion_matrix": F.col("_matrix"), "per_class": F.col("_classes")}
    return means.join(classes, list(by)).join(matrix, list(by)).select(*by, _object(parts).alias("parts"))


def sections(pred: DataFrame, modes: dict[str, int], run: str = "run", iterations: int = 0, seed: int = 1, votes: bool = True) -> DataFrame:
    """(run, section): the section of each run's predictions (truth, prediction, session_id, ...) as JSON text.

    Intervals are drawn for one run at a time, so `iterations` asks for predictions of a single run.
    """
    labels = sorted(modes.values())
    slices = {k: c for k, c in SLICES.items() if c in pred.columns}
    each = [F.struct(F.lit(k).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for k, c in slices.items()]
    whole = F.struct(F.lit(_ALL).alias("slice"), F.lit(_ALL).alias("value"))
    sliced = pred.select(F.col(run).alias("run"), "truth", "prediction", F.explode(F.array(whole, *each)).alias("_s")).select("run", "_s.*", "truth", "prediction")
    by = ("run", "slice", "value")
    found = base(metrics.confusion(sliced, labels, by), modes, by)
    out = found.where(F.col("slice") == _ALL).select("run", F.expr("substr(parts, 1, length(parts) - 1)").alias("_own"))
    names = (("rows", None), ("groups", "group_id"), ("sessions", "session_id"), ("participants", "participant_id"))
    names = [(n, c) for n, c in names if c is None or c in pred.columns]
    counts = pred.groupBy(F.col(run).alias("run")).agg(*[(F.count_distinct(c) if c else F.count(F.lit(1))).alias(n) for n, c in names])
    parts = {n: _number(F.col(n)) for n, c in names}
    out = out.join(counts, "run")
    if slices:
        inner = found.where(F.col("slice") != _ALL).groupBy("run", "slice").agg(_entries(F.col("value"), F.col("parts"), F.col("value")).alias("o"))
        out = out.join(inner.groupBy("run").pivot("slice", list(slices)).agg(F.first("o")), "run")
        parts |= {k: F.col(k) for k in slices}
    if iterations:
        ci = metrics.bootstrap_ci(pred, labels, iterations, seed)
        mode = F.element_at(F.create_map(*[F.lit(x) for m, n in modes.items() for x in (f"recall_{n}", f"{m}.recall")]), F.col("metric"))
        text = _entries(F.coalesce(mode, F.col("metric")), F.to_json(F.struct(F.col("low").alias("lower"), F.col("high").alias("upper"))), F.col("metric"))
        out = out.crossJoin(F.broadcast(ci.where("metric <> 'accuracy'").agg(text.alias("_ci"))))
        parts["participant_cluster_95_ci"] = F.col("_ci")
    if votes:
        carried = tuple(c for c in dict.fromkeys((*slices.values(), "participant_id", "group_id")) if c in pred.columns)
        both = pred.withColumn("session_id", F.struct(F.col(run).alias("run"), "session_id"))
        voted = metrics.session_vote(both, labels, carried=carried).select("session_id.run", "session_id.session_id", "truth", "prediction", *carried)
        out = out.join(sections(voted, modes, "run", votes=False, iterations=iterations, seed=seed).select("run", F.col("section").alias("_votes")), "run")
        parts["session_level"] = F.col("_votes")
    inside = F.substring(_object(parts), 2, 1 << 30)
    return out.select("run", F.concat(F.col("_own"), F.lit(", "), inside).alias("section"))


def documents(named: DataFrame, held: dict[str, DataFrame]) -> DataFrame:
    """(run, value): one document a run. `named`: (run, identity), a struct of what names the run; `held`: sections by name."""
    out = named.select("run", F.to_json("identity", {"ignoreNullFields": "false"}).alias("_identity"))
    for name, own in held.items():
        out = out.join(own.select("run", F.col("section").alias(name)), "run", "left")
    inside = F.substring(_object({name: F.col(name) for name in held}), 2, 1 << 30)
    return out.select("run", F.concat(F.expr("substr(_identity, 1, length(_identity) - 1)"), F.lit(", "), inside).alias("value"))


def write_documents(found: DataFrame, folder: str) -> None:
    """Write each run's document as one file below `folder`, from the tasks; read_metrics finds them."""
    found.select("run", "value").repartition("run").write.partitionBy("run").text(folder)


def of_run(spark: SparkSession, run, df: DataFrame, identity: dict, modes: dict[str, int], iterations: int = 0, seed: int = 1) -> str:
    """The document of a protocol's run (see protocols.Run) as JSON text."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("domain") != "collector").alias("source_rows"), F.count_if(F.col("domain") == "collector").alias("collector_rows"), F.count_distinct("group_id").alias("groups")).first()
    whole = {**identity, **size.asDict()}
    for name, pred in run.predictions.items():
        found = sections(pred.withColumn("run", F.lit("run")), modes, "run", iterations, seed).first()
        whole[name] = json.loads(found["section"]) if found else {"rows": 0}
    return json.dumps(whole, indent=2)
