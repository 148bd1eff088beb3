"""Training protocols: tune, fit and evaluate without leakage between groups.

Only fitted parameters, trial scores and one row for each participant or fold reach the driver;
rows stay in Spark. Feature tables are read many times, so pass written ones; rows to fit and
predictions are read many times too, and are written to `folder` first.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import write_text
from . import balance, digest, documents, metrics, ml, search, splits
from .search import Trial

#: Columns whose digest identifies the rows that splits belong to.
FINGERPRINT = ("domain", "participant_id", "group_id", "label", "session_id", "window_start_ms", "window_end_ms")


@dataclass(frozen=True)
class Settings:
    """What a run is asked to do. `folder`: shared, for tables between steps. `modes`: name -> label.

    `trials`: (family, parameters) to choose from; if there are none, `searched` of them are suggested from `spaces`.
    With `pruned`, those that fall behind are stopped after some of their folds.
    """

    folder: str
    features: list[str]
    modes: dict[str, int]
    trials: list[tuple[str, dict]]
    metric: str = "macro_f1"
    hierarchical: bool = True
    collector_factor: float = 1.0
    balanced: bool = False
    calibration: float | dict[int, float] = 0.5
    folds: int = 5
    iterations: int = 0
    seed: int = 1
    spaces: dict = field(default_factory=dict)
    searched: int = 20
    pruned: bool = False

    @property
    def labels(self) -> list[int]:
        return sorted(self.modes.values())


@dataclass
class Run:
    """A fitted model (pipeline and gaps), the chosen trial, all trials, predictions and figures by name, splits."""

    strategy: str
    model: tuple[PipelineModel, list[int]]
    family: str
    parameters: dict
    trials: list[Trial]
    predictions: dict[str, DataFrame]
    figures: dict[str, DataFrame]
    splits: DataFrame
    folds: list[dict] = field(default_factory=list)


def parted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, collector) rows; none of either is an error."""
    source, collector = df.where("domain <> 'collector'"), df.where("domain = 'collector'")
    for name, rows in (("source", source), ("collector", collector)):
        if rows.isEmpty():
            raise ValueError(f"no {name} feature rows")
    return source, collector


def _kept(df: DataFrame, asked: Settings) -> DataFrame:
    """`df` written and read back."""
    path = f"{asked.folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _weighted(asked: Settings, factor: bool = True):
    """Chooses and weights rows to fit, for a fold's number."""

    def prepare(train: DataFrame, fold: int) -> DataFrame:
        own = balance.balance_durations(train, asked.seed + fold) if asked.balanced else train
        weigh = balance.hierarchical_weights if asked.hierarchical else balance.class_weights
        return _kept(weigh(own, asked.collector_factor if factor else 1.0), asked)

    return prepare


def tuned(source: DataFrame, rows: DataFrame, folds: DataFrame, group: str, asked: Settings, factor: bool = True, study: str = "final") -> list[Trial]:
    """Every trial of a study, best first, by pooled out-of-fold predictions.

    Folds are fitted one after the other; labels squared counts of each come to the driver. A trial can be stopped from
    the fold on with which every label was met.
    """
    held, numbers = ml.folded(rows, folds, group)
    rungs, done = search.Rungs(study, len(numbers)), []
    for number in range(len(asked.trials) or asked.searched):
        family, params = asked.trials[number] if asked.trials else search.suggest(asked.spaces, done, asked.seed, number)
        trial, matrix = Trial(study, number, family, params), Counter()
        for fold in numbers:
            pred = ml.fold_predictions(source, held, fold, asked.features, asked.labels, family, params, _weighted(asked, factor), "weight", asked.seed)
            matrix.update({(r["truth"], r["prediction"]): r["count"] for r in pred.groupBy("truth", "prediction").count().collect()})
            trial.score = search.matrix_score(matrix, asked.labels, asked.metric)
            trial.steps.append(trial.score)
            if asked.pruned and {t for t, _ in matrix} >= set(asked.labels) and rungs.behind(number, len(trial.steps), trial.score) and fold != numbers[-1]:
                trial.state = "pruned"
                break
        done.append(trial)
    return search.ordered(done)


def _fitted(train: DataFrame, best: Trial, asked: Settings, fold: int = 0) -> tuple[PipelineModel, list[int]]:
    return ml.fit(_weighted(asked)(train, fold), asked.features, best.family, best.parameters, asked.seed, "weight", max(asked.labels) + 1)


def session_holdout(df: DataFrame, asked: Settings, group: str = "group_id") -> Run:
    """Tune on calibration groups, fit on the source and all of them, report on them and on held-out groups."""
    ml.combined(df, df.limit(0), asked.features)
    source, collector = parted(df)
    roles = _kept(splits.holdout(collector, asked.calibration, asked.seed, group, asked.modes), asked)
    of = lambda role: collector.join(F.broadcast(roles.where(F.col("role") == role).select(group)), group, "left_semi")
    calibration, held = of("calibration"), of("holdout")
    folds = _kept(splits.group_kfold(calibration, asked.folds, asked.seed, group), asked)
    # Without hierarchical weights, trials are compared without the collector's factor.
    trials = tuned(source, calibration, folds, group, asked, asked.hierarchical)
    model = _fitted(source.unionByName(calibration), trials[0], asked)
    shown = {name: _kept(ml.predict(model, rows, asked.features, asked.labels), asked) for name, rows in (("collector_calibration", calibration), ("collector_holdout", held))}
    figures = {name: metrics.evaluation(rows, asked.labels, asked.iterations, asked.seed) for name, rows in shown.items()}
    kept = roles.join(folds, group, "left").select(F.lit("session").alias("held_out"), F.col(group).alias("grp"), "role", "fold")
    return Run("session_holdout", model, trials[0].family, trials[0].parameters, trials, shown, figures, kept)


def participant_nested(df: DataFrame, asked: Settings) -> Run:
    """Each participant is predicted by a model tuned and fitted without them; then a last study and fit on all.

    Needs two participants of every mode and three in all. Every collector row must be predicted
    exactly once.
    """
    group = "participant_id"
    ml.combined(df, df.limit(0), asked.features)
    source, collector = parted(df)
    if not collector.where("participant_id IS NULL").isEmpty():
        raise ValueError("collector rows without a participant")
    splits.check_modes(collector, asked.modes, group)
    people = [r[0] for r in collector.select(group).distinct().orderBy(group).collect()]
    if len(people) < 3:
        raise ValueError("nested evaluation needs three participants")
    pooled, outer, trials, kept = None, [], [], None
    for number, person in enumerate(people):
        rows, test = collector.where(F.col(group) != person), collector.where(F.col(group) == person)
        folds = _kept(splits.stratified_group_kfold(rows, asked.folds, asked.seed + number).drop("scope"), asked)
        found = tuned(source, rows, folds, group, asked, study=str(person))
        trials += found
        own = _kept(ml.predict(_fitted(source.unionByName(rows), found[0], asked, number), test, asked.features, asked.labels), asked)
        outer.append({"held_out": str(person), "score": found[0].score, "family": found[0].family, "parameters": found[0].parameters})
        pooled = own if pooled is None else pooled.unionByName(own)
        inner = folds.select(F.lit(str(person)).alias("held_out"), F.col(group).cast("string").alias("grp"), F.lit("train").alias("role"), "fold")
        kept = inner if kept is None else kept.unionByName(inner)
    if not incomplete(collector, pooled).isEmpty():
        raise RuntimeError("not every collector row is predicted exactly once")
    folds = _kept(splits.stratified_group_kfold(collector, asked.folds, asked.seed).drop("scope"), asked)
    final = tuned(source, collector, folds, group, asked)
    model = _fitted(df, final[0], asked)
    figures = {"collector_holdout": metrics.evaluation(pooled, asked.labels, asked.iterations, asked.seed)}
    kept = kept.unionByName(folds.select(F.lit("none").alias("held_out"), F.col(group).cast("string").alias("grp"), F.lit("train").alias("role"), "fold"))
    return Run("participant_nested_cv", model, final[0].family, final[0].parameters, trials + final, {"collector_holdout": pooled}, figures, kept, outer)


def incomplete(rows: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("session_id", "window_start_ms")) -> DataFrame:
    """(keys, n): rows that aren't predicted exactly as often as they occur, n times more or less."""
    each = rows.select(*keys, F.lit(-1).alias("n")).unionAll(predicted.select(*keys, F.lit(1).alias("n")))
    return each.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def roles(splits_: DataFrame, group: str) -> DataFrame:
    """(group, role): what each collector group is to a run; a group may have several roles, or none.

    Of a session holdout, groups calibrate or are held out. Of a nested run, every participant both
    belongs to the deployed model's rows and is evaluated out of fold. Splits of another kind are an error.
    """
    kinds = {r[0] for r in splits_.select(F.col("held_out") == "session").distinct().collect()}
    if len(kinds) != 1:
        raise ValueError("splits of one run are asked for")
    if kinds == {True}:
        named = splits_.select(F.col("grp").alias(group), F.when(F.col("role") == "holdout", "evaluation").otherwise("calibration").alias("role"))
        return named.distinct()
    people = splits_.where("held_out = 'none'").select(F.col("grp").alias(group)).distinct()
    return people.withColumn("role", F.explode(F.array(F.lit("calibration"), F.lit("evaluation"))))


def with_roles(df: DataFrame, splits_: DataFrame, group: str) -> DataFrame:
    """`df` of one run, a row for each of a row's roles: training (source rows), calibration, evaluation.

    A collector row without a role is an error when it is met, so no rows are lost without a word.
    """
    named = roles(splits_, group).groupBy(group).agg(F.collect_set("role").alias("_roles"))
    collector = df.where("domain = 'collector'").withColumn("_group", F.col(group).cast("string")).join(named.withColumnRenamed(group, "_group"), "_group", "left")
    missing = F.raise_error(F.concat(F.lit("no role for "), F.coalesce("_group", F.lit("null")))).cast("array<string>")
    collector = collector.withColumn("role", F.explode(F.coalesce("_roles", missing))).drop("_group", "_roles")
    return df.where("domain <> 'collector'").withColumn("role", F.lit("training")).unionByName(collector)


def lineage(df: DataFrame, columns: list[str], by: tuple[str, ...] = ("role",)) -> DataFrame:
    """(role, rows, digest) of the rows in each role of a run."""
    return digest.dataset_digest(df, columns, by)


def trials_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    """(study, number, state, score, family, parameters, steps): a row for each trial; parameters are JSON."""
    rows = [(t.study, t.number, t.state, float(t.score), t.family, json.dumps(t.parameters, sort_keys=True), [float(x) for x in t.steps]) for t in trials]
    return spark.createDataFrame(rows, "study string, number int, state string, score double, family string, parameters string, steps array<double>")


def identity(run: Run, asked: Settings, **named) -> dict:
    """What names a run and how it was chosen; `named`: hashes, dataset, name, index."""
    best = next(t for t in run.trials if t.study == "final")
    folds = run.splits.where("fold IS NOT NULL").select("held_out", "fold").distinct().groupBy("held_out").count().agg(F.max("count")).first()[0]
    chosen = {"family": run.family, **run.parameters}
    pooled = {"method": "grouped_out_of_fold", "folds": folds, "score": best.score} if run.strategy == "session_holdout" else {"method": "nested_participant_out_of_fold", "outer_folds": len(run.folds), "inner_folds": asked.folds}
    return {
        **named, "evaluation_strategy": run.strategy, "best_cross_validation_score": best.score, **({"best_cross_validation_macro_f1": best.score} if asked.metric == "macro_f1" else {}),
        "selection_metric": asked.metric, "cross_validation": pooled, "best_params": chosen, "participant_outer_folds": run.folds, "feature_names": asked.features,
    }


def write_report(spark: SparkSession, run: Run, df: DataFrame, path: str, asked: Settings, **named) -> None:
    """The metrics document, splits with the fingerprint of the rows they belong to, trials and the model, below a folder.

    `named`: config_hash, trial_hash, trial_index, run_name and train_dataset, as reports ask for them.
    """
    named = {"config_hash": None, "trial_hash": None, "trial_index": None, "run_name": None, "train_dataset": None, **named}
    write_text(spark, f"{path}/metrics.json", documents.of_run(spark, run, df, identity(run, asked, **named), asked.modes, asked.iterations, asked.seed) + "\n")
    write_text(spark, f"{path}/trial.json", json.dumps({k: v for k, v in asdict(asked).items() if k not in ("folder", "spaces")}, sort_keys=True, indent=2) + "\n")
    stamp = digest.dataset_digest(df, [c for c in FINGERPRINT if c in df.columns]).select(F.col("digest").alias("fingerprint"))
    run.splits.crossJoin(F.broadcast(stamp)).write.mode("overwrite").parquet(f"{path}/splits")
    trials_table(spark, run.trials).coalesce(1).write.mode("overwrite").json(f"{path}/trials")
    ml.save_model(run.model, f"{path}/model")
