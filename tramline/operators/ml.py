"""MLlib pipelines over feature tables, with pooled out-of-fold tuning and evaluation."""

from __future__ import annotations

import random
import re

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics

#: Hyper-parameters that the random grid draws from, by family.
SPACE = {
    "random_forest": {"numTrees": [20, 50, 100], "maxDepth": [4, 8, 12], "minInstancesPerNode": [1, 2, 4]},
    "gradient_boosting": {"maxIter": [5, 10, 20], "maxDepth": [3, 5], "stepSize": [0.05, 0.1, 0.2]},
    "multilayer_perceptron": {"hidden": [8, 16, 32], "maxIter": [50, 100], "stepSize": [0.01, 0.03]},
}


def missing_columns(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if c not in df.columns]


def combined(source: DataFrame, collector: DataFrame, features: list[str]) -> DataFrame:
    """Rows of both feature tables, aligned by name; a feature that neither has is an error."""
    both = source.unionByName(collector, allowMissingColumns=True)
    missing = sorted(missing_columns(both, features))
    if missing:
        raise ValueError(f"feature columns are missing: {', '.join(missing)}")
    return both


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns as doubles f0, f1, ...: names with # and @ don't suit expressions."""
    return df.select("*", *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])


def indicators(train: DataFrame, n: int) -> list[int]:
    """Positions of features with a missing value in the rows to fit."""
    counts = train.agg(*[F.count_if(F.col(f"f{i}").isNull()).alias(str(i)) for i in range(n)]).first()
    return [i for i in range(n) if counts[str(i)]]


def fit(train: DataFrame, features: list[str], family: str, params: dict, seed: int = 1, weight: str | None = None, classes: int = 2) -> tuple[PipelineModel, list[int]]:
    """A fitted pipeline of median imputation, missing indicators, scaling (perceptron) and the classifier.

    The perceptron takes no weights and is fitted without.
    """
    rows = prepared(train, features)
    gaps = indicators(rows, len(features))
    for i in gaps:
        rows = rows.withColumn(f"m{i}", F.col(f"f{i}").isNull().cast("double"))
    names = [f"f{i}" for i in range(len(features))]
    stages = [Imputer(strategy="median", relativeError=0.0, inputCols=names, outputCols=[f"i{n}" for n in names])]
    stages.append(VectorAssembler(inputCols=[f"i{n}" for n in names] + [f"m{i}" for i in gaps], outputCol="raw"))
    params, column = dict(params), "raw"
    weighted = {"weightCol": weight} if weight else {}
    if family == "random_forest":
        stages.append(RandomForestClassifier(featuresCol=column, labelCol="label", seed=seed, **weighted, **params))
    elif family == "gradient_boosting":
        one = GBTClassifier(featuresCol=column, labelCol="label", seed=seed, **params)
        stages.append(OneVsRest(classifier=one, featuresCol=column, labelCol="label", **weighted))
    elif family == "multilayer_perceptron":
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=column, outputCol="scaled"))
        hidden = [int(n) for n in str(params.pop("hidden", 16)).split("_")]
        layers = [len(features) + len(gaps), *hidden, classes]
        stages.append(MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=layers, seed=seed, **params))
    else:
        raise ValueError(f"unknown family {family}")
    return Pipeline(stages=stages).fit(rows.withColumn("label", F.col("label").cast("double"))), gaps


def predict(model: tuple[PipelineModel, list[int]], df: DataFrame, features: list[str], labels: list[int]) -> DataFrame:
    """Rows with truth, prediction and probabilities in the order of labels; 0 for classes the fit didn't see.

    One-vs-rest gives scores only: their sigmoids, scaled to sum to 1, stand for probabilities.
    """
    pipeline, gaps = model
    rows = prepared(df, features)
    for i in gaps:
        rows = rows.withColumn(f"m{i}", F.col(f"f{i}").isNull().cast("double"))
    out = pipeline.transform(rows)
    if "probability" in out.columns:
        known = vector_to_array("probability")
    else:
        sig = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
        known = F.transform(sig, lambda x: x / F.aggregate(sig, F.lit(0.0), lambda t, y: t + y))
    aligned = F.array(*[F.coalesce(F.get(known, F.lit(x)), F.lit(0.0)) for x in labels])
    out = out.withColumn("probabilities", aligned)
    at = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
    return out.select(*df.columns, F.col("label").cast("int").alias("truth"), F.get(F.array(*map(F.lit, labels)), at).alias("prediction"), "probabilities")


def out_of_fold(df: DataFrame, folds: DataFrame, group: str, features: list[str], labels: list[int], family: str, params: dict, weight: str | None = None) -> DataFrame:
    """Every row predicted by the model that didn't see its group."""
    return cross_validated(df.limit(0), df, folds, group, features, labels, family, params, lambda train, fold: train, weight)


def fold_predictions(
    source: DataFrame, held: DataFrame, fold: int, features: list[str], labels: list[int], family: str, params: dict,
    prepare: Callable[[DataFrame, int], DataFrame], weight: str | None = None, seed: int = 1,
) -> DataFrame:
    """Rows of one fold of `held` (with `fold`), predicted by a model of `source` and the other folds' rows."""
    train = prepare(source.unionByName(held.where(F.col("fold") != fold).drop("fold"), allowMissingColumns=True), fold)
    model = fit(train, features, family, params, seed, weight, max(labels) + 1)
    return predict(model, held.where(F.col("fold") == fold).drop("fold"), features, labels)


def folded(rows: DataFrame, folds: DataFrame, group: str) -> tuple[DataFrame, list[int]]:
    """`rows` with their fold, and the folds' numbers."""
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    return rows.join(folds.select(group, "fold"), group), numbers


def cross_validated(
    source: DataFrame, rows: DataFrame, folds: DataFrame, group: str, features: list[str], labels: list[int], family: str, params: dict,
    prepare: Callable[[DataFrame, int], DataFrame], weight: str | None = None, seed: int = 1,
) -> DataFrame:
    """`rows` predicted by models of `source` and the other folds' rows; `prepare` (train, fold) chooses and weights what is fitted."""
    held, numbers = folded(rows, folds, group)
    out = None
    for fold in numbers:
        own = fold_predictions(source, held, fold, features, labels, family, params, prepare, weight, seed)
        out = own if out is None else out.unionByName(own)
    return out


def save_model(model: tuple[PipelineModel, list[int]], path: str) -> None:
    """Write a fitted pipeline; what it imputes is read back from its own stages."""
    model[0].write().overwrite().save(path)


def load_model(path: str) -> tuple[PipelineModel, list[int]]:
    pipeline = PipelineModel.load(path)
    return pipeline, [int(c[1:]) for c in pipeline.stages[1].getInputCols() if re.fullmatch(r"m\d+", c)]


def grid(family: str, n: int, seed: int) -> list[dict]:
    """n seeded draws from the family's space, without repeats where possible."""
    rng, out = random.Random(seed), []
    for _ in range(20 * n):
        own = {k: rng.choice(v) for k, v in SPACE[family].items()}
        if own not in out:
            out.append(own)
        if len(out) == n:
            break
    return out


def tune(df: DataFrame, folds: DataFrame, group: str, features: list[str], labels: list[int], family: str, trials: list[dict], metric: str = "macro_f1", weight: str | None = None) -> list[tuple[float, dict]]:
    """(score, parameters) of every trial, best first; scores are of pooled out-of-fold predictions."""
    found = []
    for params in trials:
        pooled = out_of_fold(df, folds, group, features, labels, family, params, weight)
        found.append((float(metrics.overall(metrics.confusion(pooled, labels)).first()[metric]), params))
    return sorted(found, key=lambda x: -x[0])
