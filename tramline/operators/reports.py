"""Reports over saved metrics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DOCUMENT = "config_hash string, trial_hash string, train_dataset string, run_name string, trial_index int"
SCORES = ("accuracy", "balanced_accuracy", "macro_f1", "minimum_class_recall")
#: Entries of a classification report that aren't modes.
NOT_MODES = ("accuracy", "macro avg", "weighted avg")


def display_name() -> Column:
    """[run name-]dataset-first eight of the hash."""
    return F.concat_ws("-", F.nullif("run_name", F.lit("")), "train_dataset", F.substring(F.coalesce("trial_hash", "config_hash"), 1, 8))


def read_metrics(spark: SparkSession, path: str, section: str = "collector_holdout") -> DataFrame:
    """One row for each metrics document below a folder: identity, a section's scores, report and confusion matrix.

    Documents are files named metrics.json, or those that documents.write_documents has written.
    """
    raw = spark.read.schema(f"{_DOCUMENT}, `{section}` string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "{metrics.json,part-*.txt}").json(path)
    # Models beside the documents are saved as text as well.
    raw = raw.select("*", F.col("_metadata.file_path").alias("path")).where(F.col("path").rlike(r"/(metrics\.json|run=[^/]*/part-[^/]*\.txt)$"))
    held = F.col(f"`{section}`")
    scores = [F.get_json_object(held, f"$.{s}").try_cast("double").alias(s) for s in SCORES]
    report = F.from_json(F.get_json_object(held, "$.classification_report"), "map<string,string>")
    matrix = F.from_json(F.get_json_object(held, "$.confusion_matrix"), "array<array<double>>")
    return raw.select("config_hash", "trial_hash", "train_dataset", "run_name", "trial_index", display_name().alias("name"), *scores, report.alias("report"), matrix.alias("matrix"), "path")


def invalid_scores(metrics: DataFrame) -> DataFrame:
    """Rows with a score that is missing, not finite or outside [0, 1]."""
    return metrics.where(" OR ".join(f"{s} IS NULL OR isnan({s}) OR {s} < 0 OR {s} > 1" for s in SCORES))


def check_scores(metrics: DataFrame) -> None:
    """An error that names a document with an invalid score."""
    bad = invalid_scores(metrics).select("path").first()
    if bad:
        raise ValueError(f"{bad[0]}: scores must be numbers between 0 and 1")


def in_order(metrics: DataFrame, *more: str) -> DataFrame:
    """Runs by trial index, those without one last; then by name and `more`."""
    return metrics.orderBy(F.asc_nulls_last("trial_index"), "name", *more)


def mode_scores(metrics: DataFrame) -> DataFrame:
    """(name, trial_index, mode, precision, recall, f1, support) of each run."""
    each = metrics.select("name", "trial_index", F.explode("report").alias("mode", "x")).where(~F.col("mode").isin(*NOT_MODES))
    get = lambda k: F.get_json_object("x", f"$['{k}']").try_cast("double")
    return each.select("name", "trial_index", "mode", get("precision").alias("precision"), get("recall").alias("recall"), get("f1-score").alias("f1"), get("support").alias("support"))


def bad_matrices(metrics: DataFrame) -> DataFrame:
    """Runs whose confusion matrix doesn't fit their report: as many rows and columns as modes, finite counts, row sums equal to supports."""
    modes = F.filter(F.map_keys("report"), lambda m: ~m.isin(*NOT_MODES))
    support = F.transform(modes, lambda m: F.get_json_object(F.element_at("report", m), "$.support").try_cast("double"))
    square = (F.size("matrix") == F.size(modes)) & F.forall("matrix", lambda row: F.size(row) == F.size(modes))
    counts = F.forall(F.flatten("matrix"), lambda x: x.isNotNull() & (x >= 0) & (x < float("inf")))
    sums = F.transform("matrix", lambda row: F.aggregate(row, F.lit(0.0), lambda t, x: t + x))
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs(a), F.abs(b)))
    same = F.forall(F.arrays_zip(sums.alias("a"), support.alias("b")), lambda p: F.coalesce(near(p["a"], p["b"]), F.lit(False)))
    return metrics.where(~F.coalesce(square & counts & same, F.lit(False)))


def normalized_matrix(matrix: Column) -> Column:
    """Each row by its sum, zeros for an empty one."""
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda t, x: t + x)
    return F.transform(matrix, lambda row: F.transform(row, lambda x: F.coalesce(F.try_divide(x, total(row)), F.lit(0.0))))


def dedupe(runs: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row a run, runs seen with different values); of different values the smallest stay."""
    conflicts = runs.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("versions")).where("versions > 1")
    rest = [c for c in runs.columns if c not in (key, *columns)]
    return runs.groupBy(key).agg(F.min(F.struct(*columns, *rest)).alias("_r")).select(key, "_r.*").select(*runs.columns), conflicts


def top_runs(runs: DataFrame, metric: str, n: int, ties: list[str]) -> DataFrame:
    return runs.orderBy(F.desc(metric), *ties).limit(n)


def pivot(scores: DataFrame, run: str, mode: str, value: str, modes: list[str]) -> DataFrame:
    """A row for each run, a column for each mode, null where a run lacks it."""
    return scores.groupBy(run).pivot(mode, modes).agg(F.first(value))
