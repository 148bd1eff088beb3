"""Training protocols on small tables: leakage, completeness, reports and errors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import metrics, ml, protocols, reports, search, splits

MODES = {"bus": 0, "car": 1, "walk": 2}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = random.Random(3)
    out = []
    for domain, people in (("us-tmd", 2), ("collector", 3)):
        for p in range(people):
            for label in range(3):
                for session in range(2):
                    for w in range(2):
                        sid = f"{domain}-{p}-{label}-{session}"
                        out.append((domain, f"p{p}", sid, f"p{p}#d#{sid}", label, "hand" if session else None, w * 1000, w * 1000 + 1000, label + rng.random() / 4, None if w and p == 1 else rng.random()))
    df = spark.createDataFrame(out, "domain string, participant_id string, session_id string, group_id string, label int, phone_position string, window_start_ms long, window_end_ms long, `a#mean` double, `b#mean` double")
    path = str(tmp_path_factory.mktemp("rows"))
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


FOREST = ("random_forest", {"numTrees": 3, "maxDepth": 3})


def asked(folder, trials=(FOREST,), folds=2, **more):
    return protocols.Settings(f"file://{folder}", ["a#mean", "b#mean"], MODES, list(trials), folds=folds, **more)


def test_session_holdout(spark, rows, tmp_path):
    run = protocols.session_holdout(rows, asked(tmp_path, iterations=5, balanced=True))
    held, known = (run.predictions[f"collector_{x}"] for x in ("holdout", "calibration"))
    groups = [{r[0] for r in x.select("group_id").distinct().collect()} for x in (held, known)]
    assert len(groups[0]) == len(groups[1]) == 9 and not groups[0] & groups[1]
    # Computed once; the other section is of the same making.
    run.figures.pop("collector_calibration")
    run.figures["collector_holdout"].coalesce(1).write.parquet(f"file://{tmp_path}/figures")
    run.figures["collector_holdout"] = spark.read.parquet(f"file://{tmp_path}/figures")
    figures = {(r["level"], r["metric"]): r for r in run.figures["collector_holdout"].where("slice = 'all'").collect()}
    assert figures["window", "rows"]["x"] == 18 and figures["session", "sessions"]["x"] == 9 and figures["window", "macro_f1"]["x"] > 0.5
    assert figures["window", "ci95_macro_f1"]["x"] <= figures["window", "ci95_macro_f1"]["upper"]
    assert {r["value"] for r in run.figures["collector_holdout"].where("slice = 'phone_position'").collect()} <= {"hand", "unknown"}
    out = f"file://{tmp_path}/report"
    run.predictions = {"collector_holdout": held}
    protocols.write_report(spark, run, rows, out, asked(tmp_path), train_dataset="us-tmd", trial_hash="0123456789abcdef", run_name="first", trial_index=4)
    document = reports.read_metrics(spark, out).first()
    means = {m: figures["window", m]["x"] for m in reports.SCORES}
    assert document["name"] == "first-us-tmd-01234567" and document["trial_index"] == 4 and {m: document[m] for m in means} == pytest.approx(means)
    assert reports.bad_matrices(reports.read_metrics(spark, out)).isEmpty() and sum(map(sum, document["matrix"])) == 18
    with open(f"{tmp_path}/report/metrics.json") as f:
        whole = json.load(f)
    assert whole["rows"] == 60 and whole["source_rows"] == 24 and whole["collector_rows"] == 36 and whole["feature_names"] == ["a#mean", "b#mean"] and whole["best_params"] == {"family": "random_forest", "numTrees": 3, "maxDepth": 3}
    section = whole["collector_holdout"]
    assert section["sessions"] == 9 and section["session_level"]["rows"] == 9 and set(section["per_class"]) == set(MODES) and set(section["by_phone_position"]) <= {"hand", "unknown"}
    assert list(section["classification_report"]) == ["bus", "car", "walk", "accuracy", "macro avg", "weighted avg"] and section["classification_report"]["macro avg"]["support"] == 18
    assert spark.read.parquet(f"{out}/splits").select("fingerprint").distinct().count() == 1
    assert spark.read.json(f"{out}/trials").first()["state"] == "complete"
    again = ml.predict(ml.load_model(f"{out}/model"), rows, ["a#mean", "b#mean"], [0, 1, 2])
    assert again.exceptAll(ml.predict(run.model, rows, ["a#mean", "b#mean"], [0, 1, 2])).isEmpty() and ml.load_model(f"{out}/model")[1] == run.model[1]
    roles = protocols.with_roles(rows, run.splits, "group_id")
    assert {r["role"]: r["rows"] for r in protocols.lineage(roles, ["session_id", "window_start_ms"]).collect()} == {"training": 24, "calibration": 18, "evaluation": 18}


def test_participant_nested(rows, tmp_path):
    run = protocols.participant_nested(rows, asked(tmp_path))
    pooled = run.predictions["collector_holdout"]
    assert pooled.count() == 36 and protocols.incomplete(rows.where("domain = 'collector'"), pooled).isEmpty()
    assert [o["held_out"] for o in run.folds] == ["p0", "p1", "p2"] and [t.study for t in run.trials] == ["p0", "p1", "p2", "final"]
    inner = run.splits.where("held_out = grp")
    assert inner.isEmpty() and run.splits.where("held_out = 'none'").count() == 3
    assert protocols.incomplete(pooled, pooled.limit(35)).count() == 1
    roles = protocols.with_roles(rows, run.splits, "participant_id")
    found = {r["role"]: (r["rows"], r["digest"]) for r in protocols.lineage(roles, ["session_id", "window_start_ms"]).collect()}
    assert {k: n for k, (n, _) in found.items()} == {"training": 24, "calibration": 36, "evaluation": 36} and found["calibration"] == found["evaluation"]
    some = run.splits.where("grp <> 'p1'")
    with pytest.raises(Exception, match="no role for p1"):
        protocols.with_roles(rows, some, "participant_id").collect()


@pytest.mark.parametrize("metric", ["macro_f1", "minimum_class_recall"])
def test_trials_are_chosen(rows, tmp_path, metric):
    """Of three trials of two families the one of the best pooled score is fitted."""
    trials = [("random_forest", {"numTrees": 1, "maxDepth": 0}), FOREST, ("multilayer_perceptron", {"hidden": "3_2", "maxIter": 2})]
    run = protocols.session_holdout(rows, asked(tmp_path, trials, metric=metric))
    assert [t.number for t in run.trials][0] == 1 and run.parameters == FOREST[1] and run.family == FOREST[0]
    folds = run.splits.where("fold IS NOT NULL").select(F.col("grp").alias("group_id"), "fold")
    collector, prepare = rows.where("domain = 'collector'"), protocols._weighted(asked(tmp_path), True)
    pooled = ml.cross_validated(rows.where("domain <> 'collector'"), collector, folds, "group_id", ["a#mean", "b#mean"], [0, 1, 2], *FOREST, prepare, "weight", 1)
    assert run.trials[0].score == pytest.approx(metrics.overall(metrics.confusion(pooled, [0, 1, 2])).first()[metric])


def test_trials_are_pruned(rows, tmp_path):
    """Trials that are behind at the first rung stop there, are noted, and are never chosen."""
    good, poor = FOREST, ("random_forest", {"numTrees": 1, "maxDepth": 0})
    early = [i for i in range(40) if search.Rungs("final", 3).bracket(i) == 0][:2]
    trials = [poor if i == early[1] else good for i in range(early[1] + 1)]
    run = protocols.session_holdout(rows, asked(tmp_path, trials, folds=3, pruned=True))
    found = {t.number: (t.state, len(t.steps)) for t in run.trials}
    assert found[early[1]] == ("pruned", 1) and found[early[0]] == ("complete", 3) and run.trials[-1].number == early[1]
    assert protocols.trials_table(rows.sparkSession, run.trials).where("state = 'pruned'").count() == 1


def test_searched(rows, tmp_path):
    spaces = {"random_forest": {"numTrees": search.Number(1, 3, step=1), "maxDepth": search.Choice((1, 2))}}
    run = protocols.session_holdout(rows, asked(tmp_path, [], spaces=spaces, searched=2))
    assert sorted(t.parameters["numTrees"] for t in run.trials) == sorted(search.suggest(spaces, [], 1, i)[1]["numTrees"] for i in range(2))


def test_protocol_errors(rows, tmp_path):
    with pytest.raises(ValueError, match="missing: c#mean"):
        ml.combined(rows.where("domain = 'us-tmd'"), rows.where("domain = 'collector'"), ["a#mean", "c#mean"])
    with pytest.raises(ValueError, match="no source"):
        protocols.session_holdout(rows.where("domain = 'collector'"), asked(tmp_path))
    collector = rows.where("domain = 'collector'")
    with pytest.raises(ValueError, match="fewer than 2 of group_id: bus"):
        splits.holdout(collector.where("label <> 0 OR group_id LIKE '%collector-0-0-0'"), 0.5, 1, modes=MODES)
    with pytest.raises(ValueError, match="not configured"):
        splits.holdout(collector, 0.5, 1, modes={"bus": 0, "car": 1})
    with pytest.raises(ValueError, match="exactly one label"):
        splits.holdout(collector.withColumn("group_id", F.col("participant_id")), 0.5, 1)
    with pytest.raises(ValueError, match="three participants"):
        protocols.participant_nested(rows.where("domain <> 'collector' OR participant_id <> 'p2'"), asked(tmp_path))
    with pytest.raises(ValueError, match="at least two"):
        splits.group_kfold(collector.limit(1), 5, 1)
    assert splits.group_kfold(collector.where("label = 0 AND participant_id = 'p0'"), 5, 1).select("fold").distinct().count() == 2
    per_mode = splits.holdout(collector, {0: 0.9, 1: 0.2, 2: 0.5}, 1).where("role = 'calibration'").groupBy("label").count()
    assert {r["label"]: r["count"] for r in per_mode.collect()} == {0: 5, 1: 1, 2: 3}


def test_mixed_sessions(spark):
    pred = spark.createDataFrame([("a", 0, 0, [1.0, 0.0]), ("a", 1, 0, [1.0, 0.0])], "session_id string, truth int, prediction int, probabilities array<double>")
    assert metrics.session_vote(pred, [0, 1]).first()["truths"] == 2
    with pytest.raises(Exception, match="more than one true label"):
        metrics.session_vote(pred, [0, 1], strict=True).collect()


def test_grid():
    drawn = ml.grid("random_forest", 5, 3)
    assert len(drawn) == 5 and drawn == ml.grid("random_forest", 5, 3) and all(drawn.count(x) == 1 for x in drawn)
    assert all(set(x) == set(ml.SPACE["random_forest"]) for x in drawn)
