"""Ranks, sums and draws in parts equal those made in one piece."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import balance, metrics, splits


@pytest.fixture(scope="module")
def sessions(spark):
    rng = random.Random(12)
    # Each participant has one session of a label, or many; ids share a beginning.
    rows = [(f"participant-{rng.randrange(300):04d}", f"s{i}", i % 3, rng.randrange(1000, 90_000) / 1000.0) for i in range(900)]
    return spark.createDataFrame(rows, "participant_id string, session_id string, label int, seconds double").repartition(3), rows


def md5(seed, x):
    return hashlib.md5(f"{seed}{x}".encode()).hexdigest()


def test_sessions_are_selected_as_in_one_piece(spark, sessions):
    df, rows = sessions
    keys = {r["session_id"]: r["k"] for r in df.select("session_id", balance.S.shuffle_key(4, "session_id").alias("k")).collect()}
    target = min(round(sum(r[3] for r in rows if r[2] == label), 3) for label in range(3))
    expected = set()
    for label in range(3):
        rounds, total = {}, 0.0
        for p in {r[0] for r in rows if r[2] == label}:
            for n, r in enumerate(sorted((r for r in rows if r[2] == label and r[0] == p), key=lambda r: (keys[r[1]], r[1]))):
                rounds.setdefault(n, []).append(r)
        for n in sorted(rounds):
            for r in sorted(rounds[n]):
                if round(total, 3) < target:
                    expected.add((r[1], n + 1))
                total += r[3]
    assert {(r["session_id"], r["round"]) for r in balance.select_sessions(df, 4).collect()} == expected
    assert len(expected) > 500 and balance.select_sessions(df.limit(0), 4).count() == 0


def test_holdout_as_in_one_piece(spark, sessions):
    df = sessions[0].withColumnRenamed("session_id", "group_id")
    keys = {r["group_id"]: (r["k"], r["group_id"], r["label"]) for r in df.select("group_id", "label", balance.S.shuffle_key(9, "group_id").alias("k")).collect()}
    expected = {}
    for label in range(3):
        own = sorted(k for k in keys.values() if k[2] == label)
        expected |= {g: "calibration" if n < max(1, min(int(len(own) * 0.3), len(own) - 1)) else "holdout" for n, (_, g, _) in enumerate(own)}
    assert {r["group_id"]: r["role"] for r in splits.holdout(df, 0.3, 9).collect()} == expected


def test_bootstrap_either_way(spark):
    rng = random.Random(2)
    pred = spark.createDataFrame([(f"p{rng.randrange(40)}", rng.randrange(3), rng.randrange(3)) for _ in range(900)], "participant_id string, truth int, prediction int")
    here, joined = (metrics.bootstrap_ci(pred, [0, 1, 2], 30, 5, sent=n).orderBy("metric").collect() for n in (10**6, 0))
    assert [r["metric"] for r in here] == [r["metric"] for r in joined] and [x for r in here for x in r[1:]] == pytest.approx([x for r in joined for x in r[1:]])
    assert len(here) == 7 and all(0 <= r["low"] <= r["high"] <= 1 for r in here)
    plan = metrics.bootstrap_ci(pred, [0, 1, 2], 30, 5)._jdf.queryExecution().executedPlan().toString()
    assert "participant_id" not in plan and "grp" not in plan


def test_leave_one_out_by_predicate(spark, sessions):
    df = sessions[0].withColumn("group_id", F.col("session_id"))
    sizes = {r["fold"]: r for r in splits.leave_one_out_sizes(df).collect()}
    for fold in ("participant-0001", "participant-0200"):
        roles = {r["role"]: r["count"] for r in df.withColumn("role", splits.fold_role(F.lit(fold), F.col("participant_id"))).groupBy("role").count().collect()}
        assert sizes[fold]["test_rows"] == roles.get("test", 0) == sizes[fold]["test_groups"] and sizes[fold]["train_rows"] == roles["train"]


def test_stratified_folds(spark):
    rng = random.Random(3)
    rows = [(f"g{g}", label) for g in range(60) for label in range(3) for _ in range((5, 40, 130)[(g + label) % 3] + rng.randrange(3))]
    df = spark.createDataFrame(rows, "participant_id string, label int")
    folds = {r["participant_id"]: r["fold"] for r in splits.stratified_group_kfold(df, 4, 7).collect()}
    assert len(folds) == 60 and set(folds.values()) == {0, 1, 2, 3}
    counts = [[sum(1 for g, x in rows if folds[g] == f and x == label) for f in range(4)] for label in range(3)]
    assert all(max(c) < 1.25 * min(c) for c in counts)
    assert folds == {r["participant_id"]: r["fold"] for r in splits.stratified_group_kfold(df.repartition(5), 4, 7).collect()}
    # Plain version of what is left over: each goes where counts stay most even.
    table = [("a", 5, {"0": 4.0, "1": 1.0}), ("b", 3, {"0": 1.0, "1": 4.0}), ("c", 8, {"0": 2.0})]
    assert {p: len(x) for p, x in splits.dealt(table, 4).items()} == {"a": 1, "b": 3, "c": 0}
    with pytest.raises(ValueError, match="at least two"):
        splits.dealt([("a", 1, {"0": 1.0})], 4)


def test_stratified_folds_of_many_groups(spark):
    """A million groups of few profiles: one row a profile is dealt, sizes of folds and of labels in folds are even."""
    df = spark.range(1_000_000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("participant_id"), (F.col("id") % 5).cast("int").alias("label"))
    assert splits.profiles(df).select("profile").distinct().count() == 5
    found = splits.stratified_group_kfold(df, 4, 1).join(df, "participant_id").groupBy("fold", "label").count().collect()
    assert len(found) == 20 and {r["count"] for r in found} == {50_000}
