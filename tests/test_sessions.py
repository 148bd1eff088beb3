import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators import balance, digest, features, metrics, reports, sessions, snapshot, splits, windows
from tramline.schema import EVENTS, NOR_COLUMNS
from tramline.sources import readers
from tramline.streaming import incremental


def events(spark, times, values=None, session="s", **more):
    values = values or [1.0] * len(times)
    rows = [{"session_id": session, "timestamp_ms": t, "p": v, "label": 0, **more} for t, v in zip(times, values, strict=True)]
    return spark.createDataFrame([{f.name: r.get(f.name) for f in EVENTS} for r in rows], EVENTS)


def starts(spark, times, rates=None, gap=None, window=1000, values=None):
    own = events(spark, times, values)
    out = features.window_features(own, {"pressure": ("p",)}, window, window, aggregates=("mean",), rates=rates, max_gap_ms=gap)
    return sorted(r["window_start_ms"] for r in out.collect())


@pytest.mark.parametrize(
    ("times", "rates", "gap", "found"),
    [
        ([0], None, None, [0]), ([0], {"pressure": 4}, 500, []), ([0, 100, 800, 900], None, 500, []), ([0, 500], None, 500, [0]),
        ([0, 900], None, None, [0]), ([0, 500, 1600, 1900, 2000, 2500], None, 500, [0, 2000]),
    ],
)
def test_gate(spark, times, rates, gap, found):
    assert starts(spark, times, rates, gap) == found


def test_sensor_never_present(spark):
    assert starts(spark, [0, 500], values=[None, None]) == []


def test_sine(spark):
    times = list(range(0, 4001, 100))
    own = events(spark, times, [math.sin(2 * math.pi * t / 1000) for t in times])
    out = features.window_features(own, {"pressure": ("p",)}, 4000, 4000, [2000, 4000], features.AGGREGATES).collect()
    assert len(out) == 1
    for at in ("@4s", "@2s"):
        assert abs(out[0][f"pressure#dominant_frequency_hz{at}"] - 1) <= 0.1
        assert out[0][f"pressure#spectral_energy{at}"] > 0 and 0 <= out[0][f"pressure#spectral_entropy{at}"] <= 1


def test_equal_powers_have_the_lowest_frequency():
    """A single peak has the same power at all frequencies."""
    for n in range(4, 13):
        for peak in range(n):
            for low, high in ((34.77, 12.1), (0.03, 99.99), (71.28, 71.29)):
                values = np.full(n, low)
                values[peak] = high
                energy, frequency, _ = features.spectrum(np.arange(n) * 1000.0, values)
                assert energy > 0 and frequency == pytest.approx(1 / n)


def test_statistics_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=17)
    own = spark.createDataFrame([("a", int(i * 100), float(x)) for i, x in enumerate(v)], "k string, timestamp_ms long, v double")
    r = features.statistics(own, ["k"]).first()
    n, d = len(v), v - v.mean()
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert r["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert r["interquartile_range"] == pytest.approx(np.percentile(v, 75) - np.percentile(v, 25))
    jerk = np.diff(v) / 0.1
    assert r["mean_absolute_jerk"] == pytest.approx(np.abs(jerk).mean()) and r["jerk_standard_deviation"] == pytest.approx(jerk.std())


def test_axis_correlation_constant(spark):
    own = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 4.0, 5.0)], "k string, x double, y double, z double")
    assert features.axis_correlation(own, ["k"], ("x", "y", "z")).first()["mean_axis_correlation"] == pytest.approx(1)


def test_minimum_samples():
    assert windows.minimum_samples(30, 0.5) == 15 and windows.minimum_samples(0.1, 1) == 1


def test_us_files(spark, tmp_path):
    (tmp_path / "sensorfile_U1_car_123.csv").write_text("1000,android.sensor.accelerometer,1,2,3\n1001,android.sensor.pressure,990\n1002,light,1\n1003,android.sensor.pressure,x\n1004,android.sensor.accelerometer,1,2,3,9,9\n")
    (tmp_path / "sensorfile_U1_boat_1.csv").write_text("1000,android.sensor.pressure,1\n")
    rows = readers.read("us-tmd", spark, str(tmp_path), {"car": 3}).orderBy("timestamp_ms").collect()
    assert [(r["timestamp_ms"], r["ax"], r["p"]) for r in rows] == [(1000, 1.0, None), (1001, None, 990.0), (1004, 1.0, None)]
    assert rows[0]["participant_id"] == "U1" and rows[0]["session_id"] == "sensorfile_U1_car_123" and rows[0]["label"] == 3


def test_nor_rows(spark, tmp_path):
    line = "p1,1,2,Apple,X,2020-01-01T00:00:00.500Z,CAR,CMAccelerometerData,hand,1,0,0,iOS"
    (tmp_path / "a.CSV").write_text(",".join(NOR_COLUMNS) + "\n" + line + "\n")
    r = readers.read("nor-tmd", spark, str(tmp_path), {"car": 0}).first()
    assert r["session_id"] == "p1#1#2" and r["ax"] == pytest.approx(9.80665) and r["timestamp_ms"] == 1577836800500 and r["device_id"] == "ios:apple:x"
    with pytest.raises(ValueError, match="missing"):
        readers.normalize_nor(spark.createDataFrame([("a",)], "OS string"), {})
    with pytest.raises(ValueError):
        readers.read("none", spark, "", {})


def test_collector_incremental(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()

    def put(name, **own):
        (raw / f"{name}.json").write_text(json.dumps({"vehicle_type": "Car", "samples": [{"ts": 1, "p": 1.5}, {"ts": 9, "p": 2}], **own}))

    put("a", session_id="a", trimmed_start_ms=1, trimmed_end_ms=5)
    (raw / "a.json.metadata.json").write_text(json.dumps({"participant_id": "participant_001"}))
    rows = readers.read("collector", spark, str(raw), {"car": 1}).collect()
    assert [(r["participant_id"], r["timestamp_ms"], r["p"]) for r in rows] == [("participant_001", 1, 1.5)]
    for name, expected in (("a", {"a"}), ("b", {"a", "b"})):
        put(name, session_id=name)
        for _ in range(2):
            incremental.append_new(readers.read("collector", spark, str(raw), {"car": 1}), f"file://{out}")
        assert {r["session_id"] for r in incremental.processed_sessions(spark, f"file://{out}").collect()} == expected
    assert incremental.processed_sessions(spark, f"file://{out}").count() == spark.read.parquet(str(out)).select("session_id").distinct().count()
    assert not readers.write_events(spark.read.parquet(str(out)), str(out)) and spark.read.parquet(str(out)).count() == 4


def test_stream_available(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"session_id": "a", "v": 1}\n')
    schema = spark.createDataFrame([], "session_id string, v int").schema
    for n, more in ((1, None), (2, '{"session_id": "b", "v": 1}\n{"session_id": "a", "v": 2}\n'), (2, None)):
        if more:
            (src / "2.json").write_text(more)
        incremental.run_available(spark, str(src), schema, str(tmp_path / "t"), str(tmp_path / "c"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n


def test_splits_and_weights(spark):
    rows = [(m, f"g{m}{g}", f"p{g}") for m in range(3) for g in range(5) for _ in range(2)]
    df = spark.createDataFrame(rows, "label int, group_id string, participant_id string")
    for fraction, n in ((0.8, 4), (0.4, 2), (0.01, 1), (0.99, 4)):
        got = splits.holdout(df, fraction, 1).where("role = 'calibration'").groupBy("label").count().collect()
        assert {r["count"] for r in got} == {n}
    folds = splits.group_kfold(df, 4, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [3, 4, 4, 4]
    assert splits.leave_one_out(df).where("role = 'test'").count() == 5
    strat = splits.stratified_group_kfold(df, 3, 1)
    assert strat.count() == 5 and {r["fold"] for r in strat.collect()} == {0, 1, 2}
    feat = spark.createDataFrame([("source", 0, "p", "s", 0, 1), ("source", 0, "p", "s", 1, 2), ("collector", 0, "q", "t", 0, 1)], "domain string, label int, participant_id string, session_id string, window_start_ms long, window_end_ms long")
    mass = {r["domain"]: r["w"] for r in balance.hierarchical_weights(feat, 2.0).groupBy("domain").agg(F.sum("weight").alias("w")).collect()}
    assert mass["collector"] == pytest.approx(2 * mass["source"]) and sum(mass.values()) == pytest.approx(3)


def test_duration_balance(spark):
    rows = [("collector", m, f"p{m}{i % 2}", f"s{m}{i}", 0, 100_000) for m, n in ((0, 2), (1, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "domain string, label int, participant_id string, session_id string, window_start_ms long, window_end_ms long")
    got = {r["label"]: r for r in balance.balance_report(df, 3).collect()}
    assert all(r["target"] == 200 and r["sessions"] == 2 for r in got.values())
    assert balance.balance_durations(df, 3).where("label = 1").select("participant_id").distinct().count() == 2


def test_metrics_votes_digests(spark):
    pred = spark.createDataFrame([("a", 0, 0, [1.0, 0.0]), ("a", 0, 1, [0.4, 0.6]), ("b", 1, 1, [0.5, 0.5])], "session_id string, truth int, prediction int, probabilities array<double>")
    all_ = metrics.overall(metrics.confusion(pred, [0, 1, 2])).first()
    assert all_["accuracy"] == pytest.approx(2 / 3) and all_["balanced_accuracy"] == pytest.approx(0.5) and all_["minimum_class_recall"] == 0
    assert {r["session_id"]: r["prediction"] for r in metrics.session_vote(pred, [0, 1]).collect()} == {"a": 0, "b": 0}
    one = digest.dataset_digest(pred, ["session_id", "truth"]).first()["digest"]
    assert one == digest.dataset_digest(pred.orderBy(F.desc("session_id")), ["session_id", "truth"]).first()["digest"]
    assert one != digest.dataset_digest(pred.where("session_id = 'a'"), ["session_id", "truth"]).first()["digest"] and len(one) == 36


def test_snapshot(spark):
    index = spark.createDataFrame([("participant_001", "raw/participant_001/a/x.json"), ("test_001", "raw/test_001/a"), ("participant_002", "raw/participant_001/a")], "participant_id string, s3_key string")
    assert [r["participant_id"] for r in index.where(snapshot.is_eligible()).collect()] == ["participant_001"]
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a//b",), ("a/../b",), ("",), ("a.b/c..d",)], "p string")
    assert [r["p"] for r in paths.where(~snapshot.unsafe_path(F.col("p"))).collect()] == ["a/b", "a.b/c..d"]
    own = spark.createDataFrame([("s", "1000", "61000", "")], "session_id string, started_at_ms string, stopped_at_ms string, sample_count string")
    assert snapshot.snapshot_sessions(own).first()["duration_seconds"] == 60
    from tramline.functions.scalars import hms

    assert spark.range(1).select(hms(F.lit(3155.0)).alias("a"), hms(F.lit(189300.0)).alias("b")).first()[:] == ("00:52:35", "52:35:00")


def test_reports(spark, tmp_path):
    for i, m in enumerate(([[8, 2], [4, 6]], [[9, 1], [1, 9]])):
        (tmp_path / f"r{i}" / "x").mkdir(parents=True)
        report = {"bus": {"precision": 1, "recall": 0.5, "f1-score": 0.6, "support": 10}, "car": {"precision": 1, "recall": 0.5 + i / 10, "f1-score": 0.6, "support": 10}, "accuracy": 0.7, "macro avg": {"recall": 1}}
        held = {"accuracy": 0.7 + i / 5, "balanced_accuracy": 0.7, "macro_f1": 0.7 + i / 5, "minimum_class_recall": 0.6, "classification_report": report, "confusion_matrix": m}
        (tmp_path / f"r{i}" / "x" / "metrics.json").write_text(json.dumps({"config_hash": "c" * 12, "trial_hash": f"{i}" * 12, "train_dataset": "us", "collector_holdout": held}))
    own = reports.read_metrics(spark, str(tmp_path))
    assert [r["name"] for r in reports.top_runs(own, "macro_f1", 2, ["name"]).collect()] == ["us-11111111", "us-00000000"]
    assert reports.invalid_scores(own).isEmpty() and reports.bad_matrices(own).isEmpty()
    wide = reports.pivot(reports.mode_scores(own), "name", "mode", "recall", ["car"])
    assert {r["name"]: r["car"] for r in wide.collect()} == {"us-00000000": 0.5, "us-11111111": 0.6}


def test_session_filters(spark):
    own = events(spark, [0, 30_000]).unionByName(events(spark, [0, 29_999], session="t"))
    assert {r["session_id"] for r in sessions.filter_duration(own, 30, 100).collect()} == {"s"}
    assert {r["session_id"] for r in sessions.pending(own, own.where("session_id = 's'")).collect()} == {"t"}


def test_entry_point():
    import __spark_entry__ as e

    assert callable(e.entry) and set(e.oracle_sql()) <= set(e.queries())
