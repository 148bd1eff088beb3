"""Policies, guards, incremental builds, marks, snapshots and report checks."""

import json

import pytest
from pyspark.sql import functions as F

from tramline.operators import digest, features, reports, snapshot
from tramline.schema import NOR_COLUMNS
from tramline.sources import readers, store
from tramline.streaming import incremental


def test_policy_and_incremental_features(spark, tmp_path):
    root = f"file://{tmp_path}/f"
    events = spark.createDataFrame([("collector", s, t) for s in "ab" for t in (0, 1)], "domain string, session_id string, timestamp_ms long")
    built = []

    def build(own):
        built.append(sorted(r[0] for r in own.select("session_id").distinct().collect()))
        return own.where("session_id <> 'none'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))

    policy = store.feature_policy("collector", "h", (30, 100), {"pressure": 2.0}, 500)
    for part in (events.where("session_id = 'a'"), events, events, events.unionByName(events.limit(1).withColumn("session_id", F.lit("none")))):
        store.build_source(part, root, "collector", policy, build, incremental=True)
    assert built == [["a"], ["b"], [], ["none"]] and store.read_features(spark, root, "collector").count() == 2
    # Sessions without a window are in the ledger: they aren't built again.
    store.build_source(events.withColumn("session_id", F.lit("none")), root, "collector", policy, build, incremental=True)
    assert built[-1] == []
    store.build_source(events, root, "collector", store.feature_policy("collector", "h", (30, 100), {"pressure": 3.0}, 500), build, incremental=True)
    assert built[-1] == ["a", "b"] and store.read_features(spark, root, "collector").count() == 2
    source = events.withColumn("domain", F.lit("us-tmd"))
    assert store.build_source(source, root, "us-tmd", store.feature_policy("us-tmd", "h", (30, 100)), build)
    assert not store.build_source(source, root, "us-tmd", store.feature_policy("us-tmd", "h", (30, 100)), build)
    with pytest.raises(ValueError, match="got events of us-tmd"):
        store.build_source(source, root, "collector", policy, build)
    with pytest.raises(ValueError, match="no feature rows"):
        store.build_source(source.withColumn("domain", F.lit("x")), root, "x", store.feature_policy("x", "h", (0, 1)), lambda x: x.limit(0))
    with pytest.raises(FileNotFoundError):
        store.read_features(spark, root, "nothing")


def test_hashes_and_paths():
    trial = {"run_name": "x", "labels": {"car": 0}, "training": {"seed": 1}}
    cache, full = store.trial_hashes(trial)
    assert store.trial_hashes({**trial, "run_name": "y"}) == (cache, full)
    other = store.trial_hashes({**trial, "training": {"seed": 2}})
    assert other[0] == cache and other[1] != full and store.run_paths("/r", trial, "us-tmd")["report"] == f"/r/{cache}/reports/us-tmd/{full}"


def test_marks(spark):
    marks = spark.createDataFrame([("a", 1, "k5"), ("b", 2, "k3")], "source string, version int, sync_key string")
    seen = spark.createDataFrame([("k2",), ("k4",)], "sync_key string")
    assert incremental.mark_of(marks, "a", 2) is None and incremental.mark_of(marks, "a", 1) == "k5" and incremental.mark_of(marks, "c") is None
    assert incremental.mark_of(incremental.advance_mark(marks, "a", seen, 1), "a", 1) == "k5"
    moved = incremental.advance_mark(incremental.advance_mark(marks, "a", seen, 2), "b", seen, 2)
    assert sorted(tuple(r) for r in moved.collect()) == [("a", 2, "k4"), ("b", 2, "k4")]


def test_snapshot_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    index = spark.createDataFrame([(f"sé{i}", "participant_001", "Car ", "1000", "61000") for i in range(3)], "session_id string, participant_id string, vehicle_type string, started_at_ms string, stopped_at_ms string")
    sessions = snapshot.snapshot_sessions(index)
    snapshot.write_snapshot(sessions, path, "r1", "k9")
    back = snapshot.read_snapshot(spark, path, "r1")
    assert [r["session_id"] for r in back.orderBy("session_id").collect()] == ["sé0", "sé1", "sé2"]
    row = snapshot.summary(back, "r1", "manifest").first()
    import hashlib

    expected = hashlib.sha256(json.dumps(["sé0", "sé1", "sé2"], ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()
    assert (row["sessions"], row["with_duration"], row["session_id_digest"]) == (3, 3, expected)
    assert [tuple(r)[:3] for r in snapshot.mode_summary(back).orderBy("mode").collect()] == [("Total", 3, 1), ("car", 3, 1)]
    with pytest.raises(ValueError, match="not 'r2'"):
        snapshot.read_snapshot(spark, path, "r2")
    back.limit(2).write.mode("overwrite").json(f"{path}2/sessions")
    spark.read.json(f"{path}/header").write.json(f"{path}2/header")
    with pytest.raises(ValueError, match="session_count"):
        snapshot.read_snapshot(spark, f"{path}2", "r1")
    with pytest.raises(ValueError, match="occurs 2 times"):
        snapshot.write_snapshot(sessions.union(sessions.limit(1)), path, "r1")
    lines = spark.createDataFrame([("x path=/data/downloaded_sessions/raw/a.json",), ("path=/data/downloaded_sessions/raw/b.json.gz",), ("path=/data/other/c.json",)], "value string")
    sides = spark.createDataFrame([("raw/a.json.metadata.json", 1), ("raw/z.json.metadata.json", 2)], "path string, n int")
    with pytest.raises(ValueError, match="1 session sidecars are missing; the first is raw/b.json.gz.metadata.json"):
        snapshot.sessions_of_log(lines, sides)
    assert snapshot.sessions_of_log(lines.limit(1), sides).count() == 1
    with pytest.raises(ValueError, match="no session paths"):
        snapshot.session_paths(lines.where("value LIKE '%other%'"))


def test_report_checks(spark):
    report = '{"bus": {"support": 10}, "car": {"support": 10}, "accuracy": 0.5}'
    rows = [("good", report, [[8.0, 2.0], [4.0, 6.0]]), ("sum", report, [[8.0, 3.0], [4.0, 6.0]]), ("shape", report, [[8.0, 2.0]]), ("none", report, None)]
    df = spark.createDataFrame(rows, "name string, r string, matrix array<array<double>>").withColumn("report", F.from_json("r", "map<string,string>"))
    assert {r["name"] for r in reports.bad_matrices(df).collect()} == {"sum", "shape", "none"}
    runs = spark.createDataFrame([("b", None), ("a", 2), ("c", 1)], "name string, trial_index int")
    assert [r["name"] for r in reports.in_order(runs).collect()] == ["c", "a", "b"]
    scores = spark.createDataFrame([("p", 0.5, 0.5, 0.5, 1.5)], "path string, accuracy double, balanced_accuracy double, macro_f1 double, minimum_class_recall double")
    with pytest.raises(ValueError, match="p: scores"):
        reports.check_scores(scores)


def test_names_and_gates(spark):
    assert [features.normal_name(x) for x in ("STD", "mean-absolute  deviation", "Dominant Frequency", "iqr")] == ["standard_deviation", "mean_absolute_deviation", "dominant_frequency_hz", "interquartile_range"]
    with pytest.raises(ValueError, match="unsupported"):
        features.normal_name("mode")
    own = spark.createDataFrame([("s", t, 1.0, None if t > 500 else 2.0, 3.0) for t in range(0, 1000, 100)], "session_id string, timestamp_ms long, ax double, ay double, az double")
    sensors = {"accelerometer": ("ax", "ay", "az")}
    assert features.window_features(own, sensors, 1000, 1000, rates={"accelerometer": 6}).count() == 1
    assert features.window_features(own, sensors, 1000, 1000, rates={"accelerometer": 7}).count() == 0
    wide = features.window_features(own, sensors, 1000, 1000, [500, 1000], {"accelerometer": ("mean", "iqr")})
    assert {c for c in wide.columns if "#" in c} == {f"accelerometer#{a}@{c}s" for a in ("mean", "interquartile_range") for c in ("1", "0.5")}
    assert features.window_features(own, sensors, 1000, 1000, seconds=(1.0, 9.0)).count() == 0


def test_source_files(spark, tmp_path):
    (tmp_path / "x y" / "deep").mkdir(parents=True)
    line = "1000,android.sensor.pressure,990\n1001,android.sensor.linear_acceleration,1,2,3\n"
    for name in ("x y/deep/r_U1_car_1.csv", "r_U2_car_1.CSV", "r_U3_car_1.txt", "short.csv"):
        (tmp_path / name).write_text(line)
    read = lambda **more: {r["participant_id"] for r in readers.read_us(spark, str(tmp_path), {"car": 0}, **more).collect()}
    assert read() == {"U1", "U2"} and read(globs=("**/deep/*.csv",)) == {"U1"} and read(globs=("r_U2*", "r_U2_*")) == {"U2"}
    one = readers.read("us-tmd", spark, f"{tmp_path}/r_U2_car_1.CSV", {"car": 0}).first()
    assert (one["domain"], one["device_id"], one["group_id"]) == ("us-tmd", "U2", "U2#U2#r_U2_car_1")
    rows = [["p1", "1", None, "a"], [None, "1", "2", "a"], ["p1", "1", "2", "a"]]
    full = [[*r[:3], None, "M", "2020-01-01T00:00:00Z", "car", "android.sensor.gyroscope", None, "1", "2", "3", "Android"] for r in rows]
    raw = spark.createDataFrame(full, ", ".join(f"{c} string" for c in NOR_COLUMNS))
    assert [(r["session_id"], r["device_id"], r["gx"]) for r in readers.normalize_nor(raw, {"car": 0}).collect()] == [("p1#1#2", "android:unknown:m", 1.0)]
    with pytest.raises(ValueError, match="registered already"):
        readers.register_source("collector", readers.read_collector)


def test_json_text(spark):
    ids = ["a", 'q"\\', "é", "😀", "\x01\n\x7f", "", "ÿ￿"]
    df = spark.createDataFrame([(x,) for x in ids], "x string")
    assert [r[0] for r in df.select(digest.json_text(F.col("x"))).collect()] == [json.dumps(x) for x in ids]
