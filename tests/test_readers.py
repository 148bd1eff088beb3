"""Globs, zones, two-phase ingest, partial datasets, and what is too large for one task."""

import gzip
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tramline.functions import scalars as S
from tramline.operators import features, quantiles, sessions, windows
from tramline.sources import readers

LABELS = {"car": 0, "bus": 1}


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w")).write(text)


@pytest.mark.parametrize("glob, expected", [
    ("a/*.csv", {"a/y.csv"}), ("**/*.csv", {"a/y.csv", "x/a/y.csv", "x/a/z1.csv", "x.csv/w.csv", "top.csv"}), ("**/z[0-9].csv", {"x/a/z1.csv"}), ("**/[!yz]*.csv", {"x.csv/w.csv", "top.csv"}), ("*.csv", {"top.csv"}), ("x/**/y.csv", {"x/a/y.csv"}), ("x.csv/*", {"x.csv/w.csv"}), ("?op.csv", {"top.csv"}),
])
def test_globs(spark, tmp_path, glob, expected):
    for name in ("a/y.csv", "x/a/y.csv", "x/a/z1.csv", "x.csv/w.csv", "top.csv"):
        put(tmp_path / "in", name, "1000,accelerometer,1,2,3\n")
    reader, asked = readers._csv(spark, f"file://{tmp_path}/in", (glob,))
    got = reader.schema("a string").csv(f"file://{tmp_path}/in").where(asked).select(F.col("_metadata.file_path")).collect()
    assert {r[0].split("/in/", 1)[1] for r in got} == expected
    assert {str(p.relative_to(tmp_path / "in")) for p in (tmp_path / "in").glob(glob) if p.is_file()} == expected


def test_a_folder_named_like_a_file(spark, tmp_path):
    put(tmp_path, "d.csv/t_p1_car_1.csv", "1000,accelerometer,1,2,3\n")
    put(tmp_path, "d.csv/sub/t_p2_car_1.csv", "1000,accelerometer,1,2,3\n")
    assert [r["participant_id"] for r in readers.read_us(spark, f"{tmp_path}/d.csv", LABELS, ("*.csv",)).collect()] == ["p1"]
    assert readers.read_us(spark, f"{tmp_path}/d.csv/sub/t_p2_car_1.csv", LABELS, ("nothing",)).count() == 1


def test_zones(spark):
    given = {"2020-01-01T00:00:00": 1577836800000, " 2020-01-01 00:00:00 ": 1577836800000, "2020-01-01": 1577836800000, "2020-01-01T00:00:00Z": 1577836800000, "2020-01-01T02:00:00+02:00": 1577836800000, "2020-01-01T00:00:00.250": 1577836800250, "2020-07-01T00:00": 1593561600000, "2020-03-08T02:30:00": 1583634600000, "x": None, "": None}
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("America/New_York", "Asia/Kolkata", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            df = spark.createDataFrame([(k,) for k in given], "x string").select("x", S.iso_ms(F.col("x")).alias("ms"))
            assert {r["x"]: r["ms"] for r in df.collect()} == given
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


def payload(session, mode="car", n=3):
    return json.dumps({"session_id": session, "vehicle_type": mode, "participant_id": "p", "samples": [{"ts": 1000 + i, "p": 1.0 + i} for i in range(n)]})


def test_collector_in_two_phases(spark, tmp_path):
    put(tmp_path, "a/one.json", payload("s1"))
    put(tmp_path, "b/two.json.gz", payload("s1", n=9))
    put(tmp_path, "b/three.json.gz", payload("s3", n=2))
    put(tmp_path, "b/three.json.gz.metadata.json", json.dumps({"participant_id": "side"}))
    put(tmp_path, "b/four.json", payload("s4", "boat"))
    got = readers.read_collector(spark, str(tmp_path), LABELS)
    assert sorted((r["session_id"], r["participant_id"], r["timestamp_ms"]) for r in got.collect()) == [("s1", "p", 1000), ("s1", "p", 1001), ("s1", "p", 1002), ("s3", "side", 1000), ("s3", "side", 1001)]
    assert readers.read_collector(spark, str(tmp_path / "b/three.json.gz"), LABELS).count() == 2
    exchanges = [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "samples" in line]
    assert not exchanges
    # More sessions than are sent to the tasks.
    payloads = spark.createDataFrame([(f"/x/{i}", [(str(j), None, None, None, None, None, None, None, None, None, "1") for j in range(3)]) for i in range(9)], f"path string, samples array<struct<ts string, {', '.join(f'{c} string' for c in readers.VALUES)}>>")
    chosen = payloads.select("path", F.concat(F.lit("s"), "path").alias("session_id"), *[F.lit("x").alias(c) for c in ("participant_id", "device_id", "vehicle_type", "phone_position")], *[F.lit(None).cast("bigint").alias(c) for c in "se"], F.lit(1).alias("label"))
    assert readers.collector_events(payloads, chosen, sent=4).count() == readers.collector_events(payloads, chosen).count() == 27


def test_partial_and_taken(spark, tmp_path):
    events = readers.coerce(spark.createDataFrame([("s", 1, 0), ("t", 2, 1)], "session_id string, timestamp_ms long, label int"))
    path = f"{tmp_path}/events"
    assert readers.write_events(events, path) and not readers.write_events(events.limit(1), path)
    (tmp_path / "events/_SUCCESS").unlink()
    put(tmp_path, "events/part-junk.parquet", "junk")
    assert readers.write_events(events, path) and spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="registered already"):
        readers.register_source(readers.US, readers.read_us)


def test_medians(spark):
    rng = random.Random(4)
    values = {"even": [rng.gauss(0, 1) for _ in range(4000)], "odd": [rng.choice([1.0, 2.0, 2.0, 1e300, -1e300]) for _ in range(3001)], "same": [7.0] * 2500, "two": [1.0] * 1500 + [3.0] * 1500, "near": [1.0, 1.0 + 2**-52] * 1200, "small": [5.0, 1.0, 9.0], None: [2.0, 4.0]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("none", None), ("none", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    for cells in (4, 4096):
        got = {r["k"]: r["median"] for r in quantiles.median(df, ["k"], "v", most=2000, cells=cells).collect()}
        assert got == {k: statistics.median(own) for k, own in values.items()}
    assert quantiles.median(df.limit(0), ["k"], "v").count() == 0


def test_hot_session_is_spread(spark):
    """Half of all events are one session's: its windows equal those of the plain path, and no task has more than a part of it."""
    rng = random.Random(6)
    rows = [("hot" if i % 2 else f"s{i % 10}", rng.randrange(10**6), float(i % 97), "car") for i in range(6000)]
    events = spark.createDataFrame(rows, "session_id string, timestamp_ms long, p double, vehicle_type string")
    own = events.where("session_id = 'hot'")
    stats = sessions.sliced_stats(own, 5000, 20000)
    plain = sessions.session_stats(own, 5000)
    assert stats.collect() == plain.collect()
    cut = windows.assign_sliced(own, stats, 12000, 5000, 50000)
    whole = windows.assign_windows(own, plain, 12000, 5000)
    assert cut.drop("slice").select(*whole.columns).exceptAll(whole).isEmpty() and cut.count() == whole.count()
    copies = own.count() * 1.5
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = windows.assign_sliced(own, stats, 12000, 5000, 50000).select("timestamp_ms", "p", F.spark_partition_id().alias("t")).distinct().groupBy("t").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) > 6 and max(r["count"] for r in tasks) < copies / 3
    asked = dict(window_ms=12000, step_ms=5000, contexts_ms=[5000, 12000], aggregates=("mean", "range", "delta_from_session_baseline", "kurtosis"), rates={"pressure": 0.1}, max_gap_ms=9000)
    sensors = {"pressure": ("p",)}
    sliced = features.window_features(events, sensors, **asked, most=1000, slice_steps=4)
    plain = features.window_features(events, sensors, **asked)
    assert sliced.count() == plain.count() > 100
    rounded = lambda df: df.select(*[F.round(F.col(f"`{c}`"), 3).alias(c) if "#" in c else F.col(f"`{c}`") for c in plain.columns])
    assert rounded(sliced).exceptAll(rounded(plain)).isEmpty()
    with pytest.raises(ValueError, match="number of steps"):
        windows.assign_sliced(own, stats, 12000, 5000, 12000)
