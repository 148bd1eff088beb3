"""The stateful stream against windows cut by hand."""

import json

from pyspark.sql import functions as F

from tramline.streaming import incremental

HOUR = 3_600_000


def _drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"session_id": s, "timestamp_ms": t, "v": v}) for s, t, v in rows))


def _expected(rows, window, step):
    out = set()
    for session in {s for s, _, _ in rows}:
        own = [(t, v) for s, t, v in rows if s == session]
        first, last = min(t for t, _ in own), max(t for t, _ in own)
        for start in range(first, last + 1, step):
            values = [v for t, v in own if start <= t < start + window]
            if values:
                out.add((session, start, len(values), round(sum(values) / len(values), 9)))
    return out


def _run(spark, tmp_path, window, step):
    source = spark.readStream.schema("session_id string, timestamp_ms long, v double").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    rows = source.withColumn("ts", F.timestamp_millis("timestamp_ms"))
    out = incremental.stream_windows(rows, window, step, "0 seconds")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    return [(r["session_id"], r["window_start_ms"], r["n"], round(r["mean"], 9)) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


def test_stream_windows(spark, tmp_path):
    # In order of time, an hour after the epoch (rows at or below the watermark, 0 at first, are late).
    own = [("a", HOUR + 250 * i, float(i)) for i in range(13)] + [("b", HOUR + 700 + 900 * i, -float(i)) for i in range(4)] + [("a", HOUR + 9000, 5.0)]
    own.sort(key=lambda r: r[1])
    _drop(tmp_path / "in", "0.json", own[:10])
    # A second run goes on from the first one's state; an hour later everything before is closed.
    _run(spark, tmp_path, 1000, 500)
    _drop(tmp_path / "in", "1.json", own[10:])
    _run(spark, tmp_path, 1000, 500)
    _drop(tmp_path / "in", "2.json", [("c", 2 * HOUR, 0.0)])
    found = _run(spark, tmp_path, 1000, 500)
    assert len(found) == len(set(found))
    assert set(found) == _expected(own, 1000, 500)


def test_state_is_panes(spark, tmp_path):
    """A thousand rows of an open window are a few panes of state; a long silence is passed over at once."""
    own = [("a", HOUR + 3 * i, float(i % 10)) for i in range(2000)]
    _drop(tmp_path / "in", "0.json", own)
    _run(spark, tmp_path, 4000, 1500)
    (held,) = spark.read.format("statestore").load(f"{tmp_path}/mark").select("value.groupState.*").collect()
    # Two windows have closed; of the third one six panes are held.
    assert sum(held["counts"]) == 1000 and held["panes"] == list(range(6, 12))
    late = [("a", 3 * HOUR * 1000 + 7, 1.0)]
    _drop(tmp_path / "in", "1.json", late)
    _run(spark, tmp_path, 4000, 1500)
    _drop(tmp_path / "in", "2.json", [("z", 9 * HOUR * 1000, 0.0)])
    found = _run(spark, tmp_path, 4000, 1500)
    near = {x for x in _expected(own, 4000, 1500)}
    assert near <= set(found) and len(found) == len(set(found))
    rest = set(found) - near
    assert rest and all(n == 1 and mean == 1.0 and start <= late[0][1] < start + 4000 and (start - HOUR) % 1500 == 0 for _, start, n, mean in rest)
