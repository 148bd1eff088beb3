"""Session index, snapshots and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .digest import session_digest

#: Who takes part, and the fields of a snapshot.
PARTICIPANT = r"^participant_\d{3}$"
LOGGED = r"path=/data/downloaded_sessions/(.+(?:\.json|\.json\.gz))$"
VERSION = 1
TEXT_FIELDS = ("session_id", "participant_id", "device_uuid", "vehicle_type", "phone_position", "s3_key", "sync_key")
NUMBER_FIELDS = ("sample_count", "uploaded_at_ms", "started_at_ms", "stopped_at_ms", "trimmed_start_ms", "trimmed_end_ms")


def is_eligible() -> Column:
    """A participant by pattern, with a key below raw/<participant>/."""
    part = F.split("s3_key", "/")
    return F.coalesce(F.col("participant_id").rlike(PARTICIPANT) & (F.size(part) >= 3) & (F.get(part, F.lit(0)) == "raw") & (F.get(part, F.lit(1)) == F.col("participant_id")), F.lit(False))


def unsafe_path(path: Column) -> Column:
    """Absolute or empty paths, and those with empty, `.` or `..` parts."""
    return path.isNull() | (path == "") | path.rlike(r"(^|/)(\.{1,2})?(/|$)")


def since(index: DataFrame, mark: str | None) -> DataFrame:
    """Received rows of the index after the high-water mark."""
    rows = index.where("sync_partition = 'received'")
    return rows if mark is None else rows.where(F.col("sync_key") > mark)


def high_water_mark(rows: DataFrame) -> DataFrame:
    """(sync_key): the largest key seen, of eligible rows or not."""
    return rows.agg(F.max("sync_key").alias("sync_key"))


def snapshot_sessions(index: DataFrame) -> DataFrame:
    """Non-empty texts, parsable integers and the duration of each session."""
    columns = [(F.nullif(F.col(c).cast("string"), F.lit("")) if c in index.columns else F.lit(None).cast("string")).alias(c) for c in TEXT_FIELDS]
    columns += [(F.col(c).try_cast("bigint") if c in index.columns else F.lit(None).cast("bigint")).alias(c) for c in NUMBER_FIELDS]
    given = F.col("duration_seconds").cast("string") if "duration_seconds" in index.columns else F.lit(None).cast("string")
    rows = index.select(*columns, given.alias("_given"))
    pairs = [(F.col("trimmed_start_ms"), F.col("trimmed_end_ms")), (F.col("started_at_ms"), F.col("stopped_at_ms"))]
    return rows.withColumn("duration_seconds", S.duration_seconds(F.col("_given"), pairs)).drop("_given")


def session_paths(lines: DataFrame) -> DataFrame:
    """(path): distinct session files named at the end of log lines (value), in order; none are an error."""
    found = lines.select(F.regexp_extract("value", LOGGED, 1).alias("path")).where("path <> ''").distinct()
    if found.isEmpty():
        raise ValueError("no session paths in the log")
    return found.orderBy("path")


def sessions_of_log(lines: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars (path, ...) of the session files that a log names; a missing one is an error."""
    asked = session_paths(lines).withColumn("path", F.concat("path", F.lit(".metadata.json")))
    missing = asked.join(sidecars, "path", "left_anti").orderBy("path").agg(F.count(F.lit(1)), F.min("path")).first()
    if missing[0]:
        raise ValueError(f"{missing[0]} session sidecars are missing; the first is {missing[1]}")
    return sidecars.join(asked, "path", "left_semi")


def without_payload(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecars (s3_key, ...) whose session file isn't among the files (path): there must be none."""
    return sidecars.join(files.select(F.col("path").alias("s3_key")), "s3_key", "left_anti")


def check_sessions(sessions: DataFrame) -> None:
    """An error for missing or repeated session ids."""
    if not sessions.where("session_id IS NULL OR session_id = ''").isEmpty():
        raise ValueError("a session has no id")
    again = duplicates(sessions).first()
    if again:
        raise ValueError(f"session {again['session_id']} occurs {again['count']} times")


def write_snapshot(sessions: DataFrame, path: str, run_id: str, mark: str | None = None) -> None:
    """Sessions in order of id, and one header row: version, run, time, mark, count and digest."""
    check_sessions(sessions)
    sessions.orderBy("session_id").write.mode("overwrite").json(f"{path}/sessions")
    head = session_digest(sessions).select(
        F.lit(VERSION).alias("schema_version"), F.lit(run_id).alias("run_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("captured_at"),
        F.lit(mark).cast("string").alias("last_sync_key"), "session_count", "session_id_digest",
    )
    head.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_snapshot(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The sessions of a snapshot; another version or run, and a count or digest that doesn't fit, are errors."""
    head = spark.read.schema("schema_version int, run_id string, session_count bigint, session_id_digest string").json(f"{path}/header").first()
    texts, numbers = (", ".join(f"{c} {kind}" for c in names) for names, kind in ((TEXT_FIELDS, "string"), (NUMBER_FIELDS, "bigint")))
    sessions = spark.read.schema(f"{texts}, {numbers}, duration_seconds double").json(f"{path}/sessions")
    if head["schema_version"] != VERSION:
        raise ValueError(f"snapshot of version {head['schema_version']}")
    if head["run_id"] != run_id:
        raise ValueError(f"snapshot of run {head['run_id']!r}, not {run_id!r}")
    check_sessions(sessions)
    found = session_digest(sessions).first()
    for name in ("session_count", "session_id_digest"):
        if head[name] != found[name]:
            raise ValueError(f"the snapshot's {name} is {head[name]}, its sessions' {found[name]}")
    return sessions


def summary(sessions: DataFrame, run_id: str, source: str) -> DataFrame:
    """One row: run, where the snapshot came from, sessions, known durations, digest."""
    known = sessions.agg(F.count(F.lit(1)).alias("sessions"), F.count("duration_seconds").alias("with_duration"))
    return known.crossJoin(session_digest(sessions).select("session_id_digest")).select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), "*")


def _named(sessions: DataFrame) -> DataFrame:
    """Modes in lower case without blanks around; unknown where there is no mode or participant."""
    mode = F.trim(F.lower(F.coalesce(F.nullif("vehicle_type", F.lit("")), F.lit("unknown"))))
    return sessions.withColumns({"vehicle_type": mode, "participant_id": F.coalesce(F.nullif("participant_id", F.lit("")), F.lit("unknown"))})


def duplicates(sessions: DataFrame) -> DataFrame:
    """Session ids that occur more than once: there must be none."""
    return sessions.groupBy("session_id").count().where("count > 1")


def mode_summary(sessions: DataFrame) -> DataFrame:
    """(mode, sessions, participants, seconds, samples), and a row Total."""
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    rolled = _named(sessions).rollup("vehicle_type").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("sessions"), F.count_distinct("participant_id").alias("participants"), total("duration_seconds", 0.0).alias("seconds"), total("sample_count", 0).cast("bigint").alias("samples")
    )
    return rolled.select(F.when(F.col("_g") == 1, "Total").otherwise(F.col("vehicle_type")).alias("mode"), "sessions", "participants", "seconds", "samples")


def participant_mode(sessions: DataFrame, modes: list[str]) -> DataFrame:
    """Seconds of each participant in each mode, null where there are none, with totals (0 where there are none) on both sides."""
    cubed = _named(sessions).cube("participant_id", "vehicle_type").agg(F.grouping("participant_id").alias("_p"), F.grouping("vehicle_type").alias("_m"), F.sum("duration_seconds").alias("s"))
    named = cubed.select(F.when(F.col("_p") == 1, "Total").otherwise(F.col("participant_id")).alias("participant"), F.when(F.col("_m") == 1, "Total").otherwise(F.col("vehicle_type")).alias("mode"), F.when((F.col("_p") == 1) | (F.col("_m") == 1), F.coalesce("s", F.lit(0.0))).otherwise(F.nullif("s", F.lit(0.0))).alias("s"))
    return named.groupBy("participant").pivot("mode", [*modes, "Total"]).agg(F.first("s"))
