"""Raw recordings to the event table; one reader per format, registered by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import EVENTS, NOR_COLUMNS, PAYLOAD, SENSORS, SIDECAR, US_RAW, VALUES
from ..streaming.incremental import file_system
from .scratch import written

#: The names of the sources, which are the domains of their events as well.
US, NOR, COLLECTOR = "us-tmd", "nor-tmd", "collector"

Reader = Callable[[SparkSession, str, dict], DataFrame]
_readers: dict[str, Reader] = {}


def register_source(name: str, reader: Reader) -> None:
    """Make a reader known; a name can be taken once."""
    if name in _readers:
        raise ValueError(f"source {name} is registered already")
    _readers[name] = reader


def read(name: str, spark: SparkSession, path: str, labels: dict[str, int]) -> DataFrame:
    """Events of a registered source."""
    if name not in _readers:
        raise ValueError(f"unknown source {name}; known: {sorted(_readers)}")
    return _readers[name](spark, path, labels)


def widen(sensor: Column, values: list[Column]) -> list[Column]:
    """A row's readings in the columns of its sensor, null elsewhere."""
    return [F.when(sensor == name, values[i]).alias(c) for name, columns in SENSORS.items() for i, c in enumerate(columns)]


def complete(sensor: Column, values: list[Column]) -> Column:
    """Pressure needs one value, vector sensors need all three."""
    return values[0].isNotNull() & ((sensor == "pressure") | (values[1].isNotNull() & values[2].isNotNull()))


def coerce(events: DataFrame) -> DataFrame:
    """The event schema in order; rows without session, time or label are dropped."""
    columns = [(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS]
    return events.select(*columns).na.drop(subset=["session_id", "timestamp_ms", "label"])


def group_id() -> Column:
    return F.concat_ws("#", "participant_id", "device_id", "session_id").alias("group_id")


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def _pattern(glob: str) -> str:
    """A glob as a regular expression: `**/` is any folders, `*` and `?` stay within a name, `[a-z]` and `[!a-z]` are classes."""
    marks = (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]"))
    out, at = "", 0
    while at < len(glob):
        end = glob.find("]", at + 2 + glob.startswith("[!", at)) if glob[at] == "[" else -1
        if end > 0:
            own = glob[at + 1 : end]
            negated = own.startswith("!")
            inner = re.sub(r"([\\\[\]^&])", r"\\\1", own[negated:])
            out, at = out + f"(?!/)[{'^' * negated}{inner}]", end + 1
            continue
        mark, meant = next(((m, r) for m, r in marks if glob.startswith(m, at)), (glob[at], re.escape(glob[at])))
        out, at = out + meant, at + len(mark)
    return out


def included(path: Column, globs: tuple[str, ...], root: str = "") -> Column:
    """Whether a path matches a glob below the folder `root`; without one, below any folder."""
    start = re.escape(_plain(root).rstrip("/") + "/") if root else "(?:.*/)?"
    plain = F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    out = F.lit(False)
    for glob in globs:
        out |= plain.rlike(f"^{start}{_pattern(glob)}$")
    return out


def _plain(uri: str) -> str:
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", uri)


def _asked(spark: SparkSession, path: str, globs: tuple[str, ...]) -> tuple[Column, bool]:
    """Which files at or below a path are asked for, and whether the path is a single file; that is always asked for."""
    fs, own = file_system(spark, path)
    if fs.getFileStatus(own).isFile():
        return F.lit(True), True
    return included(F.col("_metadata.file_path"), globs, fs.makeQualified(own).toString()), False


def _csv(spark: SparkSession, path: str, globs: tuple[str, ...]) -> tuple[DataFrameReader, Column]:
    """A reader of the CSV files (of any case) at or below a path, and which of them are asked for."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]")
    return reader, _asked(spark, path, globs)[0]


def normalize_us(raw: DataFrame, labels: dict[str, int], domain: str = US) -> DataFrame:
    """Raw rows with a column `path`; identity comes from the file name, the participant's stands for the device's."""
    part = F.split(F.element_at(F.split("path", "/"), -1), "_")
    who = F.coalesce(F.get(part, F.lit(1)), stem(F.col("path")))
    rows = raw.select(
        who.alias("participant_id"), who.alias("device_id"), F.lower(F.coalesce(F.get(part, F.lit(2)), F.lit(""))).alias("vehicle_type"), stem(F.col("path")).alias("session_id"),
        S.us_sensor(F.col("sensor_type")).alias("sensor"), S.digits_ms(F.col("time")).alias("timestamp_ms"), *[S.number(F.col(f"value_{i}")).alias(f"v{i}") for i in range(3)],
    )
    v = [F.col(f"v{i}") for i in range(3)]
    kept = rows.withColumn("label", S.lookup(F.col("vehicle_type"), labels)).where(F.col("label").isNotNull() & F.col("sensor").isNotNull() & complete(F.col("sensor"), v))
    named = kept.withColumns({"domain": F.lit(domain), "trip_id": F.col("session_id"), "phone_position": F.lit("unknown")})
    return coerce(named.select("*", group_id(), *widen(F.col("sensor"), v)))


def read_us(spark: SparkSession, path: str, labels: dict[str, int], globs: tuple[str, ...] = ("**/*",)) -> DataFrame:
    """Headerless CSV files; short rows are padded, long ones cut, bad bytes replaced."""
    reader, asked = _csv(spark, path, globs)
    raw = reader.schema(US_RAW).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    return normalize_us(raw.where(asked).withColumn("path", F.col("_metadata.file_path")), labels)


def normalize_nor(raw: DataFrame, labels: dict[str, int], domain: str = NOR) -> DataFrame:
    """Rows of the header format; Apple devices give g and kPa.

    Rows without a participant, journey or trip belong to no session and go.
    """
    missing = [c for c in NOR_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    ios = F.upper("OS") == "IOS"
    rows = raw.select(*NOR_COLUMNS).withColumns({"sensor": S.nor_sensor(F.col("typeString")), "vehicle_type": F.lower("transportType"), "timestamp_ms": S.iso_ms(F.col("timestamp"))})
    scale = F.when(ios & (F.col("sensor") == "accelerometer"), S.STANDARD_GRAVITY).when(ios & (F.col("sensor") == "pressure"), S.KILOPASCAL_IN_HECTOPASCAL).otherwise(1.0)
    v = [S.number(F.col(f"value_{i}")) * scale for i in range(3)]
    kept = rows.withColumn("label", S.lookup(F.col("vehicle_type"), labels)).where(F.col("label").isNotNull() & F.col("sensor").isNotNull() & complete(F.col("sensor"), v))
    device = F.concat_ws(":", *[F.lower(F.coalesce(S.filled(F.col(c)), F.lit("unknown"))) for c in ("OS", "manufacturer", "model")])
    # Unlike concat_ws, concat gives null where a part is null, so that trips don't run together.
    trip = F.concat("journeyNumber", F.lit("#"), "tripNumber")
    named = kept.withColumns({
        "domain": F.lit(domain), "participant_id": F.col("installationId"), "device_id": device, "trip_id": trip,
        "session_id": F.concat("installationId", F.lit("#"), trip), "phone_position": F.coalesce(S.filled(F.lower("deviceLocation")), F.lit("unknown")),
    })
    return coerce(named.select("*", group_id(), *widen(F.col("sensor"), v)))


def read_nor(spark: SparkSession, path: str, labels: dict[str, int], globs: tuple[str, ...] = ("**/*",)) -> DataFrame:
    """CSV files with a header; only the known columns are read."""
    reader, asked = _csv(spark, path, globs)
    return normalize_nor(reader.option("header", True).csv(path).where(asked), labels)


def with_sidecars(payloads: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Payloads (path, ...) with `side`: `<file>.metadata.json` first, else the name with its last suffix replaced."""
    key = F.regexp_replace("path", r"\.metadata\.json$", "")
    side = sidecars.select(key.alias("_key"), F.struct(*SIDECAR.names).alias("_side"))
    shorter = F.regexp_replace("path", r"\.[^./]*$", "")
    one, two = side.withColumnRenamed("_side", "_exact"), side.withColumnRenamed("_side", "_stem")
    joined = payloads.join(one, payloads["path"] == one["_key"], "left").drop("_key")
    joined = joined.withColumn("_s", shorter).join(two, F.col("_s") == two["_key"], "left")
    return joined.withColumn("side", F.coalesce("_exact", "_stem")).drop("_exact", "_stem", "_key", "_s")


def chosen_sessions(heads: DataFrame, labels: dict[str, int]) -> DataFrame:
    """What is known of each session to be taken: heads (payloads but for their samples) with `path` and `side`.

    Sessions of no known label go. Of two files with one session id the first path wins.
    """

    def first(*columns: str) -> Column:
        return F.coalesce(*[S.filled(F.col(c)) for c in columns])

    named = heads.select(
        "path",
        F.coalesce(first("side.participant_id", "participant_id"), F.lit("unknown_participant")).alias("participant_id"),
        F.coalesce(first("session_id", "side.session_id"), stem(F.col("path"))).alias("session_id"),
        F.coalesce(first("device_uuid", "side.device_uuid", "side.device_id"), F.lit("unknown_device")).alias("device_id"),
        F.lower(first("vehicle_type", "side.vehicle_type")).alias("vehicle_type"),
        F.coalesce(first("phone_position", "side.phone_position"), F.lit("unknown")).alias("phone_position"),
        F.coalesce(F.col("trimmed_start_ms").try_cast("bigint"), F.col("side.trimmed_start_ms").try_cast("bigint")).alias("s"),
        F.coalesce(F.col("trimmed_end_ms").try_cast("bigint"), F.col("side.trimmed_end_ms").try_cast("bigint")).alias("e"),
    )
    named = named.withColumn("label", S.lookup(F.col("vehicle_type"), labels)).where("label IS NOT NULL")
    rest = [c for c in named.columns if c != "session_id"]
    return named.groupBy("session_id").agg(F.min(F.struct(*rest)).alias("_r")).select("session_id", "_r.*")


def collector_events(payloads: DataFrame, chosen: DataFrame, domain: str = COLLECTOR, sent: int = 100_000) -> DataFrame:
    """Events of the chosen sessions' payloads (path, samples).

    Up to `sent` sessions, what is known of them is sent to the tasks, and no exchange carries samples; with more
    of them, one does. `chosen` is read several times: pass it written.
    """
    known = F.broadcast(chosen) if chosen.limit(sent + 1).count() <= sent else chosen
    rows = payloads.select("path", "samples").join(known, "path").withColumn("x", F.explode("samples")).withColumn("timestamp_ms", F.col("x.ts").try_cast("double").cast("bigint"))
    rows = rows.where("s IS NULL OR e IS NULL OR timestamp_ms BETWEEN s AND e")
    rows = rows.withColumns({"domain": F.lit(domain), "trip_id": F.col("session_id")})
    return coerce(rows.select("*", group_id(), *[S.number(F.col(f"x.{c}")).alias(c) for c in VALUES]))


def normalize_collector(payloads: DataFrame, labels: dict[str, int], domain: str = COLLECTOR) -> DataFrame:
    """Nested sessions with `path` and `side` to events, in two phases: sessions are chosen without their samples."""
    return collector_events(payloads, written(chosen_sessions(payloads.drop("samples"), labels), "sessions"), domain)


def read_collector(spark: SparkSession, path: str, labels: dict[str, int], globs: tuple[str, ...] = ("**/*",)) -> DataFrame:
    """JSON sessions, plain or gzip, with their sidecars. Samples are read once sessions are chosen."""
    every = lambda schema: spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    file = F.element_at(F.split("path", "/"), -1)
    asked, single = _asked(spark, path, globs)
    payloads = every(PAYLOAD).option("pathGlobFilter", "*.{json,json.gz}").json(path).where(asked).withColumn("path", F.col("_metadata.file_path"))
    payloads = payloads.where(~F.lower("path").endswith(".metadata.json") & ~file.startswith("."))
    beside = str(file_system(spark, path)[1].getParent()) if single else path
    sidecars = every(SIDECAR).option("pathGlobFilter", "*.metadata.json").json(beside).withColumn("path", F.col("_metadata.file_path"))
    heads = with_sidecars(payloads.drop("samples"), sidecars)
    return collector_events(payloads, written(chosen_sessions(heads, labels), "sessions"))


for _name, _reader in ((US, read_us), (NOR, read_nor), (COLLECTOR, read_collector)):
    register_source(_name, _reader)


def write_events(events: DataFrame, path: str) -> bool:
    """Write a dataset once: a complete one is left as it is (False), a partial one rebuilt; no rows are an error."""
    fs, marker = file_system(events.sparkSession, f"{path}/_SUCCESS")
    if fs.exists(marker):
        return False
    if events.isEmpty():
        raise ValueError("no rows to write")
    events.repartition("session_id").sortWithinPartitions("session_id", "timestamp_ms").write.mode("overwrite").parquet(path)
    return True
