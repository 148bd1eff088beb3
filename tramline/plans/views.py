"""The driver tables as sensor sessions: event_sessions, line_vectors, windows and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..operators import sessions, windows

DAY = 86_400_000
WINDOW, STEP, CONTEXTS = 10 * DAY, 5 * DAY, [5 * DAY, 10 * DAY]
#: The modes of the table, and their labels.
MODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
LABELS = [0, 1, 2, 3, 4]
LINE_WINDOW, LINE_STEP = 360 * DAY, 180 * DAY
LINE_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return as_sessions(spark.read.parquet(f"{d}/events.parquet"))


def as_sessions(events: DataFrame) -> DataFrame:
    user = F.col("user_id").cast("string")
    return events.select(
        F.when(F.col("user_id") % 3 == 0, "collector").otherwise("source").alias("domain"), F.concat(F.lit("u"), user).alias("participant_id"),
        F.concat(F.lit("u"), user, F.lit("-"), F.col("event_type")).alias("session_id"), F.concat(F.lit("u"), user, F.lit("-"), F.col("event_type")).alias("group_id"),
        F.col("event_type").alias("vehicle_type"), lookup(F.col("event_type"), MODES).alias("label"),
        F.concat(F.lit("pos"), (F.col("user_id") % 2).cast("string")).alias("phone_position"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.col("value").alias("p"), "event_id", "props", *[c for c in events.columns if c == "_file"],
    )


def line_vectors(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return line.select(
        F.concat_ws("-", F.col("l_suppkey").cast("string"), "l_returnflag").alias("session_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp_ms"),
        F.col("l_quantity").alias("ax"), (F.col("l_extendedprice") / 1000).alias("ay"), (F.col("l_discount") * 100).alias("az"), *LINE_TIE,
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    own = event_sessions(spark, d)
    return own.select(
        "participant_id", "session_id", "phone_position", "timestamp_ms", F.col("label").alias("truth"), F.pmod(F.floor("p").cast("int"), F.lit(5)).alias("prediction"),
        F.array(*[F.when(F.pmod(F.floor("p").cast("int"), F.lit(5)) == i, 1.0).otherwise(0.0) for i in LABELS]).alias("probabilities"),
    )


def windowed(spark: SparkSession, d: str) -> DataFrame:
    """Events in their windows."""
    own = event_sessions(spark, d).repartition("session_id")
    return windows.assign_windows(own, sessions.session_stats(own, STEP), WINDOW, STEP)


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row for each window with samples: identity and simple features."""
    keys = ["domain", "participant_id", "session_id", "label", "window_start_ms", "window_end_ms"]
    return windowed(spark, d).groupBy(*keys).agg(F.avg("p").alias("pressure#mean"), F.coalesce(F.stddev_pop("p"), F.lit(0.0)).alias("pressure#standard_deviation"), F.count(F.lit(1)).alias("pressure#count"))


#: The same in SQL, as common table expressions.
ES = """es AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'collector' ELSE 'source' END AS domain, 'u' || user_id AS participant_id,
  'u' || user_id || '-' || event_type AS session_id, event_type AS vehicle_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS label,
  'pos' || (user_id % 2) AS phone_position, (epoch_us(ts) // 1000)::BIGINT AS timestamp_ms, value AS p, event_id, props FROM events)"""
LV = """lv AS (SELECT l_suppkey || '-' || l_returnflag AS session_id, (epoch_us(l_shipdate) // 1000)::BIGINT AS timestamp_ms, l_quantity AS ax,
  l_extendedprice / 1000 AS ay, l_discount * 100 AS az, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount FROM lineitem)"""


def stats_sql(base: str, name: str, window: int, step: int) -> str:
    """Session statistics, the grid of windows, and rows in windows by range join."""
    return f"""{name}_g AS (SELECT session_id, timestamp_ms, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms) AS gap FROM {base}),
{name}_s AS (SELECT session_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, count(*) AS n,
  coalesce(floor(median(gap) FILTER (gap > 0))::BIGINT, {step}) AS interval_ms FROM {name}_g GROUP BY session_id),
{name}_w AS (SELECT session_id, first_ms + i * {step} AS window_start_ms, first_ms + i * {step} + {window} AS window_end_ms FROM (
  SELECT *, unnest(range(0, greatest(0, floor((last_ms + interval_ms - first_ms - {window}) / {step})::BIGINT + 1))) AS i FROM {name}_s)),
{name}_r AS (SELECT b.*, w.window_start_ms, w.window_end_ms FROM {base} b JOIN {name}_w w ON b.session_id = w.session_id
  AND b.timestamp_ms >= w.window_start_ms AND b.timestamp_ms < w.window_end_ms)"""


EW = ES + ",\n" + stats_sql("es", "e", WINDOW, STEP)
LW = LV + ",\n" + stats_sql("lv", "l", LINE_WINDOW, LINE_STEP)
PR = ES + """,
pr AS (SELECT participant_id, session_id, phone_position, label AS truth, (floor(p)::INT % 5 + 5) % 5 AS prediction FROM es)"""
FR = EW + """,
fr AS (SELECT domain, participant_id, session_id, label, window_start_ms, window_end_ms, avg(p) AS mean FROM e_r GROUP BY ALL)"""
