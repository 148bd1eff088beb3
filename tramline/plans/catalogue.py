"""Registered queries over the driver tables, and the same in SQL.

Doubles are rounded on both sides: to 6 places, kurtosis and spectra to 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import balance, digest, documents, features, metrics, ml, protocols, quantiles, reports, search, sessions, snapshot, splits, windows
from ..sources import readers, store
from ..sources.scratch import scratch_dir
from ..streaming import incremental
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 7
KEYS = ["session_id", "window_start_ms"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def md5_key(*columns: str) -> str:
    return f"md5('{SEED}|' || " + " || '|' || ".join(columns) + ")"


# Sessions ------------------------------------------------------------------------------


@query(f"WITH {V.EW} SELECT * FROM e_s")
def session_stats(spark, d):
    return sessions.session_stats(V.event_sessions(spark, d), V.STEP)


@query(f"WITH {V.EW} SELECT session_id, count(*) AS n FROM es SEMI JOIN (SELECT session_id FROM e_s WHERE (last_ms - first_ms) / 1000.0 BETWEEN 1728000 AND 2160000) k USING (session_id) GROUP BY session_id")
def duration_filter(spark, d):
    kept = sessions.filter_duration(V.event_sessions(spark, d), 20 * 86400, 25 * 86400)
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.EW} SELECT session_id, interval_ms FROM e_s WHERE n > 3")
def sampling_interval(spark, d):
    return sessions.session_stats(V.event_sessions(spark, d), V.STEP).where("n > 3").select("session_id", "interval_ms")


@query(f"WITH {V.ES} SELECT session_id, count(*) AS n FROM es WHERE session_id NOT IN (SELECT session_id FROM es GROUP BY session_id HAVING count(*) >= 12) GROUP BY session_id")
def new_sessions_anti(spark, d):
    own = V.event_sessions(spark, d)
    done = own.groupBy("session_id").count().where("count >= 12")
    return sessions.pending(own, done).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.ES} SELECT session_id FROM es EXCEPT SELECT session_id FROM es WHERE domain = 'collector'")
def pending_sessions_except(spark, d):
    own = V.event_sessions(spark, d)
    return own.select("session_id").distinct().exceptAll(own.where("domain = 'collector'").select("session_id").distinct())


@query(f"""WITH {V.EW}, c AS (SELECT DISTINCT session_id, vehicle_type, domain FROM es), x AS (SELECT c.*, (last_ms - first_ms) / 1000.0 AS s FROM c JOIN e_s USING (session_id))
SELECT CASE WHEN domain = 'collector' THEN 'already_processed' WHEN vehicle_type = 'click' THEN 'ignored' WHEN NOT s BETWEEN 1728000 AND 2160000 THEN 'duration_filtered' ELSE 'ingested' END AS status, count(*) AS sessions FROM x GROUP BY 1""")
def ingest_status_counts(spark, d):
    own = V.event_sessions(spark, d)
    each = own.groupBy("session_id", "vehicle_type", "domain").agg(((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0).alias("seconds"))
    known = own.select("vehicle_type").distinct().where("vehicle_type <> 'click'")
    return sessions.status_counts(each, each.where("domain = 'collector'"), known, 20 * 86400, 25 * 86400)


# Windows -------------------------------------------------------------------------------


@query(f"WITH {V.EW} SELECT * FROM e_w")
def window_grid(spark, d):
    return windows.window_grid(sessions.session_stats(V.event_sessions(spark, d), V.STEP), V.WINDOW, V.STEP)


@query(f"WITH {V.EW} SELECT session_id, window_start_ms, event_id FROM e_r")
def window_assign(spark, d):
    return V.windowed(spark, d).select(*KEYS, "event_id")


#: Every second event belongs to one large session.
_HOT = f"""{V.ES}, hs AS (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE session_id END AS session_id, timestamp_ms + event_id AS timestamp_ms) FROM es),
{V.stats_sql("hs", "h", V.WINDOW, V.STEP)}"""


def _hot(spark, d):
    own = V.event_sessions(spark, d)
    return own.withColumns({"session_id": F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("session_id")), "timestamp_ms": F.col("timestamp_ms") + F.col("event_id")})


@query(f"WITH {_HOT} SELECT session_id, window_start_ms, event_id FROM h_r WHERE session_id = 'hot'")
def window_assign_sliced(spark, d):
    """A session of half of all events, cut into slices of time that go to different tasks."""
    own = _hot(spark, d)
    own = own.join(F.broadcast(sessions.large_sessions(own, 1000)), "session_id", "left_semi")
    return windows.assign_sliced(own, sessions.sliced_stats(own, V.STEP, V.STEP), V.WINDOW, V.STEP, V.STEP).select(*KEYS, "event_id")


@query(f"WITH {_HOT} SELECT session_id, first_ms, last_ms, n, interval_ms FROM h_s WHERE session_id = 'hot'")
def sliced_session_stats(spark, d):
    return sessions.sliced_stats(_hot(spark, d).where("session_id = 'hot'"), V.STEP, V.DAY)


@query(f"""WITH {_HOT}, b AS (SELECT session_id, arg_min(p, timestamp_ms) AS b, median(abs(p)) AS m FROM hs GROUP BY session_id)
SELECT session_id, window_start_ms, round(avg(p)::FLOAT, 3) AS mean, round((max(p) - min(p))::FLOAT, 3) AS range, round((avg(p) - any_value(b))::FLOAT, 3) AS delta, round((avg(abs(p)) - any_value(m))::FLOAT, 3) AS field_delta FROM h_r JOIN b USING (session_id) GROUP BY ALL""")
def feature_wide_hot(spark, d):
    """Features of all sessions, of which one has half of all events."""
    sensors = {"pressure": ("p",), "magnetometer": ("a",)}
    found = features.window_features(_hot(spark, d).withColumn("a", F.abs("p")), sensors, V.WINDOW, V.STEP, aggregates=("mean", "range", "delta_from_session_baseline"), most=1000, slice_steps=1)
    names = {"mean": "pressure#mean", "range": "pressure#range", "delta": "pressure#delta_from_session_baseline", "field_delta": "magnetometer#delta_from_session_baseline"}
    return rounded(found.select(*KEYS, *[F.col(f"`{c}`").alias(n) for n, c in names.items()]), 3)


@query("SELECT CASE WHEN l_orderkey % 3 > 0 THEN 'hot' ELSE l_returnflag END AS flag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def medians_of_hot_keys(spark, d):
    """Medians of keys, of which one has two thirds of all rows, by counts in cells."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.when(F.col("l_orderkey") % 3 > 0, "hot").otherwise(F.col("l_returnflag")).alias("flag"), "l_extendedprice")
    return quantiles.median(line, ["flag"], "l_extendedprice", most=2000, cells=64)


def _values(spark, d):
    return V.windowed(spark, d).withColumn("v", F.col("p"))


@query(f"""WITH {V.EW} SELECT session_id, window_start_ms, count(p) AS n, round(min(p), 6) AS minimum, round(max(p), 6) AS maximum, round(avg(p), 6) AS mean, round(max(p) - min(p), 6) AS range,
round(var_pop(p), 6) AS variance, round(stddev_pop(p), 6) AS standard_deviation FROM e_r GROUP BY ALL""")
def window_basic_stats(spark, d):
    return rounded(features.statistics(_values(spark, d), KEYS, features.BASIC))


@query(f"""WITH {V.EW}, m AS (SELECT *, avg(p) OVER (PARTITION BY session_id, window_start_ms) AS mu FROM e_r),
x AS (SELECT session_id, window_start_ms, count(p) AS n, avg(pow(p - mu, 4)) AS m4, avg(pow(p - mu, 2)) AS m2, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) AS iqr FROM m GROUP BY ALL)
SELECT session_id, window_start_ms, n, round(CASE WHEN m2 = 0 THEN 0 WHEN n > 3 THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) ELSE m4 / (m2 * m2) - 3 END, 4) AS kurtosis, round(iqr, 4) AS interquartile_range FROM x""")
def window_shape_stats(spark, d):
    return rounded(features.statistics(_values(spark, d), KEYS, features.SHAPE), 4)


@query(f"""WITH {V.EW}, b AS (SELECT session_id, arg_min(p, timestamp_ms) AS b FROM es GROUP BY session_id)
SELECT session_id, window_start_ms, count(p) AS n, round(arg_max(p, timestamp_ms) - arg_min(p, timestamp_ms), 6) AS delta_from_window_start, round(avg(p) - any_value(b), 6) AS delta_from_session_baseline FROM e_r JOIN b USING (session_id) GROUP BY ALL""")
def window_deltas(spark, d):
    own = V.event_sessions(spark, d)
    base = features.baselines(own, {"pressure": ("p",)}).withColumnRenamed("baseline_pressure", "baseline")
    return rounded(features.statistics(_values(spark, d).join(base, "session_id"), KEYS, ("delta_from_window_start", "delta_from_session_baseline")))


@query(f"WITH {V.ES} SELECT session_id, round(arg_min(p, timestamp_ms), 6) AS first_value, round(median(p), 6) AS median_value FROM es GROUP BY session_id")
def session_baselines(spark, d):
    own = V.event_sessions(spark, d)
    both = features.baselines(own, {"pressure": ("p",), "magnetometer": ("p",)})
    return rounded(both.select("session_id", F.col("baseline_pressure").alias("first_value"), F.col("baseline_magnetometer").alias("median_value")))


@query(f"""WITH {V.EW}, m AS (SELECT *, avg(p) OVER (PARTITION BY session_id, window_start_ms) AS mu FROM e_r)
SELECT session_id, window_start_ms, count(p) AS n, round(avg(abs(p - mu)), 9) AS mean_absolute_deviation FROM m GROUP BY ALL""")
def window_mad(spark, d):
    return rounded(features.statistics(_values(spark, d), KEYS, ("mean_absolute_deviation",)), 9)


@query(f"""WITH {V.EW}, j AS (SELECT *, (p - lag(p) OVER o) / nullif((timestamp_ms - lag(timestamp_ms) OVER o) / 1000.0, 0) * 1000 AS j FROM e_r WINDOW o AS (PARTITION BY session_id, window_start_ms ORDER BY timestamp_ms))
SELECT session_id, window_start_ms, count(p) AS n, round(coalesce(avg(abs(j)), 0), 4) AS jerk, round(coalesce(stddev_pop(j), 0), 4) AS jerk_deviation FROM j GROUP BY ALL""")
def window_jerk(spark, d):
    out = features.statistics(_values(spark, d), KEYS, ("mean_absolute_jerk", "jerk_standard_deviation"))
    return rounded(out.select(*KEYS, "n", (F.col("mean_absolute_jerk") * 1000).alias("jerk"), (F.col("jerk_standard_deviation") * 1000).alias("jerk_deviation")), 4)


_CONTEXTS = f"c AS (SELECT e_r.*, context_ms FROM e_r, (VALUES ({V.CONTEXTS[0]}::BIGINT), ({V.CONTEXTS[1]}::BIGINT)) t(context_ms) WHERE timestamp_ms >= window_end_ms - context_ms)"


@query(f"WITH {V.EW}, {_CONTEXTS} SELECT session_id, window_start_ms, context_ms, count(*) AS n, round(avg(p), 6) AS mean, round(max(p) - min(p), 6) AS range FROM c GROUP BY ALL")
def multi_context_features(spark, d):
    rows = windows.with_contexts(_values(spark, d), V.CONTEXTS)
    return rounded(features.statistics(rows, [*KEYS, "context_ms"], ("mean", "range")))


@query(f"""WITH {V.EW}, {_CONTEXTS}, g AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id, window_start_ms, context_ms ORDER BY timestamp_ms) AS gap FROM c),
k AS (SELECT session_id, window_start_ms, context_ms, count(*) >= greatest(1, ceil(context_ms / 1000.0 * 0.000003)) AND greatest(coalesce(max(gap), 0), min(timestamp_ms) - (any_value(window_end_ms) - context_ms), any_value(window_end_ms) - max(timestamp_ms)) <= {4 * V.DAY} AS good FROM g GROUP BY session_id, window_start_ms, context_ms)
SELECT session_id, window_start_ms FROM k GROUP BY ALL HAVING bool_and(good) AND count(*) = 2""")
def window_quality_gate(spark, d):
    rows = windows.with_contexts(V.windowed(spark, d), V.CONTEXTS)
    return windows.quality_gate(rows, {"pressure": "p"}, V.CONTEXTS, {"pressure": 0.000003}, 4 * V.DAY)


_TIE = ", ".join(V.LINE_TIE)
_DEDUPED = f"dd AS (SELECT * FROM l_r QUALIFY row_number() OVER (PARTITION BY session_id, window_start_ms, timestamp_ms ORDER BY {_TIE}) = 1)"


def _lines(spark, d):
    own = V.line_vectors(spark, d).repartition("session_id")
    return windows.assign_windows(own, sessions.session_stats(own, V.LINE_STEP), V.LINE_WINDOW, V.LINE_STEP)


@query(f"WITH {V.LW}, {_DEDUPED} SELECT session_id, window_start_ms, count(*) AS n, round(avg(sqrt(ax*ax+ay*ay+az*az)), 6) AS mean, round(max(sqrt(ax*ax+ay*ay+az*az)), 6) AS maximum FROM dd GROUP BY ALL")
def vector_magnitude_features(spark, d):
    rows = features.first_per_time(_lines(spark, d), KEYS, list(V.LINE_TIE)).withColumn("v", S.magnitude(("ax", "ay", "az")))
    return rounded(features.statistics(rows, KEYS, ("mean", "maximum")))


@query(f"WITH {V.LV} SELECT session_id, timestamp_ms, l_orderkey, l_linenumber, l_partkey FROM lv QUALIFY row_number() OVER (PARTITION BY session_id, timestamp_ms ORDER BY {_TIE}) = 1")
def timestamp_dedupe(spark, d):
    return features.first_per_time(V.line_vectors(spark, d), ["session_id"], list(V.LINE_TIE)).select("session_id", "timestamp_ms", "l_orderkey", "l_linenumber", "l_partkey")


def _pearson(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN abs(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))) END"


@query(f"""WITH {V.LW}, x AS (SELECT session_id, window_start_ms, count(*) AS n, {_pearson('ax', 'ay')} AS a, {_pearson('ax', 'az')} AS b, {_pearson('ay', 'az')} AS c FROM l_r GROUP BY ALL)
SELECT session_id, window_start_ms, round(CASE WHEN n < 2 THEN 0 ELSE coalesce((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 0) END, 6) AS mean_axis_correlation FROM x""")
def axis_correlation(spark, d):
    return rounded(features.axis_correlation(_lines(spark, d), KEYS, ("ax", "ay", "az")))


_SPECTRA = f"""WITH {V.EW}, o AS (SELECT session_id, window_start_ms, timestamp_ms, p, row_number() OVER w AS i, lead(timestamp_ms) OVER w AS t1, lead(p) OVER w AS p1 FROM e_r WINDOW w AS (PARTITION BY session_id, window_start_ms ORDER BY timestamp_ms)),
m AS (SELECT session_id, window_start_ms, count(*) AS n, min(timestamp_ms) AS t0, max(timestamp_ms) AS tn, median(t1 - timestamp_ms) FILTER (t1 > timestamp_ms) AS step FROM o GROUP BY ALL),
h AS (SELECT *, ceil((tn + step / 2 - t0) / step)::INT AS g FROM m WHERE n >= 4),
q AS (SELECT session_id, window_start_ms, step, g, t0, tn, unnest(range(0, g)) AS i FROM h WHERE g >= 4),
v AS (SELECT q.session_id, q.window_start_ms, q.step, q.g, q.i, CASE WHEN t0 + i_ * step >= tn THEN last ELSE o.p + (o.p1 - o.p) * (t0 + i_ * step - o.timestamp_ms) / (o.t1 - o.timestamp_ms) END AS y
  FROM (SELECT q.*, q.i AS i_, l.p AS last FROM q JOIN o l ON l.session_id = q.session_id AND l.window_start_ms = q.window_start_ms AND l.timestamp_ms = q.tn) q
  LEFT JOIN o ON o.session_id = q.session_id AND o.window_start_ms = q.window_start_ms AND o.timestamp_ms <= t0 + i_ * step AND o.t1 > t0 + i_ * step),
z AS (SELECT *, y - avg(y) OVER (PARTITION BY session_id, window_start_ms) AS c FROM v),
f AS (SELECT session_id, window_start_ms, any_value(step) AS step, g, k, (pow(sum(c * cos(2 * pi() * k * i / g)), 2) + pow(sum(c * sin(2 * pi() * k * i / g)), 2)) / (g * g) AS power
  FROM (SELECT *, unnest(range(1, g // 2 + 1)) AS k FROM z) GROUP BY session_id, window_start_ms, g, k)"""


@query(_SPECTRA + """,
s AS (SELECT session_id, window_start_ms, sum(power) AS e, -sum(CASE WHEN power > 0 THEN power * ln(power) ELSE 0 END) AS u, count(*) AS bins FROM f GROUP BY ALL)
SELECT w.session_id, w.window_start_ms, round(coalesce(e, 0), 4) AS spectral_energy, round(CASE WHEN e > 0 THEN (u / e + ln(e)) / CASE WHEN bins > 1 THEN ln(bins) ELSE 1 END ELSE 0 END, 4) AS spectral_entropy
FROM m w LEFT JOIN s ON s.session_id = w.session_id AND s.window_start_ms = w.window_start_ms""")
def spectral_features(spark, d):
    return rounded(features.spectral(_values(spark, d), KEYS).drop("dominant_frequency_hz"), 4)


@query(_SPECTRA + """,
d AS (SELECT session_id, window_start_ms, arg_max(k / (g * step / 1000.0), power * 1e6 - k * 1e-9) AS hz, sum(power) AS e FROM f GROUP BY ALL)
SELECT w.session_id, w.window_start_ms, round(CASE WHEN e > 0 THEN hz * 86400 ELSE 0 END, 4) AS cycles_a_day FROM m w LEFT JOIN d ON d.session_id = w.session_id AND d.window_start_ms = w.window_start_ms""")
def spectral_dominant(spark, d):
    return rounded(features.spectral(_values(spark, d), KEYS).select(*KEYS, (F.col("dominant_frequency_hz") * 86400).alias("cycles_a_day")), 4)


@query(f"""WITH {V.EW}, {_CONTEXTS}, i AS (SELECT session_id, window_start_ms, any_value(window_end_ms) AS window_end_ms, any_value(domain) AS domain, any_value(participant_id) AS participant_id, any_value(label) AS label, any_value(phone_position) AS phone_position FROM e_r GROUP BY session_id, window_start_ms),
a AS (SELECT session_id, window_start_ms, context_ms, avg(p) AS m, max(p) - min(p) AS r FROM c GROUP BY ALL)
SELECT i.*, round(l.m::FLOAT::DOUBLE, 2) AS mean, round(l.r::FLOAT::DOUBLE, 2) AS range, round(s.m::FLOAT::DOUBLE, 2) AS mean_short, round(s.r::FLOAT::DOUBLE, 2) AS range_short FROM i JOIN a l ON l.session_id = i.session_id AND l.window_start_ms = i.window_start_ms AND l.context_ms = {V.CONTEXTS[1]}
JOIN a s ON s.session_id = i.session_id AND s.window_start_ms = i.window_start_ms AND s.context_ms = {V.CONTEXTS[0]}""")
def feature_wide(spark, d):
    own = V.event_sessions(spark, d).select("domain", "participant_id", "session_id", "label", "phone_position", "timestamp_ms", "p", "event_id")
    wide = features.window_features(own, {"pressure": ("p",)}, V.WINDOW, V.STEP, V.CONTEXTS, ("mean", "range"), tie=("event_id",))
    name = lambda a, c: F.round(F.col(f"`{features.feature_name('pressure', a, c, False)}`").cast("double"), 2)
    return wide.select(*KEYS, "window_end_ms", "domain", "participant_id", "label", "phone_position", name("mean", V.CONTEXTS[1]).alias("mean"), name("range", V.CONTEXTS[1]).alias("range"), name("mean", V.CONTEXTS[0]).alias("mean_short"), name("range", V.CONTEXTS[0]).alias("range_short"))


# Ingest expressions ----------------------------------------------------------------------


_RAW = "raw AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'android.sensor.accelerometer' WHEN 1 THEN ' Android.Sensor.PRESSURE!' WHEN 2 THEN 'android.sensor.magnetic_field' WHEN 3 THEN 'com.x.gyroscope' ELSE 'light' END AS sensor_type, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE round(value, 3)::VARCHAR END AS value_0, 't' || (epoch_us(ts) // 1000) || 'ms' AS time, user_id FROM events)"


def _raw(spark, d):
    kind = F.col("event_id") % 5
    name = F.when(kind == 0, "android.sensor.accelerometer").when(kind == 1, " Android.Sensor.PRESSURE!").when(kind == 2, "android.sensor.magnetic_field").when(kind == 3, "com.x.gyroscope").otherwise("light")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", "user_id", name.alias("sensor_type"), F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.round("value", 3).cast("string")).alias("value_0"), F.concat(F.lit("t"), ms.cast("string"), F.lit("ms")).alias("time")
    )


_SENSOR = "CASE event_id % 5 WHEN 0 THEN 'accelerometer' WHEN 1 THEN 'pressure' WHEN 2 THEN 'magnetometer' WHEN 3 THEN 'gyroscope' END"


@query(f"WITH {_RAW} SELECT {_SENSOR} AS sensor, count(*) AS n FROM raw GROUP BY 1")
def canonical_sensor(spark, d):
    return _raw(spark, d).groupBy(S.us_sensor(F.col("sensor_type")).alias("sensor")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RAW} SELECT event_id, round(try_cast(value_0 AS DOUBLE), 3) AS value, regexp_extract(time, '[0-9]+')::BIGINT AS timestamp_ms FROM raw")
def lenient_cast(spark, d):
    return _raw(spark, d).select("event_id", F.round(S.number(F.col("value_0")), 3).alias("value"), S.digits_ms(F.col("time")).alias("timestamp_ms"))


@query("SELECT event_id, round(CASE WHEN user_id % 2 = 0 AND event_id % 2 = 0 THEN value * 9.80665 WHEN user_id % 2 = 0 THEN value * 10 ELSE value END, 8) AS value FROM events")
def unit_scale(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    raw = rows.select(
        F.col("event_id").cast("string").alias("installationId"), F.lit("1").alias("journeyNumber"), F.lit("1").alias("tripNumber"), F.lit("m").alias("manufacturer"), F.lit("x").alias("model"),
        F.col("ts").cast("string").alias("timestamp"), F.lit("CAR").alias("transportType"), F.when(F.col("event_id") % 2 == 0, "CMAccelerometerData").otherwise("RelativePressure").alias("typeString"), F.lit("hand").alias("deviceLocation"),
        *[F.col("value").alias(f"value_{i}") for i in range(3)], F.when(F.col("user_id") % 2 == 0, "iOS").otherwise("Android").alias("OS"),
    )
    events = readers.normalize_nor(raw, {"car": 0})
    return events.select(F.col("participant_id").cast("bigint").alias("event_id"), F.round(F.coalesce("ax", "p"), 8).alias("value"))


@query(f"""WITH {_RAW}, x AS (SELECT event_id, {_SENSOR} AS s, try_cast(value_0 AS DOUBLE) AS v FROM raw) SELECT event_id, CASE WHEN s = 'accelerometer' THEN v END AS ax, CASE WHEN s = 'gyroscope' THEN v END AS gx, CASE WHEN s = 'magnetometer' THEN v END AS mx, CASE WHEN s = 'pressure' THEN v END AS p FROM x WHERE s IS NOT NULL AND v IS NOT NULL""")
def sensor_widen(spark, d):
    v = S.number(F.col("value_0"))
    rows = _raw(spark, d).withColumn("sensor", S.us_sensor(F.col("sensor_type"))).where(F.col("sensor").isNotNull() & readers.complete(F.col("sensor"), [v, v, v]))
    return rows.select("event_id", *readers.widen(F.col("sensor"), [v, v, v])).select("event_id", "ax", "gx", "mx", "p")


def _payloads(spark, d):
    """Payload and sidecar of each user, derived from events."""
    own = V.event_sessions(spark, d)
    one = own.groupBy("participant_id").agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b"), F.sort_array(F.collect_list(F.struct(F.col("timestamp_ms").cast("string").alias("ts"), F.col("p").cast("string").alias("p")))).alias("samples"))
    u = F.expr("cast(substr(participant_id, 2) as int)")
    none = lambda c, k: F.when(u % k != 0, c)
    samples = F.transform("samples", lambda x: F.struct(x["ts"].alias("ts"), *[(x["p"] if c == "p" else F.lit(None).cast("string")).alias(c) for c in readers.VALUES]))
    payload = one.select(
        F.concat(F.lit("/in/"), "participant_id", F.lit(".json")).alias("path"), samples.alias("samples"), F.concat(F.lit("p-"), "participant_id").alias("participant_id"), none(F.concat(F.lit("s-"), "participant_id"), 4).alias("session_id"),
        F.lit(None).cast("string").alias("device_uuid"), none(F.lit("Car"), 5).alias("vehicle_type"), F.lit("").alias("phone_position"), none((F.col("a") + 86400000).cast("string"), 2).alias("trimmed_start_ms"), F.col("b").cast("string").alias("trimmed_end_ms"),
    )
    empty = {c: F.lit(None).cast("string") for c in readers.SIDECAR.names}
    made = empty | {"participant_id": none(F.concat(F.lit("q-"), "participant_id"), 3), "vehicle_type": F.lit("bus"), "session_id": F.concat(F.lit("z-"), "participant_id"), "phone_position": F.lit("hand")}
    side = one.where(u % 7 != 0).select(F.concat(F.lit("/in/"), "participant_id", F.lit(".json.metadata.json")).alias("path"), *[x.alias(c) for c, x in made.items()])
    return readers.with_sidecars(payload, side)


_META = f"""WITH {V.ES}, u AS (SELECT participant_id AS k, substr(participant_id, 2)::INT AS u, min(timestamp_ms) AS a, max(timestamp_ms) AS b FROM es GROUP BY 1, 2),
m AS (SELECT k, u, a, b, u % 7 <> 0 AS side, CASE WHEN u % 7 <> 0 AND u % 3 <> 0 THEN 'q-' || k ELSE 'p-' || k END AS participant_id, CASE WHEN u % 4 <> 0 THEN 's-' || k WHEN u % 7 <> 0 THEN 'z-' || k ELSE k END AS session_id,
CASE WHEN u % 5 <> 0 THEN 'car' WHEN u % 7 <> 0 THEN 'bus' END AS vehicle_type, CASE WHEN u % 7 <> 0 THEN 'hand' ELSE 'unknown' END AS phone_position, CASE WHEN u % 2 <> 0 THEN a + 86400000 END AS s FROM u)"""


@query(f"""WITH {V.ES} SELECT event_id, timestamp_ms // 1000 * 1000 AS plain, timestamp_ms // 1000 * 1000 AS utc, timestamp_ms // 1000 * 1000 - 7200000 AS east, timestamp_ms // 86400000 * 86400000 AS day, NULL::BIGINT AS none FROM es""")
def utc_times(spark, d):
    """Times without a zone are UTC in a session of another zone, too."""
    text = V.event_sessions(spark, d).select("event_id", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss").alias("x"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone != "UTC":
        text = text.withColumn("x", F.date_format(F.to_utc_timestamp("x", zone), "yyyy-MM-dd'T'HH:mm:ss"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        return text.select("event_id", S.iso_ms(F.col("x")).alias("plain"), S.iso_ms(F.concat("x", F.lit("Z"))).alias("utc"), S.iso_ms(F.concat("x", F.lit("+02:00"))).alias("east"), S.iso_ms(F.substring("x", 1, 10)).alias("day"), S.iso_ms(F.concat(F.lit("no"), "x")).alias("none"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@query(f"{_META} SELECT participant_id, session_id, vehicle_type, phone_position FROM m WHERE vehicle_type IS NOT NULL AND (s IS NULL OR s <= b)")
def metadata_fallback(spark, d):
    return readers.normalize_collector(_payloads(spark, d), {"car": 0, "bus": 1}).select("participant_id", "session_id", "vehicle_type", "phone_position").distinct()


@query(f"{_META} SELECT m.session_id, count(*) AS n, round(sum(es.p), 4) AS total FROM m JOIN es ON es.participant_id = m.k WHERE m.vehicle_type IS NOT NULL AND (s IS NULL OR timestamp_ms BETWEEN s AND b) GROUP BY 1")
def trim_range(spark, d):
    return rounded(readers.normalize_collector(_payloads(spark, d), {"car": 0, "bus": 1}).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")), 4)


_FILES = "SELECT event_id, user_id, value, 'rec_' || CASE user_id % 3 WHEN 0 THEN 'U' || user_id || '_Car_' || user_id || '.csv' WHEN 1 THEN 'U' || user_id || '_bus.csv' ELSE 'U' || user_id || '_bus_x.y.csv' END AS name FROM events"


@query(f"WITH f AS ({_FILES}) SELECT split_part(name, '_', 2) AS participant_id, split_part(name, '_', 2) AS device_id, name[:-5] AS session_id, lower(split_part(name, '_', 3)) AS vehicle_type, count(*) AS n FROM f WHERE lower(split_part(name, '_', 3)) IN ('car', 'bus') GROUP BY ALL")
def file_identity(spark, d):
    u = F.col("user_id").cast("string")
    tail = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("_Car_"), u, F.lit(".csv"))).when(F.col("user_id") % 3 == 1, "_bus.csv").otherwise("_bus_x.y.csv")
    raw = spark.read.parquet(f"{d}/events.parquet").select(
        F.concat(F.lit("/in/rec_U"), u, tail).alias("path"), F.lit("1000").alias("time"), F.lit("android.sensor.pressure").alias("sensor_type"), F.col("value").cast("string").alias("value_0"), *[F.lit(None).cast("string").alias(f"value_{i}") for i in (1, 2)]
    )
    events = readers.normalize_us(raw, {"car": 0, "bus": 1})
    return events.groupBy("participant_id", "device_id", "session_id", "vehicle_type").agg(F.count(F.lit(1)).alias("n"))


_NOR_NAMES = ("android.sensor.accelerometer", "CMAccelerometerData", " Android.Sensor.Gyroscope ", "cmgyrodata", "android.sensor.magnetic_field", "CMMagnetometerData", "android.sensor.pressure", "CMAltimeterData", "accelerometer", "android.sensor.linear_acceleration")


@query("""WITH x AS (SELECT *, event_id % 10 AS k, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'i' || user_id END AS i, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (user_id % 3)::VARCHAR END AS j FROM events)
SELECT CASE WHEN k < 2 THEN 'ax' WHEN k < 4 THEN 'gx' WHEN k < 6 THEN 'mx' ELSE 'p' END AS first_column, i || '#' || j || '#1' AS session_id, 'ios:unknown:x' AS device_id, count(*) AS n FROM x WHERE k < 8 AND i IS NOT NULL AND j IS NOT NULL GROUP BY ALL""")
def header_format_identity(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    names = F.get(F.array(*map(F.lit, _NOR_NAMES)), (F.col("event_id") % 10).cast("int"))
    raw = rows.select(
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("i"), F.col("user_id").cast("string"))).alias("installationId"), F.when(F.col("event_id") % 13 != 0, (F.col("user_id") % 3).cast("string")).alias("journeyNumber"), F.lit("1").alias("tripNumber"),
        F.lit(None).cast("string").alias("manufacturer"), F.lit("X").alias("model"), F.col("ts").cast("string").alias("timestamp"), F.lit("Car").alias("transportType"), names.alias("typeString"), F.lit("Hand").alias("deviceLocation"),
        *[F.col("value").alias(f"value_{i}") for i in range(3)], F.lit("iOS").alias("OS"),
    )
    events = readers.normalize_nor(raw, {"car": 0})
    first = F.when(F.col("ax").isNotNull(), "ax").when(F.col("gx").isNotNull(), "gx").when(F.col("mx").isNotNull(), "mx").otherwise("p")
    return events.groupBy(first.alias("first_column"), "session_id", "device_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.ES}, u AS (SELECT DISTINCT participant_id AS k, substr(participant_id, 2)::INT AS u FROM es)
SELECT CASE WHEN u % 2 = 0 THEN 'p-' || k ELSE 'unknown_participant' END AS participant_id, CASE WHEN u % 3 = 0 THEN 'd-' || k WHEN u % 3 = 1 THEN 'm-' || k ELSE 'unknown_device' END AS device_id, k AS session_id FROM u""")
def collector_defaults(spark, d):
    one = V.event_sessions(spark, d).select("participant_id").distinct().withColumn("u", F.expr("cast(substr(participant_id, 2) as int)"))
    no = F.lit(None).cast("string")
    sample = F.struct(F.lit("5").alias("ts"), *[(F.lit("1.5") if c == "p" else no).alias(c) for c in readers.VALUES])
    payload = one.select(
        F.concat(F.lit("/in/"), "participant_id", F.lit(".json")).alias("path"), F.array(sample).alias("samples"), F.when(F.col("u") % 2 == 0, F.concat(F.lit("p-"), "participant_id")).alias("participant_id"), F.lit("").alias("session_id"),
        F.when(F.col("u") % 3 == 0, F.concat(F.lit("d-"), "participant_id")).alias("device_uuid"), F.lit("CAR").alias("vehicle_type"), no.alias("phone_position"), no.alias("trimmed_start_ms"), no.alias("trimmed_end_ms"),
    )
    made = {c: no for c in readers.SIDECAR.names} | {"device_id": F.when(F.col("u") % 3 == 1, F.concat(F.lit("m-"), "participant_id"))}
    side = one.select(F.concat(F.lit("/in/"), "participant_id", F.lit(".metadata.json")).alias("path"), *[x.alias(c) for c, x in made.items()])
    return readers.normalize_collector(readers.with_sidecars(payload, side), {"car": 0}).select("participant_id", "device_id", "session_id")


_PARTIAL = f"pv AS (SELECT session_id, timestamp_ms, ax, CASE WHEN l_orderkey % 5 <> 0 THEN ay END AS ay, az FROM lv)"
_PARTIAL_W = V.LV + ", " + _PARTIAL + ",\n" + V.stats_sql("pv", "v", V.LINE_WINDOW, V.LINE_STEP)


@query(f"""WITH {_PARTIAL_W}, g AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id, window_start_ms ORDER BY timestamp_ms) AS gap FROM v_r WHERE ay IS NOT NULL),
k AS (SELECT session_id, window_start_ms, count(*) >= 20 AND greatest(coalesce(max(gap), 0), min(timestamp_ms) - any_value(window_start_ms), any_value(window_end_ms) - max(timestamp_ms)) <= {60 * V.DAY} AS good FROM g GROUP BY ALL)
SELECT session_id, window_start_ms FROM k WHERE good""")
def vector_quality_gate(spark, d):
    own = V.line_vectors(spark, d).select("session_id", "timestamp_ms", "ax", F.when(F.col("l_orderkey") % 5 != 0, F.col("ay")).alias("ay"), "az")
    rows = windows.with_contexts(windows.assign_windows(own, sessions.session_stats(own, V.LINE_STEP), V.LINE_WINDOW, V.LINE_STEP), [V.LINE_WINDOW])
    return windows.quality_gate(rows, {"accelerometer": ("ax", "ay", "az")}, [V.LINE_WINDOW], {"accelerometer": 20000 / V.LINE_WINDOW}, 60 * V.DAY)


@query(f"""WITH {_PARTIAL_W}, x AS (SELECT session_id, window_start_ms, {_pearson('ax', 'ay')} AS a, {_pearson('ax', 'az')} AS b, {_pearson('ay', 'az')} AS c, count(*) AS n FROM v_r WHERE ay IS NOT NULL GROUP BY ALL),
r AS (SELECT session_id, window_start_ms, timestamp_ms, sqrt(ax*ax+ay*ay+az*az) AS v FROM v_r WHERE ay IS NOT NULL), q AS (SELECT session_id, window_start_ms, timestamp_ms, min(v) AS v FROM r GROUP BY ALL),
m AS (SELECT session_id, window_start_ms, max(v) - min(v) AS r FROM q GROUP BY ALL)
SELECT x.session_id, x.window_start_ms, round(m.r::FLOAT::DOUBLE, 2) AS range, round(CASE WHEN n < 2 THEN 0 ELSE coalesce((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 0) END, 4) AS correlation FROM x JOIN m ON m.session_id = x.session_id AND m.window_start_ms = x.window_start_ms""")
def feature_wide_vectors(spark, d):
    own = V.line_vectors(spark, d).select("session_id", "timestamp_ms", "ax", F.when(F.col("l_orderkey") % 5 != 0, F.col("ay")).alias("ay"), "az")
    wide = features.window_features(own, {"accelerometer": ("ax", "ay", "az")}, V.LINE_WINDOW, V.LINE_STEP, aggregates=("Range", "mean-axis_correlation"))
    return wide.select(*KEYS, F.round(F.col("`accelerometer#range`").cast("double"), 2).alias("range"), F.round(F.col("`accelerometer#mean_axis_correlation`").cast("double"), 4).alias("correlation"))


# Splits, balancing, weights ----------------------------------------------------------------


@query(f"WITH {V.ES} SELECT participant_id, count(DISTINCT label) AS n_label, count(DISTINCT phone_position) AS n_phone_position FROM es GROUP BY 1 HAVING count(DISTINCT label) > 1 OR count(DISTINCT phone_position) > 1")
def group_purity(spark, d):
    return splits.impure(V.event_sessions(spark, d), "participant_id", "label", "phone_position")


@query(f"WITH {V.ES} SELECT label, count(DISTINCT participant_id) AS participants FROM es GROUP BY 1")
def mode_participants(spark, d):
    return splits.mode_participants(V.event_sessions(spark, d))


@query(f"WITH {V.ES} SELECT DISTINCT label FROM es WHERE label NOT IN (0, 1, 2)")
def unknown_labels(spark, d):
    return splits.unknown_labels(V.event_sessions(spark, d), [0, 1, 2])


@query(f"""WITH {V.ES}, g AS (SELECT DISTINCT label, session_id FROM es WHERE domain = 'collector'), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_key('session_id')}, session_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM g)
SELECT label, session_id, CASE WHEN k <= greatest(1, least(floor(n * 0.6), n - 1)) THEN 'calibration' ELSE 'holdout' END AS role FROM r""")
def calibration_holdout_split(spark, d):
    return splits.holdout(V.event_sessions(spark, d).where("domain = 'collector'"), 0.6, SEED, "session_id")


@query(f"WITH {V.ES}, g AS (SELECT DISTINCT session_id FROM es WHERE domain = 'collector') SELECT session_id, ((row_number() OVER (ORDER BY {md5_key('session_id')}, session_id) - 1) % 5)::INT AS fold FROM g")
def group_kfold(spark, d):
    return splits.group_kfold(V.event_sessions(spark, d).where("domain = 'collector'"), 5, SEED, "session_id")


@query(f"WITH {V.ES}, g AS (SELECT DISTINCT participant_id FROM es WHERE domain = 'collector') SELECT a.participant_id AS fold, b.participant_id, CASE WHEN a.participant_id = b.participant_id THEN 'test' ELSE 'train' END AS role FROM g a, g b")
def lopo_folds(spark, d):
    return splits.leave_one_out(V.event_sessions(spark, d).where("domain = 'collector'"))


@query(f"WITH {V.ES}, c AS (SELECT participant_id AS fold, count(*) AS test_rows, count(DISTINCT session_id) AS test_groups FROM es GROUP BY 1) SELECT fold, test_rows, (SELECT count(*) FROM es) - test_rows AS train_rows, test_groups, (SELECT count(DISTINCT session_id) FROM es) - test_groups AS train_groups FROM c")
def lopo_sizes(spark, d):
    """A row for each participant, from roles by predicate, without the table of pairs."""
    return splits.leave_one_out_sizes(V.event_sessions(spark, d))


@query()
def stratified_group_kfold(spark, d):
    return splits.stratified_group_kfold(V.event_sessions(spark, d).where("domain = 'collector'"), 5, SEED)


_DURATIONS = V.FR + """,
b AS (SELECT *, max(window_end_ms) OVER (PARTITION BY session_id ORDER BY window_start_ms, window_end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fr),
du AS (SELECT domain, session_id, participant_id, label, sum(greatest(0, window_end_ms - greatest(window_start_ms, coalesce(reach, window_start_ms)))) / 1000.0 AS seconds FROM b GROUP BY 1, 2, 3, 4)"""
_CHOSEN = _DURATIONS + f""",
t AS (SELECT min(s) AS target FROM (SELECT sum(seconds) AS s FROM du WHERE domain = 'collector' GROUP BY label)),
ro AS (SELECT *, row_number() OVER (PARTITION BY label, participant_id ORDER BY {md5_key('session_id')}, session_id) AS round FROM du WHERE domain = 'collector'),
ch AS (SELECT * FROM (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY label ORDER BY round, participant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ro), t WHERE before < target)"""


@query(f"WITH {_DURATIONS} SELECT session_id, participant_id, label, round(seconds, 3) AS seconds FROM du")
def covered_duration(spark, d):
    return rounded(balance.session_durations(V.feature_rows(spark, d)), 3)


@query(f"WITH {_CHOSEN} SELECT session_id, window_start_ms, label FROM fr WHERE domain <> 'collector' OR session_id IN (SELECT session_id FROM ch)")
def duration_balance(spark, d):
    return balance.balance_durations(V.feature_rows(spark, d), SEED).select("session_id", "window_start_ms", "label")


@query(f"WITH {_CHOSEN} SELECT label, round(any_value(target), 3) AS target, count(*) AS sessions, round(sum(seconds), 3) AS seconds FROM ch GROUP BY label")
def duration_balance_report(spark, d):
    return rounded(balance.balance_report(V.feature_rows(spark, d), SEED), 3)


@query(f"WITH {V.FR} SELECT session_id, window_start_ms, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM fr) * count(*) OVER (PARTITION BY label)) * CASE WHEN domain = 'collector' THEN 2.0 ELSE 1.0 END, 6) AS weight FROM fr")
def weights_class_balanced(spark, d):
    return rounded(balance.class_weights(V.feature_rows(spark, d), 2.0).select(*KEYS, "weight"))


@query(f"""WITH {V.FR}, s AS (SELECT domain, label, participant_id, session_id, count(*) AS r FROM fr GROUP BY ALL), p AS (SELECT domain, label, participant_id, count(*) AS s FROM s GROUP BY ALL), m AS (SELECT domain, label, count(*) AS p, CASE WHEN domain = 'collector' THEN 2.0 ELSE 1.0 END AS mass FROM p GROUP BY ALL)
SELECT session_id, window_start_ms, round(mass / p / s / r * (SELECT count(*) FROM fr) / (SELECT sum(mass) FROM m), 6) AS weight FROM fr JOIN s USING (domain, label, participant_id, session_id) JOIN p USING (domain, label, participant_id) JOIN m USING (domain, label)""")
def weights_hierarchical(spark, d):
    return rounded(balance.hierarchical_weights(V.feature_rows(spark, d), 2.0).select(*KEYS, "weight"))


# Metrics -----------------------------------------------------------------------------------


_GRID = "l AS (SELECT unnest(range(0, 5))::INT AS label)"
_REPORT = "SELECT {by} l.label, sum((truth = l.label AND prediction = l.label)::INT) AS tp, sum((truth = l.label)::INT) AS support, sum((prediction = l.label)::INT) AS chosen FROM {pr}, l GROUP BY ALL"
_SCORES = "coalesce(tp / nullif(chosen, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp / nullif(chosen + support, 0), 0) AS f1"
_MEANS = "round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(min(recall), 6) AS minimum_class_recall, round(avg(precision), 6) AS macro_precision, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS rows"


def _conf(spark, d):
    return metrics.confusion(V.predictions(spark, d), V.LABELS)


@query(f"WITH {V.PR}, {_GRID} SELECT a.label AS truth, b.label AS prediction, count(pr.truth) AS n FROM l a CROSS JOIN l b LEFT JOIN pr ON pr.truth = a.label AND pr.prediction = b.label GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return _conf(spark, d)


@query(f"WITH {V.PR}, {_GRID}, c AS (SELECT a.label AS truth, b.label AS prediction, count(pr.truth) AS n FROM l a CROSS JOIN l b LEFT JOIN pr ON pr.truth = a.label AND pr.prediction = b.label GROUP BY 1, 2) SELECT *, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM c")
def confusion_normalized(spark, d):
    return rounded(metrics.normalized(_conf(spark, d)))


@query(f"WITH {V.PR}, {_GRID}, r AS ({_REPORT.format(by='', pr='pr')}) SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (SELECT *, {_SCORES} FROM r)")
def class_report(spark, d):
    return rounded(metrics.class_report(_conf(spark, d)))


@query(f"WITH {V.PR}, {_GRID}, r AS ({_REPORT.format(by='', pr='pr')}) SELECT {_MEANS} FROM (SELECT *, {_SCORES} FROM r)")
def overall_metrics(spark, d):
    return rounded(metrics.overall(_conf(spark, d)))


_SLICES = "x AS (SELECT 'all' AS slice, 'all' AS value, truth, prediction FROM pr UNION ALL SELECT 'phone_position', phone_position, truth, prediction FROM pr UNION ALL SELECT 'participant_id', participant_id, truth, prediction FROM pr)"


@query(f"WITH {V.PR}, {_GRID}, {_SLICES}, r AS ({_REPORT.format(by='slice, value,', pr='x')}) SELECT slice, value, {_MEANS} FROM (SELECT *, {_SCORES} FROM r) GROUP BY slice, value")
def metrics_by_slice(spark, d):
    return rounded(metrics.by_slice(V.predictions(spark, d), V.LABELS, ["phone_position", "participant_id"]))


_VOTES = "n AS (SELECT session_id, prediction, count(*) AS c FROM pr GROUP BY ALL), v AS (SELECT session_id, arg_max(prediction, c * 10 - prediction) AS prediction FROM n GROUP BY 1), t AS (SELECT session_id, min(truth) AS truth, count(DISTINCT truth) AS truths FROM pr GROUP BY 1), vt AS (SELECT session_id, truth, prediction, truths FROM v JOIN t USING (session_id))"


@query(f"WITH {V.PR}, {_VOTES} SELECT * FROM vt")
def session_vote(spark, d):
    return metrics.session_vote(V.predictions(spark, d), V.LABELS)


@query(f"WITH {V.PR}, {_GRID}, {_VOTES}, r AS ({_REPORT.format(by='', pr='vt')}) SELECT {_MEANS} FROM (SELECT *, {_SCORES} FROM r)")
def session_vote_metrics(spark, d):
    return rounded(metrics.overall(metrics.confusion(metrics.session_vote(V.predictions(spark, d), V.LABELS), V.LABELS)))


@query(f"""WITH {V.PR}, {_GRID}, g AS (SELECT participant_id AS grp, row_number() OVER (ORDER BY {md5_key("participant_id")}, participant_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT participant_id FROM pr)),
c AS (SELECT participant_id AS grp, truth, prediction, count(*) AS n FROM pr GROUP BY ALL),
dr AS (SELECT t.it, ('0x' || substr(md5('{SEED}-' || t.it || '-' || g.i), 1, 8))::BIGINT % g.n AS i FROM g, (SELECT unnest(range(0, 40)) AS it) t),
cc AS (SELECT it, truth, prediction, sum(c.n) AS n FROM dr JOIN g ON g.i = dr.i JOIN c ON c.grp = g.grp GROUP BY ALL),
r AS (SELECT it, l.label, sum(CASE WHEN truth = l.label AND prediction = l.label THEN n ELSE 0 END) AS tp, sum(CASE WHEN truth = l.label THEN n ELSE 0 END) AS support, sum(CASE WHEN prediction = l.label THEN n ELSE 0 END) AS chosen FROM cc, l GROUP BY ALL),
s AS (SELECT *, {_SCORES} FROM r), o AS (SELECT it, sum(recall * support) / sum(support) AS accuracy, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1, min(recall) AS minimum_class_recall FROM s GROUP BY it),
x AS (SELECT metric, x FROM (UNPIVOT (SELECT accuracy, balanced_accuracy, macro_f1, minimum_class_recall FROM o) ON accuracy, balanced_accuracy, macro_f1, minimum_class_recall INTO NAME metric VALUE x) UNION ALL SELECT 'recall_' || label, recall FROM s WHERE support > 0)
SELECT metric, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM x GROUP BY metric""")
def participant_bootstrap_ci(spark, d):
    return rounded(metrics.bootstrap_ci(V.predictions(spark, d), V.LABELS, 40, SEED))


# Digests, snapshots, reports -----------------------------------------------------------------


@query(f"""WITH {V.ES} SELECT count(DISTINCT session_id) AS session_count, sha256('["' || string_agg(DISTINCT session_id, '","' ORDER BY session_id) || '"]') AS session_id_digest FROM es""")
def session_digest(spark, d):
    return digest.session_digest(V.event_sessions(spark, d))


@query(f"""WITH {V.ES}, h AS (SELECT domain, ('0x' || substr(md5(session_id || chr(31) || timestamp_ms), 1, 15))::BIGINT AS h FROM es), s AS (SELECT domain, count(*) AS rows, sum(h) AS s, bit_xor(h) AS x FROM h GROUP BY domain)
SELECT domain, rows, substr(sha256('session_id:string,timestamp_ms:bigint|' || rows || '|' || s || '|' || x), 1, 36) AS digest FROM s""")
def dataset_digest(spark, d):
    return digest.dataset_digest(V.event_sessions(spark, d), ["session_id", "timestamp_ms"], ("domain",))


def _index(spark, d):
    """A session index derived from users: one row a session."""
    own = V.event_sessions(spark, d)
    one = own.groupBy("session_id", "participant_id", "vehicle_type").agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b"), F.count(F.lit(1)).alias("n"))
    u = F.expr("cast(substr(participant_id, 2) as int)")
    who = F.when(u % 4 == 0, F.concat(F.lit("test_"), F.lpad(u.cast("string"), 3, "0"))).otherwise(F.concat(F.lit("participant_"), F.lpad(u.cast("string"), 3, "0")))
    return one.select(
        "session_id", who.alias("participant_id"), "vehicle_type", F.concat(F.lit("raw/"), F.when(u % 5 == 0, F.lit("other")).otherwise(who), F.lit("/"), "session_id").alias("s3_key"),
        F.concat(F.lpad(F.col("a").cast("string"), 15, "0"), F.lit("#"), "session_id").alias("sync_key"), F.when(u % 6 == 0, "pending").otherwise("received").alias("sync_partition"),
        F.col("n").cast("string").alias("sample_count"), F.when(u % 2 == 0, F.col("a")).cast("string").alias("trimmed_start_ms"), F.col("b").cast("string").alias("trimmed_end_ms"),
        F.col("a").cast("string").alias("started_at_ms"), F.when(u % 3 != 0, F.col("b") - 5000).cast("string").alias("stopped_at_ms"), F.when(u % 7 == 0, "12.5").alias("duration_seconds"),
    )


_IX = f"""{V.ES}, ix0 AS (SELECT session_id, vehicle_type, substr(participant_id, 2)::INT AS u, min(timestamp_ms) AS a, max(timestamp_ms) AS b, count(*) AS n FROM es GROUP BY ALL),
ix AS (SELECT session_id, vehicle_type, u, a, b, n, CASE WHEN u % 4 = 0 THEN 'test_' ELSE 'participant_' END || left(lpad(u::VARCHAR, 3, '0'), 3) AS participant_id, lpad(a::VARCHAR, 15, '0') || '#' || session_id AS sync_key FROM ix0)"""


@query(f"WITH {_IX} SELECT session_id, participant_id FROM ix WHERE u % 4 <> 0 AND u % 5 <> 0 AND u % 6 <> 0")
def eligible_sessions(spark, d):
    return snapshot.since(_index(spark, d), None).where(snapshot.is_eligible()).select("session_id", "participant_id")


@query(f"WITH {_IX} SELECT max(sync_key) AS sync_key FROM ix WHERE u % 6 <> 0 AND sync_key > '000001704000000'")
def sync_high_water_mark(spark, d):
    return snapshot.high_water_mark(snapshot.since(_index(spark, d), "000001704000000"))


_SN = f"{_IX}, sn AS (SELECT *, CASE WHEN u % 7 = 0 THEN 12.5 WHEN u % 2 = 0 THEN (b - a) / 1000.0 WHEN u % 3 <> 0 AND b - 5000 >= a THEN (b - 5000 - a) / 1000.0 END AS seconds FROM ix)"


@query(f"WITH {_SN} SELECT session_id, n AS sample_count, round(seconds, 3) AS duration_seconds FROM sn")
def session_snapshot(spark, d):
    return rounded(snapshot.snapshot_sessions(_index(spark, d)).select("session_id", "sample_count", "duration_seconds"), 3)


@query(f"WITH {_SN} SELECT coalesce(vehicle_type, 'Total') AS mode, count(*) AS sessions, count(DISTINCT participant_id) AS participants, round(coalesce(sum(seconds), 0), 3) AS seconds, sum(n)::BIGINT AS samples FROM sn GROUP BY ROLLUP (vehicle_type)")
def mode_summary_rollup(spark, d):
    return rounded(snapshot.mode_summary(snapshot.snapshot_sessions(_index(spark, d))), 3)


@query(f"WITH {_SN} SELECT coalesce(participant_id, 'Total') AS participant, round(CASE WHEN grouping(participant_id) = 1 THEN coalesce(sum(seconds) FILTER (vehicle_type = 'click'), 0) ELSE nullif(sum(seconds) FILTER (vehicle_type = 'click'), 0) END, 3) AS click, round(CASE WHEN grouping(participant_id) = 1 THEN coalesce(sum(seconds) FILTER (vehicle_type = 'view'), 0) ELSE nullif(sum(seconds) FILTER (vehicle_type = 'view'), 0) END, 3) AS view, round(coalesce(sum(seconds), 0), 3) AS Total FROM sn GROUP BY ROLLUP (participant_id)")
def participant_mode_crosstab(spark, d):
    return rounded(snapshot.participant_mode(snapshot.snapshot_sessions(_index(spark, d)), ["click", "view"]), 3)


@query(f"WITH {_SN} SELECT session_id, CASE WHEN seconds IS NOT NULL THEN format('{{:02d}}:{{:02d}}:{{:02d}}', round_even(seconds, 0)::BIGINT // 3600, round_even(seconds, 0)::BIGINT % 3600 // 60, round_even(seconds, 0)::BIGINT % 60) END AS duration FROM sn")
def duration_hms(spark, d):
    own = snapshot.snapshot_sessions(_index(spark, d))
    return own.select("session_id", F.when(F.col("duration_seconds").isNotNull(), S.hms(F.col("duration_seconds"))).alias("duration"))


def _runs(spark, d):
    """Each participant's metrics as a run."""
    return metrics.overall(metrics.confusion(V.predictions(spark, d), V.LABELS, ("participant_id",)), ("participant_id",)).withColumnRenamed("participant_id", "run")


_RUNS = f"{V.PR}, {_GRID}, r AS ({_REPORT.format(by='participant_id AS run,', pr='pr')}), sc AS (SELECT *, {_SCORES} FROM r), ru AS (SELECT run, {_MEANS} FROM sc GROUP BY run)"


@query(f"WITH {_RUNS} SELECT run, macro_f1, accuracy FROM ru ORDER BY macro_f1 DESC, run LIMIT 10")
def top_runs_by_metric(spark, d):
    return reports.top_runs(rounded(_runs(spark, d).select("run", "macro_f1", "accuracy")), "macro_f1", 10, ["run"])


@query(f"WITH {_RUNS} SELECT run, minimum_class_recall FROM ru ORDER BY minimum_class_recall DESC, run LIMIT 1")
def best_run(spark, d):
    return reports.top_runs(rounded(_runs(spark, d).select("run", "minimum_class_recall")), "minimum_class_recall", 1, ["run"])


@query(f"WITH {_RUNS} SELECT run, " + ", ".join(f"round(max(recall) FILTER (label = {i} AND support > 0), 6) AS mode_{i}" for i in V.LABELS) + " FROM sc GROUP BY run")
def recall_pivot(spark, d):
    report = metrics.class_report(metrics.confusion(V.predictions(spark, d), V.LABELS, ("participant_id",)), ("participant_id",)).where("support > 0")
    wide = reports.pivot(report.withColumn("mode", F.concat(F.lit("mode_"), F.col("label").cast("string"))), "participant_id", "mode", "recall", [f"mode_{i}" for i in V.LABELS])
    return rounded(wide.withColumnRenamed("participant_id", "run"))


@query(f"WITH {_RUNS} SELECT run, accuracy FROM ru")
def run_dedupe(spark, d):
    runs = rounded(_runs(spark, d).select("run", "accuracy"))
    return reports.dedupe(runs.union(runs), "run", ["accuracy"])[0]


@query(f"WITH {V.PR}, {_GRID}, c AS (SELECT a.label AS truth, list(n ORDER BY b) AS ns FROM (SELECT a.label AS label, b.label AS b, count(pr.truth) AS n FROM l a CROSS JOIN l b LEFT JOIN pr ON pr.truth = a.label AND pr.prediction = b.label GROUP BY 1, 2) a GROUP BY 1) SELECT truth, round(ns[1] / list_sum(ns), 6) AS share_0, list_sum(ns)::BIGINT AS support FROM c")
def matrix_normalized(spark, d):
    rows = _conf(spark, d).groupBy("truth").agg(F.transform(F.sort_array(F.collect_list(F.struct("prediction", "n"))), lambda x: x["n"]).alias("ns"))
    share = F.get(F.get(reports.normalized_matrix(F.array("ns")), F.lit(0)), F.lit(0))
    return rows.select("truth", F.round(share, 6).alias("share_0"), F.aggregate("ns", F.lit(0).cast("bigint"), lambda t, x: t + x).alias("support"))


@query(f"WITH {_SN} SELECT 'r1' AS run_id, 'index' AS source, count(*) AS sessions, count(seconds) AS with_duration, sha256('[\"' || string_agg(DISTINCT session_id, '\",\"' ORDER BY session_id) || '\"]') AS session_id_digest FROM sn")
def snapshot_summary(spark, d):
    return snapshot.summary(snapshot.snapshot_sessions(_index(spark, d)), "r1", "index")


@query(f"""WITH {V.ES}, i AS (SELECT DISTINCT replace(session_id, 'u', '\\u00fc\\ud83d\\ude00\\"\\u0001') AS id, session_id FROM es)
SELECT count(*) AS session_count, sha256('["' || string_agg(id, '","' ORDER BY session_id) || '"]') AS session_id_digest FROM i""")
def session_digest_escaped(spark, d):
    return digest.session_digest(V.event_sessions(spark, d).select(F.replace("session_id", F.lit("u"), F.lit("\u00fc\U0001f600\"\x01")).alias("session_id")))


_LOG = "lo AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'status=ignored, path=/tmp/x.json' ELSE 'file: path=/data/downloaded_sessions/raw/u' || user_id || '/a' || (event_id % 4) || CASE WHEN event_id % 5 = 0 THEN '.json.gz' WHEN event_id % 5 = 1 THEN '.txt' ELSE '.json' END END AS value, user_id FROM events)"


def _log(spark, d):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    end = F.when(e % 5 == 0, ".json.gz").when(e % 5 == 1, ".txt").otherwise(".json")
    named = F.concat(F.lit("file: path=/data/downloaded_sessions/raw/u"), u, F.lit("/a"), (e % 4).cast("string"), end)
    return spark.read.parquet(f"{d}/events.parquet").select(F.when(e % 3 == 0, "status=ignored, path=/tmp/x.json").otherwise(named).alias("value"), "user_id")


@query(rf"WITH {_LOG} SELECT DISTINCT regexp_extract(value, 'path=/data/downloaded_sessions/(.+(\.json|\.json\.gz))$', 1) AS path FROM lo WHERE value ~ '.*path=/data/downloaded_sessions/.+(\.json|\.json\.gz)'")
def log_session_paths(spark, d):
    return snapshot.session_paths(_log(spark, d))


@query(rf"WITH {_LOG}, p AS (SELECT DISTINCT user_id, regexp_extract(value, 'path=/data/downloaded_sessions/(.+(\.json|\.json\.gz))$', 1) AS path FROM lo) SELECT user_id, path || '.metadata.json' AS path FROM p WHERE path <> ''")
def log_sidecars(spark, d):
    own = _log(spark, d)
    paths = own.select("user_id", F.regexp_extract("value", snapshot.LOGGED, 1).alias("path")).where("path <> ''").distinct()
    sidecars = paths.withColumn("path", F.concat("path", F.lit(".metadata.json"))).unionByName(paths.withColumn("path", F.concat("path", F.lit(".other"))))
    return snapshot.sessions_of_log(own, sidecars)


@query(f"WITH {_IX} SELECT session_id FROM ix WHERE u % 5 = 0")
def sidecars_without_payload(spark, d):
    own = _index(spark, d)
    files = own.where(~F.col("s3_key").startswith("raw/other/")).select(F.col("s3_key").alias("path"))
    return snapshot.without_payload(own, files).select("session_id")


@query(f"WITH {_RUNS} SELECT run AS name FROM ru WHERE substr(run, 2)::INT % 3 = 0")
def confusion_row_check(spark, d):
    """Runs whose supports are changed are found, the others pass."""
    conf = metrics.confusion(V.predictions(spark, d), V.LABELS, ("participant_id",))
    rows = conf.groupBy("participant_id", "truth").agg(F.sum("n").alias("s"), F.transform(F.sort_array(F.collect_list(F.struct("prediction", F.col("n").cast("double").alias("n")))), lambda x: x["n"]).alias("row"))
    wrong = F.when(F.substring("participant_id", 2, 9).cast("int") % 3 == 0, 1).otherwise(0)
    each = rows.groupBy("participant_id").agg(F.sort_array(F.collect_list(F.struct("truth", "row", "s"))).alias("x"))
    entry = lambda x: F.struct(F.concat(F.lit("mode_"), x["truth"].cast("string")), F.concat(F.lit('{"support": '), (x["s"] + wrong).cast("string"), F.lit("}")))
    own = each.select(F.col("participant_id").alias("name"), F.map_from_entries(F.transform("x", entry)).alias("report"), F.transform("x", lambda x: x["row"]).alias("matrix"))
    return reports.bad_matrices(own).select("name")


@query(f"WITH {_RUNS} SELECT run, trial_index FROM (SELECT run, CASE WHEN substr(run, 2)::INT % 4 <> 0 THEN substr(run, 2)::INT % 50 END AS trial_index FROM ru) ORDER BY trial_index NULLS LAST, run LIMIT 20")
def runs_in_order(spark, d):
    u = F.substring("run", 2, 9).cast("int")
    own = _runs(spark, d).select("run", F.when(u % 4 != 0, u % 50).alias("trial_index"), F.col("run").alias("name"))
    return reports.in_order(own).limit(20).select("run", "trial_index")


@query(f"WITH {_RUNS} SELECT run, 2::BIGINT AS versions FROM ru WHERE accuracy > 0")
def run_conflicts(spark, d):
    runs = rounded(_runs(spark, d).select("run", "accuracy"))
    return reports.dedupe(runs.union(runs.withColumn("accuracy", F.lit(0.0))), "run", ["accuracy"])[1]


@query(f"WITH {_IX} SELECT CASE WHEN u % 2 = 0 THEN 'a' ELSE 'b' END AS source, 2 AS version, max(sync_key) AS sync_key FROM ix GROUP BY 1")
def marks_advanced(spark, d):
    """Marks of an older version don't count, those ahead of what was seen stay."""
    own = _index(spark, d).withColumn("even", F.expr("cast(substr(session_id, 2, instr(session_id, '-') - 2) as int) % 2 = 0"))
    marks = own.where("even").agg(F.lit("a").alias("source"), F.lit(1).alias("version"), F.lit("9").alias("sync_key")).unionByName(own.where("NOT even").agg(F.lit("b").alias("source"), F.lit(2).alias("version"), F.max("sync_key").alias("sync_key")))
    marks = incremental.advance_mark(marks, "a", own.where("even"), 2)
    # All sessions but some, none of which is ahead of the mark.
    return incremental.advance_mark(marks, "b", own.where("NOT even AND session_id < 'u5'"), 2)


@query(f"WITH {V.ES} SELECT session_id, count(*) AS n FROM es GROUP BY 1")
def incremental_ingest_stream(spark, d):
    """The events by a file stream, run twice: each session is taken once."""
    out = scratch_dir(spark, "ingest")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    for _ in range(2):
        incremental.run_available(spark, d, schema, f"{out}/events", f"{out}/stream", "parquet", lambda x: V.as_sessions(x).select("session_id", "timestamp_ms", "_file"), "events.parquet")
    return spark.read.parquet(f"{out}/events").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.EW} SELECT session_id, count(*) AS windows FROM e_w GROUP BY 1")
def incremental_features(spark, d):
    """Window grids of sessions as they come, in two steps; a session is built once."""
    out, own = scratch_dir(spark, "features"), V.event_sessions(spark, d).select("domain", "session_id", "timestamp_ms").withColumn("domain", F.lit("collector"))
    policy = store.feature_policy("collector", "h", (0, 1e12))
    build = lambda x: windows.window_grid(sessions.session_stats(x, V.STEP), V.WINDOW, V.STEP)
    for part in (own.where("session_id < 'u5'"), own, own):
        store.build_source(part, out, "collector", policy, build, incremental=True)
    return store.read_features(spark, out, "collector").groupBy("session_id").agg(F.count(F.lit(1)).alias("windows"))


@query(f"WITH {V.PR} SELECT participant_id AS session_id FROM pr GROUP BY 1 HAVING count(DISTINCT truth) > 1")
def mixed_sessions(spark, d):
    whole = V.predictions(spark, d).withColumn("session_id", F.col("participant_id"))
    return metrics.session_vote(whole, V.LABELS).where("truths > 1").select("session_id")


# Models: rows only, with SQL for the splits ---------------------------------------------------


def _model_rows(spark, d):
    """Feature rows of all labels, with a group and few participants: a nested run fits for each of them."""
    rows = V.feature_rows(spark, d).withColumnsRenamed({"session_id": "session"})
    few = F.concat(F.lit("g"), (F.substring("participant_id", 2, 9).cast("int") / 3 % 4).cast("int").cast("string"))
    rows = rows.select("domain", few.alias("participant_id"), F.col("session").alias("session_id"), F.col("session").alias("group_id"), "label", F.lit("unknown").alias("phone_position"), "window_start_ms", "window_end_ms", *[c for c in rows.columns if "#" in c])
    # Read many times by the fits: written once.
    path = scratch_dir(spark, "features")
    rows.write.parquet(path)
    return spark.read.parquet(path)


_MODES = {f"mode{i}": i for i in V.LABELS}
_FOREST = ("random_forest", {"numTrees": 10, "maxDepth": 5})


def _asked(rows, trials, **more):
    return protocols.Settings(scratch_dir(rows.sparkSession, "run"), [c for c in rows.columns if "#" in c], _MODES, trials, seed=SEED, **more)


def _weighted_rows(spark, d):
    path = scratch_dir(spark, "weighted")
    balance.class_weights(_model_rows(spark, d)).write.parquet(path)
    return spark.read.parquet(path)


def _holdout_metrics(spark, d, family, params):
    rows = _weighted_rows(spark, d)
    names = [c for c in rows.columns if "#" in c]
    held = F.broadcast(splits.holdout(rows.where("domain = 'collector'"), 0.5, SEED).where("role = 'holdout'").select("group_id"))
    model = ml.fit(rows.join(held, "group_id", "left_anti"), names, family, params, weight="weight", classes=len(V.LABELS))
    return metrics.overall(metrics.confusion(ml.predict(model, rows.join(held, "group_id", "left_semi"), names, V.LABELS), V.LABELS))


@query()
def rf_holdout_metrics(spark, d):
    return _holdout_metrics(spark, d, *_FOREST)


@query()
def ovr_gbt_metrics(spark, d):
    return _holdout_metrics(spark, d, "gradient_boosting", {"maxIter": 3, "maxDepth": 3})


@query()
def mlp_metrics(spark, d):
    return _holdout_metrics(spark, d, "multilayer_perceptron", {"hidden": 8, "maxIter": 30})


@query()
def tuning_oof(spark, d):
    rows = _weighted_rows(spark, d)
    folds = splits.group_kfold(rows, 3, SEED)
    found = ml.tune(rows, folds, "group_id", [c for c in rows.columns if "#" in c], V.LABELS, "random_forest", [{"numTrees": 5, "maxDepth": 3}, {"numTrees": 10, "maxDepth": 5}], weight="weight")
    return spark.createDataFrame([(i, s, str(p)) for i, (s, p) in enumerate(found)], "place int, score double, parameters string")


def _figures(run):
    out = None
    for name, own in run.figures.items():
        part = own.select(F.lit(name).alias("section"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def session_holdout_protocol(spark, d):
    rows = _model_rows(spark, d)
    trials = [_FOREST, ("random_forest", {"numTrees": 3, "maxDepth": 2}), ("multilayer_perceptron", {"hidden": "8_4", "maxIter": 20})]
    return _figures(protocols.session_holdout(rows, _asked(rows, trials, folds=2, balanced=True, collector_factor=2.0)))


#: Small ranges, for a search that is run as a query.
_SPACES = {
    "random_forest": {"numTrees": search.Number(2, 6, step=2), "maxDepth": search.Choice((2, 3)), "featureSubsetStrategy": search.Choice(("sqrt", "0.8"))},
    "multilayer_perceptron": {"hidden": search.Choice(("4", "6_4")), "maxIter": search.Number(10, 20, step=5), "tol": search.Number(1e-4, 1e-3, log=True)},
}


@query()
def trials_searched(spark, d):
    """Trials of a study by search and pruning, for the smallest recall of a mode."""
    rows = _model_rows(spark, d)
    run = protocols.session_holdout(rows, _asked(rows, [], folds=3, spaces=_SPACES, searched=5, pruned=True, metric="minimum_class_recall"))
    return protocols.trials_table(spark, run.trials)


@query()
def participant_nested_protocol(spark, d):
    rows = _model_rows(spark, d)
    return _figures(protocols.participant_nested(rows, _asked(rows, [("random_forest", {"numTrees": 5, "maxDepth": 4}), ("random_forest", {"numTrees": 2, "maxDepth": 2})], folds=2, metric="minimum_class_recall")))


_ROLES = f"""{V.FR}, g AS (SELECT DISTINCT label, session_id FROM fr WHERE domain = 'collector'), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_key('session_id')}, session_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM g),
ro AS (SELECT session_id, 'evaluation' AS role FROM r WHERE k > greatest(1, least(floor(n * 0.5), n - 1)) UNION ALL SELECT session_id, 'calibration' FROM r WHERE k <= greatest(1, least(floor(n * 0.5), n - 1))),
rr AS (SELECT fr.session_id, window_start_ms, 'training' AS role FROM fr WHERE domain <> 'collector' UNION ALL SELECT fr.session_id, window_start_ms, role FROM fr JOIN ro USING (session_id) WHERE domain = 'collector')"""


def _roles(spark, d):
    rows = _model_rows(spark, d)
    parts = splits.holdout(rows.where("domain = 'collector'"), {i: 0.5 for i in V.LABELS}, SEED, "group_id", _MODES)
    return protocols.with_roles(rows, parts.select(F.lit("session").alias("held_out"), F.col("group_id").alias("grp"), "role"), "group_id")


@query(f"WITH {_ROLES} SELECT role, count(*) AS rows, count(DISTINCT session_id) AS sessions FROM rr GROUP BY role")
def run_roles(spark, d):
    return _roles(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("sessions"))


@query(f"""WITH {_ROLES}, h AS (SELECT role, ('0x' || substr(md5(session_id || chr(31) || window_start_ms), 1, 15))::BIGINT AS h FROM rr), s AS (SELECT role, count(*) AS rows, sum(h) AS s, bit_xor(h) AS x FROM h GROUP BY role)
SELECT role, rows, substr(sha256('session_id:string,window_start_ms:bigint|' || rows || '|' || s || '|' || x), 1, 36) AS digest FROM s""")
def run_lineage(spark, d):
    return protocols.lineage(_roles(spark, d), ["session_id", "window_start_ms"])


@query(f"""WITH {V.FR}, rr AS (SELECT 'training' AS role, session_id, window_start_ms FROM fr WHERE domain <> 'collector' UNION ALL SELECT unnest(['calibration', 'evaluation']), session_id, window_start_ms FROM fr WHERE domain = 'collector'),
h AS (SELECT role, ('0x' || substr(md5(session_id || chr(31) || window_start_ms), 1, 15))::BIGINT AS h FROM rr), s AS (SELECT role, count(*) AS rows, sum(h) AS s, bit_xor(h) AS x FROM h GROUP BY role)
SELECT role, rows, substr(sha256('session_id:string,window_start_ms:bigint|' || rows || '|' || s || '|' || x), 1, 36) AS digest FROM s""")
def nested_lineage(spark, d):
    """Of a nested run, every collector row is in the deployed model and is evaluated."""
    rows = _model_rows(spark, d)
    people = rows.where("domain = 'collector'").select("participant_id").distinct()
    parts = people.select(F.explode(F.array(F.lit("none"), F.col("participant_id"))).alias("held_out"), F.col("participant_id").alias("grp"), F.lit("train").alias("role"))
    return protocols.lineage(protocols.with_roles(rows, parts, "participant_id"), ["session_id", "window_start_ms"])


def _documents(spark, d):
    """A metrics document for each participant, written and read back."""
    pred = V.predictions(spark, d)
    u = F.substring("run", 2, 9).cast("int")
    named = pred.select(F.col("participant_id").alias("run")).distinct()
    named = named.select("run", F.struct(F.sha2("run", 256).alias("config_hash"), F.lit(None).cast("string").alias("trial_hash"), F.lit("events").alias("train_dataset"), F.when(u % 2 == 0, F.col("run")).alias("run_name"), F.when(u % 4 != 0, u % 50).alias("trial_index")).alias("identity"))
    folder = scratch_dir(spark, "documents")
    documents.write_documents(documents.documents(named, {"collector_holdout": documents.sections(pred, V.MODES, "participant_id")}), folder)
    found = reports.read_metrics(spark, folder)
    reports.check_scores(found)
    return found


_NAME = "CASE WHEN substr(run, 2)::INT % 2 = 0 THEN run || '-' ELSE '' END || 'events-' || substr(sha256(run), 1, 8)"


@query(f"""WITH {_RUNS} SELECT {_NAME} AS name, CASE WHEN substr(run, 2)::INT % 4 <> 0 THEN substr(run, 2)::INT % 50 END AS trial_index, accuracy, balanced_accuracy, macro_f1, minimum_class_recall, true AS valid,
(row_number() OVER (ORDER BY macro_f1 DESC, {_NAME}))::INT AS place FROM ru QUALIFY place <= 50""")
def report_documents(spark, d):
    """The first documents by their score, and whether their matrices fit their reports."""
    found = _documents(spark, d)
    top = reports.top_runs(rounded(found.select("name", "trial_index", *reports.SCORES)), "macro_f1", 50, ["name"])
    bad = reports.bad_matrices(found).select("name", F.lit(False).alias("valid"))
    place = F.row_number().over(Window.orderBy(F.desc("macro_f1"), "name"))
    return top.withColumn("place", place).join(bad, "name", "left").withColumn("valid", F.coalesce("valid", F.lit(True)))


@query(f"WITH {_RUNS} SELECT {_NAME} AS name, mode, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::DOUBLE AS support FROM sc JOIN (VALUES " + ", ".join(f"('{m}', {n})" for m, n in V.MODES.items()) + ") AS m(mode, n) ON label = n")
def report_mode_scores(spark, d):
    return rounded(reports.mode_scores(_documents(spark, d)).drop("trial_index"))


@query(f"WITH {V.PR}, {_GRID}, {_VOTES}, x AS (SELECT phone_position AS value, truth, prediction FROM pr), r AS ({_REPORT.format(by='value,', pr='x')}), s AS (SELECT value, {_MEANS} FROM (SELECT *, {_SCORES} FROM r) GROUP BY value), q AS ({_REPORT.format(by='', pr='vt')}), whole AS (SELECT {_MEANS} FROM (SELECT *, {_SCORES} FROM q)) SELECT 'by_phone_position' AS part, value, macro_f1, accuracy FROM s UNION ALL SELECT 'session_level', 'all', macro_f1, accuracy FROM whole")
def document_slices(spark, d):
    """Scores by phone position and of whole sessions, out of the document of all predictions."""
    text = documents.sections(V.predictions(spark, d).withColumn("run", F.lit("all")), V.MODES)
    each = text.select(F.explode(F.from_json(F.get_json_object("section", "$.by_phone_position"), "map<string,string>")).alias("value", "x")).select(F.lit("by_phone_position").alias("part"), "value", "x")
    each = each.unionByName(text.select(F.lit("session_level").alias("part"), F.lit("all").alias("value"), F.get_json_object("section", "$.session_level").alias("x")))
    return rounded(each.select("part", "value", *[F.get_json_object("x", f"$.{s}").cast("double").alias(s) for s in ("macro_f1", "accuracy")]))


@query(f"WITH {V.PR} SELECT count(*) AS rows, count(DISTINCT session_id) AS sessions, count(DISTINCT participant_id) AS participants FROM pr")
def evaluation_counts(spark, d):
    return metrics.counts(V.predictions(spark, d))


@query(f"""WITH {V.PR}, {_GRID}, {_VOTES}, r AS ({_REPORT.format(by='', pr='vt')}), s AS (SELECT *, {_SCORES} FROM r), m AS (SELECT {_MEANS} FROM s)
SELECT 'session' AS level, metric, round(x, 6) AS x FROM (UNPIVOT (SELECT accuracy, macro_f1, minimum_class_recall FROM m) ON accuracy, macro_f1, minimum_class_recall INTO NAME metric VALUE x)
UNION ALL SELECT 'session', 'recall@' || label, round(recall, 6) FROM s UNION ALL SELECT 'session', 'sessions', count(*)::DOUBLE FROM vt""")
def evaluation_of_sessions(spark, d):
    own = metrics.evaluation(V.predictions(spark, d), V.LABELS).where("level = 'session' AND slice = 'all'")
    return rounded(own.where(F.col("metric").isin("accuracy", "macro_f1", "minimum_class_recall", "sessions") | F.col("metric").startswith("recall@")).select("level", "metric", "x"))


@query(f"WITH {V.ES} SELECT session_id, timestamp_ms, -count(*) AS n FROM es WHERE timestamp_ms % 7 = 0 GROUP BY ALL")
def unpredicted_rows(spark, d):
    own = V.predictions(spark, d).select("session_id", "timestamp_ms")
    return protocols.incomplete(own, own.where("timestamp_ms % 7 <> 0"), ("session_id", "timestamp_ms"))
