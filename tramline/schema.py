"""Schemas and fixed names of the sensor-session data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Identity columns, vector axes and scalar sensors of the event table.
IDS = ("domain", "participant_id", "device_id", "session_id", "trip_id", "group_id", "vehicle_type")
SENSORS = {"accelerometer": ("ax", "ay", "az"), "gyroscope": ("gx", "gy", "gz"), "magnetometer": ("mx", "my", "mz"), "pressure": ("p",)}
VALUES = tuple(c for columns in SENSORS.values() for c in columns)

EVENTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in IDS]
    + [T.StructField("label", T.IntegerType()), T.StructField("phone_position", T.StringType()), T.StructField("timestamp_ms", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in VALUES]
)

#: The columns of the headerless format, in order.
US_RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("time", "sensor_type", "value_0", "value_1", "value_2")])

#: The columns of the header format.
NOR_COLUMNS = ("installationId", "journeyNumber", "tripNumber", "manufacturer", "model", "timestamp", "transportType", "typeString", "deviceLocation", "value_0", "value_1", "value_2", "OS")

_SAMPLE = T.StructType([T.StructField("ts", T.StringType()), *(T.StructField(c, T.StringType()) for c in VALUES)])
#: The fields of session files and of their sidecars.
_TEXTS = ("session_id", "participant_id", "device_uuid", "vehicle_type", "phone_position")
PAYLOAD = T.StructType([*(T.StructField(c, T.StringType()) for c in (*_TEXTS, "trimmed_start_ms", "trimmed_end_ms")), T.StructField("samples", T.ArrayType(_SAMPLE))])
SIDECAR = T.StructType([T.StructField(c, T.StringType()) for c in (*_TEXTS, "device_id", "trimmed_start_ms", "trimmed_end_ms", "started_at_ms", "stopped_at_ms", "duration_seconds", "sample_count", "uploaded_at_ms", "s3_key", "sync_key")])

#: Columns that every feature row has beside its features.
FEATURE_IDS = ("domain", "participant_id", "device_id", "session_id", "trip_id", "group_id", "vehicle_type", "label", "phone_position", "window_start_ms", "window_end_ms")
