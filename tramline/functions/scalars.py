"""Column functions shared by sources and operators; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that the raw formats use for each sensor.
US_NAMES = {"accelerometer": "accelerometer", "gyroscope": "gyroscope", "magnetic_field": "magnetometer", "magnetometer": "magnetometer", "pressure": "pressure"}
NOR_NAMES = {
    "android.sensor.accelerometer": "accelerometer", "cmaccelerometerdata": "accelerometer", "android.sensor.gyroscope": "gyroscope", "cmgyrodata": "gyroscope",
    "android.sensor.magnetic_field": "magnetometer", "cmmagnetometerdata": "magnetometer",
}
STANDARD_GRAVITY = 9.80665
KILOPASCAL_IN_HECTOPASCAL = 10.0


def lookup(key: Column, names: dict) -> Column:
    """names[key], null where there is none."""
    if not names:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def number(x: Column) -> Column:
    """A finite double, or null for whatever isn't one."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def us_sensor(x: Column) -> Column:
    """The sensor of a dotted name: odd characters removed, lower case, last part."""
    clean = F.lower(F.regexp_replace(x, r"[^a-zA-Z0-9._-]", ""))
    return lookup(F.element_at(F.split(clean, r"\."), -1), US_NAMES)


def nor_sensor(x: Column) -> Column:
    """The sensor of a free name: anything with pressure or altimeter is the pressure sensor."""
    low = F.lower(F.trim(x))
    return F.when(low.contains("pressure") | low.contains("altimeter"), "pressure").otherwise(lookup(low, NOR_NAMES))


def digits_ms(x: Column) -> Column:
    """The first run of digits as milliseconds."""
    return F.nullif(F.regexp_extract(x, r"\d+", 0), F.lit("")).try_cast("bigint")


def iso_ms(x: Column) -> Column:
    """An ISO-8601 time (UTC where no zone is given, whatever the session's zone) as milliseconds, null if it is none."""
    own = F.regexp_replace(F.trim(x), r"^([^:]*:\d\d)(?=$|[Zz+-])", "$1:00")
    zoned = own.rlike(r":.*(?:[A-Za-z]|[+-]\d{1,2}(?::?\d{1,2})?)$")
    utc = F.when(own.contains(":"), F.concat(own, F.lit("Z"))).otherwise(F.concat(own, F.lit("T00:00:00Z")))
    # A time without a date would be taken as today's.
    return F.unix_millis(F.try_to_timestamp(F.when(own.rlike(r"^\d{4}"), F.when(zoned, own).otherwise(utc))))


def filled(x: Column) -> Column:
    """Null for empty text."""
    return F.nullif(x, F.lit(""))


def magnitude(columns: tuple[str, ...]) -> Column:
    """The one value, or the length of the vector; null unless all parts are finite."""
    parts = [number(F.col(c)) for c in columns]
    return parts[0] if len(parts) == 1 else F.sqrt(sum(p * p for p in parts))


def hms(seconds: Column) -> Column:
    """HH:MM:SS of the nearest second (halves to the even one), hours unbounded."""
    s = F.bround(seconds.cast("double")).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def duration_seconds(given: Column, starts: list[tuple[Column, Column]]) -> Column:
    """The given duration, else the first pair (start, end) in ms with end >= start."""
    return F.coalesce(given.try_cast("double"), *[F.when(e >= s, (e - s) / 1000.0) for s, e in starts])


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def shuffle_key(seed: int, *columns: str) -> Column:
    """A text that orders rows pseudo-randomly but the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
