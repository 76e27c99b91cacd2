"""Timestamp text, ages and decay weights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: ISO-8601 forms accepted by the observation and watermark parsers.
ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
_ZONED = r"(Z|[+-]\d{2}:\d{2})$"
_DAY_MICROS = 86_400_000_000.0


def instant(now: dt.datetime | str | Column) -> Column:
    """``now`` as a timestamp column; naive values are UTC."""
    if isinstance(now, Column):
        return now
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now.replace("Z", "+00:00"))
    if now.tzinfo is None:
        now = now.replace(tzinfo=dt.timezone.utc)
    micros = int((now - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc))
                 / dt.timedelta(microseconds=1))
    return F.timestamp_micros(F.lit(micros))


def parse_iso(text: Column) -> Column:
    """ISO text to timestamp (session zone UTC); unparsable text gives null."""
    return F.when(text.rlike(ISO_PATTERN), F.try_to_timestamp(text))


def as_timestamp(column: Column, data_type: T.DataType) -> Column:
    """Observation time of any stored type as a timestamp; bad text becomes null."""
    if isinstance(data_type, T.StringType):
        return parse_iso(column)
    return column.cast("timestamp")


def comparison_text(text: Column) -> Column:
    """Second-precision comparison form of ISO text; other text is kept as it is.

    Zoned values are shifted to UTC and end in ``Z``; naive values stay naive, so a
    naive and a zoned value never compare equal.
    """
    parsed = parse_iso(text)
    naive = F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")
    return (F.when(parsed.isNull(), text)
            .when(text.rlike(_ZONED), F.concat(naive, F.lit("Z")))
            .otherwise(naive))


def comparison_value(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return comparison_text(column)
    return F.date_trunc("second", column.cast("timestamp"))


def age_days(observed: Column, now) -> Column:
    """Fractional days since ``observed``; future values count as age zero."""
    micros = F.unix_micros(instant(now)) - F.unix_micros(observed)
    return F.greatest(F.lit(0.0), micros.cast("double") / F.lit(_DAY_MICROS))


def decay_weight(age: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
