"""Dates, times and durations."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import function

UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}
LONG = {"ms": "ms", "milli": "ms", "millis": "ms", "milliseconds": "ms", "s": "s", "second": "s", "seconds": "s", "m": "m", "minute": "m", "minutes": "m", "h": "h", "hour": "h", "hours": "h", "d": "d", "day": "d", "days": "d"}
# The ISO layouts by name.
ISO_FORMATS = {
    "basic_iso_date": "%Y%m%d", "iso_date": "%Y-%m-%d", "iso_instant": "%Y-%m-%dT%H:%M:%SZ", "iso_local_date": "%Y-%m-%d", "iso_local_date_time": "%Y-%m-%dT%H:%M:%S",
    "iso_local_time": "%H:%M:%S", "iso_offset_date": "%Y-%m-%d%z", "iso_offset_date_time": "%Y-%m-%dT%H:%M:%S%z", "iso_offset_time": "%H:%M:%S%z", "iso_ordinal_date": "%Y-%j", "iso_week_date": "%G-W%V-%u",
}


def unit(name: str) -> str:
    if name.lower() not in LONG:
        raise ValueError(f"unit {name} isn't one of ms, s, m, h, d")
    return LONG[name.lower()]


def _zone(name: str) -> timezone | object:
    if re.fullmatch(r"[+-]\d\d:?\d\d", name):
        sign, h, m = name[0], int(name[1:3]), int(name[-2:])
        return timezone((1 if sign == "+" else -1) * timedelta(hours=h, minutes=m))
    from zoneinfo import ZoneInfo

    return ZoneInfo(name)


def parse_text(value: str, unit_name: str, layout: str, zone: str) -> int:
    moment = datetime.strptime(value, layout)
    moment = moment if moment.tzinfo else moment.replace(tzinfo=_zone(zone))
    micro = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return micro // int(UNITS[unit(unit_name)] * 1_000_000)


def format_number(value: int, unit_name: str, layout: str, zone: str) -> str:
    moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=value * UNITS[unit(unit_name)])
    return moment.astimezone(_zone(zone)).strftime(layout)


@function("date.parse")
def parse(time: Column, unit: str = "ms", format: str = "%Y-%m-%d %H:%M:%S", timezone: str = "UTC") -> Column:  # noqa: A002
    """Whole units since 1970 of a text in a strptime layout; floors.  The default layout in UTC stays in the JVM."""
    if format == "%Y-%m-%d %H:%M:%S" and timezone == "UTC":
        seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.to_timestamp_ntz(time, F.lit("yyyy-MM-dd HH:mm:ss")))
        scale = UNITS[LONG[unit.lower()]]
        return (seconds * 1000 if scale < 1 else F.floor(seconds / int(scale))).cast("long")

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: parse_text(v, unit, format, timezone) if v is not None else None).astype("Int64")

    return run(time)


@function("date.format")
def format_(time: Column, unit: str = "ms", format: str = "%Y-%m-%d %H:%M:%S %Z", timezone: str = "UTC") -> Column:  # noqa: A002
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: format_number(int(v), unit, format, timezone) if v == v and v is not None else None)

    return run(time)


@function("date.add")
def add(time: Column, unit: str, add_value: int, add_unit: str) -> Column:
    """In time's unit; what isn't a whole unit is cut."""
    step = add_value * UNITS[LONG[add_unit.lower()]] / UNITS[LONG[unit.lower()]]
    return (time + F.lit(int(step))).cast("long")


@function("date.convert_format")
def convert_format(temporal: Column, current_format: str, convert_to: str) -> Column:
    """From one ISO layout, by name, to another; null and blank give null."""
    if current_format not in ISO_FORMATS or convert_to not in ISO_FORMATS:
        raise ValueError(f"formats are {', '.join(ISO_FORMATS)}")

    def one(v: str | None) -> str | None:
        if v is None or not v.strip():
            return None
        moment = datetime.strptime(v.strip(), ISO_FORMATS[current_format])
        out = moment.strftime(ISO_FORMATS[convert_to])
        return re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", out) if "%z" in ISO_FORMATS[convert_to] else out

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(temporal)


@function("date.get_date_formats")
def get_date_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(list(ISO_FORMATS),)], "formats array<string>")


@function("temporal.format")
def temporal_format(temporal: Column, format: str = "ISO") -> Column:  # noqa: A002
    """strftime of a date or timestamp; ISO gives its ISO text.  Zones aren't known here, so %z and %Z raise."""
    if "%z" in format or "%Z" in format:
        raise ValueError("%z and %Z can't be formatted")
    if format == "ISO":
        return F.date_format(temporal, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.to_datetime(s).dt.strftime(format)

    return run(temporal)
