"""Scalar display functions as Column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000

# Severity numbers of the telemetry log data model.
SEVERITY_BANDS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
SEVERITY_FLOOR = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}

# Span kinds and status codes of the telemetry trace data model.
SPAN_KINDS = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]
STATUS_CODES = ["UNSET", "OK", "ERROR"]

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def div(value: Column, by: int) -> Column:
    """Integer division of bigints."""
    return F.call_function("div", value, F.lit(by))


def utc_seconds(ns: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone is."""
    return F.timestamp_add("SECOND", div(ns, NANOS), F.expr(_EPOCH)).cast("string")


def _fraction(ns: Column, digits: int) -> Column:
    unit = 10 ** (9 - digits)
    return F.lpad(div(ns % NANOS, unit).cast("string"), digits, "0")


def format_timestamp_ns(ns: Column) -> Column:
    """RFC 3339 with milliseconds and ``Z``."""
    return F.concat(
        F.translate(utc_seconds(ns), " ", "T"), F.lit("."), _fraction(ns, 3), F.lit("Z")
    )


def format_time_of_day(ns: Column) -> Column:
    """``HH:mm:ss.SSS``; zero is ``-``."""
    text = F.concat(F.substring(utc_seconds(ns), 12, 8), F.lit("."), _fraction(ns, 3))
    return F.when(ns == 0, "-").otherwise(text)


def format_timestamp_full(ns: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSSSSS UTC``; zero is ``-``."""
    text = F.concat(utc_seconds(ns), F.lit("."), _fraction(ns, 6), F.lit(" UTC"))
    return F.when(ns == 0, "-").otherwise(text)


def duration_scaled(ns: Column) -> Column:
    """The number shown by :func:`format_duration`, before rounding."""
    value = ns.cast("double")
    return (
        F.when(ns < 1_000, value)
        .when(ns < 1_000_000, value / 1e3)
        .when(ns < NANOS, value / 1e6)
        .otherwise(value / 1e9)
    )


def duration_unit(ns: Column) -> Column:
    return (
        F.when(ns < 1_000, "ns").when(ns < 1_000_000, "us").when(ns < NANOS, "ms").otherwise("s")
    )


def format_duration(ns: Column) -> Column:
    """Nanoseconds in the largest unit that keeps the number at or above one."""
    number = duration_scaled(ns)
    digits = (
        F.when(ns < 1_000, ns.cast("string"))
        .when(ns < 1_000_000, F.format_string("%.1f", number))
        .when(ns < NANOS, F.format_string("%.2f", number))
        .otherwise(F.format_string("%.3f", number))
    )
    return F.concat(digits, duration_unit(ns))


def severity_band(number: Column) -> Column:
    """Band name of a severity number (four numbers per band), else ``UNSPECIFIED``."""
    names = F.array(*[F.lit(n) for n in SEVERITY_BANDS])
    return F.when(
        number.between(1, 24), F.element_at(names, (div(number - 1, 4) + 1).cast("int"))
    ).otherwise("UNSPECIFIED")


def severity_text(number: Column, text: Column) -> Column:
    """The text when there is one, else the band of the number."""
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(severity_band(number))


def severity_name(number: Column) -> Column:
    """Enum name: ``Error``, ``Error2`` … ``Unspecified``."""
    step = (number - 1) % 4 + 1
    return F.concat(
        F.initcap(severity_band(number)),
        F.when(number.between(1, 24) & (step > 1), step.cast("string")).otherwise(""),
    )


def severity_number(text: Column) -> Column:
    """Number of the first level name contained in the text, 0 when there is none."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = F
    for name in SEVERITY_BANDS:
        out = out.when(upper.contains(name), SEVERITY_FLOOR[name])
    return out.otherwise(0)


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits behind the point; halves of the double's own product go up.

    Rounded before it is printed: printing alone rounds the shortest decimal text of the double, which
    can be a half where the double lies below it.
    """
    unit = float(10**digits)
    return F.format_string(f"%.{digits}f", F.floor(value * unit + 0.5) / unit)


def _name_or_unknown(code: Column, names: list[str]) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    return F.when(
        code.between(0, len(names) - 1), F.element_at(table, code.cast("int") + 1)
    ).otherwise(F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")")))


def span_kind_name(kind: Column) -> Column:
    return _name_or_unknown(kind, SPAN_KINDS)


def status_name(code: Column) -> Column:
    return _name_or_unknown(code, STATUS_CODES)


def compact_scaled(value: Column) -> Column:
    """The number shown by :func:`format_compact`, before rounding."""
    size = F.abs(value)
    return (
        F.when(size >= 1e9, value / 1e9)
        .when(size >= 1e6, value / 1e6)
        .when(size >= 1e3, value / 1e3)
        .otherwise(value)
    )


def compact_suffix(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size >= 1e9, "G").when(size >= 1e6, "M").when(size >= 1e3, "K").otherwise("")


def format_compact(value: Column) -> Column:
    """Short number with G/M/K; one digit, four below one."""
    size = F.abs(value)
    number = compact_scaled(value)
    digits = F.when(
        (size >= 1.0) | (size == 0.0), F.format_string("%.1f", number)
    ).otherwise(F.format_string("%.4f", number))
    return F.concat(digits, compact_suffix(value))


def short_id(hex_id: Column) -> Column:
    return F.substring(hex_id, 1, 8)


def display_service(name: Column) -> Column:
    """Service name for display rows; a missing one is ``<unknown>``."""
    return F.when(F.coalesce(name, F.lit("")) == "", "<unknown>").otherwise(name)
