"""Naming and escaping rules of the Prometheus text format, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(name: Column, allowed: str, empty: str) -> Column:
    replaced = F.regexp_replace(F.regexp_replace(name, "^[0-9]", "_"), f"[^{allowed}]", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", empty).otherwise(replaced)


def metric_name(name: Column) -> Column:
    """Letters, digits, ``_`` and ``:``; anything else and a leading digit become ``_``."""
    return _clean(name, "A-Za-z0-9_:", "_unnamed")


def label_name(name: Column) -> Column:
    return _clean(name, "A-Za-z0-9_", "_")


def escape_help(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def escape_label(text: Column) -> Column:
    return F.replace(escape_help(text), F.lit('"'), F.lit('\\"'))


def plain_decimal(value: Column) -> Column:
    # Shortest digits that read back as the same double, without an exponent.
    text = value.cast("string")
    mantissa = F.regexp_extract(text, r"^-?([0-9]+)\.([0-9]+)E", 1)
    fraction = F.regexp_replace(F.regexp_extract(text, r"^-?[0-9]+\.([0-9]+)E", 1), "0+$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.concat(mantissa, fraction)
    large = F.concat(digits, F.repeat(F.lit("0"), power - F.length(fraction)))
    point = F.concat(
        F.substring(digits, F.lit(1), power + 1),
        F.lit("."),
        F.substring(digits, power + 2, F.length(digits)),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    unsigned = (
        F.when(power < 0, small).when(power >= F.length(fraction), large).otherwise(point)
    )
    sign = F.when(text.startswith("-"), "-").otherwise("")
    plain = F.regexp_replace(text, r"\.0$", "")
    return F.when(text.contains("E"), F.concat(sign, unsigned)).otherwise(plain)


def format_value(value: Column) -> Column:
    """Whole numbers without a point, ``NaN``, ``+Inf`` and ``-Inf``."""
    infinity = F.lit(float("inf"))
    whole = (F.abs(value) < 1e15) & (F.floor(value).cast("double") == value)
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == infinity, "+Inf")
        .when(value == -infinity, "-Inf")
        .when(whole, F.floor(value).cast("string"))
        .otherwise(plain_decimal(value))
    )


def label_value(value: Column) -> Column:
    """Text of a typed attribute value in a label; bytes and nested values are empty."""
    return F.coalesce(
        value["string_value"],
        value["int_value"].cast("string"),
        format_value(value["double_value"]),
        value["bool_value"].cast("string"),
        F.lit(""),
    )


def label_pairs(service: Column, attributes: Column) -> Column:
    """Array of rendered ``name="value"`` labels: the service first, then the attributes."""
    first = F.when(
        service != "",
        F.array(F.concat(F.lit('service_name="'), escape_label(service), F.lit('"'))),
    ).otherwise(F.expr("cast(array() as array<string>)"))
    rest = F.transform(
        F.filter(attributes, lambda kv: kv["value"].isNotNull()),
        lambda kv: F.concat(
            label_name(kv["key"]),
            F.lit('="'),
            escape_label(label_value(kv["value"])),
            F.lit('"'),
        ),
    )
    return F.concat(first, F.coalesce(rest, F.expr("cast(array() as array<string>)")))


def label_set(pairs: Column) -> Column:
    """``{a="1",b="2"}``, or the empty text when there is no label."""
    return F.when(F.size(pairs) == 0, "").otherwise(
        F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    )
