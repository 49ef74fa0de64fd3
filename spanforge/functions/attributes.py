"""Attribute lists (key plus typed value) as maps, JSON text and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.exposition import plain_decimal

#: Tokens of JSON text. Every loop is possessive, so that a long string needs no deep stack.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}]++|[,:]|[^\s\[\]{},:"]++'
#: Characters that JSON text writes otherwise than they are.
JSON_ESCAPED = r'["\\\x00-\x1F\x7F\u2028\u2029]'
EMPTY_MAP = "cast(map() as map<string,string>)"


def _json_string(text: Column) -> Column:
    # to_json of a one-element array is the quoted, escaped string between two brackets.
    # Most texts have nothing to escape; a writer for each of them costs more than the rest of a row.
    rendered = F.to_json(F.array(text))
    inner = F.substring(rendered, F.lit(2), F.length(rendered) - 2)
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.rlike(JSON_ESCAPED), inner).otherwise(plain)


def bytes_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def value_text(value: Column) -> Column:
    """Plain text of a typed value; NULL when the value is unset."""
    return F.coalesce(
        value["string_value"],
        value["int_value"].cast("string"),
        value["double_value"].cast("string"),
        value["bool_value"].cast("string"),
        bytes_hex(value["bytes_value"]),
        value["json_value"],
    )


def value_json(value: Column) -> Column:
    """JSON text of a typed value: numbers and booleans unquoted, unset values ``null``.

    Doubles have no exponent; NaN and the infinities, which JSON cannot write, are ``null``.
    """
    double = value["double_value"]
    finite = F.abs(double) < float("inf")  # false for NaN, which is above all numbers
    number = F.when(finite, plain_decimal(double)).when(double.isNotNull(), "null")
    return F.coalesce(
        _json_string(value["string_value"]),
        value["int_value"].cast("string"),
        number,
        value["bool_value"].cast("string"),
        _json_string(bytes_hex(value["bytes_value"])),
        value["json_value"],
        F.lit("null"),
    )


def json_display(json: Column) -> Column:
    """Display text of JSON text: lists as ``[a, b]``, objects as ``{k=v, l=w}``, at any depth.

    Leaves are shown as :func:`value_display` shows them: strings without quotes, numbers with a
    fraction or an exponent with six digits, ``null`` as nothing. The text is a row of tokens, each
    of which is shown by itself, so that no nesting has to be followed. Members keep their
    order. Text that is not JSON, or repeats a key within an object, is shown as it is.
    """

    def shown(token: Column) -> Column:
        parsed = F.try_variant_get(F.try_parse_json(token), "$", "string")
        plain = F.substring(token, F.lit(2), F.length(token) - 2)
        text = F.when(token.contains("\\"), parsed).otherwise(plain)
        number = F.format_string("%.6f", token.try_cast("double"))
        return (
            F.when(token == ",", ", ")
            .when(token == ":", "=")
            .when(token == "null", "")
            .when(token.startswith('"'), text)
            .when(token.rlike("^-?[0-9]") & token.rlike("[.eE]"), number)
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(json, F.lit(JSON_TOKEN), F.lit(0))
    parts = F.array_join(F.transform(tokens, shown), "")
    return F.when(F.try_parse_json(json).isNotNull(), parts).otherwise(json)


def value_display(value: Column) -> Column:
    """Display text: doubles with six digits, bytes as hex, lists and maps member by member."""
    return F.coalesce(
        value["string_value"],
        value["int_value"].cast("string"),
        F.when(
            value["double_value"].isNotNull(), F.format_string("%.6f", value["double_value"])
        ),
        value["bool_value"].cast("string"),
        bytes_hex(value["bytes_value"]),
        json_display(value["json_value"]),
        F.lit(""),
    )


def last_wins(pairs: Column) -> Column:
    """Drop earlier entries of a repeated key, so the map does not depend on a session setting."""
    keys = pairs["key"]
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    kept = F.filter(
        pairs,
        lambda kv, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), kv["key"]),
    )
    return F.when(unique, pairs).otherwise(kept)


def to_map(pairs: Column) -> Column:
    """Attribute list as ``map<string,string>``, empty when the list is missing."""
    entries = F.transform(
        last_wins(pairs), lambda kv: F.struct(kv["key"], value_text(kv["value"]))
    )
    return F.coalesce(F.map_from_entries(entries), F.expr(EMPTY_MAP))


def to_json_object(pairs: Column) -> Column:
    """Attribute list as JSON object text, keys sorted, last value of a repeated key."""
    members = F.transform(
        F.sort_array(
            F.transform(
                last_wins(pairs),
                lambda kv: F.struct(kv["key"].alias("k"), value_json(kv["value"]).alias("v")),
            )
        ),
        lambda m: F.concat(_json_string(m["k"]), F.lit(":"), m["v"]),
    )
    return F.coalesce(
        F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")), F.lit("{}")
    )


def map_json(attributes: Column) -> Column:
    """A string map as JSON object text with sorted keys."""
    entries = F.sort_array(F.map_entries(attributes))
    return F.to_json(F.map_from_entries(entries))


def from_map(attributes: Column) -> Column:
    """A string map as an attribute list (the inverse of :func:`to_map` for strings)."""
    null = F.lit(None)
    return F.transform(
        F.sort_array(F.map_entries(attributes)),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.struct(
                e["value"].alias("string_value"),
                null.cast("boolean").alias("bool_value"),
                null.cast("bigint").alias("int_value"),
                null.cast("double").alias("double_value"),
                null.cast("binary").alias("bytes_value"),
                null.cast("string").alias("json_value"),
            ).alias("value"),
        ),
    )


def service_name(pairs: Column) -> Column:
    """``service.name`` when it is a string, else the empty text."""
    found = F.filter(pairs, lambda kv: kv["key"] == "service.name")
    return F.coalesce(F.get(found, F.lit(0))["value"]["string_value"], F.lit(""))
