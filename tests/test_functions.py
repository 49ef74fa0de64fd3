import pytest
from pyspark.sql import functions as F

from spanforge.functions import exposition as E
from spanforge.functions import text as T
from spanforge.operators.services import mermaid_id


def each(spark, ddl, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_times(spark):
    ns = [0, 1_710_037_800_123_456_789]
    assert each(spark, "bigint", ns, T.format_timestamp_ns) == [
        "1970-01-01T00:00:00.000Z", "2024-03-10T02:30:00.123Z"]
    assert each(spark, "bigint", ns, T.format_time_of_day) == ["-", "02:30:00.123"]
    assert each(spark, "bigint", ns, T.format_timestamp_full) == [
        "-", "2024-03-10 02:30:00.123456 UTC"]


def test_times_do_not_depend_on_the_session_zone(spark):
    # 02:30 on that day does not exist in New York.
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        shown = each(spark, "bigint", [1_710_037_800_123_456_789], T.format_timestamp_ns)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert shown == ["2024-03-10T02:30:00.123Z"]


def test_durations(spark):
    assert each(spark, "bigint", [0, 999, 1_500, 2_500_000, 1_234_000_000], T.format_duration) == [
        "0ns", "999ns", "1.5us", "2.50ms", "1.234s"]


def test_severity(spark):
    assert each(spark, "int", [0, 1, 8, 9, 14, 17, 24, 25], T.severity_band) == [
        "UNSPECIFIED", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNSPECIFIED"]
    assert each(spark, "int", [0, 9, 18, 24], T.severity_name) == [
        "Unspecified", "Info", "Error2", "Fatal4"]
    assert each(spark, "string", ["INFO", "warning", "SeverityNumberError", "x", None],
                T.severity_number) == [9, 13, 17, 0, 0]
    text = each(spark, "string", ["custom", "", None], lambda c: T.severity_text(F.lit(17), c))
    assert text == ["custom", "ERROR", "ERROR"]


def test_names(spark):
    assert each(spark, "int", [0, 2, 5, 9], T.span_kind_name) == [
        "UNSPECIFIED", "SERVER", "CONSUMER", "UNKNOWN(9)"]
    assert each(spark, "int", [0, 1, 2, 3], T.status_name) == [
        "UNSET", "OK", "ERROR", "UNKNOWN(3)"]
    assert each(spark, "string", ["my-service.v2", "a/b:c", "ok_1"], mermaid_id) == [
        "my_service_v2", "a_b_c", "ok_1"]


def test_compact(spark):
    assert each(spark, "double", [0.0, 0.1234, 5.0, 1500.0, 2.5e6, -3e9], T.format_compact) == [
        "0.0", "0.1234", "5.0", "1.5K", "2.5M", "-3.0G"]


def test_exposition_names(spark):
    names = ["http.request.duration", "0starts_with_digit", "", "a:b", "9.x"]
    assert each(spark, "string", names, E.metric_name) == [
        "http_request_duration", "_starts_with_digit", "_unnamed", "a:b", "__x"]
    assert each(spark, "string", ["a:b", ""], E.label_name) == ["a_b", "_"]


def test_exposition_values(spark):
    values = [42.0, 42.5, float("nan"), float("inf"), float("-inf"), 12345678.25, 1e15, 1.5e-7,
              -0.00012, 2.5e20, -3.0]
    assert each(spark, "double", values, E.format_value) == [
        "42", "42.5", "NaN", "+Inf", "-Inf", "12345678.25", "1000000000000000", "0.00000015",
        "-0.00012", "250000000000000000000", "-3"]


def test_escaping(spark):
    assert each(spark, "string", ['a"b\\c\nd'], E.escape_label) == ['a\\"b\\\\c\\nd']
    assert each(spark, "string", ['a"b\nc'], E.escape_help) == ['a"b\\nc']


@pytest.mark.parametrize("hex_id,short", [("abcdef0123456789", "abcdef01"), ("ab", "ab")])
def test_short_id(spark, hex_id, short):
    assert each(spark, "string", [hex_id], T.short_id) == [short]


def test_value_json_of_doubles(spark):
    from spanforge.functions.attributes import value_json

    shape = ("v struct<string_value: string, int_value: bigint, double_value: double, bool_value: boolean, "
             "bytes_value: binary, json_value: string>")
    values = [float("nan"), float("inf"), float("-inf"), 1e10, -2.5, 1e-7, None]
    rows = spark.createDataFrame([((None, None, d, None, None, None),) for d in values], shape)
    got = [r[0] for r in rows.select(value_json(rows["v"])).collect()]
    assert got[:3] == ["null"] * 3 and got[-1] == "null"
    assert [float(x) for x in got[3:6]] == [1e10, -2.5, 1e-7] and not any("E" in x for x in got[3:6])


def test_fixed_digits_of_halves(spark):
    # As printf('%.3f', floor(x * 1000 + 0.5) / 1000): 32.0725 * 1000 lies below its half.
    shown = each(spark, "double", [32.0725, 130.2325, 0.0625, 0.0, 7.0], lambda c: T.fixed(c, 3))
    assert shown == ["32.072", "130.232", "0.063", "0.000", "7.000"]


def test_json_display_of_brackets_and_quotes(spark):
    import re

    from spanforge.functions.attributes import JSON_TOKEN, json_display

    # Neighbouring brackets are one token; texts without a backslash are shown without parsing.
    assert re.findall(JSON_TOKEN, '[["a"]]') == ["[[", '"a"', "]]"]
    texts = ['[["a",{"k":[]}],[]]', '{"q":"[x]{\\"y\\"}","e":"","u":"é\\u00e9","n":[1,0.5,null]}', '["\\\\"]']
    assert each(spark, "string", texts, json_display) == [
        "[[a, {k=[]}], []]", '{q=[x]{"y"}, e=, u=éé, n=[1, 0.500000, ]}', "[\\]"]
