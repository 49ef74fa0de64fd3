"""Import of JSON lines into the flat tables, and what kind of file a path is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions.attributes import EMPTY_MAP
from spanforge.sinks.export import TYPE_NAMES

# Fields read per signal; an export's own spellings are accepted next to the import's.
_FIELDS = {
    "traces": (
        "time string, service string, span_name string, duration_ms double, trace_id string, "
        "span_id string, parent_span_id string, kind int, status string, status_code int, "
        "status_message string"
    ),
    "logs": "time string, service string, severity string, body string",
    "metrics": (
        "time string, service string, name string, metric_name string, type string, "
        "value double, description string, unit string"
    ),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files at a path or glob, with the file they come from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))


# JSON types that a field is read from; a value of any other type counts as missing.
_JSON_TYPES = {"string": "STRING", "int": "BIGINT", "double": r"BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)"}


def _field(row: Column, name: str, kind: str) -> Column:
    path = f"$.{name}"
    found = F.schema_of_variant(F.try_variant_get(row, path, "variant"))
    return F.when(found.rlike(f"^({_JSON_TYPES[kind]})$"), F.try_variant_get(row, path, kind))


def _as_expected(row: Column, fields: list[list[str]]) -> Column:
    """Whether a variant is a flat object whose known fields all have their type or are null."""
    names: dict[str, list[str]] = {}
    for name, kind in fields:
        names.setdefault(kind, []).append(name)
    known = [f"(?:{'|'.join(n)}): (?:{_JSON_TYPES[kind]}|VOID)" for kind, n in names.items()]
    others = f"(?!(?:{'|'.join(n for n, _ in fields)}): )[A-Za-z0-9_]+: [A-Z]+(?:\\([0-9]+,[0-9]+\\))?"
    each = f"(?:{'|'.join([*known, others])})"
    return F.schema_of_variant(row).rlike(f"^OBJECT<{each}(?:, {each})*>$")


def _parsed(lines: DataFrame, signal: str) -> DataFrame:
    """Parse the ``value`` column; a line that is not JSON fails the job and is quoted.

    A field of another type than the expected one counts as missing. Lines without such fields, told by
    one look at the types of all fields, are read in one pass, others field by field. The failure names
    the file where the lines have their ``path``.
    """
    # Not a filter: pushed below the column, it would make lines that are written on the way twice.
    filled = lines.withColumn("value", F.explode(F.filter(F.array("value"), lambda x: F.trim(x) != "")))
    where = [F.lit(" in "), F.col("path")] if "path" in lines.columns else []
    failure = F.raise_error(F.concat(F.lit("invalid JSON line: "), F.col("value"), *where))
    fields = [part.strip().split(" ") for part in _FIELDS[signal].split(",")]
    row = F.coalesce(F.try_parse_json("value"), failure.cast("variant"))
    parsed = filled.select(row.alias("v"), "value").select(
        "v", F.when(_as_expected(F.col("v"), fields), F.from_json("value", _FIELDS[signal])).alias("r")
    )
    each = F.struct(*[_field(F.col("v"), *field).alias(field[0]) for field in fields])
    return parsed.select(F.coalesce("r", each).alias("r"))


def time_ns(text: Column) -> Column:
    """RFC 3339 text to nanoseconds, all nine digits; empty is 0 and other text fails."""
    micros = F.unix_micros(F.to_timestamp(text))
    beyond = F.regexp_extract(text, r"\.[0-9]{6}([0-9]{1,3})", 1)
    nanos = F.rpad(beyond, 3, "0").try_cast("bigint")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(
        micros * 1000 + F.coalesce(nanos, F.lit(0))
    ).cast("bigint")


def _hex_id(text: Column, missing: str) -> Column:
    """An id in lower case; text that is not pairs of hexadecimal digits fails the job."""
    bad = F.raise_error(F.concat(F.lit("invalid hexadecimal id: "), text)).cast("string")
    checked = F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.lower(text)).otherwise(bad)
    return F.when(text.isNull(), missing).otherwise(checked)


def _service(column: Column) -> Column:
    return F.coalesce(column, F.lit("unknown"))


def _resource(service: Column) -> Column:
    return F.create_map(F.lit("service.name"), service)


def import_traces(lines: DataFrame) -> DataFrame:
    """JSON lines to ``traces``; missing ids are zero, the end is start plus whole nanoseconds."""
    r = F.col("r")
    service = _service(r["service"])
    start = time_ns(r["time"])
    length = F.coalesce(r["duration_ms"], F.lit(0.0)) * F.lit(1_000_000.0)
    duration = F.when(length > 0, F.floor(length)).otherwise(0).cast("bigint")
    named = F.when(r["status"] == "Ok", 1).when(r["status"] == "Error", 2)
    return _parsed(lines, "traces").select(
        service.alias("service_name"),
        F.coalesce(r["span_name"], F.lit("")).alias("span_name"),
        _hex_id(r["trace_id"], "0" * 32).alias("trace_id"),
        _hex_id(r["span_id"], "0" * 16).alias("span_id"),
        _hex_id(r["parent_span_id"], "").alias("parent_span_id"),
        F.coalesce(r["kind"], F.lit(0)).alias("kind"),
        start.alias("start_time_unix_nano"),
        (start + duration).alias("end_time_unix_nano"),
        duration.alias("duration_ns"),
        F.coalesce(named, r["status_code"], F.lit(0)).alias("status_code"),
        F.coalesce(r["status_message"], F.lit("")).alias("status_message"),
        F.expr(EMPTY_MAP).alias("attributes"),
        _resource(service).alias("resource"),
    )


def import_logs(lines: DataFrame) -> DataFrame:
    """JSON lines to ``logs``; the severity number follows from the level name in the text."""
    r = F.col("r")
    service = _service(r["service"])
    return _parsed(lines, "logs").select(
        service.alias("service_name"),
        time_ns(r["time"]).alias("timestamp_unix_nano"),
        T.severity_number(r["severity"]).alias("severity_number"),
        F.coalesce(r["severity"], F.lit("")).alias("severity_text"),
        F.coalesce(r["body"], F.lit("")).alias("body"),
        F.lit("").alias("trace_id"),
        F.lit("").alias("span_id"),
        F.expr(EMPTY_MAP).alias("attributes"),
        _resource(service).alias("resource"),
    )


def _metric_type(name: Column) -> Column:
    """The type's own name, from that or from the display name an export writes."""
    known = {shown.lower(): own for own, shown in TYPE_NAMES.items()}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    lower = F.lower(F.coalesce(name, F.lit("gauge")))
    return F.coalesce(names[lower], lower)


def import_metrics(lines: DataFrame) -> DataFrame:
    """JSON lines to ``metrics``; a row without a value keeps NULL rather than a made-up zero."""
    r = F.col("r")
    service = _service(r["service"])
    return _parsed(lines, "metrics").select(
        service.alias("service_name"),
        F.coalesce(r["name"], r["metric_name"], F.lit("")).alias("metric_name"),
        _metric_type(r["type"]).alias("metric_type"),
        time_ns(r["time"]).alias("timestamp_unix_nano"),
        r["value"].alias("value"),
        F.coalesce(r["unit"], F.lit("")).alias("unit"),
        F.expr(EMPTY_MAP).alias("attributes"),
        _resource(service).alias("resource"),
        F.coalesce(r["description"], F.lit("")).alias("description"),
    )


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def detect_signal(path: Column) -> Column:
    """``logs``, ``metrics`` or (by default) ``traces``, from the file name."""
    stem = file_stem(path)
    return F.when(stem.contains("log"), "logs").when(stem.contains("metric"), "metrics").otherwise(
        "traces"
    )


def detect_format(path: Column) -> Column:
    """``protobuf`` for the binary extensions, else ``jsonl``."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)
    return F.when(extension.isin("pb", "proto", "bin"), "protobuf").otherwise("jsonl")


def import_files(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Import every JSONL file at a path or glob into the table its name stands for."""
    lines = read_lines(spark, path).where(detect_format(F.col("path")) == "jsonl")
    readers = {"traces": import_traces, "logs": import_logs, "metrics": import_metrics}
    return {
        signal: reader(lines.where(detect_signal(F.col("path")) == signal))
        for signal, reader in readers.items()
    }
