"""Prometheus text exposition of nested metric batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import exposition as E
from spanforge.sources.flatten import metric_messages

_SAMPLE = (
    "array<struct<suffix:string,extra:string,text:string,number:double,time:bigint,"
    "position:int,attributes:array<string>>>"
)


def _exposed_type(metric: Column) -> Column:
    return (
        F.when(metric["gauge"].isNotNull(), "gauge")
        .when(metric["sum"].isNotNull() & F.coalesce(metric["sum"]["is_monotonic"], F.lit(False)),
              "counter")
        .when(metric["sum"].isNotNull(), "gauge")
        .when(metric["histogram"].isNotNull(), "histogram")
        .when(metric["summary"].isNotNull(), "summary")
        .otherwise("untyped")
    )


def _label(key: str, text: Column) -> Column:
    return F.concat(F.lit(f'{key}="'), text, F.lit('"'))


def _sample(
    dp: Column, service: Column, suffix: str, number: Column, text: Column,
    position: Column, extra: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(suffix).alias("suffix"),
        (extra if extra is not None else F.lit(None).cast("string")).alias("extra"),
        text.alias("text"),
        number.cast("double").alias("number"),
        dp["time_unix_nano"].alias("time"),
        position.cast("int").alias("position"),
        E.label_pairs(service, dp["attributes"]).alias("attributes"),
    )


def _numbers(points: Column, service: Column) -> Column:
    def one(dp: Column) -> Column:
        value = F.coalesce(dp["as_double"], dp["as_int"].cast("double"), F.lit(0.0))
        return _sample(dp, service, "", value, E.format_value(value), F.lit(0))

    return F.transform(points, one)


def _totals(dp: Column, service: Column, after: Column) -> list[Column]:
    total = F.coalesce(dp["sum"], F.lit(0.0))
    count = dp["count"]
    return [
        _sample(dp, service, "_sum", total, E.format_value(total), after + 1),
        _sample(dp, service, "_count", count, count.cast("string"), after + 2),
    ]


def _histograms(points: Column, service: Column) -> Column:
    def one(dp: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        bounds = F.coalesce(dp["explicit_bounds"], F.expr("cast(array() as array<double>)"))
        counts = F.coalesce(dp["bucket_counts"], F.expr("cast(array() as array<bigint>)"))

        def bucket(bound: Column, i: Column) -> Column:
            below = F.aggregate(
                F.slice(counts, F.lit(1), i + 1), zero, lambda total, n: total + n
            )
            extra = _label("le", E.format_value(bound))
            return _sample(dp, service, "_bucket", below, below.cast("string"), i, extra)

        n = F.size(bounds)
        infinite = _sample(
            dp, service, "_bucket", dp["count"], dp["count"].cast("string"), n,
            F.lit('le="+Inf"'),
        )
        return F.concat(
            F.transform(bounds, bucket), F.array(infinite, *_totals(dp, service, n))
        )

    return F.flatten(F.transform(points, one))


def _summaries(points: Column, service: Column) -> Column:
    def one(dp: Column) -> Column:
        quantiles = dp["quantile_values"]

        def quantile(q: Column, i: Column) -> Column:
            extra = _label("quantile", E.format_value(q["quantile"]))
            value = q["value"]
            return _sample(dp, service, "", value, E.format_value(value), i, extra)

        n = F.coalesce(F.size(quantiles), F.lit(0))
        return F.concat(
            F.coalesce(
                F.transform(quantiles, quantile).cast(_SAMPLE),
                F.expr(f"cast(array() as {_SAMPLE})"),
            ),
            F.array(*_totals(dp, service, n)).cast(_SAMPLE),
        )

    return F.flatten(F.transform(points, one))


def prometheus_samples(batches: DataFrame) -> DataFrame:
    """One row per sample line: name, labels, value (text and number), time and position.

    Buckets are cumulative. Exponential histograms and metrics without data give no samples.
    """
    metric, service = F.col("metric"), F.col("service_name")
    parts = [
        _numbers(metric["gauge"]["data_points"], service),
        _numbers(metric["sum"]["data_points"], service),
        _histograms(metric["histogram"]["data_points"], service),
        _summaries(metric["summary"]["data_points"], service),
    ]
    empty = F.expr(f"cast(array() as {_SAMPLE})")
    samples = F.concat(*[F.coalesce(part.cast(_SAMPLE), empty) for part in parts])
    rows = metric_messages(batches).select(
        E.metric_name(F.coalesce(F.col("metric.name"), F.lit(""))).alias("metric"),
        "service_name",
        F.explode(samples).alias("s"),
    )
    pairs = F.when(F.col("s.extra").isNull(), F.col("s.attributes")).otherwise(
        F.concat(F.col("s.attributes"), F.array("s.extra"))
    )
    return rows.select(
        "metric",
        F.concat("metric", "s.suffix").alias("sample_name"),
        E.label_set(pairs).alias("labels"),
        F.col("s.number").alias("value"),
        F.col("s.text").alias("value_text"),
        F.coalesce("s.time", F.lit(0)).alias("timestamp_unix_nano"),
        F.array_join("s.attributes", ",").alias("series"),
        F.col("s.position").alias("position"),
    )


def prometheus_headers(batches: DataFrame) -> DataFrame:
    """Type and help text per exposed name, taken from the oldest message of that name."""
    metric = F.col("metric")
    times = [
        F.array_min(F.transform(metric[kind]["data_points"], lambda dp: dp["time_unix_nano"]))
        for kind in ("gauge", "sum", "histogram", "exponential_histogram", "summary")
    ]
    rows = metric_messages(batches).select(
        E.metric_name(F.coalesce(F.col("metric.name"), F.lit(""))).alias("name"),
        F.coalesce(*times, F.lit(0)).alias("time"),
        _exposed_type(metric).alias("type"),
        F.coalesce(F.col("metric.description"), F.lit("")).alias("description"),
    )
    picked = rows.groupBy(F.col("name").alias("metric")).agg(
        F.min_by(
            F.struct("type", "description"), F.struct("time", "type", "description")
        ).alias("h")
    )
    return picked.select("metric", F.col("h.type").alias("type"),
                         F.col("h.description").alias("description"))


_LINE_COLUMNS = (
    "block int, metric string, section int, series string, timestamp_unix_nano bigint, "
    "position int, line string"
)


def _lines(df: DataFrame, **given: Column) -> DataFrame:
    columns = []
    for part in _LINE_COLUMNS.split(", "):
        name, kind = part.split(" ")
        default = F.lit("") if kind == "string" else F.lit(0)
        columns.append(given.get(name, default).cast(kind).alias(name))
    return df.select(*columns)


# What the four gauges about the store itself count.
STORE_GAUGES = {
    "traces_total": "Number of unique trace IDs stored",
    "spans_total": "Number of spans stored",
    "logs_total": "Number of log records stored",
    "metrics_total": "Number of metric data points stored",
}


def store_gauge_lines(status: DataFrame, prefix: str = "store") -> DataFrame:
    """The four gauges about the tables themselves, from a status row."""
    source = {
        "traces_total": "traces",
        "spans_total": "spans",
        "logs_total": "logs",
        "metrics_total": "data_points",
    }
    entries = []
    for i, (suffix, text) in enumerate(STORE_GAUGES.items()):
        name = f"{prefix}_{suffix}"
        texts = [
            F.lit(f"# HELP {name} {text}"),
            F.lit(f"# TYPE {name} gauge"),
            F.concat(F.lit(f"{name} "), F.col(source[suffix]).cast("string")),
        ]
        for section, line in enumerate(texts):
            entries.append(F.struct(F.lit(i).alias("i"), F.lit(section).alias("section"),
                                    F.lit(name).alias("name"), line.alias("line")))
    rows = status.select(F.explode(F.array(*entries)).alias("e"))
    return _lines(
        rows, block=F.lit(1) + F.col("e.i"), metric=F.col("e.name"),
        section=F.col("e.section"), line=F.col("e.line"),
    )


def prometheus_lines(batches: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """The whole exposition as lines with sort columns; see :func:`in_exposition_order`."""
    described = F.when(F.col("description") != "", E.escape_help(F.col("description")))
    headers = prometheus_headers(batches).select(
        "metric",
        F.posexplode(
            F.array(
                F.concat(F.lit("# HELP "), "metric", F.lit(" "), described),
                F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "type"),
            )
        ).alias("section", "line"),
    )
    header_lines = _lines(
        headers.where(F.col("line").isNotNull()),
        metric=F.col("metric"),
        section=F.col("section"),
        line=F.col("line"),
    )
    sample_lines = _lines(
        prometheus_samples(batches),
        metric=F.col("metric"),
        section=F.lit(2),
        series=F.col("series"),
        timestamp_unix_nano=F.col("timestamp_unix_nano"),
        position=F.col("position"),
        line=F.concat("sample_name", "labels", F.lit(" "), "value_text"),
    )
    out = header_lines.unionByName(sample_lines)
    return out if status is None else out.unionByName(store_gauge_lines(status))


def in_exposition_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy(
        "block", "metric", "section", "series", "timestamp_unix_nano", "position", "line"
    )
