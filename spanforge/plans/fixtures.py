"""Telemetry tables derived from the star-schema parquet files.

Orders become root spans and their lines child spans, events become log records and gauge
points, monthly and daily roll-ups of lines and orders become sums, histograms and summaries.
The same definitions are written as SQL in :mod:`spanforge.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge import schema
from spanforge.functions import attributes as A

IDS_PER_ORDER = 1 << 20  # span ids of an order; more lines than any order has
SPANS_PER_BATCH = 16
RECORDS_PER_BATCH = 50
BOUNDS = [10.0, 20.0, 30.0, 40.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column: str) -> Column:
    """Nanoseconds since the epoch of a timestamp without time zone."""
    return F.expr(
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) * 1000"
    )


def hex_id(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def _string_map(**pairs: Column) -> Column:
    parts: list[Column] = []
    for key, value in pairs.items():
        parts += [F.lit(key), value]
    return F.create_map(*parts)


def _service_map(service: Column, **pairs: Column) -> Column:
    parts = [F.lit("service.name"), service]
    for key, value in pairs.items():
        parts += [F.lit(key), value]
    return F.create_map(*parts)


def root_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    base = orders.select(
        (F.col("o_orderkey") + 1).alias("k"),
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        ns("o_orderdate").alias("start"),
        F.round(F.col("o_totalprice") * 1000).cast("bigint").alias("dur"),
        # Not a literal: a stored table would not let the optimizer see a constant either.
        F.when(F.col("o_orderkey") >= 0, "gateway").otherwise("edge").alias("svc"),
    )
    return base.select(
        F.col("svc").alias("service_name"),
        F.concat(F.lit("order."), "o_orderpriority").alias("span_name"),
        hex_id(F.col("k"), 32).alias("trace_id"),
        hex_id(F.col("k") * IDS_PER_ORDER, 16).alias("span_id"),
        F.lit("").alias("parent_span_id"),
        F.lit(2).alias("kind"),
        F.col("start").alias("start_time_unix_nano"),
        (F.col("start") + F.col("dur")).alias("end_time_unix_nano"),
        F.col("dur").alias("duration_ns"),
        F.when(F.col("o_orderstatus") == "P", 2)
        .when(F.col("o_orderstatus") == "F", 1)
        .otherwise(0)
        .alias("status_code"),
        F.when(F.col("o_orderstatus") == "P", "returned").otherwise("").alias("status_message"),
        _string_map(priority=F.col("o_orderpriority")).alias("attributes"),
        _service_map(F.col("svc")).alias("resource"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.lit(0).alias("line_no"),
    )


def child_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines are sorted once, by their window: the join hashes the orders of its partition instead.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", ns("o_orderdate").alias("base"))
    orders = orders.hint("shuffle_hash")
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("n", F.row_number().over(line))
        .withColumn("k", (F.col("l_orderkey") + 1) * IDS_PER_ORDER)
        .withColumn("start", F.col("base") + F.col("n") * 1_000_000)
        .withColumn(
            "dur",
            (F.col("l_quantity") * 1_000_000).cast("bigint")
            * F.when(F.col("l_partkey") % 97 == 0, 20).otherwise(1),
        )
        .withColumn(
            "svc", F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 7).cast("string"))
        )
    )
    returned = F.col("l_returnflag") == "R"
    return lines.select(
        F.col("svc").alias("service_name"),
        F.concat(F.lit("line."), "l_returnflag", "l_linestatus").alias("span_name"),
        hex_id(F.col("l_orderkey") + 1, 32).alias("trace_id"),
        hex_id(F.col("k") + F.col("n"), 16).alias("span_id"),
        hex_id(F.col("k") + F.expr("n div 2"), 16).alias("parent_span_id"),
        F.lit(3).alias("kind"),
        F.col("start").alias("start_time_unix_nano"),
        (F.col("start") + F.col("dur")).alias("end_time_unix_nano"),
        F.col("dur").alias("duration_ns"),
        F.when(returned, 2).otherwise(0).alias("status_code"),
        F.when(returned, "returned").otherwise("").alias("status_message"),
        _string_map(
            flag=F.col("l_returnflag"), part=F.col("l_partkey").cast("string")
        ).alias("attributes"),
        _service_map(
            F.col("svc"), supplier=F.col("l_suppkey").cast("string")
        ).alias("resource"),
        F.col("l_orderkey").alias("ingest_seq"),
        F.col("n").alias("line_no"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat traces plus ``ingest_seq`` (arrival order) and ``line_no``."""
    return root_spans(spark, sf_dir).unionByName(child_spans(spark, sf_dir))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select(*schema.TRACE_COLUMNS)


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat logs plus ``batch_id`` (arrival order of their batches)."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    number = (
        F.when(kind == "view", 5)
        .when(kind.isin("click", "signup"), 9)
        .when(kind == "purchase", 13)
        .otherwise(17)
    )
    text = (
        F.when(kind == "view", "DEBUG")
        .when(kind == "signup", "INFO")
        .when(kind == "purchase", "WARN")
        .when(kind == "error", "ERROR")
        .otherwise("")
    )
    linked = F.col("event_id") % 10 != 0
    service = F.concat(F.lit("user-svc-"), (F.col("user_id") % 5).cast("string"))
    return events.select(
        service.alias("service_name"),
        ns("ts").alias("timestamp_unix_nano"),
        number.alias("severity_number"),
        text.alias("severity_text"),
        F.concat(kind, F.lit(" "), "props").alias("body"),
        F.when(linked, hex_id(F.col("event_id") + 1, 32)).otherwise("").alias("trace_id"),
        F.when(linked, hex_id((F.col("event_id") + 1) * IDS_PER_ORDER, 16))
        .otherwise("")
        .alias("span_id"),
        _string_map(k=F.get_json_object("props", "$.k"), type=kind).alias("attributes"),
        _service_map(service).alias("resource"),
        F.expr(f"event_id div {RECORDS_PER_BATCH}").alias("batch_id"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_records(spark, sf_dir).select(*schema.LOG_COLUMNS)


_POINT_COLUMNS = (
    "service_name string, metric_name string, kind string, timestamp_unix_nano bigint, "
    "as_double double, as_int bigint, count bigint, sum double, bucket_counts array<bigint>, "
    "explicit_bounds array<double>, "
    "quantile_values array<struct<quantile:double,value:double>>, "
    "attributes map<string,string>, batch_id bigint"
)


def _points(df: DataFrame, **columns: Column) -> DataFrame:
    picked = []
    for part in _POINT_COLUMNS.split(", "):
        name, kind = part.split(" ", 1)
        picked.append(columns.get(name, F.lit(None)).cast(kind).alias(name))
    return df.select(*picked)


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per data point of every kind, before nesting."""
    no_attributes = F.expr(A.EMPTY_MAP)
    supplier = F.concat(F.lit("supplier-"), F.col("svc").cast("string"))
    lines = table(spark, sf_dir, "lineitem").withColumn("svc", F.col("l_suppkey") % 7)

    gauge = _points(
        table(spark, sf_dir, "events"),
        service_name=F.concat(F.lit("user-svc-"), (F.col("user_id") % 5).cast("string")),
        metric_name=F.concat(F.lit("user."), "event_type"),
        kind=F.lit("gauge"),
        timestamp_unix_nano=ns("ts"),
        as_double=F.col("value"),
        attributes=_string_map(k=F.get_json_object("props", "$.k")),
        batch_id=F.expr(f"event_id div {RECORDS_PER_BATCH}"),
    )
    daily = lines.groupBy("svc", F.expr("cast(l_shipdate as date)").alias("day")).agg(
        F.count("*").alias("n")
    )
    day_number = F.expr("datediff(day, date'1970-01-01')")
    total = _points(
        daily,
        service_name=supplier,
        metric_name=F.lit("line.count"),
        kind=F.lit("sum"),
        timestamp_unix_nano=F.expr("cast(datediff(day, date'1970-01-01') as bigint)")
        * 86_400_000_000_000,
        as_int=F.col("n"),
        attributes=no_attributes,
        batch_id=day_number,
    )
    month = F.expr("trunc(cast(l_shipdate as date), 'MM')").alias("month")
    quantity = F.col("l_quantity")
    edges = [float("-inf")] + BOUNDS + [float("inf")]
    counts = [
        F.sum(F.when((quantity > low) & (quantity <= high), 1).otherwise(0)).alias(f"b{i}")
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]
    monthly = lines.groupBy("svc", month).agg(
        F.count("*").alias("n"),
        F.sum(quantity.cast("decimal(18,2)")).cast("double").alias("total"),
        *counts,
    )
    month_ns = F.expr("cast(datediff(month, date'1970-01-01') as bigint)") * 86_400_000_000_000
    month_number = F.expr("datediff(month, date'1970-01-01')")
    histogram = _points(
        monthly,
        service_name=supplier,
        metric_name=F.lit("line.quantity"),
        kind=F.lit("histogram"),
        timestamp_unix_nano=month_ns,
        count=F.col("n"),
        sum=F.col("total"),
        bucket_counts=F.array(*[F.col(f"b{i}") for i in range(len(counts))]),
        explicit_bounds=F.array(*[F.lit(b) for b in BOUNDS]),
        attributes=no_attributes,
        batch_id=month_number,
    )
    prices = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.expr("trunc(cast(o_orderdate as date), 'MM')").alias("month"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
            F.min("o_totalprice").alias("low"),
            F.max("o_totalprice").alias("high"),
        )
    )
    summary = _points(
        prices,
        service_name=F.lit("gateway"),
        metric_name=F.lit("order.price"),
        kind=F.lit("summary"),
        timestamp_unix_nano=month_ns,
        count=F.col("n"),
        sum=F.col("total"),
        quantile_values=F.array(
            F.struct(F.lit(0.0).alias("quantile"), F.col("low").alias("value")),
            F.struct(F.lit(1.0).alias("quantile"), F.col("high").alias("value")),
        ),
        attributes=_string_map(priority=F.col("o_orderpriority")),
        batch_id=month_number,
    )
    none = _points(
        spark.range(1),
        service_name=F.lit("gateway"),
        metric_name=F.lit("empty.metric"),
        kind=F.lit("unknown"),
        timestamp_unix_nano=F.lit(0),
        attributes=no_attributes,
        batch_id=F.lit(0),
    )
    return (
        gauge.unionByName(total).unionByName(histogram).unionByName(summary).unionByName(none)
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metric_points(spark, sf_dir)
    value = F.coalesce(F.col("as_double"), F.col("as_int").cast("double"), F.col("sum"))
    return points.select(
        "service_name",
        "metric_name",
        F.col("kind").alias("metric_type"),
        "timestamp_unix_nano",
        value.alias("value"),
        F.lit("1").alias("unit"),
        "attributes",
        _service_map(F.col("service_name")).alias("resource"),
        F.col("metric_name").alias("description"),
    )


# --- nested batches -------------------------------------------------------------------------
# Every batch holds a bounded number of records (a slice of one trace, a slice of one arrival
# batch), so no group can grow with the data.


def _resource(attributes: Column) -> Column:
    return F.struct(A.from_map(attributes).alias("attributes"))


def _scoped(items: str) -> Column:
    """One scope entry holding the collected items."""
    return F.array(
        F.struct(
            F.struct(F.lit("fixture").alias("name"), F.lit("1").alias("version")).alias("scope"),
            F.col(items).alias(items),
        )
    )


def _pairs(values: dict[str, Column]) -> Column:
    """An attribute list of texts under known keys: as ``from_map`` of their map."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("key"), _text_value(values[k]).alias("value"))
            for k in sorted(values)
        ]
    )


def _trace_batches(rows: DataFrame, attributes: list[str], resource: list[str]) -> DataFrame:
    """Spans are collected as few plain fields and take their nested shape afterwards."""
    plain = F.struct(
        F.unhex("trace_id").alias("trace_id"),
        F.unhex("span_id").alias("span_id"),
        F.unhex("parent_span_id").alias("parent_span_id"),
        F.col("span_name").alias("name"),
        "kind",
        "start_time_unix_nano",
        "end_time_unix_nano",
        "line_no",
        "status_code",
        "status_message",
        *[F.col("attributes")[k].alias(k) for k in attributes],
    )

    def span(s: Column) -> Column:
        start, line = s["start_time_unix_nano"], s["line_no"]
        event = F.struct(start.alias("time_unix_nano"), F.lit("step").alias("name"))
        link = F.struct(s["trace_id"].alias("trace_id"), s["span_id"].alias("span_id"))
        own = ["trace_id", "span_id", "parent_span_id", "name", "kind", "start_time_unix_nano", "end_time_unix_nano"]
        return F.struct(
            *[s[c].alias(c) for c in own],
            _pairs({k: s[k] for k in attributes}).alias("attributes"),
            F.array_repeat(event, line % 3).alias("events"),
            F.array_repeat(link, line % 2).alias("links"),
            F.struct(s["status_code"].alias("code"), s["status_message"].alias("message")).alias("status"),
        )

    keys = {k: f"_r{i}" for i, k in enumerate(resource)}
    grouped = (
        rows.select(
            "ingest_seq",
            F.expr(f"line_no div {SPANS_PER_BATCH}").alias("part"),
            *[F.col("resource")[k].alias(name) for k, name in keys.items()],
            plain.alias("span"),
        )
        .groupBy("ingest_seq", "part", *keys.values())
        .agg(F.collect_list("span").alias("spans"))
        .withColumn("spans", F.transform("spans", span))
    )
    pairs = _pairs({k: F.col(name) for k, name in keys.items()})
    return grouped.select(
        F.struct(pairs.alias("attributes")).alias("resource"), _scoped("spans").alias("scope_spans")
    )


def nested_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resource_spans`` batches: up to 16 spans of one trace and one resource each.

    Roots and children never share a resource. Children are grouped where their window has put
    them, by the key of their order, without a shuffle of whole spans.
    """
    roots = _trace_batches(root_spans(spark, sf_dir), ["priority"], ["service.name"])
    children = _trace_batches(
        child_spans(spark, sf_dir), ["flag", "part"], ["service.name", "supplier"]
    )
    return roots.unionByName(children)


def _text_value(text: Column) -> Column:
    null = F.lit(None)
    return F.struct(
        text.alias("string_value"),
        null.cast("boolean").alias("bool_value"),
        null.cast("bigint").alias("int_value"),
        null.cast("double").alias("double_value"),
        null.cast("binary").alias("bytes_value"),
        null.cast("string").alias("json_value"),
    )


def nested_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resource_logs`` batches: the records of one arrival batch and one resource."""
    record = F.struct(
        F.col("timestamp_unix_nano").alias("time_unix_nano"),
        F.col("timestamp_unix_nano").alias("observed_time_unix_nano"),
        "severity_number",
        "severity_text",
        _text_value(F.col("body")).alias("body"),
        A.from_map(F.col("attributes")).alias("attributes"),
        F.unhex("trace_id").alias("trace_id"),
        F.unhex("span_id").alias("span_id"),
    )
    return (
        log_records(spark, sf_dir)
        .select("batch_id", _resource(F.col("resource")).alias("resource"), record.alias("record"))
        .groupBy("batch_id", "resource")
        .agg(F.collect_list("record").alias("log_records"))
        .select("resource", _scoped("log_records").alias("scope_logs"))
    )


_METRIC_KINDS = {
    "gauge": "struct(array({number}) as data_points)",
    "sum": (
        "struct(array({number}) as data_points, 2 as aggregation_temporality, "
        "true as is_monotonic)"
    ),
    "histogram": (
        "struct(array(struct(attrs as attributes, timestamp_unix_nano as time_unix_nano, "
        "count, sum, bucket_counts, explicit_bounds)) as data_points)"
    ),
    "summary": (
        "struct(array(struct(attrs as attributes, timestamp_unix_nano as time_unix_nano, "
        "count, sum, quantile_values)) as data_points)"
    ),
}
_NUMBER = (
    "struct(attrs as attributes, timestamp_unix_nano as time_unix_nano, as_double, as_int)"
)


def nested_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resource_metrics`` batches: one message per point, by arrival batch and resource."""
    points = metric_points(spark, sf_dir).withColumn("attrs", A.from_map(F.col("attributes")))
    data = [
        F.expr(
            f"case when kind = '{kind}' then {body.format(number=_NUMBER)} end"
        ).alias(kind)
        for kind, body in _METRIC_KINDS.items()
    ]
    exponential = F.lit(None).cast(
        f"struct<data_points:array<{schema.EXP_HISTOGRAM_POINT}>>"
    ).alias("exponential_histogram")
    metric = F.struct(
        F.col("metric_name").alias("name"),
        F.col("metric_name").alias("description"),
        F.lit("1").alias("unit"),
        *data[:3],
        exponential,
        data[3],
    )
    return (
        points.select(
            "batch_id",
            "metric_name",
            _resource(_service_map(F.col("service_name"))).alias("resource"),
            metric.alias("metric"),
        )
        .groupBy("batch_id", "metric_name", "resource")
        .agg(F.collect_list("metric").alias("metrics"))
        .select("resource", _scoped("metrics").alias("scope_metrics"))
    )


# --- parameters -----------------------------------------------------------------------------

LOGS_NOW_NS = 1_706_659_200_000_000_000  # 2024-01-31T00:00:00Z
TRACES_NOW_NS = 1_009_756_800_000_000_000  # 2001-12-31T00:00:00Z
DAY_NS = 86_400_000_000_000


def trace_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lowest order keys that have lines, as one row; the lower key is the pair id."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    lowest = keys.orderBy("l_orderkey").limit(2)
    return lowest.agg(
        F.min("l_orderkey").alias("pair_id"),
        hex_id(F.min("l_orderkey") + 1, 32).alias("trace_a"),
        hex_id(F.max("l_orderkey") + 1, 32).alias("trace_b"),
    )


def trace_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every even order key with its successor."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == 0)
    return orders.select(
        F.col("o_orderkey").alias("pair_id"),
        hex_id(F.col("o_orderkey") + 1, 32).alias("trace_a"),
        hex_id(F.col("o_orderkey") + 2, 32).alias("trace_b"),
    )
