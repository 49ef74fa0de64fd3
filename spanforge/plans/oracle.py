"""The registered queries as SQL for a second engine, on the same parquet tables.

Every text starts from common table expressions that define the telemetry tables exactly as
:mod:`spanforge.plans.fixtures` does; maps appear as JSON text with sorted keys.
"""

from __future__ import annotations

from spanforge.functions.text import SPAN_KINDS, STATUS_CODES
from spanforge.plans import queries as Q
from spanforge.plans import sql_texts
from spanforge.sinks.export import TYPE_NAMES

DAY_NS = Q.X.DAY_NS

LINES = """
lines AS (
  SELECT l.*, o.o_orderdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS n
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"""

SPANS = """
root_spans AS (
  SELECT 'gateway' AS service_name, 'order.' || o_orderpriority AS span_name,
         lpad(lower(hex(o_orderkey + 1)), 32, '0') AS trace_id,
         lpad(lower(hex((o_orderkey + 1) * 1048576)), 16, '0') AS span_id,
         '' AS parent_span_id, 2::INTEGER AS kind,
         epoch_us(o_orderdate) * 1000 AS start_time_unix_nano,
         epoch_us(o_orderdate) * 1000 + CAST(round(o_totalprice * 1000) AS BIGINT)
           AS end_time_unix_nano,
         CAST(round(o_totalprice * 1000) AS BIGINT) AS duration_ns,
         (CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END)::INTEGER AS status_code,
         CASE o_orderstatus WHEN 'P' THEN 'returned' ELSE '' END AS status_message,
         '{"priority":"' || o_orderpriority || '"}' AS attributes,
         '{"service.name":"gateway"}' AS resource,
         o_orderkey AS ingest_seq, 0 AS line_no
  FROM orders),
child_spans AS (
  SELECT 'supplier-' || (l_suppkey % 7) AS service_name,
         'line.' || l_returnflag || l_linestatus AS span_name,
         lpad(lower(hex(l_orderkey + 1)), 32, '0') AS trace_id,
         lpad(lower(hex((l_orderkey + 1) * 1048576 + n)), 16, '0') AS span_id,
         lpad(lower(hex((l_orderkey + 1) * 1048576 + n // 2)), 16, '0') AS parent_span_id,
         3::INTEGER AS kind,
         epoch_us(o_orderdate) * 1000 + n * 1000000 AS start_time_unix_nano,
         epoch_us(o_orderdate) * 1000 + n * 1000000 + d AS end_time_unix_nano,
         d AS duration_ns,
         (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END)::INTEGER AS status_code,
         CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE '' END AS status_message,
         '{"flag":"' || l_returnflag || '","part":"' || l_partkey || '"}' AS attributes,
         '{"service.name":"supplier-' || (l_suppkey % 7) || '","supplier":"' || l_suppkey || '"}'
           AS resource,
         l_orderkey AS ingest_seq, n AS line_no
  FROM (SELECT *, CAST(l_quantity * 1000000 AS BIGINT)
                  * CASE WHEN l_partkey % 97 = 0 THEN 20 ELSE 1 END AS d FROM lines)),
spans AS (SELECT * FROM root_spans UNION ALL SELECT * FROM child_spans),
traces AS (SELECT * EXCLUDE (ingest_seq, line_no) FROM spans)"""

LOGS = """
log_records AS (
  SELECT 'user-svc-' || (user_id % 5) AS service_name,
         epoch_us(ts) * 1000 AS timestamp_unix_nano,
         (CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 9 WHEN 'signup' THEN 9
                          WHEN 'purchase' THEN 13 ELSE 17 END)::INTEGER AS severity_number,
         CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'INFO'
                         WHEN 'purchase' THEN 'WARN' WHEN 'error' THEN 'ERROR' ELSE '' END
           AS severity_text,
         event_type || ' ' || props AS body,
         CASE WHEN event_id % 10 <> 0 THEN lpad(lower(hex(event_id + 1)), 32, '0') ELSE '' END
           AS trace_id,
         CASE WHEN event_id % 10 <> 0 THEN lpad(lower(hex((event_id + 1) * 1048576)), 16, '0')
              ELSE '' END AS span_id,
         '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}'
           AS attributes,
         '{"service.name":"user-svc-' || (user_id % 5) || '"}' AS resource,
         event_id // 50 AS batch_id
  FROM events),
logs AS (SELECT * EXCLUDE (batch_id) FROM log_records)"""

METRICS = """
metric_points AS (
  SELECT 'user-svc-' || (user_id % 5) AS service_name, 'user.' || event_type AS metric_name,
         'gauge' AS kind, epoch_us(ts) * 1000 AS ts, value,
         CAST(NULL AS BIGINT) AS cnt, CAST(NULL AS DOUBLE) AS total, FALSE AS is_int,
         '{"k":"' || json_extract_string(props, '$.k') || '"}' AS attributes,
         ',k="' || json_extract_string(props, '$.k') || '"' AS labels,
         event_id // 50 AS batch_id,
         0::BIGINT AS c1, 0::BIGINT AS c2, 0::BIGINT AS c3, 0::BIGINT AS c4,
         CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high
  FROM events
  UNION ALL
  SELECT 'supplier-' || (l_suppkey % 7), 'line.count', 'sum',
         epoch_us(date_trunc('day', l_shipdate)::TIMESTAMP) * 1000, count(*)::DOUBLE,
         NULL, NULL, TRUE, '{}', '', NULL, 0, 0, 0, 0, NULL, NULL
  FROM lineitem GROUP BY l_suppkey % 7, date_trunc('day', l_shipdate)
  UNION ALL
  SELECT 'supplier-' || (l_suppkey % 7), 'line.quantity', 'histogram',
         epoch_us(date_trunc('month', l_shipdate)::TIMESTAMP) * 1000,
         sum(l_quantity::DECIMAL(18,2))::DOUBLE,
         count(*), sum(l_quantity::DECIMAL(18,2))::DOUBLE, FALSE, '{}', '', NULL,
         count(*) FILTER (WHERE l_quantity <= 10), count(*) FILTER (WHERE l_quantity <= 20),
         count(*) FILTER (WHERE l_quantity <= 30), count(*) FILTER (WHERE l_quantity <= 40),
         NULL, NULL
  FROM lineitem GROUP BY l_suppkey % 7, date_trunc('month', l_shipdate)
  UNION ALL
  SELECT 'gateway', 'order.price', 'summary',
         epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP) * 1000,
         sum(o_totalprice::DECIMAL(18,2))::DOUBLE,
         count(*), sum(o_totalprice::DECIMAL(18,2))::DOUBLE, FALSE,
         '{"priority":"' || o_orderpriority || '"}', ',priority="' || o_orderpriority || '"',
         NULL, 0, 0, 0, 0, min(o_totalprice), max(o_totalprice)
  FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)
  UNION ALL
  SELECT 'gateway', 'empty.metric', 'unknown', 0, NULL, NULL, NULL, FALSE, '{}', '', NULL,
         0, 0, 0, 0, NULL, NULL),
metrics AS (
  SELECT service_name, metric_name, kind AS metric_type, ts AS timestamp_unix_nano, value,
         '1' AS unit, attributes, '{"service.name":"' || service_name || '"}' AS resource,
         metric_name AS description
  FROM metric_points)"""


def _with(tables: str, body: str, extra: str = "", recursive: bool = False) -> str:
    parts = []
    if "T" in tables:
        parts += [LINES, SPANS]
    if "L" in tables:
        parts.append(LOGS)
    if "M" in tables:
        parts.append(METRICS)
    if extra:
        parts.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(parts) + "\n" + body


T_COLS = "service_name, span_name, trace_id, span_id, duration_ns"

GROUPS = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id
             ORDER BY CASE WHEN parent_span_id = '' THEN 0 ELSE 1 END,
                      start_time_unix_nano, span_id) AS rn FROM traces),
groups AS (
  SELECT trace_id, max(service_name) FILTER (WHERE rn = 1) AS service_name,
         max(span_name) FILTER (WHERE rn = 1) AS root_span_name,
         count(*) AS span_count,
         max(start_time_unix_nano + duration_ns) - min(start_time_unix_nano) AS duration_ns,
         max(start_time_unix_nano) FILTER (WHERE rn = 1) AS start_time_unix_nano
  FROM ranked GROUP BY trace_id)"""


def seconds_text(ns: str) -> str:
    return f"strftime(make_timestamp(({ns}) // 1000000000 * 1000000), '%Y-%m-%d %H:%M:%S')"


def rfc3339(ns: str) -> str:
    return (
        f"replace({seconds_text(ns)}, ' ', 'T') || '.' || "
        f"lpad((({ns}) // 1000000 % 1000)::VARCHAR, 3, '0') || 'Z'"
    )


SEVERITY_NAME = (
    "(CASE severity_number WHEN 5 THEN 'Debug' WHEN 9 THEN 'Info' WHEN 13 THEN 'Warn' "
    "ELSE 'Error' END)"
)
SHOWN_SEVERITY = (
    "(CASE WHEN severity_text <> '' THEN severity_text ELSE upper(" + SEVERITY_NAME + ") END)"
)
TYPE_NAME = "(CASE metric_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items()
) + " END)"

EXPORT_METRICS = f"""
exported AS (
  SELECT 'metric' AS signal, service_name AS service, metric_name, {TYPE_NAME} AS type,
         unit, description,
         count(*) FILTER (WHERE metric_type <> 'unknown') AS data_point_count
  FROM metrics GROUP BY service_name, metric_name, metric_type, unit, description)"""


def service_map(match_trace: bool = True, since: int | None = None) -> str:
    on = "p.span_id = c.parent_span_id" + (" AND p.trace_id = c.trace_id" if match_trace else "")
    when = (
        f" AND p.start_time_unix_nano >= {since} AND c.start_time_unix_nano >= {since}"
        if since is not None
        else ""
    )
    return f"""
edges AS (
  SELECT p.service_name AS caller_service, c.service_name AS callee_service,
         count(*) AS call_count,
         sum(c.duration_ns)::BIGINT::DOUBLE / count(*)::DOUBLE / 1e6 AS avg_duration_ms
  FROM traces p JOIN traces c ON {on} AND c.parent_span_id <> ''
  WHERE p.service_name <> c.service_name{when}
  GROUP BY 1, 2)"""


ONE_DIGIT = "printf('%.1f', floor(avg_duration_ms * 10 + 0.5) / 10)"


def mermaid_id(column: str) -> str:
    return f"regexp_replace({column}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g')"


MERMAID = f"""
SELECT 0::INTEGER AS section, 'graph LR' AS line
UNION ALL
SELECT 1::INTEGER, '    ' || {mermaid_id('caller_service')} || '["' || caller_service || '"] -->|' ||
       call_count || ' calls, ' || {ONE_DIGIT} || 'ms avg| ' ||
       {mermaid_id('callee_service')} || '["' || callee_service || '"]'
FROM edges"""

MAP_TEXT = f"""
SELECT 0::INTEGER AS section, 'Service Dependency Map' AS line
UNION ALL SELECT 1::INTEGER, '======================'
UNION ALL
SELECT 2::INTEGER, '  ' || caller_service || ' --(' || call_count || ' calls, avg ' || {ONE_DIGIT} ||
       'ms)--> ' || callee_service FROM edges
UNION ALL
SELECT 3::INTEGER, 'Services: ' || string_agg(s, ', ' ORDER BY s)
FROM (SELECT caller_service AS s FROM edges UNION SELECT callee_service FROM edges)"""


def nearest(percent: int) -> str:
    index = f"CAST(floor({percent / 100.0} * (n - 1)::DOUBLE + 0.5) AS BIGINT)"
    return f"max(CASE WHEN rn = {index} THEN duration_ns::DOUBLE / 1e6 END) AS p{percent}_ms"


LATENCY = f"""
SELECT service_name, span_name, count(*) AS samples,
       min(duration_ns)::DOUBLE / 1e6 AS min_ms, max(duration_ns)::DOUBLE / 1e6 AS max_ms,
       sum(duration_ns)::BIGINT::DOUBLE / count(*)::DOUBLE / 1e6 AS mean_ms,
       {nearest(50)}, {nearest(95)}, {nearest(99)}
FROM (SELECT *, row_number() OVER (PARTITION BY service_name, span_name
                                   ORDER BY duration_ns) - 1 AS rn,
             count(*) OVER (PARTITION BY service_name, span_name) AS n FROM traces)
GROUP BY service_name, span_name"""

HISTOGRAM = """
SELECT g.span_name, g.bucket::INTEGER AS bucket,
       lo + g.bucket::DOUBLE * w AS low_ms, lo + g.bucket::DOUBLE * w + w AS high_ms,
       count(t.span_name) AS count
FROM (SELECT b.*, unnest(range(0, CASE WHEN w = 0 THEN 1 ELSE 20 END)) AS bucket FROM bounds b) g
LEFT JOIN (
  SELECT x.span_name, CASE WHEN w = 0 THEN 0 ELSE
         least(CAST(floor((duration_ns::DOUBLE / 1e6 - lo) / w) AS INTEGER), 19) END AS bucket
  FROM traces x JOIN bounds b ON x.span_name = b.span_name) t
  ON t.span_name = g.span_name AND t.bucket = g.bucket
GROUP BY g.span_name, g.bucket, lo, w"""

BOUNDS = """
bounds AS (
  SELECT span_name, min(duration_ns)::DOUBLE / 1e6 AS lo,
         (max(duration_ns)::DOUBLE / 1e6 - min(duration_ns)::DOUBLE / 1e6) / 20.0::DOUBLE AS w
  FROM traces GROUP BY span_name)"""

OUTLIERS = """
limits AS (
  SELECT service_name, span_name, avg(duration_ns::DOUBLE) + 2.0 * stddev_pop(duration_ns::DOUBLE)
           AS cutoff
  FROM traces GROUP BY service_name, span_name
  HAVING count(*) >= 2 AND min(duration_ns) < max(duration_ns)),
flagged AS (
  SELECT t.*, coalesce(t.duration_ns > l.cutoff, FALSE) AS slow
  FROM traces t LEFT JOIN limits l
    ON t.service_name = l.service_name AND t.span_name = l.span_name)"""

ONE_PAIR = """
low AS (SELECT DISTINCT l_orderkey AS k FROM lineitem ORDER BY k LIMIT 2),
pairs AS (
  SELECT min(k) AS pair_id, lpad(lower(hex(min(k) + 1)), 32, '0') AS trace_a,
         lpad(lower(hex(max(k) + 1)), 32, '0') AS trace_b FROM low)"""

ALL_PAIRS = """
pairs AS (
  SELECT o_orderkey AS pair_id, lpad(lower(hex(o_orderkey + 1)), 32, '0') AS trace_a,
         lpad(lower(hex(o_orderkey + 2)), 32, '0') AS trace_b
  FROM orders WHERE o_orderkey % 2 = 0)"""

DIFF = f"""
SELECT pair_id, service_name, span_name, position,
       CASE WHEN db IS NULL THEN 'removed' WHEN da IS NULL THEN 'added' ELSE 'matched' END AS status,
       ia AS span_id_a, ib AS span_id_b, sa AS start_a, sb AS start_b,
       da AS duration_ns_a, db AS duration_ns_b, db - da AS delta_ns, pct AS pct_change,
       abs(pct) > {Q.THRESHOLD_PCT} AS exceeds_threshold
FROM (
  SELECT *, CASE WHEN da IS NULL OR db IS NULL THEN NULL
                 WHEN da = 0 THEN CASE WHEN db = 0 THEN 0.0 ELSE 100.0 END
                 ELSE (db - da)::DOUBLE / da::DOUBLE * 100.0 END AS pct
  FROM a FULL OUTER JOIN b USING (pair_id, service_name, span_name, position))"""


def _diff_side(side: str) -> str:
    return f"""
{side} AS (
  SELECT p.pair_id, t.service_name, t.span_name,
         row_number() OVER (PARTITION BY p.pair_id, t.service_name, t.span_name
                            ORDER BY t.start_time_unix_nano, t.span_id) - 1 AS position,
         t.span_id AS i{side}, t.start_time_unix_nano AS s{side}, t.duration_ns AS d{side}
  FROM pairs p JOIN traces t ON t.trace_id = p.trace_{side})"""


DIFF_SIDES = _diff_side("a") + "," + _diff_side("b")

DIFF_SUMMARY = f"""
SELECT pair_id, trace_a, trace_b, ta AS total_ns_a, tb AS total_ns_b, tb - ta AS delta_ns,
       pct AS pct_change, na = 0 AS missing_a, nb = 0 AS missing_b,
       abs(pct) > {Q.THRESHOLD_PCT} AS exceeds_threshold
FROM (SELECT *, CASE WHEN ta = 0 THEN 0.0 ELSE (tb - ta)::DOUBLE / ta::DOUBLE * 100.0 END AS pct
  FROM (
    SELECT p.pair_id, p.trace_a, p.trace_b,
           coalesce(a.d, 0) AS ta, coalesce(b.d, 0) AS tb,
           coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb
    FROM pairs p
    LEFT JOIN totals a ON a.trace_id = p.trace_a
    LEFT JOIN totals b ON b.trace_id = p.trace_b))"""

TOTALS = """
totals AS (
  SELECT trace_id, max(start_time_unix_nano + duration_ns) - min(start_time_unix_nano) AS d,
         count(*) AS n
  FROM traces GROUP BY trace_id)"""

ROLLUP = """
rolled AS (
  SELECT metric_name, service_name, max(metric_type) AS metric_type, '1' AS unit,
         metric_name AS description,
         count(*) FILTER (WHERE metric_type <> 'unknown') AS point_count,
         max(timestamp_unix_nano) FILTER (WHERE metric_type <> 'unknown') AS newest_unix_nano,
         max(value) FILTER (WHERE rn = 1 AND metric_type <> 'unknown') AS newest_value,
         sum(value) AS total, max(metric_type) = 'sum' AS all_int
  FROM (SELECT *, row_number() OVER (PARTITION BY metric_name, service_name
                    ORDER BY timestamp_unix_nano DESC, value DESC) AS rn FROM metrics)
  GROUP BY metric_name, service_name)"""

SERIES = f"""
SELECT metric_name, service_name, timestamp_unix_nano, value, n AS points, position,
       (value - lo) / greatest(hi - lo, 0.001) AS normalized
FROM (
  SELECT s.*, p.position FROM (
    SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER k AS n,
           min(value) OVER k AS lo, max(value) OVER k AS hi
    FROM metrics WHERE metric_type IN ('gauge', 'sum') AND value IS NOT NULL
    WINDOW k AS (PARTITION BY metric_name, service_name),
           w AS (PARTITION BY metric_name, service_name ORDER BY timestamp_unix_nano, value)) s
  JOIN (SELECT unnest(range(0, {Q.SERIES_WIDTH})) AS position) p
    ON s.rn = CASE WHEN s.n <= {Q.SERIES_WIDTH} THEN p.position
                   ELSE p.position * (s.n - 1) // {Q.SERIES_WIDTH - 1} END
  WHERE s.n >= 5)"""

PARENT_CHILD = """
SELECT parent, child, d::DOUBLE / 1e6 AS child_ms FROM (
  SELECT p.span_name AS parent, c.span_name AS child, c.duration_ns AS d
  FROM traces p JOIN traces c ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
  WHERE c.parent_span_id <> ''
  ORDER BY d DESC, parent, child LIMIT 20)"""

POSITION = "(('0x' || substr(md5(trace_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
ALWAYS = ", ".join(f"'{s}'" for s in Q.ALWAYS)
IN_SAMPLE = f"({POSITION} < {Q.SAMPLE_RATE} OR service_name IN ({ALWAYS}))"

ARRIVALS = f"""
arrivals AS (
  SELECT trace_id, first, first >= newest - newest // {Q.NEW_PART} OR first % {Q.PIN_EVERY} = 0 AS safe
  FROM (SELECT trace_id, min(ingest_seq) AS first FROM spans GROUP BY trace_id),
       (SELECT max(ingest_seq) AS newest FROM root_spans)),
others AS (SELECT *, row_number() OVER (ORDER BY first DESC, trace_id) AS rn
           FROM arrivals WHERE NOT safe),
kept AS (
  SELECT trace_id FROM arrivals WHERE safe
  UNION ALL
  SELECT trace_id FROM others
  WHERE rn <= (SELECT count(*) // {Q.KEEP_PART} FROM root_spans) -
              (SELECT count(*) FROM arrivals WHERE safe))"""


def newest_batches(table: str) -> str:
    return f"""
kept AS (SELECT DISTINCT batch_id FROM {table}
         ORDER BY batch_id DESC LIMIT {Q.KEEP_BATCHES})"""


TREE = """
tree AS (
  SELECT trace_id, span_id, parent_span_id, 0 AS depth,
         lpad(start_time_unix_nano::VARCHAR, 19, '0') || ':' || span_id AS path
  FROM traces WHERE parent_span_id = ''
  UNION ALL
  SELECT c.trace_id, c.span_id, c.parent_span_id, t.depth + 1,
         t.path || '/' || lpad(c.start_time_unix_nano::VARCHAR, 19, '0') || ':' || c.span_id
  FROM tree t JOIN traces c ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id)"""

LAYOUT = """
SELECT trace_id, span_id,
       (start_time_unix_nano - lo)::DOUBLE / r * 100 AS left_pct,
       greatest(0.5::DOUBLE, duration_ns::DOUBLE / r * 100) AS width_pct
FROM (SELECT t.*, b.lo, (CASE WHEN b.hi = b.lo THEN 1 ELSE b.hi - b.lo END)::DOUBLE AS r
      FROM traces t JOIN (SELECT trace_id, min(start_time_unix_nano) AS lo,
                                 max(start_time_unix_nano + duration_ns) AS hi
                          FROM traces GROUP BY trace_id) b ON t.trace_id = b.trace_id)"""


def number_text(x: str) -> str:
    return (
        f"(CASE WHEN {x} = trunc({x}) THEN CAST({x} AS BIGINT)::VARCHAR ELSE {x}::VARCHAR END)"
    )


def _name(x: str) -> str:
    return f"regexp_replace({x}, '[^A-Za-z0-9_:]', '_', 'g')"


def _sample(kind: str, suffix: str, extra: str, value: str, text: str, position: str) -> str:
    label = f"""'{{service_name="' || service_name || '"' || labels || '{extra}}}'"""
    return f"""
  SELECT {_name('metric_name')} AS metric, {_name('metric_name')} || '{suffix}' AS sample_name,
         {label} AS labels, ({value})::DOUBLE AS value, {text} AS value_text,
         ts AS timestamp_unix_nano, {position}::INTEGER AS position
  FROM metric_points WHERE kind = '{kind}'"""


SAMPLES = "samples AS (" + " UNION ALL ".join(
    [
        _sample("gauge", "", "", "value", number_text("value"), "0"),
        _sample("sum", "", "", "value", number_text("value"), "0"),
        *[
            _sample("histogram", "_bucket", f',le="{i}0"', f"c{i}", f"c{i}::VARCHAR", str(i - 1))
            for i in (1, 2, 3, 4)
        ],
        _sample("histogram", "_bucket", ',le="+Inf"', "cnt", "cnt::VARCHAR", "4"),
        _sample("histogram", "_sum", "", "total", number_text("total"), "5"),
        _sample("histogram", "_count", "", "cnt", "cnt::VARCHAR", "6"),
        _sample("summary", "", ',quantile="0"', "low", number_text("low"), "0"),
        _sample("summary", "", ',quantile="1"', "high", number_text("high"), "1"),
        _sample("summary", "_sum", "", "total", number_text("total"), "3"),
        _sample("summary", "_count", "", "cnt", "cnt::VARCHAR", "4"),
    ]
) + ")"

GAUGE_VALUES = {
    "traces_total": "(SELECT count(DISTINCT trace_id) FROM traces)",
    "spans_total": "(SELECT count(*) FROM traces)",
    "logs_total": "(SELECT count(*) FROM logs)",
    "metrics_total": "(SELECT count(*) FROM metrics WHERE metric_type <> 'unknown')",
}

STORE_LINES = ""
for _i, (_suffix, _text) in enumerate(Q.prometheus.STORE_GAUGES.items()):
    _gauge = f"store_{_suffix}"
    for _section, _line in enumerate(
        (
            f"'# HELP {_gauge} {_text}'",
            f"'# TYPE {_gauge} gauge'",
            f"'{_gauge} ' || {GAUGE_VALUES[_suffix]}",
        )
    ):
        STORE_LINES += f"""
UNION ALL SELECT {1 + _i}::INTEGER, {_section}::INTEGER, '{_gauge}', {_line}"""

EXPOSED_TYPE = (
    "(CASE max(metric_type) WHEN 'sum' THEN 'counter' WHEN 'unknown' THEN 'untyped' "
    "ELSE max(metric_type) END)"
)
EXPOSITION = f"""
SELECT 0::INTEGER AS block, 0::INTEGER AS section, {_name('metric_name')} AS metric,
       '# HELP ' || {_name('metric_name')} || ' ' || metric_name AS line
FROM metrics GROUP BY metric_name
UNION ALL
SELECT 0::INTEGER, 1::INTEGER, {_name('metric_name')},
       '# TYPE ' || {_name('metric_name')} || ' ' || {EXPOSED_TYPE}
FROM metrics GROUP BY metric_name
UNION ALL
SELECT 0::INTEGER, 2::INTEGER, metric, sample_name || labels || ' ' || value_text FROM samples
{STORE_LINES}"""

WINDOW_COUNTS = f"""
SELECT DISTINCT "at", errors_in_window FROM (
  SELECT start_time_unix_nano AS "at",
         count(*) OVER (ORDER BY start_time_unix_nano
                        RANGE BETWEEN {Q.HOUR_NS} PRECEDING AND CURRENT ROW) AS errors_in_window
  FROM traces WHERE status_code = 2)
WHERE errors_in_window > {Q.MAX_ERRORS}"""

SLIDING_WINDOWS = f"""
SELECT window_start_ns, window_start_ns + {Q.HOUR_NS} AS window_end_ns, count(*) AS errors
FROM (SELECT unnest([slide, slide - {Q.HOUR_NS // 2}]) AS window_start_ns
      FROM (SELECT start_time_unix_nano // {Q.HOUR_NS // 2} * {Q.HOUR_NS // 2} AS slide
            FROM traces WHERE status_code = 2))
GROUP BY window_start_ns HAVING count(*) > {Q.MAX_ERRORS}"""

DISPLAY = """
SELECT span_id, unnest(['name', 'kind', 'eighth', 'failed', 'id', 'list', 'map', 'unset']) AS key,
       unnest([span_name, kind::VARCHAR, printf('%.6f', kind::DOUBLE / 8),
               (status_code = 2)::VARCHAR, span_id, '[' || span_name || ', ' || kind || ']',
               '{name=' || span_name || ', each=[' || inner_text || ', ' || inner_text || ']}',
               '']) AS shown
FROM (SELECT *, '{eighth=' || printf('%.6f', kind::DOUBLE / 8) || ', failed=' ||
             (status_code = 2)::VARCHAR || '}' AS inner_text FROM traces)"""

RULE_HITS = f"""
hits AS (
  SELECT 'span_duration > 400ms' AS rule, 'span_duration' AS kind, start_time_unix_nano AS "at"
  FROM traces WHERE duration_ns > 400000000
  UNION ALL
  SELECT DISTINCT 'error_rate > 5/1h', 'error_rate', "at" FROM (
    SELECT start_time_unix_nano AS "at", count(*) OVER (ORDER BY start_time_unix_nano
             RANGE BETWEEN {Q.HOUR_NS} PRECEDING AND CURRENT ROW) AS n
    FROM traces WHERE status_code = 2) WHERE n > 5
  UNION ALL
  SELECT 'log_body contains ''purchase''', 'log_body', timestamp_unix_nano
  FROM logs WHERE contains(body, 'purchase')
  UNION ALL
  SELECT 'log_severity >= ERROR', 'log_severity', timestamp_unix_nano
  FROM logs WHERE severity_number >= 17
  UNION ALL
  SELECT 'metric user.error >= 100', 'metric', timestamp_unix_nano
  FROM metrics WHERE metric_name = 'user.error' AND value >= 100
  UNION ALL
  SELECT 'metric line.count = 6', 'metric', timestamp_unix_nano
  FROM metrics WHERE metric_name = 'line.count' AND value = 6)"""

def three_digits(ns: str) -> str:
    return f"printf('%.3f', floor(({ns})::DOUBLE / 1e9 * 1000 + 0.5) / 1000)"


_CUT = "CASE WHEN strlen(body) > 100 THEN substr(body, 1, 100) || '...' ELSE body END"
MESSAGE_HITS = f"""
worded AS (
  SELECT 'span_duration > 400ms' AS rule, 'span_duration' AS kind, start_time_unix_nano AS "at",
         'span ''' || span_name || ''' duration ' || {three_digits('duration_ns')} ||
         's exceeds threshold 0.400s' AS message
  FROM traces WHERE duration_ns > 400000000
  UNION ALL
  SELECT 'error_rate > 5/1h', 'error_rate', "at",
         'error rate ' || n || ' exceeds threshold 5 in 3600s window' FROM (
    SELECT start_time_unix_nano AS "at", count(*) OVER (ORDER BY start_time_unix_nano
             RANGE BETWEEN {Q.HOUR_NS} PRECEDING AND CURRENT ROW) AS n
    FROM traces WHERE status_code = 2) WHERE n > 5
  UNION ALL
  SELECT 'log_body contains ''purchase''', 'log_body', timestamp_unix_nano,
         'log body contains ''purchase'': ' || {_CUT}
  FROM logs WHERE contains(body, 'purchase')
  UNION ALL
  SELECT 'log_severity >= ERROR', 'log_severity', timestamp_unix_nano,
         'log severity ' || severity_number || ' >= 17: ' || {_CUT}
  FROM logs WHERE severity_number >= 17
  UNION ALL
  SELECT 'metric user.error >= 100', 'metric', timestamp_unix_nano,
         'metric ''user.error'' value ' || {number_text('value')} ||
         ' triggered (threshold 100)'
  FROM metrics WHERE metric_name = 'user.error' AND value >= 100
  UNION ALL
  SELECT 'metric line.count = 6', 'metric', timestamp_unix_nano,
         'metric ''line.count'' value 6 triggered (threshold 6)'
  FROM metrics WHERE metric_name = 'line.count' AND value = 6),
hits AS (SELECT DISTINCT rule, kind, "at" FROM worded)"""

SEVERITY_HITS = """
hits AS (SELECT DISTINCT 'severity ' || severity_number AS rule, timestamp_unix_nano AS "at"
         FROM logs)"""


def fires(cooldown_ns: int, columns: str = "rule") -> str:
    return f"""
following AS (
  SELECT {columns}, "at", min("at") OVER (PARTITION BY rule ORDER BY "at"
           RANGE BETWEEN {cooldown_ns} FOLLOWING AND UNBOUNDED FOLLOWING) AS next
  FROM (SELECT DISTINCT {columns}, "at" FROM hits)),
fired AS (
  SELECT {columns}, min("at") AS "at" FROM hits GROUP BY {columns}
  UNION ALL
  SELECT f.rule{', f.kind' if 'kind' in columns else ''}, n.next
  FROM fired f JOIN following n ON n.rule = f.rule AND n."at" = f."at"
  WHERE n.next IS NOT NULL)"""


def _names(column: str, names: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"(CASE {column} {cases} ELSE 'UNKNOWN(' || ({column}) || ')' END)"


_BANDS = "(CASE WHEN kind * 5 BETWEEN 9 AND 12 THEN 'Info' WHEN kind * 5 BETWEEN 13 AND 16 " \
         "THEN 'Warn' ELSE 'Unspecified' END)"
_ENUM = (
    f"{_BANDS} || (CASE WHEN kind * 5 > 0 AND (kind * 5 - 1) % 4 > 0 "
    "THEN ((kind * 5 - 1) % 4 + 1)::VARCHAR ELSE '' END)"
)
_NS = "start_time_unix_nano"
SCALARS = f"""
SELECT span_id,
  {rfc3339(_NS)} AS ts_text,
  substr({seconds_text(_NS)}, 12, 8) || '.' || lpad(({_NS} // 1000000 % 1000)::VARCHAR, 3, '0')
    AS time_of_day,
  {seconds_text(_NS)} || '.' || lpad(({_NS} // 1000 % 1000000)::VARCHAR, 6, '0') || ' UTC'
    AS full_time,
  CASE WHEN duration_ns < 1000 THEN duration_ns::DOUBLE
       WHEN duration_ns < 1000000 THEN duration_ns::DOUBLE / 1e3
       WHEN duration_ns < 1000000000 THEN duration_ns::DOUBLE / 1e6
       ELSE duration_ns::DOUBLE / 1e9 END AS duration_number,
  CASE WHEN duration_ns < 1000 THEN 'ns' WHEN duration_ns < 1000000 THEN 'us'
       WHEN duration_ns < 1000000000 THEN 'ms' ELSE 's' END AS duration_unit,
  CASE WHEN status_message <> '' THEN status_message ELSE upper({_BANDS}) END AS severity,
  {_ENUM} AS severity_enum,
  0::INTEGER AS severity_guess,
  {_names('kind', SPAN_KINDS)} AS kind_name,
  {_names('(status_code + 1)', STATUS_CODES)} AS status_text,
  CASE WHEN p >= 1e9 THEN p / 1e9 WHEN p >= 1e6 THEN p / 1e6 WHEN p >= 1e3 THEN p / 1e3
       ELSE p END AS compact_number,
  CASE WHEN p >= 1e9 THEN 'G' WHEN p >= 1e6 THEN 'M' WHEN p >= 1e3 THEN 'K' ELSE '' END
    AS compact_suffix,
  {_name('span_name')} AS clean_name,
  substr(trace_id, 1, 8) AS short_id
FROM (SELECT *, duration_ns::DOUBLE / 7.0::DOUBLE AS p FROM traces)"""

FILES = f"""
SELECT DISTINCT '/landing/spans-' || service_name || '-' || (start_time_unix_nano // {DAY_NS})
         || '.jsonl' AS path, 'traces' AS signal, 'jsonl' AS format FROM traces
UNION ALL
SELECT DISTINCT '/landing/app-log-' || service_name || '-' || (timestamp_unix_nano // {DAY_NS})
         || '.ndjson', 'logs', 'jsonl' FROM logs
UNION ALL
SELECT DISTINCT '/landing/metrics-' || service_name || '-' || (timestamp_unix_nano // {DAY_NS})
         || '.pb', 'metrics', 'protobuf' FROM metrics"""

ONE_SERVICE = "'{\"service.name\":\"' || service_name || '\"}'"


def _queries() -> dict[str, str]:
    since_t, until_t, since_l = Q.SINCE_TRACES, Q.UNTIL_TRACES, Q.SINCE_LOGS
    level = "severity_number"
    found: dict[str, str] = {}
    add = found.__setitem__

    add("flatten_traces", _with("T", """
SELECT * EXCLUDE (attributes, resource, ingest_seq, line_no), attributes AS attributes_json,
       resource AS resource_json, (line_no % 3)::INTEGER AS events_count,
       (line_no % 2)::INTEGER AS links_count
FROM spans"""))
    add("flatten_logs", _with("L", """
SELECT * EXCLUDE (attributes, resource), attributes AS attributes_json,
       resource AS resource_json, timestamp_unix_nano AS observed_time_unix_nano,
       'fixture' AS scope_name
FROM logs"""))
    add("flatten_metrics", _with("M", f"""
SELECT service_name, metric_name, kind AS metric_type, ts AS timestamp_unix_nano, value,
       '1' AS unit, metric_name AS description, attributes AS attributes_json,
       {ONE_SERVICE} AS resource_json, cnt AS point_count, total AS point_sum, is_int,
       value IS NOT NULL AS has_value
FROM metric_points"""))
    length = "CAST(floor(duration_ns::DOUBLE / 1e6 * 1000000.0::DOUBLE) AS BIGINT)"
    add("import_traces", _with("T", f"""
SELECT * EXCLUDE (attributes, resource, duration_ns, end_time_unix_nano),
       {length} AS duration_ns, start_time_unix_nano + {length} AS end_time_unix_nano,
       '{{}}' AS attributes, {ONE_SERVICE} AS resource
FROM traces"""))
    add("import_logs", _with("L", f"""
SELECT service_name, timestamp_unix_nano // 1000000 * 1000000 AS timestamp_unix_nano,
       severity_number, {SEVERITY_NAME} AS severity_text, body, '' AS trace_id, '' AS span_id,
       '{{}}' AS attributes, {ONE_SERVICE} AS resource
FROM logs"""))
    add("import_metrics", _with("M", """
SELECT service AS service_name, metric_name, lower(type) AS metric_type,
       0::BIGINT AS timestamp_unix_nano, CAST(NULL AS DOUBLE) AS value, unit,
       '{}' AS attributes, '{"service.name":"' || service || '"}' AS resource, description
FROM exported""", EXPORT_METRICS))
    add("detect_signal", _with("TLM", FILES))
    add("multi_source", _with("T", f"""
SELECT {T_COLS}, 'edge:4317' AS source FROM root_spans
UNION ALL SELECT {T_COLS}, 'backend:4317' FROM child_spans"""))

    add("export_traces", _with("T", f"""
SELECT 'trace' AS signal, {rfc3339('start_time_unix_nano')} AS time, service_name AS service,
       span_name, duration_ns::DOUBLE / 1e6 AS duration_ms, trace_id, span_id, parent_span_id,
       kind, status_code, status_message FROM traces"""))
    add("export_csv", _with("T", f"""
SELECT 'trace' AS signal, {rfc3339('start_time_unix_nano')} AS time, service_name AS service,
       span_name,
       printf('%.3f', floor(duration_ns::DOUBLE / 1e6 * 1000 + 0.5) / 1000) AS duration_ms,
       trace_id, span_id, parent_span_id, kind, status_code FROM traces"""))
    add("export_logs", _with("L", f"""
SELECT 'log' AS signal, {rfc3339('timestamp_unix_nano')} AS time, service_name AS service,
       {SEVERITY_NAME} AS severity, body FROM logs"""))
    add("export_metrics", _with("M", "SELECT * FROM exported", EXPORT_METRICS))
    add("export_text", _with("TLM", f"""
SELECT {rfc3339('start_time_unix_nano')} || ' ' || service_name || ' ' || span_name || ' ' ||
       printf('%.3f', floor(duration_ns::DOUBLE / 1e6 * 1000 + 0.5) / 1000) || 'ms trace_id=' || trace_id AS value
FROM traces
UNION ALL
SELECT {rfc3339('timestamp_unix_nano')} || ' ' || service_name || ' [' || {SEVERITY_NAME} ||
       '] ' || body FROM logs
UNION ALL
SELECT service || ' ' || metric_name || ' (' || unit || ') [' || type || '] ' || description
FROM exported""", EXPORT_METRICS))
    add("export_all", _with("TLM", f"""
SELECT 0::INTEGER AS part, 'trace' AS signal, {rfc3339('start_time_unix_nano')} AS time,
       service_name AS service, span_name, NULL AS body, NULL AS metric_name FROM traces
UNION ALL
SELECT 1::INTEGER, 'log', {rfc3339('timestamp_unix_nano')}, service_name, NULL, body, NULL FROM logs
UNION ALL
SELECT 2::INTEGER, 'metric', NULL, service, NULL, NULL, metric_name FROM exported""", EXPORT_METRICS))
    add("replay_counts", _with("TLM", f"""
SELECT 'traces' AS signal, count(*) AS records, CAST(NULL AS BIGINT) AS batches
FROM traces WHERE start_time_unix_nano >= {since_t}
UNION ALL
SELECT 'logs', count(*), count(DISTINCT batch_id)
FROM log_records WHERE timestamp_unix_nano >= {since_t}
UNION ALL
SELECT 'metrics', count(*), NULL FROM metrics WHERE timestamp_unix_nano >= {since_t}"""))
    add("prometheus_samples", _with("M", "SELECT * FROM samples", SAMPLES))
    add("prometheus_text", _with("TLM", EXPOSITION, SAMPLES))

    add("find_spans", _with("T", f"""
SELECT * FROM traces WHERE service_name = 'supplier-3'
  AND start_time_unix_nano BETWEEN {since_t} AND {until_t}
  AND json_extract_string(attributes, '$.flag') = 'R'"""))
    add("find_spans_newest", _with("T", f"""
SELECT {T_COLS}, start_time_unix_nano FROM traces WHERE span_name = 'line.AF'
ORDER BY start_time_unix_nano DESC, trace_id, span_id LIMIT {Q.LIMIT}"""))
    add("find_logs", _with("L", f"""
SELECT * FROM logs WHERE service_name = 'user-svc-1' AND {level} BETWEEN 9 AND 12
  AND contains(body, 'signup') AND timestamp_unix_nano >= {since_l}"""))
    add("find_logs_by_severity", _with("L", f"""
SELECT 'name_contains' AS mode, service_name, timestamp_unix_nano, body FROM logs
WHERE {level} = 9
UNION ALL SELECT 'text_contains', service_name, timestamp_unix_nano, body FROM logs
WHERE contains(severity_text, 'WAR')
UNION ALL SELECT 'equals', service_name, timestamp_unix_nano, body FROM logs
WHERE {SHOWN_SEVERITY} = 'INFO'"""))
    add("find_metrics", _with("M", f"""
SELECT * FROM metrics WHERE service_name = 'user-svc-2' AND metric_name = 'user.view'
  AND timestamp_unix_nano >= {since_l}"""))
    add("find_metrics_by_resource", _with("M", """
SELECT metric_name, metric_type, timestamp_unix_nano, value FROM metrics
WHERE json_extract_string(resource, '$."service.name"') = 'supplier-4'"""))
    add("search_traces", _with("T", """
SELECT * FROM groups WHERE contains(lower(service_name), 'urgent')
  OR contains(lower(root_span_name), 'urgent') OR contains(lower(trace_id), 'urgent')""", GROUPS))
    add("search_logs", _with("L", f"""
SELECT service_name, timestamp_unix_nano, severity_text, body FROM logs
WHERE contains(lower(body), 'warn') OR contains(lower(service_name), 'warn')
   OR contains(lower({SHOWN_SEVERITY}), 'warn')"""))
    add("search_metrics", _with("M", """
SELECT service_name, metric_name, timestamp_unix_nano, value FROM metrics
WHERE contains(lower(metric_name), 'line.') OR contains(lower(service_name), 'line.')"""))
    add("logs_with_trace", _with("TL", """
SELECT l.* EXCLUDE (attributes, resource), g.service_name AS root_service, g.root_span_name,
       g.span_count, g.duration_ns AS trace_duration_ns, g.start_time_unix_nano
FROM logs l LEFT JOIN groups g ON l.trace_id = g.trace_id AND l.trace_id <> ''""", GROUPS))
    add("logs_in_spans", _with("TL", """
SELECT l.trace_id, l.timestamp_unix_nano, l.severity_number, l.body, l.service_name AS log_service,
       t.span_id AS inside_span_id, t.span_name,
       l.timestamp_unix_nano - t.start_time_unix_nano AS since_start_ns
FROM (SELECT logs.* REPLACE (start_time_unix_nano
             + timestamp_unix_nano % (2 * duration_ns + 1) AS timestamp_unix_nano)
      FROM logs JOIN traces ON logs.trace_id = traces.trace_id AND parent_span_id = ''
      WHERE logs.trace_id <> '') l
JOIN traces t
  ON l.trace_id = t.trace_id
 AND l.timestamp_unix_nano BETWEEN t.start_time_unix_nano AND t.end_time_unix_nano"""))
    add("follow_traces", _with("T", """
SELECT * FROM traces WHERE service_name = 'supplier-5' AND span_name = 'line.RF'"""))
    add("follow_logs", _with("L", """
SELECT * FROM logs WHERE severity_number BETWEEN 17 AND 20 AND contains(body, 'error')"""))
    add("follow_metrics", _with("M", """
SELECT * FROM metrics WHERE service_name = 'supplier-2' AND metric_name = 'line.count'"""))
    add("metric_catalog", _with("M", """
SELECT DISTINCT metric_name, service_name, description, unit, metric_type FROM metrics"""))

    add("trace_groups", _with("T", "SELECT * FROM groups", GROUPS))
    add("span_tree", _with("T", """
SELECT a.trace_id, a.span_id, any_value(a.parent_span_id) AS parent_span_id,
       any_value(a.depth) AS depth, any_value(a.position) AS position,
       count(*) AS subtree_size, FALSE AS orphan
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position
      FROM tree) a
JOIN tree d ON d.trace_id = a.trace_id AND (d.path = a.path OR starts_with(d.path, a.path || '/'))
GROUP BY a.trace_id, a.span_id""", TREE, recursive=True))
    add("waterfall_layout", _with("T", LAYOUT))
    add("display_rows", _with("T", f"""
SELECT substr({seconds_text(_NS)}, 12, 8) || '.' || lpad(({_NS} // 1000000 % 1000)::VARCHAR, 3, '0')
         AS time, service_name AS service, span_name, {_names('kind', SPAN_KINDS)} AS kind,
       {_names('status_code', STATUS_CODES)} AS status, trace_id, span_id,
       (line_no % 3)::INTEGER AS events_count, (line_no % 2)::INTEGER AS links_count
FROM spans"""))
    add("service_map", _with("T", "SELECT * FROM edges", service_map()))
    add("service_map_since", _with("T", "SELECT * FROM edges", service_map(since=since_t)))
    add("service_map_by_span_id", _with("T", "SELECT * FROM edges", service_map(False)))
    add("service_map_mermaid", _with("T", MERMAID, service_map()))
    add("service_map_text", _with("T", MAP_TEXT, service_map()))
    add("latency_stats", _with("T", LATENCY))
    add("latency_histogram", _with("T", HISTOGRAM, BOUNDS))
    add("latency_rows", _with("T", """
SELECT span_name, duration_ns::DOUBLE / 1e6 AS duration_ms FROM traces
WHERE service_name = 'supplier-1'"""))
    add("outlier_spans", _with("T", f"SELECT {T_COLS} FROM flagged WHERE slow", OUTLIERS))
    add("outlier_traces", _with("T", """
SELECT trace_id, count(*) AS outlier_spans FROM flagged WHERE slow GROUP BY trace_id""", OUTLIERS))
    add("tagged_spans", _with("T", f"""
SELECT {T_COLS}, CASE WHEN slow THEN '[SLOW]' ELSE '' END AS tag FROM flagged""", OUTLIERS))
    add("trace_diff", _with("T", DIFF, ONE_PAIR + "," + DIFF_SIDES))
    add("trace_diff_pairs", _with("T", DIFF, ALL_PAIRS + "," + DIFF_SIDES))
    add("trace_diff_summary", _with("T", DIFF_SUMMARY, ONE_PAIR + "," + TOTALS))
    add("trace_diff_pairs_summary", _with("T", DIFF_SUMMARY, ALL_PAIRS + "," + TOTALS))
    add("metric_rollup", _with("M", """
SELECT * REPLACE (round(total, 3) AS total) FROM rolled""", ROLLUP))
    add("metric_display", _with("M", """
SELECT metric_name, service_name, point_count = 0 AS is_empty,
       round(CASE WHEN point_count > 1 AND metric_type IN ('gauge', 'sum') THEN total
                  ELSE newest_value END, 3) AS display_number FROM rolled""", ROLLUP))
    add("metric_series", _with("M", SERIES))
    add("status", _with("TLM", """
SELECT (SELECT count(DISTINCT trace_id) FROM traces) AS traces,
       (SELECT count(*) FROM traces) AS spans, (SELECT count(*) FROM logs) AS logs,
       (SELECT count(*) FROM metrics) AS metrics,
       (SELECT count(*) FROM metrics WHERE metric_type <> 'unknown') AS data_points,
       1.0::DOUBLE AS sample_rate, 0::BIGINT AS spans_dropped"""))
    add("slowest_spans", _with("T", """
SELECT service_name, span_name, trace_id, span_id, duration_ns::DOUBLE / 1e6 AS ms FROM traces
ORDER BY duration_ns DESC, trace_id, span_id LIMIT 20"""))
    add("error_rate_by_service", _with("T", """
SELECT service_name, count(*) AS total, count(*) FILTER (WHERE status_code = 2) AS errors
FROM traces GROUP BY service_name"""))
    add("log_volume", _with("L", """
SELECT severity_text, count(*) AS n FROM logs GROUP BY severity_text"""))
    stats = """count(*) AS n,
       sum(duration_ns)::BIGINT::DOUBLE / count(*)::DOUBLE / 1e6 AS avg_ms,
       max(duration_ns)::DOUBLE / 1e6 AS max_ms FROM traces"""
    add("operation_stats", _with("T", f"SELECT span_name, {stats} GROUP BY span_name"))
    add("operation_stats_by_service", _with("T", f"""
SELECT service_name, span_name, {stats} GROUP BY service_name, span_name"""))
    add("parent_child", _with("T", PARENT_CHILD))
    add("metric_by_attr", _with("M", """
SELECT json_extract_string(resource, '$."service.name"') AS attribute, sum(value) AS total
FROM metrics WHERE metric_name = 'line.count' GROUP BY 1"""))

    add("sample_traces", _with("T", f"""
SELECT {T_COLS} FROM traces WHERE {POSITION} < {Q.SAMPLE_RATE}"""))
    add("sample_always", _with("T", f"SELECT {T_COLS} FROM traces WHERE {IN_SAMPLE}"))
    add("sample_report", _with("T", f"""
SELECT service_name, count(*) FILTER (WHERE {IN_SAMPLE}) AS spans_kept,
       count(*) FILTER (WHERE NOT {IN_SAMPLE}) AS spans_dropped
FROM traces GROUP BY service_name"""))
    add("retain_traces", _with("T", f"""
SELECT {T_COLS} FROM spans WHERE trace_id IN (SELECT trace_id FROM kept)""", ARRIVALS))
    add("retain_logs", _with("L", """
SELECT batch_id, service_name, timestamp_unix_nano, body FROM log_records
WHERE batch_id IN (SELECT batch_id FROM kept)""", newest_batches("log_records")))
    add("retain_metrics", _with("M", f"""
SELECT ts // {DAY_NS} AS batch_id, service_name, metric_name, ts AS timestamp_unix_nano
FROM metric_points WHERE ts // {DAY_NS} IN (SELECT batch_id FROM kept)""",
        newest_batches(f"(SELECT ts // {DAY_NS} AS batch_id FROM metric_points)")))
    add("retain_by_age_traces", _with("T", f"""
SELECT {T_COLS} FROM traces WHERE end_time_unix_nano >= {since_t}"""))
    add("retain_by_age_logs", _with("L", f"""
SELECT service_name, timestamp_unix_nano, body FROM logs
WHERE timestamp_unix_nano >= {since_l}"""))
    add("retain_by_age_metrics", _with("M", f"""
SELECT service_name, metric_name, timestamp_unix_nano, value FROM metrics
WHERE metric_type <> 'unknown' AND timestamp_unix_nano >= {since_l}"""))

    add("alert_span_duration", _with("T", f"""
SELECT {T_COLS} FROM traces WHERE duration_ns > {Q.SLOW_NS}"""))
    add("alert_error_rate", _with("T", WINDOW_COUNTS))
    add("error_rate_windows", _with("T", SLIDING_WINDOWS))
    add("alert_log_body", _with("L", """
SELECT service_name, timestamp_unix_nano, body FROM logs WHERE contains(body, 'purchase')"""))
    add("alert_log_severity", _with("L", """
SELECT service_name, timestamp_unix_nano, severity_number, body FROM logs
WHERE severity_number >= 13"""))
    add("alert_metric", _with("M", """
SELECT service_name, metric_name, timestamp_unix_nano, value FROM metrics
WHERE metric_name = 'user.error' AND value > 100"""))
    add("alert_cooldown", _with("L", 'SELECT rule, "at" FROM fired',
        SEVERITY_HITS + "," + fires(Q.HOUR_NS), recursive=True))
    add("alert_rules", _with("TLM", "SELECT * FROM hits", RULE_HITS))
    add("alerts_all", _with("TLM", 'SELECT rule, kind, "at" FROM fired',
        RULE_HITS + "," + fires(DAY_NS, "rule, kind"), recursive=True))

    add("alert_messages", _with("TLM", """
SELECT f.rule, f.kind, f."at", min(w.message) AS message
FROM fired f JOIN worded w ON w.rule = f.rule AND w."at" = f."at"
GROUP BY 1, 2, 3""", MESSAGE_HITS + "," + fires(DAY_NS, "rule, kind"), recursive=True))

    add("attribute_display", _with("T", DISPLAY))
    add("scalar_functions", _with("T", SCALARS))
    for name, text in sql_texts.DUCKDB.items():
        add(name, _with("TLM", text.replace("WITH errors AS", ", errors AS")
                        if text.lstrip().startswith("WITH") else text))
    return found


def oracle_sql() -> dict[str, str]:
    return _queries()
