"""One SQL text per class of SQL a user runs over ``traces``, ``logs`` and ``metrics``."""

from __future__ import annotations

# Texts that read the same in both engines.
COMMON = {
    "sql_basic": """
        SELECT service_name, span_name, trace_id, span_id, duration_ns
        FROM traces
        WHERE status_code = 2 AND duration_ns > 45000000
        ORDER BY duration_ns DESC, span_id
        LIMIT 50
    """,
    "sql_group": """
        SELECT service_name, COUNT(*) AS n FROM traces GROUP BY service_name
    """,
    "sql_expr": """
        SELECT span_id,
               CASE WHEN status_code = 2 THEN 'error' WHEN status_code = 1 THEN 'ok'
                    ELSE 'unset' END AS outcome,
               CAST(kind AS VARCHAR(10)) AS kind_text,
               CAST(duration_ns AS DOUBLE) / 1000000.0 AS ms,
               duration_ns % 1000 + kind * 2 AS mixed
        FROM traces
        WHERE span_name LIKE 'line.R%' OR span_name LIKE '%URGENT'
    """,
    "sql_joins": """
        SELECT 'leaf spans' AS what, COUNT(*) AS n
        FROM traces p
        WHERE NOT EXISTS (SELECT 1 FROM traces c
                          WHERE c.trace_id = p.trace_id AND c.parent_span_id = p.span_id)
        UNION ALL
        SELECT 'spans with children', COUNT(*)
        FROM traces p
        WHERE EXISTS (SELECT 1 FROM traces c
                      WHERE c.trace_id = p.trace_id AND c.parent_span_id = p.span_id)
        UNION ALL
        SELECT 'logs without trace', COUNT(*)
        FROM logs l LEFT JOIN (SELECT DISTINCT trace_id FROM traces) t
          ON l.trace_id = t.trace_id
        WHERE t.trace_id IS NULL
        UNION ALL
        SELECT 'services on either side', COUNT(*)
        FROM (SELECT DISTINCT service_name FROM traces) a
        FULL OUTER JOIN (SELECT DISTINCT service_name FROM metrics) b
          ON a.service_name = b.service_name
    """,
    "sql_range_join": """
        SELECT c.trace_id, c.span_id
        FROM traces c
        JOIN (SELECT trace_id, MIN(start_time_unix_nano) AS lo, MAX(end_time_unix_nano) AS hi
              FROM traces WHERE parent_span_id = '' GROUP BY trace_id) r
          ON c.trace_id = r.trace_id
         AND c.start_time_unix_nano >= r.lo AND c.end_time_unix_nano <= r.hi
        WHERE c.parent_span_id <> ''
    """,
    "sql_having": """
        SELECT service_name, COUNT(DISTINCT span_name) AS span_names,
               COUNT(*) FILTER (WHERE status_code = 2) AS errors
        FROM traces
        GROUP BY service_name
        HAVING COUNT(DISTINCT span_name) > 5
    """,
    "sql_rollup": """
        SELECT service_name, severity_number, COUNT(*) AS n,
               CAST(GROUPING(service_name) AS INT) AS all_services,
               CAST(GROUPING(severity_number) AS INT) AS all_severities
        FROM logs
        GROUP BY ROLLUP (service_name, severity_number)
    """,
    "sql_setops": """
        SELECT 'both' AS side, service_name FROM (
          SELECT service_name FROM traces INTERSECT SELECT service_name FROM metrics) x
        UNION ALL
        SELECT 'metrics only', service_name FROM (
          SELECT service_name FROM metrics EXCEPT SELECT service_name FROM traces) y
        UNION ALL
        SELECT 'any', service_name FROM (
          SELECT service_name FROM traces UNION SELECT service_name FROM logs) z
    """,
    "sql_subquery": """
        WITH errors AS (SELECT trace_id, COUNT(*) AS n FROM traces
                        WHERE status_code = 2 GROUP BY trace_id)
        SELECT t.trace_id, t.span_id, t.duration_ns, e.n AS errors_in_trace
        FROM traces t JOIN errors e ON t.trace_id = e.trace_id
        WHERE t.duration_ns > (SELECT AVG(u.duration_ns) FROM traces u
                               WHERE u.service_name = t.service_name)
          AND e.n >= (SELECT MIN(n) FROM errors)
    """,
}

SPARK = {
    **COMMON,
    "sql_window": """
        SELECT 'rank' AS what, trace_id AS id, span_id AS item,
               CAST(RANK() OVER (PARTITION BY trace_id ORDER BY duration_ns DESC) AS BIGINT)
                 AS value
        FROM traces
        UNION ALL
        SELECT 'gap', service_name, CAST(timestamp_unix_nano AS STRING),
               timestamp_unix_nano - LAG(timestamp_unix_nano) OVER (
                 PARTITION BY service_name, timestamp_unix_nano div 3600000000000
                 ORDER BY timestamp_unix_nano)
        FROM logs
    """,
    "sql_functions": """
        SELECT timestamp_unix_nano div 3600000000000 AS hour_number,
               UPPER(regexp_extract(body, '^([a-z]+) ', 1)) AS event,
               COUNT(*) AS n,
               MAX(LENGTH(body)) AS longest,
               MIN(CAST(FLOOR(SQRT(CAST(timestamp_unix_nano AS DOUBLE))) AS BIGINT)) AS root
        FROM logs
        WHERE body RLIKE '[0-9]+'
        GROUP BY timestamp_unix_nano div 3600000000000, regexp_extract(body, '^([a-z]+) ', 1)
    """,
    "sql_brackets": """
        SELECT resource['service.name'] AS service, attributes['flag'] AS flag,
               COUNT(*) AS n, MAX(CAST(attributes['part'] AS BIGINT)) AS highest_part
        FROM traces
        WHERE attributes['flag'] IS NOT NULL
        GROUP BY resource['service.name'], attributes['flag']
    """,
}

DUCKDB = {
    **COMMON,
    "sql_window": """
        SELECT 'rank' AS what, trace_id AS id, span_id AS item,
               CAST(RANK() OVER (PARTITION BY trace_id ORDER BY duration_ns DESC) AS BIGINT)
                 AS value
        FROM traces
        UNION ALL
        SELECT 'gap', service_name, CAST(timestamp_unix_nano AS VARCHAR),
               timestamp_unix_nano - LAG(timestamp_unix_nano) OVER (
                 PARTITION BY service_name, timestamp_unix_nano // 3600000000000
                 ORDER BY timestamp_unix_nano)
        FROM logs
    """,
    "sql_functions": """
        SELECT timestamp_unix_nano // 3600000000000 AS hour_number,
               UPPER(regexp_extract(body, '^([a-z]+) ', 1)) AS event,
               COUNT(*) AS n,
               CAST(MAX(LENGTH(body)) AS INTEGER) AS longest,
               MIN(CAST(FLOOR(SQRT(CAST(timestamp_unix_nano AS DOUBLE))) AS BIGINT)) AS root
        FROM logs
        WHERE regexp_matches(body, '[0-9]+')
        GROUP BY 1, 2
    """,
    "sql_brackets": """
        SELECT json_extract_string(resource, '$."service.name"') AS service,
               json_extract_string(attributes, '$.flag') AS flag,
               COUNT(*) AS n,
               MAX(CAST(json_extract_string(attributes, '$.part') AS BIGINT)) AS highest_part
        FROM traces
        WHERE json_extract_string(attributes, '$.flag') IS NOT NULL
        GROUP BY 1, 2
    """,
}
