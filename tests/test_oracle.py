"""Registered queries against their SQL counterparts at the smallest scale.

A part of them runs by default; ORACLE_ALL=1 runs every one (``check.py`` does so at any scale).
"""

import os

import pytest

from check import compare, connect
from spanforge.plans.oracle import oracle_sql
from spanforge.plans.queries import queries

SF_DIR = "/root/testdata/sf0.001"
DEFAULT = [
    "flatten_logs", "import_logs", "export_metrics", "prometheus_samples", "find_spans",
    "logs_with_trace", "span_tree", "service_map", "latency_stats", "outlier_spans",
    "trace_diff_pairs", "metric_display", "metric_series", "sample_always", "retain_traces",
    "alert_error_rate", "alert_cooldown", "sql_joins", "sql_brackets",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test data is not here")
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("ORACLE_ALL") else DEFAULT)
def test_same_result(spark, duck, name):
    assert compare(queries()[name](spark, SF_DIR), duck, oracle_sql()[name]) is None
