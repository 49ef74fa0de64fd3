"""Alert rules over tables: the five rule kinds, rule text, and the cooldown between fires."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.exposition import format_value
from spanforge.functions.numbers import plus
from spanforge.functions.text import NANOS, SEVERITY_FLOOR, fixed
from spanforge.operators import chains
from spanforge.operators.ranking import counts_before
from spanforge.session import cut_lineage

COOLDOWN_NS = 60 * NANOS
BODY_SHOWN = 100
EPSILON = 2.220446049250313e-16  # distance from 1.0 to the next double
#: Rules are a written list; their texts and thresholds together may take so many bytes.
MOST_RULE_BYTES = 64 << 20

# --- the five conditions, one function each ---------------------------------------------------


def slow_spans(traces: DataFrame, threshold_ns: int) -> DataFrame:
    """Spans longer than the threshold."""
    return traces.where(F.col("duration_ns") > threshold_ns)


def logs_containing(logs: DataFrame, pattern: str) -> DataFrame:
    """Log records whose body contains the text."""
    return logs.where(F.col("body").contains(pattern))


def logs_at_least(logs: DataFrame, severity: str) -> DataFrame:
    """Log records at or above a severity level."""
    name = "WARN" if severity.upper() == "WARNING" else severity.upper()
    if name not in SEVERITY_FLOOR:
        raise ValueError(f"unknown severity: {severity}")
    return logs.where(F.col("severity_number") >= SEVERITY_FLOOR[name])


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """The five comparisons of a metric rule; ``=`` allows one epsilon."""
    return (
        F.when(op == ">", value > threshold)
        .when(op == "<", value < threshold)
        .when(op == ">=", value >= threshold)
        .when(op == "<=", value <= threshold)
        .when(op == "=", F.abs(value - threshold) < EPSILON)
        .otherwise(False)
    )


def alertable_points(metrics: DataFrame) -> DataFrame:
    """Points a metric rule looks at: gauges, sums and histogram sums that have a value.

    A flat table has a count for a histogram without a sum and a zero for a point without a
    value. Only ``has_value`` (extended flattening, saved tables) tells them apart; where it is
    missing or NULL the value is taken as it is.
    """
    looked_at = F.col("metric_type").isin("gauge", "sum", "histogram")
    if "has_value" in metrics.columns:
        looked_at = looked_at & F.coalesce("has_value", F.lit(True))
    return metrics.where(looked_at & F.col("value").isNotNull())


def metric_over(metrics: DataFrame, name: str, op: str, threshold: float) -> DataFrame:
    """Data points of one metric that meet the comparison."""
    if op not in (">", "<", ">=", "<=", "="):
        raise ValueError(f"unknown comparison: {op}")
    points = alertable_points(metrics).where(F.col("metric_name") == name)
    return points.where(compare(F.col("value"), F.lit(op), F.lit(float(threshold))))


def error_counts(
    errors: DataFrame,
    window_ns: Column | int,
    keys: Sequence[str] = (),
    at: str = "at",
    history: DataFrame | None = None,
) -> DataFrame:
    """Errors in the trailing window (both ends included) at every distinct error time.

    ``window_ns`` may be a column that is constant per key. ``history`` holds earlier errors
    that count but are not asked about. Counting is a difference of two ordered counts, so
    neither a burst nor a long history meets in one task.
    """
    keys = list(keys)
    window = F.lit(window_ns) if isinstance(window_ns, int) else window_ns
    counted = errors.select(*keys, at, window.alias("_window"), F.lit(True).alias("_asked"))
    if history is not None:
        counted = counted.unionByName(
            history.select(*keys, at, F.lit(False).alias("_asked")), allowMissingColumns=True
        )
    # Counted once: the ordered counts read these times several times over, not the spans.
    counted = cut_lineage(
        counted.groupBy(*keys, at).agg(
            F.count("*").alias("weight"), F.max("_window").alias("_window"), F.max("_asked").alias("_asked")
        )
    )
    events = counted.select(*keys, at, "weight")
    times = counted.where("_asked").select(*keys, at, "_window")
    probes = times.select(
        *keys,
        F.col(at).alias("_time"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("sign"), plus(F.col(at), 1).alias("at")),
                F.struct(F.lit(-1).alias("sign"), (F.col(at) - F.col("_window")).alias("at")),
            )
        ).alias("p"),
    ).select(*keys, "_time", "p.sign", F.col("p.at").alias(at))
    counted = counts_before(events, probes, keys, at=at)
    return counted.groupBy(*keys, F.col("_time").alias(at)).agg(
        F.sum(F.col("before") * F.col("sign")).alias("errors_in_window")
    )


def error_bursts(errors: DataFrame, max_count: int, window_ns: int, at: str = "at") -> DataFrame:
    """Error times at which the trailing window holds more than ``max_count`` errors."""
    return error_counts(errors, window_ns, at=at).where(F.col("errors_in_window") > max_count)


# --- rules as text ----------------------------------------------------------------------------

# The written forms of the five rules, and the lengths of the time units.
RULE_FORMS = {
    "span_duration": r"^span_duration\s*>\s*([0-9]+)(ms|s|m|h|d)$",
    "error_rate": r"^error_rate\s*>\s*([0-9]+)\s*/\s*(?:([0-9]+)(ms|s|m|h|d)|(min|minute|hr|hour))$",
    "log_body": r"(?s)^log_body\s*contains\s*'(.*)'$",
    "log_severity": r"^log_severity\s*>=\s*(\S+)$",
    "metric": r"^metric\s*(.*?\S)\s*(>=|<=|>|<|=)\s*([^<>=]+)$",
}
UNIT_NS = {
    "ms": 1_000_000,
    "s": NANOS,
    "m": 60 * NANOS,
    "h": 3_600 * NANOS,
    "d": 86_400 * NANOS,
}
NAMED_WINDOW_NS = {
    "min": 60 * NANOS,
    "minute": 60 * NANOS,
    "hr": 3_600 * NANOS,
    "hour": 3_600 * NANOS,
}


def _lookup(table: dict[str, int], key: Column) -> Column:
    parts = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*parts)[key]


def rules_frame(spark: SparkSession, rules: Sequence[str]) -> DataFrame:
    """Rule texts as a table (``rule``)."""
    return spark.createDataFrame([(r,) for r in rules], "rule string")


def parse_rules(rules: DataFrame) -> DataFrame:
    """Rule texts to conditions; ``error`` is set on texts that are not a rule."""
    text = F.trim(F.col("rule"))

    def part(kind: str, group: int) -> Column:
        return F.when(
            F.col("kind") == kind, F.regexp_extract(text, RULE_FORMS[kind], group)
        )

    kind = F.lit(None).cast("string")
    for name, form in RULE_FORMS.items():
        kind = F.when(text.rlike(form), name).otherwise(kind)
    level = F.upper(part("log_severity", 1))
    floors = {**SEVERITY_FLOOR, "WARNING": SEVERITY_FLOOR["WARN"]}
    duration = part("span_duration", 1).try_cast("bigint") * _lookup(
        UNIT_NS, part("span_duration", 2)
    )
    window = F.coalesce(
        _lookup(NAMED_WINDOW_NS, part("error_rate", 4)),
        part("error_rate", 2).try_cast("bigint") * _lookup(UNIT_NS, part("error_rate", 3)),
    )
    parsed = rules.select(F.col("rule"), kind.alias("kind")).select(
        text.alias("rule"),
        "kind",
        duration.alias("threshold_ns"),
        part("error_rate", 1).try_cast("bigint").alias("max_count"),
        window.alias("window_ns"),
        part("log_body", 1).alias("pattern"),
        _lookup(floors, level).alias("min_severity"),
        F.trim(part("metric", 1)).alias("metric_name"),
        part("metric", 2).alias("op"),
        F.trim(part("metric", 3)).try_cast("double").alias("threshold"),
    )
    complete = (
        ((F.col("kind") == "span_duration") & F.col("threshold_ns").isNotNull())
        | ((F.col("kind") == "error_rate") & F.col("max_count").isNotNull()
           & F.col("window_ns").isNotNull())
        | (F.col("kind") == "log_body")
        | ((F.col("kind") == "log_severity") & F.col("min_severity").isNotNull())
        | ((F.col("kind") == "metric") & F.col("threshold").isNotNull())
    )
    reason = F.concat(F.lit("not an alert rule: "), F.col("rule"))
    return parsed.withColumn(
        "error", F.when(F.coalesce(complete, F.lit(False)), F.lit(None)).otherwise(reason)
    )


def _seconds(ns: Column) -> Column:
    return fixed(ns.cast("double") / 1e9, 3)


def _cut(body: Column) -> Column:
    # The limit counts bytes; a character that it would split is left out.
    shown = F.make_valid_utf8(F.substring(body.cast("binary"), 1, BODY_SHOWN).cast("string"))
    return F.when(
        F.octet_length(body) > BODY_SHOWN,
        F.concat(F.regexp_replace(shown, "\uFFFD+$", ""), F.lit("...")),
    ).otherwise(body)


def _window_text(ns: Column) -> Column:
    whole = ns % NANOS == 0
    seconds = F.concat((ns / NANOS).cast("bigint").cast("string"), F.lit("s"))
    millis = F.concat((ns / 1_000_000).cast("bigint").cast("string"), F.lit("ms"))
    return F.when(whole, seconds).otherwise(millis)


_RULE_FIELDS = [
    "rule", "kind", "threshold_ns", "max_count", "window_ns", "pattern", "min_severity",
    "metric_name", "op", "threshold",
]
_HIT = "rule string, kind string, at bigint, message string"


class _Rules:
    """Parsed rules, ready to meet tables.

    Rules are a list that people write, so the lists that tasks search travel with the plan, as
    scalar subqueries: one array for each kind, sorted by threshold. A row finds by binary search how
    many of its kind's thresholds it passes, and only these are exploded. Texts to look for and the
    kinds that occur are read while the plan is built, up to ``MOST_RULE_BYTES``.
    """

    def __init__(self, rules: DataFrame) -> None:
        self.table = rules.where(F.col("error").isNull()).select(*_RULE_FIELDS)
        size = F.sum(F.octet_length("rule") + F.lit(64)).alias("size")
        found = self.table.groupBy("kind").agg(size).collect()
        self.kinds = {r["kind"] for r in found}
        if sum(r["size"] for r in found) > MOST_RULE_BYTES:
            raise ValueError(f"rules beyond {MOST_RULE_BYTES} bytes: evaluate them in parts")

    def has(self, *kinds: str) -> bool:
        return bool(self.kinds.intersection(kinds))

    def of(self, kind: str) -> DataFrame:
        return self.table.where(F.col("kind") == kind)

    def list_of(self, kind: str, threshold: str) -> Column:
        """All rules of a kind as one array of ``t`` and ``rule``, sorted by threshold."""
        entry = F.struct(F.col(threshold).alias("t"), "rule")
        return self.of(kind).agg(F.sort_array(F.collect_list(entry)).alias("sorted")).scalar()

    def patterns(self) -> list[str]:
        return sorted(r[0] for r in self.of("log_body").select("pattern").distinct().collect())


def _below(entries: Column, holds) -> Column:
    """How many leading entries of a sorted array meet ``holds`` (true, then false): binary search."""
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def step(at: Column, width: Column) -> Column:
        further = (at + width <= F.size(entries)) & holds(F.get(entries, at + width - 1))
        return F.when(F.coalesce(further, F.lit(False)), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _explode_passed(rows: DataFrame, entries: Column, holds, onward: bool = False) -> DataFrame:
    """Each row beside the entries that it passes (struct ``r``): the leading ones, or the others."""
    found = rows.withColumn("_list", entries)
    found = found.withColumn("_n", _below(F.col("_list"), holds))
    size = F.size("_list")
    passed = F.slice("_list", F.col("_n") + 1, size - F.col("_n")) if onward else F.slice("_list", F.lit(1), F.col("_n"))
    hit = F.col("_n") < size if onward else F.col("_n") > 0
    return found.where(hit).withColumn("r", F.explode(passed)).drop("_list", "_n")


def evaluate_rules(
    rules: DataFrame,
    traces: DataFrame,
    logs: DataFrame,
    metrics: DataFrame,
    earlier_errors: DataFrame | None = None,
) -> DataFrame:
    """Every hit of every parsed rule: rule, kind, time and message, before the cooldown.

    ``earlier_errors`` (``at``) are error times of earlier batches that still count in the
    windows of error-rate rules.

    A row is never put beside a rule that it does not meet: thresholds are found by binary
    search in sorted lists, texts by one automaton of all patterns, metrics by name.
    """
    known = _Rules(rules)
    parts = []
    if known.has("span_duration"):
        parts.append(_span_hits(known, traces))
    if known.has("log_body"):
        parts.append(_body_hits(known, logs))
    if known.has("log_severity"):
        parts.append(_severity_hits(known, logs))
    if known.has("metric"):
        parts.append(_metric_hits(known, metrics))
    if known.has("error_rate"):
        parts.append(_error_rate_hits(known, traces, earlier_errors))
    if not parts:
        return rules.sparkSession.createDataFrame([], _HIT)
    return reduce(DataFrame.unionByName, parts)


def _hits(rows: DataFrame, kind: str, at: str, rule: Column, message: Column) -> DataFrame:
    return rows.select(
        rule.alias("rule"), F.lit(kind).alias("kind"), F.col(at).alias("at"),
        message.alias("message"),
    )


def _span_hits(known: _Rules, traces: DataFrame) -> DataFrame:
    duration = F.col("duration_ns")
    rows = traces.select("start_time_unix_nano", "span_name", "duration_ns")
    slow = _explode_passed(
        rows, known.list_of("span_duration", "threshold_ns"), lambda e: e["t"] < duration
    )
    # The words of the messages.
    message = F.concat(
        F.lit("span '"), "span_name", F.lit("' duration "), _seconds(duration),
        F.lit("s exceeds threshold "), _seconds(F.col("r.t")), F.lit("s"),
    )
    return _hits(slow, "span_duration", "start_time_unix_nano", F.col("r.rule"), message)


def _patterns_in(patterns: list[str]):
    """An Arrow function from bodies to the patterns they contain, in one pass over each body."""

    def found(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern in patterns:
            if pattern:
                automaton.add_word(pattern, pattern)
        everywhere = [""] if "" in patterns else []
        if len(automaton):
            automaton.make_automaton()

        def of(body: str | None) -> list[str] | None:
            if body is None:
                return None
            matches = {p for _, p in automaton.iter(body)} if len(automaton) else ()
            return everywhere + sorted(matches)

        for series in bodies:
            yield series.map(of, na_action=None)

    return F.pandas_udf(found, "array<string>")


def _body_hits(known: _Rules, logs: DataFrame) -> DataFrame:
    rows = logs.select("timestamp_unix_nano", "body").where(F.col("body").isNotNull())
    found = rows.withColumn("pattern", F.explode(_patterns_in(known.patterns())(F.col("body"))))
    mine = F.broadcast(known.of("log_body").select("rule", "pattern"))  # at most MOST_RULE_BYTES
    message = F.concat(
        F.lit("log body contains '"), "pattern", F.lit("': "), _cut(F.col("body"))
    )
    return _hits(found.join(mine, "pattern"), "log_body", "timestamp_unix_nano", F.col("rule"), message)


def _severity_hits(known: _Rules, logs: DataFrame) -> DataFrame:
    number = F.col("severity_number")
    rows = logs.select("timestamp_unix_nano", "body", "severity_number")
    loud = _explode_passed(
        rows, known.list_of("log_severity", "min_severity"), lambda e: e["t"] <= number
    )
    message = F.concat(
        F.lit("log severity "), number.cast("string"), F.lit(" >= "),
        F.col("r.t").cast("string"), F.lit(": "), _cut(F.col("body")),
    )
    return _hits(loud, "log_severity", "timestamp_unix_nano", F.col("r.rule"), message)


def _metric_hits(known: _Rules, metrics: DataFrame) -> DataFrame:
    """Points meet the rules of their name: one row a name, with a sorted list for each comparison."""
    value = F.col("value")
    entry = F.struct(F.col("threshold").alias("t"), "rule", "op")
    # What a list is sorted for: the side of the threshold that its comparisons look at.
    side = F.when(F.col("op").isin(">", ">="), "above").when(F.col("op").isin("<", "<="), "under")
    lists = known.of("metric").groupBy("metric_name", F.coalesce(side, F.lit("equal")).alias("side")).agg(
        F.sort_array(F.collect_list(entry)).alias("rules")
    )
    points = alertable_points(metrics).select("timestamp_unix_nano", "metric_name", "value")
    beside = points.join(F.broadcast(lists), "metric_name")  # at most MOST_RULE_BYTES
    above = _explode_passed(
        beside.where("side = 'above'"), F.col("rules"), lambda e: e["t"] <= value
    )
    under = _explode_passed(
        beside.where("side = 'under'"), F.col("rules"), lambda e: e["t"] < value, onward=True
    )
    # Only thresholds about as large as the value can differ from it by less than one epsilon.
    low, high = value - 2 * EPSILON, value + 2 * EPSILON
    near = beside.where("side = 'equal'").withColumn("_from", _below(F.col("rules"), lambda e: e["t"] < low))
    near = near.withColumn("_to", _below(F.col("rules"), lambda e: e["t"] <= high))
    near = near.where("_to > _from").withColumn(
        "r", F.explode(F.slice("rules", F.col("_from") + 1, F.col("_to") - F.col("_from")))
    ).drop("_from", "_to")
    met = reduce(DataFrame.unionByName, [above, under, near]).where(
        compare(value, F.col("r.op"), F.col("r.t"))
    )
    message = F.concat(
        F.lit("metric '"), "metric_name", F.lit("' value "), format_value(value),
        F.lit(" triggered (threshold "), format_value(F.col("r.t")), F.lit(")"),
    )
    return _hits(met, "metric", "timestamp_unix_nano", F.col("r.rule"), message)


def _error_rate_hits(
    known: _Rules, traces: DataFrame, earlier_errors: DataFrame | None
) -> DataFrame:
    """Errors are counted once for each distinct window; its rules are a list by their limit."""
    mine = known.of("error_rate")
    windows = mine.agg(F.collect_set("window_ns")).scalar()

    def per_window(times: DataFrame) -> DataFrame:
        return times.select("at", F.explode(windows).alias("window_ns"))

    failed = traces.where(F.col("status_code") == 2)
    errors = per_window(failed.select(F.col("start_time_unix_nano").alias("at")))
    history = None if earlier_errors is None else per_window(earlier_errors.select("at"))
    counted = error_counts(errors, F.col("window_ns"), ["window_ns"], history=history)
    entry = F.struct(F.col("max_count").alias("t"), "rule")
    lists = mine.groupBy("window_ns").agg(F.sort_array(F.collect_list(entry)).alias("rules"))
    n = F.col("errors_in_window")
    beside = counted.join(F.broadcast(lists), "window_ns")  # at most MOST_RULE_BYTES
    over = _explode_passed(beside, F.col("rules"), lambda e: e["t"] < n)
    message = F.concat(
        F.lit("error rate "), n.cast("string"), F.lit(" exceeds threshold "),
        F.col("r.t").cast("string"), F.lit(" in "), _window_text(F.col("window_ns")),
        F.lit(" window"),
    )
    return _hits(over, "error_rate", "at", F.col("r.rule"), message)


# --- cooldown ---------------------------------------------------------------------------------


def cooldown(
    hits: DataFrame,
    cooldown_ns: int = COOLDOWN_NS,
    last_fired: DataFrame | None = None,
) -> DataFrame:
    """The (rule, at) pairs that fire: after a fire the same rule is silent for the cooldown.

    ``last_fired`` (rule, fired_at) carries fires from earlier batches. Hits are reduced to
    distinct times. No rule is held in one task, and only the hits that can be the first fire of
    a chunk of their rule are followed from chunk to chunk (:mod:`spanforge.operators.chains`).
    """
    known = F.col("rule").isNotNull() & F.col("at").isNotNull()
    times = hits.select("rule", F.col("at").cast("bigint").alias("at")).where(known).distinct()
    if last_fired is not None:
        earlier = last_fired.groupBy("rule").agg(F.max("fired_at").alias("_last"))
        times = (
            times.join(earlier, "rule", "left")
            .where(F.col("_last").isNull() | (F.col("at") >= plus(F.col("_last"), cooldown_ns)))
            .select("rule", "at")
        )
    # Times are distinct: without a cooldown each of them fires.
    return chains.fires(cut_lineage(times), max(cooldown_ns, 1))


def alert_rows(
    hits: DataFrame,
    cooldown_ns: int = COOLDOWN_NS,
    last_fired: DataFrame | None = None,
) -> DataFrame:
    """Fired alerts: rule, kind, time and one message (the first in text order)."""
    first = cut_lineage(
        hits.groupBy("rule", "at").agg(F.min(F.struct("message", "kind")).alias("m"))
    )
    fires = cooldown(first, cooldown_ns, last_fired)
    return fires.join(first, ["rule", "at"]).select(
        "rule", F.col("m.kind").alias("kind"), "at", F.col("m.message").alias("message")
    )
