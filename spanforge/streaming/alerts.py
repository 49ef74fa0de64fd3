"""Alerts on streams: the rules per micro-batch, with state kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import NANOS, div
from spanforge.operators import alerts
from spanforge.session import cut_lineage
from spanforge.sources import store

_STATE = "rule string, fired_at bigint"
_ERRORS = "at bigint"
LATENESS_NS = 3_600 * NANOS


def _batches(spark: SparkSession, folder: str) -> tuple[object, dict[int, object]]:
    """The file system of a folder, and the paths of the batches in it by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    names = {s.getPath().getName(): s.getPath() for s in found}
    return files, {int(n[6:]): p for n, p in names.items() if n.startswith("batch=")}


def _newest(spark: SparkSession, folder: str, ddl: str, below: int) -> DataFrame:
    """What the last batch before this one left behind; one folder, whatever the history."""
    _, known = _batches(spark, folder)
    earlier = [n for n in known if n < below]
    if not earlier:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{folder}/batch={max(earlier)}")


def _write(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def _forget(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Delete state that no retry of this batch can ask for: all but it and the one before."""
    files, known = _batches(spark, folder)
    for number in sorted(n for n in known if n < batch_id)[:-1]:
        files.delete(known[number], True)


def alert_batch(
    rules: DataFrame,
    root: str,
    signal: str,
    cooldown_ns: int = alerts.COOLDOWN_NS,
    lateness_ns: int = LATENESS_NS,
):
    """The ``foreachBatch`` function that turns flat rows of one signal into alerts.

    Below ``root`` every batch writes its fired alerts, and as state the last fire per rule and
    the error times that can still count: those within the longest window and ``lateness_ns``
    of the newest error. A batch reads the state of the one before and nothing older, which it
    deletes, so its cost does not grow with the stream. A retried batch gives the same result.

    A span that comes later than ``lateness_ns`` behind the newest error still alerts, but may
    miss errors that have left the state; a hit older than the last fire of its rule does not.
    """
    longest = rules.agg(F.coalesce(F.max("window_ns"), F.lit(0))).first()[0]
    base = f"{root.rstrip('/')}/_alerts/{signal}"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        try:
            tables = {
                name: held if name == signal else spark.createDataFrame([], ddl)
                for name, ddl in store.SIGNALS.items()
            }
            earlier = None
            if signal == "traces":
                failed = held.where(F.col("status_code") == 2)
                times = failed.select(F.col("start_time_unix_nano").alias("at"))
                earlier = _newest(spark, f"{base}/errors", _ERRORS, batch_id)
                known = earlier.unionByName(times)
                newest = known.agg(F.max("at")).scalar()
                reached = F.col("at") >= newest - (longest + lateness_ns)
                _write(known.where(reached), f"{base}/errors", batch_id)
            last = cut_lineage(_newest(spark, f"{base}/state", _STATE, batch_id))
            hits = alerts.evaluate_rules(
                rules, tables["traces"], tables["logs"], tables["metrics"], earlier
            )
            fired = cut_lineage(alerts.alert_rows(hits, cooldown_ns, last))
            _write(fired, f"{base}/fired", batch_id)
            latest = (
                fired.select("rule", F.col("at").alias("fired_at"))
                .unionByName(last)
                .groupBy("rule")
                .agg(F.max("fired_at").alias("fired_at"))
            )
            _write(latest, f"{base}/state", batch_id)
            for state in ("errors", "state"):
                _forget(spark, f"{base}/{state}", batch_id)
        finally:
            held.unpersist()

    return run


def start_alerts(
    rows: DataFrame,
    rules: DataFrame,
    root: str,
    signal: str,
    checkpoint: str,
    cooldown_ns: int = alerts.COOLDOWN_NS,
    available_now: bool = False,
):
    """Evaluate parsed rules over a stream of flat rows."""
    writer = rows.writeStream.foreachBatch(
        alert_batch(rules, root, signal, cooldown_ns)
    ).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def fired_alerts(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """Alerts fired so far on a signal."""
    ddl = "rule string, kind string, at bigint, message string, batch bigint"
    folder = f"{root.rstrip('/')}/_alerts/{signal}/fired"
    if not _batches(spark, folder)[1]:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(folder)


def error_rate_windows(
    traces: DataFrame, max_count: int, window: str, slide: str, lateness: str
) -> DataFrame:
    """Sliding windows with more than ``max_count`` error spans, on a stream of flat spans.

    Spans later than ``lateness`` behind the newest one are left out of closed windows.
    """
    # Whole microseconds: a double of nanoseconds could round a span into the next window.
    errors = traces.where(F.col("status_code") == 2).withColumn(
        "event_time", F.timestamp_micros(div(F.col("start_time_unix_nano"), 1_000))
    )
    counts = (
        errors.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window, slide).alias("w"))
        .agg(F.count("*").alias("errors"))
    )
    return counts.where(F.col("errors") > max_count).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors"
    )
