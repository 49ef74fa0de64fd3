"""Saved tables: append-only Parquet by signal and date, reload, clear, and SQL views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.operators.lookups import event_date

SIGNALS = {"traces": schema.TRACES, "logs": schema.LOGS, "metrics": schema.METRICS}


def saved_schema(signal: str) -> str:
    """The columns of a saved table: the flat ones, extras, and those of the folders."""
    extra = "".join(f", {name} {kind}" for name, kind in schema.SAVED_EXTRA[signal].items())
    return f"{SIGNALS[signal]}{extra}, batch bigint, event_date date"


def _folder(root: str, signal: str) -> str:
    if signal not in SIGNALS:
        raise ValueError(f"unknown signal: {signal}")
    return f"{root.rstrip('/')}/{signal}"


def save(df: DataFrame, root: str, signal: str, batch_id: int | None = None) -> None:
    """Append a flat table below ``root``, partitioned by ``event_date``.

    No file is ever rewritten. With a ``batch_id`` the rows go to a folder of that batch which
    a retry of the same batch overwrites, so a repeated micro-batch counts once. Rows are
    gathered by date with a rebalance, which splits a hot day into tasks of the advised size
    and merges small ones, and sorted for tight min/max statistics. Logs keep their observed time
    and points whether they had a value, where ``df`` has these columns (extended flattening);
    logs without a time lie under 1970-01-01, whatever their observed time.
    """
    columns = schema.column_names(SIGNALS[signal]) + [
        F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
        for name, kind in schema.SAVED_EXTRA[signal].items()
    ]
    dated = df.select(*columns, event_date(F.col(schema.TIME_COLUMN[signal])).alias("event_date"))
    laid_out = dated.hint("rebalance", "event_date").sortWithinPartitions(
        "event_date", "service_name", schema.TIME_COLUMN[signal]
    )
    folder = _folder(root, signal)
    number = -1 if batch_id is None else batch_id
    writer = laid_out.withColumn("batch", F.lit(number).cast("bigint")).write.partitionBy(
        "batch", "event_date"
    )
    if batch_id is None:
        writer.mode("append").parquet(folder)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def exists(spark: SparkSession, root: str, signal: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(root, signal))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(path))


def load(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """A saved table with its partition columns; an empty table when nothing was saved."""
    full = saved_schema(signal)
    if not exists(spark, root, signal):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(_folder(root, signal))


def clear(spark: SparkSession, root: str, signal: str) -> int:
    """Empty one signal; returns how many rows were removed."""
    removed = load(spark, root, signal).count()
    if removed:
        empty = spark.createDataFrame([], saved_schema(signal))
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "batch", "event_date"
        ).parquet(_folder(root, signal))
    return removed


def clear_all(spark: SparkSession, root: str) -> dict[str, int]:
    return {signal: clear(spark, root, signal) for signal in SIGNALS}


def with_source(df: DataFrame, source: str, key: str = "source") -> DataFrame:
    """Tag the resource of every row with where it came from (replacing an older tag)."""
    label = F.regexp_replace(F.lit(source), "^https?://", "")
    others = F.map_filter("resource", lambda k, _: k != key)
    return df.withColumn("resource", F.map_concat(others, F.create_map(F.lit(key), label)))


def union_sources(sources: Mapping[str, DataFrame], key: str = "source") -> DataFrame:
    """One table from several stores, each row tagged with its source."""
    merged: DataFrame | None = None
    for name, df in sources.items():
        tagged = with_source(df, name, key)
        merged = tagged if merged is None else merged.unionByName(tagged, True)
    if merged is None:
        raise ValueError("no source given")
    return merged


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Make the flat tables known to SQL as ``traces``, ``logs`` and ``metrics``."""
    for name, df in tables.items():
        if name not in SIGNALS:
            raise ValueError(f"unknown table: {name}")
        df.createOrReplaceTempView(name)


def register_saved(spark: SparkSession, root: str, signals: Iterable[str] = SIGNALS) -> None:
    register(spark, {s: load(spark, root, s) for s in signals})


def replay(selection: Mapping[str, DataFrame], target: str) -> None:
    """Append selected rows of every signal to another store."""
    for signal, df in selection.items():
        save(df, target, signal)
