"""Free SQL over the registered tables; Spark SQL plans and runs it."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def columns(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types of a result."""
    return list(df.dtypes)


def as_text(df: DataFrame) -> DataFrame:
    """Every value as text, NULL shown as ``NULL``."""
    shown = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        flat = column if not kind.startswith(("map", "array", "struct")) else F.to_json(column)
        shown.append(F.coalesce(flat.cast("string"), F.lit("NULL")).alias(name))
    return df.select(*shown)


def try_sql(spark: SparkSession, text: str) -> tuple[DataFrame | None, str | None]:
    """The result, or the message of the error the text gives when it is analysed."""
    try:
        return spark.sql(text), None
    except PySparkException as error:
        return None, str(error)


def run_sql(
    spark: SparkSession, text: str, folder: str
) -> tuple[DataFrame | None, str | None]:
    """Run ``text`` to its end: its rows as :func:`as_text` shows them, or the error it gives.

    The rows are written to a new folder below ``folder``, on storage that every executor reaches,
    and read from there, so a result of any size is whole or absent: an error in any row, such as a
    cast or a division, is caught like one of the analysis, and nothing of that result is seen.
    """
    result, error = try_sql(spark, text)
    if result is None:
        return None, error
    path = f"{folder.rstrip('/')}/sql-{uuid.uuid4().hex}"
    try:
        shown = as_text(result)
        shown.write.parquet(path)
        return spark.read.schema(shown.schema).parquet(path), None
    except PySparkException as failure:
        return None, str(failure)
    except Py4JJavaError as failure:
        return None, str(failure.java_exception)
