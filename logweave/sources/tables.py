"""Table scans over the stored Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.parse import event_time

LOG_VIEW_COLS = ["date", "time", "level", "component", "block_id"]


def log_view(parsed: DataFrame) -> DataFrame:
    """The five query columns plus ``ts``; rows with an invalid time dropped.

    Selecting the columns first lets Catalyst prune the Parquet read schema.
    A stored table's partition column ``dt`` is kept so that ``LogFilter``
    can prune partitions.
    """
    keep = LOG_VIEW_COLS + (["dt"] if "dt" in parsed.columns else [])
    df = parsed.select(*keep)
    df = df.withColumn("ts", event_time(F.col("date"), F.col("time")))
    return df.filter(F.col("ts").isNotNull())


def error_log_view(parsed: DataFrame) -> DataFrame:
    """ERROR/WARN rows only; the level predicate reaches the scan."""
    return log_view(parsed.filter(F.col("level").isin("ERROR", "WARN")))


def read_parsed_logs(spark, path: str, batch: tuple[str, int] | None = None) -> DataFrame:
    """The stored parsed-log table with its ``dt`` (event day) partition column:
    rows of all runs, or of one (run, batch).  A missing table has no rows."""
    from logweave import schemas
    from logweave.streaming.runs import read_batches
    df = read_batches(spark, path, schemas.PARSED_LOGS, ("dt",))
    if df is None:
        df = spark.createDataFrame([], schemas.PARSED_LOGS).selectExpr(
            "*", "'' AS run", "0L AS batch", "CAST(NULL AS STRING) AS dt")
    if batch is not None:
        df = df.where((F.col("run") == batch[0]) & (F.col("batch") == batch[1]))
    return df.drop("run", "batch")


def read_anomalies(spark, path: str) -> DataFrame:
    """Both anomaly shapes under one wide nullable schema."""
    from logweave import schemas
    return spark.read.schema(schemas.ANOMALIES).parquet(path)
