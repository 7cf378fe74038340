"""Error-spike detection (A19, S10, J5) and the spike series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions.timefmt import iso, iso_utc, parse_iso_utc, time_bucket
from logweave.operators.activity import lines
from logweave.operators.filters import error_or_warn


def error_spikes(logs: DataFrame, seconds: int = 60, sigma: float = 2.0) -> DataFrame:
    """ERROR/WARN lines per bucket; keep buckets with
    ``count > mean + sigma * sample_std`` over the buckets that have such lines.

    Columns ``minute`` (naive ISO text of the bucket start) and ``error_count``.
    The level predicate is pushed to the scan; the bucket counts are one
    aggregation whose exchange is reused by the threshold (a scalar subquery
    over the bucket counts, one scan).  A single bucket has no sample std
    (null), so it is never a spike.
    """
    ew = logs.filter(error_or_warn())
    counts = (ew.groupBy(time_bucket(F.col("ts"), seconds=seconds).alias("bucket"))
              .agg(lines(ew).alias("error_count")))
    threshold = counts.agg(F.avg("error_count") + F.lit(sigma) * F.stddev_samp("error_count")).scalar()
    out = counts.filter(F.col("error_count") > threshold)
    return out.select(iso(F.col("bucket")).alias("minute"), "error_count")


def spike_anomalies(spikes: DataFrame, detected_at: str) -> DataFrame:
    """Spike rows in the anomaly-table shape."""
    return spikes.select(F.lit(schemas.METHOD_SPIKE).alias("method"), "minute",
                         F.col("error_count").cast("long").alias("error_count"),
                         F.lit(detected_at).alias("detected_at"))


def spike_series(anomalies: DataFrame) -> DataFrame:
    """Statistical-threshold rows with a valid ``minute`` as
    ``time`` (ISO with offset) and ``error_count`` (missing -> 0)."""
    s = anomalies.filter(F.col("method") == schemas.METHOD_SPIKE)
    s = s.withColumn("_m", parse_iso_utc(F.col("minute"))).filter(F.col("_m").isNotNull())
    return s.select(iso_utc(F.col("_m")).alias("time"),
                    F.coalesce(F.col("error_count"), F.lit(0)).cast("long").alias("error_count"))
