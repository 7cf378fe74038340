"""Event counts of a structured-log stream, and the model made from them.

The event matrix is a sum, so every micro-batch adds its counts by (block,
event) and the matrix is read from their sums; blocks without a known event keep
a row without an event.  ``publish_scores`` stores a model's block scores as a
version beside the earlier ones; a version is seen once it is committed
(``streaming.runs``), and the newest one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave import schemas
from logweave.operators.features import block_events, widen_counts
from logweave.streaming.runs import commits, compact, read_batches, start_batches, write_batch

COUNTS = T.StructType().add("BlockId", "string").add("EventId", "string").add("count", "long")
SCORES = T.StructType().add("block_id", "string").add("is_anomaly", "boolean").add("true_label", "string")
MODEL_RUN = "model"


def start_event_counts(stream: DataFrame, target: str, checkpoint: str, available_now: bool = False,
                       interval: str = "10 seconds"):
    """Run the stream: each micro-batch of (Content, EventId) adds its counts."""
    return start_batches(stream, lambda batch, run, number: write_batch(block_events(batch), target, run, number),
                         checkpoint, available_now, interval)


def read_event_matrix(spark, target: str, features: list[str] | None = None) -> DataFrame:
    """A20 from the counts so far: one row a block, ``E1..E29`` as double."""
    df = read_batches(spark, target, COUNTS)
    if df is None:
        df = spark.createDataFrame([], COUNTS)
    return widen_counts(df, features)


def merged_counts(df: DataFrame) -> DataFrame:
    """Counts of all batches added up by (block, event)."""
    return df.groupBy("BlockId", "EventId").agg(F.sum("count").alias("count"))


def compact_events(spark, target: str, least: int = 2) -> int:
    """Add up the counts that batches have left; returns the batches folded."""
    return compact(spark, target, COUNTS, least=least, merge=merged_counts)


def publish_scores(scores: DataFrame, target: str) -> int:
    """Store ``block_id, is_anomaly, true_label`` as the next version; returns its number."""
    log = commits(scores.sparkSession, target)
    version = 0 if log is None or MODEL_RUN not in log.known else log.known[MODEL_RUN][-1][1] + 1
    write_batch(scores.select(*SCORES.names), target, MODEL_RUN, version)
    return version


def latest_scores(spark, target: str) -> DataFrame:
    """The newest version of the block scores; none before the first."""
    df, log = read_batches(spark, target, SCORES), commits(spark, target)
    if df is None or MODEL_RUN not in log.known:
        return spark.createDataFrame([], SCORES)
    return df.where(F.col("batch") == log.known[MODEL_RUN][-1][1]).drop("run", "batch")
