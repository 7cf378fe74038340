"""Event-occurrence matrix and labels.

Counts by (block, event) come first: narrow rows, added up on the map side, so a
block holding a large share of all rows collapses to a few before the exchange.
Only then are a block's counts brought together and widened to 29 columns, in
tasks that hold whole blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions.parse import normalise_event_id, normalise_label, primary_block_id


def event_matrix(structured: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Count per (BlockId, EventId) as wide columns ``E1..E29`` (double).

    Rows without a block id are dropped; events outside the feature list do
    not count but their block is kept (all-zero row when it has no other).
    """
    feats = features or schemas.FEATURE_COLS
    return widen_counts(block_events(structured, feats), feats)


def block_events(structured: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Counts by (block, event) of structured-log rows; a null event stands for all others."""
    event = normalise_event_id(F.col("EventId"))
    # Past a one-element generator the filter cannot look for the block id a second time.
    rows = structured.select("EventId", F.inline(F.array(F.struct(primary_block_id(F.col("Content")).alias("BlockId")))))
    rows = rows.where("BlockId is not null").select(
        "BlockId", F.when(event.isin(features or schemas.FEATURE_COLS), event).alias("EventId"))
    return rows.groupBy("BlockId", "EventId").agg(F.count(F.lit(1)).alias("count"))


def widen_counts(counts: DataFrame, features: list[str] | None = None) -> DataFrame:
    """One row a block from ``BlockId, EventId, count`` rows, ``E1..E29`` as double.

    The narrow rows are dealt by block to all shuffle partitions: a wide row takes
    many times the bytes that a partition is measured by when small ones are merged.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = [F.sum(F.when(F.col("EventId") == e, F.col("count")).otherwise(0)).cast("double").alias(e)
             for e in features or schemas.FEATURE_COLS]
    return counts.repartition(parts, "BlockId").groupBy("BlockId").agg(*cells)


def label_matrix(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """J2 + P13: left join the labels; missing -> Normal; Anomaly/Normal ->
    Fail/Success.  Both sides are partitioned by ``BlockId`` (the matrix
    already is, from its aggregation), so the join adds one exchange only."""
    lab = labels.select("BlockId", F.col("Label").alias("_label"))
    out = matrix.join(lab, "BlockId", "left")
    return out.withColumn("Label", normalise_label(F.col("_label"))).drop("_label")


def label_counts(labelled: DataFrame) -> DataFrame:
    """Number of blocks per label."""
    return labelled.groupBy("Label").agg(F.count(F.lit(1)).alias("blocks"))


def binary_label(labelled: DataFrame, label_col: str = "Label", out: str = "y_true") -> DataFrame:
    """Label -> 0/1.  Fail/Success vocabulary if any such value occurs,
    else Anomaly/Normal, else an error.  One small aggregate picks the vocabulary."""
    voc = labelled.agg(
        F.max(F.col(label_col).isin(schemas.LABEL_FAIL, schemas.LABEL_SUCCESS).cast("int")).alias("fs"),
        F.max(F.col(label_col).isin(schemas.LABEL_ANOMALY_SRC,
                                    schemas.LABEL_NORMAL_SRC).cast("int")).alias("an")).first()
    if voc["fs"] == 1:
        pos = schemas.LABEL_FAIL
    elif voc["an"] == 1:
        pos = schemas.LABEL_ANOMALY_SRC
    else:
        raise ValueError(f"{label_col} holds neither {schemas.LABEL_FAIL}/{schemas.LABEL_SUCCESS} nor "
                         f"{schemas.LABEL_ANOMALY_SRC}/{schemas.LABEL_NORMAL_SRC}")
    return labelled.withColumn(out, (F.col(label_col) == pos).cast("int"))


def empirical_contamination(labelled: DataFrame, label_col: str = "y_true") -> float:
    """Mean of the 0/1 labels (falls back to the published rate when empty)."""
    v = labelled.agg(F.avg(F.col(label_col))).first()[0]
    return float(v) if v is not None else schemas.CONTAMINATION_DEFAULT
