"""Declared schemas of the tables the library reads and writes (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model (event columns of the occurrence matrix,
# label vocabularies, method names, the published anomaly rate).
FEATURE_COLS = [f"E{i}" for i in range(1, 30)]
LABEL_ANOMALY_SRC, LABEL_NORMAL_SRC = "Anomaly", "Normal"
LABEL_FAIL, LABEL_SUCCESS = "Fail", "Success"
METHOD_KMEANS = "kmeans_distance"
METHOD_IFOREST = "isolation_forest"
METHOD_OCSVM = "one_class_svm"
METHOD_SPIKE = "statistical_threshold"
CONTAMINATION_DEFAULT = 16838 / 575061
BLOCK_KEY_CANDIDATES = ["block_id", "BlockId", "blk_id", "blkid"]

LOG_LINE = T.StructType([T.StructField("value", T.StringType(), True)])

ENVELOPE = T.StructType([
    T.StructField("ingested_at", T.StringType(), True),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("payload", T.StructType([T.StructField("raw", T.StringType(), True)]), True),
])

# Envelope whose payload is a CSV record (all values strings).
ENVELOPE_CSV = T.StructType([
    T.StructField("ingested_at", T.StringType(), True),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType()), True),
])

PARSED_LOGS = T.StructType([
    T.StructField("ingested_at", T.StringType(), True),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("time", T.StringType(), True),
    T.StructField("pid", T.StringType(), True),
    T.StructField("level", T.StringType(), True),
    T.StructField("component", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("block_id", T.StringType(), True),
    T.StructField("all_block_ids", T.ArrayType(T.StringType(), True), True),
])

ANOMALIES = T.StructType([
    T.StructField("method", T.StringType(), True),
    T.StructField("block_id", T.StringType(), True),
    T.StructField("true_label", T.StringType(), True),
    T.StructField("minute", T.StringType(), True),
    T.StructField("error_count", T.LongType(), True),
    T.StructField("detected_at", T.StringType(), True),
])

STRUCTURED_LOG = T.StructType([
    T.StructField("Content", T.StringType(), True),
    T.StructField("EventId", T.StringType(), True),
])

LABELS = T.StructType([
    T.StructField("BlockId", T.StringType(), True),
    T.StructField("Label", T.StringType(), True),
])

MATRIX = T.StructType(
    [T.StructField("BlockId", T.StringType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in FEATURE_COLS]
    + [T.StructField("Label", T.StringType(), True)]
)
