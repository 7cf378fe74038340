"""File sources (S1-S8): raw logs, CSV records, matrices, labels.

All readers use declared or all-string schemas; nothing is inferred.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions.parse import base_name, strip_ws


def read_log_lines(spark: SparkSession, path: str, streaming: bool = False,
                   **options) -> DataFrame:
    """One row per non-blank line, column ``raw``, plus ``source_file``.

    Lines are read as UTF-8 (invalid byte sequences decode to U+FFFD when the
    text is matched); blank and whitespace-only lines are dropped.
    """
    reader = spark.readStream if streaming else spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.schema(schemas.LOG_LINE).text(path)
    df = df.select(F.col("value").alias("raw"),
                   base_name(F.col("_metadata.file_path")).alias("source_file"))
    return df.filter(F.length(strip_ws(F.col("raw"))) > 0)


def read_csv_records(spark: SparkSession, path: str, sep: str = ",",
                     streaming: bool = False, schema=None, **options) -> DataFrame:
    """Header CSV, all columns strings, plus ``key`` = first non-empty
    of the block-id columns that exist."""
    if streaming:
        if schema is None:
            raise ValueError("a streaming CSV source needs a schema")
        reader = spark.readStream.schema(schema)
    else:
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
    reader = reader.option("header", True).option("inferSchema", False).option("sep", sep)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.csv(path)
    present = [c for c in schemas.BLOCK_KEY_CANDIDATES if c in df.columns]
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in present]) if present \
        else F.lit(None).cast("string")
    return df.withColumn("key", key)


def choose_format(path: str, fmt: str = "auto") -> str:
    """S3: ``csv`` / ``tsv`` / ``raw`` by explicit choice or by file extension."""
    if fmt in ("csv", "raw"):
        return fmt
    ext = os.path.splitext(path.lower())[1]
    if ext == ".csv":
        return "csv"
    if ext == ".tsv":
        return "tsv"
    return "raw"


def read_records(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """S3: dispatch to the CSV or raw-line reader."""
    kind = choose_format(path, fmt)
    if kind == "raw":
        return read_log_lines(spark, path)
    return read_csv_records(spark, path, sep="\t" if kind == "tsv" else ",")


def require_columns(df: DataFrame, cols: list[str], what: str) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """Event-matrix CSV; ``E1..E29`` and ``Label`` must be present."""
    head = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(head, schemas.FEATURE_COLS, "event matrix")
    require_columns(head, ["Label"], "event matrix")
    cols = [F.col(c).cast("double").alias(c) for c in schemas.FEATURE_COLS]
    extra = [F.col("BlockId")] if "BlockId" in head.columns else []
    return head.select(*extra, *cols, F.col("Label"))


def read_structured_log(spark: SparkSession, path: str,
                        raw_log_path: str | None = None) -> DataFrame:
    """Structured-log CSV (``Content``, ``EventId``); when the raw log is
    given, its non-blank line count must equal the CSV row count."""
    df = spark.read.option("header", True).option("inferSchema", False) \
        .option("multiLine", True).option("escape", '"').csv(path)
    require_columns(df, ["Content", "EventId"], "structured log")
    if raw_log_path is not None:
        n_raw = read_log_lines(spark, raw_log_path).count()
        n_struct = df.count()
        if n_raw != n_struct:
            raise ValueError(f"{path} describes {n_struct} lines, but {raw_log_path} holds {n_raw} that are not blank")
    return df


def _header_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A header CSV of text columns; None if (and only if) the path does not exist."""
    try:
        return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_labels_csv(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """Labels CSV with ``BlockId, Label``.  A missing file returns None when
    ``required`` is False (the metrics path: no ground truth)."""
    df = _header_csv(spark, path)
    if df is None:
        if required:
            raise FileNotFoundError(path)
        return None
    require_columns(df, ["BlockId", "Label"], "labels")
    return df.select("BlockId", "Label")


def read_templates_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Log-template CSV; a missing file gives None."""
    return _header_csv(spark, path)
