"""Sinks (K1-K6): envelope publishing, log appends, anomaly writes, CSV exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions.timefmt import ISO_FMT


def to_envelopes(records: DataFrame, source_file: str | None = None,
                 ingested_at=None, payload_cols: list[str] | None = None,
                 key_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """K1 (shape): ``key`` (nullable) and ``value`` = JSON envelope text.

    Raw lines give ``payload = {raw}``; see ``record_envelopes`` for CSV records.
    ``ingested_at`` is a constant or, by default, the query's current time.
    """
    at = F.lit(ingested_at) if ingested_at is not None else \
        F.date_format(F.current_timestamp(), ISO_FMT + ".SSSSSSXXX")
    src = F.lit(source_file) if source_file is not None else F.col("source_file")
    cols = payload_cols or ["raw"]
    payload = F.struct(*[F.col(c) for c in cols])
    value = F.to_json(F.struct(at.alias("ingested_at"), src.alias("source_file"),
                               payload.alias("payload")))
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    return records.select(*(keep or []), key.alias("key"), value.alias("value"))


def record_envelopes(records: DataFrame, source_file: str | None = None, ingested_at=None) -> DataFrame:
    """K1 for CSV records (``read_csv_records``): the payload holds all columns of
    the record, the key is its first non-empty block id."""
    cols = [c for c in records.columns if c not in ("key", "source_file")]
    return to_envelopes(records, source_file, ingested_at, payload_cols=cols, key_col="key")


def publish(envelopes: DataFrame, fmt: str, path_or_topic: str,
            max_messages: int | None = None, **options) -> None:
    """K1: write envelopes.  ``fmt='kafka'`` needs the Kafka connector on the
    classpath (``topic`` option); ``json``/``parquet``/``text`` write files.
    ``max_messages`` (T8) keeps the first N records in the order they are read."""
    df = first_rows(envelopes, max_messages) if max_messages else envelopes
    if fmt == "kafka":
        w = df.write.format("kafka").option("topic", path_or_topic)
        for k, v in options.items():
            w = w.option(k, v)
        w.save()
    elif fmt == "text":
        df.select("value").write.mode("append").text(path_or_topic)
    else:
        df.write.mode("append").format(fmt).save(path_or_topic)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in partition order, without moving them: rows are
    counted per partition, and each partition keeps what the budget leaves it."""
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left, last = n, None
    for p in sorted(counts):
        last = p, left
        left -= counts[p]
        if left <= 0:
            break
    if last is None:
        return df
    offset = F.col("_at").bitwiseAND(F.lit(2 ** 33 - 1))
    return tagged.where((part < last[0]) | ((part == last[0]) & (offset < last[1]))).drop("_at")


def append_logs(parsed: DataFrame, path: str, run: str | None = None, batch: int = 0) -> None:
    """K2: add parsed logs to the stored table as one batch of a run (a new run
    by default), partitioned below it by the event day ``dt`` (``yyyy-MM-dd``),
    so time-range filters prune whole partitions.  Rows are first gathered by
    day, and large days split, so a day gets few files of a good size."""
    from logweave.functions.parse import event_day
    from logweave.streaming.runs import write_batch
    cols = [f.name for f in schemas.PARSED_LOGS.fields]
    rows = parsed.select(*cols, event_day(F.col("date"), F.col("time")).alias("dt")).hint("rebalance", F.col("dt"))
    write_batch(rows, path, run or f"bulk-{uuid.uuid4().hex}", batch, ("dt",))


def compact_logs(spark, path: str, least: int = 2) -> int:
    """K2: fold the small files that batches have left in the stored log table, day
    by day, into files of a good size; the rows stay.  Returns the batches folded;
    ``streaming.runs.vacuum`` removes the old files."""
    from logweave.streaming.runs import compact
    return compact(spark, path, schemas.PARSED_LOGS, by=("dt",), least=least)


def expire_logs(spark, path: str, first_day: str) -> int:
    """K2: remove the days before ``first_day`` (``yyyy-MM-dd``) from the stored log
    table, whichever batches or folds they lie in; returns the folders removed.
    Rows without a valid day stay."""
    import datetime as dt

    from logweave.streaming.runs import remove
    first = dt.date.fromisoformat(first_day).isoformat()
    return remove(spark, path, "run=*/batch=*/dt=????-??-??", lambda name: name.removeprefix("dt=") < first)


def anomalies_frame(df: DataFrame) -> DataFrame:
    """Project any anomaly rows onto the single wide anomaly schema."""
    out = []
    for f in schemas.ANOMALIES.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def refresh_anomalies(parts: list[DataFrame], path: str) -> None:
    """K4: full refresh — union of both anomaly shapes, overwrite."""
    u = None
    for p in parts:
        p = anomalies_frame(p)
        u = p if u is None else u.unionByName(p)
    u.write.mode("overwrite").parquet(path)


def write_matrix_csv(matrix: DataFrame, path: str) -> None:
    """K5: matrix as CSV with header."""
    matrix.write.mode("overwrite").option("header", True).csv(path)


def export_rows(page: DataFrame) -> DataFrame:
    """K6 (projection): export columns of a log page.

    ``Timestamp`` as ``yyyy-MM-dd HH:mm:ss``; null block id -> empty text.
    """
    return page.select(
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("level").alias("Level"),
        F.col("component").alias("Component"),
        F.coalesce(F.col("block_id"), F.lit("")).alias("Block ID"),
    )


def write_export_csv(page: DataFrame, path: str) -> None:
    """K6: CSV with header, component always quoted, null block id empty."""
    (export_rows(page).write.mode("overwrite").option("header", True)
     .option("quoteAll", True).option("emptyValue", "").csv(path))
