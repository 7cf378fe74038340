"""Live activity over a growing log stream.

Instead of reading all lines again at every refresh, every micro-batch adds its
own rollup, and readers sum the rollups.  Sums do not mind the order rows arrive
in, so late rows count like any other and nothing is held in state; a replayed
batch is committed once (``streaming.runs``).

Two forms: counts by (bucket, level), and the full rollup that serves all live
views (A1, A3-A8, A16, A19): lines per (minute, component, level) with their first
and last time, and per day a HyperLogLog sketch of the block ids (A7 counts
distinct blocks, which no count can add up).  ``live_logs`` is read by the
operators of ``operators.activity`` and ``operators.spikes`` like a log table whose
rows stand for ``weight`` lines.  ``compact_rollup`` adds up what batches left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.parse import event_time
from logweave.functions.timefmt import iso, time_bucket
from logweave.operators.activity import dominant_level
from logweave.streaming.runs import compact, read_batches, start_batches, write_batch

COUNTS = T.StructType().add("bucket", "timestamp").add("level", "string").add("count", "long")


def batch_counts(parsed: DataFrame, seconds: int = 300) -> DataFrame:
    """Lines per (bucket, level) of some parsed rows."""
    s = parsed.select(event_time(F.col("date"), F.col("time")).alias("ts"), "level").where("ts is not null")
    return s.groupBy(time_bucket(F.col("ts"), seconds=seconds).cast("timestamp").alias("bucket"), "level") \
        .agg(F.count(F.lit(1)).alias("count"))


def start_live_counts(parsed_stream: DataFrame, target: str, checkpoint: str, seconds: int = 300,
                      available_now: bool = False, interval: str = "30 seconds"):
    """Run X6: each micro-batch adds its counts to the target."""
    def write(batch: DataFrame, run: str, number: int) -> None:
        write_batch(batch_counts(batch, seconds), target, run, number)

    return start_batches(parsed_stream, write, checkpoint, available_now, interval)


def read_live_counts(spark, target: str) -> DataFrame:
    """Count per (bucket, level) so far: ``time, level, count``."""
    df = read_batches(spark, target, COUNTS)
    if df is None:
        df = spark.createDataFrame([], COUNTS)
    return df.groupBy("bucket", "level").agg(F.sum("count").alias("count")) \
        .select(iso(F.col("bucket")).alias("time"), "level", "count")


def live_error_rate(counts: DataFrame) -> DataFrame:
    """A4 over the live counts: ``100 * ERROR / total`` per bucket (numpy
    half-even to 2 places).  Reads the small per-(bucket, level) table the
    stream maintains, not the raw rows."""
    from logweave.functions.timefmt import round_half_even
    agg = counts.groupBy("time").agg(
        F.sum(F.when(F.col("level") == "ERROR", F.col("count")).otherwise(F.lit(0))).alias("err"),
        F.sum("count").alias("total"))
    rate = F.col("err") / F.col("total") * F.lit(100.0)
    return agg.select("time", round_half_even(rate, 2).alias("error_rate"))


# ------------------------------------------------------------- full rollup ---

CELLS = T.StructType().add("ts", "timestamp").add("component", "string").add("level", "string") \
    .add("weight", "long").add("first_ts", "timestamp").add("last_ts", "timestamp")
BLOCKS = T.StructType().add("day", "date").add("blocks", "binary")
#: Registers of a block sketch as a power of two: a standard error of 0.8 %, and no
#: error while a sketch still lists its few ids.
SKETCH_K = 14


def _timed(parsed: DataFrame) -> DataFrame:
    ts = event_time(F.col("date"), F.col("time")).cast("timestamp")
    return parsed.select(ts.alias("t"), "component", "level", "block_id").where("t is not null")


def batch_cells(parsed: DataFrame) -> DataFrame:
    """Lines per (minute, component, level) of some parsed rows."""
    return _timed(parsed).groupBy(F.date_trunc("minute", "t").alias("ts"), "component", "level").agg(
        F.count(F.lit(1)).alias("weight"), F.min("t").alias("first_ts"), F.max("t").alias("last_ts"))


def batch_blocks(parsed: DataFrame) -> DataFrame:
    """A sketch of the block ids per day of some parsed rows."""
    return _timed(parsed).where("block_id is not null").groupBy(F.to_date("t").alias("day")).agg(
        F.hll_sketch_agg("block_id", F.lit(SKETCH_K)).alias("blocks"))


def add_rollup(parsed: DataFrame, target: str, run: str, number: int) -> None:
    """Add the rollup of one batch: both tables, each committed once."""
    parsed = parsed.select("date", "time", "component", "level", "block_id").persist()
    try:
        write_batch(batch_cells(parsed), f"{target}/cells", run, number)
        write_batch(batch_blocks(parsed), f"{target}/blocks", run, number)
    finally:
        parsed.unpersist()


def start_rollup(parsed_stream: DataFrame, target: str, checkpoint: str, available_now: bool = False,
                 interval: str = "30 seconds"):
    """Run X6 for all live views: each micro-batch adds its rollup to the target."""
    return start_batches(parsed_stream, lambda batch, run, number: add_rollup(batch, target, run, number),
                         checkpoint, available_now, interval)


def _table(spark, path: str, schema: T.StructType) -> DataFrame:
    df = read_batches(spark, path, schema)
    return spark.createDataFrame([], schema) if df is None else df.drop("run", "batch")


def live_logs(spark, target: str) -> DataFrame:
    """The rollup as log rows: ``ts`` (the minute), ``component, level, weight`` and
    the first and last time.  Levels and components filter it exactly, times by
    whole minutes (``filters.whole_days``, or a start on a minute)."""
    return _table(spark, f"{target}/cells", CELLS)


def live_snapshot(spark, target: str) -> DataFrame:
    """A7 from the rollup; blocks are counted by the merged sketches.  One row."""
    cells, blocks = live_logs(spark, target), _table(spark, f"{target}/blocks", BLOCKS)
    n_blocks = blocks.agg(F.hll_sketch_estimate(F.hll_union_agg("blocks"))).scalar()
    out = cells.agg(iso(F.min("first_ts")).alias("start"), iso(F.max("last_ts")).alias("end"),
                    F.count_distinct("component").alias("n_components"))
    return out.withColumn("n_blocks", F.coalesce(n_blocks, F.lit(0))).withColumn("dominant_level", dominant_level(cells))


def compact_rollup(spark, target: str, least: int = 2) -> int:
    """Add up the rollups that batches have left into one of each; returns the
    batches folded.  What is read afterwards has a row a cell, not one a batch and cell."""
    cells = compact(spark, f"{target}/cells", CELLS, least=least, merge=lambda df: df.groupBy("ts", "component", "level").agg(
        F.sum("weight").alias("weight"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")))
    compact(spark, f"{target}/blocks", BLOCKS, least=least, merge=lambda df: df.groupBy("day").agg(
        F.hll_union_agg("blocks").alias("blocks")))
    return cells
