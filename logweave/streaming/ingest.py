"""Envelope decoding and the parsed-log ingest stream.

``parse_envelopes`` is a pure column transformation, so the same function
runs on a batch DataFrame and on a streaming one: no callback, no driver
collect, every micro-batch is parsed on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions.parse import decode_envelope, envelope_raw, parse_lines
from logweave.functions.timefmt import ISO_FMT
from logweave.sources.files import read_log_lines
from logweave.sources.sinks import append_logs
from logweave.sources.tables import read_parsed_logs
from logweave.streaming.runs import start_batches

# Fixed values of the reference's ingest stream: trigger interval and start position.
TRIGGER_INTERVAL = "10 seconds"
STARTING_OFFSETS = "earliest"


def parse_envelopes(values: DataFrame, value_col: str = "value") -> DataFrame:
    """P1 + P2 + P3: JSON envelope text -> parsed-log rows.

    Invalid JSON, a null value or a null payload drops the row; a payload
    without ``raw`` parses as the empty line and is dropped too.  Extra
    columns of ``values`` (keys, offsets) are kept.
    """
    # Past a one-element generator the text is decoded once, not again for each field and filter.
    env = values.select("*", F.inline(F.array(F.struct(decode_envelope(F.col(value_col)).alias("_env")))))
    env = env.filter(F.col("_env").isNotNull() & F.col("_env.payload").isNotNull())
    env = env.select("*", F.col("_env.ingested_at").alias("ingested_at"),
                     F.col("_env.source_file").alias("source_file"),
                     envelope_raw(F.col("_env")).alias("raw")).drop("_env", value_col)
    return parse_lines(env, "raw")


def parsed_columns(df: DataFrame) -> DataFrame:
    """Project onto the stored parsed-log schema."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.PARSED_LOGS.fields])


def kafka_values(spark: SparkSession, bootstrap: str, topic: str,
                 max_per_trigger: int | None = None) -> DataFrame:
    """Kafka stream with only ``value`` as text (needs the Kafka connector).
    ``max_per_trigger`` caps the intake of a trigger; by default all that waits is read."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap)
              .option("subscribe", topic)
              .option("startingOffsets", STARTING_OFFSETS)
              .option("failOnDataLoss", "false"))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def file_values(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Envelope stream from text files (one JSON envelope per line).

    Stands in for S4 where no broker is available; ``max_files_per_trigger``
    caps the intake of a trigger.
    """
    r = spark.readStream.schema(schemas.LOG_LINE)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.text(path)


def start_ingest(values: DataFrame, out_path: str, checkpoint: str,
                 available_now: bool = False, interval: str = TRIGGER_INTERVAL):
    """X1 + X2 + K2: parse the envelope stream into the stored parsed-log table.

    Each batch owns its partitions (``streaming.runs``), below them the event
    day ``dt``: a replayed batch rewrites itself, a run with a new checkpoint
    adds to the table, and bulk loads stand beside streams.  Empty micro-batches
    write nothing (X5).
    """
    def write(batch: DataFrame, run: str, number: int) -> None:
        append_logs(batch, out_path, run, number)

    return start_batches(parsed_columns(parse_envelopes(values)), write, checkpoint, available_now, interval)


def start_ingest_detect(values: DataFrame, flagged: DataFrame, logs_path: str, anomalies_path: str,
                        checkpoint: str, available_now: bool = False, interval: str = TRIGGER_INTERVAL):
    """X1-X4 + K2 + K3: one query that reads and parses the stream once, appends
    the logs, and looks up the blocks of the batch just written."""
    from logweave.streaming.detect import batch_anomalies, upsert_batch
    flagged = flagged.select("block_id", "true_label")

    def write(batch: DataFrame, run: str, number: int) -> None:
        append_logs(batch, logs_path, run, number)
        stored = read_parsed_logs(batch.sparkSession, logs_path, (run, number))
        upsert_batch(batch_anomalies(stored, flagged), anomalies_path, run, number)

    return start_batches(parsed_columns(parse_envelopes(values)), write, checkpoint, available_now, interval)


def bulk_ingest(spark: SparkSession, path: str, out_path: str, source_name: str | None = None,
                ingested_at: str | None = None) -> int:
    """K2 (batch) + S1 + P15: parse a raw log file (or folder) into the
    parsed-log table as a run of its own; one ``ingested_at`` per run,
    ``source_file`` the base name of each input file unless ``source_name`` is
    given.  Returns the number of parsed rows written (counted as they are written)."""
    lines = read_log_lines(spark, path)
    at = F.lit(ingested_at) if ingested_at else \
        F.date_format(F.current_timestamp(), ISO_FMT + ".SSSSSSXXX")
    src = F.lit(source_name) if source_name else F.col("source_file")
    parsed = parse_lines(lines.select(at.alias("ingested_at"), src.alias("source_file"), "raw"))
    written = Observation()
    append_logs(parsed_columns(parsed).observe(written, F.count(F.lit(1)).alias("rows")), out_path)
    return written.get["rows"]
