"""Adapters from the driver's test tables to the tables the library reads.

This is the only module that knows the test-table names.  An adapter only
renders rows in the schema a job expects (log lines, structured-log rows,
labels); the parsing, counting, joining and detection all happen in the
library's operators afterwards.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """A test table of one row group gives one task: deal its rows over the cores
    before they are rendered.  Tables with a task for each core stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # Past a one-element generator no later filter moves into the single scan task.
    return df.repartition(cores).select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- LOG_LINES: raw HDFS-style lines rendered from `events` ------------------
# Level per event type and the line template are fixed fixture values; a few
# lines have a level outside the usual four.
LEVEL_OF_EVENT = {"error": "ERROR", "signup": "WARN", "click": "DEBUG"}  # others: INFO


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, raw``: one text line per event (some deliberately malformed)."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id",
                                                                  "event_type"))
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_OF_EVENT.items()
                                                   for x in kv]), F.col("event_type")),
                       F.lit("INFO"))
    level = F.when(F.col("event_id") % 501 == 0, F.lit("FATAL")).otherwise(level)
    msg = (F.when(F.col("event_id") % 11 == 0, F.lit("heartbeat"))
           .otherwise(F.concat(F.lit("event for blk_"), F.col("user_id").cast("string"),
                               F.when(F.col("event_id") % 7 == 0,
                                      F.concat(F.lit(" src blk_-"),
                                               (F.col("event_id") % 100).cast("string")))
                               .otherwise(F.lit("")))))
    line = F.concat(F.date_format(F.col("ts"), "yyMMdd HHmmss"), F.lit(" "),
                    (F.col("event_id") % 997).cast("string"), F.lit(" "), level,
                    F.lit(" svc.Node$Shard"), (F.col("user_id") % 30).cast("string"),
                    F.lit(": "), msg)
    raw = F.when(F.col("event_id") % 13 == 0,
                 F.concat(F.lit("garbage "), F.col("event_id").cast("string"))).otherwise(line)
    return ev.select("event_id", raw.alias("raw"))


# SQL twin of `log_lines` for the DuckDB oracle.
LOG_LINES_SQL = """
log_lines AS (
  SELECT event_id,
    CASE WHEN event_id % 13 = 0 THEN 'garbage ' || CAST(event_id AS VARCHAR)
    ELSE strftime(ts, '%y%m%d %H%M%S') || ' ' || CAST(event_id % 997 AS VARCHAR) || ' ' ||
         CASE WHEN event_id % 501 = 0 THEN 'FATAL' ELSE CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
                         WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END END ||
         ' svc.Node$Shard' || CAST(user_id % 30 AS VARCHAR) || ': ' ||
         CASE WHEN event_id % 11 = 0 THEN 'heartbeat'
              ELSE 'event for blk_' || CAST(user_id AS VARCHAR) ||
                   CASE WHEN event_id % 7 = 0 THEN ' src blk_-' || CAST(event_id % 100 AS VARCHAR)
                        ELSE '' END END
    END AS raw
  FROM events)"""

# Fixed value: the reference's log-line pattern in RE2 syntax for DuckDB.
_RE = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([\w.$]+):\s+(.*)$"

# Event time of a parsed row (P5) in DuckDB.
TS_SQL = ("CAST(try_strptime(CASE WHEN CAST(substr(date, 1, 2) AS INT) >= 69 THEN '19' "
          "ELSE '20' END || date || substr(time, 1, 4), '%Y%m%d%H%M') AS TIMESTAMP) "
          "+ to_seconds(CAST(substr(time, 5, 2) AS INT))")

PARSED_SQL = LOG_LINES_SQL + f""",
parsed AS (
  SELECT event_id, raw,
    regexp_extract(trim(raw), '{_RE}', 1) AS date,
    regexp_extract(trim(raw), '{_RE}', 2) AS time,
    regexp_extract(trim(raw), '{_RE}', 3) AS pid,
    regexp_extract(trim(raw), '{_RE}', 4) AS level,
    regexp_extract(trim(raw), '{_RE}', 5) AS component,
    regexp_extract(trim(raw), '{_RE}', 6) AS message
  FROM log_lines WHERE regexp_matches(trim(raw), '{_RE}')),
parsed_ids AS (
  SELECT *, regexp_extract_all(message, 'blk_[+-]?\\d+') AS all_block_ids,
         regexp_extract_all(message, 'blk_[+-]?\\d+')[1] AS block_id
  FROM parsed),
logs AS (
  SELECT * FROM (SELECT date, time, level, component, block_id, {TS_SQL} AS ts
                 FROM parsed_ids) WHERE ts IS NOT NULL)"""


def parsed_logs(spark: SparkSession, sf_dir: str, ingested_at: str = "2024-02-01T00:00:00+00:00",
                source_file: str = "events.log") -> DataFrame:
    """LOG_LINES parsed by the library (P2, P3) with the stored-table columns."""
    from logweave.functions.parse import parse_lines
    lines = log_lines(spark, sf_dir)
    parsed = parse_lines(lines, "raw")
    return parsed.select(F.lit(ingested_at).alias("ingested_at"),
                         F.lit(source_file).alias("source_file"), "*")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOGS: the log view (S9) over the parsed lines."""
    from logweave.sources.tables import log_view
    return log_view(parsed_logs(spark, sf_dir))


# --- ENVELOPES ---------------------------------------------------------------
ENVELOPE_AT = "2024-02-01T00:00:00+00:00"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, key, value``: JSON envelopes (K1 shape) of LOG_LINES; every
    17th value is cut to 20 characters to make it invalid JSON."""
    from logweave.sources.sinks import to_envelopes
    env = to_envelopes(log_lines(spark, sf_dir), source_file="events.log",
                       ingested_at=ENVELOPE_AT, keep=["event_id"])
    cut = F.when(F.col("event_id") % 17 == 0, F.substring("value", 1, 20)).otherwise(F.col("value"))
    return env.select("event_id", "key", cut.alias("value"))


# --- STRUCTURED / LABELS from lineitem / orders -------------------------------

def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Content, EventId``: one structured-log row per line item.

    Event ids are lower-case and padded on purpose (normalised by the
    builder); ids E30/E31 fall outside the matrix columns.  Line items with
    line number 7 carry no block id in their text.
    """
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    content = F.when(F.col("l_linenumber") == 7,
                     F.concat(F.lit("PacketResponder "), F.col("l_suppkey").cast("string"),
                              F.lit(" terminating")))\
        .otherwise(F.concat(F.lit("Receiving block blk_"), F.col("l_orderkey").cast("string"),
                            F.lit(" src: /10.0."), F.col("l_suppkey").cast("string"),
                            F.lit(" size "), F.col("l_quantity").cast("string")))
    ev = F.concat(F.lit(" e"), (F.col("l_partkey") % 31 + 1).cast("string"))
    return li.select(content.alias("Content"), ev.alias("EventId"))


def structured_files(spark: SparkSession, sf_dir: str, path: str, files: int = 8) -> None:
    """STRUCTURED written as files for a file stream.  Rows are dealt by their texts:
    dealing them in turn would order all rows first, so that a task done again deals alike."""
    structured(spark, sf_dir).repartition(files, "Content", "EventId").write.parquet(path)


STRUCTURED_SQL = """
structured AS (
  SELECT CASE WHEN l_linenumber = 7
              THEN 'PacketResponder ' || CAST(l_suppkey AS VARCHAR) || ' terminating'
              ELSE 'Receiving block blk_' || CAST(l_orderkey AS VARCHAR) || ' src: /10.0.' ||
                   CAST(l_suppkey AS VARCHAR) || ' size ' || CAST(l_quantity AS VARCHAR) END AS Content,
         ' e' || CAST(l_partkey % 31 + 1 AS VARCHAR) AS EventId
  FROM lineitem)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``BlockId, Label`` in {Anomaly, Normal} from orders."""
    o = table(spark, sf_dir, "orders")
    lab = F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1"),
                 F.lit("Anomaly")).otherwise(F.lit("Normal"))
    return o.select(F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string")).alias("BlockId"),
                    lab.alias("Label"))


LABELS_SQL = """
labels_src AS (
  SELECT 'blk_' || CAST(o_orderkey AS VARCHAR) AS BlockId,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'Anomaly'
              ELSE 'Normal' END AS Label
  FROM orders)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATRIX: event matrix of STRUCTURED (A20) left-joined with LABELS."""
    from logweave.operators.features import event_matrix, label_matrix
    return label_matrix(event_matrix(structured(spark, sf_dir)), labels(spark, sf_dir))


def _feature_sql(fmt: str, sep: str = ", ") -> str:
    from logweave.schemas import FEATURE_COLS
    return sep.join(fmt.format(c=c) for c in FEATURE_COLS)


MATRIX_SQL = STRUCTURED_SQL + """,
mrows AS (SELECT nullif(regexp_extract(Content, 'blk_-?\\d+', 0), '') AS BlockId,
                 upper(trim(EventId)) AS EventId FROM structured),
matrix AS (SELECT BlockId, """ + _feature_sql("CAST(count_if(EventId = '{c}') AS DOUBLE) AS {c}") + """
           FROM mrows WHERE BlockId IS NOT NULL GROUP BY BlockId),""" + LABELS_SQL + """,
labelled AS (SELECT m.*, CASE coalesce(l.Label, 'Normal') WHEN 'Anomaly' THEN 'Fail'
                          WHEN 'Normal' THEN 'Success' ELSE l.Label END AS Label
             FROM matrix m LEFT JOIN labels_src l ON m.BlockId = l.BlockId)"""

CLASS_DIST_SQL = MATRIX_SQL + """,
st AS (SELECT """ + _feature_sql("avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}") + """ FROM labelled),
z AS (SELECT BlockId, Label,
        CAST(list_position([""" + _feature_sql("{c}") + """], list_max([""" + _feature_sql("{c}") + """])) AS BIGINT) AS cluster,
        """ + _feature_sql("CASE WHEN coalesce(s_{c}, 0) = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS z_{c}") + """
      FROM labelled, st),
cen AS (SELECT cluster, """ + _feature_sql("avg(z_{c}) AS c_{c}") + """ FROM z GROUP BY cluster),
dist AS (SELECT BlockId, Label, cluster,
           round(sqrt(""" + _feature_sql("(z_{c} - c_{c}) * (z_{c} - c_{c})", " + ") + """), 6) AS distance
         FROM z JOIN cen USING (cluster))"""


# --- ANOM: the anomaly table, produced by the library's detectors ------------
DETECTED_AT = "2024-02-01T00:00:00+00:00"
_ANOM_PATHS: dict[tuple, str] = {}


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANOM: the stored anomaly table (both shapes, S11 schema).

    * ``kmeans_distance``: MATRIX blocks flagged by the cutoff rule (T6) on
      the class-mean distance, true label from LABELS, detected at the
      order date of the block;
    * ``isolation_forest``: log blocks that have an ERROR line, without a
      true label, detected at their first such line (a second method with
      null labels for the labelled-subset rules);
    * ``statistical_threshold``: hourly error spikes of LOGS (A19).

    Written once per session and sf to the shared checkpoint folder (K4),
    then read back, so the queries over it do not recompute the detectors.
    """
    from logweave import schemas
    from logweave.functions.timefmt import iso, iso_utc
    from logweave.operators.cutoff import flag_ge_cutoff
    from logweave.operators.kmeans import class_mean_distance
    from logweave.operators.spikes import error_spikes, spike_anomalies
    from logweave.session import scratch_path
    from logweave.sources.sinks import refresh_anomalies
    from logweave.sources.tables import read_anomalies

    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _ANOM_PATHS:
        flagged = flag_ge_cutoff(class_mean_distance(matrix(spark, sf_dir), places=6), "distance",
                                 contamination=schemas.CONTAMINATION_DEFAULT)
        orders = table(spark, sf_dir, "orders").select(
            F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string")).alias("BlockId"),
            "o_orderdate")
        km = (flagged.filter(F.col("is_anomaly")).join(orders, "BlockId")
              .select(F.lit(schemas.METHOD_KMEANS).alias("method"),
                      F.col("BlockId").alias("block_id"), F.col("Label").alias("true_label"),
                      F.concat(iso(F.col("o_orderdate")), F.lit("+00:00")).alias("detected_at")))
        lg = logs(spark, sf_dir)
        ifr = (lg.filter((F.col("level") == "ERROR") & F.col("block_id").isNotNull())
               .groupBy("block_id").agg(F.min("ts").alias("_t"))
               .select(F.lit(schemas.METHOD_IFOREST).alias("method"), "block_id",
                       iso_utc(F.col("_t")).alias("detected_at")))
        sp = spike_anomalies(error_spikes(lg, seconds=3600), DETECTED_AT)
        path = scratch_path(spark, "anomalies")
        refresh_anomalies([km, ifr, sp], path)
        _ANOM_PATHS[key] = path
    return read_anomalies(spark, _ANOM_PATHS[key])


ANOM_SQL = f"""
cut AS (SELECT greatest(1, least(CAST(round_even((16838.0 / 575061.0) * count(*), 0) AS BIGINT),
                                 greatest(1, count(*) - 1))) AS k FROM dist),
ranked AS (SELECT BlockId, Label, rank() OVER (ORDER BY distance DESC) AS rk FROM dist),
anom AS (
  SELECT 'kmeans_distance' AS method, r.BlockId AS block_id, r.Label AS true_label,
         CAST(NULL AS VARCHAR) AS minute, CAST(NULL AS BIGINT) AS error_count,
         strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS detected_at
  FROM ranked r JOIN orders o ON r.BlockId = 'blk_' || CAST(o.o_orderkey AS VARCHAR)
  WHERE r.rk <= (SELECT k FROM cut)
  UNION ALL
  SELECT 'isolation_forest', block_id, NULL, NULL, NULL,
         strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
  FROM logs WHERE level = 'ERROR' AND block_id IS NOT NULL GROUP BY block_id
  UNION ALL
  SELECT 'statistical_threshold', NULL, NULL, strftime(b, '%Y-%m-%dT%H:%M:%S'), error_count,
         '{DETECTED_AT}'
  FROM (SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS b, count(*) AS error_count
        FROM logs WHERE level IN ('ERROR', 'WARN') GROUP BY 1) c,
       (SELECT avg(error_count) + 2 * stddev_samp(error_count) AS thr
        FROM (SELECT count(*) AS error_count FROM logs WHERE level IN ('ERROR', 'WARN')
              GROUP BY to_timestamp(floor(epoch(ts) / 3600) * 3600))) s
  WHERE error_count > thr)"""


_ENV_PATHS: dict[tuple, str] = {}


def envelope_files(spark: SparkSession, sf_dir: str, part: int | None = None, parts: int = 2,
                   files: int = 8) -> str:
    """ENVELOPES written as text files (one JSON envelope per line) for
    file-stream sources; ids are scrambled over the files, so times arrive out
    of order.  ``part`` takes one of ``parts`` disjoint shares of the rows."""
    from logweave.session import scratch_path
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), part, parts, files)
    if key not in _ENV_PATHS:
        path = scratch_path(spark, "envelopes")
        rows = envelopes(spark, sf_dir)
        if part is not None:
            rows = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part)
        (rows.repartitionByRange(files, F.pmod(F.col("event_id") * 7919, F.lit(10007)), "event_id")
         .select("value").write.text(path))
        _ENV_PATHS[key] = path
    return _ENV_PATHS[key]
