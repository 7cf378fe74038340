"""Column functions for parsing log lines and envelopes.

Everything here is a `Column` expression: it runs inside whole-stage codegen on
the executors, in batch and streaming plans alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import schemas

# The log line layout ``YYMMDD HHMMSS PID LEVEL COMPONENT: message``
# and the two block-id patterns (log parser allows a sign ``+``/``-``, the
# structured-log matrix builder only ``-``).  ``(?U)`` gives Unicode \d \w \s
# like the reference's regex engine; ``(?d)`` lets ``.`` stop only at ``\n``.
LOG_LINE_RE = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([\w.$]+):\s+(.*)$"
BLOCK_RE = r"blk_[+-]?\d+"
PRIMARY_BLOCK_RE = r"blk_-?\d+"
_FLAGS = "(?Ud)"
# Whitespace removed at both ends before matching (str.strip semantics).
_STRIP_RE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SEP = "\u0001"
LOG_FIELDS = ["date", "time", "pid", "level", "component", "message"]


def strip_ws(c: Column) -> Column:
    """Remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, _STRIP_RE, "")


def is_log_line(stripped: Column) -> Column:
    return stripped.rlike(_FLAGS + LOG_LINE_RE)


def log_fields(stripped: Column) -> Column:
    """Array of the six fields of a matching line; any other array otherwise.

    The five leading fields cannot contain the separator, and ``limit=6``
    keeps the message whole, so the split is exact.
    """
    rep = _SEP.join(f"${i}" for i in range(1, 7))
    return F.split(F.regexp_replace(stripped, _FLAGS + LOG_LINE_RE, rep), _SEP, 6)


def block_ids(message: Column) -> Column:
    """Every block id in the message, in order."""
    return F.regexp_extract_all(message, F.lit(_FLAGS + BLOCK_RE), F.lit(0))


def primary_block_id(content: Column) -> Column:
    """First ``blk_-?\\d+`` in the content or null."""
    c = F.coalesce(content, F.lit(""))
    return F.nullif(F.regexp_extract(c, _FLAGS + PRIMARY_BLOCK_RE, 0), F.lit(""))


def parse_lines(df: DataFrame, col: str = "raw") -> DataFrame:
    """P2 + P3: keep lines that match the layout and add the parsed columns.

    Non-matching lines are dropped.  Adds ``date, time, pid, level, component,
    message, block_id, all_block_ids``.

    Each line is stripped and matched once: stripped text and field array leave
    one-element generators, below which no later predicate or projection is
    pushed, so neither is computed again for each field.  A line matched if the
    split gave six fields; only a line that itself holds the separator is
    matched a second time to tell.
    """
    text, fields = F.col("_s"), F.col("_f")
    stripped = df.select(*df.columns, F.inline(F.array(F.struct(strip_ws(F.col(col)).alias("_s")))))
    split = stripped.select(*df.columns, F.inline(F.array(F.struct(text.alias("_s"), log_fields(text).alias("_f")))))
    matched = (F.size(fields) == 6) & ((F.instr(text, _SEP) == 0) | is_log_line(text))
    # get(): null-safe even if the optimizer evaluates it ahead of the filter.
    out = split.filter(matched).select(*df.columns, *[F.get(fields, i).alias(n) for i, n in enumerate(LOG_FIELDS)])
    out = out.withColumn("all_block_ids", block_ids(F.col("message")))
    return out.withColumn("block_id", F.get(F.col("all_block_ids"), 0))


def event_time(date: Column, time: Column) -> Column:
    """P5: ``%y%m%d%H%M%S`` to a timestamp, invalid -> null.

    Two-digit years pivot like POSIX ``%y`` (69-99 -> 19xx, 00-68 -> 20xx);
    seconds 60 and 61 roll into the next minute.
    """
    ok = date.rlike(r"^[0-9]{6}$") & time.rlike(r"^[0-9]{6}$")
    yy = F.substring(date, 1, 2).try_cast("int")
    century = F.when(yy >= 69, F.lit("19")).otherwise(F.lit("20"))
    base = F.try_to_timestamp(F.concat(century, date, F.substring(time, 1, 4)),
                              F.lit("yyyyMMddHHmm"))
    sec = F.substring(time, 5, 2).try_cast("int")
    ts = F.timestamp_seconds(F.unix_timestamp(base) + sec)
    return F.when(ok & (sec <= 61), ts)


def event_day(date: Column, time: Column) -> Column:
    """Partition value of a parsed row: ISO day of its event time (null if invalid)."""
    return F.date_format(event_time(date, time), "yyyy-MM-dd")


def decode_envelope(value: Column) -> Column:
    """JSON envelope -> struct; invalid JSON gives null."""
    return F.from_json(value, schemas.ENVELOPE)


def decode_csv_envelope(value: Column) -> Column:
    """P1 for CSV-record envelopes: the payload as a ``map<string,string>``.
    Such envelopes carry no ``raw`` line, so the log parser drops them; they
    stay readable as records through this decoder."""
    return F.from_json(value, schemas.ENVELOPE_CSV)


def envelope_raw(env: Column) -> Column:
    """``payload.raw``; a missing ``raw`` key defaults to the empty string."""
    return F.coalesce(env["payload"]["raw"], F.lit(""))


def normalise_event_id(c: Column) -> Column:
    """String, trimmed, upper case."""
    return F.upper(F.trim(c.cast("string")))


def normalise_label(c: Column) -> Column:
    """Null -> Normal; Anomaly -> Fail; Normal -> Success; other kept."""
    lab = F.coalesce(c, F.lit(schemas.LABEL_NORMAL_SRC))
    return (F.when(lab == schemas.LABEL_ANOMALY_SRC, F.lit(schemas.LABEL_FAIL))
            .when(lab == schemas.LABEL_NORMAL_SRC, F.lit(schemas.LABEL_SUCCESS))
            .otherwise(lab))


def base_name(path: Column) -> Column:
    """Base name of a path or URI."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)
