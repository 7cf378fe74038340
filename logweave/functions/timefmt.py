"""Time bucketing, ISO rendering and rounding column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import schemas

# The supported bucket widths (seconds); unknown names use 5min.
GRANULARITY_SECONDS = {"1min": 60, "5min": 300, "15min": 900, "1h": 3600}
DEFAULT_GRANULARITY = "5min"
ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss"


def granularity_seconds(g: str | None) -> int:
    return GRANULARITY_SECONDS.get(g or DEFAULT_GRANULARITY,
                                   GRANULARITY_SECONDS[DEFAULT_GRANULARITY])


def time_bucket(ts: Column, granularity: str | None = None, seconds: int | None = None) -> Column:
    """Epoch-aligned floor of ``ts`` to the bucket width."""
    n = seconds or granularity_seconds(granularity)
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / F.lit(n)) * F.lit(n))


def iso(ts: Column) -> Column:
    """P10: naive ISO text (``YYYY-MM-DDTHH:MM:SS``)."""
    return F.date_format(ts, ISO_FMT)


def iso_utc(ts: Column) -> Column:
    """P10: ISO text with the UTC offset (``+00:00``)."""
    return F.concat(F.date_format(ts, ISO_FMT), F.lit("+00:00"))


def parse_iso_utc(s: Column) -> Column:
    """ISO text (optionally with offset / fraction) as a timestamp; invalid -> null.

    The session zone is UTC, so a text without offset is read as UTC.
    """
    return F.try_to_timestamp(s)


def outcome(true_label: Column, unknown: str | None = None) -> Column:
    """Fail -> True Positive, Success -> False Positive, else ``unknown``."""
    other = F.lit(unknown) if unknown is not None else F.lit(None).cast("string")
    return (F.when(true_label == schemas.LABEL_FAIL, F.lit("True Positive"))
            .when(true_label == schemas.LABEL_SUCCESS, F.lit("False Positive"))
            .otherwise(other))


def round_half_even(x: Column, places: int = 2) -> Column:
    """P16 (rates): numpy ``round`` = ``rint(x * 10**p) / 10**p``."""
    f = float(10 ** places)
    return F.rint(x * F.lit(f)) / F.lit(f)


def round_metric(x: Column, places: int = 4) -> Column:
    """P16 (metrics): half-even rounding to ``places`` decimals."""
    return F.bround(x, places)
