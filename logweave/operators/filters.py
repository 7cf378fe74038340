"""Filters (F1-F10) as frozen dataclasses with an ``apply(df)`` method.

Every predicate is a plain column expression, so Catalyst pushes the level /
component / method predicates into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DATE_ONLY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _split(csv_list: str | None) -> list[str] | None:
    """Comma split without trimming; empty text means no filter."""
    if not csv_list:
        return None
    return csv_list.split(",")


def _to_ts(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


def regex_search(c: Column, pattern: str, literal: bool = False) -> Column:
    """case-insensitive regex find on ``coalesce(c, '')``."""
    p = re.escape(pattern) if literal else pattern
    return F.coalesce(c, F.lit("")).rlike("(?i)" + p)


@dataclass(frozen=True)
class LogFilter:
    """F1-F3 (+ F1b with ``end_inclusive_day``).

    ``start``/``end`` are ISO date or date-time texts.  A date-only ``end``
    means midnight at the start of that day, unless ``end_inclusive_day``
    extends it to the whole day.
    """
    start: str | None = None
    end: str | None = None
    levels: str | None = None
    components: str | None = None
    end_inclusive_day: bool = False

    def predicate(self, ts: str = "ts") -> Column | None:
        conds = []
        if self.start:
            conds.append(F.col(ts) >= _to_ts(self.start))
        if self.end:
            if self.end_inclusive_day:
                day = _dt.date.fromisoformat(self.end[:10]) + _dt.timedelta(days=1)
                conds.append(F.col(ts) < _to_ts(day.isoformat()))
            else:
                conds.append(F.col(ts) <= _to_ts(self.end))
        lv = _split(self.levels)
        if lv:
            conds.append(F.col("level").isin(lv))
        comps = _split(self.components)
        if comps:
            conds.append(F.col("component").isin(comps))
        if not conds:
            return None
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return out

    def day_bounds(self) -> Column | None:
        """Partition predicate on ``dt`` (ISO day): the days of the parsed bounds,
        whatever form or zone they are written in."""
        conds = []
        if self.start:
            conds.append(F.col("dt") >= F.date_format(_to_ts(self.start), "yyyy-MM-dd"))
        if self.end:
            end = self.end[:10] if self.end_inclusive_day else self.end
            conds.append(F.col("dt") <= F.date_format(_to_ts(end), "yyyy-MM-dd"))
        if not conds:
            return None
        return conds[0] if len(conds) == 1 else conds[0] & conds[1]

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate()
        if p is not None and "dt" in df.columns:
            days = self.day_bounds()
            if days is not None:
                p = days & p          # prunes partitions of a stored table
        return df if p is None else df.filter(p)


def whole_days(start_day: str, end_day: str, **kw) -> LogFilter:
    """Every row from ``start_day`` 00:00 to the end of ``end_day``."""
    return LogFilter(start=start_day, end=end_day, end_inclusive_day=True, **kw)


@dataclass(frozen=True)
class AnomalyFilter:
    """F4 method list, F5 block-id regex search (case-insensitive)."""
    methods: str | None = None
    block_search: str | None = None
    literal: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        ms = _split(self.methods)
        if ms:
            df = df.filter(F.col("method").isin(ms))
        if self.block_search and "block_id" in df.columns:
            df = df.filter(regex_search(F.col("block_id"), self.block_search, self.literal))
        return df


def text_filter(df: DataFrame, pattern: str | None, literal: bool = False) -> DataFrame:
    """regex match on ``block_id`` OR ``component``."""
    if not pattern:
        return df
    return df.filter(regex_search(F.col("block_id"), pattern, literal)
                     | regex_search(F.col("component"), pattern, literal))


def error_or_warn(level: Column | None = None) -> Column:
    """F8."""
    return (level if level is not None else F.col("level")).isin("ERROR", "WARN")


def outcome_filter(df: DataFrame, chip: str | None) -> DataFrame:
    """all / True Positive / False Positive on the ``correct`` column."""
    if not chip or chip == "all":
        return df
    return df.filter(F.col("correct") == chip)
