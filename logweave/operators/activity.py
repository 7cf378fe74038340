"""Log-activity aggregations (A1-A8, A16), top-N (T1) and paging.

Design rules used throughout:
* one aggregation per query: pivots are written as conditional counts
  in a single ``groupBy``, so there is one shuffle with a map-side partial
  aggregate (hot keys collapse to one row per task); where the columns are the
  levels found, the same pass counts them and the wide form reads its few rows;
* the counts work on log rows and on rollups of them alike (``weight``);
* top-N is ``orderBy(...).limit(n)`` on the aggregated rows -> TakeOrdered,
  never a global sort of raw rows;
* results are bounded (buckets, components, a page) — nothing raw is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.timefmt import iso, round_half_even, time_bucket
from logweave.operators.filters import AnomalyFilter, LogFilter, error_or_warn, text_filter

HOURS = list(range(24))
# A pivot has a column per level; a table with more levels has no wide form.
MAX_LEVEL_COLUMNS = 1000


def level_values(counts: DataFrame) -> list[str]:
    """The levels that occur, sorted: the columns of the wide forms (A3, A5)."""
    rows = counts.select("level").distinct().limit(MAX_LEVEL_COLUMNS + 1).collect()
    if len(rows) > MAX_LEVEL_COLUMNS:
        raise ValueError(f"more than {MAX_LEVEL_COLUMNS} levels; use the long form")
    return sorted(r[0] for r in rows)


def lines(logs: DataFrame, cond: Column | None = None) -> Column:
    """Number of lines (for which ``cond`` holds); a row of a rollup stands for ``weight`` lines."""
    if "weight" not in logs.columns:
        return F.count(F.lit(1)) if cond is None else F.count_if(cond)
    w = F.col("weight") if cond is None else F.when(cond, F.col("weight")).otherwise(0)
    return F.coalesce(F.sum(w), F.lit(0)).cast("long")


def _by_level(logs: DataFrame, key: Column, name: str) -> tuple[DataFrame, list[str]]:
    """Lines per key and level, materialised: one pass over the logs finds the
    levels and their counts, and the wide form is made from these few rows."""
    counts = (logs.filter(F.col("level").isNotNull()).groupBy(key.alias(name), "level")
              .agg(lines(logs).alias("_n")).checkpoint(eager=True))
    return counts, level_values(counts)


def _level_columns(levels: list[str]) -> list[Column]:
    return [F.sum(F.when(F.col("level") == lv, F.col("_n")).otherwise(0)).alias(lv) for lv in levels]


def timeseries(logs: DataFrame, granularity: str = "5min") -> DataFrame:
    """A3: lines per (bucket, level), one column per level that occurs, 0-filled.

    Columns: ``time`` (ISO) + one count per level.  No gap filling, no order.
    """
    counts, lv = _by_level(logs, time_bucket(F.col("ts"), granularity), "bucket")
    agg = counts.groupBy("bucket").agg(F.sum("_n").alias("_total"), *_level_columns(lv))
    return agg.select(iso(F.col("bucket")).alias("time"), *[F.col(f"`{c}`") for c in lv])


def timeseries_long(logs: DataFrame, granularity: str = "5min") -> DataFrame:
    """Long form ``time, level, count``."""
    agg = (logs.filter(F.col("level").isNotNull())
           .groupBy(time_bucket(F.col("ts"), granularity).alias("bucket"), "level")
           .agg(lines(logs).alias("count")))
    return agg.select(iso(F.col("bucket")).alias("time"), "level", "count")


def error_rate(logs: DataFrame, granularity: str = "5min", rounded: bool = True) -> DataFrame:
    """``100 * ERROR / total`` per bucket.

    ``rounded`` (A4): numpy half-even to 2 places, buckets without ERROR give 0.
    Unrounded (A4b): the whole series is empty when no ERROR line exists.
    """
    agg = (logs.filter(F.col("level").isNotNull())
           .groupBy(time_bucket(F.col("ts"), granularity).alias("bucket"))
           .agg(lines(logs, F.col("level") == "ERROR").alias("err"),
                lines(logs).alias("total")))
    rate = F.col("err") / F.col("total") * F.lit(100.0)
    if rounded:
        return agg.select(iso(F.col("bucket")).alias("time"),
                          round_half_even(rate, 2).alias("error_rate"))
    # The emptiness test is a scalar subquery over the same aggregation (its
    # exchange is reused, one scan).
    anyerr = agg.agg(F.sum("err") > 0).scalar()
    return agg.filter(anyerr).select(iso(F.col("bucket")).alias("time"), rate.alias("error_rate"))


def top_by_count(agg: DataFrame, count_col: str, key: str, n: int) -> DataFrame:
    """Top-N rows by count, ties by key ascending (TakeOrdered)."""
    return agg.orderBy(F.col(count_col).desc(), F.col(key).asc()).limit(n)


def components(logs: DataFrame, top_n: int = 20) -> DataFrame:
    """A5: per component the count per level that occurs and ``total``; top-N by total,
    returned in ascending total order."""
    counts, lv = _by_level(logs.filter(F.col("component").isNotNull()), F.col("component"), "component")
    agg = counts.groupBy("component").agg(F.sum("_n").alias("total"), *_level_columns(lv))
    top = top_by_count(agg, "total", "component", top_n)
    return top.orderBy(F.col("total").asc(), F.col("component").asc())


def component_share(comps: DataFrame) -> DataFrame:
    """Each component's total as percent of the largest one."""
    mx = comps.agg(F.max("total")).scalar()
    return comps.withColumn("share_pct", F.col("total") / mx * F.lit(100.0))


def heatmap(logs: DataFrame, top_n: int = 10) -> DataFrame:
    """ERROR/WARN lines per component x hour (0..23), 0-filled.

    Components: top-N by all-level volume, keeping only those with at least
    one ERROR/WARN line; alphabetical.  Columns ``component, h00..h23``.
    One aggregation computes volume, the ERROR/WARN flag and all 24 cells.
    """
    ew = error_or_warn()
    hr = F.hour(F.col("ts"))
    cells = [lines(logs, ew & (hr == h)).alias(f"h{h:02d}") for h in HOURS]
    agg = (logs.filter(F.col("component").isNotNull())
           .groupBy("component")
           .agg(lines(logs, F.col("level").isNotNull()).alias("_n"), lines(logs, ew).alias("_ew"), *cells))
    top = top_by_count(agg, "_n", "component", top_n)
    return (top.filter(F.col("_ew") > 0).drop("_n", "_ew").orderBy("component"))


def heatmap_values(hm: DataFrame) -> DataFrame:
    """A6 response shape: ``component, values`` (array of 24 counts)."""
    return hm.select("component", F.array(*[F.col(f"h{h:02d}") for h in HOURS]).alias("values"))


def dominant_level(logs: DataFrame) -> Column:
    """The level with most lines (ties alphabetical), as a scalar."""
    dom = logs.filter(F.col("level").isNotNull()).groupBy("level").agg(lines(logs).alias("_c"))
    return top_by_count(dom, "_c", "level", 1).select("level").scalar()


def snapshot(logs: DataFrame, approximate: bool = False) -> DataFrame:
    """Time window, distinct components, distinct non-null block ids and
    the dominant level (most lines; ties alphabetical).  One row."""
    cd = (lambda c: F.approx_count_distinct(c)) if approximate else \
        (lambda c: F.count_distinct(c))
    dom = dominant_level(logs)
    return (logs.agg(iso(F.min("ts")).alias("start"), iso(F.max("ts")).alias("end"),
                     cd(F.col("component")).alias("n_components"),
                     cd(F.col("block_id")).alias("n_blocks"))
            .withColumn("dominant_level", dom))


def level_mix(logs: DataFrame) -> DataFrame:
    """Count and percent of all lines per level."""
    counts = (logs.filter(F.col("level").isNotNull()).groupBy("level")
              .agg(lines(logs).alias("count")))
    tot = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("pct", F.col("count") / tot * F.lit(100.0))


def overview(logs: DataFrame, anomalies: DataFrame,
             log_filter: LogFilter | None = None,
             anomaly_filter: AnomalyFilter | None = None) -> DataFrame:
    """A1: total logs, ERROR logs, total anomalies, isolation-forest anomalies."""
    lf = (log_filter or LogFilter()).apply(logs)
    af = (anomaly_filter or AnomalyFilter()).apply(anomalies)
    n_anom = af.agg(F.count(F.lit(1))).scalar()
    n_if = af.agg(F.count_if(F.col("method") == "isolation_forest")).scalar()
    return (lf.agg(lines(lf).alias("total_logs"),
                   lines(lf, F.col("level") == "ERROR").alias("error_logs"))
            .withColumn("total_anomalies", n_anom).withColumn("if_anomalies", n_if))


def facets(logs: DataFrame, anomalies: DataFrame, n_components: int = 20) -> DataFrame:
    """A2: time range, sorted levels, first components alphabetically, sorted
    methods.  Lists are returned as comma-joined text (one row)."""
    rng = logs.agg(iso(F.min("ts")).alias("min_ts"), iso(F.max("ts")).alias("max_ts"))
    # Each list is a scalar subquery over a distinct set (levels, the first
    # components, methods): bounded by the vocabulary, not by the rows.
    lv = (logs.select("level").where(F.col("level").isNotNull()).distinct()
          .agg(F.array_join(F.array_sort(F.collect_list("level")), ",")).scalar())
    comps = (logs.select("component").where(F.col("component").isNotNull()).distinct()
             .orderBy("component").limit(n_components)
             .agg(F.array_join(F.array_sort(F.collect_list("component")), ",")).scalar())
    ms = (anomalies.select("method").where(F.col("method").isNotNull()).distinct()
          .agg(F.array_join(F.array_sort(F.collect_list("method")), ",")).scalar())
    return rng.withColumn("levels", lv).withColumn("components", comps).withColumn("methods", ms)


# Pages up to this many rows (offset + limit) are a TakeOrdered; deeper pages
# use the range-partitioned path below instead of one task holding them all.
DEEP_PAGE_ROWS = 100_000


def page_rows(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit - 1`` of ``df`` in ``order``.

    ``order`` must sort by every column of ``df`` (rows equal in all of them
    are interchangeable).  Shallow pages: ``orderBy().limit(offset + limit)
    .offset(offset)`` — a TakeOrdered with at most offset + limit rows per task.

    Deep pages: equal rows are first collapsed into one weighted row (a
    pre-aggregated ``groupBy``, so a value shared by a third of all rows costs
    one row per task), the distinct rows are range-sorted and checkpointed,
    per-partition weight sums (one row per partition) locate the partitions
    that overlap the page, a running weight inside those partitions gives
    each distinct row its global positions, and only the page's copies are
    expanded back (at most ``limit`` rows).
    """
    if offset + limit <= DEEP_PAGE_ROWS:
        return df.orderBy(*order).limit(offset + limit).offset(offset)
    from pyspark.sql import Window
    cols = df.columns
    weighted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    ranked = weighted.orderBy(*order).withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)
    sums = ranked.groupBy("_p").agg(F.sum("_n").alias("w")).orderBy("_p").collect()
    start, wanted, firsts = 0, [], {}
    for r in sums:
        end = start + r["w"]
        if end > offset and start < offset + limit:
            wanted.append(r["_p"])
            firsts[r["_p"]] = start
        start = end
    if not wanted:
        return df.limit(0)
    base = F.create_map(*[x for p in wanted for x in (F.lit(p), F.lit(firsts[p]))])
    run = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = ranked.filter(F.col("_p").isin(wanted))
    part = part.withColumn("_hi", F.element_at(base, F.col("_p")) + F.sum("_n").over(run))
    part = part.withColumn("_lo", F.col("_hi") - F.col("_n"))
    lo, hi = F.lit(offset), F.lit(offset + limit)
    part = part.filter((F.col("_hi") > lo) & (F.col("_lo") < hi))
    copies = F.least(F.col("_hi"), hi) - F.greatest(F.col("_lo"), lo)
    return part.select(*cols, F.explode(F.sequence(F.lit(1), copies)).alias("_k")).drop("_k")


PAGE_COLS = ["ts", "level", "component", "block_id"]
SORTABLE = {"ts", "level", "component", "block_id"}


def raw_page(logs: DataFrame, log_filter: LogFilter | None = None,
             text: str | None = None, limit: int = 500, offset: int = 0,
             sort_by: str | None = None, ascending: bool = False) -> DataFrame:
    """One page of log rows plus the ``total`` match count.

    Default order is newest first; ties are broken by the remaining page
    columns so pages are deterministic.  ``sort_by`` (T5) sorts the whole
    result by one column with nulls as the empty text.  The page is a bounded
    TakeOrdered (offset + limit rows per task), never a global sort, unless
    the page is deep (``page_rows``).
    """
    if not 100 <= limit <= 10000:
        raise ValueError("limit must be within 100..10000")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    df = (log_filter or LogFilter()).apply(logs)
    df = text_filter(df, text).select(*PAGE_COLS)
    if sort_by is None:
        order = [F.col("ts").desc(), F.col("component").asc_nulls_first(),
                 F.col("block_id").asc_nulls_first(), F.col("level").asc_nulls_first()]
    else:
        if sort_by not in SORTABLE:
            raise ValueError(f"cannot sort by {sort_by}")
        key = F.coalesce(F.col(sort_by).cast("string"), F.lit(""))
        key = key.asc() if ascending else key.desc()
        rest = [F.col(c).asc_nulls_first() for c in PAGE_COLS if c != sort_by]
        order = [key] + rest
    page = page_rows(df, order, offset, limit)
    total = df.agg(F.count(F.lit(1))).scalar()
    return page.select(iso(F.col("ts")).alias("ts"), "level", "component", "block_id",
                       total.alias("total"))


def head_rows(logs: DataFrame, n_rows: int = 500) -> DataFrame:
    """Newest ``n_rows`` lines (100..10000) with the total."""
    return raw_page(logs, limit=n_rows, offset=0)
