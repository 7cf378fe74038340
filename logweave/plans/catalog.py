"""Registered queries: ``key -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL)``.

Each query reads the whole test tables through the adapters in
``fixtures`` and runs the library's operators.  The oracle SQL recomputes
the same result in DuckDB from the same tables (views pre-registered by
the checker); queries whose result depends on a random model have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)


LOGS_CTE = fx.PARSED_SQL


def _iso_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S')"


# ---------------------------------------------------------------- parsing ---

@register("parse_logs", _with(LOGS_CTE) + f"""
SELECT event_id, date, time, pid, level, component, message, block_id,
       array_to_string(all_block_ids, ' ') AS block_ids,
       CAST(len(all_block_ids) AS BIGINT) AS n_ids,
       {_iso_sql(fx.TS_SQL)} AS ts
FROM parsed_ids""")
def q_parse_logs(spark, sf_dir):
    """Parse every rendered line; unparseable lines are dropped."""
    from logweave.functions.parse import event_time
    from logweave.functions.timefmt import iso
    p = fx.parsed_logs(spark, sf_dir)
    return p.select("event_id", "date", "time", "pid", "level", "component", "message",
                    "block_id", F.array_join("all_block_ids", " ").alias("block_ids"),
                    F.size("all_block_ids").cast("long").alias("n_ids"),
                    iso(event_time(F.col("date"), F.col("time"))).alias("ts"))


# ------------------------------------------------------------- timeseries ---

# The levels of the rendered lines (fixed fixture values): a view's pivot needs
# its columns named, and any other level makes the statement fail.
LEVELS, FILTERED_LEVELS = ("DEBUG", "ERROR", "FATAL", "INFO", "WARN"), ("ERROR", "INFO", "WARN")


def _levels(levels=LEVELS) -> str:
    return "(" + ", ".join(f"'{x}'" for x in levels) + ")"


def _level_sql(levels=LEVELS) -> str:
    return f"CASE WHEN level IN {_levels(levels)} THEN level ELSE error('another level: ' || level) END AS level"


def _ts_sql(seconds: int) -> str:
    return _with(LOGS_CTE) + f""",
b AS (SELECT {_iso_sql(f"to_timestamp(floor(epoch(ts) / {seconds}) * {seconds})::TIMESTAMP")} AS time, {_level_sql()} FROM logs)
SELECT * FROM (PIVOT b ON level IN {_levels()} USING count(*) GROUP BY time)"""


def _ts_query(granularity):
    def fn(spark, sf_dir):
        from logweave.operators.activity import timeseries
        return timeseries(fx.logs(spark, sf_dir), granularity)
    fn.__doc__ = f"P6/A3: lines per {granularity} bucket and level, pivoted."
    return fn


for _g, _s in [("1min", 60), ("5min", 300), ("15min", 900), ("1h", 3600)]:
    register(f"timeseries_{_g}", _ts_sql(_s))(_ts_query(_g))


@register("timeseries_long", _with(LOGS_CTE) + f"""
SELECT {_iso_sql("to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP")} AS time, level,
       count(*) AS count
FROM logs GROUP BY 1, 2""")
def q_timeseries_long(spark, sf_dir):
    """Long form (bucket, level, count) at 5 minutes."""
    from logweave.operators.activity import timeseries_long
    return timeseries_long(fx.logs(spark, sf_dir), "5min")


_BUCKET_1H = "to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP"


@register("error_rate", _with(LOGS_CTE) + f"""
SELECT {_iso_sql(_BUCKET_1H)} AS time,
       round_even(CAST(count_if(level = 'ERROR') AS DOUBLE) / count(*) * 100.0, 2) AS error_rate
FROM logs GROUP BY 1""")
def q_error_rate(spark, sf_dir):
    """Hourly ERROR share in percent, half-even to 2 places."""
    from logweave.operators.activity import error_rate
    return error_rate(fx.logs(spark, sf_dir), "1h", rounded=True)


@register("error_rate_unrounded", _with(LOGS_CTE) + f"""
SELECT {_iso_sql("to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP")} AS time,
       round(CAST(count_if(level = 'ERROR') AS DOUBLE) / count(*) * 100.0, 9) AS error_rate
FROM logs GROUP BY 1
HAVING (SELECT count_if(level = 'ERROR') FROM logs) > 0""")
def q_error_rate_unrounded(spark, sf_dir):
    """15-minute ERROR share, unrounded (compared at 9 places)."""
    from logweave.operators.activity import error_rate
    df = error_rate(fx.logs(spark, sf_dir), "15min", rounded=False)
    return df.withColumn("error_rate", F.round("error_rate", 9))


def _pivot(levels=LEVELS) -> str:
    return f"(PIVOT cl ON level IN {_levels(levels)} USING count(*) GROUP BY component) p"


_TOP_COMPONENTS_SQL = f""",
cl AS (SELECT component, {_level_sql()} FROM logs),
top AS (SELECT component, count(*) AS total FROM logs GROUP BY component ORDER BY total DESC, component LIMIT 20)"""


@register("components_top20", _with(LOGS_CTE) + _TOP_COMPONENTS_SQL + """
SELECT p.*, total FROM top JOIN """ + _pivot() + " USING (component)")
def q_components(spark, sf_dir):
    """Top-20 components by lines, counts per level."""
    from logweave.operators.activity import components
    return components(fx.logs(spark, sf_dir), 20)


@register("component_share", _with(LOGS_CTE) + _TOP_COMPONENTS_SQL + """
SELECT p.*, total, CAST(total AS DOUBLE) / (SELECT max(total) FROM top) * 100.0 AS share_pct
FROM top JOIN """ + _pivot() + " USING (component)")
def q_component_share(spark, sf_dir):
    """Top-20 components with their share of the largest one."""
    from logweave.operators.activity import component_share, components
    return component_share(components(fx.logs(spark, sf_dir), 20))


_HOUR_CELLS_SQL = ", ".join(
    f"count_if(level IN ('ERROR', 'WARN') AND hour(ts) = {h}) AS h{h:02d}" for h in range(24))


@register("heatmap_top10", _with(LOGS_CTE) + f""",
agg AS (SELECT component, count(level) AS n, count_if(level IN ('ERROR', 'WARN')) AS ew,
               {_HOUR_CELLS_SQL}
        FROM logs GROUP BY component),
top AS (SELECT * FROM agg ORDER BY n DESC, component LIMIT 10)
SELECT * EXCLUDE (n, ew) FROM top WHERE ew > 0""")
def q_heatmap(spark, sf_dir):
    """ERROR/WARN per component x hour for the 10 busiest components."""
    from logweave.operators.activity import heatmap
    return heatmap(fx.logs(spark, sf_dir), 10)


@register("snapshot", _with(LOGS_CTE) + f""",
dom AS (SELECT level FROM logs GROUP BY level ORDER BY count(*) DESC, level LIMIT 1)
SELECT {_iso_sql('min(ts)')} AS start, {_iso_sql('max(ts)')} AS "end",
       count(DISTINCT component) AS n_components, count(DISTINCT block_id) AS n_blocks,
       (SELECT level FROM dom) AS dominant_level
FROM logs""")
def q_snapshot(spark, sf_dir):
    """Time window, distinct components / blocks, dominant level."""
    from logweave.operators.activity import snapshot
    return snapshot(fx.logs(spark, sf_dir))


@register("level_mix", _with(LOGS_CTE) + """
SELECT level, count(*) AS count,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM logs) * 100.0 AS pct
FROM logs GROUP BY level""")
def q_level_mix(spark, sf_dir):
    """Lines and percent per level."""
    from logweave.operators.activity import level_mix
    return level_mix(fx.logs(spark, sf_dir))


# Filter parameters used by the filter / paging queries (fixed test values).
F_START, F_END = "2024-01-05 06:00:00", "2024-01-20"
F_LEVELS = "ERROR,WARN,INFO"
F_COMPONENTS = "svc.Node$Shard1,svc.Node$Shard2,svc.Node$Shard3,svc.Node$Shard5,svc.Node$Shard8"
F_TEXT = r"shard1[0-9]|blk_1[0-9]$"


def _log_filter():
    from logweave.operators.filters import LogFilter
    return LogFilter(start=F_START, end=F_END, levels=F_LEVELS, components=F_COMPONENTS)


_COMP_LIST_SQL = ", ".join("'" + c + "'" for c in F_COMPONENTS.split(","))
_LEVEL_LIST_SQL = ", ".join("'" + c + "'" for c in F_LEVELS.split(","))
_FILTER_SQL = (f"ts >= TIMESTAMP '{F_START}' AND ts <= TIMESTAMP '{F_END}' "
               f"AND level IN ({_LEVEL_LIST_SQL}) AND component IN ({_COMP_LIST_SQL})")


@register("filter_logs_range_level_component", _with(LOGS_CTE) + f"""
SELECT {_iso_sql('ts')} AS ts, level, component, block_id FROM logs WHERE {_FILTER_SQL}""")
def q_filter_logs(spark, sf_dir):
    """time range (date-only end = midnight), level and component lists."""
    from logweave.functions.timefmt import iso
    df = _log_filter().apply(fx.logs(spark, sf_dir))
    return df.select(iso(F.col("ts")).alias("ts"), "level", "component", "block_id")


@register("filter_logs_whole_days", _with(LOGS_CTE) + f"""
SELECT {_iso_sql('ts')} AS ts, level, component, block_id FROM logs
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""")
def q_filter_whole_days(spark, sf_dir):
    """Whole days 2024-01-10 .. 2024-01-12 inclusive."""
    from logweave.functions.timefmt import iso
    from logweave.operators.filters import whole_days
    df = whole_days("2024-01-10", "2024-01-12").apply(fx.logs(spark, sf_dir))
    return df.select(iso(F.col("ts")).alias("ts"), "level", "component", "block_id")


_TEXT_SQL = (f"(regexp_matches(coalesce(block_id, ''), '(?i){F_TEXT}') "
             f"OR regexp_matches(coalesce(component, ''), '(?i){F_TEXT}'))")


@register("search_logs_text", _with(LOGS_CTE) + f"""
SELECT {_iso_sql('ts')} AS ts, level, component, block_id FROM logs WHERE {_TEXT_SQL}""")
def q_search_text(spark, sf_dir):
    """case-insensitive regex search on block id or component."""
    from logweave.functions.timefmt import iso
    from logweave.operators.filters import text_filter
    df = text_filter(fx.logs(spark, sf_dir), F_TEXT)
    return df.select(iso(F.col("ts")).alias("ts"), "level", "component", "block_id")


_PAGE_ORDER = ("ts DESC, component ASC NULLS FIRST, block_id ASC NULLS FIRST, "
               "level ASC NULLS FIRST")


@register("raw_page", _with(LOGS_CTE) + f""",
f AS (SELECT ts, level, component, block_id FROM logs
      WHERE ts >= TIMESTAMP '{F_START}' AND ts <= TIMESTAMP '{F_END}' AND {_TEXT_SQL})
SELECT {_iso_sql('ts')} AS ts, level, component, block_id, (SELECT count(*) FROM f) AS total
FROM f ORDER BY {_PAGE_ORDER} LIMIT 500 OFFSET 100""")
def q_raw_page(spark, sf_dir):
    """Newest-first page (offset 100, limit 500) with the total count."""
    from logweave.operators.activity import raw_page
    from logweave.operators.filters import LogFilter
    return raw_page(fx.logs(spark, sf_dir), LogFilter(start=F_START, end=F_END),
                    text=F_TEXT, limit=500, offset=100)


@register("raw_page_sorted", _with(LOGS_CTE) + f""",
f AS (SELECT ts, level, component, block_id FROM logs)
SELECT {_iso_sql('ts')} AS ts, level, component, block_id, (SELECT count(*) FROM f) AS total
FROM f ORDER BY coalesce(block_id, '') ASC, ts ASC NULLS FIRST, level ASC NULLS FIRST,
                component ASC NULLS FIRST
LIMIT 1000 OFFSET 0""")
def q_raw_page_sorted(spark, sf_dir):
    """First 1000 rows sorted by block id ascending (nulls as '')."""
    from logweave.operators.activity import raw_page
    return raw_page(fx.logs(spark, sf_dir), limit=1000, offset=0,
                    sort_by="block_id", ascending=True)


@register("export_rows", _with(LOGS_CTE) + f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Timestamp", level AS "Level",
       component AS "Component", coalesce(block_id, '') AS "Block ID"
FROM logs WHERE {_FILTER_SQL}""")
def q_export_rows(spark, sf_dir):
    """K6: export projection of the filtered log rows."""
    from logweave.sources.sinks import export_rows
    return export_rows(_log_filter().apply(fx.logs(spark, sf_dir)))


@register("decode_envelopes", _with(fx.LOG_LINES_SQL) + f""",
env AS (SELECT event_id,
          CASE WHEN event_id % 17 = 0
               THEN substr(to_json({{'ingested_at': '{fx.ENVELOPE_AT}', 'source_file': 'events.log',
                                     'payload': {{'raw': raw}}}})::VARCHAR, 1, 20)
               ELSE to_json({{'ingested_at': '{fx.ENVELOPE_AT}', 'source_file': 'events.log',
                              'payload': {{'raw': raw}}}})::VARCHAR END AS value
        FROM log_lines),
dec AS (SELECT event_id, value->>'$.ingested_at' AS ingested_at,
               value->>'$.source_file' AS source_file,
               coalesce(value->>'$.payload.raw', '') AS raw
        FROM env WHERE json_valid(value)),
p AS (SELECT event_id, ingested_at, source_file, raw,
             regexp_extract(trim(raw), '{fx._RE}', 4) AS level,
             regexp_extract(trim(raw), '{fx._RE}', 5) AS component,
             regexp_extract(trim(raw), '{fx._RE}', 6) AS message
      FROM dec WHERE regexp_matches(trim(raw), '{fx._RE}'))
SELECT event_id, ingested_at, source_file, raw, level, component, message,
       regexp_extract_all(message, 'blk_[+-]?\\d+')[1] AS block_id FROM p""")
def q_decode_envelopes(spark, sf_dir):
    """JSON envelopes -> parsed rows; invalid JSON dropped."""
    from logweave.streaming.ingest import parse_envelopes
    p = parse_envelopes(fx.envelopes(spark, sf_dir))
    return p.select("event_id", "ingested_at", "source_file", "raw", "level", "component",
                    "message", "block_id")


@register("primary_block_ids", _with(fx.STRUCTURED_SQL) + """
SELECT Content, upper(trim(EventId)) AS EventId,
       nullif(regexp_extract(Content, 'blk_-?\\d+', 0), '') AS BlockId
FROM structured""")
def q_primary_block_ids(spark, sf_dir):
    """First block id of the structured content; event id normalised."""
    from logweave.functions.parse import normalise_event_id, primary_block_id
    s = fx.structured(spark, sf_dir)
    return s.select("Content", normalise_event_id(F.col("EventId")).alias("EventId"),
                    primary_block_id(F.col("Content")).alias("BlockId"))


# ------------------------------------------------------ spikes / matrix ---

def _spike_sql(seconds: int) -> str:
    return _with(LOGS_CTE) + f""",
c AS (SELECT to_timestamp(floor(epoch(ts) / {seconds}) * {seconds})::TIMESTAMP AS b, count(*) AS error_count
      FROM logs WHERE level IN ('ERROR', 'WARN') GROUP BY 1),
s AS (SELECT avg(error_count) + 2 * stddev_samp(error_count) AS thr FROM c)
SELECT {_iso_sql('b')} AS minute, error_count FROM c, s WHERE error_count > thr"""


def _spike_query(seconds):
    def fn(spark, sf_dir):
        from logweave.operators.spikes import error_spikes
        return error_spikes(fx.logs(spark, sf_dir), seconds=seconds)
    fn.__doc__ = f"S10/A19/J5: ERROR/WARN spikes over {seconds}-second buckets (mean + 2 std)."
    return fn


register("error_spikes_minute", _spike_sql(60))(_spike_query(60))
register("error_spikes_hour", _spike_sql(3600))(_spike_query(3600))


@register("event_matrix", _with(fx.MATRIX_SQL) + " SELECT * FROM matrix")
def q_event_matrix(spark, sf_dir):
    """Per block the count of each event E1..E29."""
    from logweave.operators.features import event_matrix
    return event_matrix(fx.structured(spark, sf_dir))


@register("labelled_matrix", _with(fx.MATRIX_SQL) + " SELECT * FROM labelled")
def q_labelled_matrix(spark, sf_dir):
    """Matrix left join labels, Fail/Success vocabulary."""
    return fx.matrix(spark, sf_dir)


@register("matrix_label_counts", _with(fx.MATRIX_SQL) + """
SELECT Label, count(*) AS blocks,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labelled) AS share
FROM labelled GROUP BY Label""")
def q_matrix_label_counts(spark, sf_dir):
    """Blocks per label and each label's share (the empirical rate)."""
    from logweave.operators.features import label_counts
    lc = label_counts(fx.matrix(spark, sf_dir))
    tot = lc.agg(F.sum("blocks")).scalar()
    return lc.select("Label", "blocks", (F.col("blocks") / tot).alias("share"))


@register("centroid_distance", _with(fx.CLASS_DIST_SQL) + " SELECT BlockId, cluster, distance FROM dist")
def q_centroid_distance(spark, sf_dir):
    """M2/M4: standardised distance of every block to its class-mean centre."""
    from logweave.operators.kmeans import class_mean_distance
    return class_mean_distance(fx.matrix(spark, sf_dir), places=6).select("BlockId", "cluster", "distance")


_C = "(16838.0 / 575061.0)"


@register("flag_ge_cutoff", _with(fx.CLASS_DIST_SQL) + f""",
n AS (SELECT count(*) AS N FROM dist),
b AS (SELECT greatest(1, least(CAST(round_even({_C} * N, 0) AS BIGINT), greatest(1, N - 1))) AS k FROM n)
SELECT BlockId, distance, rank() OVER (ORDER BY distance DESC) <= (SELECT k FROM b) AS is_anomaly
FROM dist""")
def q_flag_ge_cutoff(spark, sf_dir):
    """Flag distance >= n-th largest, n = round(c N) clamped to 1..N-1."""
    from logweave.operators.cutoff import flag_ge_cutoff
    from logweave.operators.kmeans import class_mean_distance
    d = class_mean_distance(fx.matrix(spark, sf_dir), places=6).select("BlockId", "distance")
    from logweave import schemas
    return flag_ge_cutoff(d, "distance", contamination=schemas.CONTAMINATION_DEFAULT)


@register("flag_exact_n", _with(fx.CLASS_DIST_SQL) + f""",
n AS (SELECT count(*) AS N FROM dist),
b AS (SELECT greatest(1, least(CAST(round_even({_C} * N, 0) AS BIGINT), N)) AS k FROM n)
SELECT BlockId, distance,
       row_number() OVER (ORDER BY distance DESC, BlockId ASC) <= (SELECT k FROM b) AS is_anomaly
FROM dist""")
def q_flag_exact_n(spark, sf_dir):
    """Exactly n = round(c N) farthest blocks, ties by BlockId."""
    from logweave import schemas
    from logweave.operators.cutoff import flag_exact_n
    from logweave.operators.kmeans import class_mean_distance
    d = class_mean_distance(fx.matrix(spark, sf_dir), places=6).select("BlockId", "distance")
    return flag_exact_n(d, "distance", "BlockId", contamination=schemas.CONTAMINATION_DEFAULT)


# ------------------------------------------------ Spark ML (rows only) ---

DETECTED_AT = "2024-02-01T00:00:00+00:00"


# The seeds of the models decide which blocks they flag; what holds for every
# seed is compared: whole tables scored, budgets met, order of the scores.
_BUDGET_SQL = f""",
n AS (SELECT count(*) AS blocks, CAST(round_even({_C} * count(*), 0) AS BIGINT) AS raw FROM labelled),
k AS (SELECT blocks, greatest(1, least(raw, blocks)) AS exact,
             greatest(1, least(raw, greatest(1, blocks - 1))) AS clamped FROM n)"""


def _ordered(flag="is_anomaly", score="distance"):
    """Whether no unflagged row scores above a flagged one."""
    return (F.max(F.when(~F.col(flag), F.col(score))) <= F.min(F.when(F.col(flag), F.col(score)))).alias("ordered")


@register("kmeans_detector", _with(fx.MATRIX_SQL) + _BUDGET_SQL + """
SELECT blocks, true AS flags_reach_budget, 0::BIGINT AS not_nearest, true AS ordered, clamped AS budget FROM k""")
def q_kmeans_detector(spark, sf_dir):
    """K-means|| (k=8) on the standardised matrix, distance to the
    assigned centre, cutoff rule; summarised over all blocks."""
    from logweave import schemas
    from logweave.operators.cutoff import budget
    from logweave.operators.kmeans import flagged_rows
    flags = flagged_rows(fx.matrix(spark, sf_dir), 8, schemas.CONTAMINATION_DEFAULT, nearest=True)
    out = flags.agg(F.count(F.lit(1)).alias("blocks"), F.count_if("is_anomaly").alias("_flagged"),
                    F.count_if(F.col("distance") > F.col("nearest") + 1e-9).alias("not_nearest"), _ordered()).first()
    n = budget(schemas.CONTAMINATION_DEFAULT, out["blocks"])
    return spark.createDataFrame([(out["blocks"], out["_flagged"] >= n, out["not_nearest"], out["ordered"], n)],
                                 "blocks long, flags_reach_budget boolean, not_nearest long, ordered boolean, budget long")


@register("kmeans_exact_budget", _with(fx.MATRIX_SQL) + _BUDGET_SQL + """
SELECT blocks, exact AS flagged, true AS ordered FROM k""")
def q_kmeans_exact_budget(spark, sf_dir):
    """Exactly round(c N) farthest blocks flagged, summarised over all blocks."""
    from logweave.operators.kmeans import kmeans_exact_budget
    return kmeans_exact_budget(fx.matrix(spark, sf_dir), k=8).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("is_anomaly").alias("flagged"), _ordered())


@register("block_scores_summary", _with(fx.MATRIX_SQL) + _BUDGET_SQL + """
SELECT blocks, true AS flags_reach_budget, (SELECT count(DISTINCT BlockId) FROM labelled) AS distinct_blocks,
       (SELECT count_if(Label = 'Fail') FROM labelled) AS failed FROM k""")
def q_block_scores_summary(spark, sf_dir):
    """The per-block lookup table of K-Means flags and labels, summarised."""
    from logweave import schemas
    from logweave.operators.cutoff import budget
    from logweave.operators.kmeans import block_scores, model_summary
    scores = block_scores(fx.matrix(spark, sf_dir), k=8).checkpoint()
    r = model_summary(scores).first()
    n = budget(schemas.CONTAMINATION_DEFAULT, r["blocks"], clamp_below_total=False)
    return scores.agg(F.lit(r["blocks"]).alias("blocks"), F.lit(r["anomalies"] >= n).alias("flags_reach_budget"),
                      F.count_distinct("block_id").alias("distinct_blocks"),
                      F.count_if(F.col("true_label") == "Fail").alias("failed"))


# ------------------------------------------------------ anomaly table ---

ANOM_CTE = (LOGS_CTE.rstrip() + "," + fx.CLASS_DIST_SQL.rstrip() + "," + fx.LABELS_SQL.replace(
    "labels_src AS", "gt AS") + "," + fx.ANOM_SQL)
A_METHODS, A_SEARCH = "kmeans_distance,isolation_forest", "BLK_1"


def _anom(spark, sf_dir):
    return fx.anomalies(spark, sf_dir)


@register("anomaly_table", _with(ANOM_CTE) + " SELECT * FROM anom")
def q_anomaly_table(spark, sf_dir):
    """S11/K4/M11 shape: both anomaly shapes under one wide schema."""
    return _anom(spark, sf_dir)


@register("overview", _with(ANOM_CTE) + f""",
l AS (SELECT count(*) AS total_logs, count_if(level = 'ERROR') AS error_logs FROM logs
      WHERE ts >= TIMESTAMP '{F_START}' AND ts <= TIMESTAMP '{F_END}' AND level IN ({_LEVEL_LIST_SQL})),
a AS (SELECT count(*) AS total_anomalies, count_if(method = 'isolation_forest') AS if_anomalies
      FROM anom WHERE method IN ('kmeans_distance', 'isolation_forest')
        AND regexp_matches(coalesce(block_id, ''), '(?i){A_SEARCH}'))
SELECT * FROM l, a""")
def q_overview(spark, sf_dir):
    """A1 + F1-F5: log and anomaly counts under log and anomaly filters."""
    from logweave.operators.activity import overview
    from logweave.operators.filters import AnomalyFilter, LogFilter
    return overview(fx.logs(spark, sf_dir), _anom(spark, sf_dir),
                    LogFilter(start=F_START, end=F_END, levels=F_LEVELS),
                    AnomalyFilter(methods=A_METHODS, block_search=A_SEARCH))


@register("facets", _with(ANOM_CTE) + f"""
SELECT {_iso_sql('(SELECT min(ts) FROM logs)')} AS min_ts, {_iso_sql('(SELECT max(ts) FROM logs)')} AS max_ts,
  (SELECT string_agg(level, ',' ORDER BY level) FROM (SELECT DISTINCT level FROM logs)) AS levels,
  (SELECT string_agg(component, ',' ORDER BY component)
     FROM (SELECT DISTINCT component FROM logs ORDER BY component LIMIT 20)) AS components,
  (SELECT string_agg(method, ',' ORDER BY method) FROM (SELECT DISTINCT method FROM anom)) AS methods""")
def q_facets(spark, sf_dir):
    """A2: filter facets (time range, levels, first 20 components, methods)."""
    from logweave.operators.activity import facets
    return facets(fx.logs(spark, sf_dir), _anom(spark, sf_dir))


@register("method_counts", _with(ANOM_CTE) + " SELECT method, count(*) AS count FROM anom GROUP BY method")
def q_method_counts(spark, sf_dir):
    """Anomalies per detection method."""
    from logweave.operators.evaluate import method_counts
    return method_counts(_anom(spark, sf_dir))


@register("primary_method", _with(ANOM_CTE) + """
SELECT method AS primary_method, count(*) AS count FROM anom GROUP BY method
ORDER BY CASE method WHEN 'kmeans_distance' THEN 0 WHEN 'isolation_forest' THEN 1
         WHEN 'one_class_svm' THEN 2 WHEN 'statistical_threshold' THEN 4 ELSE 3 END, method
LIMIT 1""")
def q_primary_method(spark, sf_dir):
    """A10: the dashboard's primary ML method and its count."""
    from logweave.operators.evaluate import primary_method
    return primary_method(_anom(spark, sf_dir))


def _metrics_sql(where: str) -> str:
    return _with(ANOM_CTE) + f""",
a AS (SELECT * FROM anom WHERE {where}),
s AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE true_label IS NOT NULL) AS n_lab,
             count(*) FILTER (WHERE true_label = 'Fail') AS tp_lab, count(*) FILTER (WHERE true_label = 'Success') AS fp_lab,
             count(*) FILTER (WHERE method = 'isolation_forest') AS n_if,
             count(*) FILTER (WHERE method = 'isolation_forest' AND true_label = 'Fail') AS tp_if,
             count(*) FILTER (WHERE method = 'isolation_forest' AND true_label = 'Success') AS fp_if FROM a),
g AS (SELECT count(*) FILTER (WHERE Label = 'Anomaly') AS actual, count(*) AS blocks FROM gt),
c AS (SELECT n_all > 0 AS has_data,
             CASE WHEN n_lab > 0 THEN n_lab ELSE n_if END AS detected,
             CASE WHEN n_lab > 0 THEN tp_lab ELSE tp_if END AS tp,
             CASE WHEN n_lab > 0 THEN fp_lab ELSE fp_if END AS fp, actual, blocks FROM s, g),
d AS (SELECT *, has_data AND detected > 0 AS has_labels,
             CASE WHEN detected > 0 THEN CAST(tp AS DOUBLE) / detected ELSE 0.0 END AS prec,
             CASE WHEN actual > 0 THEN CAST(tp AS DOUBLE) / actual ELSE 0.0 END AS rec FROM c)
SELECT has_data, has_labels, has_labels AS has_full_metrics,
       CASE WHEN has_labels THEN detected END AS detected, CASE WHEN has_labels THEN tp END AS tp,
       CASE WHEN has_labels THEN fp END AS fp,
       CASE WHEN has_labels THEN round_even(prec, 4) END AS precision,
       CASE WHEN has_labels THEN actual - tp END AS fn,
       CASE WHEN has_labels THEN blocks - actual - fp END AS tn,
       CASE WHEN has_labels THEN round_even(rec, 4) END AS recall,
       CASE WHEN has_labels THEN round_even(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec)
                                                 ELSE 0.0 END, 4) END AS f1
FROM d"""


def _metrics(spark, sf_dir, methods=None):
    from logweave.operators.evaluate import detection_metrics
    from logweave.operators.filters import AnomalyFilter
    return detection_metrics(_anom(spark, sf_dir), fx.labels(spark, sf_dir),
                             AnomalyFilter(methods=methods))


@register("detection_metrics", _metrics_sql("true"))
def q_detection_metrics(spark, sf_dir):
    """Precision over labelled rows; recall/F1 with ground truth."""
    return _metrics(spark, sf_dir)


@register("detection_metrics_unlabelled", _metrics_sql("method = 'isolation_forest'"))
def q_detection_metrics_unlabelled(spark, sf_dir):
    """Only unlabelled isolation-forest rows -> fallback subset."""
    return _metrics(spark, sf_dir, "isolation_forest")


_REPLY_SQL = """
SELECT m.*, CASE WHEN has_full_metrics THEN format('{}/{}/{}/{}', tp, fn, fp, tn) END AS confusion,
       CASE WHEN has_data AND NOT has_labels THEN (SELECT string_agg(method || '=' || n, ',' ORDER BY method)
         FROM (SELECT method, count(*) AS n FROM a GROUP BY method)) END AS counts FROM m"""


def _reply(spark, sf_dir, methods=None, labelled=True):
    from logweave.operators.evaluate import metrics_reply
    from logweave.operators.filters import AnomalyFilter
    anom = _anom(spark, sf_dir)
    if not labelled:
        anom = anom.withColumn("true_label", F.lit(None).cast("string"))
    r = metrics_reply(anom, fx.labels(spark, sf_dir), AnomalyFilter(methods=methods))
    counts = F.array_join(F.transform("method_counts", lambda x: F.concat(x["method"], F.lit("="), x["count"])), ",")
    return r.select("*", F.array_join(F.flatten("confusion_matrix"), "/").alias("confusion"),
                    counts.alias("counts")).drop("confusion_matrix", "method_counts")


def _reply_sql(where: str) -> str:
    head, tail = _metrics_sql(where).split("\nSELECT has_data, has_labels,", 1)
    return head + ",\nm AS (SELECT has_data, has_labels," + tail + ")" + _REPLY_SQL


@register("detection_metrics_reply", _reply_sql("true"))
def q_detection_metrics_reply(spark, sf_dir):
    """The whole reply with its confusion matrix."""
    return _reply(spark, sf_dir)


@register("detection_metrics_no_labels", _reply_sql("true").replace("anom AS (", "anom0 AS (", 1).replace(
    "\na AS (SELECT * FROM anom WHERE", "\nanom AS (SELECT * REPLACE (NULL::VARCHAR AS true_label) FROM anom0),"
    "\na AS (SELECT * FROM anom WHERE").replace("has_data AND detected > 0 AS has_labels", "false AS has_labels"))
def q_detection_metrics_no_labels(spark, sf_dir):
    """An anomaly table without any true label answers with its method counts."""
    return _reply(spark, sf_dir, labelled=False)


@register("health_status", _metrics_sql("true").replace("\nSELECT has_data, has_labels,", ",\nm AS (SELECT has_data, has_labels,", 1).rstrip() + """)
SELECT *, CASE WHEN NOT has_data THEN 'ok'
               WHEN coalesce(precision, 1.0) < 0.6 THEN 'critical'
               WHEN coalesce(detected, 0) > 5000 OR coalesce(precision, 1.0) < 0.8 THEN 'warn'
               ELSE 'ok' END AS status,
       CASE WHEN coalesce(detected, 0) > 0 THEN CAST(tp AS DOUBLE) / detected * 100.0 END AS tp_pct,
       CASE WHEN coalesce(detected, 0) > 0 THEN CAST(fp AS DOUBLE) / detected * 100.0 END AS fp_pct
FROM m""")
def q_health_status(spark, sf_dir):
    """Status banner state and tp / fp shares."""
    from logweave.operators.evaluate import health_status
    return health_status(_metrics(spark, sf_dir))


_RESULT_SQL = ("CASE true_label WHEN 'Fail' THEN 'True Positive' WHEN 'Success' THEN 'False Positive' "
               "ELSE 'Unknown' END")


@register("detection_timeline", _with(ANOM_CTE) + f""",
t AS (SELECT date_trunc('hour', CAST(substr(detected_at, 1, 19) AS TIMESTAMP)) AS b,
             {_RESULT_SQL} AS r FROM anom)
SELECT {_iso_sql('b')} AS time, count_if(r = 'False Positive') AS "False Positive",
       count_if(r = 'True Positive') AS "True Positive", count_if(r = 'Unknown') AS "Unknown"
FROM t GROUP BY b""")
def q_detection_timeline(spark, sf_dir):
    """Detections per hour and outcome."""
    from logweave.operators.evaluate import detection_timeline
    return detection_timeline(_anom(spark, sf_dir))


@register("outcome_share", _with(ANOM_CTE) + f"""
SELECT {_RESULT_SQL} AS result, count(*) AS count FROM anom
WHERE true_label IN ('Fail', 'Success') GROUP BY 1""")
def q_outcome_share(spark, sf_dir):
    """True vs false positives."""
    from logweave.operators.evaluate import outcome_share
    return outcome_share(_anom(spark, sf_dir))


@register("spike_series", _with(ANOM_CTE) + f"""
SELECT {_iso_sql('CAST(minute AS TIMESTAMP)')} || '+00:00' AS time,
       coalesce(error_count, 0) AS error_count
FROM anom WHERE method = 'statistical_threshold' AND TRY_CAST(minute AS TIMESTAMP) IS NOT NULL""")
def q_spike_series(spark, sf_dir):
    """The stored spikes as a time series."""
    from logweave.operators.spikes import spike_series
    return spike_series(_anom(spark, sf_dir))


_APAGE_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in
                         ["detected_at", "method", "block_id", "minute", "true_label", "error_count"])
_CORRECT_SQL = ("CASE true_label WHEN 'Fail' THEN 'True Positive' WHEN 'Success' THEN "
                "'False Positive' END")


@register("anomaly_page", _with(ANOM_CTE) + f""",
a AS (SELECT method, block_id, true_label, {_CORRECT_SQL} AS correct, minute, error_count, detected_at
      FROM anom)
SELECT *, (SELECT count(*) FROM a) AS total, CAST(ceil((SELECT count(*) FROM a) / 50.0) AS BIGINT) AS pages
FROM a ORDER BY {_APAGE_ORDER} LIMIT 500 OFFSET 50""")
def q_anomaly_page(spark, sf_dir):
    """Anomaly records page (offset 50, limit 500) with totals."""
    from logweave.operators.evaluate import anomaly_page
    return anomaly_page(_anom(spark, sf_dir), limit=500, offset=50)


@register("anomaly_page_true_positives", _with(ANOM_CTE) + f""",
a AS (SELECT method, block_id, true_label, {_CORRECT_SQL} AS correct, minute, error_count, detected_at
      FROM anom WHERE method IN ('kmeans_distance', 'isolation_forest')
        AND regexp_matches(coalesce(block_id, ''), '(?i){A_SEARCH}')),
b AS (SELECT * FROM a WHERE correct = 'True Positive')
SELECT *, (SELECT count(*) FROM b) AS total, CAST(ceil((SELECT count(*) FROM b) / 50.0) AS BIGINT) AS pages
FROM b ORDER BY {_APAGE_ORDER} LIMIT 100""")
def q_anomaly_page_tp(spark, sf_dir):
    """Filtered page of true positives (chip applied before paging)."""
    from logweave.operators.evaluate import anomaly_page
    from logweave.operators.filters import AnomalyFilter
    return anomaly_page(_anom(spark, sf_dir), AnomalyFilter(methods=A_METHODS, block_search=A_SEARCH),
                        limit=100, offset=0, chip="True Positive")


def _class_flags(spark, sf_dir, clamp=True):
    from logweave import schemas
    from logweave.operators.cutoff import flag_ge_cutoff
    from logweave.operators.kmeans import class_mean_distance
    return flag_ge_cutoff(class_mean_distance(fx.matrix(spark, sf_dir), places=6), "distance",
                          contamination=schemas.CONTAMINATION_DEFAULT, clamp_below_total=clamp)


@register("detect_lookup", _with(ANOM_CTE) + """,
k AS (SELECT greatest(1, CAST(round_even((16838.0 / 575061.0) * count(*), 0) AS BIGINT)) AS k FROM dist),
fl AS (SELECT BlockId, Label FROM (SELECT *, rank() OVER (ORDER BY distance DESC) AS rk FROM dist)
       WHERE rk <= (SELECT k FROM k))
SELECT 'kmeans_distance' AS method, s.block_id, fl.Label AS true_label
FROM (SELECT DISTINCT block_id FROM logs WHERE block_id IS NOT NULL) s JOIN fl ON s.block_id = fl.BlockId""")
def q_detect_lookup(spark, sf_dir):
    """Log blocks looked up in the flagged block-score table."""
    from logweave.operators.evaluate import lookup_detect
    scores = _class_flags(spark, sf_dir, clamp=False).select(
        F.col("BlockId").alias("block_id"), "is_anomaly", F.col("Label").alias("true_label"))
    return lookup_detect(fx.logs(spark, sf_dir), scores, DETECTED_AT).drop("detected_at")


_FLAGS_SQL = """,
fl AS (SELECT CASE WHEN Label = 'Fail' THEN 1 ELSE 0 END AS y_true,
              CASE WHEN rank() OVER (ORDER BY distance DESC) <= (SELECT k FROM cut) THEN 1 ELSE 0 END AS y_pred
       FROM dist),
cm AS (SELECT count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
              count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn FROM fl)"""


def _flags_binary(spark, sf_dir):
    f = _class_flags(spark, sf_dir)
    return f.select((F.col("Label") == "Fail").cast("int").alias("y_true"),
                    F.col("is_anomaly").cast("int").alias("y_pred"))


@register("binary_metrics", _with(ANOM_CTE) + _FLAGS_SQL + """
SELECT CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN tp > 0 THEN 2 * (CAST(tp AS DOUBLE) / (tp + fp)) * (CAST(tp AS DOUBLE) / (tp + fn))
                 / ((CAST(tp AS DOUBLE) / (tp + fp)) + (CAST(tp AS DOUBLE) / (tp + fn))) ELSE 0.0 END AS f1,
       tp, fp, fn, tn FROM cm""")
def q_binary_metrics(spark, sf_dir):
    """Confusion counts and P/R/F1 of the cutoff flags vs labels."""
    from logweave.operators.evaluate import binary_metrics
    return binary_metrics(_flags_binary(spark, sf_dir))


def _prf(tp, fp, fn):
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fp}) ELSE 0.0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) ELSE 0.0 END)"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return p, r, f


_PN, _RN, _FN = _prf("tn", "fn", "fp")
_PA, _RA, _FA = _prf("tp", "fp", "fn")


@register("classification_report", _with(ANOM_CTE) + _FLAGS_SQL + f""",
t AS (SELECT tp + fp + fn + tn AS total, tn + fp AS sn, tp + fn AS sa, * FROM cm)
SELECT 'Normal' AS class, {_PN} AS precision, {_RN} AS recall, {_FN} AS f1, sn AS support FROM t
UNION ALL SELECT 'Anomaly', {_PA}, {_RA}, {_FA}, sa FROM t
UNION ALL SELECT 'accuracy', NULL, NULL, CAST(tp + tn AS DOUBLE) / total, total FROM t
UNION ALL SELECT 'macro avg', ({_PN} + {_PA}) / 2, ({_RN} + {_RA}) / 2, ({_FN} + {_FA}) / 2, total FROM t
UNION ALL SELECT 'weighted avg', ({_PN} * sn + {_PA} * sa) / total, ({_RN} * sn + {_RA} * sa) / total,
                 ({_FN} * sn + {_FA} * sa) / total, total FROM t""")
def q_classification_report(spark, sf_dir):
    """Per-class report and averages of the cutoff flags vs labels."""
    from logweave.operators.evaluate import classification_report
    return classification_report(_flags_binary(spark, sf_dir))


# ------------------------------------------------------------- streaming ---

DEC_CTE = fx.LOG_LINES_SQL + f""",
env AS (SELECT event_id,
          CASE WHEN event_id % 17 = 0
               THEN substr(to_json({{'ingested_at': '{fx.ENVELOPE_AT}', 'source_file': 'events.log',
                                     'payload': {{'raw': raw}}}})::VARCHAR, 1, 20)
               ELSE to_json({{'ingested_at': '{fx.ENVELOPE_AT}', 'source_file': 'events.log',
                              'payload': {{'raw': raw}}}})::VARCHAR END AS value
        FROM log_lines),
dec AS (SELECT value->>'$.ingested_at' AS ingested_at, value->>'$.source_file' AS source_file,
               coalesce(value->>'$.payload.raw', '') AS raw
        FROM env WHERE json_valid(value)),
dp AS (SELECT ingested_at, source_file, raw,
              regexp_extract(trim(raw), '{fx._RE}', 1) AS date,
              regexp_extract(trim(raw), '{fx._RE}', 2) AS time,
              regexp_extract(trim(raw), '{fx._RE}', 4) AS level,
              regexp_extract(trim(raw), '{fx._RE}', 5) AS component,
              regexp_extract(trim(raw), '{fx._RE}', 6) AS message,
              regexp_extract_all(regexp_extract(trim(raw), '{fx._RE}', 6), 'blk_[+-]?\\d+')[1] AS block_id
       FROM dec WHERE regexp_matches(trim(raw), '{fx._RE}'))"""


def _stream_source(spark, sf_dir, part=None):
    from logweave.streaming.ingest import parse_envelopes
    return parse_envelopes(_stream_values(spark, sf_dir, part))


def _stream_values(spark, sf_dir, part=None):
    from logweave.streaming.ingest import file_values
    return file_values(spark, fx.envelope_files(spark, sf_dir, part), 4)


@register("stream_parse", _with(DEC_CTE) + """
SELECT ingested_at, source_file, raw, level, component, message, block_id FROM dp""")
def q_stream_parse(spark, sf_dir):
    """Envelope file stream (four files per trigger) parsed into
    the stored log table; the table read back."""
    from logweave.session import scratch_path
    from logweave.streaming.ingest import start_ingest
    out, ck = scratch_path(spark, "parsed_logs"), scratch_path(spark, "ckpt-ingest")
    start_ingest(_stream_values(spark, sf_dir), out, ck, available_now=True).awaitTermination()
    from logweave.sources.tables import read_parsed_logs
    return read_parsed_logs(spark, out).select("ingested_at", "source_file", "raw", "level",
                                               "component", "message", "block_id")


_PARSED_COLS = ["ingested_at", "source_file", "raw", "level", "component", "message", "block_id"]


@register("stream_restart_parse", _with(DEC_CTE) + """
SELECT ingested_at, source_file, raw, level, component, message, block_id FROM dp
UNION ALL SELECT '2024-03-01T00:00:00+00:00', 'bulk.log', raw, level, component, message, block_id
FROM dp WHERE level = 'FATAL'""")
def q_stream_restart_parse(spark, sf_dir):
    """Two runs with checkpoints of their own, each over half of the
    files, and a bulk load of a raw log, all into one table."""
    from logweave.session import scratch_path
    from logweave.sources.tables import read_parsed_logs
    from logweave.streaming.ingest import bulk_ingest, start_ingest
    out, log = scratch_path(spark, "parsed_logs"), scratch_path(spark, "bulk")
    for part in (0, 1):
        ck = scratch_path(spark, "ckpt-ingest")
        start_ingest(_stream_values(spark, sf_dir, part), out, ck, available_now=True).awaitTermination()
    read_parsed_logs(spark, out).where("level = 'FATAL'").select("raw").write.text(log)
    bulk_ingest(spark, log, out, source_name="bulk.log", ingested_at="2024-03-01T00:00:00+00:00")
    return read_parsed_logs(spark, out).select(*_PARSED_COLS)


_UPSERT_SQL = _with(DEC_CTE.rstrip() + "," + fx.CLASS_DIST_SQL) + """,
k AS (SELECT greatest(1, CAST(round_even((16838.0 / 575061.0) * count(*), 0) AS BIGINT)) AS k FROM dist),
fl AS (SELECT BlockId, Label FROM (SELECT *, rank() OVER (ORDER BY distance DESC) AS rk FROM dist)
       WHERE rk <= (SELECT k FROM k))
SELECT 'kmeans_distance' AS method, s.block_id, fl.Label AS true_label, s.detected_at
FROM (SELECT block_id, min(ingested_at) AS detected_at FROM dp WHERE block_id IS NOT NULL
      GROUP BY block_id) s JOIN fl ON s.block_id = fl.BlockId"""
_ANOM_COLS = ["method", "block_id", "true_label", "detected_at"]


def _flagged_table(spark, sf_dir):
    from logweave.session import scratch_path
    path = scratch_path(spark, "block_scores")
    flags = _class_flags(spark, sf_dir, clamp=False)
    (flags.filter(F.col("is_anomaly")).select(F.col("BlockId").alias("block_id"), F.col("Label").alias("true_label"))
     .write.parquet(path))
    return spark.read.parquet(path)


@register("stream_detect_upsert", _UPSERT_SQL)
def q_stream_detect_upsert(spark, sf_dir):
    """Stream-static lookup of flagged blocks, insert-if-absent
    per micro-batch (first detection kept, replay-safe)."""
    from logweave.session import scratch_path
    from logweave.streaming.detect import read_stored, start_detection
    target, ck = scratch_path(spark, "anomalies-stream"), scratch_path(spark, "ckpt-detect")
    start_detection(_stream_source(spark, sf_dir), _flagged_table(spark, sf_dir), target, ck,
                    available_now=True).awaitTermination()
    return read_stored(spark, target).select(*_ANOM_COLS)


@register("stream_restart_upsert", _UPSERT_SQL)
def q_stream_restart_upsert(spark, sf_dir):
    """Three runs with new checkpoints (each half of the files, then all
    again) into one table: each (method, block) once."""
    from logweave.session import scratch_path
    from logweave.streaming.detect import read_stored, start_detection
    target, flagged = scratch_path(spark, "anomalies-stream"), _flagged_table(spark, sf_dir)
    for part in (0, 1, None):
        start_detection(_stream_source(spark, sf_dir, part), flagged, target, scratch_path(spark, "ckpt-detect"),
                        available_now=True).awaitTermination()
    return read_stored(spark, target).select(*_ANOM_COLS)


@register("stream_ingest_detect", _UPSERT_SQL + """
UNION ALL SELECT 'stored lines', level, NULL, CAST(count(*) AS VARCHAR) FROM dp GROUP BY level""")
def q_stream_ingest_detect(spark, sf_dir):
    """One query parses each envelope once, stores the logs and
    detects; the anomalies, and the stored lines per level."""
    from logweave.session import scratch_path
    from logweave.sources.tables import read_parsed_logs
    from logweave.streaming.detect import read_stored
    from logweave.streaming.ingest import start_ingest_detect
    logs, found = scratch_path(spark, "parsed_logs"), scratch_path(spark, "anomalies-stream")
    start_ingest_detect(_stream_values(spark, sf_dir), _flagged_table(spark, sf_dir), logs, found,
                        scratch_path(spark, "ckpt-both"), available_now=True).awaitTermination()
    lines = read_parsed_logs(spark, logs).groupBy("level").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return read_stored(spark, found).select(*_ANOM_COLS).unionByName(lines.select(
        F.lit("stored lines").alias("method"), F.col("level").alias("block_id"),
        F.lit(None).cast("string").alias("true_label"), F.col("n").alias("detected_at")))


@register("stream_timeseries", _with(DEC_CTE) + f""",
t AS (SELECT level, {fx.TS_SQL} AS ts FROM dp)
SELECT {_iso_sql("to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP")} AS time, level,
       count(*) AS count
FROM t WHERE ts IS NOT NULL GROUP BY 1, 2""")
def q_stream_timeseries(spark, sf_dir):
    """5-minute counts per level, added up batch by batch over files that
    arrive out of order; the result equals the batch series."""
    from logweave.session import scratch_path
    from logweave.streaming.live import read_live_counts, start_live_counts
    target, ck = scratch_path(spark, "live-counts"), scratch_path(spark, "ckpt-live")
    q = start_live_counts(_stream_source(spark, sf_dir), target, ck, available_now=True)
    q.awaitTermination()
    return read_live_counts(spark, target)


# -------------------------------------------- other detectors (rows only) ---

@register("isolation_forest_detector", _with(fx.MATRIX_SQL) + f"""
SELECT count(*) AS blocks, true AS flags_within_share, 0::BIGINT AS layout_differences FROM labelled""")
def q_isolation_forest(spark, sf_dir):
    """M7: isolation forest (100 trees of 256 rows) on the standardised matrix,
    fitted twice on differently partitioned rows; summarised over all blocks."""
    import math

    from logweave import schemas
    from logweave.operators.iforest import isolation_forest_flags
    from logweave.operators.kmeans import standardize
    z = standardize(fx.matrix(spark, sf_dir).checkpoint())
    cols = [f"z_{c}" for c in schemas.FEATURE_COLS]
    one, two = [isolation_forest_flags(x, cols, ["BlockId"]).select("BlockId", F.col("is_anomaly").alias(name))
                for x, name in ((z, "a"), (z.repartition(5, "Label"), "b"))]
    r = one.join(two, "BlockId").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("flagged"),
                                     F.count_if(F.col("a") != F.col("b")).alias("differ")).first()
    share = math.ceil(schemas.CONTAMINATION_DEFAULT * max(r["n"] - 1, 0))
    return spark.createDataFrame([(r["n"], 0 < r["flagged"] <= share, r["differ"])],
                                 "blocks long, flags_within_share boolean, layout_differences long")


@register("one_class_detector", _with(fx.MATRIX_SQL) + f"""
SELECT count(*) AS blocks, true AS flags_within_share FROM labelled""")
def q_one_class(spark, sf_dir):
    """M8: one-class boundary (random Fourier features, distributed gradient
    passes), summarised over all blocks; some are flagged, at most the share nu."""
    import math

    from logweave import schemas
    from logweave.operators.kmeans import standardize
    from logweave.operators.ocsvm import one_class_flags
    z = standardize(fx.matrix(spark, sf_dir).checkpoint())
    flags = one_class_flags(z, [f"z_{c}" for c in schemas.FEATURE_COLS], ["BlockId"])
    r = flags.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("flagged")).first()
    return spark.createDataFrame([(r["n"], 0 < r["flagged"] <= math.ceil(schemas.CONTAMINATION_DEFAULT * r["n"]))],
                                 "blocks long, flags_within_share boolean")


@register("compare_models", _with(fx.MATRIX_SQL) + """,
t AS (SELECT count(*) AS blocks, count_if(Label = 'Fail') AS actual FROM labelled)
SELECT m.model, blocks, actual,
       CASE WHEN exact THEN greatest(1, least(CAST(round_even(CAST(actual AS DOUBLE) / blocks * blocks, 0) AS BIGINT), blocks))
       END AS flagged
FROM t, (VALUES ('K-Means distance (k=8)', true), ('One-class boundary (random Fourier features)', false),
                ('Isolation Forest', false)) m(model, exact)""")
def q_compare_models(spark, sf_dir):
    """Three models at the labelled share; per model the blocks,
    the labelled anomalies and, where the budget is exact, the flags."""
    from logweave.operators.compare import compare_models
    out = compare_models(fx.matrix(spark, sf_dir), k=8, empirical=True)
    return out.select("model", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("blocks"),
                      (F.col("tp") + F.col("fn")).alias("actual"),
                      F.when(F.col("model").startswith("K-Means"), F.col("tp") + F.col("fp")).alias("flagged"))


@register("refresh_anomalies", _with(LOGS_CTE.rstrip() + "," + fx.MATRIX_SQL) + _BUDGET_SQL + f""",
c AS (SELECT to_timestamp(floor(epoch(ts) / 60) * 60)::TIMESTAMP AS b, count(*) AS error_count
      FROM logs WHERE level IN ('ERROR', 'WARN') GROUP BY 1),
s AS (SELECT avg(error_count) + 2 * stddev_samp(error_count) AS thr FROM c)
SELECT 'statistical_threshold' AS method, {_iso_sql('b')} AS minute, error_count FROM c, s WHERE error_count > thr
UNION ALL SELECT 'kmeans_distance reaches budget', NULL, clamped FROM k""")
def q_refresh_anomalies(spark, sf_dir):
    """The batch job replaces an anomaly table in the shared folder,
    twice; its spike rows, and whether the K-Means rows reach their budget."""
    from logweave import schemas
    from logweave.operators.batch import detect_batch
    from logweave.operators.cutoff import budget
    from logweave.session import scratch_path
    from logweave.sources.tables import read_anomalies
    path, logs = scratch_path(spark, "anomalies-refresh"), fx.logs(spark, sf_dir)
    matrix = fx.matrix(spark, sf_dir).checkpoint()      # both runs and the count read it
    for _ in range(2):
        detect_batch(matrix, logs, path, DETECTED_AT, k=8)
    rows = read_anomalies(spark, path)
    n = budget(schemas.CONTAMINATION_DEFAULT, matrix.count())
    kmeans = rows.where(F.col("method") == schemas.METHOD_KMEANS).agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") >= n, F.lit("kmeans_distance reaches budget")).otherwise("too few").alias("method"),
        F.lit(None).cast("string").alias("minute"), F.lit(n).cast("long").alias("error_count"))
    return rows.where(F.col("method") == schemas.METHOD_SPIKE).select("method", "minute", "error_count") \
        .unionByName(kmeans)


# ------------------------------------------------------------ CSV records ---

@register("csv_record_keys", """
SELECT 'blk_' || CAST(o_orderkey AS VARCHAR) AS BlockId,
       coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'blk_' || CAST(o_orderkey AS VARCHAR) END, ''),
                nullif(CASE WHEN o_orderpriority LIKE '2%' THEN '' ELSE 'blk_c' || CAST(o_custkey AS VARCHAR) END, ''),
                nullif('blk_x' || CAST(o_orderkey AS VARCHAR), '')) AS key
FROM orders""")
def q_csv_record_keys(spark, sf_dir):
    """Header CSV (written from orders) read back as strings; key = first
    non-empty of block_id, BlockId, blk_id."""
    from logweave.session import scratch_path
    from logweave.sources.files import read_records
    o = fx.table(spark, sf_dir, "orders")
    oid = F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string"))
    rec = o.select(
        oid.alias("RowId"),
        F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(oid).alias("block_id"),
        F.when(F.col("o_orderpriority").startswith("2"), F.lit(""))
         .otherwise(F.concat(F.lit("blk_c"), F.col("o_custkey").cast("string"))).alias("BlockId"),
        F.concat(F.lit("blk_x"), F.col("o_orderkey").cast("string")).alias("blk_id"))
    path = scratch_path(spark, "records") + ".csv"
    rec.write.option("header", True).csv(path)
    return read_records(spark, path, "auto").select(F.col("RowId").alias("BlockId"), "key")


@register("stored_logs_filtered", _with(LOGS_CTE) + f"""
SELECT {_iso_sql('ts')} AS ts, level, component, block_id FROM logs WHERE {_FILTER_SQL}""")
def q_stored_logs_filtered(spark, sf_dir):
    """Parsed logs appended to a table partitioned by event day,
    read back with the time range pruning partitions (``dt``) before the scan."""
    from logweave.functions.timefmt import iso
    from logweave.session import scratch_path
    from logweave.sources.sinks import append_logs
    from logweave.sources.tables import log_view, read_parsed_logs
    path = scratch_path(spark, "parsed_logs")
    append_logs(fx.parsed_logs(spark, sf_dir), path)
    df = _log_filter().apply(log_view(read_parsed_logs(spark, path)))
    return df.select(iso(F.col("ts")).alias("ts"), "level", "component", "block_id")


@register("stream_error_rate", _with(DEC_CTE) + f""",
t AS (SELECT level, {fx.TS_SQL} AS ts FROM dp)
SELECT {_iso_sql("to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP")} AS time,
       round_even(CAST(count_if(level = 'ERROR') AS DOUBLE) / count(*) * 100.0, 2) AS error_rate
FROM t WHERE ts IS NOT NULL GROUP BY 1""")
def q_stream_error_rate(spark, sf_dir):
    """Error rate per 5-minute bucket from the live counts."""
    from logweave.session import scratch_path
    from logweave.streaming.live import live_error_rate, read_live_counts, start_live_counts
    target, ck = scratch_path(spark, "live-counts"), scratch_path(spark, "ckpt-live")
    q = start_live_counts(_stream_source(spark, sf_dir), target, ck, available_now=True)
    q.awaitTermination()
    return live_error_rate(read_live_counts(spark, target))


# ------------------------------------------------- under filters, and files ---

_FLOGS = f""",
fl AS (SELECT * FROM logs WHERE {_FILTER_SQL})"""


@register("timeseries_filtered", _with(LOGS_CTE) + _FLOGS + f""",
b AS (SELECT {_iso_sql(_BUCKET_1H)} AS time, {_level_sql(FILTERED_LEVELS)} FROM fl)
SELECT * FROM (PIVOT b ON level IN {_levels(FILTERED_LEVELS)} USING count(*) GROUP BY time)""")
def q_timeseries_filtered(spark, sf_dir):
    """A3 under F1-F3: hourly lines per level of the filtered logs."""
    from logweave.operators.activity import timeseries
    return timeseries(_log_filter().apply(fx.logs(spark, sf_dir)), "1h")


@register("error_rate_filtered", _with(LOGS_CTE) + _FLOGS + f"""
SELECT {_iso_sql(_BUCKET_1H)} AS time,
       round_even(CAST(count_if(level = 'ERROR') AS DOUBLE) / count(*) * 100.0, 2) AS error_rate
FROM fl GROUP BY 1""")
def q_error_rate_filtered(spark, sf_dir):
    """A4 under F1-F3: the totals are those of the filtered lines."""
    from logweave.operators.activity import error_rate
    return error_rate(_log_filter().apply(fx.logs(spark, sf_dir)), "1h", rounded=True)


@register("components_filtered", _with(LOGS_CTE) + _FLOGS + f""",
cl AS (SELECT component, {_level_sql(FILTERED_LEVELS)} FROM fl),
top AS (SELECT component, count(*) AS total FROM fl GROUP BY component ORDER BY total DESC, component LIMIT 3)
SELECT p.*, total FROM top JOIN """ + _pivot(FILTERED_LEVELS) + " USING (component)")
def q_components_filtered(spark, sf_dir):
    """A5 under F1-F3: the three busiest components of the filtered lines."""
    from logweave.operators.activity import components
    return components(_log_filter().apply(fx.logs(spark, sf_dir)), 3)


@register("heatmap_filtered", _with(LOGS_CTE) + _FLOGS + f""",
agg AS (SELECT component, count(level) AS n, count_if(level IN ('ERROR', 'WARN')) AS ew, {_HOUR_CELLS_SQL}
        FROM fl GROUP BY component),
top AS (SELECT * FROM agg ORDER BY n DESC, component LIMIT 10)
SELECT * EXCLUDE (n, ew) FROM top WHERE ew > 0""")
def q_heatmap_filtered(spark, sf_dir):
    """A6 under F1-F3."""
    from logweave.operators.activity import heatmap
    return heatmap(_log_filter().apply(fx.logs(spark, sf_dir)), 10)


_LOOSE_SQL = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 07:30:00'"


@register("stored_logs_loose_dates", _with(LOGS_CTE) + f"""
SELECT {_iso_sql('ts')} AS ts, level, component, block_id FROM logs WHERE {_LOOSE_SQL}""")
def q_stored_logs_loose_dates(spark, sf_dir):
    """F1 on a stored table: an unpadded start and an end with a zone offset."""
    from logweave.functions.timefmt import iso
    from logweave.operators.filters import LogFilter
    from logweave.session import scratch_path
    from logweave.sources.sinks import append_logs
    from logweave.sources.tables import log_view, read_parsed_logs
    path = scratch_path(spark, "parsed_logs")
    append_logs(fx.parsed_logs(spark, sf_dir), path)
    df = LogFilter(start="2024-1-5", end="2024-01-19T23:30:00-08:00").apply(log_view(read_parsed_logs(spark, path)))
    return df.select(iso(F.col("ts")).alias("ts"), "level", "component", "block_id")


@register("raw_log_files", _with(LOGS_CTE) + """
SELECT level, component, block_id, count(*) AS lines FROM parsed_ids GROUP BY ALL""")
def q_raw_log_files(spark, sf_dir):
    """The rendered lines written as text files, bulk-loaded into the
    stored table and read back; lines per level, component and block."""
    from logweave.session import scratch_path
    from logweave.sources.tables import read_parsed_logs
    from logweave.streaming.ingest import bulk_ingest
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "parsed_logs")
    fx.log_lines(spark, sf_dir).select("raw").write.text(raw)
    bulk_ingest(spark, raw, out, ingested_at=DETECTED_AT)
    return read_parsed_logs(spark, out).groupBy("level", "component", "block_id").agg(F.count(F.lit(1)).alias("lines"))


# ------------------------------------ live views, stored tables under load ---

# The logs of the stream, in place of the rendered ones.
SLOGS_CTE = DEC_CTE + f""",
logs AS (SELECT * FROM (SELECT level, component, block_id, {fx.TS_SQL} AS ts FROM dp) WHERE ts IS NOT NULL)"""


def _streamed(key: str) -> str:
    """The SQL of a log query, over the lines of the stream."""
    return ORACLE[key].replace(_with(LOGS_CTE), _with(SLOGS_CTE), 1)


def _rollup(spark, sf_dir) -> str:
    """Two runs of the rollup stream, each over half of the files; folded after the first."""
    from logweave.session import scratch_path
    from logweave.streaming.live import compact_rollup, start_rollup
    target = scratch_path(spark, "rollup")
    for part in (0, 1):
        start_rollup(_stream_source(spark, sf_dir, part), target, scratch_path(spark, "ckpt-rollup"),
                     available_now=True).awaitTermination()
        if part == 0:
            compact_rollup(spark, target)
    return target


@register("stream_components", _streamed("components_top20"))
def q_stream_components(spark, sf_dir):
    """Top components from the rollups of the stream."""
    from logweave.operators.activity import components
    from logweave.streaming.live import live_logs
    return components(live_logs(spark, _rollup(spark, sf_dir)), 20)


@register("stream_heatmap", _streamed("heatmap_top10"))
def q_stream_heatmap(spark, sf_dir):
    """Component by hour heatmap from the rollups."""
    from logweave.operators.activity import heatmap
    from logweave.streaming.live import live_logs
    return heatmap(live_logs(spark, _rollup(spark, sf_dir)), 10)


@register("stream_snapshot", _streamed("snapshot"))
def q_stream_snapshot(spark, sf_dir):
    """Snapshot from the rollups; distinct blocks from merged sketches."""
    from logweave.streaming.live import live_snapshot
    return live_snapshot(spark, _rollup(spark, sf_dir))


@register("stream_spikes", _streamed("error_spikes_minute"))
def q_stream_spikes(spark, sf_dir):
    """Error spikes from the rollups: a minute's count is the sum over batches."""
    from logweave.operators.spikes import error_spikes
    from logweave.streaming.live import live_logs
    return error_spikes(live_logs(spark, _rollup(spark, sf_dir)), seconds=60)


@register("stream_views", _with(SLOGS_CTE) + f""",
l AS (SELECT * FROM logs WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'
      AND level IN ({_LEVEL_LIST_SQL}))
SELECT 'series' AS view, {_iso_sql(_BUCKET_1H)} AS name, level, count(*)::DOUBLE AS value FROM l GROUP BY 2, 3
UNION ALL SELECT 'rate', {_iso_sql(_BUCKET_1H)}, NULL,
  round_even(CAST(count_if(level = 'ERROR') AS DOUBLE) / count(*) * 100.0, 2) FROM l GROUP BY 2
UNION ALL SELECT 'mix', NULL, level, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM l) * 100.0 FROM l GROUP BY 3
UNION ALL SELECT 'overview', 'total_logs', NULL, count(*) FROM l
UNION ALL SELECT 'overview', 'error_logs', NULL, count_if(level = 'ERROR') FROM l""")
def q_stream_views(spark, sf_dir):
    """The other live views, under a filter of whole days and levels."""
    from logweave.operators.activity import error_rate, level_mix, overview, timeseries_long
    from logweave.operators.filters import whole_days
    from logweave.schemas import ANOMALIES
    from logweave.streaming.live import live_logs
    rows = whole_days("2024-01-10", "2024-01-12", levels=F_LEVELS).apply(live_logs(spark, _rollup(spark, sf_dir)))
    none = F.lit(None).cast("string")

    def view(df, kind, name, level, value):
        return df.select(F.lit(kind).alias("view"), name.alias("name"), level.alias("level"),
                         F.col(value).cast("double").alias("value"))

    ov = overview(rows, spark.createDataFrame([], ANOMALIES))
    parts = [view(timeseries_long(rows, "1h"), "series", F.col("time"), F.col("level"), "count"),
             view(error_rate(rows, "1h"), "rate", F.col("time"), none, "error_rate"),
             view(level_mix(rows), "mix", none, F.col("level"), "pct"),
             *[view(ov, "overview", F.lit(c), none, c) for c in ("total_logs", "error_logs")]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("stream_compacted_logs", _with(DEC_CTE) + """
SELECT ingested_at, source_file, raw, level, component, message, block_id FROM dp""")
def q_stream_compacted_logs(spark, sf_dir):
    """Two runs into one log table, folded after each, old files removed; the
    table read back."""
    from logweave.session import scratch_path
    from logweave.sources.sinks import compact_logs
    from logweave.sources.tables import read_parsed_logs
    from logweave.streaming.ingest import start_ingest
    from logweave.streaming.runs import vacuum
    out = scratch_path(spark, "parsed_logs")
    for part in (0, 1):
        start_ingest(_stream_values(spark, sf_dir, part), out, scratch_path(spark, "ckpt-ingest"),
                     available_now=True).awaitTermination()
        compact_logs(spark, out)
        vacuum(spark, out)
    return read_parsed_logs(spark, out).select(*_PARSED_COLS)


@register("stream_keyed_upsert", _UPSERT_SQL)
def q_stream_keyed_upsert(spark, sf_dir):
    """The keyed anomaly table folded between three runs; each (method, block)
    once, with its first time."""
    from logweave.session import scratch_path
    from logweave.streaming.detect import compact_anomalies, read_stored, start_detection
    from logweave.streaming.runs import vacuum
    target, flagged = scratch_path(spark, "anomalies-stream"), _flagged_table(spark, sf_dir)
    for part in (0, 1, None):
        start_detection(_stream_source(spark, sf_dir, part), flagged, target, scratch_path(spark, "ckpt-detect"),
                        available_now=True).awaitTermination()
        compact_anomalies(spark, target)
        vacuum(spark, target)
    return read_stored(spark, target).select(*_ANOM_COLS)


# ------------------------------------------- event counts of a stream, CSV files ---

@register("stream_event_matrix", _with(fx.MATRIX_SQL) + " SELECT * FROM matrix")
def q_stream_event_matrix(spark, sf_dir):
    """Event counts added batch by batch from a stream of structured-log
    files, folded, and widened to the matrix."""
    from logweave import schemas
    from logweave.session import scratch_path
    from logweave.streaming.events import compact_events, read_event_matrix, start_event_counts
    src, target = scratch_path(spark, "structured"), scratch_path(spark, "event-counts")
    fx.structured_files(spark, sf_dir, src)
    stream = spark.readStream.schema(schemas.STRUCTURED_LOG).option("maxFilesPerTrigger", 4).parquet(src)
    start_event_counts(stream, target, scratch_path(spark, "ckpt-events"), available_now=True).awaitTermination()
    compact_events(spark, target)
    return read_event_matrix(spark, target)


@register("stream_model_refresh", _UPSERT_SQL + """
UNION ALL SELECT 'model blocks', CAST(count(*) AS VARCHAR), NULL, NULL FROM dist""")
def q_stream_model_refresh(spark, sf_dir):
    """Block scores made from the streamed event counts, published as a
    version, replaced by a second one, and used by a detection stream."""
    from logweave import schemas
    from logweave.operators.cutoff import flag_ge_cutoff
    from logweave.operators.features import label_matrix
    from logweave.operators.kmeans import class_mean_distance
    from logweave.session import scratch_path
    from logweave.streaming.detect import read_stored, start_detection
    from logweave.streaming.events import latest_scores, publish_scores, read_event_matrix, start_event_counts
    src, counts, model = (scratch_path(spark, n) for n in ("structured", "event-counts", "model"))
    fx.structured_files(spark, sf_dir, src)
    ck = scratch_path(spark, "ckpt-events")
    for files in (4, None):
        stream = spark.readStream.schema(schemas.STRUCTURED_LOG)
        stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(src)
        start_event_counts(stream, counts, ck, available_now=True).awaitTermination()
        matrix = label_matrix(read_event_matrix(spark, counts), fx.labels(spark, sf_dir))
        flags = flag_ge_cutoff(class_mean_distance(matrix, places=6), "distance",
                               contamination=schemas.CONTAMINATION_DEFAULT, clamp_below_total=False)
        publish_scores(flags.select(F.col("BlockId").alias("block_id"), "is_anomaly", F.col("Label").alias("true_label")), model)
    scores = latest_scores(spark, model)
    target = scratch_path(spark, "anomalies-stream")
    start_detection(_stream_source(spark, sf_dir), scores.where("is_anomaly"), target, scratch_path(spark, "ckpt-detect"),
                    available_now=True).awaitTermination()
    none = F.lit(None).cast("string")
    return read_stored(spark, target).select(*_ANOM_COLS).unionByName(scores.agg(F.count(F.lit(1)).cast("string").alias("block_id")).select(
        F.lit("model blocks").alias("method"), "block_id", none.alias("true_label"), none.alias("detected_at")))


@register("csv_structured_labels", _with(fx.MATRIX_SQL) + " SELECT * FROM labelled")
def q_csv_structured_labels(spark, sf_dir):
    """Structured log and labels written as CSV, read by the file
    sources, and built into the labelled matrix."""
    from logweave.operators.batch import build_matrix
    from logweave.session import scratch_path
    from logweave.sources.files import read_labels_csv, read_structured_log
    st, lab = scratch_path(spark, "structured"), scratch_path(spark, "labels")
    fx.structured(spark, sf_dir).withColumn("LineId", F.lit("1")).write.option("header", True) \
        .option("ignoreLeadingWhiteSpace", False).csv(st)
    fx.labels(spark, sf_dir).write.option("header", True).csv(lab)
    return build_matrix(read_structured_log(spark, st), read_labels_csv(spark, lab))


@register("csv_matrix_round_trip", _with(fx.MATRIX_SQL) + " SELECT * FROM labelled")
def q_csv_matrix_round_trip(spark, sf_dir):
    """The labelled matrix written as CSV and read back."""
    from logweave.session import scratch_path
    from logweave.sources.files import read_matrix_csv
    from logweave.sources.sinks import write_matrix_csv
    path = scratch_path(spark, "matrix")
    write_matrix_csv(fx.matrix(spark, sf_dir), path)
    return read_matrix_csv(spark, path)


@register("csv_templates", """
SELECT DISTINCT 'E' || CAST(l_partkey % 31 + 1 AS VARCHAR) AS EventId,
       'template <*>, "' || CAST(l_partkey % 31 + 1 AS VARCHAR) || '"' AS EventTemplate FROM lineitem""")
def q_csv_templates(spark, sf_dir):
    """Event templates (with quotes and commas) written as CSV and read back."""
    from logweave.session import scratch_path
    from logweave.sources.files import read_templates_csv
    path = scratch_path(spark, "templates")
    n = (F.col("l_partkey") % 31 + 1).cast("string")
    fx.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("E"), n).alias("EventId"), F.concat(F.lit('template <*>, "'), n, F.lit('"')).alias("EventTemplate")) \
        .distinct().write.option("header", True).option("escape", '"').csv(path)
    return read_templates_csv(spark, path).select("EventId", "EventTemplate")


@register("publish_first_rows", """
SELECT least(3000, count(*)) AS published, count(*) > 0 AS any_rows, 3000 <= count(*) AS capped FROM events""")
def q_publish_first_rows(spark, sf_dir):
    """The first 3000 envelopes in reading order, published as files and read back."""
    from logweave.session import scratch_path
    from logweave.sources.sinks import publish
    out, env = scratch_path(spark, "published"), fx.envelopes(spark, sf_dir).select("key", "value")
    publish(env, "parquet", out, max_messages=3000)
    n = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("published"))
    total = fx.table(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar()
    return n.select("published", (F.col("published") > 0).alias("any_rows"), (total >= 3000).alias("capped"))


@register("publish_csv_records", """
SELECT 'blk_' || CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status
FROM orders""")
def q_publish_csv_records(spark, sf_dir):
    """CSV records published as JSON envelopes with their block key, and decoded again."""
    from logweave.functions.parse import decode_csv_envelope
    from logweave.session import scratch_path
    from logweave.sources.files import read_records
    from logweave.sources.sinks import publish, record_envelopes
    path, out = scratch_path(spark, "records") + ".csv", scratch_path(spark, "published")
    o = fx.table(spark, sf_dir, "orders")
    o.select(F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string")).alias("BlockId"), F.col("o_custkey").alias("customer"),
             F.col("o_orderstatus").alias("status")).write.option("header", True).csv(path)
    publish(record_envelopes(read_records(spark, path, "auto"), "orders.csv", DETECTED_AT), "parquet", out)
    env = spark.read.parquet(out).select("key", decode_csv_envelope(F.col("value")).alias("e"))
    return env.select("key", F.col("e.payload")["customer"].alias("customer"), F.col("e.payload")["status"].alias("status"))


@register("stored_logs_retained", _with(LOGS_CTE) + f"""
SELECT {_iso_sql('ts')} AS ts, level, component, block_id FROM logs WHERE ts >= TIMESTAMP '2024-01-16'""")
def q_stored_logs_retained(spark, sf_dir):
    """K2: the stored log table after its days before a given one have been removed."""
    from logweave.functions.timefmt import iso
    from logweave.session import scratch_path
    from logweave.sources.sinks import append_logs, expire_logs
    from logweave.sources.tables import log_view, read_parsed_logs
    path = scratch_path(spark, "parsed_logs")
    append_logs(fx.parsed_logs(spark, sf_dir), path)
    expire_logs(spark, path, "2024-01-16")
    return log_view(read_parsed_logs(spark, path)).select(iso(F.col("ts")).alias("ts"), "level", "component", "block_id")
