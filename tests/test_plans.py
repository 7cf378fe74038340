import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from logweave.operators.activity import components, timeseries
from logweave.plans import fixtures as fx
from logweave.sources.sinks import append_logs
from logweave.sources.tables import error_log_view, log_view, read_parsed_logs

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_activity_plans(spark):
    logs = fx.logs(spark, SMALL)
    from logweave.operators.activity import heatmap, raw_page, snapshot
    from logweave.operators.spikes import error_spikes
    for df in (timeseries(logs, "5min"), components(logs, 5), heatmap(logs),
               raw_page(logs), snapshot(logs), error_spikes(logs)):
        p = _plan(df)
        assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
        assert "Window" not in p            # no single-partition window anywhere


def test_a_line_is_matched_once(spark):
    from logweave.functions.parse import LOG_LINE_RE, event_time, parse_lines
    lines = spark.range(10).selectExpr("concat('081109 203518 143 INFO a.B: x ', id) AS raw")
    df = parse_lines(lines).withColumn("ts", event_time(F.col("date"), F.col("time"))).where("ts is not null")
    p = _plan(df.select("ts", "level", "component", "block_id"))
    # One replacement; the other use is the test of lines that hold the separator.
    assert p.count("regexp_replace") == 2 and p.count(LOG_LINE_RE[:20]) == 2


def test_a_block_id_is_looked_for_once(spark):
    from logweave.operators.features import block_events
    rows = [("Receiving block blk_1", " e1"), ("blk_-2 and blk_1", "E30"), ("none", "E1"), (None, None), ("blk_1", "e1 ")]
    df = block_events(spark.createDataFrame(rows, "Content string, EventId string"))
    p = _plan(df)
    assert p.count("regexp_extract") == 1, p
    assert sorted(map(tuple, df.collect()), key=str) == [("blk_-2", None, 1), ("blk_1", "E1", 2)]


def test_an_envelope_is_decoded_once(spark):
    from logweave.streaming.ingest import parse_envelopes
    rows = [('{"ingested_at": "t", "source_file": "f", "payload": {"raw": "081109 203518 143 INFO a.B: blk_1"}}',),
            ("{",), (None,), ('{"ingested_at": "t"}',)]
    df = parse_envelopes(spark.createDataFrame(rows, "value string"))
    p = _plan(df.select("ingested_at", "source_file", "block_id"))
    assert p.count("from_json") == 1, p
    assert [tuple(r) for r in df.select("ingested_at", "source_file", "block_id").collect()] == [("t", "f", "blk_1")]


def test_structured_files_are_dealt_without_a_sort(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "tables")
    spark.range(300).selectExpr("id AS l_orderkey", "id % 50 AS l_partkey", "id % 3 AS l_suppkey",
                                "CAST(id % 8 AS INT) AS l_linenumber", "CAST(1 AS DOUBLE) AS l_quantity") \
        .write.parquet(os.path.join(folder, "lineitem.parquet"))
    path = os.path.join(tmp_dir, "structured")
    fx.structured_files(spark, folder, path)
    got, want = spark.read.parquet(path), fx.structured(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 1 < len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 8


def test_separator_in_a_line(spark):
    from logweave.functions.parse import parse_lines
    rows = [("081109 203518 143 INFO a.B: x\x01y\x01z",), ("a\x01b\x01c\x01d\x01e\x01f",), ("a\x01" * 9,)]
    got = parse_lines(spark.createDataFrame(rows, "raw string")).collect()
    assert [r.message for r in got] == ["x\x01y\x01z"]


def test_pushdown_and_pruning(spark, tmp_dir):
    path = os.path.join(tmp_dir, "parsed")
    append_logs(fx.parsed_logs(spark, SMALL), path)
    p = _plan(log_view(error_log_view(spark.read.parquet(path))))
    assert "PushedFilters: [In(level, [ERROR,WARN])" in p or "In(level" in p
    assert "message" not in p.split("ReadSchema:")[1].split("\n")[0]
    assert error_log_view(read_parsed_logs(spark, path)).count() == error_log_view(fx.parsed_logs(spark, SMALL)).count()


def test_partition_pruning_by_day(spark, tmp_dir):
    from logweave.operators.filters import LogFilter
    path = os.path.join(tmp_dir, "parsed_dt")
    append_logs(fx.parsed_logs(spark, SMALL), path)
    view = log_view(read_parsed_logs(spark, path))
    f = LogFilter(start="2024-01-05", end="2024-01-07 12:00:00").apply(view)
    p = _plan(f)
    part = p.split("PartitionFilters: [")[1].split("]")[0]
    assert "dt" in part and "2024-01-05" in part
    full = LogFilter(start="2024-01-05", end="2024-01-07 12:00:00").apply(fx.logs(spark, SMALL))
    assert f.count() == full.count() > 0


def test_entry_and_registry(spark):
    out = E.entry(spark)
    assert out.count() > 0 and out.columns[0] == "time"
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_spread_only_small_inputs(spark, tmp_dir):
    from logweave.plans.fixtures import spread
    cores = spark.sparkContext.defaultParallelism
    big = os.path.join(tmp_dir, "big")
    spark.range(0, 10000, numPartitions=cores * 2).write.parquet(big)
    df = spread(spark.read.parquet(big)).filter(F.col("id") > 5)
    p = _plan(df)
    assert "RoundRobinPartitioning" not in p and "GreaterThan(id,5)" in p.split("PushedFilters: ")[1]
    small = os.path.join(tmp_dir, "small")
    spark.range(0, 100, numPartitions=1).write.parquet(small)
    sp = spread(spark.read.parquet(small))
    assert "RoundRobinPartitioning" in _plan(sp) and sp.count() == 100
    assert sp.rdd.getNumPartitions() == cores


def test_wide_forms_scan_once(spark, tmp_dir):
    """The levels and their counts come from one pass; the wide form reads no log row."""
    path = os.path.join(tmp_dir, "parsed")
    append_logs(fx.parsed_logs(spark, SMALL), path)
    logs = log_view(read_parsed_logs(spark, path))
    for df in (timeseries(logs, "5min"), components(logs, 5)):
        assert "FileScan" not in _plan(df)


def test_counts_of_a_rollup_are_those_of_its_lines(spark):
    from logweave.operators.activity import error_rate, heatmap, level_mix, timeseries_long
    from logweave.operators.spikes import error_spikes
    logs = fx.logs(spark, SMALL)
    rolled = logs.groupBy(F.date_trunc("minute", "ts").alias("ts"), "level", "component").agg(
        F.count("*").alias("weight"))
    for f in (lambda x: timeseries(x, "15min"), lambda x: timeseries_long(x, "1min"), lambda x: error_rate(x, "1h"),
              lambda x: error_rate(x, "1h", rounded=False), lambda x: components(x, 7), heatmap, level_mix, error_spikes):
        assert sorted(map(tuple, f(rolled).collect())) == sorted(map(tuple, f(logs).collect())) != []
