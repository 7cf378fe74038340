from pyspark.sql import functions as F

from logweave.functions.parse import event_time, parse_lines, primary_block_id
from logweave.functions.timefmt import iso

LINE = "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-160 src blk_22"


def _parse(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    return parse_lines(df, "raw")


def test_parse_fields(spark):
    r = _parse(spark, [LINE]).first()
    assert (r.date, r.time, r.pid, r.level) == ("081109", "203518", "143", "INFO")
    assert r.component == "dfs.DataNode$DataXceiver"
    assert r.message == "Receiving block blk_-160 src blk_22"
    assert r.all_block_ids == ["blk_-160", "blk_22"] and r.block_id == "blk_-160"


def test_parse_strips_blanks(spark):
    r = _parse(spark, ["  \t" + LINE + "  \t"]).first()
    assert r.component == "dfs.DataNode$DataXceiver" and r.block_id == "blk_-160"


def test_parse_drops_bad_lines(spark):
    bad = ["garbage", "", "08110 203518 143 INFO x: y", "081109 203518 143 INFO comp message"]
    assert _parse(spark, bad).count() == 0


def test_no_block_id(spark):
    r = _parse(spark, ["081109 203518 1 WARN a.B: nothing here"]).first()
    assert r.block_id is None and r.all_block_ids == []


def test_block_id_patterns(spark):
    r = _parse(spark, ["081109 203518 1 INFO a.B: got blk_+22"]).first()
    assert r.block_id == "blk_+22"
    df = spark.createDataFrame([("got blk_+22",), ("x blk_-5 y",), (None,)], "c string")
    got = [x[0] for x in df.select(primary_block_id(F.col("c"))).collect()]
    assert got == [None, "blk_-5", None]


def _ts(spark, pairs):
    df = spark.createDataFrame(pairs, "d string, t string")
    return [r[0] for r in df.select(iso(event_time(F.col("d"), F.col("t")))).collect()]


def test_event_time_rules(spark):
    got = _ts(spark, [("690101", "000000"), ("680101", "000000"), ("081301", "000000"),
                      ("081109", "235960"), ("081109", "203518"), ("080231", "000000")])
    assert got == ["1969-01-01T00:00:00", "2068-01-01T00:00:00", None,
                   "2008-11-10T00:00:00", "2008-11-09T20:35:18", None]
