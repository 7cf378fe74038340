import datetime as dt

from pyspark.sql import functions as F

from logweave.functions.timefmt import iso, time_bucket
from logweave.operators import activity as A
from logweave.operators.filters import AnomalyFilter, LogFilter, text_filter, whole_days

SCHEMA = "ts timestamp, level string, component string, block_id string"


def _logs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def T(s):
    return dt.datetime.fromisoformat(s)


def test_buckets(spark):
    df = spark.createDataFrame([(T("2024-01-01 00:07:31"),)], "ts timestamp")
    got = df.select(iso(time_bucket(F.col("ts"), "5min")), iso(time_bucket(F.col("ts"), "15min")),
                    iso(time_bucket(F.col("ts"), "weird"))).first()
    assert tuple(got) == ("2024-01-01T00:05:00", "2024-01-01T00:00:00", "2024-01-01T00:05:00")


def test_date_only_end(spark):
    df = _logs(spark, [(T("2024-01-02 00:00:00"), "INFO", "a", None),
                       (T("2024-01-02 10:00:00"), "INFO", "a", None),
                       (T("2024-01-03 00:00:01"), "INFO", "a", None)])
    assert LogFilter(end="2024-01-02").apply(df).count() == 1
    assert whole_days("2024-01-01", "2024-01-02").apply(df).count() == 2


def test_level_list_not_trimmed(spark):
    df = _logs(spark, [(T("2024-01-02 00:00:00"), "INFO", "a", None),
                       (T("2024-01-02 00:00:00"), "WARN", "a", None)])
    assert LogFilter(levels="INFO, WARN").apply(df).count() == 1
    assert LogFilter(levels="").apply(df).count() == 2


def test_search_regex_case_and_null(spark):
    df = _logs(spark, [(T("2024-01-02 00:00:00"), "INFO", "x", "blk_17"),
                       (T("2024-01-02 00:00:00"), "INFO", "x", None)])
    assert text_filter(df, "BLK_1").count() == 1
    an = spark.createDataFrame([("m", "blk_17"), ("m", None)], "method string, block_id string")
    assert AnomalyFilter(block_search="BLK_1[0-9]").apply(an).count() == 1


def test_top_n_ties_by_name(spark):
    t = T("2024-01-02 00:00:00")
    df = _logs(spark, [(t, "INFO", c, None) for c in ["b", "a", "c", "c"]])
    got = [r.component for r in A.components(df, top_n=2).collect()]
    assert got == ["a", "c"]          # ascending total: a(1) then c(2)


def test_error_rate(spark):
    t = T("2024-01-02 00:00:00")
    df = _logs(spark, [(t, "INFO", "a", None), (t, "INFO", "a", None), (t, "ERROR", "a", None),
                       (T("2024-01-02 01:00:00"), "INFO", "a", None)])
    got = {r.time: r.error_rate for r in A.error_rate(df, "1h").collect()}
    assert got == {"2024-01-02T00:00:00": 33.33, "2024-01-02T01:00:00": 0.0}
    only_err = LogFilter(levels="ERROR").apply(df)
    assert [r.error_rate for r in A.error_rate(only_err, "1h").collect()] == [100.0]
    no_err = df.filter(F.col("level") != "ERROR")
    assert A.error_rate(no_err, "1h", rounded=False).count() == 0


def test_heatmap_shape(spark):
    rows = [(T("2024-01-02 03:00:00"), "ERROR", "a", None),
            (T("2024-01-02 05:00:00"), "INFO", "b", None),
            (T("2024-01-02 05:00:00"), "INFO", "b", None)]
    hm = A.heatmap(_logs(spark, rows), top_n=10)
    out = hm.collect()
    assert [r.component for r in out] == ["a"] and len(hm.columns) == 25
    assert out[0].h03 == 1 and out[0].h05 == 0


def test_raw_page_total_and_order(spark):
    rows = [(T(f"2024-01-02 00:00:{i:02d}"), "INFO", "a", f"blk_{i}") for i in range(30)]
    page = A.raw_page(_logs(spark, rows), limit=100, offset=5).collect()
    assert len(page) == 25 and page[0].total == 30 and page[0].ts == "2024-01-02T00:00:24"


def test_deep_page_matches_shallow(spark, monkeypatch):
    rows = [(T(f"2024-01-02 00:{i // 60:02d}:{i % 60:02d}"), "INFO", f"c{i % 3}", f"blk_{i % 5}")
            for i in range(600)]
    df = _logs(spark, rows)
    shallow = [tuple(r) for r in A.raw_page(df, limit=150, offset=230).collect()]
    monkeypatch.setattr(A, "DEEP_PAGE_ROWS", 10)
    deep = [tuple(r) for r in A.raw_page(df.repartition(4), limit=150, offset=230).collect()]
    assert sorted(deep) == sorted(shallow) and len(deep) == 150


def test_deep_page_with_hot_duplicates(spark, monkeypatch):
    hot = [(T("2024-01-02 00:00:00"), "INFO", "hot", "blk_1")] * 300
    rest = [(T(f"2024-01-02 00:{i // 60:02d}:{i % 60:02d}"), "WARN", "c", None) for i in range(1, 200)]
    df = _logs(spark, hot + rest)
    for off, lim in [(0, 100), (150, 250), (400, 500)]:
        shallow = sorted(tuple(r) for r in A.raw_page(df, limit=lim, offset=off).collect())
        monkeypatch.setattr(A, "DEEP_PAGE_ROWS", 10)
        deep = sorted(tuple(r) for r in A.raw_page(df.repartition(3), limit=lim, offset=off).collect())
        monkeypatch.setattr(A, "DEEP_PAGE_ROWS", 100_000)
        assert deep == shallow
