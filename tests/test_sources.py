import json
import os

from logweave.sources.files import choose_format, read_csv_records, read_log_lines
from logweave.streaming.ingest import parse_envelopes

LINE = "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-160"


def test_envelopes_drop_invalid(spark):
    good = json.dumps({"ingested_at": "t", "source_file": "f", "payload": {"raw": LINE}})
    vals = [good, "{not json", None, json.dumps({"ingested_at": "t", "payload": None}),
            json.dumps({"ingested_at": "t", "payload": {"BlockId": "blk_1"}})]
    df = spark.createDataFrame([(v,) for v in vals], "value string")
    rows = parse_envelopes(df).collect()
    assert len(rows) == 1 and rows[0].block_id == "blk_-160" and rows[0].source_file == "f"


def test_read_log_lines_skips_blank(spark, tmp_dir):
    p = os.path.join(tmp_dir, "x.log")
    with open(p, "w") as f:
        f.write(LINE + "\n\n   \n" + LINE + "\n")
    df = read_log_lines(spark, p)
    rows = df.collect()
    assert len(rows) == 2 and rows[0].source_file == "x.log"


def test_csv_key_first_non_empty(spark, tmp_dir):
    p = os.path.join(tmp_dir, "r.csv")
    with open(p, "w") as f:
        f.write("id,block_id,BlockId,blkid\n1,,blk_2,blk_3\n2,blk_9,,\n3,,,\n")
    rows = {r.id: r.key for r in read_csv_records(spark, p).collect()}
    assert rows == {"1": "blk_2", "2": "blk_9", "3": None}


def test_choose_format():
    assert choose_format("a.csv") == "csv" and choose_format("a.TSV") == "tsv"
    assert choose_format("a.log") == "raw" and choose_format("a.csv", "raw") == "raw"


def test_csv_envelope_is_a_map(spark):
    from pyspark.sql import functions as F

    from logweave.functions.parse import decode_csv_envelope
    v = json.dumps({"ingested_at": "t", "source_file": "f.csv",
                    "payload": {"BlockId": "blk_1", "Level": "INFO"}})
    df = spark.createDataFrame([(v,)], "value string")
    r = df.select(decode_csv_envelope(F.col("value")).alias("e")).first().e
    assert r.payload == {"BlockId": "blk_1", "Level": "INFO"} and r.source_file == "f.csv"
    assert parse_envelopes(df).count() == 0


def test_first_rows_are_the_first_in_reading_order(spark):
    from logweave.sources.sinks import first_rows
    df = spark.range(0, 1000, 1, 7)
    for n in (1, 142, 143, 144, 500, 1000, 5000):
        assert [r.id for r in first_rows(df, n).collect()] == list(range(min(n, 1000)))
    assert first_rows(df.limit(0), 5).count() == 0


def test_record_envelopes_hold_all_columns(spark):
    import json

    from logweave.sources.sinks import record_envelopes
    rec = spark.createDataFrame([("r1", "", "b2", "b2")], "RowId string, block_id string, BlockId string, key string")
    r = record_envelopes(rec, "f.csv", "t0").first()
    assert r.key == "b2" and json.loads(r.value)["payload"] == {"RowId": "r1", "block_id": "", "BlockId": "b2"}


def test_lines_of_any_white_space_are_blank(spark, tmp_dir):
    import os

    from logweave.sources.files import read_labels_csv, read_log_lines
    p = os.path.join(tmp_dir, "x.log")
    with open(p, "w") as f:
        f.write("a\n\t\n  \n\u2003\nb\n")
    assert [r.raw for r in read_log_lines(spark, p).collect()] == ["a", "b"]
    assert read_labels_csv(spark, os.path.join(tmp_dir, "none.csv"), required=False) is None


def test_day_bounds_follow_the_parsed_dates(spark):
    from logweave.operators.filters import LogFilter
    df = spark.sql("SELECT TIMESTAMP '2024-01-05 07:00:00' AS ts, '2024-01-05' AS dt, 'INFO' AS level, 'c' AS component")
    assert LogFilter(start="2024-1-5").apply(df).count() == 1
    assert LogFilter(end="2024-01-04T23:30:00-08:00").apply(df).count() == 1
    assert LogFilter(end="2024-01-04T22:30:00-08:00").apply(df).count() == 0
