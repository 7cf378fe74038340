import json
import os

from pyspark.sql import functions as F

from logweave.streaming.detect import batch_anomalies, read_stored, upsert_batch
from logweave.streaming.ingest import parse_envelopes, start_ingest
from logweave.streaming.live import read_live_counts, start_live_counts


def _rows(spark, ids, at):
    return spark.createDataFrame([("kmeans_distance", b, "Fail", at) for b in ids],
                                 "method string, block_id string, true_label string, detected_at string")


def test_upsert_first_wins_replay_and_new_runs(spark, tmp_dir):
    target = os.path.join(tmp_dir, "anom")
    upsert_batch(_rows(spark, ["b1", "b2"], "t0"), target, "one", 0)
    upsert_batch(_rows(spark, ["b2", "b3"], "t1"), target, "one", 1)
    upsert_batch(_rows(spark, ["b2", "b3"], "t1"), target, "one", 1)     # replay of batch 1
    upsert_batch(_rows(spark, ["b3", "b4"], "t9"), target, "two", 0)     # a run with a new checkpoint
    rows = read_stored(spark, target).collect()
    assert sorted((r.block_id, r.detected_at) for r in rows) == [("b1", "t0"), ("b2", "t0"), ("b3", "t1"), ("b4", "t9")]


def test_nothing_stored_yet(spark, tmp_dir):
    from logweave.sources.tables import read_parsed_logs
    assert read_stored(spark, os.path.join(tmp_dir, "no")).count() == 0
    assert read_parsed_logs(spark, os.path.join(tmp_dir, "no")).count() == 0
    assert read_live_counts(spark, os.path.join(tmp_dir, "no")).count() == 0


def test_batch_lookup_dedupes(spark):
    batch = spark.createDataFrame([("b1", "t1"), ("b1", "t0"), ("b9", "t0"), (None, "t0")],
                                  "block_id string, ingested_at string")
    flagged = spark.createDataFrame([("b1", "Fail")], "block_id string, true_label string")
    rows = batch_anomalies(batch, flagged).collect()
    assert [(r.block_id, r.detected_at) for r in rows] == [("b1", "t0")]


def _write_envelopes(tmp_dir, n_files=3):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    k = 0
    for f in range(n_files):
        with open(os.path.join(src, f"part-{f}.txt"), "w") as fh:
            for i in range(20):
                lvl = "ERROR" if i % 3 == 0 else "INFO"
                raw = f"0811{10 + f:02d} 2035{i:02d} 1 {lvl} a.B: blk_{k % 7}"
                fh.write(json.dumps({"ingested_at": "t", "source_file": "x", "payload": {"raw": raw}}) + "\n")
                k += 1
    return src


def test_stream_equals_batch(spark, tmp_dir):
    from logweave.operators.activity import timeseries_long
    from logweave.sources.tables import log_view
    from logweave.streaming.ingest import file_values
    src = _write_envelopes(tmp_dir)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    start_ingest(file_values(spark, src, 1), out, ck, available_now=True).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == 60
    live, ck2 = os.path.join(tmp_dir, "live"), os.path.join(tmp_dir, "ck2")
    start_live_counts(parse_envelopes(file_values(spark, src, 1)), live, ck2,
                      available_now=True).awaitTermination()
    got = sorted(tuple(r) for r in read_live_counts(spark, live).collect())
    batch = parse_envelopes(spark.read.text(src))
    want = sorted(tuple(r) for r in timeseries_long(log_view(batch), "5min").collect())
    assert got == want


def test_late_lines_are_counted(spark, tmp_dir):
    from logweave.streaming.ingest import file_values
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for f, t in enumerate(["120000", "120500", "060000"]):
        with open(os.path.join(src, f"part-{f}.txt"), "w") as fh:
            fh.write(json.dumps({"payload": {"raw": f"081109 {t} 1 ERROR a.B: x"}}) + "\n")
    live = os.path.join(tmp_dir, "live")
    start_live_counts(parse_envelopes(file_values(spark, src, 1)), live, os.path.join(tmp_dir, "ck"),
                      available_now=True).awaitTermination()
    assert sorted(r.time[11:16] for r in read_live_counts(spark, live).collect()) == ["06:00", "12:00", "12:05"]


def test_a_new_checkpoint_adds_to_the_table(spark, tmp_dir):
    from logweave.sources.tables import read_parsed_logs
    from logweave.streaming.ingest import bulk_ingest, file_values
    src, out = _write_envelopes(tmp_dir), os.path.join(tmp_dir, "out")
    for k in range(2):
        start_ingest(file_values(spark, src), out, os.path.join(tmp_dir, f"ck{k}"), available_now=True).awaitTermination()
    start_ingest(file_values(spark, src), out, os.path.join(tmp_dir, "ck1"), available_now=True).awaitTermination()
    p = os.path.join(tmp_dir, "a.log")
    with open(p, "w") as f:
        f.write("081109 203518 143 INFO a.B: x blk_1\n")
    bulk_ingest(spark, p, out)
    assert read_parsed_logs(spark, out).count() == 121


def test_bulk_ingest(spark, tmp_dir):
    from logweave.streaming.ingest import bulk_ingest
    p = os.path.join(tmp_dir, "a.log")
    with open(p, "w") as f:
        f.write("081109 203518 143 INFO a.B: x blk_1\n\ngarbage\n081109 203519 1 WARN a.C: y\n")
    out = os.path.join(tmp_dir, "parsed")
    assert bulk_ingest(spark, p, out, ingested_at="t0") == 2
    rows = spark.read.parquet(out).collect()
    assert {r.source_file for r in rows} == {"a.log"} and {r.ingested_at for r in rows} == {"t0"}
    assert {str(r.dt) for r in rows} == {"2008-11-09"}
