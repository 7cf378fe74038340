"""Commit log, compaction, the keyed anomaly table and the live rollups."""

import os

import pytest
from pyspark.sql import functions as F

from logweave import schemas
from logweave.sources.sinks import append_logs, compact_logs
from logweave.sources.tables import read_parsed_logs
from logweave.streaming import live, runs
from logweave.streaming.detect import (BY_BUCKET, compact_anomalies, key_bucket, read_stored, stored_keys,
                                       upsert_batch)

ROW = "ingested_at string, source_file string, raw string, date string, time string, pid string, level string, " \
    "component string, message string, block_id string, all_block_ids array<string>"


def logs(spark, names, day="081109", level="INFO"):
    return spark.createDataFrame([("t", "f", n, day, f"2035{i:02d}", "1", level, f"c{i % 3}", "m", n, [n])
                                  for i, n in enumerate(names)], ROW)


def names(df):
    return sorted(r.raw for r in df.collect())


def files(df):
    """The files that a read of ``df`` opens."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_half_a_batch_is_not_seen(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    append_logs(logs(spark, ["a"]), path, "r", 0)
    rows = logs(spark, ["b", "c"]).withColumn("dt", F.lit("2008-11-09"))
    runs._write(rows, path, "r", 1, ("dt",), ())            # the crash: files, no commit
    assert names(read_parsed_logs(spark, path)) == ["a"]
    append_logs(logs(spark, ["b", "c", "d"]), path, "r", 1)  # the replay
    assert names(read_parsed_logs(spark, path)) == ["a", "b", "c", "d"]
    append_logs(logs(spark, ["x"]), path, "r", 1)            # a replay of what is committed
    assert names(read_parsed_logs(spark, path)) == ["a", "b", "c", "d"]


def test_a_first_batch_that_fails_shows_nothing(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    bad = logs(spark, ["a", "b"]).withColumn("raw", F.when(F.col("raw") == "b", F.raise_error(F.lit("stop"))).otherwise("a"))
    with pytest.raises(Exception, match="stop"):
        append_logs(bad, path, "r", 0)
    assert read_parsed_logs(spark, path).count() == 0
    append_logs(logs(spark, ["a", "b"]), path, "r", 0)
    assert names(read_parsed_logs(spark, path)) == ["a", "b"]


def test_compaction_keeps_the_rows(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    for k in range(4):
        append_logs(logs(spark, [f"{k}{x}" for x in "ab"], day=f"08110{1 + k % 2}"), path, "r", k)
    append_logs(logs(spark, ["bulk"]), path)
    want = names(read_parsed_logs(spark, path))
    assert len(want) == 9 and len(files(read_parsed_logs(spark, path))) >= 5
    assert compact_logs(spark, path) == 5
    folded = read_parsed_logs(spark, path)
    # Folded files only, and each day's rows still under that day.
    assert names(folded) == want
    assert all("run=fold-" in f for f in files(folded.where("dt = '2008-11-01'")))
    assert {(r.dt, r.date) for r in folded.collect()} == {("2008-11-01", "081101"), ("2008-11-02", "081102"), ("2008-11-09", "081109")}
    append_logs(logs(spark, ["x"]), path, "r", 2)            # replays of folded batches change nothing
    assert names(read_parsed_logs(spark, path)) == want
    assert compact_logs(spark, path) == 0
    append_logs(logs(spark, ["new"]), path, "r", 4)
    assert runs.vacuum(spark, path) == 5
    assert names(read_parsed_logs(spark, path)) == sorted([*want, "new"])
    append_logs(logs(spark, ["x"]), path, "r", 3)            # the log still knows them
    assert names(read_parsed_logs(spark, path)) == sorted([*want, "new"])
    assert len([f for f in os.listdir(os.path.join(path, "_commits")) if f.startswith("part-")]) == 1
    assert not os.path.exists(os.path.join(path, "run=r", "batch=2"))
    # A second fold leaves the first one's files alone.
    append_logs(logs(spark, ["new2"]), path, "r", 5)
    first = {f for f in files(read_parsed_logs(spark, path)) if "run=fold-" in f}
    assert compact_logs(spark, path) == 2 and first <= files(read_parsed_logs(spark, path))


def test_ranges():
    assert runs._union([(3, 4), (0, 1), (2, 2), (9, 8)]) == [(0, 4)]
    assert runs._without([(0, 9)], [(2, 3), (9, 9)]) == [(0, 1), (4, 8)]


def test_an_unlogged_table_is_read_whole(spark, tmp_dir):
    path = os.path.join(tmp_dir, "logs")
    runs._write(logs(spark, ["a"]).withColumn("dt", F.lit("2008-11-09")), path, "r", 0, ("dt",), ())
    assert names(read_parsed_logs(spark, path)) == ["a"]


def anomalies(spark, ids, at):
    return spark.createDataFrame([("kmeans_distance", b, "Fail", at) for b in ids],
                                 "method string, block_id string, true_label string, detected_at string")


def test_a_trigger_reads_its_own_buckets(spark, tmp_dir):
    target = os.path.join(tmp_dir, "anom")
    mine = anomalies(spark, ["b1"], "t")
    bucket = mine.select(key_bucket(16)).first()[0]
    upsert_batch(mine, target, "r", 0, buckets=16)
    read = []
    for k in range(1, 4):                                     # other keys arrive
        upsert_batch(anomalies(spark, [f"other{k}-{i}" for i in range(200)], "t").where(key_bucket(16) != bucket),
                     target, "r", k)
        stored = stored_keys(spark, target, [bucket])
        read.append((sorted(files(stored)), stored.count()))
    assert read == [read[0]] * 3 and len(read[0][0]) == 1
    assert f"bucket={bucket}/" in read[0][0][0]
    assert len(stored.inputFiles()) == 1                     # no other folder is listed
    assert runs.commits(spark, target).buckets == 16
    assert read_stored(spark, target).count() == 1 + sum(
        anomalies(spark, [f"other{k}-{i}" for i in range(200)], "t").where(key_bucket(16) != bucket).count() for k in (1, 2, 3))


def test_folded_keys_are_still_found(spark, tmp_dir):
    target = os.path.join(tmp_dir, "anom")
    for k in range(3):
        upsert_batch(anomalies(spark, [f"b{i}" for i in range(k, k + 30)], f"t{k}"), target, "one", k, buckets=4)
    assert compact_anomalies(spark, target) == 3
    runs.vacuum(spark, target)
    upsert_batch(anomalies(spark, ["b0", "b31", "b40"], "t9"), target, "two", 0)
    got = {r.block_id: r.detected_at for r in read_stored(spark, target).collect()}
    assert len(got) == 33 == read_stored(spark, target).count()
    assert (got["b0"], got["b30"], got["b31"], got["b40"]) == ("t0", "t1", "t2", "t9")
    per_bucket = runs.read_batches(spark, target, schemas.ANOMALIES, lead=BY_BUCKET).where("run like 'fold-%'")
    assert len(files(per_bucket)) <= 4 + 3


def test_rollups_add_up(spark, tmp_dir):
    target = os.path.join(tmp_dir, "rollup")
    for k in range(3):
        live.add_rollup(logs(spark, [f"b{i}" for i in range(k * 5, k * 5 + 20)], level="ERROR"), target, "r", k)
    live.add_rollup(logs(spark, ["x"]), target, "r", 2)      # a replay
    view = live.live_logs(spark, target)
    assert view.agg(F.sum("weight")).first()[0] == 60
    before = live.live_snapshot(spark, target).first()
    assert (before.n_components, before.n_blocks, before.dominant_level) == (3, 30, "ERROR")
    assert (before.start, before.end) == ("2008-11-09T20:35:00", "2008-11-09T20:35:19")
    assert live.compact_rollup(spark, target) == 3
    folded = live.live_logs(spark, target)
    assert folded.count() == 3 and folded.agg(F.sum("weight")).first()[0] == 60
    assert live.live_snapshot(spark, target).first() == before


def test_sketched_blocks_are_near(spark, tmp_dir):
    target, n = os.path.join(tmp_dir, "rollup"), 60_000
    rows = spark.range(n).selectExpr("'081109' AS date", "'203518' AS time", "'c' AS component", "'INFO' AS level",
                                     "concat('blk_', id) AS block_id")
    for k in range(3):                                        # overlapping thirds
        live.add_rollup(rows.where(f"abs(hash(block_id)) % 4 in ({k}, {k + 1})"), target, "r", k)
    assert abs(live.live_snapshot(spark, target).first().n_blocks - n) < 0.03 * n


def test_no_rollup_yet(spark, tmp_dir):
    target = os.path.join(tmp_dir, "none")
    assert live.live_logs(spark, target).count() == 0
    r = live.live_snapshot(spark, target).first()
    assert (r.start, r.n_components, r.n_blocks, r.dominant_level) == (None, 0, 0, None)


def test_old_days_expire(spark, tmp_dir):
    from logweave.sources.sinks import expire_logs
    path = os.path.join(tmp_dir, "logs")
    for k, day in enumerate(["081101", "081102", "081109", "999999"]):
        append_logs(logs(spark, [f"{day}-{k}"], day=day), path, "r", k)
    append_logs(logs(spark, ["folded"], day="081101"), path, "r", 4)
    compact_logs(spark, path)
    append_logs(logs(spark, ["late"], day="081101"), path, "r", 5)
    assert expire_logs(spark, path, "2008-11-02") >= 2
    assert names(read_parsed_logs(spark, path)) == ["081102-1", "081109-2", "999999-3"]
    assert expire_logs(spark, path, "2008-11-03") >= 1
    runs.vacuum(spark, path)
    assert names(read_parsed_logs(spark, path)) == ["081109-2", "999999-3"]
    with pytest.raises(ValueError):
        expire_logs(spark, path, "yesterday")
