import json
import os

import pytest
from pyspark.sql import functions as F

from logweave import schemas
from logweave.operators.features import event_matrix, label_matrix
from logweave.sources import files as S
from logweave.sources.sinks import publish, to_envelopes, write_export_csv, write_matrix_csv


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_structured_and_labels_to_matrix_csv(spark, tmp_dir):
    log = _write(os.path.join(tmp_dir, "a.log"), "l1\nl2\n\nl3\n")
    st = _write(os.path.join(tmp_dir, "s.csv"),
                'LineId,Content,EventId\n1,"got blk_1, ok",e1\n2,blk_2 x,E2\n3,none,E1\n')
    lab = _write(os.path.join(tmp_dir, "l.csv"), "BlockId,Label\nblk_1,Anomaly\n")
    s = S.read_structured_log(spark, st, raw_log_path=log)
    m = label_matrix(event_matrix(s), S.read_labels_csv(spark, lab))
    out = os.path.join(tmp_dir, "m")
    write_matrix_csv(m, out)
    back = {r.BlockId: r for r in S.read_matrix_csv(spark, out).collect()}
    assert back["blk_1"].Label == "Fail" and back["blk_1"].E1 == 1.0
    assert back["blk_2"].Label == "Success" and back["blk_2"].E2 == 1.0
    bad = _write(os.path.join(tmp_dir, "b.log"), "l1\n")
    with pytest.raises(ValueError):
        S.read_structured_log(spark, st, raw_log_path=bad)
    assert S.read_labels_csv(spark, os.path.join(tmp_dir, "missing.csv"), required=False) is None


def test_matrix_csv_requires_columns(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "x.csv"), "BlockId,E1,Label\nb,1,Fail\n")
    with pytest.raises(ValueError):
        S.read_matrix_csv(spark, p)


def test_export_csv(spark, tmp_dir):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "INFO", "a.B", None)],
                               "ts timestamp, level string, component string, block_id string")
    out = os.path.join(tmp_dir, "e")
    write_export_csv(df, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out))
                   if f.endswith(".csv"))
    header = '"Timestamp","Level","Component","Block ID"'
    lines = text.splitlines()
    assert lines[0] == header
    assert [x for x in lines if x != header] == ['"2024-01-02 03:04:05","INFO","a.B",""']


def test_publish_limits_messages(spark, tmp_dir):
    lines = spark.createDataFrame([(f"line {i}",) for i in range(10)], "raw string")
    env = to_envelopes(lines, source_file="x.log", ingested_at="t")
    out = os.path.join(tmp_dir, "env")
    publish(env, "text", out, max_messages=4)
    vals = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(vals) == 4 and vals[0]["payload"]["raw"].startswith("line")
    assert vals[0]["source_file"] == "x.log"
