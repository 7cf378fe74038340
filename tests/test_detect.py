import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave import schemas
from logweave.operators import cutoff as C
from logweave.operators.evaluate import detection_metrics
from logweave.operators.features import event_matrix, label_matrix
from logweave.operators.spikes import error_spikes

SCHEMA = "ts timestamp, level string, component string, block_id string"


def test_spikes_edge_cases(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([(t0, "ERROR", "a", None)], SCHEMA)
    assert error_spikes(one).count() == 0
    const = spark.createDataFrame([(t0 + dt.timedelta(minutes=i), "WARN", "a", None)
                                   for i in range(5)], SCHEMA)
    assert error_spikes(const).count() == 0
    rows = [(t0 + dt.timedelta(minutes=i), "ERROR", "a", None) for i in range(20)]
    rows += [(t0 + dt.timedelta(minutes=3, seconds=s), "ERROR", "a", None) for s in range(1, 30)]
    got = error_spikes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.minute, r.error_count) for r in got] == [("2024-01-01T00:03:00", 30)]


def test_cutoff_ties_and_small_n(spark):
    df = spark.createDataFrame([(f"b{i}", float(v)) for i, v in enumerate([5, 4, 4, 4, 1])],
                               "BlockId string, d double")
    flagged = C.flag_ge_cutoff(df, "d", n=2, checkpoint=False).filter("is_anomaly").count()
    assert flagged == 4                       # ties at the cutoff are all flagged
    exact = C.flag_exact_n(df, "d", "BlockId", n=2, checkpoint=False).filter("is_anomaly")
    assert sorted(r.BlockId for r in exact.collect()) == ["b0", "b1"]
    one = spark.createDataFrame([("b0", 1.0)], "BlockId string, d double")
    assert C.flag_ge_cutoff(one, "d", contamination=0.03, checkpoint=False).first().is_anomaly


@pytest.mark.parametrize("n", [1, 7, 500, 999, 1000])
def test_nth_largest_bracket_path(spark, monkeypatch, n):
    monkeypatch.setattr(C, "ORDERED_ROWS", 50)
    monkeypatch.setattr(C, "ACCURACY", 100)
    rng = np.random.default_rng(1)
    vals = np.round(rng.normal(size=1000), 2)          # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "d double")
    assert C.nth_largest(df, "d", n) == sorted(vals, reverse=True)[n - 1]


@pytest.mark.parametrize("k", [123, 302, 640])
def test_kth_key(spark, monkeypatch, k):
    monkeypatch.setattr(C, "ORDERED_ROWS", 20)
    monkeypatch.setattr(C, "ACCURACY", 50)
    keys = [f"k{i:04d}" for i in range(300)] + ["one begin", "é", ""] + \
        [f"one begin {i}" for i in range(200)] + ["tie"] * 137
    df = spark.createDataFrame([(x,) for x in keys], "k string").repartition(5)
    assert C._kth_smallest_key(df, "k", k, len(keys)) == sorted(keys, key=str.encode)[k - 1]


def test_ties_next_to_the_answer_leave_the_band(spark, monkeypatch):
    """45 % of the rows tie just beside the answer: no round may keep them."""
    monkeypatch.setattr(C, "ORDERED_ROWS", 100)
    monkeypatch.setattr(C, "ACCURACY", 100)
    vals = [float(i) for i in range(2200)] + [700.5] * 1800
    df = spark.createDataFrame([(v,) for v in vals], "d double").repartition(6)
    limits = []
    real = type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: limits.append(n) or real(self, n))
    for n in (1499, 1500, 3300):
        assert C.nth_largest(df, "d", n, len(vals)) == sorted(vals, reverse=True)[n - 1]
    assert max(limits, default=0) <= 100


def test_matrix_rules(spark):
    st = spark.createDataFrame([("x blk_1 y", " e1"), ("blk_1", "E2 "), ("blk_2", "e30"),
                                ("no block", "E1")], "Content string, EventId string")
    m = {r.BlockId: r for r in event_matrix(st).collect()}
    assert set(m) == {"blk_1", "blk_2"}
    assert (m["blk_1"].E1, m["blk_1"].E2) == (1.0, 1.0)
    assert all(m["blk_2"][c] == 0.0 for c in schemas.FEATURE_COLS)
    lab = spark.createDataFrame([("blk_1", "Anomaly")], "BlockId string, Label string")
    got = {r.BlockId: r.Label for r in label_matrix(event_matrix(st), lab).collect()}
    assert got == {"blk_1": "Fail", "blk_2": "Success"}


def test_metrics_shapes(spark):
    an_schema = schemas.ANOMALIES
    empty = spark.createDataFrame([], an_schema)
    r = detection_metrics(empty).first()
    assert r.has_data is False and r.has_labels is False and r.detected is None
    rows = [("kmeans_distance", "b1", "Fail", None, None, "2024-01-01T00:00:00+00:00"),
            ("kmeans_distance", "b2", "Success", None, None, "2024-01-01T00:00:00+00:00")]
    an = spark.createDataFrame(rows, an_schema)
    gt = spark.createDataFrame([("b1", "Anomaly"), ("b3", "Anomaly"), ("b2", "Normal"),
                                ("b4", "Normal")], "BlockId string, Label string")
    r = detection_metrics(an, gt).first()
    assert (r.detected, r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1, 1)
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    r = detection_metrics(an).first()
    assert r.has_labels and not r.has_full_metrics and r.recall is None


def test_unlabelled_forest_rows_are_no_labels(spark):
    an = spark.createDataFrame([("isolation_forest", "b1", None, None, None, "t")], schemas.ANOMALIES)
    r = detection_metrics(an).first()
    assert r.has_data and not r.has_labels and r.precision is None


def test_labels_are_those_of_the_whole_table(spark):
    """A filter that leaves unlabelled forest rows keeps the table's labels: precision 0, nothing true."""
    from logweave.operators.evaluate import metrics_reply
    from logweave.operators.filters import AnomalyFilter
    rows = [("kmeans_distance", "b1", "Fail", None, None, "t"), ("isolation_forest", "b2", None, None, None, "t"),
            ("isolation_forest", "b3", None, None, None, "t")]
    an = spark.createDataFrame(rows, schemas.ANOMALIES)
    gt = spark.createDataFrame([("b1", "Anomaly"), ("b2", "Normal")], "BlockId string, Label string")
    r = metrics_reply(an, gt, AnomalyFilter(methods="isolation_forest")).first()
    assert r.has_labels and (r.detected, r.tp, r.fp, r.precision) == (2, 0, 0, 0.0) and r.method_counts is None
    r = metrics_reply(an, gt).first()
    assert (r.detected, r.tp) == (1, 1) and r.confusion_matrix == [[1, 0], [0, 1]]
    r = metrics_reply(an, gt, AnomalyFilter(methods="nothing")).first()
    assert not r.has_data and not r.has_labels and r.method_counts is None
    r = metrics_reply(an.where("true_label is null"), gt).first()
    assert not r.has_labels and [tuple(x) for x in r.method_counts] == [("isolation_forest", 2)] and r.confusion_matrix is None


def test_matrix_is_widened_in_many_small_tasks(spark):
    """Only narrow counts are added up on the map side, and partitions that hold wide rows are not merged."""
    from logweave.operators.features import block_events, event_matrix
    rows = [(f"got blk_{i % 50}", f" e{i % 3 + 1} ") for i in range(600)] + [("got blk_7", None), ("no block", "E1")]
    st = spark.createDataFrame(rows, "Content string, EventId string")
    m = event_matrix(st)
    assert m.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert block_events(st).columns == ["BlockId", "EventId", "count"]
    got = {r.BlockId: (r.E1, r.E2, r.E3, r.E4) for r in m.collect()}
    want = {f"blk_{b}": tuple(float(sum(i % 50 == b and i % 3 == e for i in range(600))) for e in range(3)) + (0.0,) for b in range(50)}
    assert got == want


def test_matrix_is_read_once_by_the_detectors(spark, monkeypatch):
    """Statistics and scores read one stored matrix instead of building it again."""
    from logweave import schemas
    from logweave.operators import iforest, ocsvm
    m = spark.range(40).selectExpr("concat('blk_', id) AS BlockId", *[f"cast(id % {i + 2} AS double) AS {c}" for i, c in enumerate(schemas.FEATURE_COLS)],
                                   "'Success' AS Label")
    for module, run in ((iforest, lambda: iforest.isolation_forest_detector(m, "t", n_trees=5, psi=16)),
                        (ocsvm, lambda: ocsvm.one_class_detector(m, "t"))):
        stored, keep = [], module.materialize
        monkeypatch.setattr(module, "materialize", lambda df: stored.append(df) or keep(df))
        run()
        assert stored[0] is m
        monkeypatch.setattr(module, "materialize", keep)
