from logweave import schemas
from logweave.operators import evaluate as V
from logweave.operators.filters import AnomalyFilter
from logweave.operators.spikes import spike_series

AT = "2024-01-01T05:30:00+00:00"


def _anom(spark):
    rows = [("kmeans_distance", "blk_1", "Fail", None, None, AT),
            ("kmeans_distance", "blk_2", "Success", None, None, AT),
            ("kmeans_distance", "blk_3", None, None, None, "not a time"),
            ("isolation_forest", "blk_9", None, None, None, AT),
            ("statistical_threshold", None, None, "2024-01-01T05:00:00", 7, AT),
            ("statistical_threshold", None, None, "bad", None, AT)]
    return spark.createDataFrame(rows, schemas.ANOMALIES)


def test_primary_method(spark):
    r = V.primary_method(_anom(spark)).first()
    assert (r.primary_method, r["count"]) == ("kmeans_distance", 3)
    only = _anom(spark).filter("method = 'statistical_threshold'")
    assert V.primary_method(only).first().primary_method == "statistical_threshold"


def test_page_chip_and_pages(spark):
    page = V.anomaly_page(_anom(spark), chip="True Positive").collect()
    assert [r.block_id for r in page] == ["blk_1"] and page[0].total == 1 and page[0].pages == 1
    page = V.anomaly_page(_anom(spark), AnomalyFilter(methods="kmeans_distance"), limit=2).collect()
    assert len(page) == 2 and page[0].total == 3


def test_timeline_and_share(spark):
    t = V.detection_timeline(_anom(spark)).collect()
    assert len(t) == 1 and t[0].time == "2024-01-01T05:00:00"
    assert (t[0]["True Positive"], t[0]["False Positive"], t[0]["Unknown"]) == (1, 1, 3)
    share = {r.result: r["count"] for r in V.outcome_share(_anom(spark)).collect()}
    assert share == {"True Positive": 1, "False Positive": 1}


def test_spike_series(spark):
    s = spike_series(_anom(spark)).collect()
    assert [(r.time, r.error_count) for r in s] == [("2024-01-01T05:00:00+00:00", 7)]


def test_health_status(spark):
    m = V.detection_metrics(_anom(spark))
    h = V.health_status(m).first()
    assert h.status == "critical" and h.tp_pct == 50.0     # precision 0.5 < 0.6
    empty = V.detection_metrics(_anom(spark).limit(0))
    assert V.health_status(empty).first().status == "ok"


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "y_true int, y_pred int")
    rep = {r["class"]: r for r in V.classification_report(df).collect()}
    assert rep["Anomaly"].precision == 0.5 and rep["Anomaly"].support == 2
    assert abs(rep["Normal"].recall - 2 / 3) < 1e-12 and rep["accuracy"].f1 == 0.6
    assert rep["macro avg"].support == 5
