"""Anomaly-table queries and detection quality (A9-A15, A17, A18, A12, A13,
F10, T3, T4, J1).

Every metric is one global aggregate with conditional counts, so the
labelled-subset fallback (F10) costs no second scan; absent results are
nullable columns plus ``has_*`` flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions.timefmt import iso, outcome, parse_iso_utc, round_metric
from logweave.operators.filters import AnomalyFilter, outcome_filter

# Fixed value: ML methods in the order the dashboard prefers them (A10).
ML_METHOD_PRIORITY = [schemas.METHOD_KMEANS, schemas.METHOD_IFOREST, schemas.METHOD_OCSVM]
RESULTS = ["False Positive", "True Positive", "Unknown"]
PAGE_SIZE = 50


def method_counts(anom: DataFrame) -> DataFrame:
    """Anomalies per method."""
    return anom.groupBy("method").agg(F.count(F.lit(1)).alias("count"))


def primary_method(anom: DataFrame) -> DataFrame:
    """A10: the first present of the ML methods, else the first other
    non-statistical method (alphabetical), else the statistical one; with
    its row count.  One row (none when the table is empty)."""
    mc = method_counts(anom.filter(F.col("method").isNotNull()))
    prio = F.lit(len(ML_METHOD_PRIORITY))
    for i, m in reversed(list(enumerate(ML_METHOD_PRIORITY))):
        prio = F.when(F.col("method") == m, F.lit(i)).otherwise(prio)
    prio = F.when(F.col("method") == schemas.METHOD_SPIKE, F.lit(len(ML_METHOD_PRIORITY) + 1)) \
        .otherwise(prio)
    return (mc.withColumn("_p", prio).orderBy("_p", "method").limit(1)
            .select(F.col("method").alias("primary_method"), "count"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def detection_metrics(anom: DataFrame, ground_truth: DataFrame | None = None,
                      anomaly_filter: AnomalyFilter | None = None) -> DataFrame:
    """A11 (+ F10): detected, tp, fp, precision over the labelled subset
    (rows with a true label; if none, the isolation-forest rows).  A table
    has labels if any of its rows has one, whatever the filter leaves, and the
    subset is not empty.  With ground truth (``BlockId, Label`` in
    Anomaly/Normal, unfiltered) also fn, tn, recall, F1.  Metrics rounded
    half-even to 4 places.  One row."""
    a = (anomaly_filter or AnomalyFilter()).apply(anom)
    lab = F.col("true_label").isNotNull()
    is_if = F.col("method") == schemas.METHOD_IFOREST
    s = a.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(lab).alias("n_lab"),
        F.count_if(lab & (F.col("true_label") == schemas.LABEL_FAIL)).alias("tp_lab"),
        F.count_if(lab & (F.col("true_label") == schemas.LABEL_SUCCESS)).alias("fp_lab"),
        F.count_if(is_if).alias("n_if"),
        F.count_if(is_if & (F.col("true_label") == schemas.LABEL_FAIL)).alias("tp_if"),
        F.count_if(is_if & (F.col("true_label") == schemas.LABEL_SUCCESS)).alias("fp_if"),
    )
    if ground_truth is not None:
        actual = ground_truth.agg(F.count_if(F.col("Label") == schemas.LABEL_ANOMALY_SRC)).scalar()
        blocks = ground_truth.agg(F.count(F.lit(1))).scalar()
        s = s.withColumn("actual", actual).withColumn("blocks", blocks)
        has_full = F.lit(True)
    else:
        s = s.withColumn("actual", F.lit(None).cast("long")).withColumn("blocks", F.lit(None).cast("long"))
        has_full = F.lit(False)
    use_lab = F.col("n_lab") > 0
    known = anom.agg(F.count("true_label") > 0).scalar()
    s = s.select(
        (F.col("n_all") > 0).alias("has_data"),
        F.when(use_lab, F.col("n_lab")).otherwise(F.col("n_if")).alias("detected"),
        F.when(use_lab, F.col("tp_lab")).otherwise(F.col("tp_if")).alias("tp"),
        F.when(use_lab, F.col("fp_lab")).otherwise(F.col("fp_if")).alias("fp"),
        "actual", "blocks").withColumn("has_labels", known & (F.col("detected") > 0))
    prec = _safe_div(F.col("tp"), F.col("detected"))
    rec = _safe_div(F.col("tp"), F.col("actual"))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    full = F.col("has_labels") & has_full
    out = s.select(
        "has_data", "has_labels", (F.col("has_labels") & has_full).alias("has_full_metrics"),
        F.when(F.col("has_labels"), F.col("detected")).alias("detected"),
        F.when(F.col("has_labels"), F.col("tp")).alias("tp"),
        F.when(F.col("has_labels"), F.col("fp")).alias("fp"),
        F.when(F.col("has_labels"), round_metric(prec)).alias("precision"),
        F.when(full, F.col("actual") - F.col("tp")).alias("fn"),
        F.when(full, F.col("blocks") - F.col("actual") - F.col("fp")).alias("tn"),
        F.when(full, round_metric(rec)).alias("recall"),
        F.when(full, round_metric(f1)).alias("f1"),
    )
    return out


def metrics_reply(anom: DataFrame, ground_truth: DataFrame | None = None,
                  anomaly_filter: AnomalyFilter | None = None) -> DataFrame:
    """A11, the whole reply: the metrics, ``confusion_matrix`` ([[tp, fn], [fp, tn]],
    null without ground truth) and ``method_counts`` (sorted (method, count)
    entries; only where no labels are known, null otherwise).  One row."""
    metrics = detection_metrics(anom, ground_truth, anomaly_filter)
    # One entry a method: the methods are a handful of names.
    counts = method_counts((anomaly_filter or AnomalyFilter()).apply(anom).where("method is not null")).agg(
        F.array_sort(F.collect_list(F.struct("method", "count")))).scalar()
    pairs = F.array(F.array("tp", "fn"), F.array("fp", "tn"))
    return metrics.select("*", F.when(F.col("has_full_metrics"), pairs).alias("confusion_matrix"),
                          F.when(F.col("has_data") & ~F.col("has_labels"), counts).alias("method_counts"))


def health_status(metrics: DataFrame) -> DataFrame:
    """A17 + A18: status (ok / warn / critical) and tp / fp shares of the
    detected blocks (percent; null when nothing is detected)."""
    p = F.coalesce(F.col("precision"), F.lit(1.0))
    d = F.coalesce(F.col("detected"), F.lit(0))
    state = (F.when(~F.col("has_data"), F.lit("ok"))
             .when(p < 0.6, F.lit("critical"))
             .when((d > 5000) | (p < 0.8), F.lit("warn"))
             .otherwise(F.lit("ok")))
    pct = lambda c: F.when(d > 0, F.col(c) / d * F.lit(100.0))
    return metrics.select("*", state.alias("status"), pct("tp").alias("tp_pct"),
                          pct("fp").alias("fp_pct"))


def detection_timeline(anom: DataFrame, anomaly_filter: AnomalyFilter | None = None) -> DataFrame:
    """Detections per hour (UTC) and outcome, one column per outcome."""
    a = (anomaly_filter or AnomalyFilter()).apply(anom)
    a = a.withColumn("_t", parse_iso_utc(F.col("detected_at"))).filter(F.col("_t").isNotNull())
    res = outcome(F.col("true_label"), "Unknown")
    agg = (a.groupBy(F.date_trunc("hour", F.col("_t")).alias("bucket"))
           .agg(*[F.count_if(res == r).alias(r) for r in RESULTS]))
    return agg.select(iso(F.col("bucket")).alias("time"), *[F.col(f"`{r}`") for r in RESULTS])


def outcome_share(anom: DataFrame) -> DataFrame:
    """True vs False Positive counts over the labelled rows."""
    res = outcome(F.col("true_label"))
    return (anom.select(res.alias("result")).filter(F.col("result").isNotNull())
            .groupBy("result").agg(F.count(F.lit(1)).alias("count")))


def anomaly_page(anom: DataFrame, anomaly_filter: AnomalyFilter | None = None,
                 limit: int = 500, offset: int = 0, chip: str | None = None) -> DataFrame:
    """T3 (+ F7, T4): one page of anomaly rows with the derived ``correct``
    outcome, the total match count and the page count (50 per page).

    The outcome chip filters before paging.  Order: detected_at, method,
    block_id, minute (a stored set has no insertion order).
    """
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be within 1..5000")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    a = (anomaly_filter or AnomalyFilter()).apply(anom)
    a = a.withColumn("correct", outcome(F.col("true_label")))
    a = outcome_filter(a, chip)
    cols = ["method", "block_id", "true_label", "correct", "minute", "error_count", "detected_at"]
    order = [F.col(c).asc_nulls_first() for c in ["detected_at", "method", "block_id", "minute",
                                                  "true_label", "error_count"]]
    from logweave.operators.activity import page_rows
    page = page_rows(a.select(*cols), order, offset, limit)
    tot = a.agg(F.count(F.lit(1))).scalar()
    return page.select("*", tot.alias("total"),
                       F.ceil(tot / F.lit(PAGE_SIZE)).cast("long").alias("pages"))


def lookup_detect(logs: DataFrame, scores: DataFrame, detected_at: Column | str) -> DataFrame:
    """J1 + X3: blocks seen in the logs (first block id of a line, once)
    that the model flags, as K-Means anomaly rows.

    The distinct block ids are joined with the flagged part of the score
    table; AQE chooses broadcast or shuffle join from the runtime size.
    """
    seen = logs.select("block_id").filter(F.col("block_id").isNotNull()).distinct()
    flagged = scores.filter(F.col("is_anomaly")).select("block_id", "true_label")
    # Both sides grow with the data here, so the join strategy is left to AQE.
    at = F.lit(detected_at) if isinstance(detected_at, str) else detected_at
    return seen.join(flagged, "block_id").select(
        F.lit(schemas.METHOD_KMEANS).alias("method"), "block_id", "true_label",
        at.alias("detected_at"))


def binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                   model: str | None = None) -> DataFrame:
    """Tp, fp, fn, tn, precision, recall, F1 (zero division -> 0); one row."""
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    s = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
               F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    out = s.select(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                   "tp", "fp", "fn", "tn")
    if model is not None:
        out = out.select(F.lit(model).alias("model"), "*")
    return out


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-class precision / recall / F1 / support (Normal = 0,
    Anomaly = 1), accuracy, macro and weighted averages.  Derived from one
    confusion-count aggregate."""
    m = binary_metrics(df, y_true, y_pred)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn

    def cls(name, tp_, fp_, fn_):
        pr = _safe_div(tp_, tp_ + fp_)
        rc = _safe_div(tp_, tp_ + fn_)
        f = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))
        return F.struct(F.lit(name).alias("class"), pr.alias("precision"), rc.alias("recall"),
                        f.alias("f1"), (tp_ + fn_).alias("support"))

    rows = m.select(cls("Normal", tn, fn, fp).alias("n"), cls("Anomaly", tp, fp, fn).alias("a"),
                    total.alias("total"), ((tp + tn) / total).alias("acc"))
    n, a = F.col("n"), F.col("a")
    macro = F.struct(F.lit("macro avg").alias("class"),
                     ((n["precision"] + a["precision"]) / 2).alias("precision"),
                     ((n["recall"] + a["recall"]) / 2).alias("recall"),
                     ((n["f1"] + a["f1"]) / 2).alias("f1"), F.col("total").alias("support"))
    w = lambda k: (n[k] * n["support"] + a[k] * a["support"]) / F.col("total")
    weighted = F.struct(F.lit("weighted avg").alias("class"), w("precision").alias("precision"),
                        w("recall").alias("recall"), w("f1").alias("f1"),
                        F.col("total").alias("support"))
    accuracy = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                        F.col("total").alias("support"))
    return rows.select(F.explode(F.array(n, a, accuracy, macro, weighted)).alias("r")).select("r.*")
