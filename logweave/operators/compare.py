"""Model comparison (M9): precision / recall / F1 and confusion counts per
detector on the same labelled event matrix (P14 label vocabulary, A22
contamination, A12 metrics).  The label travels in the row it was scored
with, so no prediction can be misaligned with its ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave import schemas
from logweave.operators.cutoff import materialize
from logweave.operators.evaluate import binary_metrics
from logweave.operators.features import binary_label, empirical_contamination


def compare_models(matrix: DataFrame, k: int = 8, empirical: bool = False,
                   skip_isolation_forest: bool = False, skip_one_class: bool = False) -> DataFrame:
    """One row per model: ``model, precision, recall, f1, tp, fp, fn, tn``."""
    from logweave.operators.iforest import isolation_forest_flags
    from logweave.operators.kmeans import kmeans_exact_budget, standardize
    from logweave.operators.ocsvm import one_class_flags

    # The labels, the statistics and each model read the matrix: store it once.
    labelled = binary_label(materialize(matrix), "Label", "y_true")
    c = empirical_contamination(labelled) if empirical else schemas.CONTAMINATION_DEFAULT
    rows = []
    km = kmeans_exact_budget(labelled, k=k, contamination=c)
    rows.append(binary_metrics(km.select("y_true", F.col("is_anomaly").cast("int").alias("y_pred")),
                               model=f"K-Means distance (k={k})"))
    feats = schemas.FEATURE_COLS
    z = standardize(labelled, feats)
    zc = [f"z_{f}" for f in feats]
    if not skip_one_class:
        oc = one_class_flags(z, zc, ["y_true"], c)
        rows.append(binary_metrics(oc.select("y_true", F.col("is_anomaly").cast("int").alias("y_pred")),
                                   model="One-class boundary (random Fourier features)"))
    if not skip_isolation_forest:
        fo = isolation_forest_flags(z, zc, ["y_true"], c)
        rows.append(binary_metrics(fo.select("y_true", F.col("is_anomaly").cast("int").alias("y_pred")),
                                   model="Isolation Forest"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
