"""K-Means distance scoring and detectors.

Blocks with equal event counts are one point of the model: the fit, the distances
and the cutoff work on the distinct count vectors, each with the number of its
blocks as weight, and only what is asked of single blocks is joined back to them.

Standardisation and the distance to the assigned centre are plain column
arithmetic (unrolled over the 29 features, inside whole-stage codegen).
The centre table has exactly k rows (or one per distinct assignment), so
broadcasting it is bounded by the model size, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave import schemas
from logweave.operators.cutoff import budget, flag_exact_n, materialize, nth_largest_weighted


def _z(c: str) -> str:
    return f"z_{c}"


def standardize(matrix: DataFrame, features: list[str] | None = None) -> DataFrame:
    """M2: ``(x - mean) / std`` per feature (sample std); a zero-variance
    feature becomes 0.  One global aggregate computes all 58 statistics."""
    feats = features or schemas.FEATURE_COLS
    # One aggregation pass; its single row (2 x 29 numbers) is the model of
    # the scaler and enters the projection as literals.
    row = matrix.agg(*[F.avg(c).alias(f"m_{c}") for c in feats],
                     *[F.stddev_samp(c).alias(f"s_{c}") for c in feats]).first()
    return scale(matrix, {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in feats})


def scale(matrix: DataFrame, scaler: dict[str, tuple]) -> DataFrame:
    """``z_*`` columns beside those of ``matrix`` from each feature's mean and deviation."""
    zs = []
    for c, (m, s) in scaler.items():
        if s is None or s == 0 or m is None:
            zs.append(F.lit(0.0).alias(_z(c)))
        else:
            zs.append(((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(_z(c)))
    return matrix.select(*matrix.columns, *zs)


def distinct_vectors(matrix: DataFrame, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``matrix`` with their counts as one array ``vector``, and the
    distinct vectors with ``weight`` rows each and the place of the ``first``; both
    materialised.  Rows with a missing count are skipped.  Equal vectors collapse
    before they are shuffled."""
    feats = features or schemas.FEATURE_COLS
    keep = [c for c in matrix.columns if c not in feats]
    # + 0.0 makes one zero of both.
    rows = materialize(matrix.na.drop(subset=feats).select(
        *keep, F.array(*[F.col(c).cast("double") + 0.0 for c in feats]).alias("vector")))
    return rows, materialize(rows.select("vector", F.monotonically_increasing_id().alias("at")).groupBy("vector").agg(
        F.count(F.lit(1)).alias("weight"), F.min("at").alias("first")))


def standardize_weighted(vectors: DataFrame, features: list[str] | None = None) -> DataFrame:
    """M2 over weighted distinct vectors: ``z_*`` columns beside them.  The mean and
    the sample deviation are those of the rows that the vectors stand for."""
    feats = features or schemas.FEATURE_COLS
    some = vectors.select("vector").first()
    # Sums about one of the vectors, in one pass: no difference of large sums.
    w, base = F.col("weight"), dict(zip(feats, some[0] if some else [0.0] * len(feats)))
    off = {c: F.col("vector")[i] - base[c] for i, c in enumerate(feats)}
    row = vectors.agg(F.sum(w).alias("n"), *[F.sum(w * off[c]).alias(f"s_{c}") for c in feats],
                      *[F.sum(w * off[c] * off[c]).alias(f"q_{c}") for c in feats]).first()
    n = row["n"] or 0
    zs = []
    for c in feats:
        mean = row[f"s_{c}"] / n if n else 0.0
        square = max(row[f"q_{c}"] - n * mean * mean, 0.0) if n > 1 else 0.0
        zs.append(((off[c] - mean) / (square / (n - 1)) ** 0.5 if square else F.lit(0.0)).alias(_z(c)))
    return vectors.select("*", *zs)


def dominant_event(features: list[str] | None = None):
    """Index (1-based) of the first largest event count of a block."""
    feats = features or schemas.FEATURE_COLS
    arr = F.array(*[F.col(c) for c in feats])
    return F.array_position(arr, F.array_max(arr))


def class_sums(rows: DataFrame, assign_col: str, features: list[str]) -> tuple[list, dict[str, float]]:
    """Per assignment and feature the number ``n_*`` of values and the sums ``s_*``
    and ``q_*`` of their differences, and squared differences, from one of the rows
    (also returned): no difference of large sums."""
    some = rows.select(*features).first()
    base = {c: float(some[c]) if some and some[c] is not None else 0.0 for c in features}
    off = {c: F.col(c) - base[c] for c in features}
    sums = [x for c in features for x in (F.count(c).alias(f"n_{c}"), F.coalesce(F.sum(off[c]), F.lit(0.0)).alias(f"s_{c}"),
                                          F.coalesce(F.sum(off[c] * off[c]), F.lit(0.0)).alias(f"q_{c}"))]
    return rows.groupBy(assign_col).agg(*sums).collect(), base


def class_scaler(groups: list, base: dict[str, float]) -> dict[str, tuple]:
    """Mean and sample deviation of each feature over all assignments of ``class_sums``."""
    out = {}
    for c, b in base.items():
        n, s, q = (sum(g[f"{x}_{c}"] for g in groups) for x in "nsq")
        square = q - s * s / n if n > 1 else 0.0
        out[c] = (b + s / n if n else None), (0.0 if square <= 0 else (square / (n - 1)) ** 0.5)
    return out


def class_centres(groups: list, base: dict[str, float], scaler: dict[str, tuple]) -> list[tuple]:
    """Mean standardised vector per assignment; null where it has no value of a feature."""
    def centre(g, c):
        m, s = scaler[c]
        if not s:
            return 0.0
        return (base[c] + g[f"s_{c}"] / g[f"n_{c}"] - m) / s if g[f"n_{c}"] else None

    return [tuple(centre(g, c) for c in base) for g in groups]


def distance_to_centre(z: DataFrame, centres: DataFrame, assign_col: str,
                       features: list[str] | None = None, out: str = "distance") -> DataFrame:
    """M4: Euclidean distance of each row's ``z_*`` vector to the centre of
    its assignment.  ``centres`` has one row per assignment (bounded)."""
    feats = features or schemas.FEATURE_COLS
    j = z.join(F.broadcast(centres), assign_col, "inner")
    sq = None
    for c in feats:
        d = F.col(_z(c)) - F.col(f"c_{c}")
        sq = d * d if sq is None else sq + d * d
    return j.withColumn(out, F.sqrt(sq)).drop(*[f"c_{c}" for c in feats])


# ----------------------------------------------------------- Spark ML model ---

def vector_scores(vectors: DataFrame, k: int = 8, seed: int = 42, max_iter: int = 30,
                  nearest: bool = False) -> DataFrame:
    """M1-M4 over weighted distinct vectors: ``vector, weight, prediction, distance``.

    The standardised vectors (``standardize_weighted``) are materialised once and
    serve the weighted k-means|| fit, the assignment and the distances
    (``distance_to_centre``, k centres).  ``nearest`` adds the smallest distance to
    any centre, found independently of the assignment.

    The vectors are dealt and ordered by first appearance: the random start follows
    the order of the rows, and all cores share the fit.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    feats = schemas.FEATURE_COLS
    parts = max(vectors.rdd.getNumPartitions(), vectors.sparkSession.sparkContext.defaultParallelism)
    z = materialize(standardize_weighted(vectors).repartitionByRange(parts, "first").sortWithinPartitions("first"))
    rows = VectorAssembler(inputCols=[_z(c) for c in feats], outputCol="point").transform(z)
    model = KMeans(featuresCol="point", k=k, seed=seed, maxIter=max_iter, weightCol="weight").fit(rows)
    points = [[float(x) for x in c] for c in model.clusterCenters()]
    centres = vectors.sparkSession.createDataFrame(
        [(i, *p) for i, p in enumerate(points)],
        "prediction int, " + ", ".join(f"c_{c} double" for c in feats))
    out = distance_to_centre(model.transform(rows).drop("point"), centres, "prediction")
    extra = []
    if nearest:
        squares = [sum(((F.col(_z(c)) - v) * (F.col(_z(c)) - v) for c, v in zip(feats, p)), F.lit(0.0)) for p in points]
        extra = [F.sqrt(F.least(*squares) if len(squares) > 1 else squares[0]).alias("nearest")]
    return out.select("vector", "weight", "prediction", "distance", *extra)


def kmeans_scores(matrix: DataFrame, k: int = 8, seed: int = 42, max_iter: int = 30,
                  nearest: bool = False) -> DataFrame:
    """M1-M4: ``prediction`` and ``distance`` (and ``nearest``) of each row beside the
    columns of ``matrix`` that are no features."""
    rows, vectors = distinct_vectors(matrix)
    return rows.join(vector_scores(vectors, k, seed, max_iter, nearest).drop("weight"), "vector").drop("vector")


def flag_vectors(scores: DataFrame, contamination: float, clamp_below_total: bool = True) -> DataFrame:
    """T6 over weighted distinct vectors: ``is_anomaly`` where the distance reaches
    the n-th largest of all rows they stand for (ties included)."""
    scores = materialize(scores)
    total = scores.agg(F.sum("weight")).first()[0]
    if not total:
        return scores.withColumn("is_anomaly", F.lit(False))
    cut = nth_largest_weighted(scores, "distance", "weight", budget(contamination, total, clamp_below_total))
    return scores.withColumn("is_anomaly", F.col("distance") >= cut)


def flagged_rows(matrix: DataFrame, k: int, contamination: float, clamp_below_total: bool = True,
                 nearest: bool = False) -> DataFrame:
    """The columns of ``matrix`` that are no features, ``prediction``, ``distance`` (and
    ``nearest``) and ``is_anomaly``."""
    rows, vectors = distinct_vectors(matrix)
    flags = flag_vectors(vector_scores(vectors, k, nearest=nearest), contamination, clamp_below_total)
    return rows.join(flags.drop("weight"), "vector").drop("vector")


def kmeans_detector(matrix: DataFrame, detected_at: str, k: int = 8,
                    contamination: float = schemas.CONTAMINATION_DEFAULT,
                    clamp_below_total: bool = True) -> DataFrame:
    """M5: blocks whose distance is >= the n-th largest (ties included) as
    anomaly rows ``method, block_id, true_label, detected_at``."""
    rows, vectors = distinct_vectors(matrix)
    flags = flag_vectors(vector_scores(vectors, k), contamination, clamp_below_total)
    return (rows.join(flags.where("is_anomaly"), "vector", "left_semi")
            .select(F.lit(schemas.METHOD_KMEANS).alias("method"), F.col("BlockId").alias("block_id"),
                    F.col("Label").alias("true_label"), F.lit(detected_at).alias("detected_at")))


def kmeans_exact_budget(matrix: DataFrame, k: int = 8,
                        contamination: float = schemas.CONTAMINATION_DEFAULT) -> DataFrame:
    """M6: exactly ``round(c * N)`` farthest blocks flagged (ties by BlockId)."""
    return flag_exact_n(kmeans_scores(matrix, k), "distance", "BlockId",
                        contamination=contamination)


def block_scores(matrix: DataFrame, k: int = 8,
                 contamination: float = schemas.CONTAMINATION_DEFAULT) -> DataFrame:
    """Per block the flag and the true label (the streaming lookup table).
    Of a block that the matrix holds more than once (a matrix file may), the
    last row counts."""
    rows = matrix.withColumn("_row", F.monotonically_increasing_id())
    scored = flagged_rows(rows, k, contamination, clamp_below_total=False)
    return last_of_block(scored.select(F.col("BlockId").alias("block_id"), "is_anomaly",
                                       F.col("Label").alias("true_label"), "_row"))


def last_of_block(scores: DataFrame) -> DataFrame:
    """``block_id, is_anomaly, true_label`` of each block's row with the largest ``_row``."""
    last = F.max_by(F.struct("is_anomaly", "true_label"), "_row")
    return scores.groupBy("block_id").agg(last.alias("_l")).select("block_id", "_l.*")


def model_summary(scores: DataFrame) -> DataFrame:
    """Blocks indexed and anomalies in the model."""
    return scores.agg(F.count(F.lit(1)).alias("blocks"),
                      F.count_if(F.col("is_anomaly")).alias("anomalies"))


def class_mean_distance(labelled: DataFrame, features: list[str] | None = None,
                        places: int | None = None) -> DataFrame:
    """M2 + M4 with deterministic centres: each block is assigned to its
    dominant event (first largest count), the centre of an assignment is the
    mean standardised vector of its blocks, and the score is the distance to
    that centre.  The centre table has at most 29 rows.  Columns
    ``BlockId, Label, cluster, distance`` (rounded to ``places`` if given).

    One pass over the blocks gives the sums of each assignment; the scaler and
    the centres both follow from these few rows."""
    feats = features or schemas.FEATURE_COLS
    # Sums and scoring both read the per-block matrix: cut its lineage once
    # (shared checkpoint folder) instead of aggregating twice.
    rows = labelled.withColumn("cluster", dominant_event(feats)).checkpoint(eager=True)
    groups, base = class_sums(rows, "cluster", feats)
    scaler = class_scaler(groups, base)
    groups = [g for g in groups if g["cluster"] is not None]
    cen = rows.sparkSession.createDataFrame(
        [(g["cluster"], *c) for g, c in zip(groups, class_centres(groups, base, scaler))],
        "cluster long, " + ", ".join(f"c_{c} double" for c in feats))
    d = distance_to_centre(scale(rows, scaler), cen, "cluster", feats)
    if places is not None:
        d = d.withColumn("distance", F.round("distance", places))
    return d.select("BlockId", "Label", "cluster", "distance")
