import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave import schemas
from logweave.operators import cutoff as C


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=300), st.data())
def test_nth_largest_property(spark, vals, data):  # noqa: D103
    n = data.draw(st.integers(1, len(vals)))
    old = (C.ORDERED_ROWS, C.ACCURACY)
    C.ORDERED_ROWS, C.ACCURACY = 20, 50          # force the bracket-and-narrow path
    try:
        df = spark.createDataFrame([(float(v),) for v in vals], "d double")
        got = C.nth_largest(df, "d", n)
    finally:
        C.ORDERED_ROWS, C.ACCURACY = old
    assert got == sorted(vals, reverse=True)[n - 1]


def _planted(spark, n_normal=600, n_out=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_normal):
        v = np.clip(rng.poisson(2.0, size=29), 0, None).astype(float)
        rows.append((f"blk_{i}", *v.tolist(), "Success"))
    for j in range(n_out):
        v = np.zeros(29)
        v[j * 3:(j * 3) + 3] = 60.0 + j
        rows.append((f"blk_out{j}", *v.tolist(), "Fail"))
    return spark.createDataFrame(rows, schemas.MATRIX)


def test_detectors_flag_planted_outliers(spark):
    """Brute-force expectations on a fixture with 5 far-away blocks among 600."""
    from logweave.operators.iforest import isolation_forest_detector
    from logweave.operators.kmeans import kmeans_detector
    from logweave.operators.ocsvm import one_class_detector
    m = _planted(spark).checkpoint(eager=True)
    outliers = {f"blk_out{j}" for j in range(5)}
    c = 5 / 605
    forest = {r.block_id for r in isolation_forest_detector(m, "t", contamination=c).collect()}
    assert forest == outliers
    # nu * N is an upper bound on the flagged share: every flag must be an outlier.
    oc = {r.block_id for r in one_class_detector(m, "t", contamination=c).collect()}
    assert oc <= outliers and len(oc) >= 4
    # An outlier can capture a centroid of its own (distance 0): allow one miss.
    km = {r.block_id for r in kmeans_detector(m, "t", k=4, contamination=c).collect()}
    assert len(km & outliers) >= 4 and len(km) <= 6


def test_forest_does_not_depend_on_the_layout(spark):
    from logweave.operators.iforest import isolation_forest_detector
    m = _planted(spark, 900).checkpoint(eager=True)
    flags = [{r.block_id for r in isolation_forest_detector(x, "t", contamination=0.05, n_trees=30, psi=64).collect()}
             for x in (m.repartition(2), m.repartition(7, "E3"))]
    assert flags[0] == flags[1] and 40 <= len(flags[0]) <= 46


def test_kmeans_scores_use_the_nearest_centre(spark):
    from logweave.operators.kmeans import kmeans_scores
    rows = kmeans_scores(_planted(spark, 300), k=5, nearest=True).collect()
    assert len(rows) == 305 and all(abs(r.distance - r.nearest) < 1e-9 for r in rows)


def test_last_row_of_a_block_counts(spark):
    from logweave.operators.evaluate import lookup_detect
    from logweave.operators.kmeans import last_of_block
    scores = spark.createDataFrame([("b1", True, "Fail", 0), ("b1", False, "Fail", 5), ("b2", True, None, 1)],
                                   "block_id string, is_anomaly boolean, true_label string, _row long")
    logs = spark.createDataFrame([("b1",), ("b2",)], "block_id string")
    assert [r.block_id for r in lookup_detect(logs, last_of_block(scores), "t").collect()] == ["b2"]


def test_models_run_from_another_folder(tmp_path):
    """Workers get the package's functions by value: no import path is needed there."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from logweave.session import build_session
from logweave.operators.iforest import isolation_forest_flags
spark = build_session("local[2]", shuffle_partitions=2, extra={{"spark.driver.memory": "2g"}})
z = spark.range(200).selectExpr("cast(id as string) AS BlockId", "cast(id % 17 as double) AS a")
assert isolation_forest_flags(z, ["a"], ["BlockId"], n_trees=5, psi=32).count() == 200
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_weighted_cutoff_equals_the_unweighted_one(spark, monkeypatch):
    monkeypatch.setattr(C, "ORDERED_ROWS", 20)
    monkeypatch.setattr(C, "ACCURACY", 100)
    rng = np.random.default_rng(4)
    rows = [(float(np.round(rng.normal(), 2)), int(rng.integers(1, 40))) for _ in range(400)] + [(0.5, 9000), (0.51, 1)]
    vals = sorted((v for v, w in rows for _ in range(w)), reverse=True)
    df = spark.createDataFrame(rows, "d double, w long").repartition(3)
    for n in (1, 2, 137, len(vals) // 2, len(vals) // 2 + 3000, len(vals) - 1, len(vals)):
        assert C.nth_largest_weighted(df, "d", "w", n, parts=7) == vals[n - 1]


def _with_copies(spark):
    """Few distinct vectors, one of them held by a third of all blocks."""
    rng = np.random.default_rng(8)
    kinds = rng.poisson(3.0, size=(12, 29)).astype(float)
    kinds[10] += 50.0 * (np.arange(29) == 4)
    kinds[11] += 80.0 * (np.arange(29) == 20)
    counts = [300, 90, 80, 70, 70, 60, 60, 60, 50, 40, 6, 4]
    rows = [(f"blk_{k}_{i}", *kinds[k].tolist(), "Fail" if k > 9 else "Success") for k, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, schemas.MATRIX).repartition(4).checkpoint(eager=True), len(rows)


def test_weighted_vectors_stand_for_their_rows(spark):
    """Statistics, distances and flags of the weighted vectors are those of all rows."""
    from logweave.operators import kmeans as K
    m, n = _with_copies(spark)
    rows, vectors = K.distinct_vectors(m)
    assert vectors.count() == 12 and vectors.agg(F.sum("weight")).first()[0] == n == rows.count()
    plain = {tuple(r[c] for c in schemas.FEATURE_COLS): [r[f"z_{c}"] for c in schemas.FEATURE_COLS]
             for r in K.standardize(m).collect()}
    for r in K.standardize_weighted(vectors).collect():
        assert np.allclose([r[f"z_{c}"] for c in schemas.FEATURE_COLS], plain[tuple(r.vector)], atol=1e-9)
    scores = K.kmeans_scores(m, k=3, nearest=True)
    assert scores.count() == n and set(scores.columns) == {"BlockId", "Label", "prediction", "distance", "nearest"}
    assert scores.where("abs(distance - nearest) > 1e-9").count() == 0
    for share in (4 / n, 10 / n, 0.2):
        want = C.flag_ge_cutoff(scores, "distance", contamination=share).where("is_anomaly")
        got = K.kmeans_detector(m, "t", k=3, contamination=share)
        flags = K.flagged_rows(m, 3, share)
        ids = sorted(r.BlockId for r in want.collect())
        assert sorted(r.block_id for r in got.collect()) == ids
        assert sorted(r.BlockId for r in flags.where("is_anomaly").collect()) == ids and flags.count() == n


def test_weighted_detector_without_rows(spark):
    from logweave.operators import kmeans as K
    m = _planted(spark, 3, 0).where("false")
    _, vectors = K.distinct_vectors(m)
    assert K.standardize_weighted(vectors).count() == 0
    scores = spark.createDataFrame([], "vector array<double>, weight long, distance double")
    assert vectors.count() == 0
    assert K.flag_vectors(scores, 0.1).count() == 0


def test_forest_scores_do_not_depend_on_copies(spark):
    from logweave.operators.iforest import fit_forest, path_lengths, score
    m, n = _with_copies(spark)
    cols = schemas.FEATURE_COLS
    forest, psi = fit_forest(m, cols, n_trees=20, psi=64)
    got = {r.BlockId: r.score for r in score(m, cols, forest, psi, ["BlockId"]).collect()}
    x = {r.BlockId: [r[c] for c in cols] for r in m.collect()}
    h = sum(path_lengths(np.array(list(x.values())), t) for t in forest) / len(forest)
    from logweave.operators.iforest import avg_path
    want = np.power(2.0, -h / float(avg_path([psi])[0]))
    assert len(got) == n and np.allclose([got[b] for b in x], want)


def test_one_class_boundary_equals_brute_force(spark):
    """Margins, boundary and flags of the weighted points are those of all rows."""
    from logweave.operators import ocsvm as O
    m, n = _with_copies(spark)
    cols, k = schemas.FEATURE_COLS, 40
    x = np.array([[r[c] for c in cols] for r in m.collect()])
    omega, b, w, rho, scored = O._fit(m, cols, k / n, n_features=64, steps=3)
    phi = np.sqrt(2.0 / 64) * np.cos(x @ omega + b)
    want = phi.mean(axis=0)
    for t in range(1, 4):
        margins = phi @ want
        low = margins < np.sort(margins)[k - 1] - 1e-12
        want = want - 0.1 / np.sqrt(t) * (want - phi[low].sum(axis=0) / k)
    assert np.allclose(w, want, atol=1e-9) and np.isclose(rho, np.sort(phi @ want)[k - 1], atol=1e-9)
    # Equal rows are mapped once, whatever their number.
    assert scored.count() == 12 and scored.agg(F.sum("weight")).first()[0] == n
    flags = O.one_class_flags(m, cols, ["BlockId"], k / n, n_features=64, steps=3)
    got = {r.BlockId: r.is_anomaly for r in flags.collect()}
    below = {r.BlockId for r, v in zip(m.collect(), phi @ want) if v < rho - 1e-9}
    assert len(got) == n and {x for x, flag in got.items() if flag} == below and len(below) < k


def test_one_class_without_rows(spark):
    from logweave.operators.ocsvm import one_class_flags
    m = _planted(spark, 3, 0).where("false")
    assert one_class_flags(m, schemas.FEATURE_COLS, ["BlockId"]).count() == 0


def test_class_mean_distance_equals_brute_force(spark, monkeypatch):
    """Scaler and centres from one pass: far-off values, a constant, missing cells and single blocks."""
    from logweave.operators import kmeans as K
    feats = ["E1", "E2", "E3", "E4"]
    rng = np.random.default_rng(5)
    x = np.column_stack([1e8 + rng.integers(0, 3, 60), rng.integers(0, 9, 60), np.full(60, 0.1), rng.random(60) * 2e8])
    x[0] = [0, 5e8, 0.1, 0]                 # the only block of its event
    x[1, 1] = x[2, 3] = np.nan              # written as nulls
    rows = [(f"b{i}", "Normal", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    rows.append(("none", "Normal", None, None, None, None))
    df = spark.createDataFrame(rows, "BlockId string, Label string, " + ", ".join(f"{c} double" for c in feats)).repartition(4)
    monkeypatch.setattr(K, "standardize", None)     # no pass of its own for the scaler
    got = {r.BlockId: (r.cluster, r.distance) for r in K.class_mean_distance(df, feats, places=6).collect()}
    sd = np.nanstd(x, axis=0, ddof=1)
    z = np.where(sd > 1e-12, (x - np.nanmean(x, axis=0)) / np.where(sd > 1e-12, sd, 1), 0.0)
    cluster = np.nanargmax(x, axis=1)
    assert set(got) == {f"b{i}" for i in range(60)}
    for i in range(60):
        d = np.sqrt(((z[i] - np.nanmean(z[cluster == cluster[i]], axis=0)) ** 2).sum())
        k, v = got[f"b{i}"]
        assert k == cluster[i] + 1 and (v is None if np.isnan(d) else abs(v - d) < 2e-6), (i, v, d)
    assert got["b0"][1] == 0.0
    assert K.class_mean_distance(df.limit(0), feats).collect() == []
