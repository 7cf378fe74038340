"""Product-quantised near-duplicates against all pairs in numpy."""

import numpy as np
import pytest

from logweave.llm import pq


def brute(ids, vecs, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    n = len(ids)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                link[i, j] = link[j, i] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i]] + [comp[j] for j in np.flatnonzero(link[i])]) for i in range(n)]
        if new == comp:
            break
        comp = new
    least = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            least[c] = min(ids[i], least.get(c, ids[i]))
    return [(ids[i], int(link[i].sum()), least.get(comp[i])) for i in range(n)]


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_matches_brute_force(spark, cell_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    vecs = [list(map(float, v)) for v in base]
    vecs += [list(map(float, base[i % 6] + rng.normal(size=16) * 0.1)) for i in range(60)]
    vecs += [vecs[0]] * 9 + [[2 * x for x in vecs[1]]]
    vecs += [None, [], [0.0] * 16, [None] + vecs[2][1:], [float("nan")] + vecs[2][1:], [float("inf")] * 16, [1.0, 2.0]]
    ids = list(range(len(vecs)))
    ids[3] = None
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in zip(ids, vecs)],
                               "vec_id long, embedding array<float>, key int, n double").repartition(4)
    back = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vecs]
    got = pq.near_duplicates(df, lists=5, cell_rows=cell_rows, pair_block=200, slack=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(ids, back, 0.9), key=str)


def test_empty_table(spark):
    assert pq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_test_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = e.select("vec_id", "embedding").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    x /= np.sqrt((x ** 2).sum(1, keepdims=True))
    want = dict(zip(rows["vec_id"], (x @ x.T >= 0.9).sum(1) - 1))
    got = {r.id: r.n_links for r in pq.near_duplicates(e).collect()}
    assert set(got) == set(want) and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def _low_rank(n, rank, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, dim))
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("rank", [4, 8])
def test_no_link_is_lost_on_low_rank_vectors(spark, rank):
    x = _low_rank(1500, rank, 64, rank)
    unit = x / np.sqrt((x ** 2).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.id: r.n_links for r in pq.near_duplicates(df, cell_rows=400).collect()}
    assert want.sum() > 1000 and [got[i] for i in range(len(x))] == want.tolist()


def test_queries_of_a_list_are_dealt_by_their_own_number(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ball = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.02
    x = np.concatenate([ball, rng.normal(size=(200, 16))]).astype(np.float32).astype(float)
    real, limit = pq._match, 60

    def bounded(*a):
        run = real(*a)

        def checked(key, members, asks):
            # Cells are dealt by hash: twice the mean leaves room for chance.
            assert len(members) <= 2 * limit and len(asks) <= 2 * limit
            return run(key, members, asks)
        return checked

    monkeypatch.setattr(pq, "_match", bounded)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = pq.near_duplicates(df, lists=12, cell_rows=limit).collect()
    unit = x / np.sqrt((x ** 2).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert {r.id: r.n_links for r in got} == dict(enumerate(want.tolist()))
