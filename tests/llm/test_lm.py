"""Deleted interpolation against counts and sums in plain Python."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.llm import lm


def slow(rows, order, weights, held):
    """rows: (id, text, learn); scores with the given weights."""
    toks = {i: [*(t or "").encode().lower().split(), None] for i, (_, t, _) in enumerate(rows)}
    grams = [Counter() for _ in range(order + 1)]
    n_docs = sum(x[2] for x in rows)
    for i, (_, _, learn) in enumerate(rows):
        if learn:
            seq = [None] * order + toks[i]
            for j in range(order, len(seq)):
                for k in range(1, order + 1):
                    grams[k][tuple(seq[j - k + 1:j + 1])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    out = []
    for i, (d, _, _) in enumerate(rows):
        seq = [None] * order + toks[i]
        base = score = known = 0
        for j in range(order, len(seq)):
            c = grams[1][(seq[j],)]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            mle, ctx = [1 / (v + 1), c / n if n else 0], n
            for k in range(2, order + 1):
                ctx = n_docs if j == order else grams[k - 1][tuple(seq[j - k + 1:j])]
                mle.append(grams[k][tuple(seq[j - k + 1:j + 1])] / ctx if ctx else 0)
            b = min(int(math.log2(ctx)) + 1, lm.TOP - 1) if ctx else 0
            w = weights[b].copy()
            if b == 0 and order > 1:
                w[order] = 0
                w /= w.sum()
            score += math.log10(float(np.dot(w, mle)))
        out.append((d, len(toks[i]), known, n, base, score))
    return out


@pytest.mark.parametrize("order,blocks", [(1, 3), (2, 5), (2, 1), (3, 4)])
def test_scores_match_plain_counts(spark, monkeypatch, order, blocks):
    texts = ["the cat sat on the mat", "The cat ran", "a dog sat on a mat", "", None, " \t\n", "é ü the cat",
             "the cat sat on the mat", "x " * 300 + "y"] + [f"w{i % 7} w{i % 5} the w{i % 3}" for i in range(40)]
    rows = [(i, t, i % 7 != 2) for i, t in enumerate(texts)] + [(3, "the cat", True), (3, "the cat", True)]
    weights = {}
    real = lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda cells, o: weights.setdefault("w", real(cells, o)))
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, learn boolean, score string")
    got = lm.score_documents(df, F.col("learn"), order=order, blocks=blocks, held_one_in=4).collect()
    want = slow(rows, order, weights["w"], None)
    key = lambda r: (r[0], r[1], round(r[4], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_weights_maximise_the_held_likelihood():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame({"b": 3, "q1": rng.integers(0, 40, 400), "q2": rng.choice([lm.UNSEEN, 10, 30, 60], 400),
                          "n": rng.integers(1, 50, 400)})
    w = lm.fit_weights(cells, 2, rounds=400, prior=1e-9)[3]
    r = np.stack([np.ones(400), 2.0 ** (cells.q1 / 4), np.where(cells.q2 > 0, 2.0 ** (cells.q2 / 4), 0)], 1)
    like = lambda w: float((cells.n * np.log(r @ w)).sum())
    for _ in range(300):
        other = np.abs(w + rng.normal(0, 0.05, 3))
        assert like(other / other.sum()) <= like(w) + 1e-6


def test_packing_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64) * 2)
    assert np.array_equal(lm._unpack_sorted(lm._pack_sorted(x)), x)
    c = np.arange(70_000, dtype=np.uint32)
    assert np.array_equal(lm._unplane(lm._planes(c), np.uint32), c)
    assert len(lm._unplane(lm._planes(c[:0]), np.uint32)) == 0


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = lm.score_documents(docs, ~held).join(docs.select(F.col("doc_id").alias("id"), held.alias("h")), "id")
    n, base, score, bad = out.where("h").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score"),
                                             F.max("score")).first()
    assert score > base and bad <= 0
    assert out.count() == docs.count()


def test_empty_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert lm.score_documents(df.limit(0), F.lit(True)).count() == 0
    got = sorted(map(tuple, lm.score_documents(df, F.lit(False)).collect()), key=str)
    assert got == [(1, 3, 0, 0, 0.0, 0.0), (None, 1, 0, 0, 0.0, 0.0)]
