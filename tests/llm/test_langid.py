"""Language identification: held-out accuracy, whole texts, defined edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import langid


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def net(docs):
    return langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), rows_per_lang=400, steps=400)


def test_held_out_accuracy(docs, net):
    test = docs.where(langid.held_out(F.col("doc_id")))
    got = langid.predict(test, net).join(test.select(F.col("doc_id").alias("id"), "lang"), "id")
    n, right, low, high = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")),
                                  F.min("score"), F.max("score")).first()
    assert n > 250 and right / n >= 0.97 and 0 <= low and high <= 1


def test_pair_tables_equal_the_convolution(net):
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    z = net.filtered(net.columns(windows)).max(axis=1)
    p = langid._softmax(np.maximum(z + net.conv_b, 0) @ net.out + net.out_b)
    assert np.allclose(p, net.probabilities(windows, batch=7), atol=1e-4)


def test_windows_hold_every_byte():
    data = [b"", b"x" * 5, b"y" * 128, b"z" * 300]
    windows, owner, filled = langid.cut_windows(data)
    for k, b in enumerate(data):
        assert b"".join(w.tobytes()[:n] for w, n in zip(windows[owner == k], filled[owner == k])) == b


def test_training_on_two_alphabets():
    rng = np.random.default_rng(1)
    text = [bytes(rng.integers(97, 105, 300).astype(np.uint8)) for _ in range(60)] + \
        [bytes(rng.integers(110, 118, 300).astype(np.uint8)) for _ in range(60)]
    x, owner, _ = langid.cut_windows(text)
    net = langid.train(x, (owner >= 60).astype(int), ["lo", "hi"], steps=150)
    assert langid.predict_texts(net, ["abcd abc", "nopq nopq"])[0] == ["lo", "hi"]


def test_edge_cases(spark, net):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 %% 34\n", "a"), (None, "the and of", "a"), (5, "é" * 200_000, "a"),
            (6, "the and of", "a"), (6, "the and of", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.predict(df, net).collect()
    assert len(got) == 7
    assert {r.id for r in got if r.lang_pred == "und"} == {1, 2, 3}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.predict(df.limit(0), net).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    none = spark.createDataFrame([("x", None), (None, "en"), ("12", "en")], "text string, lang string")
    assert langid.fit(none) is None


def test_stage_drops_what_has_no_language(spark, net):
    rows = [(1, "the and of to in that", None, "s"), (2, "12", "en", "s"), (3, None, "en", "s"),
            (4, "the of and with this", "xx", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = langid.keep_identified(df, net)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(1, "en"), (4, "xx")]


def test_labels_are_bounded(spark):
    df = spark.createDataFrame([(str(i), f"l{i}") for i in range(5)], "text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(df, max_langs=3)
