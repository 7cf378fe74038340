"""Quality rules and mixing: SQL twins on the test table, brute force and edge cases on small ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.llm import mixing, quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return c


def rows(spark):
    line = "one two three four five six seven eight nine ten"
    return spark.createDataFrame([
        (1, None, "en", "a", "x"), (2, "", "en", "a", "x"), (3, " \t\n", None, None, "x"),
        (None, line * 3, None, "a", "x"), (5, f"{line}\n" * 5, "en", None, "x"), (5, f"{line}\n" * 5, "en", None, "x"),
        (6, " ".join(f"w{i}" for i in range(20_000)), "en", "a", "x"), (7, "a#b $c *d " * 10, "en", "b", "x")], SCHEMA)


def test_quality_equals_sql(spark, con):
    got = quality.adaptive_quality(spark.read.parquet(f"{SF}/documents.parquet"), min_group=10)
    cols = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(quality.oracle(min_group=10)).fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def slow_repeats(text, k=8):
    words = (text or "").split()
    windows = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + k)})


def test_quality_edge_cases(spark):
    df = rows(spark)
    got = quality.adaptive_quality(df).collect()
    assert len(got) == 8
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        text = texts[r.id] or ""
        assert r.n_words == len(text.split()) and r.word_chars == sum(map(len, text.split()))
        assert r.n_repeat_words == (slow_repeats(text) if r.id != 6 else 0)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.id: r.n_dup_lines for r in got}[5] == 4
    assert quality.adaptive_quality(df.limit(0)).count() == 0


def test_sketches_of_parts_merge_to_the_whole(spark):
    df = spark.range(3000).selectExpr("id % 7 AS g", "double(id) AS x")
    parts = df.groupBy("g").agg(F.kll_sketch_agg_double("x", F.lit(1024)).alias("s"))
    q = parts.agg(F.kll_merge_agg_double("s", F.lit(1024)).alias("s")).select(
        F.kll_sketch_get_quantile_double("s", F.lit(0.25))).first()[0]
    assert abs(q - 750) < 30


def test_mixing_equals_sql(spark, con):
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), fraction=0.5, rounds=2)
    got = got.select("id", "source", "lang", "topic", "n_tokens", F.round("rate", 6).alias("rate"), "repeats")
    want = con.execute(mixing.oracle(rounds=2)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_margins_hold_and_tokens_are_kept(spark):
    cells = spark.createDataFrame([(f"s{i % 5}", f"l{i % 3}", f"t{i % 2}", 10 + i * i) for i in range(30)],
                                  "source string, lang string, topic string, tokens long") \
        .groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    shares = spark.createDataFrame([("l0", 0.5), ("l1", 0.3), ("l2", 0.2)], "value string, share double")
    out = mixing.rake(cells, {"source": 0.0, "topic": 0.5, "lang": shares}, rounds=5).collect()
    total = sum(r.tokens for r in out)
    assert sum(r.weight for r in out) == pytest.approx(total)
    for lang, share in (("l0", 0.5), ("l1", 0.3), ("l2", 0.2)):
        assert sum(r.weight for r in out if r.lang == lang) == pytest.approx(share * total, rel=1e-6)
    for s in range(5):
        assert sum(r.weight for r in out if r.source == f"s{s}") == pytest.approx(total / 5, rel=1e-3)


def test_mixing_edge_cases(spark):
    df = rows(spark)
    got = mixing.mix(df, fraction=1.0, rounds=1).collect()
    assert len(got) == 8 and all(r.rate >= 0 and r.repeats in (int(r.rate), int(r.rate) + 1) for r in got)
    twins = [r.repeats for r in got if r.id == 5]
    assert twins[0] == twins[1]
    kept = mixing.sample(df, fraction=1.0, rounds=1)
    assert kept.columns == df.columns and kept.count() == sum(r.repeats > 0 for r in got)
    assert mixing.mix(df.limit(0), rounds=1).count() == 0 and mixing.sample(df.limit(0), rounds=1).count() == 0


def test_topics_take_the_first_rule(spark):
    df = spark.createDataFrame([("the Licence | a",), ("x | y",), (None,), ("abc 123",)], "text string")
    assert [r[0] for r in df.select(mixing.topic_of(F.col("text"))).collect()] == ["legal", "tabular", "prose", "numeric"]


def test_the_drawn_sample_holds_the_targets(spark):
    """A hot source and thin ones: rates above 1 repeat their rows instead of counting once."""
    import corpus_pipeline
    texts = {"prose": "plain words " * 10, "legal": "licence words " * 10}
    data = [(i, texts["prose" if i % 10 else "legal"], ("en", "de", None)[min(i % 7, 2) if i % 2 else 0],
             "hot" if i < 2000 else f"s{i % 4}", 0) for i in range(2600)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, df, "").select("*", mixing.topic_of(F.col("text")).alias("topic"))
    assert out.columns[:5] == df.columns
    got, total = out.collect(), 20 * len(data)
    assert 20 * len(got) == pytest.approx(corpus_pipeline.MIX_FRACTION * total, rel=0.03)
    assert max(r.rate for r in mixing.mix(df, fraction=corpus_pipeline.MIX_FRACTION).collect()) > 1
    for dim, power in mixing.POWERS.items():
        have = {}
        for r in df.select("*", mixing.topic_of(F.col("text")).alias("topic")).collect():
            have[r[dim]] = have.get(r[dim], 0) + 20
        goal = {k: v ** power for k, v in have.items()}
        for k, v in goal.items():
            assert sum(r[dim] == k for r in got) / len(got) == pytest.approx(v / sum(goal.values()), abs=0.03), (dim, k)
    repeats = {r.id: r.repeats for r in mixing.mix(df, fraction=corpus_pipeline.MIX_FRACTION).collect()}
    assert all(sum(g.doc_id == i for g in got) == repeats[i] for i in range(0, 2600, 50))


def test_drawing_keeps_columns_of_any_name(spark):
    rows = [(i, f"some words of text {i}", "en", f"s{i % 2}", "a", "b", "c", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _copy string, _mix_key string, "
                               "key string, `a.b` int")
    out = mixing.draw(df, fraction=1.0, rounds=2)
    assert out.dtypes == df.dtypes
    got = out.collect()
    assert len(got) >= 20 and {tuple(r) for r in got} <= {tuple(r) for r in df.collect()}
