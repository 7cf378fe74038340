"""Ids and untouched columns survive every path through Python workers, whatever stands beside them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import html, langid, lm, pii, simhash, spm, urls
from logweave.llm.queries import PIECES

IDS = [2 ** 53 + 1, None, 2 ** 63 - 1, -2 ** 63, 2 ** 53 + 3, None, 7]
TEXT = "the of and to in that for with this is a plain line of some words number {} at the end of it"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT.format(chr(97 + k) * (k + 1)), "en" if k % 2 else None, f"s{k}", None if k == 1 else 2 ** 60 + k)
            for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, DOCS).coalesce(1)


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.com/"), "source").alias("url"),
                       F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))


def key(i):
    return (i is not None, i or 0)


RUNS = {
    "op1": lambda d: langid.predict(d, None),
    "op3": lambda d: lm.score_documents(d, F.lit(True), blocks=1),
    "op4": lambda d: html.main_text(pages(d)),
    "op6": lambda d: pii.find_pii(d),
    "op7": lambda d: urls.filter_urls(pages(d)),
    "op9": lambda d: spm.tokenize(d, spm.Tokenizer.load(PIECES), keep=("n_chars",)),
    "op10": lambda d: simhash.simhash_groups(d),
    "op10 fingerprints": lambda d: simhash.fingerprints(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_ids_survive(docs, name):
    assert sorted((r.id for r in RUNS[name](docs).collect()), key=key) == sorted(IDS, key=key)


def test_kept_columns_survive(docs):
    got = {(r.id, r.n_chars) for r in RUNS["op9"](docs).collect()}
    assert got == {(r.doc_id, r.n_chars) for r in docs.collect()}


@pytest.mark.parametrize("stage", ["language_id", "personal_data"])
def test_stages_leave_other_columns(spark, docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    # The networks learn from labelled rows: enough of them, in two languages.
    more = spark.createDataFrame([(100 + i, (TEXT if i % 2 else "der die das und ist nicht ein eine mit von zu {}").format(i),
                                   "en" if i % 2 else "de", "s", 1) for i in range(60)], DOCS)
    got = run(spark, docs.unionByName(more), "").where("source <> 's'").collect()
    same = lambda r: (r.doc_id, r.source) + (() if stage == "personal_data" else (r.text, r.n_chars))
    assert sorted(map(same, got), key=repr) == sorted(map(same, docs.collect()), key=repr)
    if stage == "personal_data":
        assert {r.text for r in got} == {r.text for r in docs.collect()}


def test_tokens_decode_over_a_table(spark, docs):
    """Encoding with dropout and decoding give every text back, rows and other columns as they were."""
    texts = [None, "", " ", "a  b\n\nc ", "naïve ▁ mark \x00 ünïcode 漢字 🙂", "x" * 30_000, "Hello, world. " * 3000]
    rows = spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(texts)], DOCS).unionByName(docs)
    tok = spm.Tokenizer.load(PIECES, alpha=0.3, seed=5)
    back = spm.detokenize(spm.tokenize(rows, tok, keep=("source", "n_chars")), tok)
    assert back.columns == ["id", "source", "n_chars", "text", "n_tokens", "lossless"]
    want = sorted(((r.doc_id, r.source, r.n_chars, r.text) for r in rows.collect()), key=repr)
    assert sorted(((r.id, r.source, r.n_chars, r.text) for r in back.collect()), key=repr) == want
    assert spm.detokenize(spm.tokenize(rows.limit(0), tok), tok).count() == 0
    odd = spark.createDataFrame([(1, [10 ** 6]), (2, [-3]), (3, [tok.byte_ids[0xE6], tok.byte_ids[0xBC]]), (4, [None]), (5, None), (6, [])],
                                "id long, tokens array<int>")
    assert {r.id: r.text for r in spm.detokenize(odd, tok).collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: ""}
