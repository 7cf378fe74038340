"""The pipeline against the operators' plain functions, stage by stage."""

from test_simhash import slow_components

import corpus_pipeline
from logweave.llm import langid, mixing, pii, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    net = langid.fit(docs)
    langs, scores = langid.predict_texts(net, [r.text for r in rows.values()])
    kept = {d: r for (d, r), lang, s in zip(rows.items(), langs, scores) if lang != "und" and s >= 0.4}
    fps = [simhash.fingerprint(r.text) for r in kept.values()]
    comp = slow_components(fps, list(kept), 4)
    kept = {d: r for (d, r), c in zip(kept.items(), comp) if c == d}
    clean = spark.createDataFrame([(d, pii.redact(r.text), r.lang, r.source, 0) for d, r in kept.items()],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    drawn = {r.id for r in mixing.mix(clean, fraction=0.8).where("repeats > 0").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == drawn and len(got) > 50
    import sentencepiece
    from logweave.llm.queries import PIECES
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for d, r in got.items():
        assert r.lossless and lib.decode(list(r.tokens)) == pii.redact(kept[d].text)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0),
         (10**6 + 1, "the of and to in that for with", None, None, 3)], docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "personal_data", "mixing", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.dtypes == docs.dtypes
            out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == 9
