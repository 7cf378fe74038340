"""Registered queries over their whole tables against plain code."""

import hashlib

from test_pii import slow
from test_simhash import slow_components, slow_fingerprint

from logweave.llm import spm
from logweave.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op6_counts_and_digest(spark):
    texts = documents(spark)
    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        spans = slow(text or "")
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        kinds = [k for k, _, _ in spans]
        assert [got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == \
            [kinds.count(k) for k in ("email", "ip", "card", "phone")]


def test_op10_fingerprints_and_components(spark):
    texts = documents(spark)
    ids, fps = list(texts), [slow_fingerprint(t) for t in texts.values()]
    want = {(d, f"{f:016x}", c) for d, f, c in zip(ids, fps, slow_components(fps, ids, 4))}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()} == want


def test_op9_decodes_back(spark):
    texts, tok = documents(spark), spm.Tokenizer.load(PIECES)
    got = QUERIES["op9_sentencepiece"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.lossless and r.n_tokens == len(r.tokens or []) and tok.decode(r.tokens or []) == (texts[r.doc_id] or "")
