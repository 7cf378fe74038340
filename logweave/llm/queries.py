"""Registered queries of the operators: each over its whole table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import contamination, conversations, html, langid, lm, merkle, mixing, pii, pq, quality, simhash, spm, urls

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 4-word shingles, at most 4 differing bits."""
    docs = _table(spark, sf_dir, "documents")
    return simhash.simhash_groups(docs, shingle=4, bits=4).withColumnRenamed("id", "doc_id")


@_query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    out = pq.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


@_query
def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and adaptive verdict of all documents."""
    out = quality.adaptive_quality(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


ORACLE["op5_adaptive_quality"] = quality.oracle()


@_query
def op2_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked rate and drawn repeats of all documents for a sample of half the tokens."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), fraction=0.5)
    return out.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens",
                      F.round("rate", 6).alias("rate"), "repeats")


ORACLE["op2_mixing_weights"] = mixing.oracle()


@_query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, path rule and verdict of all page URLs."""
    out = urls.filter_urls(_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


ORACLE["op7_url_filter"] = urls.oracle()


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base counts and digest, and all spans.

    The counts are of base spans, like the digest; ``n_added`` counts the rest.
    """
    out = pii.find_pii(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind)))
    return out.select(F.col("id").alias("doc_id"), *[of(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
                      F.sha2(pii.spans_text(F.col("spans"), base_only=True), 256).alias("base_sha256"),
                      pii.spans_text(F.col("spans")).alias("spans"),
                      F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; learnt from those not held out."""
    docs = _table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, net).select(
        F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


#: A public BPE model with byte fallback.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@_query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents with merge-dropout 0.1, and whether they decode back."""
    tokenizer = spm.Tokenizer.load(PIECES, alpha=0.1, seed=42)
    return spm.tokenize(_table(spark, sf_dir, "documents"), tokenizer).withColumnRenamed("id", "doc_id")


@_query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and interpolated bigram score of all documents."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = lm.score_documents(_table(spark, sf_dir, "documents"), ~held, order=2)
    return out.withColumnRenamed("id", "doc_id").select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.main_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and each document's proof against a copy tampered in one of five."""
    manifest = merkle.build(_table(spark, sf_dir, "documents"), claim=merkle.tampered_leaf(one_in=5))
    return manifest.proofs().select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                                    "folded_root", "verified")


ORACLE["op13_merkle_manifest"] = merkle.oracle()


@_query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside 10-word windows of benchmark items, and those items."""
    out = contamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op11_decontamination"] = contamination.oracle()


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of all conversations after damage."""
    rows = _table(spark, sf_dir, "conversations")
    return conversations.audit_conversations(conversations.damage(rows), rows)


ORACLE["op12_conversation_repair"] = conversations.oracle()
