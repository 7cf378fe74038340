"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of n-grams of all orders are mixed with weights
that depend on how often the context was seen; expectation-maximisation learns
the weights on the counts of learning documents held back from the estimates.

Counting and lookup travel in blocks.  Documents are dealt into blocks of some
megabytes; a block sends each distinct n-gram once, with its counts, to the
n-gram's bucket; buckets add up the counts of all blocks and answer each block
in the order it asked.  So a frequent n-gram costs one entry a block, and no
vocabulary is ever gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, lower_bytes, mix64, told

#: Hash of the end token, which also stands before every text; of no word, as words hold no blank.
END = xxhash.xxh64_intdigest(b"\n", 1)
STEP = 4            # EM reads estimates in steps of a quarter octave
UNSEEN = -10_000
TOP = 24            # context-frequency buckets: 0, 1, 2-3, 4-7, ...


def _planes(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes (high bytes are mostly zero)."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return zstandard.ZstdCompressor(level=1).compress(flat)


def _unplane(data: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).reshape(-1)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplane(data, np.uint64), dtype=np.uint64)


class Block:
    """The n-grams of some texts: tokens in a row, and per order the sorted
    distinct hashes and each token's place among them."""

    def __init__(self, texts, order: int):
        index: dict[bytes, int] = {}
        ids, lengths = [], []
        for t in texts:
            words = lower_bytes(t).split()
            lengths.append(len(words) + 1)
            got = np.empty(len(words) + 1, np.int64)
            got[:-1] = [index.setdefault(w, len(index) + 1) for w in words]
            got[-1] = 0
            ids.append(got)
        self.lengths = np.array(lengths, np.int64)
        self.last = np.cumsum(self.lengths) - 1
        self.first = np.zeros(int(self.lengths.sum()), bool)
        self.first[self.last - self.lengths + 1] = True
        tokens = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        hashes = np.array([END, *(xxhash.xxh64_intdigest(w, 1) for w in index)], np.uint64)
        self.grams, self.place = [], []
        self._file(hashes, tokens)
        local, known, start = tokens, hashes, np.uint64(END)
        for k in range(2, order + 1):
            before = np.where(self.first, len(known), np.concatenate([[0], local[:-1]]))
            pair, local = np.unique(before * len(hashes) + tokens, return_inverse=True)
            context = np.append(known, start)[pair // len(hashes)]
            with np.errstate(over="ignore"):
                known = mix64(context * np.uint64(0x9E3779B97F4A7C15) + hashes[pair % len(hashes)] + np.uint64(k))
            start = mix64(np.array([start + np.uint64(1)]))[0]
            self._file(known, local)

    def _file(self, hashes: np.ndarray, local: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.grams.append(hashes[order])
        self.place.append(rank[local])

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of token values for each text."""
        if not len(self.lengths):
            return np.zeros(0, values.dtype)
        return np.add.reduceat(values, self.last - self.lengths + 1)


def _ask(order: int, buckets: int):
    """Group function over one block: a row for each order and bucket with its n-grams and counts."""
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows["text"], order)
        learn, held = rows["learn"].to_numpy(bool), rows["held"].to_numpy(bool)
        use = [np.repeat(learn & ~held, block.lengths), np.repeat(learn & held, block.lengths)]
        out = []
        for k in range(order):
            grams, place = block.grams[k], block.place[k]
            counts = [np.bincount(place[u], minlength=len(grams)).astype(np.uint32) for u in use]
            edges = np.searchsorted(grams, np.arange(1, buckets, dtype=np.uint64) << shift) if buckets > 1 else []
            cuts = [0, *np.asarray(edges, np.int64).tolist(), len(grams)]
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    out.append((k + 1, b, int(key[0]), _pack_sorted(grams[lo:hi]),
                                _planes(counts[0][lo:hi]), _planes(counts[1][lo:hi])))
        return pd.DataFrame(out, columns=["ord", "bucket", "block", "grams", "d", "h"])
    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Group function over one bucket: the summed counts, in each asking block's own order."""
    asked = [_unpack_sorted(x) for x in rows["grams"]]
    kinds, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = []
    for col in ("d", "h"):
        counts = np.concatenate([_unplane(x, np.uint32) for x in rows[col]])
        total.append(np.bincount(at, counts, len(kinds)).astype(np.int64))
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    parts = [[_planes(x) for x in np.split(t[at], cuts)] for t in total]
    first = np.arange(len(rows)) == 0
    return pd.DataFrame({
        "ord": rows["ord"], "bucket": rows["bucket"], "block": rows["block"], "d": parts[0], "h": parts[1],
        "kinds": np.where(first, int((total[0] + total[1] > 0).sum()), 0),
        "d_total": np.where(first, int(total[0].sum()), 0), "h_total": np.where(first, int(total[1].sum()), 0)})


def _counts(block: Block, replies: pd.DataFrame, order: int) -> list[np.ndarray]:
    """Per order the (estimating, held) counts of each token's n-gram, as an array (tokens, 2)."""
    replies = replies.sort_values(["ord", "bucket"])
    out = []
    for k in range(order):
        own = replies[replies["ord"] == k + 1]
        both = np.stack([np.concatenate([_unplane(x, np.int64) for x in own[c]]) for c in ("d", "h")], 1)
        out.append(both[block.place[k]])
    return out


def _estimates(block: Block, counts: list[np.ndarray], n_tokens: int, n_docs: int, n_kinds: int):
    """Estimates (tokens, order + 1) from uniform upwards, and the context bucket of each token.

    ``counts`` has one column of counts an order.
    """
    mle = np.zeros((len(block.first), len(counts) + 1))
    mle[:, 0] = 1.0 / (n_kinds + 1)
    mle[:, 1] = counts[0] / n_tokens if n_tokens else 0.0
    context = np.full(len(block.first), n_tokens)
    for k in range(1, len(counts)):
        context = np.where(block.first, n_docs, np.concatenate([[0], counts[k - 1][:-1]]))
        mle[:, k + 1] = np.divide(counts[k], context, out=np.zeros(len(context)), where=context > 0)
    bucket = np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, TOP - 1), 0)
    return mle, bucket


def fit_weights(cells: pd.DataFrame, order: int, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """Mixture weights (TOP buckets, order + 1) by expectation-maximisation.

    ``cells`` counts held-back tokens by bucket and the estimates' steps above
    uniform (``q1``...).  Each bucket is smoothed by ``prior`` tokens of the
    weights of all buckets together, so buckets without tokens have those.
    """
    overall = np.full(order + 1, 1.0 / (order + 1))
    weights = np.tile(overall, (TOP, 1))
    if cells.empty:
        return weights
    q = cells[[f"q{k}" for k in range(1, order + 1)]].to_numpy(float)
    ratio = np.concatenate([np.ones((len(q), 1)), np.where(q > UNSEEN / 2, 2.0 ** (q / STEP), 0.0)], axis=1)
    n, bucket = cells["n"].to_numpy(float), cells["b"].to_numpy(int)
    for _ in range(rounds):
        share = overall * ratio
        overall = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
    for _ in range(rounds):
        share = weights[bucket] * ratio
        share *= n[:, None] / share.sum(1, keepdims=True)
        total = np.tile(prior * overall, (TOP, 1))
        np.add.at(total, bucket, share)
        weights = total / total.sum(1, keepdims=True)
    return weights


def _gather(order: int, n_tokens: int, n_docs: int, n_kinds: int):
    """Cogroup function: held-back tokens of a block, counted by bucket and estimate steps."""
    names = [f"q{k}" for k in range(1, order + 1)]

    def run(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or replies.empty:
            return pd.DataFrame(columns=["b", *names, "n"])
        block = Block(docs["text"], order)
        counts = [c[:, 0] for c in _counts(block, replies, order)]
        mle, bucket = _estimates(block, counts, n_tokens, n_docs, n_kinds)
        ratio = mle[:, 1:] / mle[:, :1]
        q = np.where(ratio > 0, np.rint(STEP * np.log2(np.where(ratio > 0, ratio, 1))), UNSEEN).astype(np.int64)
        frame = pd.DataFrame(q, columns=names)
        frame.insert(0, "b", bucket)
        return frame.groupby(["b", *names]).size().rename("n").reset_index()
    return run


def _score(order: int, n_tokens: int, n_docs: int, n_kinds: int, weights: np.ndarray):
    """Cogroup function: scores of a block's texts."""
    cols = ["id", "n_tokens", "n_known", "base_score", "score"]

    def run(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or replies.empty:
            return pd.DataFrame(columns=cols)
        block = Block(docs["text"], order)
        counts = [c.sum(axis=1) for c in _counts(block, replies, order)]
        mle, bucket = _estimates(block, counts, n_tokens, n_docs, n_kinds)
        w = weights[bucket].copy()
        if order > 1:  # an unseen context says nothing: its weight goes to the lower orders
            w[bucket == 0, order] = 0
            w /= w.sum(1, keepdims=True)
        p = np.einsum("ij,ij->i", w, mle)
        return pd.DataFrame({
            "id": docs["id"], "n_tokens": block.lengths, "n_known": block.by_text((counts[0] > 0).astype(np.int64)),
            "base_score": block.by_text(np.log10((counts[0] + 1) / (n_tokens + n_kinds + 1))),
            "score": block.by_text(np.log10(p))})[cols]
    return run


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                    order: int = 2, held_one_in: int = 10, block_bytes: int = 6 << 20,
                    blocks: int | None = None) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one per input row.

    ``learn`` says which rows are learnt from (null: yes).  Tokens are the words
    of the text with A-Z lowered, and an end.  ``base_score`` is the add-one
    unigram score, ``score`` the interpolated n-gram model's; both are log10 of
    the whole text.  One in ``held_one_in`` learning documents (by hash of its
    id) is kept from the estimates while the weights are learnt; the final
    estimates count all learning documents.

    Null and blank texts are the end token alone.  Repeated rows stay repeated
    and are all counted.  Without learning rows every token has the uniform
    probability 1.  An empty table gives no rows; other columns are ignored.
    A block's texts (about ``block_bytes``) and n-grams are the memory of a task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(learn, F.lit(True)).alias("learn"))
    rows = rows.withColumn("held", F.col("learn") & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(held_one_in)) == 0))
    size, n_docs, n_held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)),
                                    F.coalesce(F.sum(F.col("learn").cast("long")), F.lit(0)),
                                    F.coalesce(F.sum(F.col("held").cast("long")), F.lit(0))).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = blocks or max(parts, -(-size // block_bytes))
    own = max(1, n_blocks // held_one_in)          # held-back documents have blocks of their own
    deal = F.xxhash64("id", "text")
    rows = rows.withColumn("block", F.when(F.col("held"), n_blocks + F.pmod(deal, F.lit(own)))
                           .otherwise(F.pmod(deal, F.lit(n_blocks))).cast("long"))
    buckets = 1 << max(0, (n_blocks - 1).bit_length() - 1)
    asked = rows.groupBy("block").applyInPandas(
        _ask(order, buckets), "ord int, bucket int, block long, grams binary, d binary, h binary")
    replies = cut(asked.groupBy("ord", "bucket").applyInPandas(
        _answer, "ord int, bucket int, block long, d binary, h binary, kinds long, d_total long, h_total long"))
    kinds, n_est, n_back = replies.where("ord = 1").agg(*[
        F.coalesce(F.sum(c), F.lit(0)) for c in ("kinds", "d_total", "h_total")]).first()
    sent = replies.select(F.col("block").alias("to"), "ord", "bucket", "d", "h")
    both = lambda d, r: d.groupBy("block").cogroup(r.groupBy("to"))
    cells = both(rows.where("held").select("block", "text"), sent.where(F.col("to") >= n_blocks)).applyInPandas(
        _gather(order, n_est, n_docs - n_held, kinds),
        "b long, " + ", ".join(f"q{k} long" for k in range(1, order + 1)) + ", n long")
    keys = ["b", *[f"q{k}" for k in range(1, order + 1)]]
    weights = fit_weights(cells.groupBy(*keys).agg(F.sum("n").alias("n")).toPandas().sort_values(keys), order)
    if not n_est + n_back:
        weights = np.tile(np.eye(order + 1)[0], (TOP, 1))
    scored = both(rows.select("block", F.col("id").cast("string").alias("id"), "text"), sent).applyInPandas(
        _score(order, n_est + n_back, n_docs, kinds, weights),
        "id string, n_tokens long, n_known long, base_score double, score double")
    return told(scored).select("id", "n_tokens", "n_known", F.lit(n_est + n_back).cast("long").alias("train_tokens"),
                         "base_score", "score")
