"""Language identification by a byte convolutional network.

Byte embeddings, filters of several widths, max pooling and a softmax are
trained in numpy on windows of a bounded sample of labelled texts.  Prediction
cuts every whole text into fixed-length windows, runs them in batches and
averages the window probabilities by window length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import lower_bytes, told

UNDETERMINED = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Parameters; filters of all widths are zero-padded to the largest, so one
    matrix product serves them."""

    langs: list[str]
    emb: np.ndarray      # 256 x EMBEDDING, row 0 (padding) stays zero
    conv: np.ndarray     # (width * EMBEDDING) x filters
    conv_b: np.ndarray
    out: np.ndarray      # filters x languages
    out_b: np.ndarray
    tables: list[np.ndarray] | None = None  # made where predictions are made

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(n, positions, width * EMBEDDING) inputs of the filters."""
        width = len(self.conv) // EMBEDDING
        x = self.emb[np.pad(windows, ((0, 0), (0, width - 1)))]
        n, places = len(windows), windows.shape[1]
        return np.concatenate([x[:, k:k + places] for k in range(width)], axis=2).reshape(n, places, -1)

    def filtered(self, cols: np.ndarray) -> np.ndarray:
        z = cols.reshape(-1, cols.shape[2]) @ self.conv
        return z.reshape(*cols.shape[:2], -1)

    def pair_tables(self) -> list[np.ndarray]:
        """What each pair of neighbouring bytes adds to all filters, by the pair's
        place in the filter: a convolution is then a sum of looked-up rows."""
        single = [self.emb @ self.conv[k * EMBEDDING:(k + 1) * EMBEDDING] for k in range(len(self.conv) // EMBEDDING)]
        if len(single) % 2:
            single.append(np.zeros_like(single[0]))
        return [(a[:, None] + b[None]).reshape(65536, -1) for a, b in zip(single[::2], single[1::2])]

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        if not len(windows):
            return out
        if self.tables is None:
            self.tables = self.pair_tables()
        for lo in range(0, len(windows), batch):
            x = np.pad(windows[lo:lo + batch], ((0, 0), (0, 2 * len(self.tables) - 1))).astype(np.intp)
            pair = x[:, :-1] * 256 + x[:, 1:]
            places = windows.shape[1]
            z = self.tables[0].take(pair[:, :places], axis=0, mode="clip")
            for k, table in enumerate(self.tables[1:], 1):
                z += table.take(pair[:, 2 * k:2 * k + places], axis=0, mode="clip")
            out[lo:lo + batch] = _softmax(np.maximum(z.max(axis=1) + self.conv_b, 0) @ self.out + self.out_b)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(data: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (zero-padded at each text's end), their text's index and their bytes."""
    counts = np.array([-(-len(b) // size) for b in data], np.int64)
    joined = b"".join(b.ljust(n * size, b"\0") for b, n in zip(data, counts.tolist()))
    windows = np.frombuffer(joined, np.uint8).reshape(-1, size)
    owner = np.repeat(np.arange(len(data)), counts)
    filled = np.full(len(windows), size, np.int64)
    full = counts > 0
    filled[np.cumsum(counts)[full] - 1] -= (counts * size - [len(b) for b in data])[full]
    return windows, owner, filled


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 900,
          batch: int = 96, rate: float = 4e-3, seed: int = 42) -> Network:
    """Fit the network by Adam on windows (n, WINDOW) with label numbers.

    Each step draws languages evenly and crops windows to a random length, so
    short texts are seen as well.
    """
    rng = np.random.default_rng(seed)
    width = max(WIDTHS)
    keep = np.concatenate([np.repeat(np.arange(width) < w, EMBEDDING)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    n_filters = FILTERS * len(WIDTHS)
    f32 = lambda a: a.astype(np.float32)
    net = Network(langs, f32(rng.normal(0, 0.5, (256, EMBEDDING))),
                  f32(rng.normal(0, 0.25, (width * EMBEDDING, n_filters)) * keep), np.zeros(n_filters, np.float32),
                  f32(rng.normal(0, 0.2, (n_filters, len(langs)))), np.zeros(len(langs), np.float32))
    net.emb[0] = 0
    parts = ["emb", "conv", "conv_b", "out", "out_b"]
    first = {p: np.zeros_like(getattr(net, p)) for p in parts}
    second = {p: np.zeros_like(getattr(net, p)) for p in parts}
    by_lang = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), batch)
        x = windows[[by_lang[k][rng.integers(len(by_lang[k]))] for k in y]]
        x = x[:, : int(2 ** rng.uniform(3.5, np.log2(x.shape[1])))]
        cols = net.columns(x)
        z = net.filtered(cols)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + net.conv_b
        h = np.maximum(top, 0)
        p = _softmax(h @ net.out + net.out_b)
        p[np.arange(batch), y] -= 1
        p /= batch
        dh = (p @ net.out.T) * (top > 0)
        hit = cols[np.arange(batch)[:, None], at]                   # batch x filters x inputs
        padded = np.pad(x, ((0, 0), (0, width - 1)))
        bytes_hit = padded[np.arange(batch)[:, None, None], at[:, :, None] + np.arange(width)]
        demb = np.zeros_like(net.emb)
        np.add.at(demb, bytes_hit, (dh[:, :, None] * net.conv.T).reshape(batch, n_filters, width, EMBEDDING))
        demb[0] = 0
        grads = {"emb": demb, "conv": np.einsum("bf,bfi->if", dh, hit) * keep, "conv_b": dh.sum(0),
                 "out": h.T @ p, "out_b": p.sum(0)}
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for part, g in grads.items():
            first[part] += 0.1 * (g - first[part])
            second[part] += 0.01 * (g * g - second[part])
            scale = (1 - 0.9 ** step), (1 - 0.99 ** step)
            value = getattr(net, part)
            value -= (now * (first[part] / scale[0]) / (np.sqrt(second[part] / scale[1]) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 1500,
        windows_per_row: int = 4, max_langs: int = 500, seed: int = 42, **training) -> Network | None:
    """Train on a bounded sample: about ``rows_per_lang`` distinct labelled texts of
    each language, at most ``windows_per_row`` evenly spaced windows of each.

    Rows without a label or a letter are not used; without any other, there is
    no model (None).  More than ``max_langs`` labels are refused.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} labels in {lang_col}")
    if not counts:
        return None

    def windows(batches):
        for b in batches:
            found = []
            for t in b["text"]:
                w = cut_windows([lower_bytes(t)])[0] if _LETTER.search(t) else np.zeros((0, WINDOW), np.uint8)
                picks = np.unique(np.linspace(0, len(w) - 1, min(windows_per_row, len(w))).astype(int)) if len(w) else []
                found.append([w[k].tobytes() for k in picks])
            yield pd.DataFrame({"h": b["h"], "lang": b["lang"], "w": found})

    place = F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 11) / F.lit(2.0 ** 53)
    share = reduce(lambda c, kv: c.when(F.col("lang") == kv[0], min(1.0, rows_per_lang / kv[1])),
                   sorted(counts.items()), F.when(F.lit(False), 0.0))
    chosen = rows.where(place < share).withColumn("h", F.xxhash64("text"))
    sample = chosen.mapInPandas(windows, "h long, lang string, w array<binary>") \
        .dropDuplicates(["h", "lang"]).limit(2 * rows_per_lang * len(counts)).toPandas().sort_values(["lang", "h"])
    pairs = [(lang, w) for lang, ws in zip(sample["lang"], sample["w"]) for w in ws]
    if not pairs:
        return None
    langs = sorted({lang for lang, _ in pairs})
    number = {lang: k for k, lang in enumerate(langs)}
    x = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([number[lang] for lang, _ in pairs]), langs, seed=seed, **training)


def predict_texts(net: Network | None, texts) -> tuple[list[str], np.ndarray]:
    """Language and probability of each whole text."""
    data = [lower_bytes(t) if t and _LETTER.search(t) else b"" for t in texts]
    langs, scores = [UNDETERMINED] * len(data), np.zeros(len(data))
    if net is None:
        return langs, scores
    windows, owner, filled = cut_windows(data)
    p = net.probabilities(windows).astype(np.float64) * filled[:, None]
    total = np.zeros((len(data), len(net.langs)))
    np.add.at(total, owner, p)
    for k in np.unique(owner):
        best = int(total[k].argmax())
        langs[k], scores[k] = net.langs[best], min(1.0, total[k, best] / total[k].sum())
    return langs, scores


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score), one per input row, from the text alone.

    Texts that are null or hold no letter are ``und`` with score 0, as is every
    text without a model.  Repeated rows stay repeated; an empty table gives no
    rows; other columns are ignored.
    """
    def run(batches):
        for b in batches:
            langs, scores = predict_texts(net, b["text"])
            yield pd.DataFrame({"id": b["id"], "lang_pred": langs, "score": scores})

    return told(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id string, lang_pred string, score double"))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id modulo 3 is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang",
                    least: float = 0.4) -> DataFrame:
    """``docs`` without the rows whose language cannot be told (``und``, or a best
    probability under ``least``); a null language is filled with the prediction.
    Columns and their order are unchanged."""
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):       # the other columns pass as they are
        for b in batches:
            langs, scores = predict_texts(net, pd.Series(b.column(text).to_pylist(), dtype=object))
            known = [p if x is None else x for x, p in zip(b.column(lang).to_pylist(), langs)]
            ok = [p != UNDETERMINED and s >= least for p, s in zip(langs, scores)]
            field = b.schema.field(lang)
            yield b.set_column(lang, field, pa.array(known, field.type)).filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
