"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.session import ensure_checkpoint_dir

#: The white space of the token rule ``[^\x20\x09-\x0D]+`` as a character class.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_small(df: DataFrame, rows: int, per_file: int = 50_000) -> DataFrame:
    """``cut`` for a frame of about ``rows`` rows: dealt anew into files of about
    ``per_file`` rows, where its partitions would each leave a file of a few."""
    return cut(df.repartition(rows // per_file + 1))


def told(df: DataFrame, col: str = "id") -> DataFrame:
    """A text column of ids as long again.  Ids pass pandas as text: beside a null it
    would turn whole numbers into doubles, which hold no more than 53 bits."""
    return df.withColumn(col, F.col(col).cast("long"))


def words_of(text: Column) -> Column:
    """Words ``[^\x20\x09-\x0D]+`` of a text as an array (null text: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z lowered (and nothing else)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, vectorised (wraps modulo 2**64)."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph with edges (a, b): every node but the
    smallest of each component, with that smallest node."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def expand_ranges(starts: np.ndarray, counts: np.ndarray, limit: int):
    """For rows i with ``counts[i]`` partners from ``starts[i]`` on, yield
    (row, partner) index arrays of at most about ``limit`` pairs at a time."""
    total = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        c = counts[lo:hi]
        n = int(c.sum())
        if n:
            row = np.repeat(np.arange(lo, hi), c)
            first = np.repeat(np.cumsum(c) - c, c)
            yield row, np.repeat(starts[lo:hi], c) + (np.arange(n) - first)
        lo = hi
