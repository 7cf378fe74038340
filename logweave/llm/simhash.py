"""SimHash near-duplicate detection with pigeonring candidate filtering.

A fingerprint is cut into ``m`` segments on a ring.  If two fingerprints
differ in at most ``t`` bits, some start segment exists from which every chain
of j consecutive segments holds at most j*t/m differing bits.  The first
``chain`` segments of every start become a key: a row is indexed under its own
key and probes all keys its budgets allow.  Candidates then have to stay
within the budgets of the longer chains before the full Hamming check.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, expand_ranges, lower_bytes, star_edges, told
from logweave.llm.components import components

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles (repeats included) as an unsigned integer."""
    words = lower_bytes(text).split()
    if not words:
        return 0
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        data = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(data[s:e], SEED) for s, e in zip(first, ends[shingle - 1:].tolist())],
                     dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 4096):
        part = np.ascontiguousarray(h[lo:lo + 4096], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 4, mark: Column | None = None) -> DataFrame:
    """Rows (id, fp): one per input row; ``fp`` holds the 64 bits as a signed long.

    Null, empty and blank texts have fingerprint zero.  ``mark`` adds a text
    column of that name.
    """
    extra = [] if mark is None else ["mark"]

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b["text"]), np.uint64, len(b))
            yield b[["id", *extra]].assign(fp=fps.view(np.int64))

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                       *([] if mark is None else [mark.alias("mark")]))
    return told(rows.mapInPandas(run, ", ".join([f"{c} string" for c in ["id", *extra]] + ["fp long"])))


class Ring:
    """Segment layout and chain budgets for ``bits`` differing bits on ``m`` segments."""

    def __init__(self, bits: int, m: int | None = None, chain: int = 2):
        self.bits, self.m = bits, m or bits + 1
        if not 0 <= bits < BITS or not 1 <= self.m <= BITS:
            raise ValueError("bits must be 0..63 and segments 1..64")
        self.chain = min(chain, self.m)
        cuts = [round(i * BITS / self.m) for i in range(self.m + 1)]
        self.segments = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(self.m)]
        self.budget = [(j + 1) * bits // self.m for j in range(self.m)]

    def mask(self, start: int, length: int) -> int:
        """Bits of ``length`` consecutive segments from ``start`` on the ring."""
        out = 0
        for j in range(length):
            lo, width = self.segments[(start + j) % self.m]
            out |= ((1 << width) - 1) << lo
        return out

    def flips(self, start: int) -> list[int]:
        """Masks of the bit sets that the budgets let the key chain differ in."""
        places = [(j, lo + k) for j in range(self.chain)
                  for lo, width in [self.segments[(start + j) % self.m]] for k in range(width)]
        out = []
        for n in range(self.budget[self.chain - 1] + 1):
            for chosen in combinations(places, n):
                if all(sum(j <= upto for j, _ in chosen) <= self.budget[upto]
                       for upto in range(self.chain)):
                    out.append(sum(1 << at for _, at in chosen))
        return out

    def fits(self, diff: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether all chains from ``start`` stay within budget; shorter chains prune first."""
        ok = np.arange(len(diff))
        for length in range(1, self.m + 1):
            masks = np.array([self.mask(s, length) for s in range(self.m)], dtype=np.uint64)
            ok = ok[np.bitwise_count(diff[ok] & masks[start[ok]]) <= self.budget[length - 1]]
        return ok


def _key_rows(fp: np.ndarray, ring: Ring, probes: bool):
    """(start, key, fp, flipped) arrays: the own keys, or the keys probed.

    Of two fingerprints that differ inside the key chain the one whose lowest
    differing key bit is 0 probes the other, so each pair meets once.
    """
    for start in range(ring.m):
        part = np.uint64(ring.mask(start, ring.chain))
        for flip in ring.flips(start) if probes else [0]:
            use = fp if not flip else fp[(fp & np.uint64(flip & -flip)) == 0]
            yield start, (use & part) ^ np.uint64(flip), use, bool(flip)


def _keyed(classes: DataFrame, ring: Ring, probes: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(fp), 20_000):
                for start, key, use, flipped in _key_rows(fp[lo:lo + 20_000], ring, probes):
                    yield pd.DataFrame({"start": np.full(len(use), start, np.int32), "key": key.view(np.int64),
                                        "fp": use.view(np.int64), "probe": probes, "flipped": flipped})

    return classes.select("fp").mapInPandas(
        run, "start int, key long, fp long, probe boolean, flipped boolean")


def _verify(ring: Ring, pair_block: int):
    """Partition function: meets index and probe rows by key, checks, emits spanning edges."""
    def run(batches):
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        if rows.empty:
            return
        cell = pd.factorize(pd.MultiIndex.from_frame(rows[["start", "key", "cell"]]))[0] \
            if rows["cell"].any() else rows.groupby(["start", "key"], sort=False).ngroup().to_numpy()
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        start = rows["start"].to_numpy(np.int64)
        probe, flipped = rows["probe"].to_numpy(bool), rows["flipped"].to_numpy(bool)
        own = np.flatnonzero(~probe)
        own = own[np.argsort(cell[own], kind="stable")]
        asks = np.flatnonzero(probe)
        lo = np.searchsorted(cell[own], cell[asks], side="left")
        n = np.searchsorted(cell[own], cell[asks], side="right") - lo
        keep_u, keep_v = [], []
        for ask, at in expand_ranges(lo, n, pair_block):
            a, b = asks[ask], own[at]
            once = flipped[a] | (fp[a] < fp[b])
            a, b = a[once], b[once]
            good = ring.fits(fp[a] ^ fp[b], start[a])
            a, b = fp[a[good]], fp[b[good]]
            full = np.bitwise_count(a ^ b) <= ring.bits
            u, v = star_edges(a[full].view(np.int64), b[full].view(np.int64))
            keep_u.append(u)
            keep_v.append(v)
        if keep_u:
            u, v = star_edges(np.concatenate(keep_u), np.concatenate(keep_v))
            yield pd.DataFrame({"u": u, "v": v})
    return run


def links(classes: DataFrame, bits: int = 4, segments: int | None = None, chain: int = 2,
          bucket_rows: int = 4096, pair_block: int = 1_000_000,
          part_rows: int = 2_000_000) -> DataFrame:
    """Spanning edges (u, v) of the graph "at most ``bits`` differing bits" over
    the distinct fingerprints ``classes.fp``.

    Every pair within the bound is checked in some bucket; of the pairs found
    in one partition only a spanning forest leaves it, so a group of near
    copies costs edges in proportion to its members.  A key whose bucket holds
    more than ``bucket_rows`` fingerprints is dealt out over a square of cells
    in which every index row still meets every probe.  ``chain`` lengthens the
    keys for larger corpora.
    """
    ring = Ring(bits, segments, chain)
    own = _keyed(classes, ring, probes=False)
    hot = cut(own.groupBy("start", "key").count().where(F.col("count") > bucket_rows)
              .select("start", "key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("side")))
    rows = own.unionByName(_keyed(classes, ring, probes=True))
    if hot.isEmpty():
        rows = rows.withColumn("cell", F.lit(0))
    else:
        side = F.col("side")
        place = F.pmod(F.xxhash64("fp", "probe"), side).cast("int")
        cells = F.when(side.isNull(), F.array(F.lit(0))).otherwise(F.transform(
            F.sequence(F.lit(0), F.coalesce(side, F.lit(1)) - 1),
            lambda k: F.when(F.col("probe"), k * side + place).otherwise(place * side + k)))
        rows = rows.join(hot, ["start", "key"], "left").withColumn("cell", F.explode(cells)).drop("side")
    # A partition is held by one task: as many as keep it at about ``part_rows`` rows.
    keys = ring.m + sum(len(ring.flips(s)) for s in range(ring.m))
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                classes.count() * keys // part_rows + 1)
    return rows.repartition(parts, "start", "key", "cell").mapInPandas(
        _verify(ring, pair_block), "u long, v long")


def _rooted(classes: DataFrame, bits: int, segments: int | None, chain: int) -> DataFrame:
    """``classes`` with the ``root`` of each fingerprint's group."""
    roots = components(links(classes, bits, segments, chain))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 4, bits: int = 4, segments: int | None = None,
                   chain: int = 2) -> DataFrame:
    """Rows (id, fingerprint, component_id), one per input row.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest
    non-null id reachable over links of at most ``bits`` differing bits, the
    row's own id included (null when no row of the group has an id).  Rows
    without words share fingerprint zero and are linked like any other.
    Repeated rows stay repeated; an empty table gives no rows; other columns
    are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    named = _rooted(classes, bits, segments, chain)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    comp = named.join(least, "root").select("fp", "component_id")
    return fps.join(comp, "fp").select(
        "id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                     bits: int = 4, segments: int | None = None, chain: int = 2) -> DataFrame:
    """One row of ``docs`` for each SimHash group: that with the smallest id, rows
    without an id last; among equal ids that whose text has the smallest SHA-256
    (a null text before all), among equal texts that whose other columns come
    first as JSON.  Rows of different groups stay even where they share an id.
    Columns are unchanged; an empty table gives no rows.
    """
    mark = F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit(""))
    fps = cut(fingerprints(docs, id_col, text_col, shingle, mark))
    classes = cut(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")))
    kept = _rooted(classes, bits, segments, chain).groupBy("root").agg(F.min("first").alias("first")) \
        .select(F.col("first.id").alias("kept_id"), F.col("first.mark").alias("kept_mark"))
    row, others = F.struct(*[F.col(c) for c in docs.columns]), [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), mark.alias("own_mark"), row.alias("row")).join(
        kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_mark") == F.col("kept_mark")), "left_semi")
    order = F.to_json(F.struct(*[F.col("row")[c] for c in others])) if others else F.lit("")
    return rows.groupBy("own_id", "own_mark").agg(F.min_by("row", order).alias("row")).select("row.*")
