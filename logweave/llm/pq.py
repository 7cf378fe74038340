"""Embedding near-duplicates by product quantisation with exact cosine rerank.

Vectors are scaled to length one, so cosine >= c means distance <= r with
r*r = 2 - 2c.  Coarse centroids give inverted lists; the residual to the list's
centroid is coded per subspace.  A query visits every list whose boundary with
its own list is within r, compares codes by table-lookup distances, drops those
farther than r and the length the code leaves out, and reranks what survives by
the cosine in double precision.  Both bounds follow from the triangle
inequality, so no link is lost.

Model fitting uses a bounded sample; every vector is indexed and is a query.
Lists travel in groups; of two vectors in different groups the one of the lower
group visits, and the link counts for both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, star_edges
from logweave.llm.components import components

MARGIN = 1e-4   # rounding of square distances in single precision


@dataclass
class Model:
    """Coarse centroids (lists x d) and codebooks (subspaces x codes x width)."""

    coarse: np.ndarray
    books: np.ndarray
    dim: int
    between: np.ndarray | None = None

    def __post_init__(self):
        sq = (self.coarse ** 2).sum(1)
        self.between = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * self.coarse @ self.coarse.T, 0))

    def split(self, x: np.ndarray) -> np.ndarray:
        """(n, subspaces, width); the dimension is padded with zeros to fit."""
        m, _, w = self.books.shape
        pad = np.zeros((len(x), m * w), np.float32)
        pad[:, : self.dim] = x
        return pad.reshape(len(x), m, w)

    def coarse_distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x ** 2).sum(1)[:, None] + (self.coarse ** 2).sum(1)[None] - 2 * x @ self.coarse.T, 0)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, subspaces) and the length of what the codes leave out."""
        parts = self.split(residual)
        codes = np.empty(parts.shape[:2], np.uint8)
        left = np.zeros(len(parts))
        for j, book in enumerate(self.books):
            d = _square_distances(parts[:, j], book)
            codes[:, j] = d.argmin(1)
            left += np.maximum(d.min(1), 0)
        return codes, np.sqrt(left)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Asymmetric distances (n, subspaces, codes) of queries to the code words."""
        parts = self.split(residual)
        return np.stack([_square_distances(parts[:, j], book) for j, book in enumerate(self.books)], 1)


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None] - 2 * x @ c.T


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([_square_distances(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def fit(sample: np.ndarray, lists: int, subspaces: int, codes: int, seed: int, rounds: int = 8) -> Model:
    """Train centroids and residual codebooks on unit vectors ``sample`` (n, d)."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    coarse = _kmeans(x, lists, rounds, rng)
    width = -(-x.shape[1] // subspaces)
    model = Model(coarse, np.zeros((subspaces, min(codes, 256), width), np.float32), x.shape[1])
    parts = model.split(x - coarse[model.coarse_distances(x).argmin(1)])
    model.books = np.stack([_kmeans(parts[:, j], min(codes, 256), rounds, rng) for j in range(subspaces)])
    return model


def usable(v: Column) -> Column:
    """Whether a vector can have a cosine: no null or non-finite component, not zero."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(values) -> tuple[np.ndarray, np.ndarray]:
    raw = np.array(list(values), dtype=np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw ** 2).sum(1, keepdims=True)), raw


def _groups(model: Model, sizes: np.ndarray, rows: int) -> np.ndarray:
    """Group of each list: neighbouring lists of about ``rows`` vectors together."""
    spread = model.coarse - model.coarse.mean(0)
    order = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")
    out = np.zeros(len(order), np.int64)
    out[order] = np.floor((np.cumsum(sizes[order]) - sizes[order] / 2) / rows)
    return out


def _assign(model: Model, reach: float, group: np.ndarray):
    """Partition function: own list of each vector, and the groups it visits as a query."""
    of = np.zeros((len(group), int(group.max()) + 1), np.float32)
    of[np.arange(len(group)), group] = 1

    def run(batches):
        for b in batches:
            if b.empty:
                continue
            x = _unit(b["vec"])[0].astype(np.float32)
            d = model.coarse_distances(x)
            home = d.argmin(1)
            gap = d - d[np.arange(len(x)), home][:, None]
            visit = gap <= 2 * reach * model.between[home] + MARGIN
            visit[np.arange(len(x)), home] = True
            met = (visit.astype(np.float32) @ of > 0) & (np.arange(of.shape[1]) >= group[home][:, None])
            yield pd.DataFrame({"key": b["key"], "vec": b["vec"], "weight": b["weight"], "home": home,
                                "part": group[home], "visits": [np.flatnonzero(v).tolist() for v in met]})
    return run


def _match(model: Model, cosine: float, reach: float, slack: float | None, pair_block: int):
    """Group function (one cell of one group of lists): members against visiting queries."""
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(key, members: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if members.empty or asks.empty:
            return pd.DataFrame({"key": [], "n": [], "root": []})
        xs, qs = _unit(members["vec"])[0], _unit(asks["ask_vec"])[0]
        mk, qk = members["key"].to_numpy(np.int64), asks["ask_key"].to_numpy(np.int64)
        mw, qw = members["weight"].to_numpy(np.int64), asks["ask_weight"].to_numpy(np.int64)
        homes, own = asks["ask_home"].to_numpy(np.int64), asks["ask_part"].to_numpy(np.int64)
        visitor = own != key[0]
        gaps = model.coarse_distances(qs.astype(np.float32))
        out, back = np.zeros(len(asks), np.int64), np.zeros(len(members), np.int64)
        us, vs = [], []
        lists = members["home"].to_numpy(np.int64)
        for c in np.unique(lists).tolist():
            mine = np.flatnonzero(lists == c)
            near_by = gaps[:, c] - gaps[np.arange(len(qs)), homes] <= 2 * reach * model.between[homes, c] + MARGIN
            come = np.flatnonzero(near_by | (homes == c))
            x, centre = xs[mine], model.coarse[c]
            codes, left = model.encode((x - centre).astype(np.float32))
            bound = (r + left) ** 2 if slack is None else r * r + left ** 2 + 2 * slack * r * left / np.sqrt(model.dim)
            bound = (bound + MARGIN)[:, None]
            step = max(1, pair_block // len(x))
            for lo in range(0, len(come), step):
                at_q = come[lo:lo + step]
                table = model.tables((qs[at_q] - centre).astype(np.float32))
                # (codes, queries) tables: a member's code fetches one contiguous row.
                near = np.zeros((len(x), len(at_q)), np.float32)
                for j in range(codes.shape[1]):
                    near += np.ascontiguousarray(table[:, j].T)[codes[:, j]]
                all_m, all_a = np.nonzero(near <= bound)
                for at in range(0, len(all_m), pair_block // 8 + 1):
                    m, a = mine[all_m[at:at + pair_block // 8 + 1]], at_q[all_a[at:at + pair_block // 8 + 1]]
                    exact = np.einsum("ij,ij->i", qs[a], xs[m]) >= cosine
                    a, m = a[exact], m[exact]
                    other = qk[a] != mk[m]
                    a, m = a[other], m[other]
                    np.add.at(out, a, mw[m])
                    # Vectors of one group meet in both roles, those of two groups only here.
                    once = visitor[a]
                    np.add.at(back, m[once], qw[a[once]])
                    u, v = star_edges(qk[a], mk[m])
                    us.append(u)
                    vs.append(v)
        u, v = star_edges(np.concatenate(us), np.concatenate(vs)) if us else (qk[:0], qk[:0])
        return pd.concat([pd.DataFrame({"key": qk[out > 0], "n": out[out > 0], "root": None}),
                          pd.DataFrame({"key": mk[back > 0], "n": back[back > 0], "root": None}),
                          pd.DataFrame({"key": u, "n": None, "root": v})], ignore_index=True)
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    cosine: float = 0.9, slack: float | None = None, subspaces: int = 8, codes: int = 256,
                    lists: int | None = None, max_lists: int = 4096, fit_rows: int = 16_384,
                    cell_rows: int = 4096, pair_block: int = 1_000_000, seed: int = 42) -> DataFrame:
    """Rows (id, n_links, component_id), one per input row.

    ``n_links`` counts the other rows linked directly (cosine >= ``cosine``),
    ``component_id`` is the smallest non-null id reachable over links, the own
    id included.  Equal vectors are one class: they are compared once and
    counted with their number.  Vectors that are null, empty, zero, hold a null
    or non-finite component, or differ in length from the others they meet link
    with nothing; their component is their own id.  Rows with a null id take
    part; the component of a group without ids is null.  An empty table gives
    no rows.  Columns other than the two named are ignored.

    ``fit_rows`` bounds the training sample, ``max_lists`` the centroids that
    go to every task (4096 x d floats).  A group of lists is dealt out over cells
    of about ``cell_rows`` members and ``cell_rows`` queries.

    No link is lost unless ``slack`` is given: it narrows both bounds to so many
    standard deviations of a random direction's share in one axis, which loses
    links that lean further.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
               .withColumn("vec", F.when(usable(F.col("vec")), F.col("vec"))))
    good = rows.where("vec is not null")
    classes = cut(good.groupBy("vec").agg(F.count("*").alias("weight"), F.min("id").alias("rep"))
                  .withColumn("dim", F.size("vec"))
                  .withColumn("key", F.xxhash64("vec")))
    own = good.withColumn("key", F.xxhash64("vec")).select("id", "key")
    found = None
    for dim in sorted(r[0] for r in classes.select("dim").distinct().collect()):
        part = _links(classes.where(F.col("dim") == dim), cosine, slack, subspaces, codes, lists,
                      max_lists, fit_rows, cell_rows, pair_block, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = cut(found)
    counts = found.where("n is not null").groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.where("root is not null").select(F.col("key").alias("u"), F.col("root").alias("v")))
    named = (classes.select("key", "weight", "rep").join(counts, "key", "left")
             .join(roots.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("root", F.coalesce("root", "key")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    told = named.join(least, "root").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = rows.where("vec is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.join(told, "key").select("id", "n_links", "component_id").unionByName(alone)


def _links(classes: DataFrame, cosine, slack, subspaces, codes, lists, max_lists, fit_rows,
           cell_rows, pair_block, seed) -> DataFrame:
    """Rows (key, n, null): links of a class found in one cell; (key, null, root): spanning edges."""
    n = classes.count()
    share = min(1.0, fit_rows / n)
    bound = int(share * 2 ** 62)
    sample = classes.where(F.shiftright(F.xxhash64("key", F.lit(seed)), 1).bitwiseAND(2 ** 62 - 1) <= bound) \
        .select("key", "vec").limit(2 * fit_rows).toPandas().sort_values("key")
    if sample.empty:
        sample = classes.select("key", "vec").limit(1).toPandas()
    k = lists or max(1, min(max_lists, round(np.sqrt(n) / 2)))
    x = _unit(sample["vec"])[0]
    model = fit(x, min(k, len(x)), min(subspaces, x.shape[1]), min(codes, len(x)), seed)
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    reach = r if slack is None else min(r, slack * r / np.sqrt(x.shape[1]))
    sizes = np.bincount(model.coarse_distances(x.astype(np.float32)).argmin(1), minlength=len(model.coarse))
    group = _groups(model, sizes * (n / len(x)), cell_rows)
    homes = cut(classes.select("key", "vec", "weight").mapInPandas(
        _assign(model, reach, group), f"key long, vec {dict(classes.dtypes)['vec']}, weight long, home int, "
                                      "part int, visits array<int>"))
    # Members and queries are counted apart, so that both sides of a cell are bounded.
    cells = lambda c: F.ceil(F.sum(c) / cell_rows).cast("int")
    held = homes.select(F.col("part").alias("at"), F.lit(1).alias("m"), F.lit(0).alias("a"))
    asked = homes.select(F.explode("visits").alias("at"), F.lit(0).alias("m"), F.lit(1).alias("a"))
    side = held.unionByName(asked).groupBy("at").agg(
        F.greatest(cells("m"), F.lit(1)).alias("rows"), F.greatest(cells("a"), F.lit(1)).alias("cols"))
    # One row a group, at most max_lists rows: small enough for every task.
    side = F.broadcast(cut(side))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("long")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = homes.withColumn("at", F.col("part")).join(side, "at").select(
        "at", F.explode(F.transform(all_of("cols"), lambda c: place("rows") * F.col("cols") + c)).alias("cell"),
        "key", "vec", "weight", "home")
    asks = homes.select(F.explode("visits").alias("at"), "key", "vec", "weight", "home", "part").join(side, "at").select(
        "at", F.explode(F.transform(all_of("rows"), lambda c: c * F.col("cols") + place("cols"))).alias("cell"),
        "key", "vec", "weight", "home", "part")
    # Fresh column identities: both sides stem from one checkpointed table.
    asks = asks.toDF(*[f"ask_{c}" for c in asks.columns])
    return members.groupBy("at", "cell").cogroup(asks.groupBy("ask_at", "ask_cell")).applyInPandas(
        _match(model, cosine, reach, slack, pair_block), "key long, n long, root long")
