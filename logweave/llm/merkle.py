"""Merkle manifest of a dataset, with proofs by checkpoint and recompute.

Every row is a leaf; the leaves of a group (a source) form a tree of ``fan``
children a node, and the group roots form the tree above them.  Only every
``every``-th level is stored.  A stored node covers an aligned subtree of
``fan ** every`` stored descendants, so both building and proving work subtree
by subtree: a task reads one subtree's stored nodes, makes the interior nodes
between, uses them (for the node above, or as siblings of the descendants), and
forgets them.  Proofs run downwards: a stored node's siblings up to the root
travel once to its subtree, not once to each leaf.

Places in a tree come from a range-partitioned sort and the row counts of its
partitions, so a source that holds a third of all rows spreads over as many
tasks as its size asks for; no task reads more than a subtree at a time.

Defined results: a null field is written ``-``; null sources are one group, the
first; in a group null ids come first, then ids ascend, rows of one id by their
leaf (equal rows have equal leaves, each its own place).  An empty table has no
rows and an empty root.  Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import LOWER, UPPER, cut, cut_small
from logweave.llm.stream import batches_of, runs_of

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Digest of a row: of each field ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    def written(c: Column) -> Column:
        v = c.cast("string")
        return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*[written(c) for c in fields]), 256)


def height(size: int, fan: int) -> int:
    """Levels between ``size`` nodes and their root."""
    levels = 0
    while size > 1:
        size, levels = -(-size // fan), levels + 1
    return levels


def interior(nodes: list[str], fan: int, levels: int) -> list[list[str]]:
    """The nodes of one subtree, level by level from the given ones to ``levels`` above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([sha(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(levels: list[list[str]], place: int, fan: int) -> list[str]:
    """What stands left and right of a node and of its ancestors in their runs:
    two texts (concatenated digests) a level, without the topmost of ``levels``."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % fan
        out += ["".join(nodes[first:place]), "".join(nodes[place + 1:first + fan])]
        place //= fan
    return out


def fold(digest: str, path: list[str]) -> str:
    """The root that a node's digest and its siblings give."""
    for left, right in zip(path[::2], path[1::2]):
        digest = sha(left, digest, right)
    return digest


def _placed(nodes: DataFrame, order: list[str], count: int) -> tuple[DataFrame, int]:
    """``nodes`` (tree, ...; about ``count`` rows) with ``idx``, the place in the tree
    by ``order`` (nulls first), and ``size``, the nodes of the tree; and the largest size."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    sorted_rows = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys) \
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    # Rows of a sorted partition carry its number, so several partitions may share a file.
    rows = cut(sorted_rows.coalesce(count // 50_000 + 1))
    # One row for each tree a partition holds; a tree's rows here are the partitions it spans.
    part = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    part = part.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"),
                       F.sum("n").over(tree).alias("size"))
    out = rows.join(part, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first")) \
        .drop("part", "at", "first", "before")
    return out, rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


NODE = T.StructType().add("tree", "string").add("idx", "long").add("size", "long").add("digest", "string")
PATHS = T.StructType().add("tree", "string").add("idx", "long").add("path", T.ArrayType(T.StringType()))


def _grown(nodes: DataFrame, largest: int, count: int, fan: int, every: int) -> list[DataFrame]:
    """The stored levels over ``nodes`` (``count`` rows, at most ``largest`` a tree),
    lowest first; each tree ends at the level where its size is 1."""
    span = fan ** every

    def fold_subtrees(batches):
        def tops():
            for (tree, sub, size), rows in runs_of(batches, 3):
                levels = min(every, height(size, fan))
                yield tree, sub, -(-size // span), interior([r[4] for r in rows], fan, levels)[-1][0]
        yield from batches_of(tops(), NODE)

    levels = [nodes]
    while largest > 1:
        rows = levels[-1].where("size > 1").select(
            "tree", F.expr(f"idx div {span}").alias("sub"), "size", "idx", "digest")
        dealt = rows.repartition("tree", "sub").sortWithinPartitions("tree", "sub", "idx")
        levels.append(cut_small(dealt.mapInArrow(fold_subtrees, NODE), count // span ** len(levels)))
        largest = -(-largest // span)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The root of each tree: its node at the level where it is alone."""
    alone = [x.where("size = 1").select("tree", "digest") for x in levels]
    out = alone[0]
    for x in alone[1:]:
        out = out.unionAll(x)
    return out


def _subtrees(level: DataFrame, above: DataFrame, span: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of ``level`` subtree by subtree, each after a row that brings the
    siblings of the node above: (tree, sub, size, idx, digest, path, *extra).
    A tree that is a single node stands under itself."""
    nodes = level.select("tree", F.expr(f"idx div {span}").alias("sub"), "size", "idx", "digest",
                         F.lit(None).cast("array<string>").alias("path"), *extra)
    kinds = dict(level.select(*extra).dtypes) if extra else {}
    heads = above.select("tree", F.col("idx").alias("sub"), F.lit(None).cast("long").alias("size"),
                         F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("string").alias("digest"), "path",
                         *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    return nodes.unionByName(heads).repartition("tree", "sub").sortWithinPartitions("tree", "sub", "idx")


def _paths_in_subtrees(batches, fan: int, every: int):
    """(row, siblings up to the root) of every node of the subtrees in ``batches``."""
    for _, rows in runs_of(batches, 2):
        head = next(rows)
        nodes = list(rows)
        if not nodes:
            continue
        levels = interior([r[4] for r in nodes], fan, min(every, height(nodes[0][2], fan)))
        for place, row in enumerate(nodes):
            yield row, siblings(levels, place, fan) + head[5]


def _descend(levels: list[DataFrame], count: int, tops: DataFrame, fan: int, every: int, lowest: bool) -> DataFrame:
    """Siblings up to the root of the stored nodes, from the trees' roots (``tops``:
    tree, path) down to the leaves, or to the level above them unless ``lowest``."""
    def down(batches):
        yield from batches_of(((r[0], r[3], path) for r, path in _paths_in_subtrees(batches, fan, every)), PATHS)

    span = fan ** every
    known, above = tops.select("tree", F.lit(0).cast("long").alias("idx"), "path"), None
    for k in range(len(levels) - 1, -1 if lowest else 0, -1):
        # Trees whose root is this level's node start here; the others go on from above.
        ends = levels[k].where("size = 1").select("tree").join(known, "tree")
        if above is None:
            above = ends
        else:
            inner = _subtrees(levels[k].where("size > 1"), above, span).mapInArrow(down, PATHS)
            above = cut_small(inner.unionByName(ends), count // span ** k, 5_000)
    return above


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the groups' trees and of the tree above them, and the root digest."""
    levels: list[DataFrame]
    top_levels: list[DataFrame]
    root: str
    fan: int
    every: int
    count: int
    groups: int

    def subroots(self) -> DataFrame:
        """(tree, digest) of each group."""
        return _tops(self.levels)

    def proofs(self, with_siblings: bool = False) -> DataFrame:
        """Per leaf: ``id, tree, leaf, subroot, root, proof_sha256`` (digest of its
        siblings, from the leaf's run to the root's, left to right),
        ``folded_root`` (what the claimed leaf and the siblings give) and
        ``verified``; the siblings themselves if asked for, two texts a level."""
        fan, every, root = self.fan, self.every, self.root
        tops = _descend(self.top_levels, self.groups, self.top_levels[-1].where("size = 1").select(
            "tree", F.array().cast("array<string>").alias("path")), fan, every, lowest=True)
        groups = self.top_levels[0].select(F.col("idx"), F.col("name")).join(tops.select("idx", "path"), "idx") \
            .select(F.col("name").alias("tree"), "path")
        above = _descend(self.levels, self.count, groups, fan, every, lowest=False) if len(self.levels) > 1 else None
        leaves = self.levels[0]
        alone = leaves.where("size = 1").select("tree").join(groups, "tree").select(
            "tree", F.lit(0).cast("long").alias("idx"), "path")
        above = alone if above is None else above.unionByName(alone)
        id_type = leaves.schema["id"].dataType
        schema = T.StructType().add("id", id_type).add("tree", "string").add("leaf", "string") \
            .add("proof_sha256", "string").add("folded_root", "string").add("siblings", T.ArrayType(T.StringType()))

        def prove(batches):
            proved = ((row[6], row[0], row[4], sha(*path), fold(row[7], path), path if with_siblings else None)
                      for row, path in _paths_in_subtrees(batches, fan, every))
            yield from batches_of(proved, schema)

        out = _subtrees(leaves, above, fan ** every, ("id", "claim")).mapInArrow(prove, schema)
        out = out.join(self.subroots().withColumnRenamed("digest", "subroot"), "tree")
        return out.select("id", "tree", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                          (F.col("folded_root") == root).alias("verified"), *(["siblings"] if with_siblings else []))


def build(docs: DataFrame, id_col: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
          claim: Column | None = None, fan: int = 16, every: int = 2) -> Manifest:
    """The manifest of ``docs``: leaves are digests of ``fields``, a tree for each
    value of ``group``.  ``claim`` is the leaf that a holder of the row presents
    when it is proved (by default the leaf itself)."""
    leaf = leaf_digest(F.col(c) for c in fields)
    # Null groups first, then bytewise: one text key that sorts like that.
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"),
                       (leaf if claim is None else claim).alias("claim"))
    count = docs.count()
    levels = _grown(*_placed(rows, ["id", "digest"], count), count, fan, every)
    groups = _tops(levels).select(F.lit("root").alias("tree"), F.col("tree").alias("name"), "digest")
    n_groups = groups.count()
    top_levels = _grown(*_placed(groups, ["name"], n_groups), n_groups, fan, every)
    root = _tops(top_levels).first()
    return Manifest(levels, top_levels, root["digest"] if root else "", fan, every, count, n_groups)


def tampered_leaf(one_in: int = 5, id_col: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose text, where ``one_in`` divides the CRC-32 of the
    written id, has its A-Z lowered; rows without an id are not touched."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % one_in == 0, F.lit(False))
    low = F.translate(F.col(text), UPPER, LOWER)
    return F.when(hit, leaf_digest(low if c == text else F.col(c) for c in fields)) \
        .otherwise(leaf_digest(F.col(c) for c in fields))


def oracle(levels: int = 4, top_levels: int = 3) -> str:
    """DuckDB SQL of the registered query: every level spelled out (16 ** levels leaves a source)."""
    written = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    low = written.replace("text::VARCHAR", f"translate(text, '{UPPER}', '{LOWER}')")
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)")

    def grow(name: str, n: int) -> str:
        out = []
        for k in range(n):
            run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}{k}s AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n,
  CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {name}{k} GROUP BY tree, i // 16, n)""")
        return ",\n".join(out)

    def climb(name: str, n: int, tree: str, place: str, digest: str, proof: str, frm: str, made: str) -> str:
        out, now = [], frm
        for k in range(n):
            out.append(f"""{made}{k} AS (SELECT x.* EXCLUDE ({digest}, {proof}),
  CASE WHEN s.n = 1 THEN {digest} ELSE sha256(s.l || {digest} || s.r) END AS {digest},
  CASE WHEN s.n = 1 THEN {proof} ELSE {proof} || s.l || s.r END AS {proof}
  FROM {now} x JOIN {name}{k}s s ON s.tree = {tree} AND s.i = x.{place} // {16 ** k})""")
            now = f"{made}{k}"
        return ",\n".join(out)

    return f"""WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256({written}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({low}) ELSE sha256({written}) END AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY tree) AS n FROM d),
a0 AS (SELECT tree, i, n, leaf AS h FROM p),
{grow("a", levels)},
b0 AS (SELECT 'root' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM a{levels}),
{grow("b", top_levels)},
x AS (SELECT p.*, p.claim AS folded_root, '' AS proof, b0.i AS place, b0.h AS subroot FROM p JOIN b0 ON b0.name = p.tree),
{climb("a", levels, "x.tree", "i", "folded_root", "proof", "x", "y")},
{climb("b", top_levels, "'root'", "place", "folded_root", "proof", f"y{levels - 1}", "z")}
SELECT doc_id, leaf, subroot, (SELECT h FROM b{top_levels}) AS root, sha256(proof) AS proof_sha256, folded_root,
  folded_root = (SELECT h FROM b{top_levels}) AS verified FROM z{top_levels - 1}"""
