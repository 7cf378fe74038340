"""The manifest against a plain recursive one, its SQL, and the edge cases of the docstring."""

import hashlib
import zlib

import duckdb
import pytest

from logweave.llm import merkle
from logweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, tree string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    out = ""
    for v in (row.doc_id, row.source, row.lang, row.n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(leaves, fan):
    """Root, and per leaf its siblings as (left, right) texts."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, p in enumerate(at):
            first = p - p % fan
            paths[k].append(("".join(nodes[first:p]), "".join(nodes[p + 1:first + fan])))
            at[k] = p // fan
        nodes = [h(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def plain(rows, fan=16, one_in=5):
    groups = {}
    for r in rows:
        groups.setdefault((r.source is not None, (r.source or "").encode()), []).append((r, leaf_of(r, r.text)))
    order, roots = sorted(groups), {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        roots[g] = tree([d for _, d in groups[g]], fan)
    root, top = tree([roots[g][0] for g in order], fan)
    out = []
    for g, above in zip(order, top):
        for (r, leaf), path in zip(groups[g], roots[g][1]):
            low = None if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % one_in == 0
            folded = leaf_of(r, low if hit else r.text)
            for left, right in path + above:
                folded = h(left, folded, right)
            out.append((r.doc_id, leaf, roots[g][0], root, h(*[x for p in path + above for x in p]), folded, folded == root))
    return sorted(out, key=repr)


def proved(df, **kw):
    m = merkle.build(df, claim=merkle.tampered_leaf(), **kw)
    return sorted((tuple(r) for r in m.proofs().drop("tree").collect()), key=repr)


def docs(spark, sizes):
    rows = [(i * 7 % 1000 + 1000 * k, f"Text {i} É", "en", s, i, 1, "x", "y")
            for k, (s, n) in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_equals_the_plain_tree(spark, every):
    df = docs(spark, [("a", 1), ("b", 2), ("c", 4), ("d", 5), ("e", 17), ("f", 90), ("é", 3)])
    assert proved(df, fan=4, every=every) == plain(df.collect(), fan=4)


def test_a_hot_group_and_defaults(spark):
    df = docs(spark, [("hot", 600), ("b", 16), ("c", 257)])
    assert proved(df) == plain(df.collect())


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None, 0, "t", "d"), (None, "A", "en", None, 1, 0, "t", "d"), (5, None, "en", "s", 0, 0, "t", "d"),
            (10, "", None, "s", 0, 0, "t", "d"), (10, "", None, "s", 0, 0, "t", "d"), (10, "Z", None, "s", 0, 0, "t", "d"),
            (2 ** 63 - 1, "X" * 300_000, "de", "s", 3, 0, "t", "d"), (2 ** 53 + 1, "ÀB", "de", "", 3, 0, "t", "d"), (-4, "n", "", "s-", 1, 0, "t", "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert proved(df, fan=2) == plain(df.collect(), fan=2)
    assert proved(df) == plain(df.collect())


def test_empty_and_single(spark):
    df = docs(spark, [("a", 1)])
    (row,) = proved(df)
    assert row[1] == row[2] == row[3] and row[4] == hashlib.sha256().hexdigest()
    assert proved(df.limit(0)) == [] and merkle.build(df.limit(0)).root == ""


def test_siblings_lead_to_the_root(spark):
    m = merkle.build(docs(spark, [("a", 40), ("b", 3)]), fan=3)
    for r in m.proofs(with_siblings=True).collect():
        assert r.verified and merkle.fold(r.leaf, r.siblings) == m.root
        assert h(*r.siblings) == r.proof_sha256


def test_registered_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    con.execute("CREATE VIEW o AS " + merkle.oracle())
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    got = QUERIES["op13_merkle_manifest"](spark, SF).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {cols} FROM o").fetchall())
    assert sorted(map(tuple, got), key=repr) == plain(spark.read.parquet(f"{SF}/documents.parquet").collect())
