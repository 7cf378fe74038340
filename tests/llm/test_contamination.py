"""Decontamination against brute force, its SQL, and the edge cases of the docstring."""

import hashlib
import random
import re

import duckdb
import pytest

from logweave.llm import contamination
from logweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, wid string, words string, key long, item string"
ITEMS = "item_id long, text string, span string, n int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, width):
    windows = {}
    for i in items:
        w = words(i.text)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add("" if i.item_id is None else str(i.item_id))
    out = []
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        out.append((d.doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def run(docs, items, **kw):
    out = contamination.decontaminate(docs, items, **kw)
    return sorted(((r.id, r.n_words, r.n_hit, r.items, r.contaminated) for r in out.collect()), key=repr)


@pytest.mark.parametrize("width,shingle", [(4, 3), (3, 3), (5, 2), (2, 4), (4, 1)])
def test_equals_brute_force(spark, width, shingle):
    rng = random.Random(width * 10 + shingle)
    text = lambda n: rng.choice(["", ". ", "-"]).join([""] * 2) + rng.choice([" ", ", ", "\n"]).join(
        rng.choice(["a", "B", "c", "dé", "É", "5"]) for _ in range(n))
    items = spark.createDataFrame([(rng.randrange(12), text(rng.randrange(0, 9)), "x", 1) for _ in range(14)], ITEMS)
    docs = spark.createDataFrame([(rng.randrange(60), text(rng.randrange(0, 60)), "w", "x", 1, "i") for _ in range(60)], DOCS)
    assert run(docs, items, width=width, shingle=shingle) == plain(docs.collect(), items.collect(), width)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(1, passage, "s", 0), (1, passage, "s", 0), (2, passage + " more", "s", 0), (3, "Two words", "s", 0),
                                   (4, None, "s", 0), (5, " ... ", "s", 0), (None, "lonely", "s", 0)], ITEMS)
    docs = [(1, None, "w", "x", 1, "i"), (2, "", "w", "x", 1, "i"), (3, "!!", "w", "x", 1, "i"), (None, passage, "w", "x", 1, "i"),
            (None, passage, "w", "x", 1, "i"), (4, f"X {passage.upper()}! tail", "w", "x", 1, "i"),
            (5, "TWO, words; two words lonely", "w", "x", 1, "i"), (6, " ".join(passage.split()[:9]), "w", "x", 1, "i"),
            (7, "filler " * 60_000 + passage + " filler" * 60_000, "w", "x", 1, "i"), (2 ** 63 - 1, "twowords", "w", "x", 1, "i"),
            *[(100 + i, f"common start {passage}", "w", "x", 1, "i") for i in range(300)]]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    got = run(df, items)
    assert got == plain(df.collect(), items.collect(), 10)
    by_id = {r[0]: r for r in got}
    assert by_id[4][2] == 14 and by_id[4][3] == ["1", "2"] and by_id[6][2] == 0 and by_id[5][3] == ["", "3"]
    assert by_id[7][2] == 14 and by_id[2 ** 63 - 1][4] is False


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "w", "x", 1, "i")], DOCS), spark.createDataFrame([(1, "a", "s", 0)], ITEMS)
    assert run(docs, items.limit(0)) == [(1, 2, 0, [], False)]
    assert run(docs.limit(0), items) == [] and run(docs.limit(0), items.limit(0)) == []


def test_windows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 300)
    items = spark.createDataFrame([(i, f"alpha beta gamma{i % 5} delta eps{i}", "s", 0) for i in range(20)], ITEMS)
    docs = spark.createDataFrame([(i, f"so alpha beta gamma{i % 5} delta eps{i} end", "w", "x", 1, "i") for i in range(40)], DOCS)
    assert run(docs, items, width=4) == plain(docs.collect(), items.collect(), 4)


def test_no_python_in_the_plan(spark):
    docs, items = spark.createDataFrame([(1, "a b", "w", "x", 1, "i")], DOCS), spark.createDataFrame([(1, "a", "s", 0)], ITEMS)
    plan = contamination.decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_registered_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cols = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    con.execute("CREATE VIEW o AS " + contamination.oracle())
    got = sorted(map(tuple, QUERIES["op11_decontamination"](spark, SF).select(*cols.split(", ")).collect()))
    assert got == sorted(con.execute(f"SELECT {cols} FROM o").fetchall())
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = [(d, n, k, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, k, i, c in plain(docs, items, 10)]
    assert got == sorted(want) and any(r[5] for r in got) and not all(r[5] for r in got)
