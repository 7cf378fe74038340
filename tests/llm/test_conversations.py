"""Conversation repair against an exhaustive search, a plain dynamic program, its SQL, and edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from logweave.llm import conversations as C
from logweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies long, after string"
SHAPE = re.compile(r"(s?(ua)+)?")
WS = " \t\n\x0b\x0c\r"


def faults(rows):
    """Per row: blank, duplicate, truncated or None; each row's first fault."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(WS)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit, shortest cost first; small conversations only."""
    kinds, best = faults(rows), None

    def go(i, inserted, cost, audit, made):
        nonlocal best
        if best and (cost, audit) > best[:2] and cost > best[0]:
            return
        if i == len(rows):
            if SHAPE.fullmatch("".join(r[:1] or "-" for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, list(made))
        else:
            role, text = rows[i]
            go(i + 1, 0, cost + 4, audit + "D", made)
            if kinds[i] not in ("blank", "duplicate"):
                extra = 3 * (kinds[i] == "truncated")
                go(i + 1, 0, cost + extra, audit + "K", made + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, 0, cost + 3 + extra, audit + "R", made + [(new, text)])
        if inserted < 2 and (best is None or cost + 3 <= best[0]):
            for new in ("user", "assistant"):
                go(i, inserted + 1, cost + 3, audit + "I", made + [(new, "")])

    go(0, 0, 0, "", [])
    return best


def ordered(rows):
    """Roles and texts in the operator's order, nulls written as one space."""
    rows = [(r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text) for r in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return [(a, b) for _, a, b in rows]


def plain(rows, search=cheapest):
    turns = {r.turn for r in rows if r.turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seq = ordered(rows)
    kinds = faults(seq)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(seq, seq[1:])]
    cost, audit, made = search(seq)
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def audits(df, ids=None):
    cols = (*C.COUNTS, "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in cols) for r in C.audit_conversations(df, ids).collect()}


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.conv_id, []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_an_exhaustive_search(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        for _ in range(rng.randrange(1, 6)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 5]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                         rng.choice(["Hi.", "Hi", "Why?", " \n", "", None, "Go!\n", "a. b"]), "x", 1, "y"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert audits(df) == {c: plain(r) for c, r in grouped(df).items()}


def program(seq):
    """Cost, audit and rows by the whole cost table."""
    kinds, inf = faults(seq), float("inf")
    nxt, name = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(b):
        for _ in range(3):
            b = [min(b[q], 3 + b[nxt[q]]) for q in range(4)]
        return b
    table = [closed([0, inf, inf, 0])]
    for (role, _), kind in zip(reversed(seq), reversed(kinds)):
        after, extra = table[-1], 3 * (kind == "truncated")
        row = [4 + x for x in after]
        if kind not in ("blank", "duplicate"):
            row = [min(row[q], 3 + extra + after[nxt[q]], extra + after[keep[q, role[:1]]] if (q, role[:1]) in keep else inf) for q in range(4)]
        table.append(closed(row))
    table.reverse()
    q, i, audit, made = 0, 0, "", []
    while i < len(seq) or q in (1, 2):
        cost = table[i][q]
        if i < len(seq) and cost == 4 + table[i + 1][q]:
            audit, i = audit + "D", i + 1
        elif cost == 3 + table[i][nxt[q]]:
            audit, q = audit + "I", nxt[q]
            made.append((("user", "user", "assistant", "user")[(2, 3).index(q) + 1 if q == 3 else 0], ""))
        else:
            (role, text), extra = seq[i], 3 * (kinds[i] == "truncated")
            to = keep.get((q, role[:1]))
            if to is not None and cost == extra + table[i + 1][to]:
                audit, q = audit + "K", to
                made.append((role, text))
            else:
                audit += "R"
                made.append((name[q], text))
                q = nxt[q]
            i += 1
    return table[0][0], audit, made


def test_long_conversations_cross_their_checkpoints(spark):
    """Thousands of entries (dozens of blocks), copies of rows by the hundred, many batches."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system", "bot"]), f"{rng.randrange(2500)}{rng.choice('.!?ab')}", "x", 1, "y")
            for i in range(4000)]
    rows += [(1, 77, "user", "again.", "x", 1, "y")] * 500 + [(2, None, "user", "", "x", 1, "y")] * 700
    rows += [(3, 0, "user", "word " * 100_000, "x", 1, "y"), (3, 1, "assistant", "x" * 400_000 + ".", "x", 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert audits(df) == {c: plain(r, program) for c, r in grouped(df).items()}


def test_blocks_grow_like_the_square_root():
    import pyarrow as pa
    from logweave.llm.stream import batches_of
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(n, t) for n, t in zip(C.ENTRY, (
        T.StringType(), T.LongType(), T.StringType(), T.BinaryType(), T.StringType(), T.LongType(), T.BooleanType(),
        T.BooleanType(), T.BooleanType()))])
    rows = [("c", 10_000 - i, "user", bytes([i % 256]), "u", 1, False, False, True) for i in range(10_000)]
    blocks = list(C._blocks_backward(batches_of(rows, schema)))
    sizes = [len(b[6]) for b in blocks]
    assert sum(sizes) == 10_000 and max(sizes) <= 142 and len(blocks) <= 142 and isinstance(pa.array([1]), pa.Array)


def test_defined_results(spark):
    df = spark.createDataFrame([(None, None, None, None, "x", 1, "y"), (2 ** 63 - 1, -5, "user", "Hi.", "x", 1, "y"),
                                (2 ** 63 - 1, 5, "assistant", "Yo.", "x", 1, "y")], SCHEMA)
    got = audits(df)
    assert got[None] == (0, 1, 0, 0, 0, 4, "D", hashlib.sha256().hexdigest())
    assert got[2 ** 63 - 1][:7] == (9, 0, 0, 0, 0, 0, "KK")
    assert audits(df.limit(0)) == {} and C.repair_conversations(df.limit(0)).count() == 0
    assert audits(df.where("turn = 5"), df)[None] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    back = [(r.conv_id, r.place, r.edit, r.role, r.text) for r in C.repair_conversations(df).orderBy("place").collect()]
    assert back == [(2 ** 63 - 1, 0, "K", "user", "Hi."), (2 ** 63 - 1, 1, "K", "assistant", "Yo.")]


def test_repaired_rows_give_the_digest(spark):
    rows = C.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    made = {}
    for r in sorted(C.repair_conversations(rows).collect(), key=lambda r: r.place):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, r in audits(rows).items():
        assert r[-1] == hashlib.sha256("\n".join(made.get(c, [])).encode()).hexdigest()
        assert r[-2].count("K") + r[-2].count("R") + r[-2].count("I") == len(made.get(c, []))


def test_damage(spark):
    df = spark.createDataFrame([(c, t, "assistant", "A. b!", "x", 1, "y") for c in range(12) for t in range(12)] +
                               [(None, None, None, None, "x", 1, "y")], SCHEMA)
    got = {}
    for r in C.damage(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    plain_rows = {0: [], 1: [("assistant", "")], 2: [("assistant", "A b")], 3: [("assistant", "A. b!")] * 2, 4: [("user", "A. b!")]}
    for c in range(12):
        for t in range(12):
            k = zlib.crc32(f"{c}:{t}".encode()) % 20
            assert got.get((c, t), []) == plain_rows.get(k, [("assistant", "A. b!")])
    k = zlib.crc32(b" : ") % 20
    assert got.get((None, None), []) == {0: [], 1: [(" ", "")], 3: [(" ", " ")] * 2, 4: [("user", " ")]}.get(k, [(" ", " ")])


def test_registered_query_equals_sql_and_program(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    con.execute("CREATE VIEW o AS " + C.oracle())
    cols = ("conv_id", *C.COUNTS, "cost", "audit", "repaired_sha256")
    got = QUERIES["op12_conversation_repair"](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM o").fetchall())
    rows = grouped(C.damage(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert {r[0]: tuple(r)[1:] for r in got if r[0] in rows} == {c: plain(r, program) for c, r in rows.items()}
