"""SimHash groups against brute force over all pairs."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from logweave.llm import simhash


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, ids, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            words = r.choice(texts).split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = r.choices(vocab, k=r.randint(1, 300))
        texts.append(" ".join(words))
    return texts


def test_fingerprint_matches_definition():
    for t in [None, "", " \t\n", "One", "a b c", "a b c d", "A b c D e", "é ü ñ x y z \v q"] + corpus(1, 20):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("bits,segments,chain", [(4, None, 2), (4, 8, 3), (3, None, 1), (5, 4, 2), (0, None, 1)])
def test_pairs_within_bound_share_a_key_chain(bits, segments, chain):
    ring = simhash.Ring(bits, segments, chain)
    r = random.Random(bits)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, bits)):
            b ^= 1 << k
        d = np.array([a ^ b], np.uint64)
        assert any(len(ring.fits(d, np.array([s]))) for s in range(ring.m))


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_groups_match_brute_force(spark, bucket_rows, monkeypatch):
    texts = corpus(7, 220) + ["", None, " ", "same same", "same same"]
    ids = list(range(len(texts)))
    ids[5] = None
    ids[6] = ids[7]
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps, ids, 4)
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda c, *a: real(c, *a, bucket_rows=bucket_rows, pair_block=50))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)],
                               "doc_id long, text string, fingerprint string, component_id int").repartition(5)
    got = sorted(map(tuple, simhash.simhash_groups(df).collect()), key=str)
    assert got == sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, want)), key=str)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    # One row of each group: groups by the places of rows, the row by (id, SHA-256 of its text).
    groups = {}
    for k, g in enumerate(slow_components(fps, list(range(len(texts))), 4)):
        groups.setdefault(g, []).append((ids[k] is None, ids[k] or 0,
                                         "" if texts[k] is None else hashlib.sha256(texts[k].encode()).hexdigest(), k))
    first = [min(g)[3] for g in groups.values()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == \
        sorted(((ids[k], texts[k]) for k in first), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(df).count() == 0
    assert simhash.drop_near_copies(df).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Groups without ids, with repeated ids, repeated rows and rows that differ elsewhere."""
    a, b, c = ("one two three four five six seven", "red green blue white black grey pink", "x y z u v w")
    rows = [(None, a, 1), (None, a, 1), (7, a, 5), (9, a, 0), (None, b, 3), (None, b, 2), (None, None, 4), (None, "", 4),
            (2 ** 53 + 1, c, None), (2 ** 53 + 1, c, 8), (7, "quite another text of its own", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int").repartition(4)
    got = sorted(map(tuple, simhash.drop_near_copies(df).collect()), key=str)
    assert got == sorted([(7, a, 5), (None, b, 2), (None, None, 4), (2 ** 53 + 1, c, 8), rows[-1]], key=str)
    assert simhash.drop_near_copies(df.select("text", "doc_id")).columns == ["text", "doc_id"]


def test_many_partitions_change_nothing(spark, monkeypatch):
    """Partitions by the number of rows, beyond the session's."""
    texts = corpus(11, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, simhash.simhash_groups(df).collect()))
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda c, *a: real(c, *a, part_rows=100))
    assert sorted(map(tuple, simhash.simhash_groups(df).collect())) == want
