"""SentencePiece: equal to the public library without dropout, lossless with it."""

import pickle

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import spm
from logweave.llm.queries import PIECES

TEXTS = ["Hello  world\n x é  ", "   three spaces", "a\n\nb\tc", "日本語 text 🙂 é", "x" * 5000, " ", "\n", "naïve café",
         "the of and " * 300, "%%% ### a.b.c"]


@pytest.fixture(scope="module")
def plain():
    return spm.Tokenizer.load(PIECES, alpha=0)


@pytest.fixture(scope="module")
def dropped():
    return spm.Tokenizer.load(PIECES, alpha=0.3, seed=7)


def test_without_dropout_equals_the_library(plain, spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = TEXTS + [r.text for r in rows]
    for t, got in zip(texts, plain.encode_all(texts, [0] * len(texts))):
        assert got.tolist() == lib.encode(t), t[:60]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab ▁\n\0é🙂the", max_size=80), st.integers(-2**63, 2**63 - 1))
def test_round_trip(dropped, text, key):
    assert dropped.decode(dropped.encode(text, key).tolist()) == text


def test_batched_agenda_equals_the_single_one(dropped, spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    by_length = {}
    for s in {s for r in rows for s in spm._SEGMENT.findall(" " + r.text)}:
        by_length.setdefault(len(s), []).append(s)
    for group in by_length.values():
        for s, got in zip(group, dropped.many_ids(group, 1)):
            if not dropped.tied.search(s):
                assert np.frombuffer(got, np.int32).tolist() == dropped.segment_ids(s, 1), s


def test_dropout_is_keyed_and_varies(dropped):
    text = "international transportation of extraordinary considerations " * 5
    one = dropped.encode(text, 1).tolist()
    assert one == spm.Tokenizer.load(PIECES, alpha=0.3, seed=7).encode(text, 1).tolist()
    assert len({tuple(dropped.encode(text, k).tolist()) for k in range(6)}) > 1
    assert one != spm.Tokenizer.load(PIECES, alpha=0.3, seed=8).encode(text, 1).tolist()
    full = spm.Tokenizer.load(PIECES, alpha=1.0).encode("transportation", 0)
    assert len(full) == len("transportation") + 1


def test_small_cache_changes_nothing(dropped):
    small = spm.Tokenizer.load(PIECES, alpha=0.3, seed=7, cache_size=8)
    for t in TEXTS:
        assert small.encode(t, 5).tolist() == dropped.encode(t, 5).tolist()


def test_frames(spark, dropped):
    copy = pickle.loads(pickle.dumps(dropped))
    rows = [(1, None, "a"), (2, "", "b"), (None, "x ▁ y", "c"), (4, "long " * 60_000, "d"), (5, "re", "e"), (5, "re", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = spm.tokenize(df.withColumnRenamed("tokens", "tag"), copy, keep=("tag",)).collect()
    assert sorted(r.tag for r in got) == ["a", "b", "c", "d", "e", "e"] and all(r.lossless for r in got)
    by = {r.tag: r for r in got}
    assert by["a"].tokens is None and by["b"].tokens == [] and by["a"].n_tokens == 0
    assert by["d"].n_tokens == len(by["d"].tokens) >= 60_000
    assert spm.tokenize(df.limit(0), copy).count() == 0
    assert spm.tokenize(df, copy).columns == ["id", "tokens", "n_tokens", "lossless"]


def test_each_place_draws_its_own_dropout(plain):
    """A frequent word has as many segmentations as independent skips give it, also next to itself."""
    tok = spm.Tokenizer.load(PIECES, alpha=0.1, seed=3)
    n = 4000
    pieces = tok.encode(" ".join(["transportation"] * n), 1).tolist()
    text = [tok.text[i].decode() for i in pieces]
    words = "".join(("|" if t.startswith(" ") else "") + "/" + t for t in text).split("|")[1:]
    assert len(words) == n and len(set(words)) > 50
    whole = plain.encode("transportation", 0).tolist()
    steps = plain._merge(" transportation", (), None)[1]
    same = sum(w.count("/") == len(whole) for w in words) / n
    assert same >= 0.9 ** steps - 0.03
    # The same shares as the plain agenda with a key for each place.
    slow = ["".join("/" + tok.text[i].decode() for i in tok.segment_ids(" transportation", k)) for k in range(n)]
    for w in set(slow) | set(words):
        a, b = words.count(w), slow.count(w)
        assert abs(a - b) <= 6 * (a + b) ** 0.5 + 1, (w, a, b)


def test_cached_skips_equal_the_single_agenda(dropped, spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(30).collect()
    tok = pickle.loads(pickle.dumps(dropped))
    tok.encode_all([r.text for r in rows], list(range(len(rows))))
    assert len(tok.after) > 100
    for node in [*tok.roots.values(), *tok.after.values()]:
        ids, steps = tok._merge(*tok.of[node], None)
        assert np.frombuffer(tok.found[node], np.int32).tolist() == ids and tok.steps[node] == steps
