import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonearm.llm import tokens

ENCODER = tokens.encoder(tokens.DEFAULT_VOCABULARY)


def ids(text):
    flat, offsets = ENCODER.encode([text])
    assert offsets.tolist() == [0, len(flat)]
    return flat.tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_cutting_changes_nothing(text):
    assert ids(text) == ENCODER.whole(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab's tre ll \n\t\r 　  !,.'1é'ж`~«»-", max_size=30))
def test_cutting_changes_nothing_around_spaces_and_apostrophes(text):
    assert ids(text) == ENCODER.whole(text)


def test_long_texts_without_and_with_cuts():
    rng = random.Random(3)
    for text in ("a" * 50_000, " " * 50_000, "\n" * 50_000, "".join(rng.choice("abc .,'\n9é") for _ in range(50_000))):
        assert ids(text) == ENCODER.whole(text)


def test_forced_pairs_occur_in_no_token():
    toks = [b"ab", b"b", b"abc"]
    forced = tokens.forced_pairs(toks)
    assert not forced[ord("a") * 256 + ord("b")] and not forced[ord("b") * 256 + ord("c")] and forced[ord("c") * 256 + ord("a")]
    assert forced.sum() == 65536 - 2


def test_many_texts_keep_their_places():
    texts = ["one two", None, "", " ", "don't", "one two"]
    flat, offsets = ENCODER.encode(texts)
    got = [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [ENCODER.whole(t) if t else [] for t in texts]
    assert ENCODER.encode([])[1].tolist() == [0]


def test_query_shape(spark):
    df = spark.createDataFrame([(1, "hi there", 5), (2, None, 6), (2, "", 7), (None, "x", 8)], "doc_id bigint, text string, ids int")
    out = tokens.token_ids(df, "doc_id", "text")
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((len(r.ids) for r in out.collect())) == [0, 0, 1, 2]
    assert [r.tokens for r in tokens.token_counts(df, ["doc_id"], "text").orderBy("tokens").collect()] == [0, 0, 1, 2]
    assert tokens.token_ids(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("k", [1, 7])
def test_a_full_cache_gives_the_same(monkeypatch, k):
    monkeypatch.setattr(tokens, "CACHE_SIZE", k)
    fresh = tokens.FragmentEncoder()
    flat, _ = fresh.encode(["one two three four five six seven eight nine"])
    assert np.array_equal(flat, ENCODER.encode(["one two three four five six seven eight nine"])[0]) and len(fresh.known) == k


def test_ids_read_back_as_texts(spark):
    rows = [(1, "Ünïcode — 漢字 \n\t  two  spaces's"), (2, ""), (3, None), (None, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    back = tokens.texts_of(tokens.token_ids(df, "doc_id", "text"), "doc_id").collect()
    assert sorted(((r.doc_id or 0), r.text) for r in back) == sorted(((i or 0), t or "") for i, t in rows)
