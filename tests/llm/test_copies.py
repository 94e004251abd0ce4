import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonearm.llm import copies, folding

KINDS = "row_id bigint, artist_name string, track_name string, ROW_IDX int"


def canonical(text):
    """The letters and digits, folded, with the accents of each in a fixed order."""
    out = []
    for c in text or "":
        letters, accents = folding.fold_char(c)
        out += [[x, ""] for x in letters]
        out = out or [["", ""]] if accents else out
        if accents:
            out[-1][1] += accents
    return tuple((x, "".join(sorted(a))) for x, a in out)


def brute(rows):
    sets = {}
    for i, a, t, *_ in sorted(rows, key=lambda r: r[0]):
        key = tuple(sorted((canonical(a), canonical(t))))
        if all(any(x for x, _ in k) for k in key):
            sets.setdefault(key, []).append(i)
    return sorted((s[0], i) for s in sets.values() for i in s[1:])


def found(spark, rows, parts=None):
    df = spark.createDataFrame(rows, KINDS)
    df = df.repartition(parts) if parts else df
    return sorted(map(tuple, copies.copy_pairs(df, "row_id", "artist_name", "track_name").collect()))


@pytest.mark.parametrize("shuffles", [3, 16])
def test_against_brute_force_with_a_hot_set(spark, shuffles):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        a, t = ("Hot", "Title!") if i % 3 == 0 else (f"artist {rng.randrange(40)}", f"song {rng.randrange(30)}")
        a, t = rng.choice([(a, t), (t, a), (a.upper(), t), (a + " ", f"({t})"), (a.replace("o", " o"), t)])
        rows.append((i, a, t, 0))
    rows += [(2000, None, None, 0), (2001, "...", " ", 0), (2002, None, "x" * 200_000, 0), (2003, "X" * 200_000, "", 0)]
    rows += [(2004, "y", "x" * 200_000, 0), (2005, "X" * 200_000, "y!", 0)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))  # the hot set spans several partitions
    try:
        assert found(spark, rows, 5) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_accents_count_in_either_spelling(spark):
    rows = [(1, "Béla", "x", 0), (2, "Béla", "X", 0), (3, "Bela", "x", 0), (4, "BÉLA", "x.", 0)]
    assert found(spark, rows) == [(1, 2), (1, 4)]


def test_fields_are_not_run_together(spark):
    assert found(spark, [(1, "ab", "c", 0), (2, "a", "bc", 0), (3, "c", "ab", 0)]) == [(1, 3)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_counts(spark):
    rows = [(1, "a", "b", 0), (2, "A", "b", 0), (3, None, None, 0), (4, "c", None, 0)]
    df = spark.createDataFrame(rows, KINDS)
    assert sorted(map(tuple, copies.copy_counts(df, "row_id", "artist_name", "track_name").collect())) == [(1, 2), (3, 1), (4, 1)]


def test_colliding_hashes_are_told_apart():
    walk = copies.Walk()
    for i, fields in enumerate([("a", "b"), ("c", "d"), ("B", "A"), ("D", "c")]):
        walk.take((1, 1), i, fields, False)
    assert [(r[2], r[3]) for r in walk.out] == [(0, 2), (1, 3)]


def test_one_empty_field_means_no_copies(spark):
    rows = [(1, "Hot", None, 0), (2, "Hot", None, 0), (3, "hot", " ", 0), (4, None, "Hot", 0), (5, "...", "Hot", 0)]
    assert found(spark, rows) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8), st.text("aA éÉe\u0301\u0323각ᄀ", max_size=6)), max_size=8))
def test_hashes_of_bytes_agree_as_the_texts_do(texts):
    column = pa.array(["skip", *texts], pa.string()).slice(1)  # a slice: offsets do not begin at 0
    one, two, counts = folding.rolling_hashes(column, copies._fold_table())
    forms = [canonical(t) for t in texts]
    assert counts.tolist() == [sum(1 for x, _ in f if x) for f in forms]
    for i, x in enumerate(forms):
        for j, y in enumerate(forms):
            assert (x == y) == (one[i] == one[j] and two[i] == two[j])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=8), st.text(max_size=8))
def test_skipping_comparison(a, b):
    assert folding.same_skipping(a, b) == (canonical(a) == canonical(b))
    assert folding.same_skipping(a, a.upper() if a.isascii() else a)
