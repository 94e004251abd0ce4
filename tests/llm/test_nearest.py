import numpy as np
import pytest

from tonearm.llm import nearest
from tonearm.llm.hilbert import hilbert_keys

V = ["danceability", "energy", "valence", "acousticness"]
KINDS = "vec_id bigint, " + ", ".join(f"{v} float" for v in V) + ", POINT int"


def brute(ids, x, k=5):
    out = set()
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        for j in np.lexsort((ids, d))[: min(k, len(x) - 1)]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def found(spark, ids, x, **more):
    rows = [(int(i), *map(float, r), 0) for i, r in zip(ids, x)]
    got = nearest.nearest_pairs(spark.createDataFrame(rows, KINDS), "vec_id", V, **more).collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(pairs) == len(got) and all(a < b for a, b in pairs)
    return pairs


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4)).astype(np.float16).astype(np.float32)
    x[:300] = x[0]  # a crowd of equal vectors
    x[300:500] = (x[300] + rng.normal(0, 0.002, (200, 4))).clip(0, 1).astype(np.float16)
    ids = rng.permutation(4000)
    want, got = brute(ids, x.astype(float)), found(spark, ids, x)
    assert len(got & want) / len(want) >= 0.99 and len(got & want) / len(got) >= 0.99


def test_a_third_in_one_crowd_is_exact(spark):
    x = np.vstack([np.tile([[0.5, 0.5, 0.5, 0.5]], (40, 1)), np.random.default_rng(2).random((80, 4))]).astype(np.float32)
    ids = np.arange(120)[::-1]
    assert found(spark, ids, x) == brute(ids, x.astype(float))


@pytest.mark.parametrize("n", [0, 1, 2, 4, 7])
def test_few_rows(spark, n):
    x = np.random.default_rng(3).random((n, 4)).astype(np.float32)
    assert found(spark, np.arange(n), x) == brute(np.arange(n), x.astype(float))


def test_small_crowds_fill_up_from_others(spark):
    x = np.array([[0, 0, 0, 0]] * 3 + [[0.1, 0, 0, 0]] * 2 + [[0.5, 0, 0, 0]] * 9, np.float32)
    assert found(spark, np.arange(14), x) == brute(np.arange(14), x.astype(float))


def test_unusable_rows_and_repeated_keys(spark):
    rows = [(3, "t", 0.1, 0.0, 0.0, 0.0), (1, "t", float("nan"), 0.0, 0.0, 0.0), (4, None, 0.2, 0.0, 0.0, 0.0), (5, None, 0.3, 0.0, 0.0, 0.0),
            (None, "u", 0.1, 0.0, 0.0, 0.0), (6, "w", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "vec_id bigint, track_id string, " + ", ".join(f"{v} float" for v in V))
    first = nearest.one_row_per_key(df, "track_id", "vec_id", V)
    assert sorted(r.vec_id for r in first.collect()) == [1, 4, 5, 6]
    assert {(r.a, r.b) for r in nearest.nearest_pairs(first, "vec_id", V).collect()} == {(4, 5)}


def test_hilbert_curve_is_a_walk():
    side = np.arange(8)
    grid = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    path = grid[np.argsort(hilbert_keys(grid, 3))]
    assert len(set(hilbert_keys(grid, 3))) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_windows_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    x, ids, curve = rng.random((90, 4)), rng.permutation(90), np.repeat([0, 1], 45).astype(np.int32)
    import pyarrow as pa

    def batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(curve[a:b]), pa.array(ids[a:b]), nearest._rows(x[a:b])], names=["curve", "point", "x"])

    def run(cuts):
        parts = nearest._windows(6, 3)(iter([batch(a, b) for a, b in zip(cuts, cuts[1:])]))
        return {p: n for part in parts for p, n in zip(part.column("point").to_pylist(), part.column("near").to_pylist())}

    whole = run([0, 90])
    assert len(whole) == 90 and whole == run([0, 1, 3, 30, 31, 77, 90])


def test_wide_vectors(spark):
    rng = np.random.default_rng(6)
    x = (rng.random((40, 24))[rng.integers(0, 40, 1500)] + rng.normal(0, 0.1, (1500, 24))).astype(np.float32)
    names = [f"v{i}" for i in range(24)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "vec_id bigint, " + ", ".join(f"{v} float" for v in names))
    got = {(r.a, r.b) for r in nearest.nearest_pairs(df, "vec_id", names).collect()}
    want = brute(np.arange(1500), x.astype(float))
    assert len(got & want) / len(want) >= 0.9

