"""The k most similar vectors of every vector, by shifted space-filling curves.

Method. Equal vectors are one point. Each point gets its place on several
Hilbert curves, each over another projection and shift. The points of all curves
are range-partitioned by (curve, place) in Spark, at bounds taken from a sample of
the points, so places are computed once; every point meets its ``window``
neighbours on either side, distances are exact, and each curve hands on the k best.
The curves' lists are then merged, repeats removed, and ranked again. Work is
linear in the points; a crowd of equal vectors costs one point, whatever its size.

A window ends with its partition: of ``PART_ROWS`` rows the ``window`` first and last
meet fewer neighbours on that curve, and all of theirs on the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.heap import smallest
from tonearm.llm.hilbert import Orderings
from tonearm.operators.skew import attach
from tonearm.session import durable, shuffle_partitions

#: Points of a partition of a curve, and points of the sample for each bound between partitions.
PART_ROWS, SAMPLE_ROWS = 50_000, 200
_PLACED = "part int, curve int, place bigint, point bigint, x array<double>"
_LISTS = "point bigint, near array<struct<d:double,id:bigint>>"
_LIST_TYPE = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rows(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))


def _place(orderings: Orderings, bounds: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every point once per curve, with its place and the number of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            for k, own in enumerate(bounds):
                place = orderings.keys(k, x)
                part = k * (len(own) + 1) + np.searchsorted(own, place, side="right")
                curve = np.full(len(x), k, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(curve), pa.array(place), batch.column("point"), batch.column("x")],
                    names=["part", "curve", "place", "point", "x"],
                )

    return run


def _bounds(points: DataFrame, orderings: Orderings, total: int) -> list[np.ndarray]:
    """For each curve the places at which partitions of about ``PART_ROWS`` points end, from a sample of ``SAMPLE_ROWS`` a partition."""
    parts = max(1, -(-total // PART_ROWS))
    if parts == 1:
        return [np.zeros(0, np.int64) for _ in orderings.maps]
    sample = points.select("x").sample(min(1.0, parts * SAMPLE_ROWS / total), 13).toArrow()
    x = _matrix(sample.column("x"))
    marks = np.arange(1, parts) * len(x) // parts
    return [np.sort(orderings.keys(k, x))[marks] for k in range(len(orderings.maps))]


def best_in_window(
    x: np.ndarray, ids: np.ndarray, curve: np.ndarray, low: int, high: int, window: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``low..high`` the k nearest among ``window`` rows either side: squared distances and ids.

    Unfilled places hold an infinite distance. Nearer first, then the smaller id.
    """
    start, end = max(0, low - window), min(len(x), high + window)
    x, ids, curve, shift = x[start:end], ids[start:end], curve[start:end], low - start
    rows = high - low
    d = np.full((end - start, 2 * window), np.inf)
    columns = [np.ascontiguousarray(x[:, c]) for c in range(x.shape[1])]
    several = curve[0] != curve[-1]
    for s in range(1, min(window, end - start - 1) + 1):  # each distance serves both of its rows
        apart = np.zeros(end - start - s)
        for c in columns:
            diff = c[s:] - c[:-s]
            apart += diff * diff
        if several:
            apart[curve[s:] != curve[:-s]] = np.inf
        d[:-s, window + s - 1] = apart
        d[s:, window - s] = apart
    d = d[shift : shift + rows]
    steps = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    near = ids[np.clip(np.arange(shift, shift + rows)[:, None] + steps[None, :], 0, end - start - 1)]
    if d.shape[1] > k:
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        crowded = (d <= bound).sum(1) > k  # ties at the bound need the ids too
        cut = np.argpartition(d, k - 1, axis=1)[:, :k]
        for r in np.flatnonzero(crowded):
            cut[r] = np.lexsort((near[r], d[r]))[:k]
        d, near = np.take_along_axis(d, cut, 1), np.take_along_axis(near, cut, 1)
    order = np.lexsort((near, d), axis=1)
    return np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)


def _lists(points: np.ndarray, d: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    real = np.isfinite(d)
    offsets = np.zeros(len(points) + 1, np.int32)
    np.cumsum(real.sum(1), out=offsets[1:])
    values = pa.StructArray.from_arrays([pa.array(d[real]), pa.array(near[real])], names=["d", "id"])
    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
    return pa.RecordBatch.from_arrays([pa.array(points), lists.cast(_LIST_TYPE)], names=["point", "near"])


def _windows(window: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams a sorted partition; only ``2 * window`` rows are carried between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = ids = curve = None
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _matrix(batch.column("x")), batch.column("point").to_numpy(), batch.column("curve").to_numpy()
            x, ids, curve = new if x is None else (np.concatenate(p) for p in zip((x, ids, curve), new))
            ready = len(x) - window
            for low in range(done, max(ready, done), 4096):
                high = min(low + 4096, ready)
                yield _lists(ids[low:high], *best_in_window(x, ids, curve, low, high, window, k))
            done = max(done, ready)
            spare = max(0, done - window)
            x, ids, curve, done = x[spare:], ids[spare:], curve[spare:], done - spare
        if x is not None and done < len(x):
            yield _lists(ids[done:], *best_in_window(x, ids, curve, done, len(x), window, k))

    return run


def nearest_points(points: DataFrame, k: int, curves: int, window: int) -> DataFrame:
    """``(point, near)`` for distinct points ``(point, x)``: up to k ``(squared distance, point)``, best first."""
    spark = points.sparkSession
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    shape = points.agg(F.max(norm).alias("r"), F.max(F.size("x")).alias("w"), F.count("*").alias("n")).first()
    orderings = Orderings(shape["w"] or 1, curves, float(np.sqrt(shape["r"] or 0.0)))
    bounds = _bounds(points, orderings, shape["n"])
    placed = points.select("point", "x").mapInArrow(_place(orderings, bounds), _PLACED)
    ranged = placed.repartitionById(curves * (len(bounds[0]) + 1), F.col("part")).sortWithinPartitions("place", "point")
    lists = ranged.select("curve", "point", "x").mapInArrow(_windows(window, k), _LISTS)
    lists = lists.groupBy("point").agg(F.flatten(F.collect_list("near")).alias("near"))
    return lists.select("point", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))


def nearest_pairs(
    df: DataFrame, ident: str, values: list[str], k: int = 5, curves: int | None = None, window: int = 64
) -> DataFrame:
    """``(a, b, d)``: every pair of rows of which one is among the other's k nearest; ``a < b``.

    ``d`` is the Euclidean distance in double precision; at equal distances the
    smaller id is nearer. Rows with a null id, or a null, NaN or infinite value,
    are left out. Equal rows are neighbours at distance 0; a lone row has no
    pair, an empty table none at all. Other columns are not read.

    ``curves`` (8 for vectors of up to four values, else 48) and ``window`` set the
    accuracy: the loss is measured in the tests and in the README. A crowd of equal
    vectors is served exactly.
    """
    curves = curves or (8 if len(values) <= 4 else 48)
    finite = [F.abs(F.col(c).cast("double")) < F.lit(float("inf")) for c in values]
    rows = df.select(
        F.col(ident).cast("bigint").alias("id"),
        # adding zero turns -0.0 into 0.0, so that equal vectors are equal keys
        F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in values]).alias("x"),
        *[ok.alias(f"ok{i}") for i, ok in enumerate(finite)],
    ).filter(" and ".join(["id is not null", *[f"ok{i}" for i in range(len(values))]]))
    rows = durable(rows.select("id", "x"))
    total = rows.count()
    crowds = rows.groupBy("x").agg(smallest(F.col("id"), k + 1).alias("ids"), F.count("*").alias("size"))
    crowds = durable(crowds.withColumn("point", F.col("ids")[0]))

    # inside a crowd: each member and the k smallest others
    shared = crowds.filter("size > 1").select("x", "ids", "size")
    members = attach(rows, shared, "x", "size", total, "id").filter("ids is not null")
    within = members.select("id", F.explode(F.slice(F.array_remove("ids", F.col("id")), 1, k)).alias("near"))
    within = within.select("id", "near", F.lit(0.0).alias("d2"))

    # between crowds: needed by those too small to serve themselves
    lists = nearest_points(crowds.select("point", "x"), k, curves, window)
    links = lists.select("point", F.explode("near").alias("n")).select("point", F.col("n.id").alias("to"), F.col("n.d").alias("d2"))
    sizes = crowds.filter("size > 1").select("point", "ids", "size")
    few = sizes.filter(F.col("size") <= k)
    links = links.join(sizes.filter(F.col("size") > k).select("point"), "point", "left_anti")
    targets = sizes.select(F.col("point").alias("to"), F.slice("ids", 1, k).alias("to_ids"))
    links = links.join(targets, "to", "left").withColumn("to_ids", F.coalesce("to_ids", F.array("to")))
    links = links.select("point", "d2", F.explode("to_ids").alias("near"))
    best = links.groupBy("point").agg(smallest(F.struct("d2", "near"), k).alias("best"))
    best = best.join(few.select("point", "ids"), "point", "left").withColumn("ids", F.coalesce("ids", F.array("point")))
    best = best.select(F.explode("ids").alias("id"), F.expr(f"slice(best, 1, {k + 1} - size(ids))").alias("best"))
    between = best.select("id", F.explode("best").alias("e")).select("id", F.col("e.near").alias("near"), F.col("e.d2").alias("d2"))

    pairs = within.unionByName(between)
    return (
        pairs.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"), F.sqrt("d2").alias("d"))
        .groupBy("a", "b")
        .agg(F.min("d").alias("d"))
    )


def one_row_per_key(df: DataFrame, key: str, ident: str, values: list[str]) -> DataFrame:
    """Of several rows with one key only the one with the smallest id; rows with a null key all stay."""
    entry = F.struct(F.col(ident).alias("i"), *[F.col(v).alias(f"v{n}") for n, v in enumerate(values)])
    apart = F.when(F.col(key).isNull(), F.col(ident)).alias("apart")
    first = df.filter(F.col(ident).isNotNull()).groupBy(F.col(key).alias("key"), apart).agg(F.min(entry).alias("e"))
    return first.select(F.col("e.i").alias(ident), *[F.col(f"e.v{n}").alias(v) for n, v in enumerate(values)])
