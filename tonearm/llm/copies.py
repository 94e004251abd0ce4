"""Records that differ only in formatting: white space, case, punctuation, field order.

Method. A vectorised pass streams the bytes of both fields through a skip-and-fold
table into two rolling polynomial hashes and adds the mixed hashes of the fields,
so their order does not matter. The same pass names each row's partition: the
hash's own, or, for a hash that a small sample shows to hold more than a fair
share of the rows, one of as many pieces as its share asks for. So rows are hashed
once and a set of copies holding a third of the table spreads over many tasks.
Each task walks its sorted runs of equal hashes once and verifies every row against
the run's first by two-pointer skipping comparison. The pieces of a split set are
joined through their heads, of which there is one per piece. The sample only
decides where rows go, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.folding import FoldTable, mix, rolling_hashes, same_skipping
from tonearm.session import durable, shuffle_partitions

#: Rows looked at to find the hashes that need splitting, and rows a split hash shows in that sample at least.
SAMPLE_ROWS, LEAST_SEEN = 50_000, 20
#: Kinds of a walked row: a copy whose set is whole in its partition; a head and a copy of a piece of a split set.
WHOLE, HEAD, PIECE = 0, 1, 2
_HASHED = "part int, split boolean, row_id bigint, a string, b string, h1 bigint, h2 bigint"
_MEMBERS = "h1 bigint, h2 bigint, head bigint, row_id bigint, kind int, a string, b string"
_table: FoldTable | None = None


def _fold_table() -> FoldTable:
    global _table
    if _table is None:
        _table = FoldTable()
    return _table


def hash_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds both hashes; rows with a field that has no letter or digit have no copies and end here."""
    table = _fold_table()
    ha, ga, na = rolling_hashes(batch.column("a"), table)
    hb, gb, nb = rolling_hashes(batch.column("b"), table)
    h1 = (mix(ha) + mix(hb)).view(np.int64)
    h2 = (mix(ga ^ np.uint64(1)) + mix(gb ^ np.uint64(1))).view(np.int64)
    out = pa.RecordBatch.from_arrays(
        [batch.column("row_id"), batch.column("a"), batch.column("b"), pa.array(h1), pa.array(h2)],
        names=["row_id", "a", "b", "h1", "h2"],
    )
    return out.filter(pa.array((na > 0) & (nb > 0)))


def _only_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield hash_batch(batch).select(["h1", "h2"])


def _placed(pieces: dict[int, int], parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes rows and names their partitions; ``pieces`` has the first hash of every set to split."""
    split_keys = np.array(sorted(pieces), np.int64)
    split_sizes = np.array([pieces[k] for k in sorted(pieces)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = hash_batch(batch)
            h1 = batch.column("h1").to_numpy()
            own = mix(h1.view(np.uint64))
            split = np.zeros(len(h1), bool)
            if len(split_keys):
                at = np.minimum(np.searchsorted(split_keys, h1), len(split_keys) - 1)
                split = split_keys[at] == h1
                scattered = mix(batch.column("row_id").to_numpy().view(np.uint64)) % split_sizes[at]
                own = np.where(split, own + scattered, own)
            part = (own % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(split), *batch.columns], names=["part", "split", *batch.schema.names])

    return run


def same_record(a: tuple, b: tuple) -> bool:
    """Are two (field, field) pairs copies, in either order of the fields?"""
    return (same_skipping(a[0], b[0]) and same_skipping(a[1], b[1])) or (
        same_skipping(a[0], b[1]) and same_skipping(a[1], b[0])
    )


class Walk:
    """One partition's walk over its sorted runs of equal hashes."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.anchors: list[tuple] = []  # (row id, fields) of each distinct record of the run
        self.out: list[tuple] = []

    def take(self, key: tuple, ident: int, fields: tuple, split: bool) -> None:
        if key != self.key:
            self.key, self.anchors = key, []
        head = next((i for i, f in self.anchors if same_record(f, fields)), None)
        if head is None:
            self.anchors.append((ident, fields))
            if split:
                self.out.append((*key, ident, ident, HEAD, *fields))
        else:
            self.out.append((*key, head, ident, PIECE if split else WHOLE, None, None))

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) or [()] * 7
        self.out = []
        kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.string()] * 2
        names = ["h1", "h2", "head", "row_id", "kind", "a", "b"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def walk_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified members of each run. The texts of rows whose hash stands alone are passed over unread."""
    walk = Walk()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        like_last = np.ones(n, bool)
        like_last[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        like_last[0] = walk.key == (int(h1[0]), int(h2[0]))
        wanted = like_last | batch.column("split").to_numpy(zero_copy_only=False)
        wanted[:-1] |= like_last[1:]
        wanted[-1] = True  # the next batch may go on with it
        at = np.flatnonzero(wanted)
        picked = batch.take(pa.array(at))
        columns = (picked.column(c).to_pylist() for c in ("h1", "h2", "row_id", "a", "b", "split"))
        for k1, k2, ident, a, b, split in zip(*columns):
            walk.take((k1, k2), ident, (a, b), split)
        yield walk.flush()


def _join_heads(pdf: pd.DataFrame) -> pd.DataFrame:
    """Heads of the pieces of one hash (one per piece and record) -> the smallest equal head."""
    anchors: list[tuple] = []
    rows = []
    for r in pdf.sort_values("head").itertuples(index=False):
        fields = (r.a if isinstance(r.a, str) else None, r.b if isinstance(r.b, str) else None)
        found = next((i for i, f in anchors if same_record(f, fields)), None)
        if found is None:
            found = r.head
            anchors.append((found, fields))
        rows.append((r.h1, r.h2, r.head, found))
    return pd.DataFrame(rows, columns=["h1", "h2", "head", "first"])


def _pieces(slim: DataFrame, parts: int) -> dict[int, int]:
    """The hashes that hold more than half a partition's fair share of a sample, and their number of pieces.

    At most twice as many as there are partitions. A hash the sample misses stays in one
    partition, which costs balance and changes nothing in the result.
    """
    total = slim.count()
    rate = min(1.0, max(SAMPLE_ROWS, LEAST_SEEN * parts) / max(total, 1))
    seen = slim.sample(rate, 11) if rate < 1 else slim
    counts = seen.mapInArrow(_only_hashes, "h1 bigint, h2 bigint").groupBy("h1").count()
    expected = max(1.0, total * rate)
    fair = max(LEAST_SEEN, expected / (2 * parts))
    return {r["h1"]: min(parts, -(-int(r["count"] * 2 * parts) // int(expected))) for r in counts.filter(F.col("count") >= fair).collect()}


def copy_pairs(df: DataFrame, ident: str, field_a: str, field_b: str) -> DataFrame:
    """``(first, row_id)``: every further copy beside the smallest id of its set.

    A row with no letter or digit in one of the fields (null and empty included),
    or without an id, has no copies. Equal rows are copies; repeated ids are not
    told apart. An empty table gives no rows. Columns other than the three named
    are not read.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    slim = df.select(
        F.col(ident).cast("bigint").alias("row_id"),
        F.col(field_a).cast("string").alias("a"),
        F.col(field_b).cast("string").alias("b"),
    ).filter("row_id is not null and a is not null and b is not null")
    placed = slim.mapInArrow(_placed(_pieces(slim, parts), parts), _HASHED)
    sorted_runs = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("h1", "h2", "row_id")
    walked = durable(sorted_runs.mapInArrow(walk_runs, _MEMBERS))
    whole = walked.filter(F.col("kind") == WHOLE).select(F.col("head").alias("first"), "row_id")
    heads = walked.filter(F.col("kind") == HEAD)
    joined = heads.groupBy("h1", "h2").applyInPandas(_join_heads, "h1 bigint, h2 bigint, head bigint, first bigint")
    pieces = walked.filter(F.col("kind") != WHOLE).select("h1", "h2", "head", "row_id")
    # one head per piece, and pieces are a few times the partitions: the map is as small as their number
    pieces = pieces.join(F.broadcast(joined), ["h1", "h2", "head"]).select("first", "row_id")
    return whole.unionByName(pieces.filter("first <> row_id"))


def copy_counts(df: DataFrame, ident: str, field_a: str, field_b: str) -> DataFrame:
    """``(row_id, copies)``: one row per record, copies counting the record itself.

    Rows that cannot have copies (see ``copy_pairs``) are records of one copy.
    """
    pairs = durable(copy_pairs(df, ident, field_a, field_b))
    counts = pairs.groupBy("first").agg((F.count("*") + 1).alias("copies"))
    ids = df.select(F.col(ident).cast("bigint").alias("row_id")).filter("row_id is not null")
    kept = ids.join(pairs.select("row_id"), "row_id", "left_anti")
    return kept.join(counts.withColumnRenamed("first", "row_id"), "row_id", "left").select(
        "row_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies")
    )
