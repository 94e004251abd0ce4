"""New batches checked against everything already accepted, without reprocessing it.

Method. Every distinct title of an artist is fingerprinted: hashes of its letter
n-grams, salted by the artist, their length by the title's. Of longer titles every
window keeps the smallest (winnowing); the windows do not overlap and there is one
more of them than slips are allowed, so no repetition the title rule accepts is
missed. A persistent store holds one record per distinct title with its
fingerprints, bucketed by artist, the track ids, bucketed by their hash, and Bloom
filters partitioned by bucket and, in buckets that hold a hot artist, by fingerprint.
A run of new rows is prescreened against the filters of the buckets it touches; only
positives are looked up, and only there; candidates must cover as much of each other
as every repetition does and then agree as titles. The run's own titles, ids and
filter bits are then appended, and small runs are merged level by level. Earlier
history is never fingerprinted or shuffled again.

Batches are numbered once, in order, and cut into runs of exactly ``run_rows`` rows,
written by run, so a run reads nothing of the others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.folding import mix
from tonearm.llm.titles import Title, most_slips, read_title, same_title
from tonearm.session import durable, shared_dir, shuffle_partitions

#: (least letters, n-gram length, windowed) of stored titles, by length. A slip spoils at most n + 1 grams, so a title with
#: as many slips as ``same_title`` allows, or whose other half is cut, still shares a gram in each band that keeps them all.
#: Of the windowed ones, parted by a letter, a slip spoils at most one, and the first lies in the half that a cut leaves.
BANDS = ((1, 1, False), (5, 2, False), (11, 3, False), (15, 4, True), (28, 6, True))
#: Gram of titles of one letter, which are a slip away from any other.
ONE_LETTER = 9
BITS_PER_ENTRY, HASHES, ROWS_PER_BUCKET = 12, 4, 60_000
#: A bucket of more rows than this has its filters split by fingerprint, a part for each so many rows.
ROWS_PER_FILTER = 4 * ROWS_PER_BUCKET
#: Rows up to which something is broadcast: pairs of numbers, or titles of a run.
BROADCAST_PAIRS, BROADCAST_TITLES = 2_000_000, 100_000
#: Runs of one level that are merged into one of the next.
FAN = 8
#: Rows of a run, at least; it grows with history so that their number does not.
RUN_ROWS, HISTORY_SHARE = 50_000, 10
_BASE = np.uint64(0x9E3779B97F4A7C15)

_READ = "ident bigint, ord bigint, idk string, cid bigint, artist string, words string, numbers string, cut boolean"
_FILTERS = "kind string, bucket int, sub int, size bigint, bits binary"
_STORED = "bucket int, cid bigint, artist string, words string, numbers string, cut boolean, fps array<int>"
_TITLE = ["artist", "words", "numbers", "cut"]
_STORED_NAMES = {"cid": "scid", "artist": "sartist", "words": "swords", "numbers": "snumbers", "cut": "scut"}


# ---- fingerprints -------------------------------------------------------------------------------------------------


class _Grams:
    """All n-gram hashes of a batch of letter strings, salted per row."""

    def __init__(self, letters: list[str], salts: np.ndarray) -> None:
        self.sizes = np.array([len(x) for x in letters], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        raw = np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), "<u4")
        self.points = mix(raw.astype(np.uint64) + np.uint64(1))
        self.salts = salts

    def of(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every k-gram of the chosen rows, in order."""
        count = np.maximum(self.sizes[rows] - k + 1, 0)
        row = np.repeat(rows, count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = self.starts[row] + place
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * _BASE + self.points[at + j]
        return (mix(h ^ self.salts[row] ^ np.uint64(k)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), row

    def winnow(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, row): the smallest hash of every window, one window more than a title's slips, a letter between them."""
        h, row = self.of(k, rows)
        if not len(h):
            return h, row
        windows = np.array([most_slips(n) + 1 for n in range(int(self.sizes.max()) + 1)])[self.sizes]
        wide = self.sizes // windows
        first = np.ones(len(h), bool)
        first[1:] = row[1:] != row[:-1]
        begin = np.flatnonzero(first)
        place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        window, inside = np.divmod(place, wide[row])
        keep = (window < windows[row]) & (inside <= wide[row] - 1 - k)
        h, row, window = h[keep], row[keep], window[keep]
        begins = np.ones(len(h), bool)
        begins[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
        at = np.flatnonzero(begins)
        return _distinct(np.minimum.reduceat(h, at), row[at])


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _by_row(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    h = np.concatenate([p[0] for p in parts])
    row = np.concatenate([p[1] for p in parts])
    h, row = _distinct(h, row)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int32)))


def _salts(artists: list[str]) -> np.ndarray:
    return np.array([_hash64(a) for a in artists], np.int64).view(np.uint64)


def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _asked_lengths(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and most letters of stored titles that a title of n letters may repeat: a few slips, or a cut end."""
    cut = n >= 6
    return np.where(cut, np.minimum(n - 3, -(-n // 2)), n - 1), np.where(cut, np.maximum(n + 3, 2 * n), n + 1)


def fingerprints(letters: list[str], artists: list[str], asking: bool) -> pa.Array:
    """Stored fingerprints of titles, or (``asking``) every n-gram a stored one could be."""
    grams = _Grams(letters, _salts(artists))
    size, rows = grams.sizes, np.arange(len(letters))
    low, high = _asked_lengths(size) if asking else (size, size)
    one = rows[size == 1]
    parts = [(mix(grams.salts[one] ^ np.uint64(ONE_LETTER)).astype(np.uint32), one)]
    for (least, k, windowed), (over, _, _) in zip(BANDS, (*BANDS[1:], (1 << 30, 0, False))):
        within = rows[(low < over) & (high >= least)]
        parts.append(grams.winnow(k, within) if windowed and not asking else grams.of(k, within))
    return _by_row(parts, len(letters))


def covered(asking: str, stored: str) -> bool:
    """Do two titles share as many n-grams as every repetition of the stored one has of it?"""
    n = len(stored)
    k = next(k for least, k, _ in reversed(BANDS) if n >= least)
    own = {stored[i : i + k] for i in range(n - k + 1)}
    return n == 1 or sum(g in asking for g in own) >= len(own) - max(most_slips(n) * (k + 1), n // 2)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads titles; ``cid`` identifies what an artist's title says and is null where it says nothing."""
    for batch in batches:
        artists, titles = batch.column("artist").to_pylist(), batch.column("title").to_pylist()
        read = [read_title(t) for t in titles]
        cids = [
            _hash64("\0".join((a, t.letters, t.numbers, "cut" if t.cut else ""))) if a is not None and t.letters else None
            for a, t in zip(artists, read)
        ]
        columns = [
            batch.column("ident"), batch.column("ord"), batch.column("idk"), pa.array(cids, pa.int64()), batch.column("artist"),
            pa.array([t.words for t in read], pa.string()), pa.array([t.numbers for t in read], pa.string()),
            pa.array([t.cut for t in read], pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["ident", "ord", "idk", "cid", "artist", "words", "numbers", "cut"])


def _once_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops repetitions of a title within an Arrow batch, so that a hot title is thin before it is shuffled."""
    for batch in _read(batches):
        _, first = np.unique(batch.column("cid").fill_null(0).to_numpy(), return_index=True)
        yield batch.take(pa.array(np.sort(first)))


def _letters(batch: pa.RecordBatch) -> list[str]:
    return [w.replace(" ", "") for w in batch.column("words").to_pylist()]


def _with_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of titles sorted by (bucket, cid), each title once."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cid = batch.column("cid").to_numpy()
        new = np.ones(len(cid), bool)
        new[1:] = cid[1:] != cid[:-1]
        new[0] = last != cid[0]
        last = cid[-1]
        batch = batch.filter(pa.array(new))
        fps = fingerprints(_letters(batch), batch.column("artist").to_pylist(), asking=False)
        names = ["bucket", "cid", *_TITLE]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), fps], names=[*names, "fps"])


def _with_questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ask = fingerprints(_letters(batch), batch.column("artist").to_pylist(), asking=True).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("cid"), ask], names=["bucket", "key", "vs"])


# ---- partitioned Bloom filters ------------------------------------------------------------------------------------


def _bloom_places(values: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` bits of each value, by double hashing."""
    a = mix(values.astype(np.int64).view(np.uint64))
    b = mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((a[:, None] + steps[None, :] * b[:, None]) % np.uint64(bits)).astype(np.int64)


def _build_filters(kind: str):
    """A filter for each (bucket, part) a partition of the store's files holds, as large as its content asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            vs = batch.column("vs")
            size = np.diff(vs.offsets.to_numpy())
            v = vs.flatten().to_numpy().astype(np.int64)
            bucket, subs = (np.repeat(batch.column(c).to_numpy(), size) for c in ("bucket", "subs"))
            sub = v % subs
            order = np.lexsort((sub, bucket))
            v, bucket, sub = v[order], bucket[order], sub[order]
            new = np.ones(len(v), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1])
            at = np.flatnonzero(new)
            for low, own in zip(at, np.split(v, at[1:])):
                found.setdefault((int(bucket[low]), int(sub[low])), []).append(own)
        rows = []
        for (b, sub), parts in found.items():
            v = np.concatenate(parts)
            bits = max(64, len(v) * BITS_PER_ENTRY)
            flags = np.zeros(bits, bool)
            flags[_bloom_places(v, bits).reshape(-1)] = True
            rows.append((kind, b, sub, bits, np.packbits(flags).tobytes()))
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        names = ["kind", "bucket", "sub", "size", "bits"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _prescreen(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The asked values that some filter of their bucket may hold: ``(kind, bucket, key, v)``."""
    asked = asked.combine_chunks()
    lists = asked.column("vs")
    lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    v = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    hit = np.zeros(len(v), bool)
    for bits, packed in zip(filters.column("size").to_pylist(), filters.column("bits").to_pylist()):
        flags = np.unpackbits(np.frombuffer(packed, np.uint8), count=bits).astype(bool)
        left = np.flatnonzero(~hit)
        hit[left] = flags[_bloom_places(v[left], bits)].all(1)
    rows = asked.select(["kind", "bucket", "key"]).take(pa.array(row[hit]))
    return rows.append_column("v", pa.array(v[hit]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps candidates that cover each other and whose titles are the same."""
    for batch in batches:
        rows = batch.to_pydict()
        keep = []
        for w, n, c, sw, sn, sc in zip(*(rows[x] for x in ("words", "numbers", "cut", "swords", "snumbers", "scut"))):
            a, b = Title(w.replace(" ", ""), w, n, c), Title(sw.replace(" ", ""), sw, sn, sc)
            keep.append(covered(a.letters, b.letters) and same_title(a, b))
        yield batch.select(["cid"]).filter(pa.array(keep, pa.bool_()))


# ---- the store ----------------------------------------------------------------------------------------------------


def id_key(track_id: Column) -> Column:
    """The id itself, without white space, address, prefix or parameters around it; case counts."""
    bare = F.regexp_extract(track_id, r"(?U)([^/:?#\s]+)(?:[?#]\S*)?\s*$", 1)
    return F.when(bare != "", bare)


def _plain_rows(df: DataFrame, ident: str, order: Column, artist: str, title: str, track_id: str) -> DataFrame:
    return df.select(
        F.col(ident).cast("bigint").alias("ident"), order.cast("bigint").alias("ord"), id_key(F.col(track_id)).alias("idk"),
        F.col(artist).cast("string").alias("artist"), F.col(title).cast("string").alias("title"),
    )


class HistoryStore:
    """Everything accepted so far, in a folder all executors share.

    Tables ``titles``, ``ids`` and ``filters`` have a folder per run; ``meta`` holds the number of buckets, the
    buckets that are split and, as the newest row, the live runs with their levels. A run that was interrupted is in
    no list of live runs and is written again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int, live: list[tuple[int, int]]) -> None:
        self.spark, self.root, self.buckets, self.live = spark, root, buckets, live
        self.n = shuffle_partitions(spark)

    # -- creating and reopening

    @classmethod
    def create(cls, spark: SparkSession, root: str, rows: DataFrame) -> HistoryStore:
        """A store holding ``rows`` (ident, ord, idk, artist, title)."""
        store = cls(spark, root, max(8, -(-rows.count() // ROWS_PER_BUCKET)), [])
        sizes = rows.filter("artist is not null").groupBy(store._bucket(F.xxhash64("artist")).alias("bucket")).count()
        split = sizes.filter(F.col("count") > ROWS_PER_FILTER)
        # at most a row for each ROWS_PER_FILTER rows of history
        split.select("bucket", F.ceil(F.col("count") / ROWS_PER_FILTER).cast("int").alias("subs")).coalesce(1).write.parquet(f"{root}/meta/split")
        spark.createDataFrame([(store.buckets,)], "buckets int").coalesce(1).write.parquet(f"{root}/meta/buckets")
        read = rows.mapInArrow(_once_per_batch, _READ).filter("cid is not null")
        store._append(read.select("cid", *_TITLE), rows.select("idk"))
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> HistoryStore:
        buckets = spark.read.parquet(f"{root}/meta/buckets").first()["buckets"]
        newest = spark.read.parquet(f"{root}/meta/live").orderBy(F.col("step").desc()).first()
        return cls(spark, root, buckets, [(r["run"], r["level"]) for r in newest["runs"]])

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self) -> None:
        system, path = self._path("")
        system.delete(path, True)

    def _write(self, df: DataFrame, name: str, run: int) -> str:
        """One run's share of a table; written again after a failure, it replaces itself."""
        path = f"{self.root}/{name}/run={run:06d}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer if name == "filters" else writer.partitionBy("bucket")).parquet(path)
        return path

    def _next(self) -> int:
        return max((run for run, _ in self.live), default=-1) + 1

    def _declare(self, live: list[tuple[int, int]]) -> None:
        """Makes a list of runs the live one."""
        self.live = live
        row = [(self._next(), [{"run": r, "level": n} for r, n in live])]
        df = self.spark.createDataFrame(row, "step int, runs array<struct<run int, level int>>")
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/meta/live")

    def _append(self, titles: DataFrame, ids: DataFrame) -> None:
        """Adds titles (cid, artist, words, numbers, cut) and ids (idk); merges runs when there are ``FAN`` of a level."""
        titles = titles.withColumn("bucket", self._bucket(F.xxhash64("artist")))
        ids = ids.filter("idk is not null").select(self._bucket(F.xxhash64("idk")).alias("bucket"), "idk")
        run, level = self._next(), 0
        self._store(run, titles, ids)
        live = [*self.live, (run, level)]
        written = {r for r, _ in live}
        while sum(n == level for _, n in live) >= FAN:
            merged = [r for r, n in live if n == level]
            run, level = run + 1, level + 1
            old = self._table("titles", _STORED, merged).select("bucket", "cid", *_TITLE)
            self._store(run, old, self._table("ids", "idk string, bucket int", merged).select("bucket", "idk"))
            live = [*((r, n) for r, n in live if r not in merged), (run, level)]
            written.add(run)
        self._declare(live)
        for r in written - {r for r, _ in live}:
            for name in ("titles", "ids", "filters"):
                system, path = self._path(f"{name}/run={r:06d}")
                system.delete(path, True)

    def _store(self, run: int, titles: DataFrame, ids: DataFrame) -> None:
        per = max(1, self.n // self.buckets)  # pieces a bucket is written in, so that a hot artist is no single task
        titles = titles.repartition(self.n, "bucket", F.pmod("cid", F.lit(per))).sortWithinPartitions("bucket", "cid")
        contents = self._write(titles.mapInArrow(_with_fingerprints, _STORED), "titles", run)
        ids = ids.repartition(self.n, "bucket", F.pmod(F.shiftright(F.xxhash64("idk"), 16), F.lit(per)))
        known = self._write(ids, "ids", run)
        # the filters are built where the files lie; nothing is shuffled
        read = self.spark.read
        fps = read.schema(_STORED).parquet(contents).select("bucket", F.col("fps").alias("vs")).join(self._split(), "bucket", "left")
        fps = fps.select("bucket", F.coalesce("subs", F.lit(1)).alias("subs"), "vs")
        keys = read.schema("idk string, bucket int").parquet(known)
        keys = keys.select("bucket", F.lit(1).alias("subs"), F.array(F.xxhash64("idk")).alias("vs"))
        filters = fps.mapInArrow(_build_filters("title"), _FILTERS).unionByName(keys.mapInArrow(_build_filters("id"), _FILTERS))
        self._write(filters.coalesce(self.n), "filters", run)

    def _bucket(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.buckets)).cast("int")

    def _split(self) -> DataFrame:
        return self.spark.read.schema("bucket int, subs int").parquet(f"{self.root}/meta/split")

    def _table(self, name: str, schema: str, runs: list[int] | None = None) -> DataFrame:
        runs = [r for r, _ in self.live] if runs is None else runs
        paths = [f"{self.root}/{name}/run={r:06d}" for r in runs]
        # each run is a table of its own with partitions by bucket
        tables = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    # -- one run of new rows

    def check_and_add(self, rows: DataFrame) -> DataFrame:
        """Which of ``rows`` (ident, ord, idk, artist, title) repeat history or an earlier one: ``(ident)``.

        Rows are ordered by (ord, ident). All of them are part of history afterwards.
        """
        rows = rows.withColumn("ord", F.col("ord").cast("bigint"))
        read = durable(rows.mapInArrow(_read, _READ))
        size = read.count()
        when = F.struct("ord", "ident")
        firsts = durable(read.filter("cid is not null").groupBy("cid", *_TITLE).agg(F.min(when).alias("at")))
        questions = firsts.select(self._bucket(F.xxhash64("artist")).alias("bucket"), "cid", "artist", "words")
        questions = questions.mapInArrow(_with_questions, "bucket int, key bigint, vs array<bigint>")
        ids = durable(read.filter("idk is not null").groupBy("idk").agg(F.min(when).alias("at")))
        key = F.xxhash64("idk")
        positive = self._positive(questions, ids.select(self._bucket(key).alias("bucket"), F.lit(None).cast("bigint").alias("key"), F.array(key).alias("vs")))

        old_ids = self._old_ids(ids, positive, size)
        old, exact = self._old_titles(firsts, positive, size)
        matched = durable(old.unionByName(self._new_titles(firsts, questions, size)).distinct())

        by_id = read.join(_small(ids.withColumnRenamed("at", "id_at"), size), "idk").join(_small(old_ids, size), "idk", "left")
        by_id = by_id.filter("old_id or struct(ord, ident) > id_at").select("ident")
        hits = matched.withColumn("hit", F.lit(True))
        by_title = read.join(_small(firsts.select("cid", "at"), size), "cid").join(_small(hits, size), "cid", "left")
        by_title = by_title.filter("hit or struct(ord, ident) > at").select("ident")
        cases = durable(by_id.unionByName(by_title).distinct())
        self._append(
            firsts.join(_small(exact, size), "cid", "left_anti").drop("at"), ids.join(_small(old_ids, size), "idk", "left_anti").select("idk")
        )
        return cases

    def _positive(self, questions: DataFrame, ids: DataFrame) -> DataFrame:
        """What the filters of the touched buckets let pass: ``(kind, bucket, key, v)``, key null for ids."""
        split = questions.join(self._split(), "bucket", "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
        split = split.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        own = F.expr("if(subs = 1, vs, filter(vs, v -> pmod(v, subs) = sub))")
        asked = split.select(F.lit("title").alias("kind"), "bucket", "sub", "key", own.alias("vs"))
        asked = asked.unionByName(ids.select(F.lit("id").alias("kind"), "bucket", F.lit(0).alias("sub"), "key", "vs"))
        touched = asked.select("kind", "bucket").distinct()
        filters = self._table("filters", _FILTERS).join(touched, ["kind", "bucket"], "left_semi")
        found = asked.groupBy("kind", "bucket", "sub").cogroup(filters.groupBy("kind", "bucket", "sub"))
        return durable(found.applyInArrow(_prescreen, "kind string, bucket int, key bigint, v bigint"))

    def _touched(self, positive: DataFrame) -> list[int]:
        """Bucket numbers of the positives: at most as many as there are buckets."""
        return [r[0] for r in positive.select("bucket").distinct().collect()]

    def _old_ids(self, ids: DataFrame, positive: DataFrame, size: int) -> DataFrame:
        hits = positive.filter("kind = 'id'")
        stored = self._table("ids", "idk string, bucket int").filter(F.col("bucket").isin(self._touched(hits)))
        keys = ids.select("idk", F.xxhash64("idk").alias("v")).join(_small(hits.select("v").distinct(), size), "v").select("idk")
        return durable(stored.join(_small(keys, size), "idk").select("idk").distinct().withColumn("old_id", F.lit(True)))

    def _old_titles(self, firsts: DataFrame, positive: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        """Titles of the run that history holds, and those it holds in the same words."""
        hits = positive.filter("kind = 'title'")
        asked = hits.select(F.col("key").alias("cid"), "v")
        pairs = asked.count()
        artists = firsts.join(_small(asked.select("cid").distinct(), size), "cid").select("artist").distinct()
        stored = self._table("titles", _STORED).filter(F.col("bucket").isin(self._touched(hits)))
        stored = stored.join(_small(artists, size), "artist", "left_semi")
        stored = stored.select("cid", *_TITLE, F.explode(F.col("fps").cast("array<bigint>")).alias("v"))
        found = stored.withColumnsRenamed(_STORED_NAMES).join(_small(asked, pairs, BROADCAST_PAIRS), "v")
        found = _near(found.join(_small(firsts, size), "cid"))
        exact = F.col("cid") == F.col("scid")
        found = durable(found.select("cid", exact.alias("exact"), "words", "numbers", "cut", "swords", "snumbers", "scut").distinct())
        same = found.filter("not exact").mapInArrow(_verify, "cid bigint")
        known = found.filter("exact").select("cid").distinct()
        return same.unionByName(known), known

    def _new_titles(self, firsts: DataFrame, questions: DataFrame, size: int) -> DataFrame:
        """Titles of the run that repeat an earlier one of the same run."""
        kept = firsts.withColumn("bucket", F.lit(0)).select("bucket", "cid", *_TITLE)
        grams = kept.mapInArrow(_with_fingerprints, _STORED).select(F.col("cid").alias("scid"), F.explode(F.col("fps").cast("array<bigint>")).alias("v"))
        asked = questions.select(F.col("key").alias("cid"), F.explode("vs").alias("v"))
        pairs = asked.join(_small(grams, size), "v").filter("cid <> scid").select("cid", "scid")
        times = firsts.select("cid", "at")
        later = pairs.join(_small(times, size), "cid").join(_small(times.toDF("scid", "sat"), size), "scid").filter("sat < at").select("cid", "scid")
        found = later.distinct().join(_small(firsts.select("cid", *_TITLE).withColumnsRenamed(_STORED_NAMES), size), "scid")
        return _near(found.join(_small(firsts, size), "cid")).mapInArrow(_verify, "cid bigint")


def _small(df: DataFrame, size: int, most: int = BROADCAST_TITLES) -> DataFrame:
    """``df``, to be broadcast if its size is known to be small."""
    return F.broadcast(df) if size <= most else df


def _near(candidates: DataFrame) -> DataFrame:
    """Pairs of titles of one artist, as far as lengths and slips allow; a swap is two edits of Spark's ``levenshtein``."""
    found = candidates.filter("artist = sartist").withColumns({"a": F.replace("words", F.lit(" ")), "b": F.replace("swords", F.lit(" "))})
    return found.filter(f"startswith(a, b) or startswith(b, a) or levenshtein(a, b, {2 * most_slips(1 << 30)}) >= 0")


# ---- all batches, in order ----------------------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the partition and each row's place in it."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), *batch.columns]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "place", *batch.schema.names])
        place += n


def _in_runs(batches: DataFrame, batch: str, ident: str, columns: list[Column], run_rows: int, folder: str) -> list[DataFrame]:
    """The rows in order of (batch, ident), numbered as ``ord``, and cut into runs of ``run_rows``; a table for each run."""
    spark = batches.sparkSession
    order = [F.col("b").asc_nulls_first(), F.col("ident")]
    slim = batches.select(F.col(batch).alias("b"), *columns)
    ranged = slim.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("b")
    schema = f"part int, place bigint, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ranged.schema)}"
    numbered = durable(ranged.mapInArrow(_numbered, schema))
    counts = sorted((r["part"], r["count"]) for r in numbered.groupBy("part").count().collect())  # a row per partition
    before = dict(zip([p for p, _ in counts], accumulate([0, *(n for _, n in counts)])))
    total = sum(n for _, n in counts)
    if not total:
        return []
    offsets = spark.createDataFrame(sorted(before.items()), "part int, before bigint")
    rows = numbered.join(F.broadcast(offsets), "part").withColumn("ord", F.col("before") + F.col("place")).drop("part", "place", "before")
    if total <= run_rows:
        return [rows]
    rows.withColumn("run", F.expr(f"ord div {run_rows}")).write.mode("overwrite").partitionBy("run").parquet(folder)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return [spark.read.schema(kinds).parquet(f"{folder}/run={k}") for k in range(-(-total // run_rows))]


def repeated_rows(
    history: DataFrame, batches: DataFrame, history_id: str, ident: str, batch: str, artist: str, title: str,
    track_id: str, run_rows: int | None = None, root: str | None = None,
) -> DataFrame:
    """``(ident)`` of every row of ``batches`` that repeats ``history`` or an earlier row of ``batches``.

    Rows come in the order (batch, ident); null batch numbers come first. A row
    repeats another if its track id names the same track, or its artist is equal
    and its title the same apart from slips, habits of writing, a cut end, or
    added credits and edition remarks. Null or blank ids and titles, and null
    artists, match nothing; equal rows repeat each other; rows without ``ident``
    are ignored; empty tables are fine. Other columns are not read.

    ``run_rows`` rows are checked at a time: 50,000, or a tenth of ``history`` if
    that is more. Without ``root`` the store lives in the shared folder and is
    removed at the end; with it, it stays and ``HistoryStore.open`` continues it.
    """
    spark = batches.sparkSession
    folder = root or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    store = HistoryStore.create(spark, folder, _plain_rows(history, history_id, F.lit(0), artist, title, track_id))
    run_rows = run_rows or max(RUN_ROWS, history.count() // HISTORY_SHARE)
    columns = [
        F.col(ident).cast("bigint").alias("ident"), id_key(F.col(track_id)).alias("idk"),
        F.col(artist).cast("string").alias("artist"), F.col(title).cast("string").alias("title"),
    ]
    out = spark.createDataFrame([], "ident bigint")
    for run in _in_runs(batches.filter(F.col(ident).isNotNull()), batch, ident, columns, run_rows, f"{folder}/batches"):
        out = out.unionByName(store.check_and_add(run))
    if root is None:
        store.drop()
    return out.withColumnRenamed("ident", ident)
