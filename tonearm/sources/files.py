"""Readers and writers for the formats tracks arrive in."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.functions.text import id_from_url, strip
from tonearm.schema import RAW
from tonearm.session import shared_dir

#: Anything that yields a table when asked.
Source = Callable[[SparkSession], DataFrame]

_ROWS_PER_CHUNK = 5_000


def parquet(path: str) -> Source:
    return lambda spark: spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def optional(source: Source, path: str, schema: T.StructType = RAW) -> Source:
    """The source, or an empty table of ``schema`` where ``path`` does not exist."""
    return lambda spark: source(spark) if exists(spark, path) else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """CSV with a header, plain or gzip; columns by name. Zip archives go to ``read_csv_zip``."""
    if path.endswith(".zip"):
        raise ValueError("a zip archive read as CSV yields no rows: use read_csv_zip")
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return _typed(raw, schema)


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(raw.columns)
    cast = [F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in schema]
    return raw.select(*[c.alias(f.name) for c, f in zip(cast, schema)])


def _unzipped(header: list[str]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for files in batches:
            for content in files["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as raw:
                            rows: list[list[str | None]] = []
                            reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline=""))
                            for line in reader:
                                rows.append([line.get(c) or None for c in header])
                                if len(rows) >= _ROWS_PER_CHUNK:
                                    yield pd.DataFrame(rows, columns=header)
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=header)

    return run


def read_csv_zip(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """All CSV members of zip archives, one task per archive, streamed in chunks; empty cells are null."""
    header = [f.name for f in schema]
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    files = spark.read.format("binaryFile").load(path).select("content")
    return _typed(files.mapInPandas(_unzipped(header), text), schema)


class _Upload(io.RawIOBase):
    """Bytes to a file of any file system Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def write_csv_zip(df: DataFrame, path: str, member: str = "tracks.csv") -> None:
    """A zip archive with one CSV member, written whole, where all executors can read it.

    One archive is one stream, so rows pass through the driver, never all at once.
    """
    with (
        io.BufferedWriter(_Upload(df.sparkSession, path), 1 << 20) as target,
        zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive,
        archive.open(member, "w") as raw,
    ):
        text = io.TextIOWrapper(raw, "utf-8", newline="")
        out = csv.writer(text)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
        text.flush()


def write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, level: int = 9, partition_by: tuple[str, ...] = ()) -> None:
    """zstd Parquet with plain and dictionary encodings, which Spark reads back vectorised."""
    writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_half_precision(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file whose half-precision columns Spark cannot read, by way of Arrow; they become float.

    Row groups pass through the driver one at a time into the shared folder: an import of old files, not a scan.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq

    def widened(table: pa.Table) -> pa.Table:
        fields = [pa.field(f.name, pa.float32() if pa.types.is_float16(f.type) else f.type) for f in table.schema]
        fields = [f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in fields]
        return table.cast(pa.schema(fields))

    file = pq.ParquetFile(path)
    folder = f"{shared_dir(spark)}/import-{uuid.uuid4().hex}"
    empty = spark.createDataFrame(widened(file.schema_arrow.empty_table()))
    for i in range(file.num_row_groups):
        spark.createDataFrame(widened(file.read_row_group(i))).write.mode("append").parquet(folder)
    return spark.read.schema(empty.schema).parquet(folder) if file.num_row_groups else empty


def read_ids(spark: SparkSession, path: str, host: str) -> DataFrame:
    """``(track_id)`` from a text file of ids or links: trimmed, blank lines and ``#`` comments left out."""
    line = strip(F.col("value"))
    return spark.read.text(path).select(line.alias("line")).filter("line <> '' and not startswith(line, '#')").select(
        id_from_url(F.col("line"), host).alias("track_id")
    )


def arrival_order() -> Column:
    """Where a row of line-based files stands in order of arrival: time and path of its file, place in the file.

    Within a part of a file ids are given in the order of its lines, whatever else its task reads.
    """
    m = F.col("_metadata")
    return F.struct(
        m["file_modification_time"].alias("time"), m["file_path"].alias("path"), m["file_block_start"].alias("part"),
        F.monotonically_increasing_id().alias("line"),
    )


#: Landed records of the track, feature and artist services (fixed format).
TRACK_RECORD = (
    "href string, trackTitle string, popularity double, durationMs double, artists array<struct<id:string,name:string>>"
)
FEATURE_RECORD = (
    "href string, danceability double, energy double, key double, loudness double, mode double, speechiness double, "
    "acousticness double, instrumentalness double, liveness double, valence double, tempo double, time_signature double"
)
ARTIST_RECORD = "name string, genres array<string>"


def write_landed(df: DataFrame, path: str, record: str, pages: str | None = None) -> None:
    """Lands the record's fields of ``df`` as JSON pages, a page for each value of ``pages`` or, without it, for each row."""
    fields = F.struct(*[F.col(f.split(" ", 1)[0]) for f in record.split(", ")])
    if pages is None:
        out = df.select(F.array(fields).alias("content"))
    else:
        out = df.groupBy(pages).agg(F.collect_list(fields).alias("content")).select("content")
    out.write.mode("overwrite").json(path)


def read_landed(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of landed JSON pages, ``{"content": [...]}`` one page per line, with ``ord``, their order of arrival."""
    page = "content array<struct<" + ", ".join(":".join(f.split(" ", 1)) for f in record.split(", ")) + ">>"
    pages = spark.read.schema(page).json(path).withColumn("page", arrival_order())
    rows = pages.select("page", F.posexplode("content").alias("pos", "r"))
    return rows.select("r.*", F.struct("page", "pos").alias("ord"))


def first_resolving(candidates: DataFrame, resolved: DataFrame, group: str, order: str, key: str, value: str) -> DataFrame:
    """``(group, value)``: each group's first candidate, by ``order``, for which ``resolved`` knows a value."""
    hits = candidates.join(resolved.filter(F.col(value).isNotNull()), key)
    return hits.groupBy(group).agg(F.min_by(value, order).alias(value))


def artist_pages(tracks: DataFrame, artist: str, order: str, limit: int, page: int = 50) -> DataFrame:
    """The records that fetching whole pages brings of each artist, in ``order``: enough for its most popular ``limit``."""
    place = F.row_number().over(W.partitionBy(artist).orderBy(order))
    return tracks.withColumn("place", place).filter(F.col("place") <= pages_to_fetch(limit, page)).drop("place")


def genres_of_artists(artists: DataFrame) -> DataFrame:
    """``(artist_name, genre, style)`` of landed artist records: the first two genres named, the earliest record winning."""
    named = artists.filter("name is not null and size(genres) > 0")
    first = named.groupBy(F.col("name").alias("artist_name")).agg(F.min_by("genres", "ord").alias("g"))
    return first.select("artist_name", F.try_element_at("g", F.lit(1)).alias("genre"), F.try_element_at("g", F.lit(2)).alias("style"))


def in_batches(ordinal: Column, size: int = 50) -> Column:
    """The number of the request batch an item falls into."""
    return F.floor((ordinal - 1) / size).cast("int")


def pages_to_fetch(limit: int, page: int = 50) -> int:
    """Tracks to fetch so that the most popular ``limit`` are among them: three times as many, in whole pages."""
    return (limit * 3 + page - 1) // page * page
