"""Appending landed tracks to the added store as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonearm.operators.ingest import removal_reasons
from tonearm.schema import RAW, RAW_COLUMNS
from tonearm.sources.files import arrival_order, exists

#: Parts of the store's indexes, by id and by artist; a micro-batch reads only the parts its keys fall into.
BUCKETS = 64
_STORED = T.StructType([*RAW, T.StructField("batch", T.IntegerType())])
_TITLES = "artist_name string, track_name string, batch int, bucket int"
_IDS = "track_id string, artist_name string, batch int, bucket int"
_REPLACED = "artist_name string, batch int"
_MAIN = "key string, kind string, bucket int"


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _touched(df: DataFrame) -> list[int]:
    """At most ``BUCKETS`` numbers."""
    return [r[0] for r in df.select("bucket").distinct().collect()]


def _alive(rows: DataFrame, spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """Rows whose artist no later batch replaced; with ``before``, as the store was ahead of that batch."""
    replaced = _table(spark, f"{store}.index/replaced", _REPLACED)
    if before is not None:
        rows, replaced = rows.filter(F.col("batch") < before), replaced.filter(F.col("batch") < before)
    last = replaced.groupBy("artist_name").agg(F.max("batch").alias("last"))
    return rows.join(last, "artist_name", "left").filter("last is null or batch >= last").drop("last")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The rows of the store ``follow`` keeps, without those of replaced artists."""
    return _alive(_table(spark, store, _STORED), spark, store).select(*RAW_COLUMNS)


def _index_main(spark: SparkSession, main: str, store: str) -> None:
    """Ids and artists of the main store by bucket, written once for all micro-batches."""
    path = f"{store}.index/main"
    if exists(spark, path):
        return
    rows = spark.read.parquet(main)
    keys = [rows.select(F.col(c).alias("key"), F.lit(c).alias("kind")).filter("key is not null").distinct() for c in ("track_id", "artist_name")]
    _index(keys[0].unionByName(keys[1]), "key", path)


def _index(keys: DataFrame, key: str, path: str) -> None:
    keys.withColumn("bucket", _bucket(F.col(key))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def follow(
    spark: SparkSession, landing: str, store: str, main: str, checkpoint: str, mode: str = "update"
) -> StreamingQuery:
    """Reads raw-track JSON files as they land and merges each micro-batch into ``store``.

    The store is a folder of Parquet runs, one per micro-batch and named after it,
    so a batch that is run again replaces its own output; ``read_store`` reads it.
    Rows are in order of arrival: batch, time and path of their file, place in it.
    New rows that repeat the main or the added store, or an earlier new row, are
    left out by the rules of ``merge``: ``default`` also skips artists either store
    has, ``override`` replaces what the added store has of the new rows' artists.
    A batch reads only the parts of the store and of the indexes beside it
    (``<store>.index``) that its artists and ids fall into. Processes what has landed
    and stops; start it again for what lands later.
    """
    if mode not in ("default", "update", "override"):
        raise ValueError(f"unknown mode: {mode}")
    _index_main(spark, main, store)

    def add(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("arrived", arrival_order()).withColumn("bucket", _bucket(F.col("artist_name"))).withColumn("id_bucket", _bucket(F.col("track_id"))).persist()
        own = _table(spark, f"{store}.index/titles", _TITLES).filter(F.col("bucket").isin(_touched(new)))
        ids = _table(spark, f"{store}.index/ids", _IDS).filter(F.col("bucket").isin(_touched(new.select(F.col("id_bucket").alias("bucket")))))
        old, ids = _alive(own, spark, store, number), _alive(ids, spark, store, number)
        keys = _table(spark, f"{store}.index/main", _MAIN)
        artists = new.select("artist_name").filter("artist_name is not null").distinct()
        old = old.join(artists, "artist_name", "left_semi")
        if mode == "override":
            ids = ids.join(artists, "artist_name", "left_anti")
            old = old.filter(F.lit(False))
            artists.write.mode("overwrite").parquet(f"{store}.index/replaced/batch={number}")
        fresh = new.join(keys.filter("kind = 'track_id'").select(F.col("key").alias("track_id")), "track_id", "left_anti")
        stored = ids.select(F.col("track_id").alias("stored_id")).distinct()
        fresh = fresh.join(stored, F.col("track_id").eqNullSafe(F.col("stored_id")), "left_anti")  # missing ids are equal
        if mode == "default":
            known = keys.filter("kind = 'artist_name'").select(F.col("key").alias("artist_name"))
            fresh = fresh.join(known.unionByName(old.select("artist_name")).distinct(), "artist_name", "left_anti")
        first = F.lit(None).cast(new.schema["arrived"].dataType)
        both = old.select("artist_name", "track_name", first.alias("arrived"), F.lit(0).alias("source_ord")).unionByName(
            fresh.select(*RAW_COLUMNS, "arrived", F.lit(1).alias("source_ord")), allowMissingColumns=True
        )
        # titles of the store have no id here, and must not count as repetitions of rows without one
        both = both.withColumn("track_id", F.when(F.col("source_ord") == 0, F.concat_ws("/", F.lit("stored"), "artist_name", "track_name")).otherwise(F.col("track_id")))
        nothing = spark.createDataFrame([], "track_id string")
        kept = removal_reasons(both, nothing, "arrived").filter("reason is null and source_ord = 1").select(*RAW_COLUMNS).persist()
        kept.write.mode("overwrite").parquet(f"{store}/batch={number}")
        _index(kept.select("track_id", "artist_name"), "track_id", f"{store}.index/ids/batch={number}")
        _index(kept.filter("artist_name is not null").select("artist_name", "track_name"), "artist_name", f"{store}.index/titles/batch={number}")
        kept.unpersist()
        new.unpersist()

    stream = spark.readStream.schema(RAW).json(landing).select("*", "_metadata")
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()
