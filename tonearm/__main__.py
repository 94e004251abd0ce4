"""Command line: encode raw tracks, bring landed tracks into the added store, update genres.

    python -m tonearm encode -i data.csv.zip -o encoded.parquet --merge added.csv.zip
    python -m tonearm ingest --tracks landed/tracks --features landed/features --main data.csv.zip --added added.csv.zip
    python -m tonearm update-genre "Artist=genre,Other=genre" --added added.csv.zip

Stores are Parquet folders or, by their ending, CSV in zip archives.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.text import parse_assignments
from tonearm.operators import ingest
from tonearm.plans.encode import encode, summary
from tonearm.schema import RAW, RAW_COLUMNS
from tonearm.session import durable
from tonearm.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tonearm")
    jobs = top.add_subparsers(dest="job", required=True)
    enc = jobs.add_parser("encode")
    enc.add_argument("-i", "--input", default="data.csv.zip")
    enc.add_argument("-o", "--output", default="data_encoded.parquet")
    enc.add_argument("--membership", required=True, help="Parquet of genre, family, weight")
    enc.add_argument("--merge", help="a second store; left out if it is not there")
    enc.add_argument("--min-songs", type=int, default=2)
    enc.add_argument("--max-songs", type=int, default=50)
    enc.add_argument("--keep-remixes", action="store_true")
    ing = jobs.add_parser("ingest")
    ing.add_argument("--tracks", required=True, help="landed track records (JSON pages)")
    ing.add_argument("--features", required=True, help="landed feature records (JSON pages)")
    ing.add_argument("--ids", help="text file of the track ids or links to take; all without it")
    ing.add_argument("--host", default="", help="host of links in --ids")
    ing.add_argument("--limit", type=int, default=15)
    ing.add_argument("--genre")
    for job in (ing, jobs.add_parser("update-genre")):
        job.add_argument("--added", required=True)
        job.add_argument("--dry-run", action="store_true")
    ing.add_argument("--main", required=True)
    mode = ing.add_mutually_exclusive_group()
    mode.add_argument("--update", action="store_const", const="update", dest="mode", default="default")
    mode.add_argument("--override", action="store_const", const="override", dest="mode")
    jobs.choices["update-genre"].add_argument("assignments", help="Artist=genre,Other=genre")
    for job in jobs.choices.values():
        job.add_argument("-v", "--verbose", action="store_true")
    return top


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store's rows with ``ord``, their order; empty if it is not there."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], RAW).withColumn("ord", F.lit(0).cast("bigint"))
    rows = files.read_csv_zip(spark, path) if path.endswith(".zip") else spark.read.parquet(path)
    # an archive is read by one task in the order of its lines; a store is read once
    return durable(rows.select(*RAW_COLUMNS).withColumn("ord", F.monotonically_increasing_id()))


def write_store(df: DataFrame, path: str) -> None:
    rows = df.select(*RAW_COLUMNS)
    files.write_csv_zip(rows, path) if path.endswith(".zip") else files.write_parquet(rows, path)


def run_encode(spark: SparkSession, args: argparse.Namespace) -> int:
    if not files.exists(spark, args.input):
        print(f"no such input: {args.input}", file=sys.stderr)
        return 1
    tracks = read_store(spark, args.input)
    added = read_store(spark, args.merge) if args.merge and files.exists(spark, args.merge) else None
    out = durable(
        encode(
            tracks, spark.read.parquet(args.membership), added, order="ord", added_order="ord",
            min_songs=args.min_songs, max_songs=args.max_songs, keep_remixes=args.keep_remixes,
        )
    )
    files.write_parquet(out.sortWithinPartitions("artist_name", F.desc("popularity")), args.output)
    summary(tracks, out).show(truncate=False)
    if args.verbose:
        out.printSchema()
    return 0


def landed_rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Raw rows of the landed records, each track under its first artist."""
    tracks = files.read_landed(spark, args.tracks, files.TRACK_RECORD)
    if args.ids:
        wanted = files.read_ids(spark, args.ids, args.host).distinct()
        tracks = tracks.withColumn("track_id", ingest.last_segment(F.col("href"))).join(wanted, "track_id", "left_semi").drop("track_id")
    tracks = tracks.withColumns({"artist_name": F.try_element_at("artists", F.lit(1))["name"], "genre": F.lit(args.genre).cast("string")})
    return ingest.build_rows(tracks, files.read_landed(spark, args.features, files.FEATURE_RECORD), args.limit)


def run_ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    added, main = read_store(spark, args.added), read_store(spark, args.main)
    # new rows come after the store's, in a fixed order
    new = durable(landed_rows(spark, args).withColumn("ord", F.xxhash64("artist_name", "track_id")))
    if args.dry_run or args.verbose:
        kept, reasons = ingest.dry_run(added, new, main, args.mode, "ord")
        kept.select("artist_name", "track_name", "track_id", "genre", "popularity").show(truncate=False)
        reasons.orderBy("source_ord", "reason").show(truncate=False)
    if not args.dry_run:
        merged = ingest.merge(added, new, main, args.mode, "ord").filter("reason is null")
        write_store(durable(merged.sort("source_ord", "ord")), args.added)
    return 0


def run_update_genre(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = [(a, g, i) for i, (a, g) in enumerate(parse_assignments(args.assignments).items())]
    updates = spark.createDataFrame(rows, "artist_name string, genre string, n int")
    out = durable(ingest.update_genres(read_store(spark, args.added), updates, "n"))
    changed = out.filter("not (genre <=> old_genre)")
    changed.groupBy("artist_name", "old_genre", "genre").count().show(truncate=False)
    if not args.dry_run and not changed.isEmpty():
        write_store(out.sort("ord"), args.added)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tonearm").getOrCreate()
    return {"encode": run_encode, "ingest": run_ingest, "update-genre": run_update_genre}[args.job](spark, args)


if __name__ == "__main__":
    sys.exit(main())
