"""Queries of the training-data operators over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.missing import valid_number
from tonearm.llm import abuse, copies, history, mixing, nearest, tokens, topn
from tonearm.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


VECTOR = ["danceability", "energy", "valence", "acousticness"]


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    encoded = table(spark, folder, "data_encoded")
    first = nearest.one_row_per_key(encoded, "track_id", "vec_id", VECTOR)
    usable = first.filter(" and ".join(f"{c} >= 0 and {c} <= 1" for c in VECTOR))
    pairs = nearest.nearest_pairs(usable, "vec_id", VECTOR, k=5)
    return pairs.select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"), F.round("d", 9).alias("distance"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pairs(spark, folder).select("vec_id_a", "vec_id_b")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.repeated_rows(
        table(spark, folder, "data_tracks"), table(spark, folder, "added_artists"),
        "row_id", "added_id", "batch_no", "artist_name", "track_name", "track_id",
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = copies.copy_pairs(table(spark, folder, "data_tracks"), "row_id", "artist_name", "track_name")
    return pairs.select(F.col("first").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_counts(table(spark, folder, "data_tracks"), "row_id", "artist_name", "track_name")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    tracks = table(spark, folder, "data_tracks")
    usable = topn.named_groups(tracks, "artist_name").filter(valid_number(F.col("popularity"), 0, 100))
    return topn.top_n_per_group(usable, "artist_name", F.col("popularity"), "row_id", 10)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select("row_id")


def p5_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).withColumnRenamed("score", "popularity")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"), "doc_id", "text")


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The ids read back as texts."""
    return tokens.texts_of(p6_ids(spark, folder), "doc_id").select("doc_id", F.md5("text").alias("md5"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(
        table(spark, folder, "documents"), table(spark, folder, "mix_targets"),
        "doc_id", "text", "source", ["lang", "agenda_item"],
    )


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p7_met(spark: SparkSession, folder: str) -> DataFrame:
    """Targets, what there is to meet them, and whether the shares reached are within a hundredth of the attainable ones."""
    met = F.abs(F.col("share") - F.col("attainable_share")) <= 0.01
    return p7_shares(spark, folder).select("mix_name", "source", F.round("target_share", 9).alias("target_share"), "max_repeats", met.alias("met"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    phrases = abuse.learn_phrases(documents, table(spark, folder, "content_labels"), "doc_id", "text", "toxic")
    return abuse.abuse_scores(documents, ["doc_id", "source"], "text", phrases)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.abuse_rates(p8_scores(spark, folder), "source")


def p8_read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read of each source; every one has a score of 0 or more."""
    scored = p8_scores(spark, folder)
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= 0).alias("scored"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p5_found": p5_found,
    "p5_ranked": p5_ranked,
    "p6_ids": p6_ids,
    "p6_texts": p6_texts,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_met": p7_met,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
    "p8_read": p8_read,
}
