"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bestfit, clusters, codes, langid, licences, media, mixing, neardup, packing, quality, sharding, tokenfiles, urls
from .common import table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text licences and notice lines of all documents."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of at most 64 MiB of text."""
    return sharding.assign(table(spark, sf_dir, "documents"))


SMALL_SHARD = 1 << 18


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 256 KiB, so that small test tables split several times too."""
    return sharding.assign(table(spark, sf_dir, "documents"), SMALL_SHARD)


RULES = [urls.Rule("block", "com/en/"), urls.Rule("allow", "example.com/en/7"), urls.Rule("allow", "net/de/"),
         urls.Rule("block", "example.net/de/8"), urls.Rule("block", "org/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with digests of their ids."""
    pieces = packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances to the nearest language and the verdict for every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as chunked media, read back and described."""
    return media.read(media.write(table(spark, sf_dir, "documents")))


#: Shares of the mixed tokens by domain.
MIX = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """`doc_id, domain` of the labelled documents."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(
        F.col("quality") == 1, "clean").alias("domain"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, fitted rate and copies of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), MIX)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as Arrow sequence files, read them back, digest each document."""
    docs = table(spark, sf_dir, "documents")
    files = tokenfiles.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfiles.read(files, docs.schema["doc_id"].dataType.simpleString()).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the held-out fold teaches nothing."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles are linked at 0.8 or more."""
    return neardup.link_documents(table(spark, sf_dir, "documents"), size=2, percent=80)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of exact clustering of all embeddings around 16 centroids."""
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: eight parts, 16 entries each, six rounds."""
    return codes.encode(table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as can be, with digests of their ids."""
    pieces = bestfit.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return bestfit.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_licence_scan": (op1_licence_scan, licences.oracle()),
    "op2_extendible_sharding": (op2_extendible_sharding, sharding.oracle(sharding.LIMIT)),
    "sharding_small_limit": (sharding_small_limit, sharding.oracle(SMALL_SHARD)),
    "op3_url_filter": (op3_url_filter, None),
    "op4_packing": (op4_packing, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_media_chunks": (op6_media_chunks, None),
    "op7_soft_mixing": (op7_soft_mixing, None),
    "op8_token_files": (op8_token_files, None),
    "op9_language_id": (op9_language_id, None),
    "op10_minhash_near_duplicates": (op10_minhash_near_duplicates, None),
    "op11_centroid_clusters": (op11_centroid_clusters, clusters.oracle()),
    "op12_vector_codes": (op12_vector_codes, codes.oracle()),
    "op13_best_fit_packing": (op13_best_fit_packing, None),
}
