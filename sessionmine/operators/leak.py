"""Verbatim overlap: runs of eight words that a text shares with source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import word_sequence
from .sizes import hint, is_small, keep

RUN = 8


def _positions(words: Column, n: int) -> Column:
    count = F.size(words) - n + 1
    return F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))


def gram_hashes(words: Column, n: int = RUN) -> Column:
    return F.transform(_positions(words, n), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))


def word_grams(words: Column, n: int = RUN) -> Column:
    return F.transform(_positions(words, n), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def shared_runs(candidates: DataFrame, sources: DataFrame, n: int = RUN,
                paired: bool = False) -> DataFrame:
    """`id, run` for each distinct run of `n` words that also occurs in the sources.

    `paired=True` compares only rows with the same `source_id`.  Hashes find the
    candidate texts (12 bytes per word cross the network), then the matching texts only
    are cut again and compared word for word.
    """
    on = ["source_id"] if paired else []
    cand = candidates.select("id", *on, word_sequence(F.col("text")).alias("words"))
    src = sources.select(*on, word_sequence(F.col("text")).alias("words"))
    src = keep(src)
    src_hashes = src.select(*on, F.explode(gram_hashes(F.col("words"), n)).alias("h")).distinct()
    small = is_small(src_hashes)
    suspects = (cand.select("id", *on, F.explode(F.array_distinct(gram_hashes(F.col("words"), n))).alias("h"))
                .join(hint(src_hashes, small), [*on, "h"], "left_semi")
                .select("id", *on).distinct())
    src_grams = src.select(*on, F.explode(F.array_distinct(word_grams(F.col("words"), n))).alias("run")).distinct()
    # Cut words again only for the texts that may match.
    again = candidates.join(suspects, ["id", *on], "left_semi").select(
        "id", *on, word_sequence(F.col("text")).alias("words"))
    return (again.select("id", *on, F.explode(F.array_distinct(word_grams(F.col("words"), n))).alias("run"))
            .join(hint(src_grams, small), [*on, "run"], "left_semi"))


def leak_check(candidates: DataFrame, sources: DataFrame, n: int = RUN, paired: bool = False) -> DataFrame:
    """Each candidate with its verbatim runs and leftover identifiers.

    `candidates(id, text[, source_id, identifiers])`.  A text's own runs are bounded by
    its length, so they fit one row.
    """
    from ..functions.redaction import identifier_leaks

    runs = shared_runs(candidates, sources, n, paired).groupBy("id").agg(
        F.array_sort(F.collect_set("run")).alias("verbatim_runs"))
    ids = F.col("identifiers") if "identifiers" in candidates.columns else F.array().cast("array<string>")
    return (candidates.select("id", identifier_leaks(F.col("text"), ids).alias("identifier_hits"))
            .join(runs, "id", "left")
            .select("id", F.coalesce("verbatim_runs", F.array().cast("array<string>")).alias("verbatim_runs"),
                    "identifier_hits")
            .withColumn("clean", (F.size("verbatim_runs") == 0) & (F.size("identifier_hits") == 0)))
