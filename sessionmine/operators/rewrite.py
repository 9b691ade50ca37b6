"""Row-level changes as table rewrites: patch, delete, id lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def patch_by_id(base: DataFrame, patches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Non-null values of `patches` replace those of `base`; unknown ids are ignored.

    Columns named in `keep` (counters, stamps) never change.
    """
    fields = [c for c in patches.columns if c != "id" and c in base.columns and c not in keep]
    p = patches.select("id", *[F.col(c).alias(f"_p_{c}") for c in fields])
    out = base.join(p, "id", "left")
    return out.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                        for c in base.columns])


def delete_ids(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id").distinct(), "id", "left_anti")


def wipe_scope(base: DataFrame, scope: str, partition: str | None = None, confirm: bool = False) -> DataFrame:
    """Everything but one scope (or one partition of it); must be confirmed."""
    if not confirm:
        raise ValueError("wiping a scope needs confirm=True")
    doomed = F.col("scope") == scope
    if partition is not None:
        doomed = doomed & (F.col("partition") == partition)
    return base.filter(~F.coalesce(doomed, F.lit(False)))


def resolve_ids(wanted: DataFrame, records: DataFrame, prefix: str = "tq_", min_chars: int = 4) -> DataFrame:
    """Resolve `wanted(needle)` to ids: exact first, else a unique prefix.

    `status` is ok, too_short, unknown or ambiguous.  The join runs on the first
    `min_chars` characters; matches are counted, not listed, so a popular prefix is safe.
    """
    bare = lambda c: F.regexp_replace(F.trim(c), f"^{prefix}", "")
    w = wanted.select("needle").distinct().withColumn("b", bare(F.col("needle")))
    r = records.select("id").distinct().withColumn("rb", bare(F.col("id")))
    exact = w.join(r.select(F.col("id").alias("exact_id")), F.trim("needle") == F.col("exact_id"))
    exact = exact.select("needle", "exact_id")
    by_prefix = (w.filter(F.length("b") >= min_chars)
                 .withColumn("k", F.substring("b", 1, min_chars))
                 .join(r.withColumn("k", F.substring("rb", 1, min_chars)), "k")
                 .filter(F.startswith("rb", "b"))
                 .groupBy("needle").agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("prefix_id")))
    out = w.join(exact, "needle", "left").join(by_prefix, "needle", "left")
    status = (F.when(F.col("exact_id").isNotNull(), "ok")
              .when(F.length("b") < min_chars, "too_short")
              .when(F.col("matches") == 1, "ok")
              .when(F.col("matches").isNull(), "unknown").otherwise("ambiguous"))
    return out.withColumn("status", status).select(
        "needle", F.when(F.col("status") == "ok", F.coalesce("exact_id", "prefix_id")).alias("id"),
        "status", F.coalesce("matches", F.lit(0)).alias("matches"))
