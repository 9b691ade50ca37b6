"""Facts: merge by key, evict, supersede."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import arr, norm_key, strip
from ..operators.joins import join_null_safe
from ..operators.ranking import top_per_group
from ..operators.sizes import keep

MAX_SOURCES = 20
KEYS = ["scope", "partition", "key"]


def merge_facts(drafts: DataFrame, existing: DataFrame | None = None, max_sources: int | None = MAX_SOURCES) -> DataFrame:
    """Drafts `scope, partition, kind, text, session_id, tags, ts, seq` into facts by key.

    The newest wording and kind win, hits add up, tags join, the last `max_sources` sources
    (all with None) stay in the order in which they first came.  Counting, picking and distinct lists are partial
    aggregates, so one statement repeated everywhere does not pile up in a task.
    """
    d = (drafts.withColumn("text", strip("text")).withColumn("key", norm_key("text"))
         .filter(F.col("key") != "")
         .select(*KEYS, "kind", "text", "ts", F.col("ts").alias("updated_at"), F.col("seq").cast("long").alias("seq"),
                 F.lit(1).cast("long").alias("hits"), F.array("session_id").alias("sources"), arr("tags").alias("tags"),
                 F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("superseded_by"),
                 F.lit(None).cast("timestamp").alias("superseded_at")))
    if existing is not None:
        d = d.unionByName(existing.select(
            *KEYS, "kind", "text", "ts", "updated_at", F.lit(-1).cast("long").alias("seq"), "hits", "sources", "tags",
            "id", "superseded_by", "superseded_at"))
    d = keep(d)
    order = F.struct("updated_at", "seq")
    body = d.groupBy(*KEYS).agg(
        F.max("id").alias("id"), F.min("ts").alias("ts"), F.max("updated_at").alias("updated_at"),
        F.max_by(F.struct("kind", "text"), order).alias("latest"), F.sum("hits").alias("hits"),
        F.max("superseded_by").alias("superseded_by"), F.max("superseded_at").alias("superseded_at"))
    values = d.select(*KEYS, "ts", "seq", F.posexplode(F.concat(
        F.transform("sources", lambda s: F.struct(F.lit("s").alias("what"), s.alias("v"))),
        F.transform("tags", lambda t: F.struct(F.lit("t").alias("what"), t.alias("v"))))).alias("pos", "x"))
    firsts = values.groupBy(*KEYS, "x.what", "x.v").agg(F.min(F.struct("ts", "seq", "pos")).alias("at"))
    sources = firsts.filter(F.col("what") == "s")
    if max_sources is not None:
        sources = top_per_group(sources, KEYS, [F.col("at").desc()], max_sources, "_n", salt_by=["v"]).drop("_n")
    lists = sources.unionByName(firsts.filter(F.col("what") == "t")).groupBy(*KEYS).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == w, F.struct("at", "v")))),
                    lambda s: s["v"]).alias(name) for w, name in (("s", "sources"), ("t", "tags"))])
    new_id = F.concat(F.lit("sm_"), F.substring(F.sha1(F.concat_ws("|", *KEYS)), 1, 32))
    return join_null_safe(body, lists, KEYS, "left").select(
        F.coalesce("id", new_id).alias("id"), "ts", "updated_at", "scope", "partition", F.col("latest.kind").alias("kind"),
        "key", F.col("latest.text").alias("text"), "hits", arr("sources").alias("sources"), arr("tags").alias("tags"),
        "superseded_by", "superseded_at")


def evict_facts(facts: DataFrame, cap: int) -> DataFrame:
    """Most observed first; of equally observed ones the oldest stay."""
    return top_per_group(facts, ["scope", "partition"], [F.col("hits").desc(), F.col("ts"), F.col("id")], cap).drop("rank")


def supersede(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mark `pairs(old_id, new_id[, at])`; both must exist in the same scope and differ in key."""
    p = pairs.withColumn("at", F.col("at") if "at" in pairs.columns else F.lit(None).cast("timestamp"))
    old = facts.select(F.col("id").alias("old_id"), *[F.col(k).alias(f"o_{k}") for k in KEYS])
    new = facts.select(F.col("id").alias("new_id"), *[F.col(k).alias(f"n_{k}") for k in KEYS])
    valid = (p.join(old, "old_id").join(new, "new_id")
             .filter(F.col("o_scope").eqNullSafe(F.col("n_scope")) & F.col("o_partition").eqNullSafe(F.col("n_partition"))
                     & (F.col("o_key") != F.col("n_key"))))
    marks = valid.groupBy(F.col("old_id").alias("id")).agg(
        F.max_by(F.struct("new_id", "at"), F.struct("at", "new_id")).alias("m"))
    return facts.join(marks, "id", "left").select(*[
        F.coalesce("m.new_id", c).alias(c) if c == "superseded_by"
        else F.coalesce("m.at", c).alias(c) if c == "superseded_at" else F.col(c) for c in facts.columns])


def standing_rules(facts: DataFrame, k: int = 4) -> DataFrame:
    """Newest preferences and constraints that still hold."""
    live = facts.filter(F.col("kind").isin("preference", "constraint") & F.col("superseded_by").isNull())
    return live.orderBy(F.col("updated_at").desc(), F.col("id")).limit(k)
