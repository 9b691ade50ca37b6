"""Library statistics, topics, metrics, retrieval evaluation, text audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import wordlists as wl
from ..functions.redaction import redact, sanitize
from ..functions.text import normalize_domain
from ..operators.leak import shared_runs


def library_stats(cards: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One conditional aggregation over the cards, optionally with subtotals (`rollup`)."""
    archived = F.col("archived_at").isNotNull()
    verified = F.col("status").isin("validated", "canonical") & ~archived
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("cards"), F.count_if(verified).alias("verified"),
        F.count_if((F.col("status") == "draft") & ~archived).alias("drafts"), F.count_if(archived).alias("archived"),
        F.count_if(z("successes") > 0).alias("adopted"), F.count_if(z("retrieve_count") > 0).alias("retrieved"),
        F.count_if((F.col("status") == "draft") & (z("retrieve_count") == 0)).alias("cold_drafts"),
        F.count_if(z("referenced") > 0).alias("referenced_cards"), F.sum(z("referenced")).alias("reference_events"),
        F.round(100 * F.count_if(z("successes") > 0) / F.count(F.lit(1)), 1).alias("adoption_rate")]
    return (cards.rollup(*by) if by else cards.groupBy()).agg(*aggs)


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """`layer, rows, superseded, projects` over the layer tables."""
    out = None
    for name, df in layers.items():
        sup = F.count_if(F.col("superseded_by").isNotNull()) if "superseded_by" in df.columns else F.lit(0)
        scopes = F.count_distinct("partition") if "partition" in df.columns else F.lit(0)
        row = df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("rows"), sup.cast("long").alias("superseded"),
                     scopes.cast("long").alias("partitions"))
        out = row if out is None else out.unionByName(row)
    return out


def failure_stats(failures: DataFrame) -> DataFrame:
    return failures.agg(
        F.count_if(F.col("status") != "deprecated").alias("active"), F.count_if(F.col("status") == "deprecated").alias("resolved"),
        F.sum(F.coalesce("prevented", F.lit(0)) if "prevented" in failures.columns else F.lit(0)).alias("prevented"),
        F.sum("relapses").alias("relapses"))


def topics(cards: DataFrame, k: int = 24) -> DataFrame:
    """Known domains by number of cards."""
    named = cards.select(normalize_domain("domain").alias("domain")).filter(F.col("domain").isNotNull())
    return named.groupBy("domain").agg(F.count(F.lit(1)).alias("cards")).orderBy(F.col("cards").desc(), "domain").limit(k)


def fold_metrics(base: DataFrame, runs: DataFrame, backoff_after: int = 5) -> DataFrame:
    """Reflection counters after a batch of runs (`ts, created, merged, called`).

    The empty streak is the number of called runs since the last one that created
    something; it needs that run's time only.
    """
    last = runs.filter("called").agg(
        F.max(F.when(F.col("created") > 0, F.col("ts"))).alias("last_new")).select("last_new")
    after = runs.filter("called").filter(
        F.col("ts") > F.coalesce(last.scalar(), F.lit("0001-01-01").cast("timestamp"))).agg(F.count(F.lit(1)).alias("streak"))
    sums = runs.agg(F.sum(F.when(F.col("called"), 1).otherwise(0)).alias("reflections"),
                    F.sum(F.when(F.col("called"), 0).otherwise(1)).alias("skipped"),
                    F.sum(F.when(F.col("called"), F.col("created")).otherwise(0)).alias("new_cards"),
                    F.sum(F.when(F.col("called"), F.col("merged")).otherwise(0)).alias("duplicate_cards"))
    streak = after.scalar()
    got_new = last.scalar().isNotNull()
    total = sums.withColumn("streak", streak).withColumn("got_new", got_new)
    b = base.select(*[F.coalesce(c, F.lit(0)).alias(f"b_{c}") for c in
                      ("reflections", "skipped", "new_cards", "duplicate_cards", "empty_streak", "injections",
                       "gate_kept", "gate_dropped", "advisories")])
    j = total.withColumn("b", b.select(F.struct("*")).scalar())
    run = F.when(F.col("got_new"), F.col("streak")).otherwise(F.col("b.b_empty_streak") + F.col("streak"))
    keep = ["injections", "gate_kept", "gate_dropped", "advisories"]
    return j.select(*[(F.col(f"b.b_{c}") + F.coalesce(c, F.lit(0))).alias(c)
                      for c in ("reflections", "skipped", "new_cards", "duplicate_cards")],
                    run.alias("empty_streak"), (run >= backoff_after).alias("backoff"),
                    *[F.col(f"b.b_{c}").alias(c) for c in keep])


# ---- evaluation -----------------------------------------------------------------

def evaluate(hits: DataFrame, labels: DataFrame, k: int = 3, groups: DataFrame | None = None) -> DataFrame:
    """hit@1, hit@k, mean reciprocal rank, recall (and group coverage) over labelled queries."""
    found = labels.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    per = found.groupBy("query_id").agg(F.min("rank").alias("best"), F.count("rank").alias("found"),
                                        F.count(F.lit(1)).alias("expected"))
    out = per.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("best") == 1).alias("hit1"),
        F.count_if(F.col("best") <= k).alias("hitk"),
        (F.sum(F.coalesce(1 / F.col("best"), F.lit(0.0))) / F.count(F.lit(1))).alias("mrr"),
        (F.sum("found") / F.sum("expected")).alias("recall"))
    if groups is not None:
        covered = hits.join(groups, "id").groupBy("query_id").agg(F.count_distinct("group").alias("covered"))
        out = out.withColumn("groups_covered", covered.agg(F.min("covered")).scalar())
    return out


# ---- audit ----------------------------------------------------------------------

def redaction_audit(docs: DataFrame, by: list[str], rules=wl.CREDENTIAL_RULES) -> DataFrame:
    """Matches per rule (on the raw text) and group: `by..., rule, hits, docs`."""
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n")) for name, p in rules])
    flat = docs.select(*by, F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c"))
    return flat.groupBy(*by, "c.rule").agg(F.sum("c.n").alias("hits"), F.count(F.lit(1)).alias("docs"))


def audit_text(docs: DataFrame) -> DataFrame:
    """Cleaned text and what was done to it."""
    clean = sanitize(redact(F.col("text")))
    return docs.withColumn("clean", clean).withColumn("changed", F.col("clean") != F.col("text")).withColumn(
        "redactions", F.regexp_count("clean", F.lit(r"\[REDACTED:")))


def decontaminate(docs: DataFrame, sources: DataFrame, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """Split `docs(id, text)` into clean ones and those that share a run with a source."""
    bad = shared_runs(docs, sources, n).select("id").distinct()
    return docs.join(bad, "id", "left_anti"), docs.join(bad, "id", "left_semi")

