"""URL filter with rules and character models (operator 3); DataFrame operations only.

Rules decide first. Every other URL is scored by two Markov models over characters, one of
the URLs that the rules allow and one of those they block. Contexts have 0 to `ORDER`
characters; each order's probability is smoothed towards the next shorter one, so the log
ratio of a character is a sum over the orders: what its n-gram adds where it was seen, what
leaving the context costs where only the context was seen. A URL is allowed when the mean
over its characters reaches a threshold that is calibrated on the decided URLs.

The two tables have a row for each n-gram and context of the decided URLs and grow with
them. They are broadcast after a look at their sizes; larger ones are joined with the
distinct n-grams of the URLs to score.

Defined results: a null or empty URL has an empty host and path and is blocked. Without any
decided URL all others are allowed; with one class only, they get its verdict. Repeated rows
count each time and get a row each. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import sizes
from .common import stage

ORDER = 4
STRENGTH = 5.0
BINS = 100
_END = "\n"


@dataclass(frozen=True)
class Rule:
    """`pattern` is a host and the start of a path, as `net/` or `example.com/en/7`."""

    verdict: str
    pattern: str


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without `://`."""
    rest = F.when(url.contains("://"), F.substring_index(F.substr(url, F.instr(url, F.lit("://")) + 3), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substr(rest, F.length(host) + 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule for a host, its subdomains and the start of a path; null for none."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        h, slash, p = rule.pattern.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule.pattern)).otherwise(out)
    return out


def _grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per character and order: columns `keep`, `k`, context `h` and character `c`.
    The end counts as a character."""
    text = F.concat(F.lower("url"), F.lit(_END))
    at = rows.select(*keep, text.alias("s"), F.explode(F.sequence(F.lit(1), F.length(text))).alias("i"))
    at = at.select(*keep, "s", "i", F.explode(F.sequence(F.lit(0), F.least(F.lit(ORDER), F.col("i") - 1))).alias("k"))
    return at.select(*keep, "k", F.substr("s", F.col("i") - F.col("k"), F.col("k")).alias("h"), F.substr("s", F.col("i"), F.lit(1)).alias("c"))


def learn(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`g, d` for n-grams and `h, e` for contexts, from `decided(url, verdict)`. The length of
    the text tells the order."""
    good, bad = (F.col("verdict") == v for v in ("allow", "block"))
    counts = stage(_grams(decided, ["verdict"]).groupBy("k", "h", "c").agg(
        F.sum(good.cast("long")).alias("a"), F.sum(bad.cast("long")).alias("b")))
    contexts = stage(counts.groupBy("k", "h").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))
    size = F.lit(float(counts.filter("k = 0").count() + 1))
    lower, grams = None, None
    for k in range(ORDER + 1):
        rows = counts.filter(F.col("k") == k).join(contexts.filter(F.col("k") == k).drop("k"), "h")
        if lower is None:
            rows = rows.withColumn("pa", 1 / size).withColumn("pb", 1 / size)
        else:
            rows = rows.join(lower, [F.substr("h", F.lit(2)) == lower.h0, F.col("c") == lower.c0])
        p = {x: (F.col(x) + STRENGTH * F.col(f"p{x}")) / (F.col(f"t{x}") + STRENGTH) for x in "ab"}
        rows = stage(rows.select("k", "h", "c", p["a"].alias("qa"), p["b"].alias("qb"),
                                 (F.log(p["a"] / p["b"]) - F.log(F.col("pa") / F.col("pb"))).alias("d")))
        grams = rows if grams is None else grams.union(rows)
        lower = rows.select(F.col("h").alias("h0"), F.col("c").alias("c0"), F.col("qa").alias("pa"), F.col("qb").alias("pb"))
    leave = F.log((F.col("tb") + STRENGTH) / (F.col("ta") + STRENGTH))
    return stage(grams.select(F.concat("h", "c").alias("g"), "d")), stage(contexts.select("h", leave.alias("e")))


def score(rows: DataFrame, model: tuple[DataFrame, DataFrame], keep: list[str], max_rows: int = sizes.MAX_BROADCAST_ROWS) -> DataFrame:
    """Columns `keep` and `score`, the mean log ratio per character (more is better)."""
    grams, contexts = model
    each = _grams(rows, keep).select(*keep, "k", "h", F.concat("h", "c").alias("g"))
    if sizes.is_small(grams, max_rows) and sizes.is_small(contexts, max_rows):
        each = each.join(F.broadcast(grams), "g", "left").join(F.broadcast(contexts), "h", "left")
        each = each.withColumn("v", F.coalesce("d", "e", F.lit(0.0)))
    else:
        asked = each.select("g", "h").distinct().join(grams, "g", "left").join(contexts, "h", "left")
        values = stage(asked.select("g", F.coalesce("d", "e").alias("v")).filter("v IS NOT NULL"))
        each = each.join(values, "g", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return each.groupBy(*keep).agg(F.round(F.sum("v") / F.sum((F.col("k") == 0).cast("int")), 6).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score with the smallest sum of both error rates, from a histogram of the decided
    URLs (`verdict, score`); the middle, where several are equal."""
    cell = F.floor(F.greatest(F.least(F.col("score"), F.lit(10.0)), F.lit(-10.0)) * BINS)
    rows = scored.groupBy(cell.alias("cell")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"),
                                                  F.sum((F.col("verdict") == "block").cast("long")).alias("b")).collect()
    a, b = max(sum(r["a"] for r in rows), 1), max(sum(r["b"] for r in rows), 1)
    lost, passed, errors = 0.0, 1.0, {}
    cells = {r["cell"]: r for r in rows}
    for cell_no in range(min(cells), max(cells) + 2):
        errors[cell_no] = round(lost + passed, 12)
        if cell_no in cells:
            lost, passed = lost + cells[cell_no]["a"] / a, passed - cells[cell_no]["b"] / b
    best = [c for c, x in errors.items() if x == min(errors.values())]
    return (best[0] + best[-1]) / 2 / BINS


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """`page_id, host, path, rule, verdict, score` for each row of `pages(page_id, url)`; only
    URLs without a rule have a score."""
    host, path = parts(F.col("url").cast("string"))
    rows = stage(pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
                 .withColumn("host", host).withColumn("path", path).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)))
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.pattern, F.lit(r.verdict)).otherwise(by_rule)
    rows = rows.withColumn("_fixed", F.coalesce(by_rule, F.when(F.col("url") == "", F.lit("block"))))
    decided = rows.filter(F.col("rule").isNotNull()).select("_row", "url", by_rule.alias("verdict"))
    classes = sorted(r["verdict"] for r in decided.select("verdict").distinct().collect())
    if len(classes) < 2:
        verdict = F.coalesce("_fixed", F.lit(classes[0] if classes else "allow"))
        return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))
    model = learn(decided)
    limit = threshold(score(decided, model, ["_row", "verdict"]))
    scored = score(rows.filter("_fixed IS NULL"), model, ["_row"])
    found = F.coalesce("_fixed", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return rows.join(scored, "_row", "left").select("page_id", "host", "path", "rule", found.alias("verdict"), "score")
