"""Mixing with soft membership (operator 7); DataFrame operations only.

A classifier over hashed words is learned from a labelled table and gives every document a
posterior over the domains. Rates per document are then fitted by projected gradient steps
so that the expected tokens of each domain come close to their targets: least squares over
the domains' relative errors, rates kept between 0 and `max_rate`.

The classifier uses all words. A word's weight in a domain is its log odds against all other
domains, taken back the less it is sure. A document has, per domain, the sum of its weights
over the root of their number and the largest of them; a logistic regression on these makes
probabilities, fitted on one in `FOLDS` of the labelled texts, which taught no weights. Equal
texts of a domain teach once.

All rates start at 1 and a step changes a rate by a product of its posterior with the
errors. So documents with equal posteriors have equal rates, and the steps run over the
table of distinct posteriors (rounded to `DIGITS`) with their token sums. They end when no
domain moves by `TOLERANCE` of its tokens, after `MAX_STEPS` at the latest.

Defined results: a null or empty text has no tokens; its posteriors are those of a text
without telling words. Rows whose label
is null teach nothing; a document with two labels teaches both; without any labelled row the
posteriors are equal. An empty table gives an empty result. Repeated rows and repeated or
null ids are rows of their own: each has a row number. Further columns pass through
`filter_documents`.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

BUCKETS = 1 << 16
PRIOR = 50.0
SURE = 3.0
FOLDS = 4
RIDGE = 1.0
ROUNDS = 12
DIGITS = 3
MAX_STEPS = 100
TOLERANCE = 1e-4
_SPLIT = r"[\s.,;:!?\"'()]+"


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, columns `keep`, number of tokens and distinct hashed words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), _SPLIT), "")
    return (docs.select(F.monotonically_increasing_id().alias("_row"), *keep, words.alias("_words"))
            .select("_row", *keep, F.size("_words").cast("long").alias("n_tokens"),
                    F.array_distinct(F.transform("_words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))).alias("buckets"),
                    F.xxhash64("_words").alias("same")))


def teachers(rows: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """`_row, domain, fold`: one row for each different text of a domain."""
    # Labels grow with the corpus, so they are never broadcast, at no size.
    known = rows.select("doc_id", "_row", "same").join(
        labelled.filter(F.col("domain").isin(domains)).select("doc_id", "domain").hint("merge"), "doc_id")
    return known.groupBy("domain", "same").agg(F.min("_row").alias("_row")).select(
        "_row", "domain", F.pmod(F.xxhash64("same", F.lit("fold")), F.lit(FOLDS)).alias("fold"))


def learn(rows: DataFrame, taught: DataFrame, domains: list[str]) -> DataFrame:
    """`bucket, w ARRAY<DOUBLE>` (at most `BUCKETS` rows): log odds of a hashed word in each
    domain against the rest.

    `PRIOR` average documents are added to both rates. A word that is z standard deviations
    away from the rest keeps z^2 / (z^2 + `SURE`^2) of its log odds.
    """
    known = rows.select("_row", "buckets").join(taught.filter("fold > 0").hint("merge"), "_row")
    seen = stage(known.select("domain", F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket"))
                 .groupBy("bucket", "domain").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["domain"]: r["n"] for r in seen.filter("bucket = -1").collect()}
    total = sum(sizes.values())
    n = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).cast("double") for d in domains]
    counted = seen.filter("bucket >= 0").groupBy("bucket").agg(F.array(*n).alias("n"), F.sum("n").cast("double").alias("all"))
    q = F.col("all") / float(max(total, 1))

    def weight(i: int, size: float) -> Column:
        inside = (F.col("n")[i] + PRIOR * q) / (size + PRIOR)
        outside = (F.col("all") - F.col("n")[i] + PRIOR * q) / (total - size + PRIOR)
        away = F.pow(F.col("n")[i] - size * q, 2) / (size * q * (1 - q) + 1)
        return F.round(F.log(inside / outside) * away / (away + SURE ** 2), 6)

    return stage(counted.select("bucket", F.array(*[weight(i, float(sizes.get(d, 0))) for i, d in enumerate(domains)]).alias("w")))


def score(rows: DataFrame, weights: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """`_row, n_tokens`, columns `keep` and `x`: per domain the scaled sum and the largest
    weight. The weights have at most `BUCKETS` rows, hence the broadcast."""
    each = rows.select("_row", *keep, "n_tokens", F.sqrt(F.size("buckets") + F.lit(1)).alias("root"),
                       F.explode_outer("buckets").alias("bucket"))
    found = each.join(F.broadcast(weights), "bucket", "left").groupBy("_row", *keep, "n_tokens", "root").agg(
        *[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)],
        *[F.coalesce(F.max(F.col("w")[i]), F.lit(0.0)).alias(f"m{i}") for i in range(k)])
    return found.select("_row", *keep, "n_tokens", F.array(
        *[F.array(F.round(F.col(f"s{i}") / F.col("root"), 6), F.round(f"m{i}", 6)) for i in range(k)]).alias("x"))


def _inputs(i: int) -> list[Column]:
    """What the regression of domain `i` sees of a row."""
    return [F.lit(1.0), F.col("x")[i][0], F.col("x")[i][1], F.log1p("n_tokens") / 10]


def _chance(i: int, beta: list[float]) -> Column:
    z = sum((b * x for b, x in zip(beta, _inputs(i))), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """The solution of a small, positive definite system."""
    rows = [list(r) + [v] for r, v in zip(a, b)]
    for i, pivot in enumerate(rows):
        for below in rows[i + 1:]:
            f = below[i] / pivot[i]
            for j in range(i, len(pivot)):
                below[j] -= f * pivot[j]
    x = [0.0] * len(b)
    for i in reversed(range(len(b))):
        x[i] = (rows[i][-1] - sum(rows[i][j] * x[j] for j in range(i + 1, len(b)))) / rows[i][i]
    return x


def calibrate(scored: DataFrame, taught: DataFrame, domains: list[str]) -> list[list[float]] | None:
    """Coefficients of one logistic regression per domain, by Newton steps with a ridge on the
    labelled texts that taught no weights; each step is one aggregation. None without any."""
    held = stage(scored.select("_row", "n_tokens", "x").join(taught.filter("fold = 0").select("_row", "domain").hint("merge"), "_row"))
    sizes = {r["domain"]: r["count"] for r in held.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    if not total:
        return None
    width = len(_inputs(0))
    beta = [[log((sizes.get(d, 0) + 0.5) / (total - sizes.get(d, 0) + 0.5))] + [0.0] * (width - 1) for d in domains]
    pairs = [(a, b) for a in range(width) for b in range(a, width)]
    for _ in range(ROUNDS):
        sums = []
        for i, d in enumerate(domains):
            x, p = _inputs(i), _chance(i, beta[i])
            sums += [F.sum(((F.col("domain") == d).cast("double") - p) * v) for v in x]
            sums += [F.sum(p * (1 - p) * x[a] * x[b]) for a, b in pairs]
        row, moved = iter(held.agg(*[s.alias(f"v{j}") for j, s in enumerate(sums)]).first()), 0.0
        for i in range(len(domains)):
            pull = [0.0] + [RIDGE * b for b in beta[i][1:]]
            gradient = [next(row) - r for r in pull]
            curve = [[0.0] * width for _ in range(width)]
            for a, b in pairs:
                curve[a][b] = curve[b][a] = next(row)
            for a in range(width):
                curve[a][a] += RIDGE if a else 1e-3
            step = [max(-3.0, min(3.0, v)) for v in _solve(curve, gradient)]
            moved = max(moved, max(map(abs, step)))
            beta[i] = [b + v for b, v in zip(beta[i], step)]
        if moved < 1e-4:
            break
    return [[round(b, 5) for b in bs] for bs in beta]


def posteriors(scored: DataFrame, betas: list[list[float]] | None, k: int) -> DataFrame:
    """`scored` with `p ARRAY<DOUBLE>` instead of `x`."""
    chances = [F.lit(1.0)] * k if betas is None else [_chance(i, b) for i, b in enumerate(betas)]
    each = F.array(*chances)
    mass = reduce(lambda a, b: a + b, [F.col("_e")[i] for i in range(k)])
    return scored.withColumn("_e", each).withColumn(
        "p", F.array(*[F.round(F.col("_e")[i] / mass, DIGITS) for i in range(k)])).drop("x", "_e")


def classify(rows: DataFrame, labelled: DataFrame, domains: list[str], keep: list[str]) -> DataFrame:
    """`_row, n_tokens, p` and columns `keep` of all rows."""
    taught = stage(teachers(rows, labelled, domains))
    scored = stage(score(rows, learn(rows, taught, domains), len(domains), keep))
    return posteriors(scored, calibrate(scored, taught, domains), len(domains))


def _rate(steps: list[list[float]], max_rate: float) -> Column:
    """The rate after all steps, as one fold over a literal: the plan stays the same size."""
    start = F.lit(1.0)
    if not steps:
        return start
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])

    def one(rate: Column, step: Column) -> Column:
        move = sum((F.col("p")[i] * step[i] for i in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(max_rate)), rate - move))

    return F.aggregate(taken, start, one)


def fit_rates(rows: DataFrame, targets: dict[str, float], max_rate: float, anchor: str | None) -> list[list[float]]:
    """The gradient steps that lead to the rates (see `_rate`).

    `targets` are shares of the mixed tokens. Their total is the corpus's, or, with an
    `anchor`, such that this domain's target is what the corpus has of it. In units of a
    domain's tokens the error matrix has row sums of 1, so a step of length 1 never
    overshoots.
    """
    k = len(targets)
    groups = stage(rows.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("t")))

    def totals(steps: list[list[float]]) -> list[float]:
        rate = _rate(steps, max_rate)
        row = groups.agg(*[F.coalesce(F.sum(F.col("t") * F.col("p")[i] * rate), F.lit(0.0)) for i in range(k)]).first()
        return [float(x) for x in row]

    have = totals([])
    shares = [w / sum(targets.values()) for w in targets.values()]
    a = list(targets).index(anchor) if anchor else None
    total = have[a] / shares[a] if anchor and shares[a] else sum(have)
    steps: list[list[float]] = []
    now = have
    for _ in range(MAX_STEPS):
        error = [(x - total * s) / h if h else 0.0 for x, s, h in zip(now, shares, have)]
        new = totals(steps + [error])
        steps.append(error)
        moved = max(abs(x - y) / max(h, 1.0) for x, y, h in zip(new, now, have))
        now = new
        if moved < TOLERANCE:
            break
    return steps


def _copies(rate: Column, seed: int) -> Column:
    """The rate's whole part, and one more with the chance of its fraction; the draw depends
    on the id and the row's text length only."""
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("n_tokens"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_rate: float = 4.0,
        anchor: str | None = None, seed: int = 7) -> DataFrame:
    """`doc_id, n_tokens, p_<domain>..., rate, copies` for each row of `docs(doc_id, text)`;
    `labelled(doc_id, domain)` teaches, `targets` maps each domain to its weight."""
    rows = stage(features(docs, ["doc_id"]))
    scored = classify(rows, labelled, list(targets), ["doc_id"])
    rate = _rate(fit_rates(scored, targets, max_rate, anchor), max_rate)
    return scored.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(targets)],
                         F.round(rate, 6).alias("rate"), _copies(rate, seed).alias("copies"))


def filter_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str | None = None,
                     seed: int = 7) -> DataFrame:
    """The rows of `docs` that the mix keeps, with all columns. Rates end at 1, so nothing is
    repeated."""
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)])
    numbered = stage(inner.withColumn("_row_id", F.monotonically_increasing_id()))
    rows = stage(features(numbered, ["doc_id", "_row_id"]))
    scored = classify(rows, labelled, list(targets), ["doc_id", "_row_id"])
    rate = _rate(fit_rates(scored, targets, 1.0, anchor), 1.0)
    kept = scored.filter(_copies(rate, seed) > 0).select("_row_id")
    return numbered.join(kept, "_row_id", "left_semi").drop("_row_id").toDF(*names)
