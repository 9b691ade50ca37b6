"""Search jobs: general, cards, facets, context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cards as cf, wordlists as wl
from ..functions.text import (empty, arr, clip_head, compact_entry, compact_rule, one, squeeze, symbols_in_text,
                              tokens)
from ..functions.redaction import sanitize
from ..functions.versions import applies_to, compatible
from ..operators.index import MAX_FACETS, FieldedIndex, Index, build_index, fielded_scores, query_terms, recency_factor, score_pairs, with_shared
from ..operators.probes import grams, rarest, word_grams
from ..operators.ranking import top_per_group
from ..operators.sizes import hint, keep, texts_are_small
from ..operators.topk import MAX_PAIRS, SLACK, reachable_pairs, rows_to_join

EPISODE_WEIGHT = 0.85


# ---- relevance gate -----------------------------------------------------------

def gate_totals(terms: DataFrame) -> DataFrame:
    """Per query: how many terms it has and how many say something."""
    own = terms.filter(F.col("mask").bitwiseAND(1) != 0)
    return own.groupBy("query_id").agg(
        F.count("term").alias("n_terms"),
        F.sum((~F.col("is_generic")).cast("int")).alias("n_informative"))


def gate_kept(min_matched: int = 2, min_score: float = 0.0, score: Column | None = None) -> Column:
    """Pass rule over `matched, strong, n_informative` of a (query, document) row."""
    need = F.when(F.col("n_informative") <= 2, 1).otherwise(F.least(F.lit(min_matched), F.col("n_informative")))
    ok = (F.col("matched") > 0) & ((F.col("matched") >= need) | (F.col("strong") >= 1))
    if min_matched <= 0:
        ok = F.lit(True)
    if min_score > 0 and score is not None:
        ok = ok & (score >= min_score)
    return ok


def relevance_gate(pairs: DataFrame, terms: DataFrame, min_matched: int = 2, min_score: float = 0.0,
                   small: bool = False) -> DataFrame:
    """Decision rows: the counts, and `kept`."""
    # A query of which only a facet has words has no totals; it still keeps its rows.
    with_totals = (pairs.join(hint(gate_totals(terms), small), "query_id", "left")
                   .fillna(0, ["n_terms", "n_informative"]))
    score = F.col("score") if "score" in pairs.columns else None
    return with_totals.withColumn("kept", gate_kept(min_matched, min_score, score))


# ---- corpus -------------------------------------------------------------------

def search_docs(episodes: DataFrame | None = None, facts: DataFrame | None = None,
                cards: DataFrame | None = None) -> DataFrame:
    """Union of the layers in one search schema."""
    parts = []
    if episodes is not None:
        parts.append(episodes.select(
            F.lit("episodic").alias("layer"), "id", "ts", cf.episode_text().alias("text"), "session_id", "scope"))
    if facts is not None:
        parts.append(facts.select(
            F.lit("semantic").alias("layer"), "id", F.col("updated_at").alias("ts"), cf.fact_text().alias("text"),
            "kind", F.col("superseded_by").isNotNull().alias("superseded"), "scope"))
    if cards is not None:
        parts.append(card_docs(cards))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def card_docs(cards: DataFrame) -> DataFrame:
    syms = cf.symbols("subject", "api")
    return cards.select(
        F.lit("technique").alias("layer"), "id", F.col("updated_at").alias("ts"), cf.card_text().alias("text"),
        "status", "partition", "stack", "tags", "domain", "applies_to", syms.alias("symbols"),
        F.col("archived_at").isNotNull().alias("archived"), "successes", "failures", "referenced",
        F.size(F.coalesce("evidence", F.array())).alias("evidence_count"), "scope")


def _with(docs: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in docs.columns else F.lit(None).cast(kind)


def _strong(docs: DataFrame) -> Column:
    return F.array_distinct(tokens(cf.strong_text(
        _with(docs, "domain", "string"), _with(docs, "tags", "array<string>"), _with(docs, "symbols", "array<string>"))))


def _layer_weight(docs: DataFrame) -> Column:
    return F.when(_with(docs, "layer", "string") == "episodic", EPISODE_WEIGHT).otherwise(1.0)


def _order(docs: DataFrame) -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("id")]


def _indexable(docs: DataFrame, boost: Column) -> DataFrame:
    has_meta = any(c in docs.columns for c in ("domain", "tags", "symbols"))
    extra = [_strong(docs).alias("strong")] if has_meta else []
    return docs.select("id", "text", _with(docs, "ts", "timestamp").alias("ts"), boost.alias("boost"), *extra)


def _asked(terms: DataFrame, small: bool) -> DataFrame | None:
    """The words to index: those asked for, or all where so many are asked for that to leave
    out the others would shuffle every token."""
    return terms.select("term").distinct() if small else None


def _as_now(now) -> Column:
    return F.lit(now).cast("timestamp") if not isinstance(now, Column) else now


def _newest(docs: DataFrame, k: int, score: Column, order: list[Column]) -> Column:
    """The k best rows for a query without words, as one array value (k is small)."""
    rows = docs.select("id", _with(docs, "ts", "timestamp").alias("ts"), score.alias("score"))
    best = rows.orderBy(*order).limit(k)
    return best.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("neg"), (-F.coalesce(F.unix_micros("ts"), F.lit(0))).alias("age"),
        F.col("id"))))).scalar()


#: A part of the documents this small tells a score that the k best of all reach at least.
PART = 16


def _best(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", small: bool = False) -> DataFrame:
    """The k best rows (`*keys, id, score`) of each key, `order` starting with the score.

    For a small query batch the rows lie by document, and all of them would be sorted where
    they lie. The k-th best score among a `PART`-th of the documents comes first; no lower one
    can be among the k best, so only some `PART` x k rows of each key are sorted at all.
    """
    if not small:
        return top_per_group(rows, keys, order, k, rank)
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(PART)) == 0)
    kth = top_per_group(some.select(*keys, "id", "score", "ts"), keys, order, k, "_rank", salts=1).filter(F.col("_rank") == k)
    bounds = kth.select(*keys, (F.col("score") * (1 - SLACK) - SLACK).alias("_bound"))
    near = rows.join(hint(bounds, True), keys, "left").filter(F.col("score") >= F.coalesce("_bound", "score"))
    return top_per_group(near.drop("_bound"), keys, order, k, rank, salts=1)


# ---- jobs ---------------------------------------------------------------------

def search(queries: DataFrame, docs: DataFrame, k: int = 5, gate: int | None = None, now=None,
           recency_weight: float = 0.15, min_score: float = 0.0, stop: list[str] = wl.GATE_STOP_WORDS,
           empty: str = "allow", decisions: bool = False, index: Index | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Top k documents per query (`query_id, text`).

    Up to `max_pairs` (query, posting) rows are scored outright; beyond that, only documents
    that can reach rank k are (see `operators.topk`), with the same result.

    `docs(id, text[, ts, layer, domain, tags, symbols])`.  `gate` is the number of matched
    informative terms asked for (None: no gate).  A query without any word returns the
    newest documents with score 0, unless `empty='deny'`.  With `decisions=True` the result
    is every scored pair with its gate counts and verdict.
    """
    prepared = queries.select("query_id", F.array("text").alias("facets"))
    terms = query_terms(prepared, stop)
    small = texts_are_small(queries)
    if index is None:
        index = build_index(_indexable(docs, _layer_weight(docs)), vocabulary=_asked(terms, small), small_vocabulary=small).keep()
    fresh = F.lit(1.0) if now is None else recency_factor(_as_now(now), F.col("ts"), recency_weight)

    def judged(pairs: DataFrame) -> DataFrame:
        scored = pairs.withColumn("score", F.get("scores", F.lit(0)) * fresh * F.col("boost")).filter(F.col("score") > 0)
        return scored if gate is None and not decisions else relevance_gate(scored, terms, gate or 0, min_score, small)

    if decisions:
        return judged(with_shared(terms, index, small)).select(
            "query_id", "id", "score", "matched", "strong", "generic", "shared", "kept")
    passed = (lambda pairs: judged(pairs).filter("kept")) if gate is not None else judged
    bounded = rows_to_join(terms, index) > max_pairs
    if not bounded:
        pairs = passed(score_pairs(terms, index, 1, small_terms=small))
    else:
        pairs = passed(reachable_pairs(terms, index, k, F.col("boost") * fresh, passed if gate is not None else None, small_terms=small))
    rows, order = pairs.select("query_id", "id", "score", "ts"), [F.col("score").desc(), *_order(docs)]
    # Reachable pairs were held against a bound already.
    hits = top_per_group(rows, ["query_id"], order, k) if bounded else _best(rows, ["query_id"], order, k, small=small)
    out = hits.select("query_id", "id", "score", "rank")
    blank = queries.filter(F.size(tokens(F.col("text"))) == 0)
    if empty == "deny" or blank.isEmpty():
        return out
    newest = _newest(docs, k, F.lit(0.0), _order(docs))
    rows = (blank.select("query_id", F.posexplode(newest).alias("pos", "d"))
            .select("query_id", F.col("d.id").alias("id"), F.lit(0.0).alias("score"),
                    (F.col("pos") + 1).alias("rank")))
    return out.unionByName(rows)


def search_fielded(queries: DataFrame, cards: DataFrame | FieldedIndex, weights: dict[str, float], k: int = 5) -> DataFrame:
    """Top k by field-weighted BM25, of documents or of a stored index of the same fields."""
    terms = query_terms(queries.select("query_id", F.array("text").alias("facets")))
    small = texts_are_small(queries)
    scored = fielded_scores(terms, cards, weights, small_terms=small)
    return top_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def candidates(docs: DataFrame, drafts: bool = False, archived: bool = False, partition: str | None = None,
               stack: Column | None = None, files: Column | None = None) -> DataFrame:
    """Card documents that may be searched at all; corpus statistics count only these."""
    fits = F.col("status") != "deprecated"
    if not drafts:
        fits = fits & F.col("status").isin("validated", "canonical")
    if not archived and "archived" in docs.columns:
        fits = fits & ~F.coalesce("archived", F.lit(False))
    if partition is not None:
        fits = fits & (F.col("partition").isNull() | (F.col("partition") == partition))
    if stack is not None and "stack" in docs.columns:
        fits = fits & compatible(F.col("stack"), stack)
    if files is not None and "applies_to" in docs.columns:
        fits = fits & applies_to(F.col("applies_to"), files, stack)
    return docs.filter(fits)


def _static_weight(docs: DataFrame) -> Column:
    referenced = F.coalesce(_with(docs, "referenced", "long"), F.lit(0))
    evidence = F.coalesce(_with(docs, "evidence_count", "int"), F.lit(0))
    return (cf.confidence(_with(docs, "successes", "long"), _with(docs, "failures", "long"))
            * F.when(evidence > 0, 1.1).otherwise(0.6)
            * (1 + F.least(referenced, F.lit(5)) * 0.04))


def _facet_pairs(queries: DataFrame, docs: DataFrame, n_facets: int, boost: Column, now, recency_weight: float,
                 gate: int | None, min_score: float, stop: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    terms = query_terms(queries.select("query_id", "facets"), stop)
    small = texts_are_small(queries, max_chars=4_000_000 // MAX_FACETS)
    index = build_index(_indexable(docs, boost), vocabulary=_asked(terms, small), small_vocabulary=small).keep()
    pairs = score_pairs(terms, index, n_facets, small_terms=small)
    fresh = F.lit(1.0) if now is None else recency_factor(_as_now(now), F.col("ts"), recency_weight)
    pairs = pairs.withColumn("weight", F.col("boost") * fresh)
    pairs = relevance_gate(pairs, terms, gate or 0, 0.0, small)
    return pairs, terms, small


def _card_bonus(pairs: DataFrame, queries: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """Multiply in what depends on both sides: exact symbols and the domain by name."""
    if "symbols" not in docs.columns and "domain" not in docs.columns:
        return pairs
    q = queries.select("query_id", F.col("facets").alias("_facets"),
                       (F.col("symbols") if "symbols" in queries.columns else empty()).alias("_qsym"))
    d = docs.select("id", _with(docs, "symbols", "array<string>").alias("_dsym"),
                    F.lower(_with(docs, "domain", "string")).alias("_domain"))
    both = pairs.join(hint(q, small), "query_id").join(d, "id")
    bonus = F.when(F.coalesce(F.arrays_overlap(arr("_dsym"), arr("_qsym")), F.lit(False)), 1.6).otherwise(1.0)
    scores = F.transform(
        "scores", lambda s, i: s * F.col("weight") * bonus * F.when(
            F.coalesce(F.contains(F.lower(F.get("_facets", i)), F.col("_domain")), F.lit(False)), 1.2).otherwise(1.0))
    return both.withColumn("scores", scores).withColumn("weight", F.lit(1.0)).drop("_facets", "_qsym", "_dsym", "_domain")


def search_cards(queries: DataFrame, docs: DataFrame, k: int = 5, drafts: bool = False, archived: bool = False,
                 partition: str | None = None, stack: Column | None = None, gate: int | None = None, now=None,
                 recency_weight: float = 0.05, min_score: float = 0.0,
                 stop: list[str] = wl.GATE_STOP_WORDS, empty: str = "allow") -> DataFrame:
    """Confidence-weighted card search over `card_docs` rows; queries without a word get the
    most trusted cards, unless `empty='deny'`."""
    pool = candidates(docs, drafts, archived, partition, stack)
    single = queries.withColumn("facets", F.array("text"))
    hits = _search_facets(single, pool, k, 1, _static_weight(pool), gate, now, recency_weight, min_score, stop, True, empty)
    return hits.select("query_id", "id", "score", "rank")


def _search_facets(queries: DataFrame, docs: DataFrame, k: int, n_facets: int, boost: Column, gate: int | None, now,
                   recency_weight: float, min_score: float, stop: list[str], as_cards: bool, empty: str = "allow",
                   exclude: DataFrame | None = None) -> DataFrame:
    pairs, _terms, small = _facet_pairs(queries, docs, n_facets, boost, now, recency_weight, gate, min_score, stop)
    if gate is not None:
        pairs = pairs.filter("kept")
    if exclude is not None:
        pairs = pairs.join(exclude, ["query_id", "id"], "left_anti")
    if as_cards:
        pairs = _card_bonus(pairs, queries, docs, small)
    ranked = pairs.select("query_id", "id", "ts", "weight", F.posexplode("scores").alias("facet_no", "raw"))
    ranked = ranked.withColumn("score", F.col("raw") * F.col("weight")).filter(F.col("score") > 0)
    if min_score > 0:
        ranked = ranked.filter(F.col("score") >= min_score)
    depth = k if n_facets == 1 else max(k, 10)
    per_facet = _best(ranked.select("query_id", "facet_no", "id", "score", "ts"), ["query_id", "facet_no"],
                      [F.col("score").desc(), *_order(docs)], depth, "facet_rank", small)
    merged = merge_round_robin(per_facet, k)
    # Queries without a word: everything counts the same, so the weight decides.
    blank = queries.filter(F.size(tokens(F.get("facets", F.lit(0)))) == 0).select("query_id")
    if empty == "deny" or blank.isEmpty():
        return merged
    merged = keep(merged)  # short lists, read here and in the result
    spare = 0
    if exclude is not None:
        most = exclude.join(blank, "query_id", "left_semi").groupBy("query_id").count().agg(F.max("count")).first()[0]
        spare = most or 0
    newest = _newest(docs, k + spare, boost if as_cards else F.lit(0.0),
                     ([F.col("score").desc()] if as_cards else []) + _order(docs))
    rows = (blank.select("query_id", F.posexplode(newest).alias("pos", "d"))
            .select("query_id", F.col("d.id").alias("id"), (-F.col("d.neg")).alias("score"), "pos"))
    # Only rows that no facet found: extras may have words where the query has none.
    rows = rows.join(merged.select("query_id").distinct(), "query_id", "left_anti")
    if exclude is not None:
        rows = rows.join(exclude, ["query_id", "id"], "left_anti")
    rows = top_per_group(rows, ["query_id"], [F.col("pos")], k, salts=1).drop("pos")
    return merged.unionByName(rows, allowMissingColumns=True)


def merge_round_robin(hits: DataFrame, k: int) -> DataFrame:
    """Interleave the ranked lists `query_id, facet_no, facet_rank, id[, score]`.

    Taking first places of all lists, then second places, and so on, with repeats left
    out, is the order by (rank, list) of each document's first appearance.
    """
    firsts = hits.groupBy("query_id", "id").agg(
        F.min(F.struct("facet_rank", "facet_no", *(["score"] if "score" in hits.columns else []))).alias("f"))
    flat = firsts.select("query_id", "id", "f.*")
    return top_per_group(flat, ["query_id"], [F.col("facet_rank"), F.col("facet_no"), F.col("id")], k)


# ---- facets -------------------------------------------------------------------

def clause_facets(text: Column) -> Column:
    """The clauses of a task description."""
    return F.split(F.regexp_replace(text, wl.CLAUSE_WORDS, "\n"), wl.CLAUSE_MARKS)


def topic_vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct topic words of the corpus: domains, tags, last parts of symbols."""
    tails = F.filter(F.transform(arr(_with(docs, "symbols", "array<string>")),
                                 lambda s: F.regexp_extract(s, r"([^.#]*)$", 1)), lambda t: F.length(t) >= 3)
    words = F.concat(one(_with(docs, "domain", "string")), arr(_with(docs, "tags", "array<string>")), tails)
    pos = docs.select("id", F.posexplode(words).alias("pos", "word"))
    return (pos.filter(F.length("word") >= 2).groupBy("word")
            .agg(F.min(F.struct("id", "pos")).alias("first_seen")))


def facets(queries: DataFrame, docs: DataFrame, cap: int = MAX_FACETS) -> DataFrame:
    """`query_id, ..., facets ARRAY<STRING>`: the query, its clauses, topic words it names
    and parts of the paths in `extras`, distinct, at most `cap`."""
    vocab = topic_vocabulary(docs).withColumn("low", F.lower("word"))
    # Substring search as an equi-join: of a word's grams the one that is in the fewest queries.
    q = queries.select("query_id", F.lower("text").alias("low_text"))
    probes = keep(q.select("query_id", F.explode(grams(F.col("low_text"))).alias("probe")))
    counts = probes.groupBy("probe").agg(F.count(F.lit(1)).alias("n"))
    wanted = rarest(vocab.withColumn("grams", word_grams(F.col("low"))), ["word", "low", "first_seen"], "grams", counts)
    named = (probes.join(wanted, "probe").join(q, "query_id")
             .filter(F.contains("low_text", "low")).select("query_id", "word", "first_seen"))
    firsts = top_per_group(named, ["query_id"], [F.col("first_seen"), F.col("word")], cap, salt_by=["word"])
    listed = firsts.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("_named"))
    extras = arr("extras") if "extras" in queries.columns else empty()
    parts = F.filter(F.flatten(F.transform(extras, lambda e: F.split(e, r"[\\/]+"))), lambda p: F.length(p) >= 4)
    rest = F.concat(clause_facets(F.col("text")), arr("_named"), parts)
    clean = F.filter(F.transform(rest, squeeze), lambda f: F.length(f) >= 2)
    return (queries.join(listed, "query_id", "left")
            .withColumn("facets", F.slice(F.array_distinct(F.concat(F.array("text"), clean)), 1, cap))
            .drop("_named"))


def search_facets(queries: DataFrame, docs: DataFrame, k: int = 5, gate: int | None = None, now=None,
                  recency_weight: float | None = None, min_score: float = 0.0, as_cards: bool = False,
                  stop: list[str] = wl.GATE_STOP_WORDS, drafts: bool = False, archived: bool = False,
                  partition: str | None = None, stack: Column | None = None,
                  files: Column | None = None, empty: str = "allow", exclude: DataFrame | None = None) -> DataFrame:
    """Multi-topic search: rank per facet, merge the lists in turn.

    Relevance is always judged by the words of the original query. `exclude(query_id, id)`
    are documents that a query must not get; the ranking closes the gap.
    """
    if as_cards:
        pool = candidates(docs, drafts, archived, partition, stack, files)
        boost, weight = _static_weight(pool), 0.05
    else:
        pool, boost, weight = docs, _layer_weight(docs), 0.15
    with_facets = facets(queries, pool)
    hits = _search_facets(with_facets, pool, k, MAX_FACETS, boost, gate, now,
                          weight if recency_weight is None else recency_weight, min_score, stop, as_cards, empty, exclude)
    return hits.select("query_id", "id", "score", "rank")


def search_with_drafts(queries: DataFrame, docs: DataFrame, k: int = 5, scan: int = 20, **options) -> DataFrame:
    """Verified cards, or drafts too where the best draft beats the best verified card."""
    wide = keep(search_facets(queries, docs, max(k, scan), as_cards=True, drafts=True, **options))  # short lists, read twice
    narrow = search_facets(queries, docs, k, as_cards=True, **options)
    status = docs.select("id", "status")
    firsts = (wide.join(status, "id").groupBy("query_id").agg(
        F.min_by("score", F.when(F.col("status") == "draft", F.col("rank"))).alias("draft"),
        F.min_by("score", F.when(F.col("status") != "draft", F.col("rank"))).alias("verified")))
    use = firsts.select("query_id", (F.col("draft").isNotNull() & (
        F.col("verified").isNull() | (F.col("draft") > F.col("verified")))).alias("fallback"))
    a = wide.filter(F.col("rank") <= k).join(use, "query_id").filter("fallback")
    b = narrow.join(use, "query_id", "left").filter(~F.coalesce("fallback", F.lit(False))).withColumn(
        "fallback", F.lit(False))
    cols = ["query_id", "id", "score", "rank", "fallback"]
    return a.select(cols).unionByName(b.select(cols))


# ---- near duplicates and context packs ------------------------------------------

def drop_near_duplicates(hits: DataFrame, ratio: float = 0.6, head: int = 80) -> DataFrame:
    """Drop a hit whose first `head` characters equal those of an earlier kept hit of the
    same query and whose words are mostly inside that hit.

    `hits(query_id, rank, id, text[, standing])`; a result list is short by design (top k),
    so one query's hits are compared inside one row.
    """
    standing = F.col("standing") if "standing" in hits.columns else F.lit(False)
    item = F.struct("rank", F.col("id").alias("id"), standing.alias("standing"),
                    F.substring(compact_entry(F.col("text")), 1, head).alias("head"),
                    F.array_distinct(tokens(F.col("text"))).alias("toks"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.slice("items", 1, 0)

    def step(kept: Column, h: Column) -> Column:
        twin = F.exists(kept, lambda o: (o["head"] == h["head"]) & (
            F.size(F.array_intersect(h["toks"], o["toks"])) >= F.lit(ratio) * F.size(h["toks"]))
            & (F.size(h["toks"]) > 0))
        return F.when(twin & ~h["standing"], kept).otherwise(F.concat(kept, F.array(h)))

    kept = lists.select("query_id", F.explode(F.aggregate("items", empty, step)).alias("h"))
    ids = kept.select("query_id", F.col("h.id").alias("id"))
    return hits.join(ids, ["query_id", "id"], "left_semi")


def entry_label(layer: Column, kind: Column) -> Column:
    safe = F.when(kind.isin(wl.FACT_KINDS), kind).otherwise("fact")
    return (F.when(layer == "semantic", F.concat(F.lit("long-term "), safe))
            .when(layer == "episodic", "past session").when(layer == "technique", "technique").otherwise(layer))


def context_pack(queries: DataFrame, docs: DataFrame, rules: int = 4, k: int = 5, chars: int = 4000,
                 gate: int | None = 2, now=None, short_rules: bool = False, shown: DataFrame | None = None,
                 stack: Column | None = None, files: Column | None = None, empty: str = "allow") -> DataFrame:
    """One text per query: standing rules, then relevant hits, within a character budget.

    Superseded facts and cards that are not trusted, archived or out of their `applies_to`
    scope never enter. A query gets neither the episode of its own session nor the cards that
    `shown(query_id, id)` names; both are left out before the hits are ranked.
    """
    live = docs.filter(~F.coalesce(_with(docs, "superseded", "boolean"), F.lit(False)))
    card = F.coalesce(_with(docs, "layer", "string") == "technique", F.lit(False))
    if "status" in docs.columns:
        live = live.filter(~card).unionByName(candidates(live.filter(card), stack=stack, files=files))
    is_rule = (_with(docs, "layer", "string") == "semantic") & F.col("kind").isin("preference", "constraint")
    top_rules = live.filter(is_rule).orderBy(F.col("ts").desc(), F.col("id")).limit(rules)
    pool = live.join(F.broadcast(top_rules.select("id")), "id", "left_anti")
    exclude = None if shown is None else shown.select("query_id", "id")
    if "session_id" in queries.columns and "session_id" in docs.columns:
        own = (pool.filter(F.col("layer") == "episodic").select("session_id", "id")
               .join(queries.select("query_id", "session_id"), "session_id").select("query_id", "id"))
        exclude = own if exclude is None else exclude.union(own)
    hits = search_facets(queries, pool, k, gate=gate, now=now, empty=empty, exclude=exclude)
    full = hits.join(pool.select("id", "layer", "kind", "text"), "id")
    full = full.select("query_id", "id", (F.col("rank") + rules).alias("rank"), "layer", "kind", "text",
                       F.lit(False).alias("standing"))
    rule_list = top_rules.agg(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros("ts")).alias("age"), "id", "layer", "kind", "text")))).scalar()
    always = (queries.select("query_id", F.posexplode(rule_list).alias("pos", "r"))
              .select("query_id", F.col("r.id").alias("id"), (F.col("pos") + 1).alias("rank"),
                      F.col("r.layer").alias("layer"), F.col("r.kind").alias("kind"), F.col("r.text").alias("text"),
                      F.lit(True).alias("standing")))
    kept = drop_near_duplicates(keep(always.unionByName(full)))  # short lists, read twice
    lists = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "id", "layer", "kind", "standing", "text"))).alias("items"))

    def line(h: Column, i: Column) -> Column:
        short = compact_rule(h["text"]) if short_rules else compact_entry(h["text"])
        body = F.when(h["standing"], short).otherwise(compact_entry(h["text"]))
        return F.concat((i + 1).cast("string"), F.lit(". ("), entry_label(h["layer"], h["kind"]), F.lit(") "),
                        sanitize(body, neutral_braces=True))

    packed = F.array_join(F.transform("items", line), "\n")
    return lists.select("query_id", F.size("items").alias("entries"),
                        F.transform("items", lambda h: h["id"]).alias("ids"),
                        clip_head(packed, chars).alias("body"))


def context_terms(turns: DataFrame, queries: DataFrame, last: int = 3) -> DataFrame:
    """Search extras of the newest turn: its files and tools, those of the turns before it
    where the user's words overlap the query, and the symbols of the query."""
    recent = top_per_group(turns.select("session_id", "turn", "user", "tools", "files"), ["session_id"],
                           [F.col("turn").desc()], last, "back", salt_by=["turn"])
    joined = recent.join(queries.select("query_id", "session_id", "text"), "session_id")
    same = F.arrays_overlap(tokens(F.coalesce("user", F.lit(""))), tokens(F.col("text")))
    used = joined.filter((F.col("back") == 1) | F.coalesce(same, F.lit(False)))
    lists = used.groupBy("query_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", F.concat(arr("files"), arr("tools")).alias("x")))),
        lambda s: s["x"])).alias("seen"))
    return queries.join(lists, "query_id", "left").select(
        "query_id", F.array_distinct(F.concat(arr("seen"), symbols_in_text(F.col("text")))).alias("extras"))
