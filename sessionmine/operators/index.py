"""Term index and BM25 scores for batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import wordlists as wl
from ..functions.text import empty, tokens
from .sizes import hint, keep

K1, B = 1.2, 0.75
MAX_FACETS = 8
BUCKETS = 256
MAX_BITS = 1024


@dataclass
class Index:
    """`postings(id, term, tf, strong, len, ts, boost)`.

    The term '' stands for the document itself (one row each), so that empty documents
    count in the totals and one aggregation yields document counts and lengths.
    """

    postings: DataFrame

    @property
    def term_stats(self) -> DataFrame:
        return self.postings.groupBy("term").agg(
            F.sum(F.when((F.col("tf") > 0) | (F.col("term") == ""), 1).otherwise(0)).alias("df"),
            F.sum("len").alias("total_len"))

    def keep(self) -> "Index":
        """Keep the postings, which both the statistics and the scores read; lost parts
        are computed again from the documents."""
        return Index(keep(self.postings))

    def write(self, path: str) -> None:
        """Store the postings by term hash, so that a query batch reads its buckets only."""
        _write_postings(self.postings, path)

    @staticmethod
    def read(spark: SparkSession, path: str, terms: DataFrame | None = None) -> "Index":
        """The stored postings; with `terms(term)`, only those of these terms and the
        documents' own rows, from the buckets (at most `BUCKETS` numbers) that hold them."""
        return Index(_read_postings(spark, path, terms))


@dataclass
class FieldedIndex:
    """`postings(id, term, tfs, len)`: a frequency for each of the fields, in their order.

    Weights are given with the query, so one stored index serves all of them. The term ''
    stands for the document itself.
    """

    postings: DataFrame

    def write(self, path: str) -> None:
        """Store the postings by term hash."""
        _write_postings(self.postings, path)

    @staticmethod
    def read(spark: SparkSession, path: str, terms: DataFrame | None = None) -> "FieldedIndex":
        """As for `Index`."""
        return FieldedIndex(_read_postings(spark, path, terms))


def _write_postings(postings: DataFrame, path: str) -> None:
    (postings.withColumn("bucket", _bucket("term"))
     .repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16)))
     .sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path))


def _read_postings(spark: SparkSession, path: str, terms: DataFrame | None) -> DataFrame:
    postings = spark.read.parquet(path)
    if terms is None:
        return postings.drop("bucket")
    wanted = terms.select("term").union(spark.range(1).select(F.lit("").alias("term"))).distinct()
    buckets = [r["b"] for r in wanted.select(_bucket("term").alias("b")).distinct().collect()]
    return postings.filter(F.col("bucket").isin(buckets)).drop("bucket").join(wanted, "term", "left_semi")


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, tokenizer: Callable[[Column], Column] = tokens,
                vocabulary: DataFrame | None = None, small_vocabulary: bool = False) -> Index:
    """Postings of `docs(id, text[, ts, boost, strong])`.

    `vocabulary(term)` keeps only terms some query asks for (the '' rows stay). The documents
    are dealt out by id before they are cut into words, so the words are counted and scores
    summed up where the document lies: neither tokens nor (query, posting) rows are shuffled.
    """
    have = set(docs.columns)
    rows = docs.filter(F.col("id").isNotNull()).repartition("id").select(
        "id",
        F.coalesce(tokenizer(F.col("text")), empty()).alias("_tokens"),
        (F.array_distinct(F.coalesce(F.col("strong"), empty())) if "strong" in have else empty()).alias("_strong"),
        (F.col("ts").cast("timestamp") if "ts" in have else F.lit(None).cast("timestamp")).alias("ts"),
        (F.col("boost") if "boost" in have else F.lit(1.0)).alias("boost"))
    # The length is taken in its own step: next to the explode it would drag the whole
    # token array along with every exploded row.
    rows = rows.select("id", F.size("_tokens").alias("len"), "ts", "boost", "_tokens", "_strong")
    if "strong" in have:
        # Occurrences, then the strong terms (which do not count as occurrences), then ''.
        def item(t: Column, n: int, s: int) -> Column:
            return F.struct(t.alias("t"), F.lit(n).alias("n"), F.lit(s).alias("s"))

        items = F.concat(F.transform(F.col("_tokens"), lambda t: item(t, 1, 0)),
                         F.transform(F.col("_strong"), lambda t: item(t, 0, 1)), F.array(item(F.lit(""), 0, 0)))
        rows = rows.select("id", "len", "ts", "boost", F.explode(items).alias("e"))
        rows = rows.select("id", "len", "ts", "boost", F.coalesce("e.t", F.lit("")).alias("term"),
                           F.col("e.n").alias("n"), F.col("e.s").alias("s"))
    else:
        rows = rows.select("id", "len", "ts", "boost",
                           F.explode(F.concat(F.col("_tokens"), F.array(F.lit("")))).alias("e"))
        rows = rows.select("id", "len", "ts", "boost", F.coalesce("e", F.lit("")).alias("term"),
                           F.when(F.col("e") == "", 0).otherwise(1).alias("n"), F.lit(0).alias("s"))
    if vocabulary is not None:
        wanted = (vocabulary.select(F.coalesce("term", F.lit("")).alias("term"))
                  .union(vocabulary.sparkSession.range(1).select(F.lit("").alias("term"))).distinct())
        rows = rows.join(hint(wanted, small_vocabulary), "term", "left_semi")
    postings = rows.groupBy("id", "term").agg(
        F.sum("n").alias("tf"), F.max("s").alias("strong"), F.max("len").alias("len"),
        F.max("ts").alias("ts"), F.max("boost").alias("boost"))
    return Index(postings)


def query_terms(queries: DataFrame, stop: list[str] = wl.GATE_STOP_WORDS,
                tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """Distinct terms of each query's `facets ARRAY<STRING>`.

    `mask` has bit f set where facet f has the term; facet 0 is the query as given, so
    its terms (bit 0) are the ones relevance is judged by.
    """
    facets = queries.select("query_id", F.posexplode("facets").alias("facet_no", "facet"))
    terms = facets.select("query_id", "facet_no", F.explode(F.array_distinct(tokenizer(F.col("facet")))).alias("term"))
    return (terms.groupBy("query_id", "term")
            .agg(F.bit_or(F.expr("shiftleft(1, cast(facet_no as int))")).alias("mask"))
            .select("query_id", F.coalesce("term", F.lit("")).alias("term"), "mask",
                    F.col("term").isin(stop).alias("is_generic"),
                    F.col("term").rlike("^[a-z][a-z0-9_.-]{3,}$").alias("is_identifier")))


def recency_factor(now: Column, ts: Column, weight: float) -> Column:
    age_days = F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(ts)) / F.lit(86_400_000.0))
    return F.when(ts.isNull(), F.lit(1.0)).otherwise(1 + F.lit(weight) / (1 + age_days / 7))


def term_weights(terms: DataFrame, index: Index) -> DataFrame:
    """`terms(term, ...)` that occur in the index, with `df, idf, avg_len`."""
    totals = index.postings.filter(F.col("term") == "").agg(F.struct(
        F.count("id").cast("double").alias("n"), F.avg("len").alias("avg_len"))).scalar()
    return (terms.join(index.term_stats.select("term", "df"), "term")
            .withColumn("totals", totals)
            .withColumn("idf", F.log(1 + (F.col("totals.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
            .withColumn("avg_len", F.col("totals.avg_len")).drop("totals"))


def score_pairs(terms: DataFrame, index: Index, n_facets: int = 1, k1: float = K1, b: float = B,
                small_terms: bool = False, n_bits: int | None = None) -> DataFrame:
    """BM25 score per facet and gate counts for each (query, document) that share a term.

    Returns `query_id, id, ts, boost, scores ARRAY<DOUBLE>, matched, strong, generic, shared`;
    `terms` with a number `no` (see `with_shared`) give `bits` of `n_bits` longs for `shared`.
    """
    weighted = term_weights(terms, index)
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    joined = (index.postings.join(hint(weighted, small_terms), "term")
              .filter(tf > 0)
              .withColumn("part", part)
              .withColumn("judged", (F.col("mask").bitwiseAND(1) != 0)))
    counted = F.col("judged") & ~F.col("is_generic")
    if n_bits is None:
        shared = F.array_sort(F.collect_list(F.when(counted, F.col("term")))).alias("shared")
    else:
        shared = F.array(*[F.bit_or(F.when(F.floor(F.col("no") / 64) == i, F.expr("shiftleft(1L, cast(no % 64 as int))")).otherwise(F.lit(0).cast("long")))
                           for i in range(n_bits)]).alias("bits")
    return joined.groupBy("query_id", "id").agg(
        F.max("ts").alias("ts"), F.max("boost").alias("boost"),
        # Rounded, since the order of a distributed sum may change the last bits and copies
        # of a document must tie.
        F.array(*[F.round(F.sum(F.when(F.col("mask").bitwiseAND(1 << f) != 0, F.col("part")).otherwise(0.0)), 9)
                  for f in range(n_facets)]).alias("scores"),
        F.sum(counted.cast("int")).alias("matched"),
        F.sum((counted & ((F.col("strong") > 0) | F.col("is_identifier"))).cast("int")).alias("strong"),
        F.sum((F.col("judged") & F.col("is_generic")).cast("int")).alias("generic"), shared)


def with_shared(terms: DataFrame, index: Index, small_terms: bool = False) -> DataFrame:
    """The rows of `score_pairs` (one facet) where all of them want their `shared` words.

    A query's counted words are numbered and a pair sums up bits instead of a list of words,
    which would be sorted by pair first; queries of more words than `MAX_BITS` are listed.
    """
    counted = (F.col("mask").bitwiseAND(1) != 0) & ~F.col("is_generic")
    numbered = terms.withColumn("no", F.when(counted, F.row_number().over(Window.partitionBy("query_id", counted).orderBy("term")) - 1))
    words = terms.filter(counted).groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("_words"))
    n_bits = -(-(words.agg(F.max(F.size("_words"))).first()[0] or 1) // 64)
    if 64 * n_bits > MAX_BITS:
        return score_pairs(terms, index, small_terms=small_terms)
    pairs = score_pairs(numbered, index, small_terms=small_terms, n_bits=n_bits)
    own = words.withColumnRenamed("query_id", "_query")
    pairs = pairs.join(hint(own, small_terms), F.col("query_id").eqNullSafe(F.col("_query")), "left")
    shared = F.expr("filter(_words, (w, i) -> shiftright(bits[cast(i div 64 as int)], i % 64) & 1L = 1L)")
    return pairs.withColumn("shared", F.coalesce(shared, empty())).drop("bits", "_query", "_words")


def build_fielded_index(docs: DataFrame, fields: list[str], tokenizer: Callable[[Column], Column] = tokens,
                        vocabulary: DataFrame | None = None, small_vocabulary: bool = False) -> FieldedIndex:
    """Postings of `docs(id, <fields>)`; `vocabulary(term)` keeps only terms some query asks for."""
    def item(t: Column, field: int) -> Column:
        return F.struct(t.alias("t"), F.lit(field).alias("f"))

    def of_field(name: str, field: int) -> Column:
        return F.transform(F.coalesce(tokenizer(F.col(name)), empty()), lambda t: item(t, field))

    each = [of_field(name, i) for i, name in enumerate(fields)]
    rows = docs.filter(F.col("id").isNotNull()).repartition("id").select("id", F.concat(*each).alias("_all"))  # as for `build_index`
    rows = rows.select("id", F.size("_all").alias("len"), "_all")
    rows = rows.select("id", "len", F.explode(F.concat("_all", F.array(item(F.lit(""), -1)))).alias("e"))
    rows = rows.select("id", "len", F.coalesce("e.t", F.lit("")).alias("term"), F.col("e.f").alias("f"))
    if vocabulary is not None:
        wanted = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        rows = rows.join(hint(wanted, small_vocabulary), "term", "left_semi")
    return FieldedIndex(rows.groupBy("id", "term").agg(
        F.array(*[F.count_if(F.col("f") == i) for i in range(len(fields))]).alias("tfs"), F.max("len").alias("len")))


def fielded_scores(terms: DataFrame, docs: DataFrame | FieldedIndex, weights: dict[str, float],
                   tokenizer: Callable[[Column], Column] = tokens, k1: float = K1, b: float = B,
                   small_terms: bool = False) -> DataFrame:
    """BM25 over weighted fields (the formula of full-text indexes with column weights), of
    documents or of an index whose fields are those of `weights` in this order.

    A term's frequency is the weighted sum over the fields; the length counts all tokens;
    the inverse frequency is ln((N-n+0.5)/(n+0.5)), at least 1e-6.
    """
    index = docs if isinstance(docs, FieldedIndex) else build_fielded_index(
        docs, list(weights), tokenizer, terms if small_terms else None, small_terms)
    sums = sum((F.col("tfs")[i] * F.lit(float(w)) for i, w in enumerate(weights.values())), F.lit(0.0))
    postings = keep(index.postings.select("id", "term", sums.alias("wtf"), "len"))
    stats = postings.groupBy("term").agg(F.count("id").alias("df"))
    totals = postings.filter(F.col("term") == "").agg(F.struct(
        F.count("id").cast("double").alias("n"), F.avg("len").alias("avg_len"))).scalar()
    ratio = (F.col("totals.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weighted = (terms.join(stats.select("term", "df"), "term").withColumn("totals", totals)
                .withColumn("idf", F.greatest(F.log(ratio), F.lit(1e-6)))
                .withColumn("avg_len", F.col("totals.avg_len")).drop("totals"))
    f = F.col("wtf")
    part = F.col("idf") * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return (postings.join(hint(weighted, small_terms), "term")
            .groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score")))
