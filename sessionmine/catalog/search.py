"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.versions import compatible
from ..operators.index import FieldedIndex, Index, build_fielded_index, build_index, query_terms
from ..operators.shared import shared_folder
from ..plans import search as s, stats
from .common import (GATE_STOP_SQL, benchmark_queries, bm25_ctes, document_cards, documents, table, tok_sql)

R = F.round


def bm25_topk(spark, sf):
    hits = s.search(benchmark_queries(spark, sf), documents(spark, sf), k=10)
    return hits.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank")


BM25_TOPK = f"""
WITH {bm25_ctes()},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10
"""


def stored_index_search(spark, sf):
    """The same from an index that is written once and read by the buckets of the terms."""
    folder = shared_folder(spark)
    build_index(documents(spark, sf)).write(folder)
    q = benchmark_queries(spark, sf)
    terms = query_terms(q.select("query_id", F.array("text").alias("facets")))
    hits = s.search(q, documents(spark, sf), k=10, index=Index.read(spark, folder, terms))
    return hits.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank")


def bounded_topk(spark, sf):
    """The same by bounds: only documents that can still reach rank 10 are paired."""
    hits = s.search(benchmark_queries(spark, sf), documents(spark, sf), k=10, max_pairs=0)
    return hits.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank")


def message_search(spark, sf):
    """User messages as queries over all messages of assistants, gated."""
    c = table(spark, sf, "conversations").withColumn("mid", F.col("conv_id") * 1000 + F.col("turn"))
    q = c.filter(F.col("role") == "user").select(F.col("mid").alias("query_id"), "text")
    d = c.filter(F.col("role") == "assistant").select(F.col("mid").alias("id"), "text")
    hits = s.search(q, d, k=3, gate=2, empty="deny")
    return hits.select("query_id", F.col("id").alias("message_id"), R("score", 6).alias("score"), "rank")


_GATE_CTES = f"""
qn AS (SELECT query_id, count(*) AS n_terms, count(*) FILTER (WHERE term NOT IN ({GATE_STOP_SQL})) AS n_inf FROM qt GROUP BY 1),
met AS (SELECT qt.query_id, tf.id,
   count(*) FILTER (WHERE term NOT IN ({GATE_STOP_SQL})) AS matched,
   count(*) FILTER (WHERE term NOT IN ({GATE_STOP_SQL}) AND (STRONG OR regexp_full_match(term, '[a-z][a-z0-9_.-]{{3,}}'))) AS strong,
   count(*) FILTER (WHERE term IN ({GATE_STOP_SQL})) AS generic
  FROM qt JOIN tf USING (term) GROUP BY 1, 2),
gate AS (SELECT met.*, n_terms, n_inf, (matched > 0 AND (matched >= CASE WHEN n_inf <= 2 THEN 1 ELSE least(2, n_inf) END OR strong >= 1)) AS kept
  FROM met JOIN qn USING (query_id))"""

_MSG = bm25_ctes("SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant'",
                 "SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'")
MESSAGE_SEARCH = f"""
WITH {_MSG}, {_GATE_CTES.replace('STRONG', 'false')},
r AS (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM scored JOIN gate USING (query_id, id) WHERE kept)
SELECT query_id, id AS message_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3
"""


def gate_decisions(spark, sf):
    """Gate verdict of every (benchmark text, document) that share a word."""
    out = s.search(benchmark_queries(spark, sf), documents(spark, sf), gate=2, decisions=True)
    return out.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"),
                      *[F.col(c).cast("long").alias(c) for c in ("matched", "strong", "generic")], "kept")


GATE_DECISIONS = f"""
WITH {bm25_ctes()}, {_GATE_CTES.replace('STRONG', 'false')}
SELECT query_id, id AS doc_id, round(score, 6) AS score, matched, strong, generic, kept FROM scored JOIN gate USING (query_id, id)
"""

FIELD_WEIGHTS = {"name": 12.0, "tags": 2.0, "summary": 4.0}


def _fielded_documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("name"),
        F.concat_ws(" ", "source", "lang").alias("tags"), F.col("text").alias("summary"))


def fielded(spark, sf):
    """Field-weighted search: first line, source and text of documents."""
    hits = s.search_fielded(benchmark_queries(spark, sf), _fielded_documents(spark, sf), FIELD_WEIGHTS, k=5)
    return hits.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank")


def stored_fielded_search(spark, sf):
    """The same from a fielded index that is written once and read by the buckets of the terms."""
    folder = shared_folder(spark)
    build_fielded_index(_fielded_documents(spark, sf), list(FIELD_WEIGHTS)).write(folder)
    q = benchmark_queries(spark, sf)
    terms = query_terms(q.select("query_id", F.array("text").alias("facets")))
    hits = s.search_fielded(q, FieldedIndex.read(spark, folder, terms), FIELD_WEIGHTS, k=5)
    return hits.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank")


FIELDED = f"""
WITH d AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS name, source || ' ' || lang AS tags, text AS summary FROM documents),
f AS (SELECT id, unnest({tok_sql('name')}) AS term, 12.0::DOUBLE AS w FROM d UNION ALL SELECT id, unnest({tok_sql('tags')}), 2.0::DOUBLE FROM d
      UNION ALL SELECT id, unnest({tok_sql('summary')}), 4.0::DOUBLE FROM d),
ln AS (SELECT d.id, count(f.id) AS len FROM d LEFT JOIN f USING (id) GROUP BY 1),
tot AS (SELECT count(*) AS n, avg(len) AS avgl FROM ln),
tf AS (SELECT id, term, sum(w) AS tf FROM f GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({tok_sql('text')}) AS term FROM benchmark),
sc AS (SELECT query_id, tf.id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgl))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN dfs USING (term) JOIN ln ON ln.id = tf.id, tot GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5
"""

CARD_ROWS = """SELECT doc_id AS id, text, lang, source, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS x, doc_id % 7 AS ref,
  CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 1 THEN 'validated' ELSE 'draft' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)"""
_CARD_WEIGHT = "((q + 1) / (q + x + 2) * CASE WHEN q > 0 THEN 1.1 ELSE 0.6 END * (1 + least(ref, 5) * 0.04))"


def _card_ctes(where: str) -> str:
    return bm25_ctes(f"SELECT * FROM ({CARD_ROWS}) WHERE {where}")


def _with_strong(ctes: str) -> str:
    """A matched term is strong where the domain, a tag or a symbol has it."""
    return ctes.replace("STRONG", "term IN (tf_lang, tf_source)").replace(
        "FROM qt JOIN tf USING (term) GROUP BY 1, 2", "FROM qt JOIN (SELECT tf.*, lang AS tf_lang, source AS tf_source FROM tf JOIN d USING (id)) tf USING (term) GROUP BY 1, 2")


def card_search(spark, sf):
    """Verified cards only, weighted by confidence, evidence, references and domain."""
    hits = s.search_cards(benchmark_queries(spark, sf), document_cards(spark, sf), k=5)
    return hits.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank")


CARD_SEARCH = f"""
WITH {_card_ctes("status IN ('validated', 'canonical')")},
w AS (SELECT query_id, scored.id, scored.score * {_CARD_WEIGHT} * CASE WHEN contains(lower(q.text), lang) THEN 1.2 ELSE 1 END AS score
      FROM scored JOIN d USING (id) JOIN q USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w WHERE score > 0)
SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5
"""


def card_candidates(spark, sf):
    """What the hard filters leave, with and without drafts, per partition."""
    d = document_cards(spark, sf)
    one = s.candidates(d).groupBy("partition").agg(F.count(F.lit(1)).alias("verified"))
    two = s.candidates(d, drafts=True).groupBy("partition").agg(F.count(F.lit(1)).alias("with_drafts"))
    return two.join(one, "partition", "left").select("partition", "with_drafts", F.coalesce("verified", F.lit(0)).alias("verified"))


CARD_CANDIDATES = f"""
SELECT source AS partition, count(*) FILTER (WHERE status <> 'deprecated') AS with_drafts,
  count(*) FILTER (WHERE status IN ('validated', 'canonical')) AS verified
FROM ({CARD_ROWS}) GROUP BY source HAVING count(*) FILTER (WHERE status <> 'deprecated') > 0
"""


def stack_filter(spark, sf):
    """Documents whose language and framework fit each of two profiles."""
    prof = lambda lang, fw: F.struct(
        F.lit(None).cast("string").alias("ecosystem"), F.array(lang).alias("languages"), F.array(fw).alias("frameworks"),
        F.lit(None).cast("map<string,string>").alias("framework_versions"),
        F.create_map(F.lit("k"), F.lit(">=1.2 <1.9")).alias("version_constraints"),
        F.create_map(F.lit("k"), F.concat(F.lit("1."), (F.col("doc_id") % 12).cast("string"))).alias("versions"))
    d = table(spark, sf, "documents")
    out = None
    for name, lang in (("english", "en"), ("german", "de")):
        hit = d.filter(compatible(prof(F.lit(lang), F.lit("src1")), prof(F.col("lang"), F.col("source"))))
        part = hit.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).select(F.lit(name).alias("profile"), "lang", "docs")
        out = part if out is None else out.unionByName(part)
    return out


STACK_FILTER = """
SELECT profile, lang, count(*) AS docs FROM documents, (VALUES ('english', 'en'), ('german', 'de')) p(profile, plang)
WHERE lang = plang AND source = 'src1' AND doc_id % 12 >= 2 AND doc_id % 12 < 9 GROUP BY 1, 2
"""


def _facet_queries(spark, sf):
    return s.facets(benchmark_queries(spark, sf), document_cards(spark, sf))


def facet_list(spark, sf):
    """Sub-queries of each benchmark text."""
    f = _facet_queries(spark, sf).select("query_id", F.posexplode("facets").alias("facet_no", "facet"))
    return f.select("query_id", F.col("facet_no").cast("long").alias("facet_no"), "facet")


def _facet_ctes(cards: str) -> str:
    return f"""
voc AS (SELECT word, min(o) AS o FROM (SELECT lang AS word, id * 10 AS o FROM ({cards}) UNION ALL SELECT source, id * 10 + 1 FROM ({cards})) GROUP BY 1),
cl AS (SELECT item_id AS query_id, 0 AS cls, 0 AS o, text AS facet FROM benchmark
  UNION ALL SELECT item_id, 1, generate_subscripts(p, 1), unnest(p) FROM (SELECT item_id, list_transform(string_split_regex(text, '[，,；;。\\n]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS p FROM benchmark)
  UNION ALL SELECT item_id, 2, o, word FROM benchmark, voc WHERE contains(lower(text), lower(word))),
fd AS (SELECT query_id, facet, min((cls, o)) AS k FROM cl WHERE cls = 0 OR length(facet) >= 2 GROUP BY 1, 2),
fr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS fno, facet FROM fd),
fac AS MATERIALIZED (SELECT * FROM fr WHERE fno <= 8)"""


FACET_LIST = f"WITH {_facet_ctes(CARD_ROWS)} SELECT query_id, fno - 1 AS facet_no, facet FROM fac"


def facet_search(spark, sf):
    """Multi-topic card search: per-facet ranking, merged in turn, gated by the query."""
    hits = s.search_facets(benchmark_queries(spark, sf), document_cards(spark, sf), k=5, gate=2, as_cards=True, drafts=True)
    return hits.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank")


def facet_sql(where: str, k: int, gated: bool) -> str:
    """Multi-topic card search in SQL: `query_id, id, score, rank`."""
    pool = f"SELECT * FROM ({CARD_ROWS}) WHERE {where}"
    kept = "kept" if gated else "true"
    return f"""
WITH {_card_ctes(where)}, {_facet_ctes(pool)}, {_with_strong(_GATE_CTES)},
ft AS (SELECT DISTINCT query_id, fno, unnest({tok_sql('facet')}) AS term FROM fac),
fs AS (SELECT ft.query_id, fno, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.len / avgl))), 9) AS score
  FROM ft JOIN tf USING (term) JOIN dfs USING (term), tot GROUP BY 1, 2, 3),
fw AS (SELECT fs.query_id, fs.fno, fs.id, fs.score * {_CARD_WEIGHT} * CASE WHEN contains(lower(facet), lang) THEN 1.2 ELSE 1 END AS score
  FROM fs LEFT JOIN gate USING (query_id, id) JOIN d USING (id) JOIN fac ON fac.query_id = fs.query_id AND fac.fno = fs.fno WHERE {kept}),
fk AS (SELECT *, row_number() OVER (PARTITION BY query_id, fno ORDER BY score DESC, id) AS fr FROM fw WHERE score > 0),
m AS (SELECT query_id, id, min((fr, fno, score)) AS k FROM fk WHERE fr <= {max(k, 10)} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM m)
SELECT query_id, id, k[3] AS score, rank FROM r WHERE rank <= {k}"""


FACET_SEARCH = f"""SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM ({facet_sql("status <> 'deprecated'", 5, True)})"""


def draft_fallback(spark, sf):
    """Whether drafts had to be shown, per query."""
    r = s.search_with_drafts(benchmark_queries(spark, sf), document_cards(spark, sf), k=3, scan=10)
    return r.select("query_id", F.col("id").alias("doc_id"), R("score", 6).alias("score"), "rank", "fallback")


DRAFT_FALLBACK = f"""
WITH wide AS MATERIALIZED ({facet_sql("status <> 'deprecated'", 10, False)}),
narrow AS MATERIALIZED ({facet_sql("status IN ('validated', 'canonical')", 3, False)}),
st AS (SELECT id, status FROM ({CARD_ROWS})),
f AS (SELECT query_id, arg_min(score, rank) FILTER (WHERE status = 'draft') AS dr, arg_min(score, rank) FILTER (WHERE status <> 'draft') AS ve FROM wide JOIN st USING (id) GROUP BY 1),
u AS (SELECT query_id, dr IS NOT NULL AND (ve IS NULL OR dr > ve) AS fallback FROM f)
SELECT query_id, id AS doc_id, round(score, 6) AS score, rank, fallback FROM wide JOIN u USING (query_id) WHERE rank <= 3 AND fallback
UNION ALL SELECT query_id, id, round(score, 6), rank, false FROM narrow LEFT JOIN u USING (query_id) WHERE NOT coalesce(fallback, false)
"""


def _pack_docs(spark, sf):
    d = table(spark, sf, "documents")
    fact = F.col("doc_id") % 3 == 0
    return d.select(
        F.when(fact, "semantic").otherwise("episodic").alias("layer"), F.col("doc_id").alias("id"),
        F.timestamp_seconds(F.col("doc_id") * 3600 + 1_700_000_000).alias("ts"), "text",
        F.when(fact, F.when(F.col("lang") == "en", "preference").otherwise("fact")).alias("kind"),
        F.array("source").alias("tags"), (F.col("doc_id") % 11 == 0).alias("superseded"))


def near_duplicates(spark, sf):
    """Hits left after dropping those that repeat an earlier hit of the same query."""
    d = _pack_docs(spark, sf)
    hits = s.search(benchmark_queries(spark, sf), d, k=10).join(d.select("id", "text"), "id")
    kept = s.drop_near_duplicates(hits)
    return kept.select("query_id", F.col("id").alias("doc_id"), "rank")


def context_pack(spark, sf):
    """Packed context per benchmark text."""
    p = s.context_pack(benchmark_queries(spark, sf), _pack_docs(spark, sf), now="2024-01-01 00:00:00")
    return p.select("query_id", F.col("entries").cast("long").alias("entries"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"),
                    F.length("body").cast("long").alias("chars"), F.sha1("body").alias("digest"))


def blank_queries(spark, sf):
    """Queries without a word for each benchmark text: the newest documents, with and without
    a gate."""
    blank = F.element_at(F.array(F.lit(""), F.lit(" ?! "), F.lit(None).cast("string")), (F.col("query_id") % 3 + 1).cast("int"))
    q = benchmark_queries(spark, sf).select("query_id", blank.alias("text"))
    d = _pack_docs(spark, sf)
    rows = [s.search_facets(q, d, k=4, gate=g).withColumn("gate", F.lit(g or 0)) for g in (None, 2)]
    return rows[0].unionByName(rows[1]).select("query_id", F.col("id").alias("doc_id"), "rank", "gate")


BLANK = """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents)
SELECT item_id AS query_id, doc_id, rank, gate FROM benchmark, n, (VALUES (0), (2)) g(gate) WHERE rank <= 4
"""


def evaluation(spark, sf):
    """Retrieval quality where a user's message is the query and the next message, if it is the
    assistant's, the answer to find among all messages of assistants."""
    c = table(spark, sf, "conversations").withColumn("mid", F.col("conv_id") * 1000 + F.col("turn"))
    q = c.filter(F.col("role") == "user").select(F.col("mid").alias("query_id"), "text")
    d = c.filter(F.col("role") == "assistant").select(F.col("mid").alias("id"), "text")
    answers = q.join(d, q["query_id"] + 1 == d["id"]).select("query_id", "id")
    e = stats.evaluate(s.search(q, d, k=3, empty="deny"), answers, k=3)
    return e.select("queries", "hit1", "hitk", R("mrr", 6).alias("mrr"), R("recall", 6).alias("recall"))


EVALUATION = f"""
WITH {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
a AS (SELECT q.query_id, d.id FROM q JOIN d ON d.id = q.query_id + 1),
l AS (SELECT a.id, rank FROM a LEFT JOIN r ON r.query_id = a.query_id AND r.id = a.id AND rank <= 3)
SELECT count(*) AS queries, count(*) FILTER (WHERE rank = 1) AS hit1, count(rank) AS hitk,
  round(sum(coalesce(1 / rank, 0)) / count(*), 6) AS mrr, round(count(rank) / count(*), 6) AS recall FROM l
"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_TOPK), "bounded_topk": (bounded_topk, BM25_TOPK), "stored_index_search": (stored_index_search, BM25_TOPK), "message_search": (message_search, MESSAGE_SEARCH),
    "gate_decisions": (gate_decisions, GATE_DECISIONS), "fielded_search": (fielded, FIELDED), "stored_fielded_search": (stored_fielded_search, FIELDED),
    "card_search": (card_search, CARD_SEARCH), "card_candidates": (card_candidates, CARD_CANDIDATES),
    "stack_filter": (stack_filter, STACK_FILTER), "facet_list": (facet_list, FACET_LIST), "facet_search": (facet_search, FACET_SEARCH),
    "draft_fallback": (draft_fallback, DRAFT_FALLBACK), "near_duplicates": (near_duplicates, None), "context_pack": (context_pack, None),
    "blank_queries": (blank_queries, BLANK),
    "retrieval_evaluation": (evaluation, EVALUATION),
}
