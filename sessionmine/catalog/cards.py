"""Card queries: documents as drafts and cards, events as outcomes and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wordlists as wl
from ..operators import rewrite
from ..plans import cards as pc, stats
from ..sources import export
from .common import document_cards, sql_list, table, tok_sql
from .text import NORM_KEY_SQL

_EV = "array<struct<kind:string,repo:string,role:string,hint:string,session_id:string>>"


def _none(t):
    return F.lit(None).cast(t)


def drafts(spark, sf):
    """One draft card per document.  Names are short, so many drafts are about one card."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    return d.select(
        F.lit("global").alias("scope"), (n % 2).cast("string").alias("partition"), F.col("source").alias("session_id"), n.alias("seq"),
        F.timestamp_seconds(n + 1_700_000_000).alias("ts"), F.lit("procedure").alias("kind"),
        F.element_at(F.array(F.lit("draft"), F.lit("validated"), F.lit("draft")), (n % 3 + 1).cast("int")).alias("status"),
        F.when(n % 17 == 0, "confidential").otherwise("internal").alias("sensitivity"),
        F.concat(F.lit("card "), F.substring("text", 1, 2)).alias("name"), F.when(n % 5 == 0, F.concat(F.lit("gist "), n.cast("string"))).alias("gist"),
        F.concat(F.lit("when "), "lang").alias("when"), F.col("text").alias("summary"),
        F.array(F.concat(F.lit("step "), (n % 30).cast("string")), F.concat(F.lit("step "), (n % 7).cast("string"))).alias("steps"),
        F.when(n % 4 == 0, F.concat(F.lit("Unit"), (n % 9).cast("string"))).alias("subject"), _none("string").alias("location"), _none("string").alias("reuse"),
        _none("string").alias("applies_to"), F.array().cast("array<string>").alias("invariants"),
        F.array(F.struct(F.concat(F.lit("Api"), (n % 20).cast("string"), F.lit(".call")).alias("symbol"), _none("string").alias("signature"),
                         F.concat(F.lit("n"), n.cast("string")).alias("notes"))).alias("api"),
        _none("struct<language:string,kind:string,code:string>").alias("example"), F.array().cast("array<string>").alias("pitfalls"),
        F.array().cast("array<string>").alias("verify"),
        F.struct(_none("string").alias("ecosystem"), F.array("lang").alias("languages"), F.array("source").alias("frameworks"),
                 _none("map<string,string>").alias("framework_versions"), _none("map<string,string>").alias("version_constraints"),
                 F.create_map(F.lit("v"), n.cast("string")).alias("versions"), _none("array<struct<name:string,version:string>>").alias("sdks"),
                 _none("string").alias("build_tool")).alias("stack"),
        F.col("lang").alias("domain"), F.array("source", "lang").alias("tags"), F.array().cast(_EV).alias("evidence"),
        F.lit("model").alias("provenance"))


def merged_cards(spark, sf):
    """All drafts merged by name, trigger and domain."""
    m = pc.merge_cards(drafts(spark, sf), cap=None)
    notes = F.transform("api", lambda a: F.concat_ws("/", a["symbol"], a["notes"]))
    return m.select(
        "id", "partition", "name", "status", "sensitivity", "gist", "subject", "hits", F.col("merged").cast("long").alias("merged"),
        F.sha1("summary").alias("summary"), F.array_join("steps", ",").alias("steps"), F.array_join("tags", ",").alias("tags"),
        F.array_join(notes, ",").alias("api"), F.array_join(F.transform("evidence", lambda e: e["session_id"]), ",").alias("evidence"),
        F.array_join("stack.frameworks", ",").alias("frameworks"), F.element_at("stack.versions", F.lit("v")).alias("version"))


_KEY = NORM_KEY_SQL.replace("lower(text)", "lower(name || ' ' || w || ' ' || lang)")
MERGE_CTES = f"""
dr AS (SELECT doc_id AS n, doc_id % 2 AS pt, source, lang, 'card ' || substr(text, 1, 2) AS nm0, 'when ' || lang AS w, text AS sm FROM documents),
d1 AS (SELECT *, trim(regexp_replace(nm0, '^\\s+|\\s+$', '', 'g')) AS name, trim(regexp_replace(sm, '^\\s+|\\s+$', '', 'g')) AS s FROM dr),
dk AS (SELECT *, CAST(pt AS VARCHAR) || '|' || {_KEY} AS key FROM d1),
b AS (SELECT key, CAST(min(pt) AS VARCHAR) AS "partition", arg_min(name, n) AS name, count(*) AS hits,
  CASE WHEN bool_or(n % 3 = 1) THEN 'validated' ELSE 'draft' END AS status, CASE WHEN bool_or(n % 17 = 0) THEN 'confidential' ELSE 'internal' END AS sensitivity,
  arg_min('gist ' || n, n) FILTER (WHERE n % 5 = 0) AS gist, arg_min('Unit' || (n % 9), n) FILTER (WHERE n % 4 = 0) AS subject,
  arg_max(s, (length(s), -n)) AS summary, CAST(max(n) AS VARCHAR) AS version FROM dk GROUP BY key),
it AS (SELECT key, 'steps' AS f, 'step ' || (n % 30) AS v, 'step ' || (n % 30) AS j, n * 10 AS o FROM dk UNION ALL SELECT key, 'steps', 'step ' || (n % 7), 'step ' || (n % 7), n * 10 + 1 FROM dk
  UNION ALL SELECT key, 'tags', source, source, n * 10 FROM dk UNION ALL SELECT key, 'tags', lang, lang, n * 10 + 1 FROM dk
  UNION ALL SELECT key, 'api', 'Api' || (n % 20) || '.call', 'Api' || (n % 20) || '.call/n' || n, n * 10 FROM dk
  UNION ALL SELECT key, 'evidence', source, source, n * 10 FROM dk UNION ALL SELECT key, 'frameworks', source, source, n * 10 FROM dk),
i1 AS (SELECT key, f, v, min(o) AS o, arg_min(j, o) AS j FROM it GROUP BY 1, 2, 3),
i2 AS (SELECT *, row_number() OVER (PARTITION BY key, f ORDER BY o) AS r FROM i1),
i3 AS (SELECT key, string_agg(j, ',' ORDER BY o) FILTER (WHERE f = 'steps' AND r <= 24) AS steps, string_agg(j, ',' ORDER BY o) FILTER (WHERE f = 'tags' AND r <= 12) AS tags,
  string_agg(j, ',' ORDER BY o) FILTER (WHERE f = 'api' AND r <= 12) AS api, string_agg(j, ',' ORDER BY o) FILTER (WHERE f = 'evidence' AND r <= 20) AS evidence,
  string_agg(j, ',' ORDER BY o) FILTER (WHERE f = 'frameworks') AS frameworks FROM i2 GROUP BY 1),
mc AS (SELECT *, 'tq_' || substr(sha1('global|' || key), 1, 32) AS id FROM b JOIN i3 USING (key))"""
MERGED = f"""WITH {MERGE_CTES}
SELECT id, "partition", name, status, sensitivity, gist, subject, hits, hits - 1 AS merged, sha1(summary) AS summary, steps, tags, api, evidence, frameworks, version FROM mc"""


def evicted_cards(spark, sf):
    """The 30 most valuable merged cards per partition."""
    m = pc.merge_cards(drafts(spark, sf), cap=None).withColumn("successes", F.col("hits") % 3).withColumn("created", F.lit(False))
    return pc.evict_cards(m, 30).select("id", "partition", "hits")


EVICTED = f"""WITH {MERGE_CTES}, f AS (SELECT key, min(n) AS t FROM dk GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY CASE WHEN hits % 3 > 0 THEN 4 ELSE 1 END DESC, hits DESC, t DESC, id) AS k FROM mc JOIN f USING (key))
SELECT id, "partition", hits FROM r WHERE k <= 30"""


def conflicts(spark, sf):
    """Cards with the same trigger as others."""
    m = pc.merge_cards(drafts(spark, sf), cap=None)
    return pc.conflicts(m).select("id", F.array_join("conflicts_with", ",").alias("others"))


CONFLICTS = f"""WITH {MERGE_CTES}, f AS (SELECT key, min(n) AS t, any_value(w) AS w FROM dk GROUP BY 1),
l AS (SELECT id, "partition", w, t FROM mc JOIN f USING (key)),
g AS (SELECT "partition", w, list(id ORDER BY t, id)[1:9] AS ids FROM l GROUP BY 1, 2 HAVING count(*) > 1)
SELECT id, array_to_string(list_filter(ids, lambda x: x <> id)[1:8], ',') AS others FROM l JOIN g USING ("partition", w)"""


def _base_cards(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    code = F.when(F.col("user_id") % 2 == 0, F.array(F.struct(F.lit("code").alias("kind"), *[_none("string").alias(x) for x in ("repo", "role", "hint", "session_id")])))
    return u.select(
        F.concat(F.lit("tq_"), F.col("user_id").cast("string")).alias("id"), F.lit("draft").alias("status"), code.alias("evidence"),
        *[F.lit(0).cast("long").alias(c) for c in ("applied", "successes", "failures")],
        F.when(F.col("user_id") % 5 == 0, F.lit("2023-01-01").cast("timestamp")).alias("archived_at"), _none("timestamp").alias("last_verified_at"),
        F.lit("2023-01-01").cast("timestamp").alias("updated_at"), _none(pc._VER).alias("verifications"))


def outcomes(spark, sf):
    """A user's first days: purchases are successes, errors failures, clicks self-reported."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "error", "click"))
    o = e.select(
        F.concat(F.lit("tq_"), F.col("user_id").cast("string")).alias("card_id"), F.col("event_id").cast("string").alias("session_id"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "click").alias("self_reported"), F.concat(F.lit("checked value "), F.col("value").cast("decimal(10,2)").cast("string")).alias("evidence"))
    c = pc.apply_outcomes(_base_cards(spark, sf), o)
    return c.select("id", "status", "applied", "successes", "failures", F.col("archived_at").isNotNull().alias("archived"),
                    F.unix_seconds("last_verified_at").alias("verified_at"),
                    F.array_join(F.transform("verifications", lambda v: v["session_id"]), ",").alias("last"))


OUTCOMES = """
WITH o AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS s, event_type = 'error' AS f FROM events WHERE event_type IN ('purchase', 'error', 'click')),
r AS (SELECT *, sum(s::INT) OVER w AS cs, sum(f::INT) OVER w AS cf, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT user_id, count(*) AS applied, sum(s::INT)::BIGINT AS successes, sum(f::INT)::BIGINT AS failures, max(CASE WHEN NOT f THEN ts END) AS v,
  max(CASE WHEN cf >= 2 AND cf > cs THEN 3 WHEN cs >= 3 AND cf = 0 AND user_id % 2 = 0 THEN 2 WHEN cs >= 1 THEN 1 ELSE 0 END) AS st,
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5) AS last FROM r GROUP BY 1)
SELECT 'tq_' || user_id AS id, ['draft', 'validated', 'canonical', 'deprecated'][st + 1] AS status, applied, successes, failures,
  (user_id % 5 = 0 AND successes = 0) AS archived, CAST(floor(epoch(v)) AS BIGINT) AS verified_at, last FROM a
"""


def evidence_checks(spark, sf):
    """All sentences of messages as evidence: how many pass, and why others do not."""
    c = table(spark, sf, "conversations").select(F.explode(F.split("text", r"[.!?]\s+")).alias("evidence"))
    return pc.check_evidence(c).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


EVIDENCE = """
WITH c AS (SELECT unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS text FROM conversations),
v AS (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS e FROM c),
w AS (SELECT e, regexp_replace(e, '[\\d%.,，。！!；;、:：\\s"''`()（）\\[\\]【】{}<>/\\\\|~-]', '', 'g') AS x FROM v)
SELECT CASE WHEN e = '' THEN 'empty' WHEN x <> '' AND regexp_replace(x, '(?i)(?:ok|okay|fine|good|done|works?|worked|success|confirmed|pass(?:ed)?)', '', 'g') = '' THEN 'content_free'
  WHEN length(e) < 12 THEN 'too_short' WHEN NOT regexp_matches(e, '\\d|`[^`]+`|"[^"]+"|''[^'']+''|\\S+/\\S+|\\.\\w{2,6}\\b') THEN 'no_observation' ELSE 'ok' END AS reason, count(*) AS n FROM w GROUP BY 1
"""


def _needle_cards(spark, sf):
    """Documents as cards whose symbols are long words of theirs, a plain and a compound one."""
    d = table(spark, sf, "documents")
    words = F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9_])([A-Z][a-z]{6,9})(?![A-Za-z0-9_])"), F.lit(1))
    w = F.array_distinct(words)
    return d.select(F.col("doc_id").alias("id"), F.timestamp_seconds(F.col("doc_id")).alias("ts"), "text", F.array_compact(F.array(
        F.get(w, F.lit(0)), F.concat(F.get(w, F.lit(1)), F.lit("."), F.lower(F.get(w, F.lit(2)))))).alias("symbols"))


def _calls(spark, sf):
    """Messages as tool calls; words follow each other with a dot in some of them."""
    c = table(spark, sf, "conversations")
    body = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", " ", ".")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("call_id"), F.col("turn").alias("seq"),
                    F.when(F.col("turn") % 2 == 0, "edit").otherwise("read").alias("tool"),
                    F.to_json(F.struct(F.concat(F.lit("/ws/f"), (F.col("turn") % 3).cast("string"), F.lit(".ts")).alias("file_path"), body.alias("note"))).alias("arguments"),
                    (F.col("turn") % 5 == 4).alias("is_error"))


def needle_census(spark, sf):
    """Needles by the number of cards that share them."""
    n = pc.needles(_needle_cards(spark, sf))
    return n.groupBy("needle").agg(F.count_distinct("id").alias("cards"), F.min("id").alias("first_card")).join(
        pc.generic_needles(n).select("needle", F.lit(True).alias("g")), "needle", "left").select(
        "needle", "cards", "first_card", F.coalesce("g", F.lit(False)).alias("generic"))


NEEDLE_CTES = """
dw AS (SELECT doc_id AS id, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS w FROM (SELECT doc_id, regexp_extract_all(' ' || regexp_replace(text, '[^A-Za-z0-9_]', '  ', 'g') || ' ', ' ([A-Z][a-z]{6,9}) ', 1) AS ws FROM (
  SELECT doc_id, regexp_replace(text, '([^A-Za-z0-9_])', '  ', 'g') AS text FROM documents))),
nd AS (SELECT id, 0 AS pos, w[1] AS needle FROM dw WHERE len(w) >= 1 UNION ALL SELECT id, 1, w[2] || '.' || lower(w[3]) FROM dw WHERE len(w) >= 3)"""
NEEDLE_CENSUS = f"""WITH {NEEDLE_CTES}
SELECT needle, count(DISTINCT id) AS cards, min(id) AS first_card, count(DISTINCT id) >= 3 AS generic FROM nd GROUP BY 1"""


def references(spark, sf):
    """First mention of every card in every session (all cards count as shown at the start)."""
    cards, calls = _needle_cards(spark, sf), _calls(spark, sf)
    n = pc.needles(cards)
    r = pc.references(None, calls, n, pc.generic_needles(n))
    return r.select("session_id", F.col("id").alias("card_id"), "call_id", "needle")


REFERENCES = f"""WITH {NEEDLE_CTES}, gn AS (SELECT needle FROM nd GROUP BY 1 HAVING count(DISTINCT id) >= 3),
c AS (SELECT conv_id AS session_id, turn AS seq, conv_id * 100 + turn AS call_id,
   CAST(to_json({{'note': CASE WHEN turn % 2 = 0 THEN replace(text, ' ', '.') ELSE text END}}) AS VARCHAR) AS arguments FROM conversations WHERE turn % 5 <> 4),
ct AS (SELECT DISTINCT session_id, seq, call_id, unnest(regexp_extract_all(arguments, '[A-Za-z0-9_$]+')) AS tok FROM c),
h AS (SELECT session_id, seq, call_id, id, pos, needle FROM ct JOIN nd ON tok = needle WHERE pos = 0
  UNION SELECT session_id, seq, call_id, id, pos, needle FROM c JOIN nd ON contains(arguments, needle) WHERE pos = 1),
f AS (SELECT session_id, id, min((seq, pos, call_id, needle)) AS m FROM h WHERE needle NOT IN (SELECT needle FROM gn) GROUP BY 1, 2)
SELECT session_id, id AS card_id, m[3] AS call_id, m[4] AS needle FROM f"""


def advice(spark, sf):
    """The card to mention at each call."""
    cards, calls = _needle_cards(spark, sf), _calls(spark, sf)
    a = pc.advise(calls, cards, pc.precise_cards(calls, pc.needles(cards)))
    return a.select("session_id", "call_id", F.col("id").alias("card_id"), "n_terms", "n_chars", "exact")


_NAMED = ("[一-龥]{2,}|[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+|[a-z][A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*"
          "|[A-Z][A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*|[A-Z][A-Z0-9_]{2,}")
_NOISE = sql_list([w for w in wl.ADVISORY_NOISE + wl.GATE_STOP_WORDS if w.isascii()])
ADVICE = f"""WITH {NEEDLE_CTES},
c AS (SELECT conv_id AS session_id, turn AS seq, conv_id * 100 + turn AS call_id, turn % 2 = 0 AS edit, turn % 3 AS file,
   CASE WHEN turn % 2 = 0 THEN replace(text, ' ', '.') ELSE text END AS note FROM conversations),
ct AS (SELECT DISTINCT session_id, seq, call_id, file, unnest(regexp_extract_all(CAST(to_json(note) AS VARCHAR), '[A-Za-z0-9_$]+')) AS tok FROM c),
h AS (SELECT session_id, seq, call_id, file, id, needle FROM ct JOIN nd ON tok = needle WHERE pos = 0
  UNION SELECT session_id, seq, call_id, file, id, needle FROM c JOIN nd ON contains(note, needle) WHERE pos = 1),
dr AS (SELECT session_id, call_id, id, count(DISTINCT needle) AS nn FROM h GROUP BY 1, 2, 3),
fi AS (SELECT session_id, file, id, min(seq) AS since FROM h GROUP BY 1, 2, 3),
lt AS (SELECT c.session_id, c.call_id, fi.id FROM c JOIN fi ON c.session_id = fi.session_id AND c.file = fi.file AND c.seq > fi.since),
pr AS (SELECT session_id, call_id, id, nn FROM dr UNION ALL SELECT session_id, call_id, id, 0 FROM lt ANTI JOIN dr USING (session_id, call_id, id)),
nm AS (SELECT session_id, call_id, edit, unnest(regexp_extract_all(note, '{_NAMED}')) AS x FROM c),
wd AS (SELECT session_id, call_id, edit, unnest(string_split_regex(regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9一-龥]+')) AS w FROM nm),
tm AS (SELECT DISTINCT session_id, call_id, edit, lower(w) AS term FROM wd WHERE length(w) >= 5 AND NOT regexp_full_match(w, '\\d+') AND lower(w) NOT IN ({_NOISE})),
ev AS (SELECT DISTINCT doc_id AS id, unnest({tok_sql('text')}) AS term FROM documents
  UNION SELECT id, unnest({tok_sql('needle')}) FROM nd),
p AS (SELECT session_id, call_id, edit, id, count(*) AS n_terms, sum(length(term))::BIGINT AS n_chars FROM tm JOIN ev USING (term) GROUP BY 1, 2, 3, 4),
r AS (SELECT p.*, CASE WHEN edit AND nn IS NOT NULL THEN 1 ELSE 0 END AS exact, row_number() OVER (PARTITION BY p.session_id, p.call_id ORDER BY
   CASE WHEN edit AND nn IS NOT NULL THEN 1 ELSE 0 END DESC, CASE WHEN edit AND coalesce(nn, 0) >= 2 THEN 1 ELSE 0 END DESC, n_terms DESC, n_chars DESC, p.id DESC) AS k
  FROM p LEFT JOIN pr ON pr.session_id = p.session_id AND pr.call_id = p.call_id AND pr.id = p.id)
SELECT session_id, call_id, id AS card_id, n_terms, n_chars, exact FROM r WHERE k = 1"""


def maintenance(spark, sf):
    """Patches for document cards: dead weight, per-domain cap, old reference counts."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    c = d.select(
        n.alias("id"), F.timestamp_seconds(n * 3600 + 1_700_000_000).alias("ts"), F.lit("global").alias("scope"), F.lit("default").alias("partition"),
        F.when(n % 4 == 0, "validated").otherwise("draft").alias("status"), F.when(n % 13 == 0, "pitfall").otherwise("procedure").alias("kind"),
        F.concat(F.lit("n"), n.cast("string")).alias("name"), F.lit("w").alias("when"), F.when(n % 6 == 0, None).otherwise(F.upper("lang")).alias("domain"),
        F.array("source", "lang").alias("tags"), (n % 3 == 1).cast("long").alias("retrieve_count"), (n % 10 == 9).cast("long").alias("referenced"),
        F.lit(0).cast("long").alias("successes"), _none("timestamp").alias("archived_at"), _none("int").alias("reference_epoch"))
    p = pc.maintain(c, "2023-12-30 00:00:00", 14, ("de",), 40)
    return p.select(F.col("id").alias("doc_id"), "domain", F.col("archived_at").isNotNull().alias("archived"), "reason")


MAINTENANCE = """
WITH c AS (SELECT doc_id AS id, doc_id * 3600 + 1700000000 AS ts, doc_id % 4 <> 0 AS draft, doc_id % 13 = 0 AS pit, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE upper(lang) END AS dom,
   lang, doc_id % 3 = 1 AS ret, doc_id % 10 = 9 AS rf FROM documents),
n AS (SELECT *, coalesce(lower(dom), CASE WHEN lang IN (SELECT lower(dom) FROM c WHERE dom IS NOT NULL) THEN lang END) AS nd FROM c),
o AS (SELECT *, draft AND NOT pit AND NOT ret AND NOT rf AND coalesce(epoch_ms(TIMESTAMP '2023-12-30') / 1000 - ts >= 14 * 86400, false)
   AND NOT (dom IS NOT NULL AND starts_with(lower(dom), 'de')) AS aged FROM n),
ac AS (SELECT * FROM o WHERE draft AND NOT aged AND nd IS NOT NULL AND NOT starts_with(nd, 'de')),
sz AS (SELECT nd, count(*) - 40 AS excess FROM ac GROUP BY 1 HAVING count(*) > 40),
un AS (SELECT id, nd, excess, row_number() OVER (PARTITION BY nd ORDER BY ts, id) AS r FROM ac JOIN sz USING (nd) WHERE NOT pit AND NOT ret AND NOT rf),
cp AS (SELECT id FROM un WHERE r <= excess),
x AS (SELECT o.*, cp.id IS NOT NULL AS capped, nd IS DISTINCT FROM dom AS renamed FROM o LEFT JOIN cp USING (id))
SELECT id AS doc_id, nd AS domain, aged OR capped AS archived, concat_ws(',', CASE WHEN aged THEN 'aged' END, CASE WHEN capped THEN 'capped' END,
  CASE WHEN renamed THEN 'domain' END, CASE WHEN rf THEN 'epoch' END) AS reason FROM x WHERE aged OR capped OR renamed OR rf
"""


def resolved_ids(spark, sf):
    """Prefixes of card ids looked up."""
    recs = table(spark, sf, "documents").select(F.concat(F.lit("tq_"), F.sha1(F.col("doc_id").cast("string"))).alias("id"))
    b = table(spark, sf, "benchmark").select("item_id", F.sha1(F.col("item_id").cast("string")).alias("h"))
    want = b.select(F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("tq_"), "h")).when(F.col("item_id") % 4 == 1, F.substring("h", 1, 4))
                    .when(F.col("item_id") % 4 == 2, F.substring("h", 1, 2)).otherwise(F.concat(F.lit("zz"), "h")).alias("needle"))
    return rewrite.resolve_ids(want, recs)


RESOLVED = """
WITH r AS (SELECT sha1(CAST(doc_id AS VARCHAR)) AS b FROM documents),
w AS (SELECT DISTINCT CASE item_id % 4 WHEN 0 THEN 'tq_' || h WHEN 1 THEN substr(h, 1, 4) WHEN 2 THEN substr(h, 1, 2) ELSE 'zz' || h END AS needle
  FROM (SELECT item_id, sha1(CAST(item_id AS VARCHAR)) AS h FROM benchmark)),
m AS (SELECT needle, regexp_replace(needle, '^tq_', '') AS b, (SELECT count(*) FROM r WHERE starts_with(r.b, regexp_replace(needle, '^tq_', ''))) AS c,
  (SELECT min(b) FROM r WHERE starts_with(r.b, regexp_replace(needle, '^tq_', ''))) AS f FROM w)
SELECT needle, CASE WHEN length(b) >= 4 AND c = 1 THEN 'tq_' || f END AS id,
  CASE WHEN length(b) < 4 THEN 'too_short' WHEN c = 1 THEN 'ok' WHEN c = 0 THEN 'unknown' ELSE 'ambiguous' END AS status, CASE WHEN length(b) < 4 THEN 0 ELSE c END AS matches FROM m
"""


def patched(spark, sf):
    """Labels patch the documents' source; unknown ids change nothing."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    p = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "removed").alias("source"), F.lit("xx").alias("lang"))
    return rewrite.patch_by_id(d, p, keep=("lang",)).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))


PATCHED = """SELECT lang, CASE WHEN toxic = 1 THEN 'removed' ELSE source END AS source, count(*) AS docs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"""


def deleted(spark, sf):
    """Documents left per language after deleting labelled ones and wiping one source."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("scope"), F.lit("p").alias("partition"))
    left = rewrite.wipe_scope(rewrite.delete_ids(d, table(spark, sf, "labels").select(F.col("doc_id").alias("id"))), "src1", confirm=True)
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


DELETED = """SELECT lang, count(*) AS docs FROM documents WHERE source <> 'src1' AND doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"""


def symbol_index(spark, sf):
    """Cards per symbol."""
    return pc.symbol_index(_needle_cards(spark, sf)).groupBy("symbol").agg(F.count("id").alias("cards"), F.min("id").alias("first_card"))


SYMBOL_INDEX = f"WITH {NEEDLE_CTES} SELECT needle AS symbol, count(DISTINCT id) AS cards, min(id) AS first_card FROM nd GROUP BY 1"


def library_stats(spark, sf):
    """Counts of the document cards with subtotals per partition."""
    d = document_cards(spark, sf).withColumn("archived_at", F.when(F.col("id") % 19 == 0, F.lit("2024-01-01").cast("timestamp"))).withColumn(
        "retrieve_count", F.col("id") % 2)
    return stats.library_stats(d, ["partition"])


STATS = """
SELECT source AS "partition", count(*) AS cards, count(*) FILTER (WHERE st = 'validated' AND NOT ar) AS verified, count(*) FILTER (WHERE st = 'draft' AND NOT ar) AS drafts,
  count(*) FILTER (WHERE ar) AS archived, count(*) FILTER (WHERE q > 0) AS adopted, count(*) FILTER (WHERE doc_id % 2 > 0) AS retrieved,
  count(*) FILTER (WHERE st = 'draft' AND doc_id % 2 = 0) AS cold_drafts, count(*) FILTER (WHERE doc_id % 7 > 0) AS referenced_cards,
  sum(doc_id % 7)::BIGINT AS reference_events, round(100 * count(*) FILTER (WHERE q > 0) / count(*), 1) AS adoption_rate
FROM (SELECT doc_id, source, doc_id % 19 = 0 AS ar, coalesce(quality, 0) AS q, CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 1 THEN 'validated' ELSE 'draft' END AS st
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ROLLUP (source)
"""


def topics(spark, sf):
    """Domains by number of cards."""
    return stats.topics(document_cards(spark, sf))


TOPICS = "SELECT lang AS domain, count(*) AS cards FROM documents GROUP BY 1"


def usage(spark, sf):
    """Retrievals and references per card."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
    u = pc.usage_counters(e.select(F.col("user_id").alias("card_id"), F.when(F.col("event_type") == "view", "retrieve").otherwise("reference").alias("event"), F.col("ts").alias("at")))
    return u.select("card_id", "retrieve_count", "referenced", F.unix_seconds("last_referenced_at").alias("last_referenced"))


USAGE = """SELECT user_id AS card_id, count(*) FILTER (WHERE event_type = 'view') AS retrieve_count, count(*) FILTER (WHERE event_type = 'click') AS referenced,
  CAST(floor(epoch(max(CASE WHEN event_type = 'click' THEN ts END))) AS BIGINT) AS last_referenced FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"""


def exported(spark, sf):
    """Trusted cards as documents."""
    m = pc.merge_cards(drafts(spark, sf), cap=None)
    x = export.export_cards(m.withColumn("conflicts_with", F.array().cast("array<string>")))
    return x.select("id", "name", F.length("description").cast("long").alias("chars"), F.size("problems").cast("long").alias("problems"))


EXPORTED = f"""WITH {MERGE_CTES},
x AS (SELECT id, summary, name, tags, frameworks, (SELECT any_value(w) FROM dk WHERE dk.key = mc.key) AS w, (SELECT any_value(lang) FROM dk WHERE dk.key = mc.key) AS lang FROM mc WHERE status = 'validated' AND sensitivity <> 'confidential'),
y AS (SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  trim(regexp_replace(CASE WHEN summary <> '' THEN summary ELSE name END || ' For: ' || w || '. Stack: ' || lang || '/' || split_part(frameworks, ',', 1) || '. Tags: ' || replace(tags, ',', ', ') || '.', '\\s+', ' ', 'g')) AS ds FROM x)
SELECT id, CASE WHEN length(slug) >= 3 THEN slug ELSE 'technique' END || '-' || substr(id, 4, 8) AS name, least(length(ds), 1024) AS chars, 0 AS problems FROM y"""

QUERIES = {
    "merged_cards": (merged_cards, MERGED), "evicted_cards": (evicted_cards, EVICTED), "card_conflicts": (conflicts, CONFLICTS),
    "card_outcomes": (outcomes, OUTCOMES), "evidence_checks": (evidence_checks, EVIDENCE), "needle_census": (needle_census, NEEDLE_CENSUS),
    "card_references": (references, REFERENCES), "card_advice": (advice, ADVICE), "card_maintenance": (maintenance, MAINTENANCE),
    "resolved_ids": (resolved_ids, RESOLVED), "patched_rows": (patched, PATCHED), "deleted_rows": (deleted, DELETED),
    "symbol_index": (symbol_index, SYMBOL_INDEX), "library_stats": (library_stats, STATS), "topics": (topics, TOPICS),
    "usage_counters": (usage, USAGE), "exported_cards": (exported, EXPORTED),
}
