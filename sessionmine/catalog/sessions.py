"""Session queries: turns, episodes, facts, reflection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_key, strip
from ..operators.running import running
from ..plans import facts as pf, search as s, sessions as ps
from .common import documents, table, tok_sql
from .text import NORM_KEY_SQL, WS, clip_sql, redact_sql, sentences_sql

# The marker words of the library do not occur in the invented prose of the test data.
PREFERENCE, DECISION, TODO = ["the ", "nicht"], ["que "], ["and ", " und "]


def session_events(spark, sf):
    """Messages as session events; each assistant message also calls a tool on a file."""
    c = table(spark, sf, "conversations")
    c = running(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 64), sums={"n_user": (F.col("role") == "user").cast("long")})
    n, none = F.col("turn"), F.lit(None).cast("string")
    base = c.select(
        F.col("conv_id").cast("string").alias("session_id"), (n * 2).alias("seq"), F.timestamp_seconds(F.col("conv_id") * 1000 + n).alias("ts"),
        F.when(F.col("role") == "assistant", "assistant/message").otherwise("user/message").alias("type"),
        F.col("n_user").cast("int").alias("turn"), "text", F.when(F.col("role") == "system", "plugin").alias("source_kind"),
        none.alias("call_id"), none.alias("tool"), none.alias("arguments"), F.lit(False).alias("is_error"), none.alias("error_name"),
        none.alias("error_code"), F.lit("/ws").alias("cwd"))
    calls = c.filter(F.col("role") == "assistant").select(
        F.col("conv_id").cast("string").alias("session_id"), (n * 2 + 1).alias("seq"), F.timestamp_seconds(F.col("conv_id") * 1000 + n).alias("ts"),
        F.lit("tool/call").alias("type"), F.col("n_user").cast("int").alias("turn"), none.alias("text"), none.alias("source_kind"),
        F.concat(F.lit("c"), n.cast("string")).alias("call_id"), F.concat(F.lit("tool"), (n % 3).cast("string")).alias("tool"),
        F.concat(F.lit('{"file_path": "/ws/src/f'), ((F.col("conv_id") + n) % 5).cast("string"), F.lit('.ts", "n": 1}')).alias("arguments"),
        F.lit(False).alias("is_error"), none.alias("error_name"), none.alias("error_code"), F.lit("/ws").alias("cwd"))
    return base.unionByName(calls)


def _turns(spark, sf):
    return ps.build_turns(session_events(spark, sf), user_chars=2000, assistant_chars=1200, max_turns=60)


def turns(spark, sf):
    t = _turns(spark, sf)
    return t.select("session_id", F.col("turn").cast("long").alias("turn"), F.sha1("user").alias("user"), F.sha1("assistant").alias("assistant"),
                    F.array_join("tools", ",").alias("tools"), F.array_join("files", ",").alias("files"))


def whole_turns(spark, sf):
    """Turns without any limit."""
    t = ps.build_turns(session_events(spark, sf))
    return t.select("session_id", F.col("turn").cast("long").alias("turn"), F.sha1("user").alias("user"), F.sha1("assistant").alias("assistant"),
                    F.array_join("tools", ",").alias("tools"), F.array_join("files", ",").alias("files"))


def _ht(col: str, n: int) -> str:
    head = n * 6 // 10
    return f"CASE WHEN length({col}) <= {n} THEN {col} ELSE substr({col}, 1, {head}) || '…' || right({col}, {n - head - 1}) END"


TURN_CTES = f"""
m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text, conv_id,
       CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn FROM conversations),
g AS (SELECT session_id, turn,
   coalesce(string_agg(text || chr(10), '' ORDER BY seq) FILTER (WHERE role = 'user'), '') AS u,
   coalesce(string_agg(text || chr(10), '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '') AS a,
   list('tool' || (seq % 3) ORDER BY seq) FILTER (WHERE role = 'assistant') AS tl,
   list('src/f' || ((conv_id + seq) % 5) || '.ts' ORDER BY seq) FILTER (WHERE role = 'assistant') AS fl
  FROM m WHERE role <> 'system' GROUP BY 1, 2),
t AS (SELECT session_id, turn, {_ht('u', 2000)} AS "user", {_ht('a', 1200)} AS assistant,
   coalesce(list_filter(tl, lambda x, i: list_position(tl, x) = i), []) AS tools,
   coalesce(list_filter(fl, lambda x, i: list_position(fl, x) = i), []) AS files FROM g)"""
TURNS = f"""WITH {TURN_CTES}
SELECT session_id, turn, sha1("user") AS "user", sha1(assistant) AS assistant, array_to_string(tools, ',') AS tools, array_to_string(files, ',') AS files FROM t"""


WHOLE_TURNS = TURNS.replace(_ht('u', 2000), "u").replace(_ht('a', 1200), "a")


def capped_transcripts(spark, sf):
    """Turns left under a 1500 character limit."""
    return ps.cap_transcript(_turns(spark, sf), 1500).select("session_id", F.col("turn").cast("long").alias("turn"))


CAPPED = f"""WITH {TURN_CTES}, z AS (SELECT session_id, turn,
  length("user" || chr(10) || assistant || chr(10) || array_to_string(files, ' ') || chr(10) || array_to_string(tools, ' ')) + 1 AS n FROM t),
w AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY turn DESC) AS tail, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM z)
SELECT session_id, turn FROM w WHERE tail - 1 <= 1500 OR back = 1"""


def _distilled(spark, sf):
    return ps.distill(_turns(spark, sf), PREFERENCE, DECISION, TODO, limits=ps.LIMITS)


def episodes(spark, sf):
    """One summary per session."""
    e, _ = _distilled(spark, sf)
    join = lambda c: F.array_join(c, "|")
    return e.select("session_id", "title", F.sha1("summary").alias("summary"), join("decisions").alias("decisions"),
                    join("todos").alias("todos"), join("files").alias("files"))


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(s), '{w}')" for w in words) + ")"


def _sq(col: str) -> str:
    return f"trim(regexp_replace({col}, '{WS}+', ' ', 'g'))"


MARK_CTES = f"""
sn AS (SELECT session_id, turn, generate_subscripts(p, 1) AS pos, unnest(p) AS s FROM (SELECT session_id, turn, {sentences_sql('"user"')} AS p FROM t)),
mk AS (SELECT session_id, turn * 100000 + pos AS sec, {clip_sql('s', 400)} AS text, {_has(PREFERENCE)} AS p, {_has(DECISION)} AS d, {_has(TODO)} AS td FROM sn),
m1 AS (SELECT session_id, text, min(sec) AS sec FROM mk WHERE p GROUP BY 1, 2),
m2 AS (SELECT mk.session_id, mk.text, min(mk.sec) AS sec FROM mk LEFT JOIN m1 USING (session_id, text) WHERE d AND mk.sec IS DISTINCT FROM m1.sec GROUP BY 1, 2),
m3 AS (SELECT mk.session_id, mk.text, min(mk.sec) AS sec FROM mk LEFT JOIN m1 USING (session_id, text) LEFT JOIN m2 USING (session_id, text)
       WHERE td AND mk.sec IS DISTINCT FROM m1.sec AND mk.sec IS DISTINCT FROM m2.sec GROUP BY 1, 2),
al AS (SELECT 'preference' AS category, * FROM m1 UNION ALL SELECT 'decision', * FROM m2 UNION ALL SELECT 'todo', * FROM m3),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY sec, text) AS n FROM al),
marked AS (SELECT * FROM rk WHERE n <= 20)"""
_RED = redact_sql("x")


def _red_list(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda x: {_RED}), '|')"


EPISODES = f"""WITH {TURN_CTES}, {MARK_CTES},
ls AS (SELECT session_id, list(text ORDER BY n) FILTER (WHERE category = 'decision') AS ds, list(text ORDER BY n) FILTER (WHERE category = 'todo') AS ts FROM marked GROUP BY 1),
fo AS (SELECT session_id, f, min(sec) AS sec FROM (SELECT session_id, turn * 1000 + generate_subscripts(files, 1) AS sec, unnest(files) AS f FROM t) GROUP BY 1, 2),
fs AS (SELECT session_id, list(f ORDER BY sec) AS fs FROM fo GROUP BY 1),
tg AS (SELECT session_id, x, min(sec) AS sec FROM (SELECT session_id, turn * 1000 + generate_subscripts(tools, 1) AS sec, unnest(tools) AS x FROM t) GROUP BY 1, 2),
ts AS (SELECT session_id, list(x ORDER BY sec) AS tl FROM tg GROUP BY 1),
b AS (SELECT session_id, count(*) AS n, coalesce(arg_min("user", turn) FILTER (WHERE "user" <> ''), '') AS rq,
        coalesce(arg_max(assistant, turn) FILTER (WHERE assistant <> ''), '') AS rs FROM t GROUP BY 1),
e AS (SELECT b.session_id, n, rq, rs, coalesce(ds, []) AS ds, coalesce(ls.ts, []) AS td, coalesce(fs, []) AS fs, coalesce(tl, []) AS tl,
   {_sq("regexp_extract(rq, '^([^\\n\\r]*)', 1)")} AS ti, {_sq('rq')} AS rq1, {_sq('rs')} AS rs1
   FROM b LEFT JOIN ls USING (session_id) LEFT JOIN fs USING (session_id) LEFT JOIN ts USING (session_id)),
su AS (SELECT *, concat_ws(' ', n || ' turns.', CASE WHEN rq <> '' THEN 'Asked: ' || {clip_sql('rq1', 200)} END,
   CASE WHEN len(tl) > 0 THEN 'Used: ' || array_to_string(tl[1:8], '; ') || CASE WHEN len(tl) > 8 THEN ' (of ' || len(tl) || ')' ELSE '' END END,
   CASE WHEN rs <> '' THEN 'Ended with: ' || {clip_sql('rs1', 240)} END, CASE WHEN len(ds) > 0 THEN 'Decided: ' || array_to_string(ds[1:3], '; ') END,
   CASE WHEN len(td) > 0 THEN 'Left: ' || array_to_string(td[1:3], '; ') END, CASE WHEN len(fs) > 0 THEN 'Touched: ' || array_to_string(fs[1:8], '; ') END) AS sm FROM e),
o AS (SELECT session_id, CASE WHEN ti <> '' THEN {clip_sql('ti', 120)} ELSE 'untitled session' END AS title0, {clip_sql('sm', 2000)} AS sm0, ds, td, fs FROM su)
SELECT session_id, {redact_sql('title0')} AS title, sha1({redact_sql('sm0')}) AS summary, {_red_list('ds')} AS decisions, {_red_list('td')} AS todos, array_to_string(fs, '|') AS files FROM o"""


def _drafts(spark, sf):
    _, f = _distilled(spark, sf)
    return f.select(F.lit("global").alias("scope"), F.lit("default").alias("partition"), "kind", "text", "session_id",
                    F.array("kind").alias("tags"), F.timestamp_seconds(F.col("session_id").cast("long") * 1000).alias("ts"),
                    (F.col("turn") * 100_000 + F.col("pos")).cast("long").alias("seq"))


def facts(spark, sf):
    """Marked sentences of all sessions as facts."""
    f = pf.merge_facts(_drafts(spark, sf))
    return f.select("key", "kind", "text", "hits", F.array_join("sources", ",").alias("sources"), F.unix_seconds("ts").alias("first_at"))


def _key(col: str) -> str:
    return NORM_KEY_SQL.replace("lower(text)", f"lower({col})")


FACT_CTES = f"""{TURN_CTES}, {MARK_CTES},
dr AS (SELECT session_id, trim({redact_sql('text')}) AS text, sec, CAST(session_id AS BIGINT) * 1000 AS ts FROM marked WHERE category = 'preference'),
kd AS (SELECT *, {_key('text')} AS key FROM dr),
so AS (SELECT key, session_id, min((ts, sec)) AS o FROM kd GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o DESC) AS r FROM so),
sl AS (SELECT key, string_agg(session_id, ',' ORDER BY o) AS sources FROM sr WHERE r <= 20 GROUP BY 1),
fa AS (SELECT key, arg_max(text, (ts, sec)) AS text, count(*) AS hits, min(ts) AS first_at FROM kd WHERE key <> '' GROUP BY 1)"""
FACTS = f"WITH {FACT_CTES} SELECT key, 'preference' AS kind, text, hits, sources, first_at FROM fa JOIN sl USING (key)"


def _message_facts(spark, sf):
    """Every message as a fact; the speaker is the partition, so two groups hold all rows."""
    c = table(spark, sf, "conversations")
    return pf.merge_facts(c.select(
        F.lit("global").alias("scope"), F.col("role").alias("partition"), F.lit("fact").alias("kind"), "text",
        F.col("conv_id").cast("string").alias("session_id"), F.array("role").alias("tags"),
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("turn").alias("seq")))


def evicted_facts(spark, sf):
    """What stays when each speaker may keep 100 facts."""
    f = pf.evict_facts(_message_facts(spark, sf), 100)
    return f.select("partition", "key", "hits", F.unix_seconds("ts").alias("first_at"), "id")


EVICTED = f"""
WITH k AS (SELECT role, trim(text) AS text, conv_id * 1000 + turn AS ts, turn, {_key('text')} AS key FROM conversations),
f AS (SELECT role AS "partition", key, count(*) AS hits, min(ts) AS first_at, 'sm_' || substr(sha1('global|' || role || '|' || key), 1, 32) AS id
      FROM k WHERE key <> '' GROUP BY role, key),
r AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY hits DESC, first_at, id) AS rank FROM f)
SELECT "partition", key, hits, first_at, id FROM r WHERE rank <= 100
"""


def superseded_facts(spark, sf):
    """A user's later message replaces the one before it in the conversation."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    facts_ = _message_facts(spark, sf).filter(F.col("partition") == "user")
    k = c.select("conv_id", "turn", F.concat(F.lit("sm_"), F.substring(F.sha1(F.concat(F.lit("global|user|"), norm_key(strip("text")))), 1, 32)).alias("fid"))
    prev = running(k, ["conv_id"], ["turn"], F.floor(F.col("turn") / 64), lasts={"old_id": F.col("fid")}, include_current=False)
    pairs = prev.filter(F.col("old_id").isNotNull()).select("old_id", F.col("fid").alias("new_id"), F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    out = pf.supersede(facts_, pairs).filter(F.col("superseded_by").isNotNull())
    return out.select("id", "superseded_by", F.unix_seconds("superseded_at").alias("at"))


SUPERSEDED = f"""
WITH k AS (SELECT conv_id, turn, 'sm_' || substr(sha1('global|user|' || {_key('text')}), 1, 32) AS id FROM conversations WHERE role = 'user'),
p AS (SELECT id AS new_id, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS old_id, conv_id * 1000 + turn AS sec FROM k)
SELECT old_id AS id, arg_max(new_id, (sec, new_id)) AS superseded_by, max(sec) AS "at" FROM p
WHERE old_id IS NOT NULL AND old_id <> new_id GROUP BY 1
"""


def latest_episodes(spark, sf):
    """Last assistant message per conversation, the newest 50 of each of two scopes."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    e = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
                 F.col("conv_id").cast("string").alias("session_id"), F.lit("project").alias("scope"), (F.col("conv_id") % 2).cast("string").alias("partition"))
    return ps.latest_episodes(e, 50).select("id", "session_id", "partition")


LATEST = """
WITH e AS (SELECT conv_id * 100 + max(turn) AS id, CAST(conv_id AS VARCHAR) AS session_id, CAST(conv_id % 2 AS VARCHAR) AS "partition"
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY id DESC) AS n FROM e)
SELECT id, session_id, "partition" FROM r WHERE n <= 50
"""


def context_terms(spark, sf):
    """Search extras for the last user message of every session."""
    t = _turns(spark, sf)
    q = t.groupBy("session_id").agg(F.max_by("user", "turn").alias("text")).withColumn("query_id", F.col("session_id"))
    x = s.context_terms(t, q)
    return x.select("query_id", F.array_join(F.array_sort(F.filter("extras", lambda e: e.contains("/") | e.startswith("tool"))), ",").alias("extras"))


CONTEXT = f"""WITH {TURN_CTES},
b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM t),
q AS (SELECT session_id, "user" AS text FROM b WHERE back = 1),
u AS (SELECT session_id, unnest(files || tools) AS x FROM b JOIN q USING (session_id)
      WHERE back <= 3 AND (back = 1 OR list_has_any({tok_sql('"user"')}, {tok_sql('text')}))),
y AS (SELECT session_id, unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*\\b')) AS x FROM q),
z AS (SELECT session_id, x FROM u UNION SELECT session_id, x FROM y WHERE length(x) >= 4 AND (contains(x, '/') OR starts_with(x, 'tool')))
SELECT session_id AS query_id, coalesce(string_agg(x, ',' ORDER BY x), '') AS extras FROM q LEFT JOIN z USING (session_id) GROUP BY 1"""


def reflection(spark, sf):
    """Which sessions are worth a reflection against the documents as library."""
    d = ps.reflect_decisions(_turns(spark, sf), documents(spark, sf), min_turns=2, threshold=0.3)
    return d.select("session_id", F.col("n_turns"), F.round("novelty", 6).alias("novelty"), "reason", "reflect")


REFLECTION = f"""WITH {TURN_CTES},
tx AS (SELECT session_id, turn, "user" || chr(10) || assistant || chr(10) || array_to_string(files, ' ') || chr(10) || array_to_string(tools, ' ') AS x FROM t),
w AS (SELECT DISTINCT session_id, unnest({tok_sql('x')}) AS tok FROM tx),
v AS (SELECT DISTINCT unnest({tok_sql('text')}) AS tok FROM documents),
nv AS (SELECT session_id, count(*) FILTER (WHERE tok NOT IN (SELECT tok FROM v)) / count(*) AS nov FROM w GROUP BY 1),
p AS (SELECT session_id, count(*) AS n, max(CASE WHEN {' OR '.join(f"contains(lower(\"user\"), '{m}')" for m in ('wrong', 'not what i', 'i said', 'stop doing', 'again'))} THEN 1 ELSE 0 END) AS c,
   max(CASE WHEN len(files) > 0 THEN 1 ELSE 0 END) AS touched FROM t GROUP BY 1),
gr AS (SELECT DISTINCT session_id FROM (SELECT session_id, unnest(files) AS f FROM t) WHERE length(replace(f, '.ts', '')) > 0
   AND NOT (length(regexp_extract(f, '([^/]*)\\.ts$', 1)) >= 5 AND regexp_extract(f, '([^/]*)\\.ts$', 1) IN (SELECT tok FROM v))),
r AS (SELECT p.session_id, n AS n_turns, coalesce(nov, 0) AS nov,
  CASE WHEN n < 2 THEN 'few_turns' WHEN touched = 0 AND c = 0 THEN 'no_signal' WHEN c = 1 THEN 'correction'
       WHEN gr.session_id IS NOT NULL THEN 'new_ground' WHEN coalesce(nov, 0) < 0.3 THEN 'not_novel' ELSE 'novel' END AS reason
  FROM p LEFT JOIN nv USING (session_id) LEFT JOIN gr ON gr.session_id = p.session_id)
SELECT session_id, n_turns, round(nov, 6) AS novelty, reason, reason IN ('correction', 'new_ground', 'novel') AS reflect FROM r"""


def delivery_forms(spark, sf):
    """Events as deliveries: full text or pointer, per user and kind of event."""
    e = table(spark, sf, "events")
    d = e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("item_id"), F.dayofyear("ts").alias("turn"),
                 (F.floor(F.dayofyear("ts") / 7)).cast("string").alias("content_hash"), F.month("ts").alias("epoch"))
    return ps.delivery_forms(d, 4).groupBy("session_id").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if("full").alias("full"))


DELIVERY = """
WITH RECURSIVE d AS (SELECT DISTINCT user_id, event_type, dayofyear(ts) AS turn, CAST(floor(dayofyear(ts) / 7) AS VARCHAR) AS h, month(ts) AS ep FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ep ORDER BY turn) AS i FROM d),
f AS (SELECT user_id, event_type, ep, i, turn, h, turn AS ft, true AS full FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_type, o.ep, o.i, o.turn, o.h,
    CASE WHEN o.h <> f.h OR o.turn - f.ft >= 4 THEN o.turn ELSE f.ft END, (o.h <> f.h OR o.turn - f.ft >= 4)
  FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.ep = f.ep AND o.i = f.i + 1)
SELECT user_id AS session_id, count(*) AS deliveries, count(*) FILTER (WHERE "full") AS "full" FROM f GROUP BY 1
"""


def stored_clean(spark, sf):
    """Episodes after the storing pipeline (credentials, identifiers, outside paths)."""
    t = _turns(spark, sf)
    e, _ = ps.distill(t, PREFERENCE, DECISION, TODO, limits=ps.LIMITS)
    j = e.join(ps.session_identifiers(t), "session_id", "left").withColumn("cwd", F.lit("/ws"))
    c = ps.clean_for_store(j, ["title", "summary"], ["decisions", "todos"], "identifiers", "cwd")
    return c.select("session_id", F.sha1("title").alias("title"), F.length("summary").cast("long").alias("chars"), F.size("decisions").cast("long").alias("decisions"))


# No identifier or outside path occurs in these texts, so only the credentials rule may act.
STORED = EPISODES[:EPISODES.rindex("SELECT session_id, ")] + (
    f"SELECT session_id, sha1({redact_sql('title0')}) AS title, length({redact_sql('sm0')}) AS chars, len(ds) AS decisions FROM o")

QUERIES = {
    "turns": (turns, TURNS), "whole_turns": (whole_turns, WHOLE_TURNS), "capped_transcripts": (capped_transcripts, CAPPED), "episodes": (episodes, EPISODES),
    "facts": (facts, FACTS), "evicted_facts": (evicted_facts, EVICTED), "superseded_facts": (superseded_facts, SUPERSEDED),
    "latest_episodes": (latest_episodes, LATEST), "context_terms": (context_terms, CONTEXT), "reflection": (reflection, REFLECTION),
    "delivery_forms": (delivery_forms, DELIVERY), "stored_clean": (stored_clean, STORED),
}
