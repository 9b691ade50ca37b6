"""Failure queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors as ef
from ..plans import failures as fl
from .common import ERROR_KINDS, table, tok_sql
from .text import TEMPLATES_CTE


def _messages(spark, sf, event_type):
    """Events of one type with the message, tool and session that error events get."""
    e = table(spark, sf, "events").filter(F.col("event_type") == event_type)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ERROR_KINDS]), (k % 5 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("session_id"), F.dayofyear("ts").alias("turn"),
        k.alias("k"), F.concat(F.lit("tool"), (k % 3).cast("string")).alias("tool"), kind.alias("kind"),
        F.concat(kind, F.lit(" at line "), k.cast("string"), F.lit(" after "),
                 F.col("value").cast("decimal(10,2)").cast("string"), F.lit(" s")).alias("message"))


def _obs(spark, sf, event_type="error"):
    return fl.fingerprinted(_messages(spark, sf, event_type))


def _cte(name: str, event_type: str) -> str:
    return (TEMPLATES_CTE.replace("event_type = 'error'", f"event_type = '{event_type}'").replace("errs", f"errs_{name}")
            .replace("tpl", f"tpl_{name}").replace("obs AS", f"{name} AS").replace("SELECT *, template", "SELECT *, template"))


def failures(spark, sf):
    """Failure records; a signup event with the same message resolves its failure."""
    f = fl.merge_failures(_obs(spark, sf), _obs(spark, sf, "signup").select("fingerprint", "ts", "seq"))
    return _record_columns(f)


EPISODE_CTES = f"""{_cte('obs', 'error')}, {_cte('res', 'signup')},
h AS (SELECT fingerprint, ts, event_id AS seq, session_id, 'observe' AS type FROM obs UNION ALL SELECT fingerprint, ts, event_id, session_id, 'resolve' FROM res),
h1 AS (SELECT *, lag(type) OVER w AS before, sum(CASE WHEN type = 'observe' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS occ FROM h WINDOW w AS (PARTITION BY fingerprint ORDER BY ts, seq)),
h2 AS (SELECT *, (type = 'observe' AND before = 'resolve' AND occ > 1) AS ro FROM h1),
h3 AS (SELECT *, sum(CASE WHEN ro THEN 1 ELSE 0 END) OVER w AS rel, last_value(CASE WHEN ro THEN occ - 1 END IGNORE NULLS) OVER w AS ar
  FROM h2 WINDOW w AS (PARTITION BY fingerprint ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"""
FAILURES = f"""WITH {EPISODE_CTES},
st AS (SELECT fingerprint, sum(CASE WHEN ro THEN 1 ELSE 0 END) AS relapses, max(CASE WHEN ro THEN seq END) AS ro_at,
  max(CASE WHEN type = 'resolve' AND occ > 0 THEN seq END) AS rs_at, arg_max(occ, seq) FILTER (WHERE type = 'resolve' AND occ > 0) AS rs_n, arg_max(occ - 1, seq) FILTER (WHERE ro) AS ro_n,
  arg_max(type, seq) AS last_type FROM h2 GROUP BY 1),
so AS (SELECT fingerprint, session_id, min(seq) AS o FROM h WHERE type = 'observe' GROUP BY 1, 2),
sl AS (SELECT fingerprint, string_agg(session_id, ',' ORDER BY o) AS sessions FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY o DESC) AS r FROM so) WHERE r <= 20 GROUP BY 1),
b AS (SELECT fingerprint, any_value(tool) AS tool, any_value(template) AS template, arg_max(message, event_id) AS symptom, count(*) AS n FROM obs GROUP BY 1),
x AS (SELECT *, greatest(1, n - coalesce(CASE WHEN ro_at > coalesce(rs_at, -1) THEN ro_n END, 0)) AS ie FROM b JOIN st USING (fingerprint) JOIN sl USING (fingerprint))
SELECT fingerprint, tool, template, symptom, n AS occurrences, relapses, ie AS in_episode, CASE WHEN ie >= 3 THEN 'ask' ELSE 'warn' END AS enforcement,
  CASE WHEN last_type = 'resolve' THEN 'deprecated' WHEN n >= 2 THEN 'validated' ELSE 'draft' END AS status, sessions, coalesce(rs_n, -1) AS at_resolve FROM x"""


def failures_in_two_steps(spark, sf):
    """The same records, merged from the events before day 15 and, onto these, the rest."""
    obs, res = _obs(spark, sf), _obs(spark, sf, "signup").select("fingerprint", "ts", "seq")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    first = fl.merge_failures(obs.filter(early), res.filter(early), max_sessions=None)
    f = fl.merge_failures(obs.filter(~early), res.filter(~early), existing=first)
    return _record_columns(f)


def _record_columns(f):
    return f.select("fingerprint", "tool", "template", "symptom", "occurrences", "relapses", F.col("in_episode").cast("long").alias("in_episode"),
                    "enforcement", "status", F.array_join("sessions", ",").alias("sessions"),
                    F.coalesce("occurrences_at_resolve", F.lit(-1)).alias("at_resolve"))


def failures_all_scopes(spark, sf):
    """Records of each user as a scope of its own, some without a partition; none is dropped."""
    o = _obs(spark, sf).withColumn("scope", F.lit("user")).withColumn("partition", F.when(F.col("turn") % 2 == 0, F.col("session_id")))
    return fl.merge_failures(o).select("scope", "partition", "fingerprint", "occurrences", "status")


def failure_episodes(spark, sf):
    """Running counters of every failure observation."""
    cols = ["fingerprint", "ts", "seq"]
    h = _obs(spark, sf).select(*cols, F.lit("observe").alias("type")).unionByName(
        _obs(spark, sf, "signup").select(*cols, F.lit("resolve").alias("type")))
    e = fl.episodes(h)
    return e.select("seq", "fingerprint", "occurrences", "relapses", F.col("in_episode").cast("long").alias("in_episode"), "reopened")


FAILURE_EPISODES = f"""WITH {EPISODE_CTES}
SELECT seq, fingerprint, occ AS occurrences, rel AS relapses, greatest(1, occ - coalesce(ar, 0)) AS in_episode, coalesce(ro, false) AS reopened FROM h3 WHERE type = 'observe'"""


ALL_SCOPES = f"""WITH {_cte('obs', 'error')}
SELECT 'user' AS scope, CASE WHEN dayofyear(ts) % 2 = 0 THEN session_id ELSE 'default' END AS partition, fingerprint, count(*) AS occurrences,
  CASE WHEN count(*) >= 2 THEN 'validated' ELSE 'draft' END AS status FROM obs GROUP BY ALL"""


def failure_list(spark, sf):
    """The ten most frequent open failures."""
    f = fl.merge_failures(_obs(spark, sf), cap=None)
    return fl.failure_list(f, 10).select("fingerprint", "occurrences", F.unix_micros("last_seen").alias("last_seen"))


FAILURE_LIST = f"""WITH {_cte('obs', 'error')}
SELECT fingerprint, count(*) AS occurrences, epoch_us(max(ts)) AS last_seen FROM obs GROUP BY 1 ORDER BY occurrences DESC, last_seen DESC, fingerprint LIMIT 10"""


def newest_failures(spark, sf):
    """What a cap of seven keeps: the failures first seen last."""
    return fl.merge_failures(_obs(spark, sf), cap=7).select("fingerprint", F.unix_micros("first_seen").alias("first_seen"))


NEWEST = f"""WITH {_cte('obs', 'error')}
SELECT fingerprint, epoch_us(min(ts)) AS first_seen FROM obs GROUP BY 1 ORDER BY first_seen DESC, fingerprint LIMIT 7"""


def corrections(spark, sf):
    """Clicks as user corrections, matched to the failure right before them."""
    m = _messages(spark, sf, "click").select("session_id", "seq", "turn", F.concat(F.lit("wrong  "), "message").alias("text"))
    c = fl.corrections(m, _obs(spark, sf))
    return c.select("session_id", "seq", "correction", "fingerprint", "own_fingerprint")


_PK = "[，。；、！？：,.;!?:''\"“”‘’()（）\\[\\]【】{}<>《》`~@#$%^&*+=|\\\\/-]+"
CORRECTIONS = f"""WITH {_cte('obs', 'error')}, {_cte('cli', 'click')},
c AS (SELECT session_id, min(event_id) AS seq, min(dayofyear(ts)) AS turn, 'wrong ' || message AS correction FROM cli GROUP BY session_id, message),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM c),
j AS (SELECT k.session_id, k.seq, k.turn, k.correction, arg_max(o.fingerprint, o.event_id) AS fingerprint, max(dayofyear(o.ts)) AS fturn
  FROM k JOIN obs o ON o.session_id = k.session_id AND o.event_id <= k.seq GROUP BY 1, 2, 3, 4)
SELECT session_id, seq, correction, fingerprint,
  substr(sha1('sem:' || regexp_replace(regexp_replace(lower(correction), '\\s+', '', 'g'), '{_PK}', '', 'g')), 1, 32) AS own_fingerprint
FROM j WHERE turn - fturn <= 1"""


def prevented(spark, sf):
    """Views as warnings after which the failure stayed away for three days."""
    w = _obs(spark, sf, "view").select("session_id", "fingerprint", "turn").distinct()
    last = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.max(F.dayofyear("ts")).alias("last_turn"))
    p = fl.prevented(w, _obs(spark, sf), last)
    return p.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("prevented"))


PREVENTED = f"""WITH {_cte('obs', 'error')}, {_cte('vw', 'view')},
w AS (SELECT DISTINCT session_id, fingerprint, dayofyear(ts) AS turn FROM vw),
l AS (SELECT CAST(user_id AS VARCHAR) AS session_id, max(dayofyear(ts)) AS last_turn FROM events GROUP BY 1)
SELECT fingerprint, count(*) AS prevented FROM w JOIN l USING (session_id) WHERE last_turn >= turn + 3
AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.session_id = w.session_id AND o.fingerprint = w.fingerprint AND dayofyear(o.ts) BETWEEN w.turn AND w.turn + 3) GROUP BY 1"""


def _sessions(spark, sf):
    calls = _messages(spark, sf, "purchase")
    said = _messages(spark, sf, "click").groupBy("session_id").agg(F.max_by("kind", "seq").alias("context"))
    tools = calls.groupBy("session_id").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    return said.join(tools, "session_id", "left").select("session_id", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), "context")


def failure_advice(spark, sf):
    """Warnings and lessons for users as sessions."""
    obs = _obs(spark, sf)
    f = fl.merge_failures(obs, _obs(spark, sf, "signup").select("fingerprint", "ts", "seq").withColumn("remedy", F.lit("do it the other way")))
    hits = obs.select("session_id", "fingerprint").distinct()
    s = _sessions(spark, sf)
    a = fl.advice(s, f, "2024-02-01 00:00:00", hits=hits.join(s.select("session_id"), "session_id", "left_semi"), limit=3)
    return a.select("session_id", "fingerprint", "kind", "rank")


_FAIL_CTES = FAILURES[len("WITH "):FAILURES.index("SELECT fingerprint, tool, template, symptom, n AS occurrences")]
ADVICE = f"""WITH {_FAIL_CTES}, {_cte('cli', 'click')}, {_cte('pu', 'purchase')},
fl AS (SELECT fingerprint, tool, template, n, relapses, ie, CASE WHEN last_type = 'resolve' THEN 'deprecated' WHEN n >= 2 THEN 'validated' ELSE 'draft' END AS status, (SELECT max(ts) FROM obs o WHERE o.fingerprint = x.fingerprint) AS ls FROM x),
cx AS (SELECT session_id, arg_max(regexp_extract(message, '^(.*) at line', 1), event_id) AS context FROM cli GROUP BY 1),
tl AS (SELECT DISTINCT session_id, tool FROM pu),
mt AS (SELECT session_id, fingerprint FROM tl JOIN cx USING (session_id) JOIN fl USING (tool)
  UNION SELECT session_id, fingerprint FROM (SELECT session_id, unnest(list_distinct({tok_sql('context')})) AS tok FROM cx) JOIN
    (SELECT fingerprint, unnest(list_distinct({tok_sql("tool || ' ' || template || ' do it the other way'")})) AS tok FROM fl) USING (tok) GROUP BY 1, 2 HAVING count(*) >= 2),
ht AS (SELECT DISTINCT session_id, fingerprint FROM obs WHERE session_id IN (SELECT session_id FROM cx)),
idle AS (SELECT session_id FROM cx WHERE session_id NOT IN (SELECT session_id FROM tl)),
ca AS (SELECT session_id, fingerprint, max(hit) AS hit FROM (SELECT *, 0 AS hit FROM mt UNION ALL SELECT *, 1 FROM ht UNION ALL SELECT session_id, fingerprint, 0 FROM idle, fl) GROUP BY 1, 2),
al AS (SELECT session_id, fl.fingerprint, 'warning' AS kind, 1 AS o, hit * 1000 + n * 10 + greatest(0.0, 9.0 - (epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(ls)) / 86400000.0) AS sc
    FROM ca JOIN fl USING (fingerprint) WHERE status <> 'deprecated' AND (relapses > 0 OR ie >= 2)
  UNION ALL SELECT session_id, fl.fingerprint, 'lesson', 0, epoch_ms(ls) / 1e15 FROM mt JOIN fl USING (fingerprint) WHERE status = 'deprecated'),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o DESC, sc DESC, fingerprint) AS rank FROM al)
SELECT session_id, fingerprint, kind, rank FROM r WHERE rank <= 3"""


def guard_matches(spark, sf):
    """Purchases as tool calls against guards taken from failed calls."""
    calls = _messages(spark, sf, "purchase").select("session_id", F.col("seq").alias("call_id"), "tool", F.to_json(F.struct(
        F.concat(F.lit("run "), F.col("k").cast("string")).alias("command"))).alias("arguments"))
    g = _messages(spark, sf, "error").select("tool", ef.guard_literal(F.to_json(F.struct(
        F.concat(F.lit("run "), (F.col("k") % 7).cast("string")).alias("command")))).alias("lit")).distinct()
    g = g.select(F.concat("tool", F.lit(":"), "lit").alias("fingerprint"), "tool", F.array("lit").alias("all_of"))
    return fl.guard_matches(calls, g).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("calls"), F.min("call_id").alias("first_call"))


GUARDS = """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
g AS (SELECT DISTINCT 'tool' || (k % 3) AS tool, 'run ' || (k % 7) AS lit FROM e WHERE event_type = 'error')
SELECT g.tool || ':' || lit AS fingerprint, count(*) AS calls, min(event_id) AS first_call
FROM e JOIN g ON 'tool' || (k % 3) = g.tool WHERE event_type = 'purchase' AND contains('{"command":"run ' || k || '"}', lit) GROUP BY 1
"""


def error_rates(spark, sf):
    """Failures per fingerprint and day."""
    return _obs(spark, sf).groupBy("fingerprint", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "fingerprint", F.unix_seconds(F.col("w.start")).alias("day"), "n")


ERROR_RATES = f"""WITH {_cte('obs', 'error')} SELECT fingerprint, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n FROM obs GROUP BY 1, 2"""

QUERIES = {
    "failures": (failures, FAILURES), "failures_in_two_steps": (failures_in_two_steps, FAILURES),
    "failures_all_scopes": (failures_all_scopes, ALL_SCOPES), "failure_episodes": (failure_episodes, FAILURE_EPISODES), "failure_list": (failure_list, FAILURE_LIST),
    "newest_failures": (newest_failures, NEWEST), "corrections": (corrections, CORRECTIONS), "prevented": (prevented, PREVENTED),
    "failure_advice": (failure_advice, ADVICE), "guard_matches": (guard_matches, GUARDS), "error_rates": (error_rates, ERROR_RATES),
}
