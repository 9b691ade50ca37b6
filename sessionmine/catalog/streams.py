"""Streams over the event table, run until all of it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import errors as ef
from ..operators.shared import shared_folder
from ..operators.sizes import spread
from ..plans import search
from ..plans.failures import MAX_SESSIONS, fingerprinted
from ..schemas import EVENTS
from ..streaming import library, metrics, stateful, tables, turns, windows
from .common import ERROR_KINDS, benchmark_queries, documents
from .failures import FAILURES, GUARDS, _cte, _messages
from .search import GATE_DECISIONS
from .sessions import WHOLE_TURNS, session_events

SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark, sf) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    s = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, spark) -> DataFrame:
    """Run a stream over all there is and read what it wrote."""
    d = shared_folder(spark)
    q = stream.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{d}/out")


def drain_parts(spark, parts: list[DataFrame], build) -> DataFrame:
    """Let parts arrive one after the other, each in a run of the stream `build(rows)` that
    goes on where the last one ended; read what all runs wrote."""
    d = shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{d}/in")
        out = build(spark.readStream.schema(part.schema).parquet(f"{d}/in"))
        out.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{d}/out")


def _stream_messages(spark, sf, event_type):
    return _as_messages(event_stream(spark, sf).filter(F.col("event_type") == event_type))


def _as_messages(e: DataFrame, *more: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ERROR_KINDS]), (k % 5 + 1).cast("int"))
    return e.select(*more, F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("session_id"), F.dayofyear("ts").alias("turn"), k.alias("k"),
                    F.concat(F.lit("tool"), (k % 3).cast("string")).alias("tool"),
                    F.concat(kind, F.lit(" at line "), k.cast("string"), F.lit(" after "), F.col("value").cast("decimal(10,2)").cast("string"), F.lit(" s")).alias("message"))


def stream_error_rates(spark, sf):
    """Daily failures per fingerprint, for days the watermark has closed."""
    r = windows.error_rates(fingerprinted(_stream_messages(spark, sf, "error")), "1 day")
    return drain(r, spark).select("fingerprint", F.unix_seconds("start").alias("day"), "n")


RATES = f"""WITH {_cte('obs', 'error')}, m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM obs)
SELECT fingerprint, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n FROM obs, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= w GROUP BY 1, 2"""


def stream_failures(spark, sf):
    """Failures kept in a keyed table: three runs of a stream over ten days each, with a signup
    event as the resolve of its message's failure, and the last batch once more."""
    d = shared_folder(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.schema(SCHEMA).parquet(f"{sf}/events.parquet").filter(F.col("event_type").isin("error", "signup"))
    day = F.dayofyear("ts")
    # All sessions stay in the table, so that the last ones can be told in the end.
    table, merge = tables.failure_table(spark, f"{d}/table", buckets=8), tables.failure_merge(max_sessions=None)

    def observed(rows):
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
        kind = F.when(F.col("event_type") == "signup", "resolve").otherwise("observe").alias("type")
        return fingerprinted(_as_messages(rows, "event_type").select("*", kind).drop("event_type"))

    for i, part in enumerate((events.filter(day <= 10), events.filter((day > 10) & (day <= 20)), events.filter(day > 20))):
        spread(part, "event_id").write.mode("append").parquet(f"{d}/in")
        rows = observed(spark.readStream.schema(SCHEMA).parquet(f"{d}/in"))
        tables.change_table(rows, table, merge, f"{d}/cp", "events").trigger(availableNow=True).start().awaitTermination()
    if table.change(observed(part), i, merge, "events"):
        raise RuntimeError("a batch that was written before was written again")
    f = table.read()
    last = F.slice("sessions", -F.least(F.size("sessions"), F.lit(MAX_SESSIONS)), MAX_SESSIONS)
    return f.select("fingerprint", "tool", "occurrences", "relapses", "enforcement", "status", F.array_join(
        F.when(F.size("sessions") > 0, last).otherwise(F.col("sessions")), ",").alias("sessions"),
        F.coalesce("occurrences_at_resolve", F.lit(-1)).alias("at_resolve"))


def logged_failures(spark, sf):
    """Observations logged by a stream, merged into records when read."""
    d = shared_folder(spark)
    obs = windows.failure_observations(_stream_messages(spark, sf, "error"))
    tables.log_batches(obs, f"{d}/log", f"{d}/cp").trigger(availableNow=True).start().awaitTermination()
    f = tables.read_failures(spark, f"{d}/log")
    return f.select("fingerprint", "tool", "occurrences", "enforcement", "status", F.array_join("sessions", ",").alias("sessions"))


S_FAILURES = f"SELECT fingerprint, tool, occurrences, relapses, enforcement, status, sessions, at_resolve FROM ({FAILURES})"
L_FAILURES = FAILURES.replace("UNION ALL SELECT fingerprint, ts, event_id, session_id, 'resolve' FROM res", "")
L_FAILURES = "SELECT fingerprint, tool, occurrences, enforcement, status, sessions FROM (" + L_FAILURES + ")"


def stream_guard_alerts(spark, sf):
    """Purchases as a stream of calls against static guards."""
    calls = _stream_messages(spark, sf, "purchase").select("session_id", F.col("seq").alias("call_id"), "tool", F.to_json(F.struct(
        F.concat(F.lit("run "), F.col("k").cast("string")).alias("command"))).alias("arguments"))
    g = _messages(spark, sf, "error").select("tool", ef.guard_literal(F.to_json(F.struct(
        F.concat(F.lit("run "), (F.col("k") % 7).cast("string")).alias("command")))).alias("lit")).distinct()
    g = g.select(F.concat("tool", F.lit(":"), "lit").alias("fingerprint"), "tool", F.array("lit").alias("all_of"))
    out = drain(windows.guard_alerts(calls, g).select("fingerprint", "call_id"), spark)
    return out.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("calls"), F.min("call_id").alias("first_call"))


def stream_without_repeats(spark, sf):
    """Events that arrive twice, once each."""
    e = event_stream(spark, sf)
    twice = e.unionByName(e)
    return drain(windows.without_repeats(twice).select("event_type", "event_id"), spark).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


NO_REPEATS = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"


def stream_turn_digests(spark, sf):
    """Digests of users' days, closed by a quiet hour."""
    e = event_stream(spark, sf)
    kind = (F.when(F.col("event_type") == "view", "user/message").when(F.col("event_type") == "click", "assistant/message")
            .when(F.col("event_type") == "error", "tool/result").otherwise("tool/call"))
    ev = e.select(F.col("user_id").cast("string").alias("session_id"), F.dayofyear("ts").alias("turn"), "ts", F.col("event_id").alias("seq"), kind.alias("type"),
                  F.col("props").alias("text"), F.lit(None).cast("string").alias("source_kind"), F.col("event_type").alias("tool"), (F.col("event_type") == "error").alias("is_error"))
    out = drain(windows.turn_digests(ev, gap="1 hour"), spark)
    return out.select("session_id", F.col("turn").cast("long").alias("turn"), F.unix_micros("started").alias("started"), "events",
                      "request", "answer", F.array_join("tools", ",").alias("tools"), "errors")


DIGESTS = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, dayofyear(ts) AS turn, ts, event_id, event_type, props FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY session_id, turn ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY session_id, turn ORDER BY ts, event_id) AS sn FROM g),
a AS (SELECT session_id, turn, sn, min(ts) AS started, max(ts) AS ended, count(*) AS events, coalesce(arg_min(props, event_id) FILTER (WHERE event_type = 'view'), '') AS request,
  coalesce(arg_max(props, event_id) FILTER (WHERE event_type = 'click'), '') AS answer, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE event_type IN ('signup', 'purchase'))), ','), '') AS tools,
  count(*) FILTER (WHERE event_type = 'error') AS errors FROM s GROUP BY 1, 2, 3)
SELECT session_id, turn, epoch_us(started) AS started, events, request, answer, tools, errors FROM a
WHERE ended + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
"""


def stream_turns(spark, sf):
    """Whole turns of conversations that arrive in two parts, then end."""
    # All sessions go on at the same time, after the watermark's start.
    ev = session_events(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("seq") + 86_400))
    names = [c.split()[0] for c in EVENTS.split(", ")]
    ev = ev.select(*names)
    ends = ev.groupBy("session_id").agg(F.max("seq").alias("seq")).select("session_id", (F.col("seq") + 1).alias("seq"))
    ends = ends.withColumn("type", F.lit("session/disposed")).withColumn("ts", F.timestamp_seconds(F.col("seq") + 86_400))
    ends = ends.select(*[F.col(c) if c in ends.columns else F.lit(None).cast(ev.schema[c].dataType).alias(c) for c in names])
    out = _stateful(spark, lambda: drain_parts(spark, [ev.filter("seq < 5"), ev.filter("seq >= 5"), ends], turns.stream_turns), False)
    return out.select("session_id", F.col("turn").cast("long").alias("turn"), F.sha1("user").alias("user"), F.sha1("assistant").alias("assistant"),
                      F.array_join("tools", ",").alias("tools"), F.array_join("files", ",").alias("files"))


def _stateful(spark, run, lazy: bool = True) -> DataFrame:
    """Run a stateful stream with the state store it needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drain(run(), spark) if lazy else run()
    finally:
        spark.conf.set(name, old)


def stream_deliveries(spark, sf):
    """Events as deliveries: full or pointer, per user."""
    def run():
        e = event_stream(spark, sf)
        return stateful.deliver_once(e.select(
            F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.dayofyear("ts").alias("turn"), F.lit("delivery").alias("kind"),
            F.col("event_type").alias("item_id"), F.floor(F.dayofyear("ts") / 7).cast("string").alias("content_hash")), every=4)
    out = _stateful(spark, run)
    return out.groupBy("session_id").agg(F.count_if(F.col("form") == "full").alias("full"), F.count_if(F.col("form") == "pointer").alias("pointers"))


DELIVERIES = """
WITH RECURSIVE d AS (SELECT user_id, event_type, event_id, dayofyear(ts) AS turn, CAST(floor(dayofyear(ts) / 7) AS VARCHAR) AS h FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM d),
f AS (SELECT user_id, event_type, i, turn, h, turn AS ft, true AS full FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_type, o.i, o.turn, o.h, CASE WHEN o.h <> f.h OR o.turn = f.ft OR o.turn - f.ft >= 4 THEN o.turn ELSE f.ft END,
    (o.h <> f.h OR o.turn = f.ft OR o.turn - f.ft >= 4) FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.i = f.i + 1)
SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (WHERE "full") AS "full", count(*) FILTER (WHERE NOT "full") AS pointers FROM f GROUP BY 1
"""


BUDGET, ADVISORIES, FIRST = 5, 6, 2


def stream_warnings(spark, sf):
    """Clicks as warnings, errors as their repeats, views as advisories, purchases as first
    contacts until a signup consults the library: what each user is sent."""
    def run():
        e = event_stream(spark, sf)
        k = F.get_json_object("props", "$.k").cast("int")
        t = F.col("event_type")
        kind = (F.when(t == "click", "once").when(t == "error", "repeat").when(t == "view", "advisory")
                .when(t == "purchase", "first_contact").when(k % 10 == 0, "consulted").otherwise("compaction"))
        item = F.when(t.isin("click", "error"), F.concat(F.lit("w"), (k % 9).cast("string"))).otherwise(F.concat(F.lit("a"), (k % 12).cast("string")))
        return stateful.deliver_once(e.select(
            F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.dayofyear("ts").alias("turn"), kind.alias("kind"),
            item.alias("item_id"), F.lit("").alias("content_hash")), budget=BUDGET, advisories=ADVISORIES, first_contacts=FIRST)
    return _stateful(spark, run).select("session_id", "seq", F.col("turn").cast("long").alias("turn"), "item_id", "form")


WARNINGS = f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, dayofyear(ts) AS turn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
  CASE event_type WHEN 'click' THEN 'once' WHEN 'error' THEN 'repeat' WHEN 'view' THEN 'advisory' WHEN 'purchase' THEN 'first_contact'
    ELSE CASE WHEN k % 10 = 0 THEN 'consulted' ELSE 'compaction' END END AS kind,
  CASE WHEN event_type IN ('click', 'error') THEN 'w' || (k % 9) ELSE 'a' || (k % 12) END AS item
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS sent, CAST([] AS VARCHAR[]) AS again, CAST([] AS VARCHAR[]) AS adv,
    0 AS firsts, CAST(-1 AS BIGINT) AS lt, false AS consulted, CAST(NULL AS VARCHAR) AS form FROM o
  UNION ALL SELECT user_id, i, CASE WHEN w AND NOT known THEN list_append(sent, item) ELSE sent END,
    CASE WHEN w THEN list_filter(again, lambda x: x <> item) WHEN kind = 'repeat' AND known THEN list_append(again, item) ELSE again END,
    CASE WHEN a THEN list_append(adv, item) ELSE adv END, firsts + CASE WHEN a AND kind = 'first_contact' THEN 1 ELSE 0 END,
    CASE WHEN a THEN turn ELSE lt END, consulted OR kind = 'consulted', CASE WHEN w AND known THEN 'again' WHEN w THEN 'once' WHEN a THEN kind END
  FROM (SELECT f.user_id, o.i, o.item, o.kind, o.turn, f.sent, f.again, f.adv, f.firsts, f.lt, f.consulted, list_contains(f.sent, o.item) AS known,
      o.kind = 'once' AND (NOT list_contains(f.sent, o.item) OR list_contains(f.again, o.item)) AND len(f.sent) < {BUDGET} AS w,
      o.kind IN ('advisory', 'first_contact') AND NOT (o.kind = 'first_contact' AND (f.consulted OR f.firsts >= {FIRST})) AND len(f.adv) < {ADVISORIES}
        AND f.lt <> o.turn AND NOT list_contains(f.adv, o.item) AS a
    FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT CAST(user_id AS VARCHAR) AS session_id, o.event_id AS seq, o.turn, o.item AS item_id, f.form FROM f JOIN o USING (user_id, i) WHERE f.form IS NOT NULL
"""


def stream_prevention(spark, sf):
    """Views as warnings, errors as failures, signups as turn ends."""
    def run():
        e = event_stream(spark, sf).filter(F.col("event_type").isin("view", "error", "signup"))
        k = F.get_json_object("props", "$.k").cast("int")
        return stateful.settle_prevention(e.select(
            F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.dayofyear("ts").alias("turn"),
            F.when(F.col("event_type") == "view", "warning").when(F.col("event_type") == "error", "observe").otherwise("turn_end").alias("kind"),
            F.concat(F.lit("f"), (k % 15).cast("string")).alias("fingerprint")))
    return _stateful(spark, run).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("prevented"))


# A warning points to what comes after it: the turn end that settles it, or the failure that
# closes it; the warning that opens next stands behind that.
PREVENTION = """WITH RECURSIVE e AS (SELECT user_id AS s, event_id AS seq, dayofyear(ts) AS turn, event_type AS kind,
  'f' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 15 AS VARCHAR) AS fp FROM events WHERE event_type IN ('view', 'error', 'signup')),
w AS (SELECT s, fp, seq, turn, (SELECT min(o.seq) FROM e o WHERE o.kind = 'error' AND o.s = v.s AND o.fp = v.fp AND o.seq > v.seq) AS closed,
  (SELECT max_by(o.turn, o.seq) FROM e o WHERE o.kind = 'error' AND o.s = v.s AND o.fp = v.fp AND o.seq < v.seq) AS last,
  (SELECT min(t.seq) FROM e t WHERE t.kind = 'signup' AND t.s = v.s AND t.seq > v.seq AND t.turn >= v.turn + 3) AS ended FROM e v WHERE kind = 'view'),
x AS (SELECT *, ended IS NOT NULL AND (closed IS NULL OR ended < closed) AND coalesce(last, -1) < turn AS prevented FROM w),
p AS (SELECT *, (SELECT min(n.seq) FROM e n WHERE n.kind = 'view' AND n.s = x.s AND n.fp = x.fp AND n.seq > CASE WHEN prevented THEN ended ELSE closed END) AS next FROM x),
r AS (SELECT p.* FROM p JOIN (SELECT s, fp, min(seq) AS seq FROM p GROUP BY 1, 2) USING (s, fp, seq)
  UNION ALL SELECT p.* FROM r JOIN p ON p.s = r.s AND p.fp = r.fp AND p.seq = r.next)
SELECT fp AS fingerprint, count(*) AS prevented FROM r WHERE prevented GROUP BY 1"""


def _reflection_rows(e: DataFrame) -> DataFrame:
    """Purchases as turn ends, errors as results; users share three libraries."""
    k = F.get_json_object("props", "$.k").cast("int")
    return e.filter(F.col("event_type").isin("purchase", "error")).select(
        F.concat(F.lit("l"), (F.col("user_id") % 3).cast("string")).alias("library"),
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.dayofyear("ts").alias("turn"),
        F.when(F.col("event_type") == "purchase", "turn_end").otherwise("result").alias("kind"), (k % 2 == 0).alias("signal"), (k % 50 == 0).alias("correction"),
        (k / 100).alias("novelty"), (k % 10 == 0).alias("new_ground"), F.when(k % 4 == 0, k % 3).otherwise(0).alias("created"), (k % 5).alias("merged"))


def stream_reflection(spark, sf):
    """When to reflect, with back-off by the user's own results."""
    out = _stateful(spark, lambda: stateful.reflect_trigger(_reflection_rows(event_stream(spark, sf)), backoff_after=BACKOFF))
    return out.select("session_id", F.col("turn").cast("long").alias("turn"), F.col("fresh_turns").cast("long").alias("fresh_turns"), "reason", "reflect")


def _library_run(spark, sf):
    """Three runs of the first stage, ten days each: the table and the folder of rows."""
    d = shared_folder(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.schema(SCHEMA).parquet(f"{sf}/events.parquet")
    day, counters = F.dayofyear("ts"), library.library_table(spark, f"{d}/table", buckets=4)
    for part in (events.filter(day <= 10), events.filter((day > 10) & (day <= 20)), events.filter(day > 20)):
        part.write.mode("append").parquet(f"{d}/in")
        rows = _reflection_rows(spark.readStream.schema(SCHEMA).parquet(f"{d}/in"))
        library.share_streaks(rows, counters, f"{d}/rows", f"{d}/cp", backoff_after=BACKOFF).trigger(availableNow=True).start().awaitTermination()
    return counters, f"{d}/rows"


def stream_shared_reflection(spark, sf):
    """When to reflect, with back-off by the results of all users of a library."""
    _, path = _library_run(spark, sf)
    schema = spark.read.parquet(path).drop("batch").schema

    def run():
        return stateful.reflect_trigger(spark.readStream.schema(schema).parquet(path), backoff_after=BACKOFF, shared_streak=True)
    out = _stateful(spark, run)
    return out.select("session_id", F.col("turn").cast("long").alias("turn"), F.col("fresh_turns").cast("long").alias("fresh_turns"), "reason", "reflect")


def library_counters(spark, sf):
    """What a library's reflections have led to after three runs of the stream."""
    return _library_run(spark, sf)[0].read().drop("bucket")


def run_metrics(spark, sf):
    """Counters of a run: the decisions of a gated search, and a stream of purchases as advisories."""
    d = shared_folder(spark)
    heard = metrics.RunMetrics(spark, f"{d}/metrics")
    spark.streams.addListener(heard)
    try:
        decisions = search.search(benchmark_queries(spark, sf), documents(spark, sf), gate=2, decisions=True)
        heard.counted(decisions, "gate", lambda df: df.write.parquet(f"{d}/decisions"))
        query = metrics.observed(event_stream(spark, sf).filter("event_type = 'purchase'"), "advisories").writeStream.format("parquet")
        query = query.option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        heard.wait(query)
    finally:
        spark.streams.removeListener(heard)
    heard.flush()
    return metrics.snapshot(spark, heard.path, _library_run(spark, sf)[0].read())


BACKOFF = 2


def _reflection_sql(shared: bool) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT user_id, 'l' || (user_id % 3) AS library, event_id, ts, dayofyear(ts) AS turn, event_type = 'error' AS res, k, CASE WHEN k % 4 = 0 THEN k % 3 ELSE 0 END AS created
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type IN ('purchase', 'error')),
g AS (SELECT *, count(*) FILTER (WHERE res AND created > 0) OVER (PARTITION BY {'library' if shared else 'user_id'} ORDER BY ts, event_id) AS run FROM e),
s AS (SELECT *, count(*) FILTER (WHERE res AND created = 0) OVER (PARTITION BY {'library' if shared else 'user_id'}, run ORDER BY ts, event_id) AS streak FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM s WHERE NOT res),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 0 AS fresh, false AS sig, false AS cor, false AS gro, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS turn, 0 AS shown FROM o
  UNION ALL SELECT user_id, i, CASE WHEN ok THEN 0 ELSE n END, NOT ok AND sg, NOT ok AND co, NOT ok AND gr, reason, turn, n
  FROM (SELECT *, reason IN ('correction', 'new_ground', 'novel') AS ok FROM (
    SELECT *, CASE WHEN n < 3 THEN 'few_turns' WHEN NOT (sg OR co) THEN 'no_signal' WHEN co THEN 'correction' WHEN streak >= {BACKOFF} AND NOT gr THEN 'backoff'
      WHEN gr THEN 'new_ground' WHEN k / 100 >= 0.15 THEN 'novel' ELSE 'not_novel' END AS reason
    FROM (SELECT o.user_id, o.i, o.k, o.streak, o.turn, f.fresh + 1 AS n, f.sig OR o.k % 2 = 0 AS sg, f.cor OR o.k % 50 = 0 AS co, f.gro OR o.k % 10 = 0 AS gr
      FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))))
SELECT CAST(user_id AS VARCHAR) AS session_id, turn, CAST(shown AS BIGINT) AS fresh_turns, reason, reason IN ('correction', 'new_ground', 'novel') AS reflect FROM f WHERE i > 0"""


LIBRARY_CTES = """WITH r AS (SELECT 'l' || (user_id % 3) AS library, event_id, ts, CASE WHEN k % 4 = 0 THEN k % 3 ELSE 0 END AS created, k % 5 AS merged
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type = 'error'),
n AS (SELECT *, max(CASE WHEN created > 0 THEN event_id END) OVER (PARTITION BY library) AS last_new FROM r),
c AS (SELECT library, count(*) AS reflections, CAST(0 AS BIGINT) AS skipped, CAST(sum(created) AS BIGINT) AS new_cards, CAST(sum(merged) AS BIGINT) AS duplicate_cards,
  count(*) FILTER (WHERE event_id > coalesce(last_new, -1)) AS empty_streak FROM n GROUP BY 1)"""
COUNTERS = f"{LIBRARY_CTES} SELECT *, empty_streak >= {BACKOFF} AS backoff FROM c"
RUN_METRICS = f"""{LIBRARY_CTES}, t AS (SELECT CAST(sum(reflections) AS BIGINT) AS reflections, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(new_cards) AS BIGINT) AS new_cards,
  CAST(sum(duplicate_cards) AS BIGINT) AS duplicate_cards, max(empty_streak) AS empty_streak, bool_or(empty_streak >= {BACKOFF}) AS backoff FROM c),
d AS ({GATE_DECISIONS})
SELECT t.*, CAST(0 AS BIGINT) AS injections, (SELECT count(*) FILTER (WHERE kept) FROM d) AS gate_kept, (SELECT count(*) FILTER (WHERE NOT kept) FROM d) AS gate_dropped,
  (SELECT count(*) FROM events WHERE event_type = 'purchase') AS advisories FROM t"""

QUERIES = {
    "stream_error_rates": (stream_error_rates, RATES), "stream_failures": (stream_failures, S_FAILURES),
    "logged_failures": (logged_failures, L_FAILURES), "stream_turns": (stream_turns, WHOLE_TURNS), "stream_warnings": (stream_warnings, WARNINGS),
    "stream_guard_alerts": (stream_guard_alerts, GUARDS), "stream_without_repeats": (stream_without_repeats, NO_REPEATS),
    "stream_turn_digests": (stream_turn_digests, DIGESTS), "stream_deliveries": (stream_deliveries, DELIVERIES),
    "stream_prevention": (stream_prevention, PREVENTION), "stream_reflection": (stream_reflection, _reflection_sql(False)),
    "stream_shared_reflection": (stream_shared_reflection, _reflection_sql(True)), "library_counters": (library_counters, COUNTERS),
    "run_metrics": (run_metrics, RUN_METRICS),
}
