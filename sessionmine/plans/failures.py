"""Failures: observe, merge, relapse episodes, corrections, prevention, advice, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import errors as ef, wordlists as wl
from ..functions.redaction import sanitize
from ..functions.text import arr, contains_any, tokens
from ..functions.versions import compatible
from ..operators.joins import join_null_safe, with_partition
from ..operators.ranking import top_per_group
from ..operators.running import running
from ..operators.sizes import hint, is_small, keep

MAX_SESSIONS = 20
SESSION_CHUNK = 4096


def observe(events: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Tool results that are failures, with template and fingerprint.

    The tool's name and arguments come from the call with the same id.  Own denials and
    calls that were never sent are noise.
    """
    calls = events.filter(F.col("type") == "tool/call").groupBy("session_id", "call_id").agg(
        F.max_by(F.struct("tool", "arguments"), "seq").alias("c"))
    failed = (F.coalesce("is_error", F.lit(False)) | F.col("error_name").isNotNull())
    results = events.filter((F.col("type") == "tool/result") & failed).filter(
        ~ef.is_own_denial("error_code", "error_name", "text")
        & ~F.coalesce(F.col("error_code") == wl.ABORTED, F.lit(False)))
    r = results.drop("tool", "arguments").join(calls, ["session_id", "call_id"], "left").select(
        "session_id", "seq", "ts", "turn", F.col("c.tool").alias("tool"), F.col("c.arguments").alias("arguments"),
        "error_name", "error_code", F.col("text").alias("message"))
    return fingerprinted(r, max_chars)


def fingerprinted(rows: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add `template, fingerprint, symptom, guard, trigger` to rows with a `message`."""
    have = set(rows.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    # A generator gives the template out, since a filter on a plain column would go below the
    # step that spreads the rows, and run all patterns there as well.
    t = rows.drop("template").select("*", F.explode_outer(F.array(ef.error_template("message", max_chars))).alias("template"))
    t = t.filter(F.col("template") != "")
    return t.withColumns({
        "fingerprint": ef.fingerprint(col("tool"), col("error_name"), col("error_code"), "template"),
        "symptom": ef.symptom("message"),
        "guard_literal": F.when(col("tool").isin(wl.GUARD_TOOLS), ef.guard_literal(col("arguments"))),
        "trigger": ef.trigger(F.lit(None).cast("string"), col("tool"), col("error_name"), F.col("template"))})


def _scoped(df: DataFrame) -> list[str]:
    return [*[c for c in ("scope", "partition") if c in df.columns], "fingerprint"]


def episodes(history: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Observations with running counts: `occurrences, relapses, in_episode, reopened`.

    `history([scope, partition,] fingerprint, ts, seq, type)` with types observe and resolve.
    A failure right after a resolve opens a new episode; repeated resolves count once.
    """
    history = with_partition(history)
    keys = _scoped(history)
    chunk = F.date_trunc("hour", "ts") if chunk is None else chunk
    seen = (F.col("type") == "observe").cast("long")
    h = running(history, keys, ["ts", "seq"], chunk, sums={"n_before": seen},
                lasts={"before": F.col("type")}, include_current=False)
    h = h.withColumn("occurrences", F.col("n_before") + seen)
    h = h.withColumn("reopened", (F.col("type") == "observe") & (F.col("n_before") > 0)
                     & F.coalesce(F.col("before") == "resolve", F.lit(False)))
    h = running(h, keys, ["ts", "seq"], chunk, sums={"relapses": F.col("reopened").cast("long")},
                lasts={"at_reopen": F.when(F.col("reopened"), F.col("occurrences") - 1)})
    out = h.filter(F.col("type") == "observe")
    n = F.greatest(F.lit(1), F.col("occurrences") - F.coalesce("at_reopen", F.lit(0)))
    return out.withColumn("in_episode", n).drop("before", "n_before", "type")


# What a failure event carries, and the types; stored records are events with counters.
_EVENT = {"tool": "string", "template": "string", "symptom": "string", "remedy": "string", "trigger": "string",
          "guard_literal": "string", "error_name": "string", "session_id": "string", "sessions": "array<string>",
          "n": "long", "first_seen": "timestamp", "last_seen": "timestamp", "relapses": "long", "at_reopen": "long",
          "resolved_at": "timestamp", "occurrences_at_resolve": "long", "last_relapse_at": "timestamp"}
_STORED_AT = "1900-01-01 00:00:00"


def _events(df: DataFrame, kind: str, group: list[str]) -> DataFrame:
    """Rows as events `group, age, ts, seq, type` and `_EVENT`; stored records come first."""
    own = with_partition(df)
    stored = kind == "stored"
    special = {"n": F.col("occurrences").cast("long") if stored else F.lit(1 if kind == "observe" else 0).cast("long")}
    if not stored:
        special |= {c: F.col("ts") if kind == "observe" else F.lit(None).cast("timestamp") for c in ("first_seen", "last_seen")}
        special |= {c: F.lit(None).cast(_EVENT[c]) for c in ("sessions", "relapses", "at_reopen", "resolved_at",
                                                             "occurrences_at_resolve", "last_relapse_at")}
    value = lambda c, t: special[c] if c in special else F.col(c).cast(t) if c in own.columns else F.lit(None).cast(t)
    at = [F.lit(_STORED_AT).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("seq")] if stored else [
        F.col("ts"), F.col("seq").cast("long").alias("seq")]
    return own.filter(F.col("fingerprint").isNotNull()).select(
        *group, F.lit(0 if stored else 1).alias("age"), *at, F.lit(kind).alias("type"),
        *[value(c, t).alias(c) for c, t in _EVENT.items()])


def merge_failures(obs: DataFrame, resolves: DataFrame | None = None, existing: DataFrame | None = None,
                   warn: int = 2, ask: int = 3, block: int = 0, cap: int | None = None,
                   chunk: Column | None = None, max_sessions: int | None = MAX_SESSIONS) -> DataFrame:
    """Failure records from observations, resolve events and stored records.

    A stored record is folded in as the first event of its fingerprint, so merging in steps
    gives what one merge over everything gives. Records are kept per scope and partition
    where the observations have them; a NULL partition is the default one. A resolve of a
    fingerprint that was never seen has no effect. All records stay unless `cap` is given
    (the newest per scope); of the sessions, the last `max_sessions`.

    Returns `fingerprint, tool, template, symptom, remedy, trigger, guard_literal, error_name,
    occurrences, first_seen, last_seen, sessions, relapses, last_relapse_at, at_reopen,
    resolved_at, occurrences_at_resolve, in_episode, enforcement, status`.
    """
    group = _scoped(obs)
    events = _events(obs, "observe", group)
    for df, kind in ((resolves, "resolve"), (existing, "stored")):
        if df is not None:
            events = events.unionByName(_events(df, kind, group))
    events = keep(events)
    order = F.struct("age", "ts", "seq")
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", order)
    resolving = F.col("type") == "resolve"
    said = lambda c: F.coalesce(F.max_by(c, F.when(resolving, given(c))), F.min_by(c, given(c))).alias(c)
    base = events.groupBy(*group).agg(
        F.min_by("tool", F.when(~resolving, order)).alias("tool"), F.min_by("template", F.when(~resolving, order)).alias("template"),
        F.max_by("symptom", F.when(F.col("symptom").isNotNull() & ~resolving, order)).alias("symptom"),
        # The first remedy and trigger hold until a resolve brings its own.
        said("remedy"), said("trigger"), F.min_by("guard_literal", given("guard_literal")).alias("guard_literal"),
        F.min_by("error_name", given("error_name")).alias("error_name"), F.sum("n").alias("occurrences"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).filter("occurrences > 0")
    state = episode_state(events, group, chunk)
    out = join_null_safe(join_null_safe(base, _session_lists(events, group, max_sessions), group, "left"), state, group)
    out = out.withColumns({
        "sessions": arr("sessions"),
        "in_episode": F.greatest(F.lit(1), F.col("occurrences") - F.coalesce("at_reopen", F.lit(0)))})
    out = out.withColumns({
        "enforcement": ef.enforcement("in_episode", warn, ask, block),
        "status": F.when(F.col("resolved_at").isNotNull(), "deprecated").when(F.col("occurrences") >= 2, "validated").otherwise("draft"),
        "remedy": F.coalesce("remedy", F.lit(""))})
    if cap is not None:
        out = top_per_group(out.withColumn("_all", F.lit(0)), ["_all", *group[:-1]],
                            [F.col("first_seen").desc(), F.col("fingerprint")], cap, salt_by=["fingerprint"]).drop("rank", "_all")
    return out


def _session_lists(events: DataFrame, group: list[str], limit: int | None) -> DataFrame:
    """The sessions of each failure in the order in which they first came."""
    own = F.when(F.col("type") == "stored", arr("sessions")).when(F.col("type") == "observe", F.array("session_id"))
    each = events.select(*group, "age", "ts", "seq", F.posexplode(F.filter(own, lambda s: s.isNotNull())).alias("pos", "session_id"))
    firsts = each.groupBy(*group, "session_id").agg(F.min(F.struct("age", "ts", "seq", "pos")).alias("at"))
    if limit is not None:
        firsts = top_per_group(firsts, group, [F.col("at").desc()], limit, "_n", salt_by=["session_id"])
    return firsts.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "session_id"))),
                                                  lambda s: s["session_id"]).alias("sessions"))


def episode_state(events: DataFrame, group: list[str], chunk: Column | None = None) -> DataFrame:
    """Final counters per fingerprint: `relapses, last_relapse_at, at_reopen, resolved_at,
    occurrences_at_resolve`.

    A stored record brings the counters it had; it counts as a resolve where it was resolved.
    `events` may be a plain history `(*group, ts, seq, type)`.
    """
    if "age" not in events.columns:
        events = events.withColumns({
            "age": F.lit(1), "n": (F.col("type") == "observe").cast("long"),
            **{c: F.lit(None).cast(_EVENT[c]) for c in ("relapses", "at_reopen", "resolved_at", "occurrences_at_resolve", "last_relapse_at")}})
    chunk = F.date_trunc("hour", "ts") if chunk is None else chunk
    stored = F.col("type") == "stored"
    h = events.select(*group, "age", "ts", "seq", "type", "n", *[F.col(c).alias(f"s_{c}") for c in (
        "relapses", "at_reopen", "resolved_at", "occurrences_at_resolve", "last_relapse_at")])
    acts_as = F.when(stored, F.when(F.col("s_resolved_at").isNotNull(), "resolve").otherwise("observe")).otherwise(F.col("type"))
    h = running(h, group, ["age", "ts", "seq"], F.when(stored, F.col("ts")).otherwise(chunk), sums={"n_before": F.col("n")},
                lasts={"before": acts_as}, include_current=False)
    h = h.withColumn("upto", F.col("n_before") + F.col("n"))
    h = h.withColumn("reopened", (F.col("type") == "observe") & (F.col("n_before") > 0)
                     & F.coalesce(F.col("before") == "resolve", F.lit(False)))
    order = F.struct("age", "ts", "seq")
    # A resolve before the first failure has nothing to resolve.
    resolve = F.when((F.col("type") == "resolve") & (F.col("upto") > 0), order)
    agg = h.groupBy(*group).agg(
        F.sum(F.col("reopened").cast("long")).alias("_new"), F.max("s_relapses").alias("_old"),
        F.max(F.when(F.col("reopened"), F.col("ts"))).alias("_relapse"), F.max("s_last_relapse_at").alias("_old_relapse"),
        F.max_by(F.col("upto") - 1, F.when(F.col("reopened"), order)).alias("_reopen_n"),
        F.max(F.when(F.col("reopened"), order)).alias("_reopen"),
        F.max(resolve).alias("_resolve"), F.max_by("upto", resolve).alias("_resolve_n"), F.max(order).alias("_last"),
        F.max(F.when(F.col("type") == "observe", order)).alias("_seen"),
        *[F.max(f"s_{c}").alias(f"_s_{c}") for c in ("at_reopen", "resolved_at", "occurrences_at_resolve")])
    # The later of the last resolve and the last reopening decides.
    closed = F.col("_resolve").isNotNull() & ~F.coalesce(F.col("_reopen") > F.col("_resolve"), F.lit(False))
    ends = closed & ~F.coalesce(F.col("_seen") > F.col("_resolve"), F.lit(False))
    return agg.select(
        *group, (F.col("_new") + F.coalesce("_old", F.lit(0))).alias("relapses"),
        F.coalesce("_relapse", "_old_relapse").alias("last_relapse_at"),
        F.when(~closed, F.coalesce("_reopen_n", "_s_at_reopen")).alias("at_reopen"),
        F.when(ends, F.col("_resolve.ts")).when(F.col("_resolve").isNull() & F.col("_seen").isNull(), F.col("_s_resolved_at")).alias("resolved_at"),
        F.coalesce("_resolve_n", "_s_occurrences_at_resolve").alias("occurrences_at_resolve"))


def should_warn(warn: int = 2) -> Column:
    return (F.col("status") != "deprecated") & ((F.coalesce("relapses", F.lit(0)) > 0) | (F.col("in_episode") >= warn))


def failure_list(failures: DataFrame, k: int = 20, resolved: bool = False) -> DataFrame:
    """Most frequent first, then most recent."""
    f = failures if resolved else failures.filter(F.col("status") != "deprecated")
    return f.orderBy(F.col("occurrences").desc(), F.col("last_seen").desc(), F.col("fingerprint")).limit(k)


# ---- corrections and prevention ---------------------------------------------------

def corrections(messages: DataFrame, obs: DataFrame, window: int = 1, markers: list[str] = wl.CORRECTION_MARKERS,
                per_session: int | None = None) -> DataFrame:
    """User corrections with the machine failure they answer.

    `messages(session_id, seq, turn, text)`.  A correction belongs to the last failure
    before it in the session, if that was in the same or the previous turn. `per_session`
    keeps the newest of a session only.
    """
    said = messages.filter(contains_any("text", markers)).select(
        "session_id", "seq", "turn", ef.correction_text("text").alias("correction"), F.lit(None).cast("string").alias("fp"))
    firsts = said.filter(F.col("correction") != "").groupBy("session_id", "correction").agg(
        F.min(F.struct("seq", "turn")).alias("m")).select(
        "session_id", "m.seq", "m.turn", "correction", F.lit(None).cast("string").alias("fp"))
    if per_session is not None:
        firsts = top_per_group(firsts, ["session_id"], [F.col("seq").desc()], per_session, salt_by=["seq"]).drop("rank")
    both = firsts.unionByName(obs.select("session_id", "seq", "turn", F.lit(None).cast("string").alias("correction"),
                                       F.col("fingerprint").alias("fp")))
    seen = running(both, ["session_id"], ["seq"], F.floor(F.col("seq") / SESSION_CHUNK),
                   lasts={"last": F.when(F.col("fp").isNotNull(), F.struct(F.col("fp").alias("fp"), F.col("turn").alias("turn")))})
    hit = seen.filter(F.col("correction").isNotNull() & (F.col("turn") - F.col("last.turn") <= window))
    return hit.select("session_id", "seq", "turn", "correction", F.col("last.fp").alias("fingerprint"),
                      ef.semantic_fingerprint("correction").alias("own_fingerprint"))


def attach_remedies(failures: DataFrame, found: DataFrame) -> DataFrame:
    """The first correction of a failure becomes its remedy where it has none."""
    r = found.groupBy("fingerprint").agg(F.min_by("correction", F.struct("session_id", "seq")).alias("_r"))
    return failures.join(r, "fingerprint", "left").withColumn(
        "remedy", F.when(F.coalesce("remedy", F.lit("")) == "", F.coalesce("_r", F.lit(""))).otherwise(F.col("remedy"))).drop("_r")


def prevented(warnings: DataFrame, obs: DataFrame, sessions: DataFrame, window: int = 3) -> DataFrame:
    """Warnings after which the failure stayed away for `window` turns.

    `warnings(session_id, fingerprint, turn)`, `sessions(session_id, last_turn)`.  Both
    ends of the window count.
    """
    w = warnings.join(sessions, "session_id").filter(F.col("last_turn") >= F.col("turn") + window)
    o = obs.select("session_id", "fingerprint", F.col("turn").alias("o_turn")).distinct()
    return w.join(o, (w["session_id"] == o["session_id"]) & (w["fingerprint"] == o["fingerprint"])
                  & o["o_turn"].between(w["turn"], w["turn"] + window), "left_anti").drop("last_turn")


# ---- advice ------------------------------------------------------------------------

def context_matches(sessions: DataFrame, failures: DataFrame) -> DataFrame:
    """`session_id, fingerprint` where the session used the failure's tool or shares at
    least two words with its trigger and remedy.

    `sessions(session_id, tools, context)`: two equi-joins instead of a condition over
    all pairs.
    """
    return tool_matches(sessions, failures).unionByName(word_matches(sessions, failures)).distinct()


def tool_matches(sessions: DataFrame, failures: DataFrame) -> DataFrame:
    """`session_id, fingerprint` where the session used the failure's tool."""
    return (sessions.select("session_id", F.explode(F.array_distinct("tools")).alias("tool"))
            .join(failures.select("fingerprint", "tool").filter(F.col("tool").isNotNull()), "tool")
            .select("session_id", "fingerprint"))


def word_matches(sessions: DataFrame, failures: DataFrame) -> DataFrame:
    """`session_id, fingerprint` with at least two words in common."""
    text = F.concat_ws(" ", ef.trigger("trigger", "tool", _opt(failures, "error_name"), "template"), F.coalesce("remedy", F.lit("")))
    words = failures.select("fingerprint", F.explode(F.array_distinct(tokens(text))).alias("tok"))
    said = sessions.select("session_id", F.explode(F.array_distinct(tokens("context"))).alias("tok"))
    return (said.join(words, "tok").groupBy("session_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= 2).select("session_id", "fingerprint"))


def tool_heads(failures: DataFrame, score: str, k: int) -> DataFrame:
    """The k first failures of each tool (and stack) by `score`.

    Sessions want the best of all failures of their tools, so what lies behind the head is
    never met with sessions: one tool with most failures costs k rows a session, for each of
    its different stacks.
    """
    keyed = failures.withColumn("_stack", F.to_json("stack") if "stack" in failures.columns else F.lit(None).cast("string"))
    order = [F.col(score).desc(), F.col("fingerprint")]
    return top_per_group(keyed.filter(F.col("tool").isNotNull()), ["tool", "_stack"], order, k, salt_by=["fingerprint"]).drop("_stack", "rank")


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def advice(sessions: DataFrame, failures: DataFrame, now, hits: DataFrame | None = None,
           forgiven: DataFrame | None = None, limit: int = 3, budget: int = 5, warn: int = 2) -> DataFrame:
    """Warnings and lessons per session: `session_id, fingerprint, kind, score, rank, line`;
    `failures` has a row for each fingerprint.

    `sessions(session_id, tools, context[, delivered, stack])`; `hits(session_id,
    fingerprint)` are failures seen in the session.  A session without any tool call sees
    all open failures; those share one ranking, so only its head is attached.
    """
    now = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    age = F.greatest(F.lit(0.0), F.lit(9.0) - (F.unix_millis(now) - F.unix_millis("last_seen")) / F.lit(86_400_000.0))
    failures = keep(failures)
    scored = failures.withColumn("base", F.col("occurrences") * 10 + age)
    open_ = scored.filter(should_warn(warn))
    sessions = keep(sessions)
    by_words = keep(word_matches(sessions, scored))
    forgiven_most = 0
    if forgiven is not None:
        forgiven_most = forgiven.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    first = limit + forgiven_most
    seen = hits.select("session_id", "fingerprint").distinct() if hits is not None else None
    used = by_words.unionByName(tool_matches(sessions, tool_heads(open_, "base", first))).withColumn("hit", F.lit(False))
    if seen is not None:
        used = used.unionByName(seen.withColumn("hit", F.lit(True)))
    used = used.groupBy("session_id", "fingerprint").agg(F.max("hit").alias("hit"))
    idle = sessions.filter(F.size(arr("tools")) == 0).select("session_id")
    spare = forgiven_most
    if seen is not None:
        spare += seen.join(idle, "session_id", "left_semi").groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    if "stack" in sessions.columns and "stack" in failures.columns:
        idle_rows = _idle_by_stack(sessions.filter(F.size(arr("tools")) == 0), open_, limit + spare)
    else:
        head = open_.orderBy(F.col("base").desc(), F.col("fingerprint")).limit(limit + spare).agg(
            F.collect_list("fingerprint")).scalar()
        idle_rows = idle.select("session_id", F.explode(head).alias("fingerprint"))
    idle_rows = idle_rows.withColumn("hit", F.lit(False))
    cand = used.unionByName(idle_rows).groupBy("session_id", "fingerprint").agg(F.max("hit").alias("hit"))
    if forgiven is not None:
        cand = cand.join(forgiven.select("session_id", "fingerprint").distinct(), ["session_id", "fingerprint"], "left_anti")
    small = is_small(failures.select("fingerprint"), 20_000)
    w = cand.join(hint(open_, small), "fingerprint").withColumn(
        "score", F.when(F.col("hit"), 1000).otherwise(0) + F.col("base")).withColumn("kind", F.lit("warning"))
    taught = scored.filter((F.col("status") == "deprecated") & (F.col("remedy") != ""))
    recent = taught.withColumn("_seen", F.unix_millis("last_seen"))
    pairs = by_words.unionByName(tool_matches(sessions, tool_heads(recent, "_seen", first))).distinct()
    lessons = pairs.join(hint(taught, small), "fingerprint")
    lessons = lessons.join(sessions.filter(F.size(tokens("context")) > 0).select("session_id"), "session_id", "left_semi")
    if forgiven is not None:
        lessons = lessons.join(forgiven.select("session_id", "fingerprint").distinct(), ["session_id", "fingerprint"], "left_anti")
    lessons = lessons.withColumn("score", F.unix_millis("last_seen") / F.lit(1e15)).withColumn(
        "kind", F.lit("lesson")).withColumn("hit", F.lit(False))
    every = w.unionByName(lessons.select(w.columns))
    if "stack" in sessions.columns and "stack" in failures.columns:
        every = every.join(sessions.select("session_id", F.col("stack").alias("_cur")), "session_id").filter(
            compatible(F.col("stack"), F.col("_cur"))).drop("_cur")
    order = [(F.col("kind") == "warning").cast("int").desc(), F.col("score").desc(), F.col("fingerprint")]
    ranked = top_per_group(every, ["session_id"], order, limit, salt_by=["fingerprint"])
    if "delivered" in sessions.columns:
        ranked = ranked.join(sessions.select("session_id", "delivered"), "session_id").filter(
            F.col("rank") <= F.greatest(F.lit(0), F.lit(budget) - F.coalesce("delivered", F.lit(0)))).drop("delivered")
    rid = F.concat(F.lit("fa_"), F.col("fingerprint"))
    line = F.when(F.col("kind") == "warning", ef.warning_line(
        "symptom", "remedy", "occurrences", "relapses", "in_episode", "tool", rid)).otherwise(
        ef.lesson_line("symptom", "remedy", ef.trigger("trigger", "tool", _opt(failures, "error_name"), "template"),
                       F.greatest(F.lit(0), F.col("occurrences") - F.col("occurrences_at_resolve")), rid))
    return ranked.select("session_id", "fingerprint", "kind", "score", "rank",
                         sanitize(line, neutral_braces=True).alias("line"))


def _idle_by_stack(idle: DataFrame, open_: DataFrame, k: int) -> DataFrame:
    """`session_id, fingerprint`: the k first open failures that fit each idle session's stack.

    Sessions and failures fall into classes of equal stacks. The head of each failure class
    meets the session classes over languages: a side without languages meets all.
    """
    key = F.coalesce(F.to_json("stack"), F.lit(""))
    order = [F.col("base").desc(), F.col("fingerprint")]
    heads = top_per_group(open_.select("fingerprint", "base", "stack", key.alias("_f")), ["_f"], order, k, salt_by=["fingerprint"])
    classes = idle.select("session_id", key.alias("_s"), "stack")
    stacks = classes.groupBy("_s").agg(F.first("stack").alias("_cur"))
    spoken = lambda c: F.filter(arr(F.col(c)["languages"]), lambda x: x != "")
    theirs = F.when(F.size(spoken("stack")) == 0, F.array(F.lit("*"))).otherwise(F.array_distinct(spoken("stack")))
    ours = F.when(F.size(spoken("_cur")) == 0, F.array(F.lit("any"))).otherwise(
        F.concat(F.transform(F.array_distinct(spoken("_cur")), lambda x: F.concat(F.lit("="), x)), F.array(F.lit("*"))))
    theirs = F.concat(F.transform(theirs, lambda x: F.when(x == "*", x).otherwise(F.concat(F.lit("="), x))), F.array(F.lit("any")))
    met = (heads.withColumn("_on", F.explode(theirs)).join(stacks.withColumn("_on", F.explode(ours)), "_on")
           .filter(compatible(F.col("stack"), F.col("_cur"))).select("_s", "fingerprint", "base").distinct())
    best = top_per_group(met, ["_s"], order, k, salt_by=["fingerprint"]).select("_s", "fingerprint")
    return classes.select("session_id", "_s").join(best, "_s").select("session_id", "fingerprint")


# ---- guards --------------------------------------------------------------------------

def guard_matches(calls: DataFrame, guards: DataFrame) -> DataFrame:
    """Calls that a guard is about: `guards(fingerprint, tool, arg_keys, all_of, pattern)`.

    Guards are few (capped per scope) and joined by tool; their size is checked.
    """
    g = guards.select(F.col("fingerprint"), "tool",
                      *[(F.col(c) if c in guards.columns else F.lit(None).cast(t)).alias(c) for c, t in (
                          ("arg_keys", "array<string>"), ("all_of", "array<string>"), ("pattern", "string"))])
    small = True if g.isStreaming else is_small(g, 20_000)
    args = F.from_json("arguments", "map<string,string>")
    keys_ok = F.col("arg_keys").isNull() | F.forall("arg_keys", lambda k: F.array_contains(F.map_keys(args), k))
    all_ok = F.col("all_of").isNull() | F.forall("all_of", lambda n: F.contains("arguments", n))
    pat_ok = F.col("pattern").isNull() | F.rlike("arguments", F.col("pattern"))
    some = F.col("arg_keys").isNotNull() | F.col("all_of").isNotNull() | F.col("pattern").isNotNull()
    ok = F.coalesce(keys_ok, F.lit(False)) & all_ok & pat_ok & some
    return calls.join(hint(g, small), "tool").filter(ok)
