"""Sessions: events to turns, turns to episodes and facts, reflection decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import wordlists as wl
from ..functions.paths import files_from_arguments, files_from_prose, keep_inside
from ..functions.redaction import (deidentify, identifiers_from_paths, redact, redact_all, scrub_external_paths)
from ..functions.text import (empty, arr, as_col, clip_head, contains_any, head_tail_sizes, sentences, squeeze, tokens)
from ..operators.joins import join_null_safe
from ..operators.ranking import top_per_group
from ..operators.running import running
from ..operators.sizes import keep

CHUNK = 4096  # events of one session handled together
NO_LIMIT = (1 << 31) - 1  # characters; no text is longer


def is_injected(text, source_kind, markers: list[str] = wl.HOST_CONTEXT_MARKERS) -> Column:
    """A user-channel message that a host or plugin put there."""
    kind = F.coalesce(as_col(source_kind), F.lit(""))
    head = F.regexp_replace(F.coalesce(as_col(text), F.lit("")), f"^[{wl.SPACE}]+", "")
    hit = (kind == "plugin") | kind.startswith("plugin:")
    for marker in markers:
        hit = hit | head.startswith(marker)
    return hit


def clipped_texts(messages: DataFrame, keys: list[str], limits: dict[str, int | None]) -> DataFrame:
    """Concatenate `text` per key and role in `seq` order, keeping head and tail; all of it
    where a role has no limit.

    Clipping after every message, as a live capture does, leaves the first 60 % of the
    limit and the end of everything said, so only messages that reach into those two
    stretches are ever gathered, however long a turn is.
    """
    msgs = messages.withColumn("piece", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")))
    msgs = running(msgs, [*keys, "role"], ["seq"], F.floor(F.col("seq") / CHUNK),
                   sums={"upto": F.length("piece").cast("long")}, totals=True)
    limit, head, tail = F.lit(0), F.lit(0), F.lit(0)
    for role, size in limits.items():
        size = NO_LIMIT if size is None else size
        h, t = head_tail_sizes(size)
        is_role = F.col("role") == role
        limit, head, tail = (F.when(is_role, v).otherwise(o) for v, o in ((size, limit), (h, head), (t, tail)))
    size = F.length("piece").cast("long")
    before = F.col("upto") - size
    fits = F.col("upto_total") <= limit
    front_room = F.when(fits, limit).otherwise(head)
    front = F.when(before < front_room, F.expr("substring(piece, 1, int(_front - (upto - length(piece))))"))
    back = F.when(~fits & (F.col("upto") > F.col("upto_total") - tail),
                  F.expr("right(piece, int(least(length(piece), upto - (upto_total - _tail))))"))
    kept = (msgs.withColumn("_front", front_room).withColumn("_tail", tail)
            .withColumn("front", front).withColumn("back", back)
            .filter(F.col("front").isNotNull() | F.col("back").isNotNull()))

    def glue(name: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("seq", name))))
        return F.array_join(F.transform(parts, lambda p: p[name]), "")

    out = kept.groupBy(*keys, "role").agg(glue("front").alias("f"), glue("back").alias("b"),
                                          F.max((~fits).cast("int")).alias("cut"))
    return out.select(*keys, "role", F.when(F.col("cut") == 1, F.concat("f", F.lit("…"), "b"))
                      .otherwise(F.col("f")).alias("clipped"))


def build_turns(events: DataFrame, user_chars: int | None = None, assistant_chars: int | None = None,
                max_turns: int | None = None) -> DataFrame:
    """Session events to turns. Whole texts and all turns, unless limits are given: characters
    of a turn's texts (start and end stay), the newest turns of a session."""
    role = (F.when(F.col("type") == "user/message", "user")
            .when(F.col("type") == "assistant/message", "assistant"))
    said = (events.withColumn("role", role).filter(F.col("role").isNotNull())
            .filter((F.col("role") == "assistant") | ~is_injected("text", "source_kind"))
            .select("session_id", "turn", "seq", "role", "text"))
    texts = clipped_texts(said, ["session_id", "turn"], {"user": user_chars, "assistant": assistant_chars})
    texts = texts.groupBy("session_id", "turn").agg(
        F.max(F.when(F.col("role") == "user", F.col("clipped"))).alias("user"),
        F.max(F.when(F.col("role") == "assistant", F.col("clipped"))).alias("assistant"))
    calls = events.filter(F.col("type") == "tool/call")
    files = keep_inside(files_from_arguments("arguments"), "cwd")
    used = calls.select("session_id", "turn", "seq", F.posexplode(F.concat(
        F.array(F.struct(F.lit("tools").alias("what"), F.col("tool").alias("v"))),
        F.transform(files, lambda f: F.struct(F.lit("files").alias("what"), f.alias("v"))))).alias("pos", "u"))
    firsts = (used.filter(F.col("u.v").isNotNull()).groupBy("session_id", "turn", "u.what", "u.v")
              .agg(F.min(F.struct("seq", "pos")).alias("at")))
    lists = firsts.groupBy("session_id", "turn").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == w, F.struct("at", "v")))),
                    lambda s: s["v"]).alias(w) for w in ("tools", "files")])
    started = events.filter(F.col("turn").isNotNull() & F.col("type").isin(
        "turn/start", "user/message", "assistant/message", "tool/call")).filter(
        (F.col("type") != "user/message") | ~is_injected("text", "source_kind")).select("session_id", "turn").distinct()
    if max_turns is not None:
        started = top_per_group(started, ["session_id"], [F.col("turn").desc()], max_turns, "_back", salt_by=["turn"]).drop("_back")
    return (started.join(texts, ["session_id", "turn"], "left")
            .join(lists, ["session_id", "turn"], "left")
            .select("session_id", "turn", F.coalesce("user", F.lit("")).alias("user"),
                    F.coalesce("assistant", F.lit("")).alias("assistant"),
                    arr("tools").alias("tools"), arr("files").alias("files")))


def turn_text() -> Column:
    """One turn as transcript text."""
    return F.concat_ws("\n", "user", "assistant", F.array_join(arr("files"), " "), F.array_join(arr("tools"), " "))


def cap_transcript(turns: DataFrame, max_chars: int = 24_000) -> DataFrame:
    """Drop the oldest turns until the rest fits; the newest turn always stays.

    A window over the turns of one session; `build_turns(max_turns=...)` bounds them.
    """
    size = F.length(turn_text()) + 1
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (turns.withColumn("_tail", total).withColumn("_back", F.row_number().over(w))
            .filter((F.col("_tail") - 1 <= max_chars) | (F.col("_back") == 1)).drop("_tail", "_back"))


# ---- distillation by marker words ---------------------------------------------

#: Lengths of the display texts and lists of a stored episode, for `distill(limits=...)`.
LIMITS = {"title": 120, "summary": 2000, "item": 400, "items": 20, "files": 40, "tags": 8, "request": 200,
          "result": 240, "process": 8, "named": 3, "named_files": 8}


def classified_sentences(turns: DataFrame, preference: list[str] = wl.PREFERENCE_MARKERS,
                         decision: list[str] = wl.DECISION_MARKERS, todo: list[str] = wl.TODO_MARKERS,
                         max_chars: int | None = None) -> DataFrame:
    """`session_id, category, turn, pos, text`: user sentences with a marker word.

    A sentence goes to the first list it has a marker for, unless that list already has
    it; then to the next one, so a repeated sentence may appear in several lists.
    """
    said = (turns.select("session_id", "turn", F.posexplode(sentences("user")).alias("pos", "s"))
            .withColumn("text", clip_head("s", max_chars or NO_LIMIT))
            .withColumn("p", contains_any("s", preference)).withColumn("d", contains_any("s", decision))
            .withColumn("t", contains_any("s", todo)).filter(F.col("p") | F.col("d") | F.col("t")))
    # Three occurrences per marker combination decide everything; more cannot matter.
    few = top_per_group(said, ["session_id", "text", "p", "d", "t"], [F.col("turn"), F.col("pos")], 3, "_n",
                        salt_by=["turn", "pos"])
    seen = few.groupBy("session_id", "text").agg(F.array_sort(F.collect_list(F.struct(
        F.struct("turn", "pos").alias("at"), "p", "d", "t"))).alias("o"))
    at = lambda cond: F.get(F.filter("o", cond), F.lit(0))["at"]
    seen = seen.withColumn("preference", at(lambda o: o["p"]))
    seen = seen.withColumn("decision", at(lambda o: o["d"] & ~o["at"].eqNullSafe(F.col("preference"))))
    seen = seen.withColumn("todo", at(lambda o: o["t"] & ~o["at"].eqNullSafe(F.col("preference"))
                                      & ~o["at"].eqNullSafe(F.col("decision"))))
    cats = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("at"))
                     for c in ("preference", "decision", "todo")])
    return (seen.select("session_id", "text", F.explode(cats).alias("c")).filter(F.col("c.at").isNotNull())
            .select("session_id", "c.category", "c.at.turn", "c.at.pos", "text"))


def _ordered(name: str, order: str, value: str, cond: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(order, value)))), lambda s: s[value]).alias(name)


def _first(df: DataFrame, keys: list[str], order: list[str], limit: int, salt_by: list[str]) -> DataFrame:
    """The first rows of each group, or all where there is no limit."""
    return df if limit == NO_LIMIT else top_per_group(df, keys, [F.col(c) for c in order], limit, "_n", salt_by=salt_by).drop("_n")


def distill(turns: DataFrame, preference: list[str] = wl.PREFERENCE_MARKERS,
            decision: list[str] = wl.DECISION_MARKERS, todo: list[str] = wl.TODO_MARKERS,
            stacks: DataFrame | None = None, redacted: bool = True,
            limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns to one episode per session and its facts (`session_id, kind, text, turn, pos`).

    Everything found is listed whole, unless `limits` (see `LIMITS`) says how much of each
    text and list is kept.
    """
    most = {name: (limits or {}).get(name, NO_LIMIT) for name in LIMITS}
    turns = keep(turns)
    marked = classified_sentences(turns, preference, decision, todo, most["item"])
    marked = keep(_first(marked, ["session_id", "category"], ["turn", "pos", "text"], most["items"], ["turn", "pos"]))
    at = F.struct("turn", "pos", "text")
    lists = marked.withColumn("n", at).groupBy("session_id").agg(
        _ordered("decisions", "n", "text", F.col("category") == "decision"),
        _ordered("todos", "n", "text", F.col("category") == "todo"))
    base = turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.min_by("user", F.when(F.col("user") != "", F.col("turn"))).alias("request"),
        F.max_by("assistant", F.when(F.col("assistant") != "", F.col("turn"))).alias("result"))
    tools = (turns.select("session_id", "turn", F.posexplode("tools").alias("pos", "tool"))
             .groupBy("session_id", "tool").agg(F.min(F.struct("turn", "pos")).alias("at"))
             .groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tool"))),
                                                    lambda s: s["tool"]).alias("tools")))
    prose = lambda c: F.flatten(F.transform(sentences(c), files_from_prose))
    files = (turns.select("session_id", "turn", F.posexplode(
        F.concat(arr("files"), prose("user"), prose("assistant"))).alias("pos", "file"))
        .groupBy("session_id", "file").agg(F.min(F.struct("turn", "pos")).alias("at")))
    files = _first(files, ["session_id"], ["at", "file"], most["files"], ["file"])
    files = files.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))),
                                                        lambda s: s["file"]).alias("files"))
    e = base.join(lists, "session_id", "left").join(tools, "session_id", "left").join(files, "session_id", "left")
    if stacks is not None:
        e = e.join(stacks.select("session_id", F.col("stack.languages").alias("_langs")), "session_id", "left")
        tags = F.slice(F.transform(arr("_langs"), F.lower), 1, most["tags"])
    else:
        tags = empty()
    request, result = F.coalesce("request", F.lit("")), F.coalesce("result", F.lit(""))
    first = squeeze(F.regexp_extract(request, "^([^\n\r]*)", 1))
    n_tools = F.size(arr("tools"))
    part = lambda cond, *xs: F.when(cond, F.concat(*xs))
    some = lambda c, name: F.array_join(F.slice(arr(c), 1, most[name]), "; ")
    summary = clip_head(F.concat_ws(
        " ",
        F.concat(F.col("n_turns").cast("string"), F.lit(" turns.")),
        part(request != "", F.lit("Asked: "), clip_head(squeeze(request), most["request"])),
        part(n_tools > 0, F.lit("Used: "), some("tools", "process"),
             F.when(n_tools > most["process"], F.concat(F.lit(" (of "), n_tools.cast("string"), F.lit(")"))).otherwise("")),
        part(result != "", F.lit("Ended with: "), clip_head(squeeze(result), most["result"])),
        part(F.size(arr("decisions")) > 0, F.lit("Decided: "), some("decisions", "named")),
        part(F.size(arr("todos")) > 0, F.lit("Left: "), some("todos", "named")),
        part(F.size(arr("files")) > 0, F.lit("Touched: "), some("files", "named_files")),
    ), most["summary"])
    title = F.when(first != "", clip_head(first, most["title"])).otherwise("untitled session")
    episodes = e.select("session_id", title.alias("title"), summary.alias("summary"),
                        arr("decisions").alias("decisions"), arr("todos").alias("todos"),
                        arr("files").alias("files"), tags.alias("tags"), F.lit("rule").alias("source"))
    facts = marked.filter(F.col("category") == "preference").select(
        "session_id", F.lit("preference").alias("kind"), "text", "turn", "pos")
    if redacted:
        episodes = episodes.withColumns({
            **{c: redact(F.col(c)) for c in ("title", "summary")},
            **{c: redact_all(c) for c in ("decisions", "todos", "files", "tags")}})
        facts = facts.withColumn("text", redact("text"))
    return episodes, facts


def clean_for_store(df: DataFrame, text_cols: list[str], list_cols: list[str], identifiers: str, cwd: str) -> DataFrame:
    """Credentials, private identifiers, outside paths: the pipeline before storing."""
    clean = lambda c: scrub_external_paths(deidentify(c, identifiers), cwd)
    return df.withColumns({**{c: clean(F.col(c)) for c in text_cols},
                           **{c: F.transform(F.col(c), clean) for c in list_cols}})


def session_identifiers(turns: DataFrame) -> DataFrame:
    """Private identifiers of a session, from the code files it touched."""
    ids = turns.select("session_id", F.explode(identifiers_from_paths("files")).alias("id")).distinct()
    return ids.groupBy("session_id").agg(F.array_sort(F.collect_list("id")).alias("identifiers"))


def latest_episodes(episodes: DataFrame, cap: int | None = None) -> DataFrame:
    """The last episode per session; with `cap`, the newest of them per scope and partition."""
    cols = episodes.columns
    last = (episodes.groupBy("scope", "partition", "session_id")
            .agg(F.max_by(F.struct(*cols), F.struct("ts", "id")).alias("e")).select("e.*"))
    if cap is None:
        return last
    return top_per_group(last, ["scope", "partition"], [F.col("ts").desc(), F.col("id")], cap).drop("rank")


# ---- reflection ----------------------------------------------------------------

def learning_signal() -> Column:
    return (F.size(arr("files")) > 0) | (F.size(arr("tools")) > 0)


def correction_signal(c="user") -> Column:
    return contains_any(c, wl.CORRECTION_MARKERS)


def new_ground(files: DataFrame, cards: DataFrame, spent: DataFrame | None = None) -> DataFrame:
    """Touched files (`session_id, file`) that no card covers and no reflection was spent on.

    `cards(id, text, symbols)`; a file is covered where a word of its stem is evidence in a card.
    """
    f = files.select("session_id", "file").distinct()
    if spent is not None:
        f = f.join(spent.select("file").distinct(), "file", "left_anti")
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]*)$", 1), r"\.[A-Za-z0-9]{1,8}$", "")
    words = f.withColumn("terms", F.array_distinct(tokens(stem))).filter(F.size("terms") > 0)
    have = evidence_terms(cards).select("term").distinct()
    covered = (words.select("session_id", "file", F.explode("terms").alias("term"))
               .filter(is_evidence("term")).join(have, "term", "left_semi").select("session_id", "file").distinct())
    return words.drop("terms").join(covered, ["session_id", "file"], "left_anti")


def is_evidence(c) -> Column:
    term = as_col(c)
    noise = list(dict.fromkeys(wl.ADVISORY_NOISE + wl.GATE_STOP_WORDS))
    return ~term.isin(noise) & (~term.rlike("^[a-z0-9_]+$") | (F.length(term) >= wl.ADVISORY_MIN_LATIN))


def evidence_words(cards: DataFrame) -> Column:
    """Distinct words of a card's text and symbols (tags prove nothing)."""
    syms = F.array_join(arr("symbols"), " ") if "symbols" in cards.columns else F.lit("")
    return F.array_distinct(F.concat(tokens(F.col("text")), tokens(syms)))


def evidence_terms(cards: DataFrame) -> DataFrame:
    """`id, term`: the evidence words of each card."""
    return cards.select("id", F.explode(evidence_words(cards)).alias("term"))


def reflect_decisions(turns: DataFrame, cards: DataFrame, min_turns: int = 3, threshold: float = 0.15,
                      backoff: DataFrame | None = None, spent: DataFrame | None = None) -> DataFrame:
    """Per session: reflect or not, and why.

    `turns` are those since the last reflection; `backoff(session_id, backoff)` marks
    sessions whose reflections kept coming back empty.
    """
    turns = keep(turns)
    per = turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.max(correction_signal()).alias("correction"),
        F.max(learning_signal()).alias("touched"))
    ground = new_ground(turns.select("session_id", F.explode("files").alias("file")), cards, spent)
    ground = ground.groupBy("session_id").agg(F.count(F.lit(1)).alias("fresh_files"))
    words = turns.select("session_id", F.explode(F.array_distinct(tokens(turn_text()))).alias("tok")).distinct()
    known = cards.select(F.explode(tokens(F.col("text"))).alias("tok")).distinct().withColumn("seen", F.lit(1))
    novel = words.join(known, "tok", "left").groupBy("session_id").agg(
        (F.sum(F.col("seen").isNull().cast("int")) / F.count(F.lit(1))).alias("novelty"))
    out = per.join(ground, "session_id", "left").join(novel, "session_id", "left")
    out = out.join(backoff, "session_id", "left") if backoff is not None else out.withColumn("backoff", F.lit(False))
    fresh = F.coalesce("fresh_files", F.lit(0)) > 0
    novelty = F.coalesce("novelty", F.lit(0.0))
    reason = (F.when(F.col("n_turns") < min_turns, "few_turns")
              .when(~(F.col("touched") | F.col("correction")), "no_signal")
              .when(F.col("correction"), "correction")
              .when(F.coalesce("backoff", F.lit(False)) & ~fresh, "backoff")
              .when(fresh, "new_ground").when(novelty < threshold, "not_novel").otherwise("novel"))
    return out.select("session_id", "n_turns", novelty.alias("novelty"), reason.alias("reason"),
                      reason.isin("correction", "new_ground", "novel").alias("reflect"))


# ---- repeat suppression ----------------------------------------------------------

DELIVERY_TURNS = 256  # turns in a chunk
_NEVER = 1 << 40


def _full(due: Column, x: Column) -> Column:
    return x["changed"] | (x["turn"] >= due)


def delivery_forms(deliveries: DataFrame, every: int = 10) -> DataFrame:
    """Full text or pointer for each delivery (`session_id, item_id, turn, content_hash`,
    optional `epoch` that counts compactions before it).

    Full on the first time, on changed content, again in the same turn, and `every` turns
    after the last full one (`every` <= 0: never for that reason). Of several contents in one
    turn the greatest hash counts; NULL hashes equal each other.

    The turn when the next full text is due depends on earlier choices. So that no task folds
    the whole history of an item, it is cut into chunks of turns: a chunk tells for each
    possible due turn at its start (it lies in the first `every` turns) the due turn at its
    end. These short tables are chained per item, then all chunks are worked out side by side.
    """
    d = deliveries if "epoch" in deliveries.columns else deliveries.withColumn("epoch", F.lit(0))
    keys, width, n = ["session_id", "item_id", "epoch"], max(DELIVERY_TURNS, every), max(every, 1)
    rows = d.groupBy(*keys, F.col("turn").cast("long").alias("turn")).agg(F.max("content_hash").alias("hash"))
    chunks = rows.groupBy(*keys, F.floor(F.col("turn") / width).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "hash"))).alias("xs"))
    before = lambda i: F.get("xs", i - 1)["hash"]
    chunks = keep(chunks.select(
        *keys, "chunk", (F.col("chunk") * width).alias("start"), F.col("xs")[0]["hash"].alias("first_hash"),
        F.element_at("xs", -1)["hash"].alias("last_hash"),
        F.transform("xs", lambda x, i: F.struct(x["turn"].alias("turn"), (
            (i > 0) & ~x["hash"].eqNullSafe(before(i))).alias("changed"))).alias("xs")))

    def after(due: Column, x: Column) -> Column:
        return F.when(_full(due, x), x["turn"] + every if every > 0 else F.lit(_NEVER)).otherwise(due)

    dues = F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("start") + i),
                    F.array(F.lit(_NEVER).cast("long")))
    tables = chunks.select(*keys, F.struct("chunk", "start", "first_hash", "last_hash", F.transform(
        dues, lambda due: F.aggregate("xs", due, after)).alias("ends")).alias("c"))
    lists = tables.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    entry = "array<struct<chunk:bigint,due:bigint>>"
    state = F.struct(F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("due"), F.array().cast(entry).alias("out"))

    def chain(acc: Column, c: Column) -> Column:
        same = (F.size(acc["out"]) > 0) & acc["hash"].eqNullSafe(c["first_hash"])
        due = F.when(same, F.greatest(acc["due"], c["start"])).otherwise(c["start"])
        end = F.get(c["ends"], F.least(due - c["start"], F.lit(n)).cast("int"))
        return F.struct(c["last_hash"].cast("string").alias("hash"), end.alias("due"),
                        F.concat(acc["out"], F.array(F.struct(c["chunk"].alias("chunk"), due.alias("due")))).alias("out"))

    starts = lists.select(*keys, F.explode(F.aggregate("cs", state, chain)["out"]).alias("o")).select(*keys, "o.chunk", "o.due")
    out = join_null_safe(chunks, starts, [*keys, "chunk"])
    flags = F.struct(F.col("due").alias("due"), F.array().cast("array<struct<turn:int,full:boolean>>").alias("out"))
    step = lambda acc, x: F.struct(after(acc["due"], x).alias("due"), F.concat(acc["out"], F.array(F.struct(
        x["turn"].cast("int").alias("turn"), _full(acc["due"], x).alias("full")))).alias("out"))
    done = out.select(*keys, F.explode(F.aggregate("xs", flags, step)["out"]).alias("o"))
    return done.select(*keys, "o.turn", "o.full")
