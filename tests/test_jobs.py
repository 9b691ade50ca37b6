"""Session, fact, card and failure jobs on small tables, against straight folds in Python."""

import random

from pyspark.sql import Window, functions as F

from sessionmine import schemas
from sessionmine.operators import leak, rewrite
from sessionmine.operators.ranking import top_per_group
from sessionmine.operators.running import running
from sessionmine.plans import cards as pc, facts as pf, failures as fl, sessions as ps

T = lambda n: f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}"


def events(spark, rows):
    names = [f.split()[0] for f in schemas.EVENTS.split(", ")]
    base = {"session_id": "s", "cwd": "/ws", "is_error": False}
    out = []
    for i, r in enumerate(rows):
        out.append(tuple({**base, "seq": i, **r}.get(n) for n in names))
    df = spark.createDataFrame(out, schemas.EVENTS.replace("ts TIMESTAMP", "ts STRING"))
    return df.withColumn("ts", F.coalesce("ts", F.concat(F.lit("2024-01-01 00:00:"), F.lpad(F.col("seq").cast("string"), 2, "0"))).cast("timestamp"))


def test_top_per_group_with_a_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5)).withColumn("v", F.xxhash64("id"))
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    want = df.withColumn("rank", F.row_number().over(w)).filter("rank <= 7")
    got = top_per_group(df, ["g"], [F.col("v").desc()], 7)
    assert sorted(got.collect()) == sorted(want.collect())


def test_running_equals_plain_windows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), i, rnd.randint(0, 5), rnd.choice([None, f"x{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, n long, v string")
    w = Window.partitionBy("k").orderBy("i")
    for inclusive, end in ((True, 0), (False, -1)):
        f = w.rowsBetween(Window.unboundedPreceding, end)
        want = df.withColumn("s", F.coalesce(F.sum("n").over(f), F.lit(0))).withColumn("l", F.last("v", True).over(f))
        got = running(df, ["k"], ["i"], F.floor(F.col("i") / 7), {"s": F.col("n")}, {"l": F.col("v")}, inclusive, totals=False)
        assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)


def _live_clip(parts, limit):
    text = ""
    for p in parts:
        text = f"{text}{p}\n"
        if len(text) > limit:
            head = max(1, limit * 6 // 10)
            text = text[:head] + "…" + text[len(text) - max(1, limit - head - 1):]
    return text


def test_turns(spark):
    rnd = random.Random(2)
    said = ["".join(rnd.choices("abc de", k=rnd.randint(0, 90))) for _ in range(40)]
    rows = [{"type": "turn/start", "turn": 1}, {"type": "user/message", "turn": 1, "text": "noise", "source_kind": "plugin:x"}]
    rows += [{"type": "user/message", "turn": 1, "text": t} for t in said]
    rows += [{"type": "tool/call", "turn": 1, "tool": t, "arguments": a} for t, a in (
        ("edit", '{"file_path": "/ws/src/a.ts"}'), ("read", '{"path": "/etc/passwd"}'), ("edit", '{"path": "b.ts"}'))]
    rows += [{"type": "assistant/message", "turn": 1, "text": "short"}, {"type": "user/message", "turn": 2, "text": "next"}]
    t = {r.turn: r for r in ps.build_turns(events(spark, rows), user_chars=300).collect()}
    assert t[1].user == _live_clip(said, 300) and t[1].assistant == "short\n"
    assert (t[1].tools, t[1].files) == (["edit", "read"], ["src/a.ts", "b.ts"]) and t[2].user == "next\n"
    assert [r.turn for r in ps.build_turns(events(spark, rows), max_turns=1).collect()] == [2]


def test_distill_and_facts(spark):
    t = spark.createDataFrame([
        ("s", 1, "我喜欢用 pnpm，不要用 npm。请帮我改一下 src/store.ts 文件。下一步还要补测试。", "好的，我修改了 src/store.ts 并新增了 test/store.test.ts 。", ["read_file", "edit_file"], ["src/store.ts"]),
        ("s", 2, "决定就用 JSONL 存情景层。", "已按 JSONL 落盘。", [], [])], schemas.TURNS)
    e, f = ps.distill(t)
    e, f = e.first(), f.collect()
    assert [x.text for x in f] == ["我喜欢用 pnpm，不要用 npm"] and e.decisions == ["决定就用 JSONL 存情景层"]
    assert e.todos == ["下一步还要补测试"] and e.files == ["src/store.ts", "test/store.test.ts"]
    assert e.title.startswith("我喜欢用 pnpm") and "Used: read_file; edit_file" in e.summary and "Ended with: 已按 JSONL 落盘。" in e.summary


def test_repeated_sentence_moves_to_the_next_list(spark):
    t = spark.createDataFrame([("s", 1, "必须决定这件事。必须决定这件事。必须决定这件事。", "", [], [])], schemas.TURNS)
    got = ps.classified_sentences(t).collect()
    assert sorted((r.category, r.pos) for r in got) == [("decision", 1), ("preference", 0)]


def drafts_of(spark, rows):
    return spark.createDataFrame(rows, "scope string, partition string, kind string, text string, session_id string, tags array<string>, ts string, seq long").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def test_merge_facts_in_two_steps_equals_one(spark):
    rows = [("global", "p", "fact", f"Use  pnpm{'!' * (i % 2)}", f"s{i % 25}", [f"t{i % 3}"], T(i), i) for i in range(60)] + [("global", "p", "fact", "other", "s1", [], T(1), 1)]
    one = pf.merge_facts(drafts_of(spark, rows)).orderBy("key").collect()
    two = pf.merge_facts(drafts_of(spark, rows[30:]), pf.merge_facts(drafts_of(spark, rows[:30]))).orderBy("key").collect()
    assert [(r.key, r.text, r.hits, r.tags) for r in one] == [(r.key, r.text, r.hits, r.tags) for r in two]
    assert len(one) == 2 and one[1].hits == 60 and one[1].sources == [f"s{i}" for i in range(5, 25)]


def test_supersede(spark):
    f = pf.merge_facts(drafts_of(spark, [("g", "p", "preference", "use npm", "s", [], T(0), 0), ("g", "p", "preference", "use pnpm", "s", [], T(1), 1)]))
    by = {r.text: r.id for r in f.collect()}
    pairs = spark.createDataFrame([(by["use npm"], by["use pnpm"]), (by["use pnpm"], by["use pnpm"]), ("nope", by["use npm"])], "old_id string, new_id string")
    out = {r.text: r.superseded_by for r in pf.supersede(f, pairs).collect()}
    assert out == {"use npm": by["use pnpm"], "use pnpm": None}
    assert [r.text for r in pf.standing_rules(pf.supersede(f, pairs)).collect()] == ["use pnpm"]


def card_drafts(spark, rows):
    names = ["scope", "partition", "session_id", "seq", "ts", "kind", "status", "sensitivity", "name", "gist", "when", "summary", "steps", "subject", "location", "reuse",
             "applies_to", "invariants", "api", "example", "pitfalls", "verify", "stack", "domain", "tags", "evidence", "provenance"]
    base = dict(scope="global", partition="d", session_id="s1", seq=0, ts="2024-01-01", kind="procedure", name="n", when="w", summary="x", stack=(None, ["java"], None, None, None, None, None, None))
    df = spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.CARD_DRAFTS.replace("ts TIMESTAMP", "ts STRING"))
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_merge_cards(spark):
    d = card_drafts(spark, [
        dict(seq=1, summary="abc", tags=["a", "b"], steps=["1"], api=[("X.y", None, "first")], sensitivity="internal", session_id="s1"),
        dict(seq=2, summary="xyz", tags=["b", "c"], gist="g2", status="validated", sensitivity="confidential", api=[("X.y", None, "second"), ("Z.q", None, None)], session_id="s2",
             stack=(None, ["java", "kotlin"], None, None, None, {"k": "2"}, None, None)),
        dict(seq=3, summary="longer", gist="g3", session_id="s2", stack=(None, ["java"], None, None, None, {"k": "3"}, None, "gradle")),
        dict(seq=4, name="N!", when="W", summary="zz"), dict(seq=5, name="other", when="w"), dict(seq=6, name=" ", when="w")])
    out = {r["name"]: r for r in pc.merge_cards(d).collect()}
    m = out["n"]
    assert (m.summary, m.status, m.sensitivity, m.gist, m.hits, m.merged, m.created) == ("longer", "validated", "confidential", "g2", 4, 3, True)
    assert m.tags == ["a", "b", "c"] and [(a.symbol, a.notes) for a in m.api] == [("X.y", "first"), ("Z.q", None)]
    assert [e.session_id for e in m.evidence] == ["s1", "s2"] and m.stack.languages == ["java", "kotlin"] and m.stack.versions == {"k": "3"} and m.stack.build_tool == "gradle"
    assert set(out) == {"n", "other"}
    again = {r["name"]: r for r in pc.merge_cards(card_drafts(spark, [dict(seq=1, summary="tiny", tags=["z"])]), pc.merge_cards(d)).collect()}
    assert (again["n"].hits, again["n"].summary, again["n"].created, again["n"].tags) == (5, "longer", False, ["a", "b", "c", "z"])


def test_evict_and_conflicts(spark):
    d = card_drafts(spark, [dict(seq=i, name=f"n{i}", when="same trigger", ts=f"2024-01-{i + 1:02d}") for i in range(12)])
    m = pc.merge_cards(d, cap=None)
    kept = pc.evict_cards(m.withColumn("successes", F.when(F.col("name") == "n0", 1).otherwise(0)).withColumn("created", F.col("name") == "n1"), 3)
    assert {r["name"] for r in kept.collect()} == {"n0", "n1", "n11"}
    c = pc.conflicts(m).collect()
    assert len(c) == 12 and all(len(r.conflicts_with) == 8 and r.id not in r.conflicts_with for r in c)


def _fold_outcomes(status, code, outs):
    rank = ["draft", "validated", "canonical", "deprecated"]
    s = f = 0
    for outcome, self_made in outs:
        s += outcome == "success" and not self_made
        f += outcome == "failure"
        if f >= 2 and f > s:
            status = "deprecated"
            continue
        p = "canonical" if s >= 3 and f == 0 and code else "validated" if s >= 1 else "draft"
        status = p if rank.index(p) > rank.index(status) else status
    return status, s, f


def test_outcomes_equal_a_fold(spark):
    rnd = random.Random(3)
    cards, outs, want = [], [], {}
    for c in range(30):
        code = c % 2 == 0
        cards.append((f"c{c}", "draft", [("code", None, None, None, None)] if code else [], 0, 0, 0, None, None, None, None))
        seq = [(rnd.choice(["success", "success", "failure"]), rnd.random() < 0.2) for _ in range(rnd.randint(0, 6))]
        outs += [(f"c{c}", f"s{i}", o, "saw 12 of 12 pass", T(i * 50), sm) for i, (o, sm) in enumerate(seq)]
        want[f"c{c}"] = _fold_outcomes("draft", code, seq)
    base = spark.createDataFrame(cards, f"id string, status string, evidence {schemas.EVIDENCE}, applied long, successes long, failures long, archived_at timestamp, "
                                 f"last_verified_at timestamp, updated_at timestamp, verifications {schemas.VERIFICATIONS}")
    o = spark.createDataFrame(outs + [("c0", "x", "success", "works", T(3000), False)], schemas.OUTCOMES.replace("at TIMESTAMP", "at STRING")).withColumn("at", F.col("at").cast("timestamp"))
    got = {r.id: (r.status, r.successes, r.failures) for r in pc.apply_outcomes(base, o, chunk=F.date_trunc("minute", "at")).collect()}
    assert got == want


def test_references_and_advice(spark):
    cards = spark.createDataFrame([("a", ["ItemStack.getOrDefault"], "enchantment order text", "2024-01-01"), ("b", ["registerAll"], "enchantment cooldown", "2024-01-02")],
                                  "id string, symbols array<string>, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    calls = spark.createDataFrame([
        ("s", "c0", 0, "edit", '{"path": "x.ts", "t": "registerAllNow"}', False), ("s", "c1", 5, "edit", '{"path": "GTEnchantment.ts", "n": "stack.getOrDefault(1)"}', True),
        ("s", "c2", 6, "edit", '{"path": "GTEnchantment.ts", "n": "stack.getOrDefault(1)"}', False), ("s", "c3", 7, "edit", '{"path": "GTEnchantment.ts"}', False)],
        "session_id string, call_id string, seq long, tool string, arguments string, is_error boolean")
    n = pc.needles(cards)
    shown = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], "session_id string, id string, seq long")
    r = pc.references(shown, calls, n).collect()
    assert [(x.id, x.call_id, x.needle) for x in r] == [("a", "c2", "getOrDefault")]
    adv = {x.call_id: (x.id, x.exact) for x in pc.advise(calls, cards, pc.precise_cards(calls, n)).collect()}
    assert adv["c2"] == ("a", 1) and adv["c3"] == ("a", 1)
    assert {x.call_id: x.id for x in pc.advise(calls, cards).collect()}["c3"] == "b"


def test_restatements(spark):
    lib = spark.createDataFrame([("l1", "alpha beta gamma delta eps"), ("l2", "one two three four")], "id string, text string")
    d = spark.createDataFrame([("d1", "alpha beta gamma zeta", "s"), ("d2", "one two nine ten", "s"), ("d3", "fresh words here", "s")], "id string, text string, session_id string")
    read = spark.createDataFrame([("s", "l2")], "session_id string, id string")
    kept, dropped = pc.drop_restatements(d, lib, read)
    assert {r.id for r in kept.collect()} == {"d3"} and {(r.id, r.restates) for r in dropped.collect()} == {("d1", "library"), ("d2", "session")}


def test_failures_from_events(spark):
    rows = []
    for i, (text, err) in enumerate([("Cannot find module 'a'", True), ("Cannot find module 'b'", True), ("fine", False), ("x MEMORY_LAYER_FAILURE_GUARD y", True), ("  ", True)]):
        rows += [{"type": "tool/call", "turn": i, "call_id": f"c{i}", "tool": "bash", "arguments": '{"command": "npm run x"}'},
                 {"type": "tool/result", "turn": i, "call_id": f"c{i}", "text": text, "is_error": err}]
    rows.append({"type": "tool/result", "turn": 9, "call_id": "zz", "text": "boom", "is_error": True, "error_code": "ABORTED_BEFORE_DISPATCH"})
    obs = fl.observe(events(spark, rows))
    f = fl.merge_failures(obs).collect()
    assert [(r.tool, r.template, r.occurrences, r.status, r.enforcement, r.guard_literal) for r in f] == [("bash", "Cannot find module LITERAL", 2, "validated", "warn", "npm run x")]
    assert f[0].trigger.startswith("运行 bash 期间报错：")


def _fold_episodes(types):
    occ = relapses = at = 0
    resolved, out = False, []
    for t in types:
        if t == "resolve":
            resolved = resolved or occ > 0
            if occ:
                at = 0
            continue
        occ += 1
        if resolved:
            relapses, at, resolved = relapses + 1, occ - 1, False
        out.append((occ, relapses, max(1, occ - at)))
    return out, resolved


def test_episodes_equal_a_fold(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for k in range(20):
        types = ["observe"] + [rnd.choice(["observe", "observe", "resolve"]) for _ in range(rnd.randint(0, 9))]
        rows += [(f"f{k}", T(i * 40), i, t) for i, t in enumerate(types)]
        want[f"f{k}"] = _fold_episodes(types)
    h = spark.createDataFrame(rows, "fingerprint string, ts string, seq long, type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {}
    for r in fl.episodes(h, F.date_trunc("minute", "ts")).orderBy("seq").collect():
        got.setdefault(r.fingerprint, []).append((r.occurrences, r.relapses, r.in_episode))
    state = {r.fingerprint: r.resolved_at is not None for r in fl.episode_state(h, ["fingerprint"]).collect()}
    for k, (steps, resolved) in want.items():
        assert [x[:2] for x in got[k]] == [x[:2] for x in steps] and state[k] == resolved
        assert got[k][-1][2] == steps[-1][2]


def test_corrections_and_prevention(spark):
    obs = spark.createDataFrame([("s", 1, 1, "f1"), ("s", 5, 2, "f2")], "session_id string, seq long, turn int, fingerprint string")
    msg = spark.createDataFrame([("s", 3, 2, "不对，应该用 X"), ("s", 4, 2, "thanks"), ("s", 9, 9, "wrong again")], "session_id string, seq long, turn int, text string")
    c = fl.corrections(msg, obs).collect()
    assert [(r.seq, r.fingerprint) for r in c] == [(3, "f1")]
    w = spark.createDataFrame([("s", "f1", 1), ("s", "f1", 2), ("s", "f2", 3), ("s", "f3", 8)], "session_id string, fingerprint string, turn int")
    last = spark.createDataFrame([("s", 6)], "session_id string, last_turn int")
    assert {(r.fingerprint, r.turn) for r in fl.prevented(w, obs, last).collect()} == {("f1", 2), ("f2", 3)}


def test_advice(spark):
    f = spark.createDataFrame([
        ("hot", "bash", "t1", "sym", "", 9, 0, 9, "validated", "alpha beta trigger", "2024-01-09", 0), ("once", "bash", "t2", "sym", "", 1, 0, 1, "draft", "x", "2024-01-09", 0),
        ("done", "sed", "t3", "sym", "fix it", 5, 0, 5, "deprecated", "gamma delta trigger", "2024-01-09", 5)],
        "fingerprint string, tool string, template string, symptom string, remedy string, occurrences long, relapses long, in_episode long, status string, trigger string, last_seen string, occurrences_at_resolve long"
    ).withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    s = spark.createDataFrame([("uses", ["bash"], ""), ("idle", [], ""), ("says", ["x"], "gamma delta please"), ("off", ["y"], "zz")], "session_id string, tools array<string>, context string")
    got = {(r.session_id, r.fingerprint, r.kind) for r in fl.advice(s, f, "2024-01-10").collect()}
    assert got == {("uses", "hot", "warning"), ("idle", "hot", "warning"), ("says", "done", "lesson")}


def test_leaks(spark):
    src = spark.createDataFrame([("a", "one two three four five six seven eight nine ten")], "source_id string, text string")
    cand = spark.createDataFrame([(1, "a", "ONE two, three four five six seven eight! nine", ["two"]), (2, "b", "one two three four five six seven eight", ["zzz"]), (3, "a", "one two three four five six seven", [])],
                                 "id int, source_id string, text string, identifiers array<string>")
    r = {x.id: x for x in leak.leak_check(cand, src, paired=True).collect()}
    assert len(r[1].verbatim_runs) == 2 and r[1].identifier_hits == ["two"] and r[2].clean and r[3].clean
    assert not {x.id: x for x in leak.leak_check(cand, src).collect()}[2].clean


def test_reflection(spark):
    t = spark.createDataFrame([("new", i, f"touch w{i}", "", ["edit"], [f"src/brandnew{i}.ts"]) for i in range(3)] + [("chat", i, "hello", "", [], []) for i in range(3)]
                              + [("fix", i, "不对", "", [], []) for i in range(3)] + [("few", 0, "x", "", ["t"], [])], schemas.TURNS)
    cards = spark.createDataFrame([("c", "hello world")], "id string, text string")
    got = {r.session_id: r.reason for r in ps.reflect_decisions(t, cards).collect()}
    assert got == {"new": "new_ground", "chat": "no_signal", "fix": "correction", "few": "few_turns"}


def test_delivery_forms_against_a_fold(spark):
    rnd = random.Random(4)
    rows = [(None if k == 2 else f"s{k}", "a", t, rnd.choice(["h1", "h1", "h1", "h2", None]) if k else "same")
            for k in range(4) for t in sorted(rnd.sample(range(2500), 900))]
    rows += [("long", "a", t, "same") for t in range(100_000)] + [("below", "a", t, "same") for t in range(-300, 300)]
    d = spark.createDataFrame(rows, "session_id string, item_id string, turn int, content_hash string")
    for every in (0, 1, 4, 10, 300):
        want, due, last = {}, {}, {}
        for s, _, t, h in rows:
            full = s not in due or last[s] != h or (every > 0 and t >= due[s])
            if full:
                due[s] = t + every
            last[s], want[s, t] = h, full
        got = {(r.session_id, r.turn): r.full for r in ps.delivery_forms(d, every).collect()}
        assert got == want, every
    assert ps.delivery_forms(d.limit(0), 4).count() == 0


def test_rewrites(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, v string, hits int")
    p = spark.createDataFrame([("a", "z", 9), ("q", "z", 9)], "id string, v string, hits int")
    assert sorted(rewrite.patch_by_id(base, p, keep=("hits",)).collect()) == [("a", "z", 1), ("b", "y", 2)]
    assert [r.id for r in rewrite.delete_ids(base, p).collect()] == ["b"]
    try:
        rewrite.wipe_scope(base, "g")
        raise AssertionError("must ask for confirmation")
    except ValueError:
        pass


# ---- stored records, missing partitions, many records ------------------------------

def _failure_rows(rows, scope=False):
    """(fingerprint, ts second, session[, scope, partition]) as observations."""
    return [(f, f"2024-01-01 00:00:{t:02d}", t, s, f"tool {f}", f"symptom {t}", *rest) for f, t, s, *rest in rows]


_OBS = "fingerprint string, ts string, seq long, session_id string, template string, symptom string"
_RES = "fingerprint string, ts string, seq long, remedy string"
_COMPARED = ["fingerprint", "symptom", "remedy", "occurrences", "relapses", "in_episode", "at_reopen", "enforcement", "status", "sessions",
             "occurrences_at_resolve", "first_seen", "last_seen", "resolved_at", "last_relapse_at"]


def _timed(df):
    return df.withColumn("ts", F.to_timestamp("ts"))


def _fold_failures(events):
    """One record per fingerprint, event by event."""
    out = {}
    for t, kind, f, s, remedy in sorted(events, key=lambda e: e[0]):
        r = out.get(f)
        if kind == "resolve":
            if r:
                r.update(remedy=remedy or r["remedy"], resolved=t, at_resolve=r["n"], reopen=None)
            continue
        if r is None:
            r = out[f] = {"n": 0, "remedy": "", "resolved": None, "at_resolve": None, "reopen": None, "relapses": 0, "sessions": []}
        r["n"] += 1
        if r["resolved"] is not None:
            r.update(relapses=r["relapses"] + 1, reopen=r["n"] - 1, resolved=None)
        if s not in r["sessions"]:
            r["sessions"] = (r["sessions"] + [s])[-20:]
    return out


def test_failures_in_steps_equal_one_merge(spark):

    r = random.Random(5)
    events = []
    for t in range(58):
        f, kind = r.choice("abcd"), "resolve" if r.random() < 0.25 else "observe"
        events.append((t, kind, f, f"s{r.randint(0, 30)}", f"do {t}" if r.random() < 0.5 else None))

    def frames(part):
        obs = _timed(spark.createDataFrame(_failure_rows([(f, t, s) for t, k, f, s, _ in part if k == "observe"]), _OBS))
        res = _timed(spark.createDataFrame([(f, f"2024-01-01 00:00:{t:02d}", t, rem) for t, k, f, _, rem in part if k == "resolve"], _RES))
        return obs, res

    once = fl.merge_failures(*frames(events)).select(_COMPARED)
    stored = None
    for cut in (events[:17], events[17:18], events[18:40], [e for e in events[40:] if e[1] == "resolve"][:0], events[40:]):
        stored = fl.merge_failures(*frames(cut), existing=stored)
        stored = spark.createDataFrame(stored.collect(), stored.schema)
    assert sorted(map(repr, stored.select(_COMPARED).collect())) == sorted(map(repr, once.collect()))
    want = _fold_failures(events)
    for x in once.collect():
        w = want[x["fingerprint"]]
        assert (x["occurrences"], x["relapses"], x["remedy"], x["sessions"], x["status"] == "deprecated", x["occurrences_at_resolve"]) == (
            w["n"], w["relapses"], w["remedy"], w["sessions"], w["resolved"] is not None, w["at_resolve"])
        assert x["in_episode"] == max(1, w["n"] - (w["reopen"] or 0))


def test_a_lone_resolve_reaches_the_stored_record(spark):
    obs = _timed(spark.createDataFrame(_failure_rows([("a", 1, "s"), ("a", 2, "s")]), _OBS))
    stored = fl.merge_failures(obs)
    res = _timed(spark.createDataFrame([("a", "2024-01-02 00:00:00", 9, "turn it off"), ("never", "2024-01-02 00:00:00", 9, "x")], _RES))
    got = fl.merge_failures(obs.limit(0), res, existing=stored).collect()
    assert [(x["fingerprint"], x["status"], x["remedy"], x["occurrences"], x["occurrences_at_resolve"]) for x in got] == [
        ("a", "deprecated", "turn it off", 2, 2)]


def test_failures_by_scope_with_a_missing_partition(spark):
    rows = _failure_rows([("a", 1, "s", "project", None), ("a", 2, "s", "project", None), ("a", 3, "s", "user", "p")])
    obs = _timed(spark.createDataFrame(rows, _OBS + ", scope string, partition string"))
    got = fl.merge_failures(obs).select("scope", "partition", "occurrences", "sessions").collect()
    assert sorted(map(tuple, got)) == [("project", "default", 2, ["s"]), ("user", "p", 1, ["s"])]


def test_nothing_is_dropped_without_a_cap(spark):
    obs = spark.range(510).select(F.col("id").cast("string").alias("fingerprint"), F.current_timestamp().alias("ts"), F.col("id").alias("seq"),
                                  F.lit("s").alias("session_id"), F.lit("t").alias("template"), F.lit("x").alias("symptom"))
    assert fl.merge_failures(obs).count() == 510 and fl.merge_failures(obs, cap=7).count() == 7
    found = spark.range(510).select(F.lit("s").alias("session_id"), F.concat(F.lit("fix number "), "id").alias("correction"), F.col("id").alias("seq"))
    long = "x" * 150
    texts = spark.range(510).select(F.lit("project").alias("scope"), F.lit(None).cast("string").alias("partition"), F.lit("note").alias("kind"),
                                    F.concat(F.lit(long), "id").alias("text"), F.lit("s").alias("session_id"), F.array(F.lit("t")).alias("tags"),
                                    F.current_timestamp().alias("ts"), F.col("id").alias("seq"))
    facts = pf.merge_facts(texts)
    assert facts.count() == 510 and facts.filter("size(sources) = 1 AND size(tags) = 1").count() == 510
    said = found.select("session_id", "seq", F.lit(1).alias("turn"), F.concat(F.lit("wrong: "), "correction").alias("text"))
    seen = spark.createDataFrame([("s", -1, 1, "fp")], "session_id string, seq long, turn int, fingerprint string")
    assert fl.corrections(said, seen).count() == 510


def test_an_idle_session_gets_the_failures_of_its_stack(spark):
    stack = "struct<ecosystem:string,languages:array<string>,frameworks:array<string>,version_constraints:map<string,string>,versions:map<string,string>>"
    def st(*langs):
        return (None, list(langs), None, None, None)
    rows = [(f"j{i}", "t", f"e{i}", "", "", 90 - i, st("java")) for i in range(5)] + [(f"p{i}", "t", f"e{i}", "", "", 20 - i, st("python")) for i in range(3)]
    rows.append(("any", "t", "e", "", "", 2, st()))
    f = spark.createDataFrame(rows, f"fingerprint string, tool string, symptom string, remedy string, template string, occurrences long, stack {stack}")
    f = f.withColumns({"status": F.lit("validated"), "relapses": F.lit(0), "in_episode": F.col("occurrences"), "trigger": F.lit("x"),
                       "last_seen": F.lit("2024-01-01").cast("timestamp"), "occurrences_at_resolve": F.lit(0)})
    s = spark.createDataFrame([("py", [], "", st("python")), ("none", [], "", st()), ("null", [], "", None)], f"session_id string, tools array<string>, context string, stack {stack}")
    got = {}
    for r in fl.advice(s, f, "2024-02-01", limit=3).orderBy("session_id", "rank").collect():
        got.setdefault(r.session_id, []).append(r.fingerprint)
    assert got == {"py": ["p0", "p1", "p2"], "none": ["j0", "j1", "j2"], "null": ["j0", "j1", "j2"]}


def test_advice_on_a_log_with_one_tool(spark):
    """Only the heads of the tool meet its sessions; the result is that of all pairs."""
    stack = "struct<ecosystem:string,languages:array<string>,frameworks:array<string>,version_constraints:map<string,string>,versions:map<string,string>>"
    langs = [["java"], ["python"], []]
    rows = [(f"f{i:03d}", "bash", f"sym{i}", "do it" if i % 3 == 0 else "", "", (i * 37) % 90 + 3, "deprecated" if i % 3 == 0 else "validated",
             1_700_000_000_000 + (i * 53) % 70, (None, langs[i % 5 % 3], None, None, None)) for i in range(300)]
    f = spark.createDataFrame(rows, f"fingerprint string, tool string, symptom string, remedy string, template string, occurrences long, status string, ms long, stack {stack}")
    f = f.withColumns({"relapses": F.lit(0), "in_episode": F.col("occurrences"), "trigger": F.lit("x"),
                       "last_seen": F.timestamp_millis("ms"), "occurrences_at_resolve": F.lit(0)}).drop("ms")
    s = spark.createDataFrame([(f"s{j:02d}", ["bash"], "some words here", (None, langs[j % 2], None, None, None)) for j in range(40)],
                              f"session_id string, tools array<string>, context string, stack {stack}")
    forgiven = spark.createDataFrame([(f"s{j:02d}", f"f{i:03d}") for j in range(0, 40, 2) for i in range(0, 300, 7)], "session_id string, fingerprint string")
    got = {}
    for r in fl.advice(s, f, "2024-02-01", forgiven=forgiven, limit=60).orderBy("session_id", "rank").collect():
        got.setdefault(r.session_id, []).append((r.fingerprint, r.kind))
    for j in range(40):
        fits = [r for r in rows if not (r[8][1] and langs[j % 2][0] not in r[8][1]) and not (j % 2 == 0 and int(r[0][1:]) % 7 == 0)]
        warned = sorted((r for r in fits if r[6] == "validated"), key=lambda r: (-r[5], r[0]))
        lessons = sorted((r for r in fits if r[6] == "deprecated"), key=lambda r: (-r[7], r[0]))
        assert got[f"s{j:02d}"] == [(r[0], "warning" if r[6] == "validated" else "lesson") for r in warned + lessons][:60]
    heads = fl.tool_heads(f.withColumn("base", F.col("occurrences")), "base", 3)
    assert fl.tool_matches(s, heads).count() == 40 * 3 * 3 and fl.tool_matches(s, f).count() == 40 * 300
