"""Keyed tables, streamed turns and delivery state against batch jobs and plain folds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sessionmine import schemas
from sessionmine.operators import sizes
from sessionmine.plans import failures as fl, sessions as ps
from sessionmine.sources import layers
from sessionmine.streaming import library, metrics, stateful, tables, turns

from .test_jobs import events
from .test_sources import run_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def feed(spark, parts, build, tmp_path):
    """Parts in one run of the stream each."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = build(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start().awaitTermination(120)
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_extend_is_a_live_clip():
    rnd = random.Random(4)
    for limit in (7, 50, None):
        text, state = "", ("", "", 0)
        for _ in range(60):
            piece = "".join(rnd.choices("abé文 ", k=rnd.randint(0, 30)))
            state = turns.extend(*state, piece, limit)
            text += piece
            head, tail = ps.head_tail_sizes(limit or 1)
            want = text if limit is None or len(text) <= limit else f"{text[:head]}…{text[-tail:]}"
            assert turns.shown(*state, limit) == want


def session_rows(rnd, session, n):
    out, seq = [], 0
    for turn in range(1, n + 1):
        kinds = ["turn/start"] * rnd.randint(0, 1) + rnd.choices(["user/message", "assistant/message", "tool/call", "tool/result"], k=rnd.randint(1, 9))
        kinds += ["turn/end"] * rnd.randint(0, 1)
        for kind in kinds:
            row = {"session_id": session, "seq": seq, "turn": turn, "type": kind, "cwd": "/ws"}
            if kind.endswith("message"):
                row["text"] = "".join(rnd.choices("abc dé", k=rnd.randint(0, 60)))
                if rnd.random() < 0.2:
                    row["source_kind"] = "plugin:x"
            if kind == "tool/call":
                row |= {"tool": rnd.choice(["edit", "read"]), "arguments": '{"file_path": "/ws/f%d.py"}' % rnd.randint(0, 3)}
            out.append(row)
            seq += 1
    return out


def test_streamed_turns_equal_batch(spark, tmp_path, rocksdb):
    rnd = random.Random(8)
    rows = [r for s in "abcd" for r in session_rows(rnd, s, 5)]
    at = lambda r: {**r, "ts": f"2024-01-01 00:{r['seq'] // 60:02d}:{r['seq'] % 60:02d}"}
    ends = [{"session_id": s, "seq": 500, "type": "session/disposed", "ts": "2024-01-01 00:59:00"} for s in "abcd"]
    parts = [[at(r) for r in rows if r["seq"] % 100 < 9], [at(r) for r in rows if 9 <= r["seq"] < 20], [at(r) for r in rows if r["seq"] >= 20], ends]
    build = lambda df: turns.stream_turns(df, user_chars=90, assistant_chars=70)
    got = feed(spark, [events(spark, p) for p in parts], build, tmp_path)
    cols = ["session_id", "turn", "user", "assistant", "tools", "files"]
    want = ps.build_turns(events(spark, [at(r) for r in rows]), user_chars=90, assistant_chars=70)
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
    assert {r["closed_by"] for r in got.collect()} == {"turn end", "next turn", "session"}


def test_a_silent_session_is_closed(spark, tmp_path, rocksdb):
    row = lambda s, seq, turn, ts: {"session_id": s, "seq": seq, "turn": turn, "type": "user/message", "text": f"{s}{turn}", "ts": ts}
    parts = [events(spark, [row("a", 0, 1, "2024-01-01 00:00:00"), row("a", 1, 2, "2024-01-01 00:01:00"), row("b", 0, 1, "2024-01-01 05:00:00")]),
             events(spark, [row("b", 1, 1, "2024-01-01 05:01:00")])]
    got = feed(spark, parts, lambda df: turns.stream_turns(df, idle="1 hour"), tmp_path)
    assert sorted((r.session_id, r.turn, r.closed_by) for r in got.collect()) == [("a", 1, "next turn"), ("a", 2, "silence")]


# ---- keyed tables ----------------------------------------------------------------

def observations(spark, n, start=0):
    rows = [(f"s{i % 3}", start + i, f"2024-01-{1 + (start + i) // 24:02d} {(start + i) % 24:02d}:00:00", 1, f"tool{i % 5}", f"Cannot find module 'm' {'abc'[i % 3] * 3}") for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, seq long, ts string, turn int, tool string, message string")
    return fl.fingerprinted(df.withColumn("ts", F.col("ts").cast("timestamp")))


def records(df):
    return sorted((r.fingerprint, r.occurrences, r.enforcement, r.status, tuple(r.sessions), r.first_seen, r.last_seen, r.relapses) for r in df.collect())


def test_keyed_failures_equal_one_merge(spark, tmp_path):
    table, merge = tables.failure_table(spark, str(tmp_path / "t"), buckets=4), tables.failure_merge()
    assert table.read() is None and table.rows_of(observations(spark, 3)) is None
    batches = [observations(spark, 40), observations(spark, 30, 40), observations(spark, 2, 70)]
    for i, b in enumerate(batches):
        assert table.change(b, i, merge, "s")
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = records(fl.merge_failures(whole))
    assert records(table.read()) == want
    before = sorted(os.listdir(tmp_path / "t"))
    assert not table.change(batches[2], 2, merge, "s") and not table.change(batches[0], 0, merge, "s")  # replays
    assert sorted(os.listdir(tmp_path / "t")) == before and records(table.read()) == want
    # Another stream counts its batches from 0 again.
    assert table.change(observations(spark, 1, 90), 0, merge, "other")
    assert sum(r.occurrences for r in table.read().collect()) == 73
    own = table.rows_of(observations(spark, 1, 90))
    assert own.count() == 1 and len({f.rpartition("/")[0] for f in own.inputFiles()}) == 1


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    table, merge = tables.failure_table(spark, str(tmp_path / "t"), buckets=2), tables.failure_merge()
    table.change(observations(spark, 20), 0, merge, "s")
    folder = tmp_path / "t" / "v00000001.s.1"
    table.read().withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(folder))
    os.remove(folder / "_SUCCESS")  # died before the end
    assert table.read().agg(F.sum("occurrences")).first()[0] == 20 and not table.written("s", 1)
    assert table.change(observations(spark, 5, 20), 1, merge, "s")
    assert records(table.read()) == records(fl.merge_failures(observations(spark, 20).unionByName(observations(spark, 5, 20))))


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    table, merge = tables.failure_table(spark, str(tmp_path / "t"), buckets=16), tables.failure_merge()
    for i in range(6):
        table.change(observations(spark, 15) if i == 0 else observations(spark, 1, 20 + i), i, merge, "s")
    folders = {n: [b for b in os.listdir(tmp_path / "t" / n) if b.startswith("bucket")] for n in os.listdir(tmp_path / "t")}
    assert all(len(b) <= 1 for n, b in folders.items() if not n.endswith(".0"))
    assert sum(len(b) for b in folders.values()) <= 15 + 2  # two versions of the changed bucket at most
    assert table.read().agg(F.sum("occurrences")).first()[0] == 20


def test_scoped_records_with_resolves(spark, tmp_path):
    table, merge = tables.failure_table(spark, str(tmp_path / "t"), scoped=True, buckets=2), tables.failure_merge()
    obs = observations(spark, 12).withColumn("scope", F.lit("p")).withColumn("partition", F.when(F.col("seq") % 2 == 0, "x")).withColumn("type", F.lit("observe"))
    fixed = obs.filter("seq = 4").withColumn("type", F.lit("resolve")).withColumn("seq", F.lit(99).cast("long")).withColumn("ts", F.lit("2024-02-01").cast("timestamp"))
    stream = run = None
    src = str(tmp_path / "in")
    for i, part in enumerate((obs.filter("seq < 6"), obs.filter("seq >= 6").unionByName(fixed))):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        run = tables.upsert_failures(stream, table, str(tmp_path / "cp"), "n")
        run.trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.partition, r.fingerprint): (r.occurrences, r.status) for r in table.read().collect()}
    want = {(r.partition, r.fingerprint): (r.occurrences, r.status) for r in fl.merge_failures(obs.drop("type"), fixed.drop("type")).collect()}
    assert got == want and "deprecated" in {s for _, s in got.values()} and {p for p, _ in got} == {"x", "default"}


def test_freed_gives_back_what_jobs_keep(spark):
    with sizes.freed():
        df = sizes.keep(spark.range(10))
        df.count()
        assert df.is_cached
    assert not df.is_cached


# ---- deliveries --------------------------------------------------------------------

SENT = "seq long, turn int, kind string, item_id string, content_hash string, session_id string, ts timestamp"


def deliver(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "seq long, turn int, kind string, item_id string")
    df = df.withColumn("content_hash", F.lit("")).withColumn("session_id", F.lit("s")).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    got = run_stream(spark, df, SENT, lambda s: stateful.deliver_once(s, **options), tmp_path, "x").orderBy("seq").collect()
    return [(r.seq, r.form) for r in got]


def test_advisories(spark, tmp_path, rocksdb):
    rows = [(1, 1, "first_contact", "a"), (2, 1, "advisory", "b"), (3, 2, "first_contact", "c"), (4, 2, "advisory", "a"), (5, 2, "advisory", "b"),
            (6, 3, "consulted", ""), (7, 3, "first_contact", "d"), (8, 3, "advisory", "d"), (9, 4, "advisory", "e"), (10, 5, "session/disposed", ""),
            (11, 5, "first_contact", "a")]
    assert deliver(spark, tmp_path, rows, advisories=3) == [(1, "first_contact"), (5, "advisory"), (8, "advisory"), (11, "first_contact")]


def test_warnings_age(spark, tmp_path, rocksdb):
    rows = [(1, 1, "once", "f"), (2, 1, "once", "f"), (60, 2, "once", "f"), (61, 3, "once", "g"), (62, 3, "once", "h")]
    df = lambda r: deliver(spark, tmp_path / str(len(r)), r, budget=2, ttl="30 minutes")
    assert df(rows[:2]) == [(1, "once")]
    os.makedirs(tmp_path / "parts", exist_ok=True)
    make = lambda part: spark.createDataFrame(part, "seq long, turn int, kind string, item_id string").withColumn("content_hash", F.lit("")).withColumn(
        "session_id", F.lit("s")).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    got = feed(spark, [make(rows[:2]), make(rows[2:])], lambda s: stateful.deliver_once(s, budget=2, ttl="30 minutes"), tmp_path / "parts")
    assert sorted((r.seq, r.form) for r in got.collect()) == [(1, "once"), (60, "once"), (61, "once")]


# ---- counters of libraries and runs ------------------------------------------------

LIBRARY = "library string, session_id string, ts timestamp, seq long, kind string, created int, merged int"


def library_rows(rnd, n, start=0):
    return [(rnd.choice(["a", "b", None]), rnd.choice("xy"), i, i, rnd.choice(["turn_end", "result", "result", "skipped"]), rnd.choice([0, 0, 0, 2, None]), rnd.choice([1, None]))
            for i in range(start, start + n)]


def test_library_streaks_against_a_fold(spark, tmp_path):
    rnd = random.Random(8)
    parts = [library_rows(rnd, 40, 0), library_rows(rnd, 40, 40), library_rows(rnd, 25, 80)]
    make = lambda rows: spark.createDataFrame(rows, LIBRARY.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds(F.col("ts") * 700))
    table = library.library_table(spark, str(tmp_path / "table"), buckets=2)
    for part in parts:
        make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(LIBRARY).parquet(str(tmp_path / "in"))
        library.share_streaks(rows, table, str(tmp_path / "rows"), str(tmp_path / "cp"), backoff_after=2).trigger(availableNow=True).start().awaitTermination(120)
    want, at = {}, {}
    for lib, _, _, seq, kind, created, merged in sum(parts, []):
        c = want.setdefault(lib, [0, 0, 0, 0, 0])
        if kind == "result":
            c[0], c[2], c[3] = c[0] + 1, c[2] + (created or 0), c[3] + (merged or 0)
            c[4] = 0 if created else c[4] + 1
        c[1] += kind == "skipped"
        at[seq] = c[4]
    got = {r.library: [r.reflections, r.skipped, r.new_cards, r.duplicate_cards, r.empty_streak] for r in table.read().collect()}
    assert got == want
    assert all(r.backoff == (r.empty_streak >= 2) for r in table.read().collect())
    assert {r.seq: r.empty_streak for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == at
    # A replay of the last batch changes neither the rows nor the counters.
    written = spark.read.parquet(str(tmp_path / "rows" / "batch=2"))
    assert not table.change(written, 2, library.counter_merge(2))
    # Without rows there is nothing, not even a library.
    assert library.with_streaks(make(parts[0]).limit(0)).count() == 0


def test_back_off_of_a_library_reaches_all_its_sessions(spark, rocksdb, tmp_path):
    sch = "library string, session_id string, seq long, turn int, kind string, signal boolean, correction boolean, novelty double, new_ground boolean, created int, merged int"
    ends = lambda s, a, b: [("l", s, i, i, "turn_end", True, False, 0.9, False, 0, 0) for i in range(a, b)]
    empty = [("l", "s1", 10 + i, 9, "result", False, False, 0.0, False, 0, 0) for i in range(2)]
    rows = ends("s1", 1, 4) + empty + ends("s2", 20, 23) + [("l", "s1", 30, 9, "result", False, False, 0.0, False, 1, 0)] + ends("s2", 31, 32)
    df = spark.createDataFrame(rows, sch).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    shared = library.with_streaks(df)
    for name, build, third in (("own", lambda s: stateful.reflect_trigger(s, backoff_after=2), "novel"),
                               ("shared", lambda s: stateful.reflect_trigger(s, backoff_after=2, shared_streak=True), "backoff")):
        got = feed(spark, [shared], build, tmp_path / name).filter("session_id = 's2'").orderBy("turn").collect()
        assert [r.reason for r in got][2] == third
        assert [r.reason for r in got][3] == ("few_turns" if name == "own" else "novel")


def test_run_metrics_count_a_replayed_batch_once(spark, tmp_path):
    heard = metrics.RunMetrics(spark, str(tmp_path / "m"))
    decisions = spark.createDataFrame([(True,), (False,), (None,), (True,)], "kept boolean")
    assert heard.counted(decisions, "gate", lambda df: df.count()) == 4
    packs = spark.createDataFrame([("a",), ("",), (None,)], "body string")
    heard.counted(packs, "packs", lambda df: df.collect())
    heard.add("q.sessionmine.advisories", 7, {"advisories": 3})
    heard.flush()
    heard.add("q.sessionmine.advisories", 7, {"advisories": 3})
    heard.add("q.sessionmine.advisories", 8, {"advisories": 1})
    heard.flush()
    r = metrics.snapshot(spark, heard.path).first()
    assert (r.gate_kept, r.gate_dropped, r.injections, r.advisories, r.reflections, r.backoff) == (2, 2, 1, 4, 0, False)
    assert metrics.snapshot(spark).first().asDict() == layers.METRIC_DEFAULTS
    with pytest.raises(ValueError):
        metrics.counts(packs, "else")
