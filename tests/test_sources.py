"""Readers, writers, source mining, exports, streams."""

import json
import os

from pyspark.sql import functions as F

from sessionmine import schemas
from sessionmine.plans import failures as fl, mining as m, sessions as ps, stack as st, stats
from sessionmine.sources import export, files as sf, layers, replies
from sessionmine.streaming import stateful, tables, windows
from tests.test_search import cards

KEY = bytes(range(32))
SCHEMA = "id STRING, n INT"


def test_layer_with_bad_lines(spark, tmp_path):
    p = tmp_path / "layer.jsonl"
    p.write_text('{"id": "a", "n": 1}\n{broken\n\n{"id": "b", "n": 2}\n')
    good, bad = layers.read_layer(spark, str(p), SCHEMA)
    assert sorted(good.collect()) == [("a", 1), ("b", 2)] and [r.line for r in bad.collect()] == ["{broken"]
    (tmp_path / "arr.json").write_text('[{"id": "a", "n": 1}, {"id": "b"}]')
    assert layers.read_layer(spark, str(tmp_path / "arr.json"), SCHEMA, array=True)[0].count() == 2


def test_encrypted_layer(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    layers.write_layer(df, str(tmp_path / "e"), key=KEY)
    lines = [r.value for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert all(x.startswith("enc:v1:") and x.count(":") == 4 for x in lines)
    good, bad = layers.read_layer(spark, str(tmp_path / "e"), SCHEMA, key=KEY)
    assert sorted(good.collect()) == [("a", 1), ("b", 2)] and bad.count() == 0
    good, bad = layers.read_layer(spark, str(tmp_path / "e"), SCHEMA, key=bytes(32))
    assert good.count() == 0 and bad.count() == 2
    (tmp_path / "e" / "plain.txt").write_text('{"id": "c", "n": 3}\nenc:v1:zz\n')
    good, bad = layers.read_layer(spark, str(tmp_path / "e"), SCHEMA, key=KEY)
    assert good.count() == 3 and bad.count() == 1


def test_scopes(spark, tmp_path):
    df = spark.createDataFrame([("project", "p1", "a", "mine"), ("global", "default", "a", "shared"), ("global", "default", "b", "shared"), ("global", "x", "c", "far"), ("project", "p2", "d", "far")],
                               "scope string, partition_key string, id string, v string")
    layers.write_layer(df, str(tmp_path / "l"), ["scope", "partition_key"])
    got = {r.id: (r.v, r.read_from) for r in layers.read_scopes(spark, str(tmp_path / "l"), "p1").collect()}
    assert got == {"a": ("mine", "project"), "b": ("shared", "global")}
    layers.write_layer(df.filter("id = 'c'").withColumn("v", F.lit("new")), str(tmp_path / "l"), ["scope", "partition_key"])
    assert spark.read.parquet(str(tmp_path / "l")).count() == 5
    assert spark.range(1).select(layers.project_key(F.lit("/home/u/My Repo!")).alias("k")).first().k.startswith("my-repo-")


def test_metrics(spark, tmp_path):
    p = str(tmp_path / "m")
    base = layers.read_metrics(spark, p, schemas.METRICS)
    runs = spark.createDataFrame([("2024-01-01", 1, 0, True), ("2024-01-02", 0, 2, True), ("2024-01-03", 0, 0, True), ("2024-01-04", 0, 0, False)],
                                 "ts string, created int, merged int, called boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    layers.write_metrics(stats.fold_metrics(base, runs, backoff_after=2), p)
    r = layers.read_metrics(spark, p, schemas.METRICS).first()
    assert (r.reflections, r.skipped, r.new_cards, r.duplicate_cards, r.empty_streak, r.backoff) == (3, 1, 1, 2, 2, True)


def test_replies(spark):
    good = {"title": " T ", "summary": "did it", "decisions": ["a", "a", 3, ""], "tags": ["Java"], "facts": [{"kind": "odd", "text": "f"}, {"kind": "constraint", "text": "token = abcdef99"}, {"text": 5}],
            "techniques": [{"name": "n", "when": "w", "summary": "s", "kind": "pitfall", "api": [{"symbol": "A.b"}, {"signature": "no"}], "domain": "PUML",
                            "example": {"code": "l\n" * 20, "language": "java"}}, {"name": "half"}],
            "corrections": [{"trigger": "t", "wrong": "x", "correctApproach": "y"}, {"trigger": "t"}]}
    rows = [("s", "Sure: ```json\n" + json.dumps(good) + "\n```"), ("bad", "{nope}"), ("none", "hello")]
    out = replies.ingest_model_output(spark.createDataFrame(rows, "session_id string, text string"))
    e = out["episodes"].first()
    assert (e.title, e.decisions, e.tags) == ("T", ["a"], ["java"])
    assert [(r.kind, r.text) for r in out["facts"].collect()] == [("fact", "f"), ("constraint", "[REDACTED:named-secret]")]
    c = out["cards"].collect()
    assert len(c) == 1 and (c[0].kind, c[0].domain, c[0].sensitivity, [a.symbol for a in c[0].api]) == ("pitfall", "plantuml", "internal", ["A.b"])
    assert c[0].example.code.count("\n") == 7 and out["corrections"].count() == 1
    assert {(r.session_id, r.reason) for r in out["rejects"].collect()} == {("bad", "not_json"), ("none", "no_object")}


REPO = {
    ".gitignore": "# x\nsecret/\n*.kt\n", "build.gradle": "plugins {}", "package.json": '{"dependencies": {"react": "^18"}, "devDependencies": {"vitest": "1", "zz": "1"}}',
    "tsconfig.json": "{}", "src/OrderService.java": "import com.acme.Orders;\n@Service\nclass A {\n  void f() {\n    if (x == null) throw new E();\n    OrdersClient.create(a, g(b, c));\n    OrdersClient.create(a);\n    Logger.info();\n  }\n}\n",
    "src/app/handler.ts": "import { z } from 'zod'\nclient.send(a)\nclient.send(a, [b, c])\nLogger.info((x))\nLogger.info(outer(Metrics.record('k', 1), 2))\n",
    "src/a.kt": "x.y()", "node_modules/m.js": "a.b()", "secret/k.ts": "a.b()", "src/big.ts": "a.b()\n" * 900, "README.md": "a.b()", ".hidden/x.ts": "a.b()",
}


def write_repo(root):
    for path, text in REPO.items():
        f = os.path.join(root, path)
        os.makedirs(os.path.dirname(f), exist_ok=True)
        with open(f, "w") as h:
            h.write(text)


def test_scan_and_mine(spark, tmp_path):
    root = str(tmp_path / "shop")
    write_repo(root)
    got, large = sf.scan_files(spark, root, max_bytes=4000)
    assert {r.path for r in got.collect()} == {"build.gradle", "package.json", "tsconfig.json", "src/OrderService.java", "src/app/handler.ts"}
    assert [r.path for r in large.collect()] == ["src/big.ts"]
    assert [r.path for r in sf.scan_files(spark, root, max_bytes=4000, max_files=3)[0].collect()] == ["build.gradle", "package.json", "tsconfig.json"]
    assert sf.scan_files(spark, root, include=["src/**"], exclude=["*.java"], max_bytes=4000)[0].count() == 1
    sites = sorted((r.symbol, r.arity) for r in m.call_sites(got).collect())
    assert sites == [("Logger.info", 0), ("Logger.info", 0), ("Logger.info", 1), ("Metrics.record", 2), ("OrdersClient.create", 1), ("OrdersClient.create", 2),
                     ("client.send", 1), ("client.send", 3)]
    assert {r.line for r in m.guards(got).collect()} == {"if (x == null) throw new E();"}
    assert {r.module for r in m.imports(got).collect()} >= {"com.acme.Orders"} and [r.annotation for r in m.annotations(got).collect()] == ["@Service"]
    out = m.mine_code(got)
    c = {r.symbol: r for r in out["clusters"].collect()}
    assert c["Logger.info"].occurrences == 3 and c["Logger.info"].n_files == 2 and set(c) == {"Logger.info", "OrdersClient.create", "client.send"}
    assert out["excerpts"].filter("symbol = 'client.send'").first().excerpt.startswith("// service-layer\n")
    names = {r.symbol: r["name"] for r in out["cards"].collect()}
    assert names["Logger.info"] == "How this repository calls Logger.info"
    assert m.mine_code(got, out["cache"])["sites"].count() == 0
    s = st.detect_stack(got).first().stack
    assert s.languages == ["javascript", "typescript", "java"] and s.build_tool == "npm" and s.framework_versions == {"react": "^18", "vitest": "1"}


def test_arity_edge_cases(column):
    for text, want in (("(a, b)", 2), ("()", 0), ("( )", 0), ("((a))", 0), ("(f(a, b), c)", 2), ("(f(g(h(a, b), 1), 2), c, d)", 3), ("(a, b", 2), ("(", 0), ("(,)", 0), ("([1, 2])", 2)):
        assert column(m.arity, text) == want, text


def test_logic_cards(spark):
    clusters = spark.createDataFrame([("r", "A.run", "src/Unit.ts")], "repo string, symbol string, first_path string")
    rep = spark.createDataFrame([("r", "A.run", None, None, "does", None, None, ["one"]), ("r", "A.run", None, None, "no steps", None, None, [])],
                                "repo string, symbol string, name string, when string, summary string, subject string, location string, steps array<string>")
    r = m.logic_cards(rep, clusters).collect()
    assert [(x.subject, x.location, x["name"]) for x in r] == [("Unit", "src/Unit.ts#run", "How Unit works")]


def test_export(spark, tmp_path):
    c = cards(spark, [dict(id="tq_ab12cd34ef", name="Use BigDecimal", when="adding money", summary="No doubles.", steps=["one"], tags=["money"], stack=(None, ["java"], ["spring"], None, None, None, None, None)),
                      dict(id="tq_x", name="折扣", when="w", summary="s"), dict(id="tq_c", name="c", when="w", sensitivity="confidential"), dict(id="tq_d", name="d", when="w", status="draft")])
    x = {r.id: r for r in export.export_cards(c).collect()}
    assert set(x) == {"tq_ab12cd34ef", "tq_x"} and x["tq_ab12cd34ef"].name == "use-bigdecimal-ab12cd34" and x["tq_x"].name == "technique-x"
    assert x["tq_ab12cd34ef"].description == "No doubles. For: adding money. Stack: java/spring. Tags: money."
    assert "## How\n1. one" in x["tq_ab12cd34ef"].markdown and x["tq_x"].problems == []
    export.write_documents(export.export_cards(c), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).filter("value = '# Use BigDecimal'").count() == 1


def run_stream(spark, df, schema, build, tmp_path, name):
    src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    df.write.parquet(src)
    s = build(spark.readStream.schema(schema).parquet(src))
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(s.schema).parquet(out)


def test_stream_failures_equal_batch(spark, tmp_path):
    rows = [("s", i, f"2024-01-0{1 + i % 3} 10:00:00", 1, "bash", f"Cannot find module 'm{i}'") for i in range(6)]
    df = spark.createDataFrame(rows, "session_id string, seq long, ts string, turn int, tool string, message string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    s = windows.failure_observations(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), "10 days")
    tables.log_batches(s, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got, want = tables.read_failures(spark, str(tmp_path / "log")).first(), fl.merge_failures(fl.fingerprinted(df)).first()
    assert (got.occurrences, got.fingerprint, got.first_seen) == (want.occurrences, want.fingerprint, want.first_seen) and got.occurrences == 6


def test_stateful_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 1, "delivery", "a", "h1"), (2, 2, "delivery", "a", "h1"), (3, 3, "delivery", "a", "h2"), (4, 13, "delivery", "a", "h2"), (5, 14, "compaction", "", ""), (6, 14, "delivery", "a", "h2"),
            (7, 1, "once", "f", ""), (8, 2, "once", "f", ""), (9, 2, "repeat", "f", ""), (10, 3, "once", "f", "")]
    sch = "seq long, turn int, kind string, item_id string, content_hash string, session_id string, ts timestamp"
    df = spark.createDataFrame(rows, sch.split(", session_id")[0]).withColumn("session_id", F.lit("s")).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    got = run_stream(spark, df, sch, stateful.deliver_once, tmp_path, "d").orderBy("seq").collect()
    assert [(r.seq, r.form) for r in got] == [(1, "full"), (2, "pointer"), (3, "full"), (4, "full"), (6, "full"), (7, "once"), (10, "again")]
    # Six warnings, one of them five times: the budget of five counts different ones.
    again = [(10 * i + j, i, k, "f0", "") for i in range(1, 6) for j, k in ((0, "once"), (1, "repeat"))] + [(100 + i, 9, "once", f"f{i}", "") for i in range(1, 7)]
    df5 = spark.createDataFrame(again, sch.split(", session_id")[0]).withColumn("session_id", F.lit("s")).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    sent = run_stream(spark, df5, sch, stateful.deliver_once, tmp_path, "d5").filter("seq > 100").count()
    assert sent == 4  # f0 is the fifth
    batch = ps.delivery_forms(df.filter("kind = 'delivery'").withColumn("epoch", (F.col("seq") > 5).cast("int")), 10).orderBy("epoch", "turn").collect()
    assert [r.full for r in batch] == [True, False, True, True, True]

    rows = [(1, 1, "warning", "f1"), (2, 1, "warning", "f2"), (3, 2, "observe", "f2"), (4, 2, "turn_end", None), (5, 4, "turn_end", None), (6, 9, "turn_end", None)]
    sch = "seq long, turn int, kind string, fingerprint string, session_id string, ts timestamp"
    df = spark.createDataFrame(rows, sch.split(", session_id")[0]).withColumn("session_id", F.lit("s")).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    got = run_stream(spark, df, sch, stateful.settle_prevention, tmp_path, "p").collect()
    assert [(r.fingerprint, r.warned_turn, r.settled_turn) for r in got] == [("f1", 1, 4)]

    rows = [(i, i, "turn_end", True, False, 0.0, False, 0) for i in range(1, 4)] + [(4, 4, "turn_end", False, True, 0.0, False, 0)] + [(5, 4, "result", False, False, 0.0, False, 0)]
    sch = "seq long, turn int, kind string, signal boolean, correction boolean, novelty double, new_ground boolean, created int, session_id string, ts timestamp"
    df = spark.createDataFrame(rows, sch.split(", session_id")[0]).withColumn("session_id", F.lit("s")).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    got = run_stream(spark, df, sch, stateful.reflect_trigger, tmp_path, "r").orderBy("turn").collect()
    assert [(r.turn, r.reason) for r in got] == [(1, "few_turns"), (2, "few_turns"), (3, "not_novel"), (4, "correction")]


def test_scan_lists_the_whole_tree(spark, tmp_path):
    """Names with `_`, `.github`, a deep folder and an empty one; skipped, ignored and hidden
    folders and links are not entered."""
    root = tmp_path / "tree"
    for name in ("_a.ts", "_gen/_b.py", ".github/workflows/c.yml", ".hidden/d.ts", "node_modules/e.ts", "drop/f.ts",
                 "x/y/z/w/g.go", "x/.h.ts", "odd name/é.rs", "readme.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "empty").mkdir()
    (root / "loop").symlink_to(root)
    (root / ".gitignore").write_text("drop/\n")
    for address in (str(root), f"file://{root}"):
        listed = {r.path for r in sf.list_files(spark, address, sf.ignore_rules(["drop/"])).collect()}
        assert listed == {"_a.ts", "_gen/_b.py", ".github/workflows/c.yml", "x/y/z/w/g.go", "x/.h.ts", "odd name/é.rs", "readme.md", ".gitignore"}
        small, large = sf.scan_files(spark, address, max_bytes=20)
        assert {r.path: r.content for r in small.collect()} == {p: p for p in ("_a.ts", "_gen/_b.py", "x/y/z/w/g.go", "odd name/é.rs")}
        assert [tuple(r) for r in large.collect()] == [(".github/workflows/c.yml", 23)]


def test_encrypted_layer_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], SCHEMA)
    layers.write_layer(df, str(tmp_path / "e"), ["n"], key=KEY)
    layers.write_layer(spark.createDataFrame([("d", 2)], SCHEMA), str(tmp_path / "e"), ["n"], key=KEY)
    good, bad = layers.read_layer(spark, str(tmp_path / "e"), SCHEMA, key=KEY)
    assert sorted(good.collect()) == [("a", 1), ("d", 2)] and bad.count() == 0
    assert sorted(p.name for p in (tmp_path / "e").iterdir() if p.is_dir()) == ["part_n=1", "part_n=2"]
