"""Steps whose rows must follow the input, not the pairs or parts of it."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sessionmine.functions import redaction as rf
from sessionmine.operators import blocks, setjoin, topk
from sessionmine.operators.index import build_index, query_terms, score_pairs, with_shared
from sessionmine.plans import cards as pc, mining as m, search as s


def _shuffled(df, kind="Exchange$", metric="shuffleRecordsWritten"):
    """Rows that a query wrote to all its shuffles (or another metric of its nodes)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    assert plan
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif re.match(kind, node.nodeName()):
            rows += node.metrics().apply(metric).value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_only_lines_with_wanted_calls_are_shuffled(spark):
    """All ends of all names were before: some 20 rows a name."""
    text = "\n".join(f"someLongName{i}.otherName{i}(x)" for i in range(200)) + "\nmy.api.get(1) api.get(2)\nlast.target(3)"
    files = spark.createDataFrame([("r", f"f{i}.ts", text, "other") for i in range(3)], "repo string, path string, content string, role string")
    wanted = [("r", "api.get"), ("r", "get"), ("r", "et"), ("r", "last.target"), ("q", "api.get"), ("r", "Name7.otherName7")]
    lines = m._called_lines(files, spark.createDataFrame(wanted, "repo string, symbol string"))
    assert _shuffled(lines) <= 3 * 8 + 12
    got = sorted((r.path, r.no, r.symbol) for r in lines.collect())
    assert got == sorted((f"f{i}.ts", no, s) for i in range(3) for no, line in enumerate(text.split("\n"))
                         for r, s in wanted if r == "r" and s + "(" in line)


def test_sites_of_a_name_that_comes_twice(spark):
    """As the join with the names' roles gave them: both files' sites, for each of the two."""
    files = spark.createDataFrame([("r", "a.ts", "x.y(1) z.w(f(1), (2))"), ("r", "a.ts", "x.y()"), ("r", "b.ts", "x.y((((1, 2))), 3)"), (None, "c.ts", "x.y()")],
                                  "repo string, path string, content string")
    f = m.with_roles(files)
    got = sorted(tuple(r) for r in m.sites_with_roles(f).select("repo", "path", "symbol", "arity", "role").collect())
    old = m.call_sites(f.drop("role")).join(f.select("repo", "path", "role"), ["repo", "path"])
    assert got == sorted(tuple(r) for r in old.select("repo", "path", "symbol", "arity", "role").collect()) and len(got) == 7
    c = m.cluster_symbols(m.sites_with_roles(f), 2, 5).collect()
    assert [(r.repo, r.symbol, r.occurrences, r.n_files, r.arities, r.first_path) for r in c] == [
        ("r", "x.y", 5, 2, [0, 1, 2], "a.ts"), ("r", "z.w", 2, 1, [2], "a.ts")]


def test_scores_are_summed_where_the_document_lies(spark):
    """Only documents are shuffled: each of 40 has 30 of the words that 20 queries ask for."""
    docs = spark.createDataFrame([(i, " ".join(f"word{(i + j) % 50}" for j in range(30))) for i in range(40)], "id long, text string")
    queries = spark.createDataFrame([(i, " ".join(f"word{(3 * i + j) % 50}" for j in range(20))) for i in range(20)], "query_id long, text string")
    terms = query_terms(queries.select("query_id", F.array("text").alias("facets")))
    index = build_index(docs, vocabulary=terms.select("term").distinct(), small_vocabulary=True)
    pairs = score_pairs(terms, index, small_terms=True)
    assert _shuffled(index.postings) < 40 + 20 * 20 + 100
    assert not re.search(r"hashpartitioning\(query_id#\w+, id#", pairs._jdf.queryExecution().executedPlan().toString())
    words = {r.id: set(r.text.split()) for r in docs.collect()}
    asked = {r.query_id: set(r.text.split()) for r in queries.collect()}
    got = {(r.query_id, r.id): r.matched for r in pairs.collect()}
    assert got == {(q, d): len(a & w) for q, a in asked.items() for d, w in words.items() if a & w}


def test_references_without_a_table_of_shown_cards(spark):
    calls = spark.createDataFrame([("s", "1", 1, "usesAlpha(x)", False), ("s", "0", 0, "usesAlpha(y)", True), ("s", "2", 2, "usesAlpha and usesBeta", None),
                                   ("t", "3", 3, "common usesBeta", False), ("t", "4", None, "usesAlpha", False)],
                                  "session_id string, call_id string, seq int, arguments string, is_error boolean")
    cards = [(1, 0, "usesAlpha"), (2, 0, "usesBeta"), (None, 0, "usesAlpha")] + [(i, 1, "common") for i in range(10, 40)]
    n = spark.createDataFrame(cards, "id long, pos int, needle string")
    generic = pc.generic_needles(n)
    got = sorted((r.session_id, r.id, r.call_id, r.needle) for r in pc.references(None, calls, n, generic).collect())
    assert got == [("s", 1, "1", "usesAlpha"), ("s", 2, "2", "usesBeta"), ("t", 2, "3", "usesBeta")]
    shown = calls.select("session_id").distinct().crossJoin(n.select("id").distinct()).withColumn("seq", F.lit(-1))
    assert got == sorted((r.session_id, r.id, r.call_id, r.needle) for r in pc.references(shown, calls, n, generic).collect())


def test_hits_are_cut_where_the_document_lies(spark):
    """Of each query's 600 hits only some are sorted and shuffled; 32 slices of a task kept 3 each before."""
    docs = spark.createDataFrame([(i, " ".join(["alpha"] * (i % 37 + 1) + ["beta"] * (i % 5) + [f"own{i}"] * (i % 11))) for i in range(600)], "id long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (None, "beta alpha"), (4, "own7")], "query_id long, text string")
    terms = query_terms(queries.select("query_id", F.array("text").alias("facets")))
    index = build_index(docs, vocabulary=terms.select("term").distinct(), small_vocabulary=True).keep()
    scored = [(r.query_id, r.id, r.scores[0]) for r in score_pairs(terms, index, small_terms=True).collect()]
    want = []
    for q in {q for q, *_ in scored}:
        best = sorted((-s, i) for p, i, s in scored if p == q)[:3]
        want += [(q, i, n + 1) for n, (_, i) in enumerate(best)]
    hits = s.search(queries, docs, k=3, index=index)
    assert sorted(map(str, want)) == sorted(str((r.query_id, r.id, r.rank)) for r in hits.collect()) and len(want) == 10
    hits = s.search(queries, docs, k=3, index=index)
    assert _shuffled(hits) < 300


def test_shared_words_are_summed_as_bits(spark):
    """A list per pair was sorted by pair first."""
    many = [f"word{i:03d}" for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(many[i:i + 90:1 + i % 2] + ["use"])) for i in range(60)], "id long, text string")
    queries = spark.createDataFrame([(1, " ".join(many)), (2, "word070 word003 use"), (3, "use"), (None, "word099")], "query_id long, text string")
    terms = query_terms(queries.select("query_id", F.array("text").alias("facets")), ["use"])
    index = build_index(docs, vocabulary=terms.select("term").distinct(), small_vocabulary=True).keep()
    got = with_shared(terms, index, True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "collect_list(CASE" not in plan
    columns = ["query_id", "id", "scores", "matched", "strong", "generic", "shared"]
    rows = sorted(str(r) for r in score_pairs(terms, index, small_terms=True).select(columns).collect())
    assert rows == sorted(str(r) for r in got.select(columns).collect())
    assert {len(r.shared) for r in got.collect()} > {0, 1, 2, 90}


def test_shared_words_of_a_long_query_are_listed(spark):
    words = [f"w{i:04d}" for i in range(1100)]
    docs = spark.createDataFrame([(0, " ".join(words))], "id long, text string")
    terms = query_terms(docs.select(F.col("id").alias("query_id"), F.array("text").alias("facets")))
    assert with_shared(terms, build_index(docs)).first()["shared"] == words


def test_containment_makes_no_rows_for_pairs(spark):
    """Each of 60 texts has half its words in each of 60 others; 3,600 pairs were shuffled before."""
    a = spark.createDataFrame([(i, " ".join([f"common{j}" for j in range(8)] + [f"mine{i}x{j}" for j in range(8)])) for i in range(60)], "id long, text string")
    b = spark.createDataFrame([(i, " ".join([f"common{j}" for j in range(8)] + ([f"mine{i // 2}x0"] if i < 6 else []) + [f"other{i}"])) for i in range(60)], "id long, text string")
    best = setjoin.max_containment(a, b, 0.5)
    assert _shuffled(best) < 1000
    assert {r.id: (r.max_ratio, r.best_id) for r in best.collect()} == {i: (9 / 16, 2 * i) if i < 3 else (0.5, 0) for i in range(60)}
    assert setjoin.containment(a, b, 0.5).count() == 3600


def test_shared_tokens_of_a_block():
    """Whatever is counted as frequent, the pairs are those of the sets."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    a = [rnd.sample(words, rnd.randint(1, 12)) + [f"only{i}"] * (i % 2) for i in range(40)]
    b = [rnd.sample(words[:24], rnd.randint(0, 20)) for i in range(50)]
    block = pa.table({"id_b": pa.array(range(50)[::-1]), "toks_b": pa.array(b[::-1], pa.list_(pa.string()))})
    for threshold in (0.1, 0.5, 0.8):
        need = [max(-(-len(x) * int(threshold * 10) // 10), 1) for x in a]
        batch = pa.record_batch({"id_a": pa.array(range(40)), "toks_a": pa.array(a), "need": pa.array(need)})
        ratios = {(i, j): len(set(x) & set(y)) / len(x) for i, x in enumerate(a) for j, y in enumerate(b)}
        want = {k: r for k, r in ratios.items() if r * len(a[k[0]]) >= need[k[0]] - 1e-9}
        for dense in (0, 3, 1024):
            got = pa.Table.from_batches(list(setjoin._shared(False, dense)(block, iter([batch])))).to_pylist()
            assert {(r["id_a"], r["id_b"]): r["ratio"] for r in got} == want and len(got) == len(want)
            got = pa.Table.from_batches(list(setjoin._shared(True, dense)(block, iter([batch])))).to_pylist()
            assert sorted((r["id_a"], -r["ratio"], r["id_b"]) for r in got) == [
                min((i, -r, j) for (i, j), r in want.items() if i == n) for n in sorted({i for i, _ in want})]


def test_bounded_search_completes_the_best_pairs_only(spark, monkeypatch):
    """No bound tells these documents apart: 20 x 300 pairs of 8 words were rows before."""
    common = " ".join(f"common{j}" for j in range(8))
    docs = spark.createDataFrame([(i, f"{common} own{i}") for i in range(300)], "id long, text string")
    queries = spark.createDataFrame([(i, f"{common} own{7 * i}") for i in range(19)] + [(None, f"{common} own299")], "query_id long, text string")
    rows, sums = [], topk._sums

    def counted(pairs, *more):
        rows.append(pairs.count())
        return sums(pairs, *more)

    monkeypatch.setattr(topk, "_sums", counted)
    got = {(r.query_id, r.rank): r.id for r in s.search(queries, docs, k=3, max_pairs=0).collect()}
    assert sum(rows) < 20 * 8 * 300 / 10
    for q in [*range(19), None]:
        first = 299 if q is None else 7 * q
        assert [got[q, i] for i in (1, 2, 3)] == [first, *[i for i in range(4) if i != first][:2]]
    assert len(got) == 60


def test_a_text_is_made_once_for_all_identifiers(spark):
    """It was redacted again for each of the 4,000 names, some milliseconds each."""
    text = "Name7 and Name12 in " + "plain words of a long text " * 4000
    df = spark.createDataFrame([(text, [f"Name{i}" for i in range(4000)]), (None, ["Name7"]), ("Name7", None)], "text string, ids array<string>")
    began = time.time()
    got = df.select(rf.identifier_leaks(rf.redact(F.concat(rf.redact("text"), F.lit("."))), "ids").alias("r")).collect()
    clean = df.select(rf.deidentify(rf.redact("text"), "ids").alias("r")).collect()
    assert time.time() - began < 30
    assert [sorted(r.r) for r in got] == [["Name1", "Name12", "Name7"], [], []]
    assert clean[0].r.startswith("<Class1> and <Class2> in plain") and clean[1].r is None and clean[2].r == "Name7"


def test_needles_with_the_same_letters_at_the_separator(spark):
    """All 300 needles have "e.d" in them, as all calls do: each met each before, 30,000 rows."""
    needles = [(i, 0, f"Some{i:03d}Name.done{i:03d}") for i in range(300)] + [(900, 0, "e.do"), (901, 1, "a.b/cd"), (902, 0, "fs.readFile"), (903, 0, "x.e.d")]
    texts = [f"call.Some{i:03d}Name.done{i:03d}4(x) one.done e.d" for i in range(97)] + ["a.b/c a.b/cd fs.readFileSync", "fs.read x.e.do", ""]
    calls = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)] + [("s", 200, None)], "session_id string, call_id long, arguments string")
    n = spark.createDataFrame(needles, "id long, pos int, needle string")
    hits = pc.needle_hits(calls, n, ["session_id"])
    assert _shuffled(hits, ".*Join$", "numOutputRows") < 3000
    assert {(r.call_id, r.id) for r in hits.collect()} == {(i, id) for i, t in enumerate(texts) for id, _, x in needles if x in t}


def test_advice_counts_words_where_the_card_lies(spark):
    """Each of 60 calls shares words with all 80 cards: 4,800 pairs of 30 words were rows before."""
    rng = random.Random(4)
    words = [f"common{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    cards = [(i, f"2024-01-{i % 9 + 1:02d}", " ".join(["shared", *rng.sample(words, 30)])) for i in range(80)]
    cards += [(3, "2024-02-01", "shared commonaa")] + [(None, "2024-01-01", " ".join(words))]
    texts = ["shared." + ".".join(rng.sample(words, 20)) for _ in range(60)]
    tools = ["edit", "read", None]
    calls = [("s%d" % (i % 5), i, tools[i % 3], '{"note": "%s"}' % t) for i, t in enumerate(texts)] + [("s0", 0, "edit", '{"note": "%s"}' % texts[0]), (None, 99, "edit", '{"note": "shared.x"}')]
    precise = [("s%d" % (i % 5), i, j, j % 3) for i in range(60) for j in range(i % 7, 80, 11)]
    seen = [("s1", j) for j in range(0, 80, 2)] + [(None, 1), ("s2", None)]

    def want(k, named, hidden):
        held = {}
        for i, _, text in cards:
            held.setdefault(i, []).extend(dict.fromkeys(text.split()))
        out = []
        for s, c in dict.fromkeys(x[:2] for x in calls):
            mine = [(tool, t) for s2, c2, tool, args in calls if (s2, c2) == (s, c) for t in args[10:-2].split(".")]
            rows = []
            for i, ts, _ in cards:
                met = [t for _, t in mine for w in held[i] if w == t and len(t) > 4]
                if i is None or not met or s and (s, i) in hidden:
                    continue
                n = named.get((s, c, i))
                tool = mine[0][0]
                exact, several = (0, 0) if n is None or tool == "read" else (1, int(n >= 2)) if tool else (None, None if n >= 2 else 0)
                low = lambda x: -1 if x is None else x
                rows.append(((-low(exact), -low(several), -len(met), -sum(map(len, met)), tuple(-ord(x) for x in ts), i), (s, c, i, sorted(set(met)), len(met), sum(map(len, met)), exact)))
            out += [(*r, rank) for rank, (_, r) in enumerate(sorted(rows, key=lambda x: x[0])[:k], 1)]
        return sorted(out, key=str)

    c = spark.createDataFrame(cards, "id long, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    a = spark.createDataFrame(calls, "session_id string, call_id long, tool string, arguments string")
    p = spark.createDataFrame(precise, "session_id string, call_id long, id long, n_needles long")
    v = spark.createDataFrame(seen, "session_id string, id long")
    plain = pc.advise(a, c)
    assert _shuffled(plain) < 2000
    assert sorted(map(tuple, plain.collect()), key=str) == want(1, {}, set())
    names = {r[:3]: r[3] for r in precise}
    for k in (1, 3, 200):
        assert sorted(map(tuple, pc.advise(a, c, p, v, k).collect()), key=str) == want(k, names, set(seen))


def test_frequent_tokens_of_short_texts_take_bounded_memory():
    """A byte per text for each of 1,024 tokens was 102 MB here, 0.8 GB in a block of texts of ten tokens."""
    known = blocks.Postings(pa.array([[f"t{i % 2000}", "all"] for i in range(100_000)]))
    marks, rows = known.dense()
    assert marks.nbytes <= blocks.DENSE_BYTES and len(marks) >= 600
    for token in ("all", "t0", "t1999"):
        number = known.words.index(token).as_py()
        texts = known.texts[known.spans(np.array([number]))[0]]
        assert len(texts) == known.df[number] and (rows[number] < 0 or sorted(np.flatnonzero(marks[rows[number]])) == sorted(texts))
