"""Quality, language, near-duplicates: brute force and odd inputs."""

from collections import Counter, defaultdict
from math import log2, sqrt

import numpy as np
import pytest

from sessionmine.llm import components, langid, neardup, quality

from .conftest import prose


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- quality ---------------------------------------------------------------------

def brute_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts(spark, make_docs, odd_rows):
    texts = ["a b c d e " * 4, "x\ty\x0bz\nx\ty\x0bz\n\n \n q", "é# ünï|<>&", "a b c d e f a b c d e g a b c d e", "a " * 30 + "\u00a0 b\x1cc",
             " ", None, prose(1, 300) + "\n" + prose(1, 300)]
    docs = make_docs([(i, t, "en") for i, t in enumerate(texts)] + [(100 + (i or 0), t, x) for i, t, x in odd_rows])
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        if r["doc_id"] not in (100, 160):  # ids of two texts
            assert tuple(got[r["doc_id"]])[1:7] == brute_base(r["text"]), r["text"]


def test_divergence_is_jensen_shannon():
    p, q = np.array([2.0, 3.0, 0.0]), np.array([0.1, 0.4, 0.5])
    def kl(a, b):
        return sum(x * log2(x / y) for x, y in zip(a, b) if x)
    ps = p / p.sum()
    m = (ps + q) / 2
    assert quality.divergence(p, q[None])[0] == pytest.approx(sqrt((kl(ps, m) + kl(q, m)) / 2))
    assert quality.divergence(q, q[None])[0] == pytest.approx(0, abs=1e-7)


def test_quality_keeps_prose_and_drops_junk(spark, make_docs, odd_rows):
    clean = [(i, prose(i, 200, lang), lang) for i in range(60) for lang in ("en", "de")]
    clean = [(n, t, x) for n, (_, t, x) in enumerate(clean)]
    r = np.random.default_rng(1)
    junk = [(1000 + i, " ".join("".join(r.choice(list("#$%&*xyz"), 6)) for _ in range(120)), "en") for i in range(4)]
    docs = make_docs(clean + junk)
    kept = {x["doc_id"] for x in quality.filter_documents(docs).select("doc_id").collect()}
    assert kept == {i for i, _, _ in clean}
    assert quality.filter_documents(docs).columns == docs.columns
    short = quality.judge(make_docs([(1, "a b c", "en"), (2, None, None)])).collect()
    assert [x["kept"] for x in short] == [False, False]


def test_rare_languages_stay(spark, make_docs):
    """Languages with under a thousandth of all words: one with words for a reference, one without."""
    r = np.random.default_rng(1)
    junk = [(900 + i, " ".join("".join(r.choice(list("#$%&*xyz"), 6)) for _ in range(120)), "en") for i in range(4)]
    large = [(i, " ".join([prose(i, 250)] * 700), "en") for i in range(40)]
    greek = str.maketrans("abcdefghiklmnoprstuvw", "αβψδεφγηικλμνοπρστθωχ")
    cyrillic = str.maketrans("abcdefghiklmnoprstuvw", "абцдефгхиклмнопрстувш")
    some = [(500 + i, prose(i, 300, "de").translate(greek), "el") for i in range(20)]
    few = [(600 + i, prose(i, 300, "de").translate(cyrillic), "sr") for i in range(3)]
    docs = make_docs(large + some + few + junk)
    got = {x["doc_id"]: x for x in quality.judge(docs).collect()}
    assert set(quality.learn(docs).languages) == {"en", "el"}
    assert all(got[i]["kept"] and got[i]["nearest"] == "el" for i, _, _ in some)
    assert all(got[i]["kept"] and got[i]["nearest"] is None for i, _, _ in few)
    assert not any(got[i]["kept"] for i, _, _ in junk)
    assert {i for i, _, _ in some + few} <= {x["doc_id"] for x in quality.filter_documents(docs).select("doc_id").collect()}


# ---- language --------------------------------------------------------------------

def brute_model(texts, order=4):
    """Interpolated Kneser-Ney with dictionaries, straight from the definition."""
    counts = Counter()
    for t in texts:
        a = langid.units(t).tolist()
        for i in range(3, len(a)):
            counts[tuple(a[i - 3:i + 1])] += 1
    levels = [counts]
    for n in range(order - 1, 0, -1):
        levels.insert(0, Counter(g[-n:] for g in levels[0]))
    return levels


def brute_logp(levels, vocabulary, gram):
    n = len(gram)
    lower = 1 / vocabulary if n == 1 else brute_logp(levels, vocabulary, gram[1:])
    c = levels[n - 1]
    ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
    after = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
    total = sum(after.values())
    if not total:
        return lower
    return max(c.get(gram, 0) - d, 0) / total + d * len(after) / total * lower


def test_model_equals_definition(spark, make_docs):
    texts = {"de": [prose(i, 20, "de") for i in range(3)], "en": [prose(i, 20) for i in range(3)]}
    docs = make_docs([(i, t, x) for x, ts in texts.items() for i, t in enumerate(ts)])
    model = langid.learn(docs)
    assert model.languages == ("de", "en")
    levels = {x: brute_model(ts) for x, ts in texts.items()}
    vocabulary = len({g for x in levels for g in levels[x][0]}) + 1
    a = langid.units("The qüick tion und Zung xx")
    got = model.logp(a)
    for j, x in enumerate(model.languages):
        want = [np.log(brute_logp(levels[x], vocabulary, tuple(a[i - 3:i + 1].tolist()))) for i in range(3, len(a))]
        assert np.allclose(got[:, j], want, atol=1e-4)


def test_identify(spark, make_docs, odd_rows):
    train = [(i, prose(i, 50, x), x) for i, x in enumerate(["en", "de"] * 150)]
    rows = train + [(1000, None, "en"), (1001, "", "de"), (1002, "12 %%", "en"), (1003, "THE OF AND", None), (None, prose(5, 40, "de"), "de")]
    rows += [(2000, "".join(np.random.default_rng(3).choice(list("qxzjkvw bq"), 900)), "en")]
    got = {r["doc_id"]: r for r in langid.identify(make_docs(rows)).collect()}
    import zlib

    for i, _, x in train:
        assert got[i]["lang_pred"] == x and got[i]["accepted"] and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and not got[1000]["accepted"]
    assert got[1003]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and not got[2000]["accepted"]
    kept = langid.filter_documents(make_docs(rows))
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i, _, _ in train} <= ids and not ids & {1000, 1001, 1002, 2000} and kept.columns == make_docs(rows).columns


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in r) / len(r) > 0.98


def test_scan_in_runs_is_the_same(monkeypatch, spark, make_docs):
    model = langid.learn(make_docs([(i, prose(i, 50, x), x) for i, x in enumerate(["en", "de"] * 10)]))
    text = prose("x", 400)
    whole = langid.predict(text, model)
    monkeypatch.setattr(langid, "_CHUNK", 97)
    assert langid.predict(text, model)[2] == pytest.approx(whole[2])


@pytest.mark.parametrize("max_cells", [40, 200])
def test_large_models_are_whole(spark, make_docs, max_cells):
    """In parts of one language (40) and whole languages (200): the definition's values."""
    texts = {"de": [prose(i, 20, "de") for i in range(3)], "en": [prose(i, 20) for i in range(3)], "fr": ["le la et des déjà où"]}
    docs = make_docs([(i, t, x) for x, ts in texts.items() for i, t in enumerate(ts)])
    small, large = langid.learn(docs), langid.learn(docs, max_cells)
    assert len(large.pieces) > 1 and (max_cells > 40 or max(x.parts for x in large.pieces) > 1)
    asked = ["The qüick tion und Zung xx", None, "12", *texts["de"], *texts["en"], "déjà 語 vu"]
    for got, want in zip(langid.predict_all(asked, large), langid.predict_all(asked, small)):
        assert got[0] == want[0] and got[3] == want[3]
        assert got[1:3] == (want[1:3] if want[2] is None else pytest.approx(want[1:3], abs=1e-4))
    columns = [c for c in docs.columns if c != "p"]
    want = rows_of(langid._scored(docs, small, columns).select("doc_id", "_found.lang_pred", "_found.n_units").sort("doc_id", "n_units"))
    assert rows_of(langid._scored(docs, large, columns).select("doc_id", "_found.lang_pred", "_found.n_units").sort("doc_id", "n_units")) == want


# ---- near-duplicates -------------------------------------------------------------

def brute_groups(rows, size, percent):
    nodes = [(i, neardup.shingle_set(t, size) if neardup.words_of(t) else set()) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(nodes):
        for j, b in nodes[:n]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_all_pairs(spark, make_docs, odd_rows, size):
    import random

    r = random.Random(size)
    rows = list(odd_rows)
    for g in range(6):  # groups of near copies around the threshold
        base = prose(f"g{g}", 40 + 90 * g).split()
        for k in range(12):
            w = list(base)
            for at in r.sample(range(len(w)), max(1, len(w) * k // 120)):
                w[at] = f"z{r.random()}"
            rows.append((1000 + 100 * g + k, " ".join(w), "en"))
    got = neardup.link_documents(make_docs(rows), size, 80).collect()
    want = brute_groups(rows, size, 80)
    assert {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None} == want
    assert len(got) == len(rows) and all(x["kept"] == (x["doc_id"] in (None, x["component_id"])) for x in got)
    assert all(x["component_id"] is None for x in got if x["doc_id"] is None)
    sets = Counter((i, len(neardup.shingle_set(t, size)) if neardup.words_of(t) else 0) for i, t, _ in rows)
    assert Counter((x["doc_id"], x["n_shingles"]) for x in got) == sets


def test_one_of_each_group_stays(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = neardup.filter_documents(docs)
    want = sorted({v for k, v in brute_groups(odd_rows, 5, 80).items()})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want
    assert kept.filter("doc_id IS NULL").count() == 1 and kept.columns == docs.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(20)] + [(5, 5), (7, 3), (None, 2), (200, 201)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 121)}, 200: 200, 201: 200}


def test_empty_tables(spark, make_docs):
    none = make_docs([(1, "x", "en")]).limit(0)
    assert quality.judge(none).count() == quality.filter_documents(none).count() == 0
    assert langid.identify(none).count() == langid.filter_documents(none).count() == 0
    assert neardup.link_documents(none).count() == neardup.filter_documents(none).count() == 0
