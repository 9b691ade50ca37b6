"""Packing, token files, media, sharding, licences, URLs, mixing."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionmine.llm import licences, media, mixing, packing, queries, sharding, textids, tokenfiles, urls

from .conftest import prose

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = ["a\n\nb  c", "  lead", " x", "trail ", "t\n", "don't 'S I'm we'll", "a\tb c\x0bd", "é a \u0301b", "ΑΣ ΣΑΣ. Σ", "<|endoftext|> x",
             "hello <|endoftext|> world", "a <|startoftext|>", "\x85 a\xa0b  c", "\x1c a", "x\n y", "日本 語。\nx", "\x00 a b", "123 45,6 #$% don''t", "",
             None, "a b", "line.\nNext line\nlast", "  ", "\n", "a \n\n b\r\n\r\nc \t", "\t\t x", "x  \n", "a\u3000 b", "a= \u0338b", "a=\u0338b"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_segments_give_the_tokenizers_ids(path, monkeypatch):
    monkeypatch.setattr(textids, "MEMORY", 200)
    plain, encoder, r = Tokenizer.from_file(path), textids.Encoder(path), random.Random(3)
    marks = [" ", "  ", "\n", "\t", "a", "b1", "'s", "é", ".", "!", "\r", "\u2003", "\u0301", "Σ", "\u200b", "don", "-", "_"]
    texts = ODD_TEXTS + [prose(i, 50, x) for i in range(5) for x in ("en", "de")] + [
        "".join(r.choices(marks, k=r.randint(0, 14))) for _ in range(1500)]
    for at in (0, 0, 7, 400):  # the second time from memory, then slices of an array
        ids, sizes = encoder.encode(pa.array(texts).slice(at, 1000), 1)
        ends = np.cumsum(sizes)
        assert ends[-1] == len(ids)
        for text, a, b in zip(texts[at:at + 1000], ends - sizes, ends):
            assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [1], repr(text)
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()), 1)] == [0, 0]


def test_cut_ids():
    ids, sizes = np.arange(12, dtype=np.uint32), np.array([5, 1, 6])
    for short_first, want in ((False, [[0, 1], [2, 3], [4], [5], [6, 7], [8, 9], [10, 11]]), (True, [[0], [1, 2], [3, 4], [5], [6, 7], [8, 9], [10, 11]])):
        p = textids.cut_ids(ids, sizes, 2, short_first)
        assert [np.frombuffer(x, "<u4").tolist() for x in p["ids"].to_pylist()] == want
        assert p["row"].to_pylist() == [0, 0, 0, 1, 2, 2, 2] and p["piece"].to_pylist() == [0, 1, 2, 0, 0, 1, 2]
        assert p["length"].to_pylist() == [len(x) for x in want] and p["start"].to_pylist() == [w[0] - [0, 5, 6][r] for w, r in zip(want, p["row"].to_pylist())]


# ---- packing ---------------------------------------------------------------------

def test_fill_is_the_best_subset_sum():
    r = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(k): int(r.integers(1, 4)) for k in r.integers(1, 30, 5)}
        room = int(r.integers(1, 70))
        best = max(s for n in product(*[range(c + 1) for c in counts.values()]) if (s := sum(a * b for a, b in zip(n, counts))) <= room)
        chosen = packing.fill(counts, room)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in Counter(r.integers(1, 2049, 4000).tolist()).items()}
    windows = packing.plan(histogram)
    used = Counter()
    for w in windows:
        assert sum(k * n for k, n in w.counts.items()) <= 2048
        used.update({k: n * w.times for k, n in w.counts.items()})
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(w.times for w in windows) <= 1.01 * total / 2048 + 3


def test_pack(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = packing.place(packing.cut(docs, BYTE, end_id=1)).collect()
    plain = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t, _ in odd_rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((i, at, tuple(ids[at:at + 2048]), len(ids)) for at in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by) <= total // 2048 + 2
    assert packing.place(packing.cut(docs.limit(0), BYTE, end_id=1)).count() == 0


# ---- token files -----------------------------------------------------------------

def test_token_files_round_trip(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows).repartition(3)
    files = tokenfiles.write(docs, WORD, 2, folder=f"file://{tmp_path}/f", length=64)
    got = sorted(tokenfiles.read(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got][0] is None and [r["doc_id"] for r in got][1:] == sorted(i for i, _, _ in odd_rows if i is not None)
    plain, at = Tokenizer.from_file(WORD), 0
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in odd_rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    for f in files.collect():
        reader = tokenfiles.Reader(f["file"])
        ids, mask = reader.sequence(f["n_sequences"] - 1)
        assert mask.buffers()[1].address == reader.file.get_batch(reader.file.num_record_batches - 1).column(1).values.buffers()[1].address  # a view
        assert len(ids) == len(mask) == 64 and mask.true_count == f["n_tokens"] - 64 * (f["n_sequences"] - 1)
        assert (reader.sequence(0)[0] == reader.tokens(0, 64)[:64]).all() and not ids.flags.owndata
    assert tokenfiles.read(tokenfiles.write(docs.limit(0), WORD, 2)).count() == 0


# ---- media -----------------------------------------------------------------------

def test_rolling_hash_is_the_gear_recurrence():
    data = bytes(np.random.default_rng(2).integers(0, 256, 500, dtype=np.uint8))
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.rolling(data).tolist() == want


def test_cuts_survive_an_insertion():
    data = np.random.default_rng(3).integers(32, 127, 60_000, dtype=np.uint8).tobytes()
    a, b = media.chunks_of(data), media.chunks_of(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(a) == data and max(map(len, a)) <= media.MAX_CHUNK
    assert all(len(c) >= media.MIN_CHUNK for c in a[:-1]) and len(set(a) & set(b)) >= len(a) - 3


def test_media_round_trip(spark, make_docs, odd_rows):
    shared = prose("passage", 8000)
    rows = odd_rows + [(200, "a " + shared, "en"), (201, "bb " + shared + " end", "en"), (202, shared + shared, "en")]
    store = media.write(make_docs(rows))
    got = media.read(store).collect()
    want = Counter()
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        whole = media.header_of(len(p)) + p
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(whole), hashlib.sha256(whole).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"])
                   for r in got) == want and all(r["verified"] for r in got)
    chunks = store.chunks.collect()
    assert len({bytes(c["digest"]) for c in chunks}) == len(chunks) > 0
    stored = store.objects.select(F.sum(F.octet_length("own"))).first()[0] + sum(len(c["bytes"]) for c in chunks)
    distinct = {hashlib.sha256(media.payload_of(t)).digest(): len(media.payload_of(t)) for _, t, _ in rows}
    assert stored < sum(distinct.values()) - 2 * len(shared)
    assert media.read(media.write(make_docs(rows).limit(0))).count() == 0


def test_a_wrong_chunk_is_found():
    part = b"x" * 300
    with pytest.raises(ValueError):
        media.rebuilt([{"digest": media.digest_of(part), "length": 300}], [], b"y" * 300, {})


# ---- sharding --------------------------------------------------------------------

def test_shards_fit_and_split_only_where_needed(spark, make_docs, odd_rows):
    rows = odd_rows + [(900, "same " * 100, "en")] * 9
    got = sharding.assign(make_docs(rows), 2000).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    sizes, count = Counter(), Counter()
    for r in got:
        sizes[r["shard"], r["part"]] += r["n_bytes"]
        count[r["shard"], r["part"]] += 1
    assert all(n <= 2000 or count[k] == 1 for k, n in sizes.items())
    names = {r["shard"] for r in got}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    total = Counter()
    for r in got:
        for d in range(r["depth"]):
            total[r["shard"][:d]] += r["n_bytes"]
    assert all(n > 2000 for n in total.values())
    assert sharding.assign(make_docs(rows).limit(0), 2000).count() == 0


def test_written_shards(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows)
    listed = sharding.write(docs, f"file://{tmp_path}/shards", 4000)
    back = spark.read.parquet(f"file://{tmp_path}/shards").drop("shard_name")
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert listed.agg(F.sum("n_rows")).first()[0] == len(odd_rows)


# ---- licences --------------------------------------------------------------------

def test_licence_scan(spark, make_docs):
    mit = licences.TEXTS["MIT"]
    rows = [(1, mit, ""), (2, "Copyright (c) 2020 A. Author\n\n" + mit.upper().replace(",", " ;"), ""), (3, mit + " more", ""),
            (4, licences.TEXTS["BSD-3-Clause"].replace("copyright holder", "copyright owner"), ""), (5, None, ""), (6, "", ""),
            (7, "text\nReleased under the MIT licence!\nmore", ""), (8, "Copyright X", ""), (9, "© someone\n" + licences.TEXTS["ISC"], ""), (None, mit, ""),
            (10, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.", "")]
    got = {r["doc_id"]: r for r in licences.scan(make_docs(rows)).collect()}
    assert {i: r["licence"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: None, 4: "BSD-3-Clause", 5: None, 6: None, 7: None, 8: None,
                                                         9: "ISC", 10: None, None: "MIT"}
    assert got[7]["notices"] == "MIT" and got[10]["notices"] == "CC-BY-NC-4.0,MIT" and got[1]["notices"] == ""
    assert got[5]["digest"] is None and got[8]["digest"] is None and got[1]["digest"] == got[2]["digest"]
    assert licences.scan(make_docs(rows).limit(0)).count() == 0


def test_published_licence_files(spark, make_docs):
    import textwrap
    from pathlib import Path

    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n"))
    titles = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License",
              "BSD-3-Clause": "BSD 3-Clause License", "MIT-0": "MIT No Attribution"}
    rows, want = [], {}

    def add(text, licence):
        want[len(rows)] = licence
        rows.append((len(rows), text, ""))

    for k, text in licences.TEXTS.items():
        for n in (60, 72, 76, 79, 80):
            add(f"{titles[k]}\n\nCopyright (c) 2021 Some One\nAll rights reserved.\n\n{wrap(text, n)}\n", k)
        add(f"Copyright Some One <a@b.c>\n\n{wrap(text, 72)}".replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), k)
        add("".join(f"// {line}\n" for line in wrap(text, 70).split("\n")), k)
        add(wrap(text, 72) + "\nand one thing more\n", None)
    folder = Path("/usr/share/common-licenses")
    for k, name in {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}.items():
        if (folder / name).exists():
            text = (folder / name).read_text()
            end = text.find("END OF TERMS AND CONDITIONS")
            add(text, k)
            add("\n".join(line.strip() for line in text.split("\n")).upper(), k)
            add(text.replace("License", "Licence"), k)
            if end > 0:
                add(text[:end], k)
            add(text[:len(text) // 2], None)
    add("MIT License", None)
    add("a\nSPDX-License-Identifier: GPL-2.0-or-later\nb\nDistributed under the Mozilla Public License, version 2.0.", None)
    got = {r["doc_id"]: r for r in licences.scan(make_docs(rows)).collect()}
    assert {i: r["licence"] for i, r in got.items()} == want
    assert got[len(rows) - 2]["digest"] is None and got[len(rows) - 1]["notices"] == "GPL-2.0,MPL-2.0"



# ---- URLs ------------------------------------------------------------------------

def brute_urls(rows, rules):
    def split(url):
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]) if url and "://" in url else None
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fit = [r for r in rules if (host == (h := r.pattern.split("/")[0]) or host.endswith("." + h)) and path.startswith(r.pattern[len(h):])]
        return max(fit, key=lambda r: len(r.pattern), default=None)

    def grams(url):
        s = url.lower() + "\n"
        return [(k, s[i - k:i], s[i]) for i in range(len(s)) for k in range(min(4, i) + 1)]

    counts, totals = {v: Counter() for v in ("allow", "block")}, {v: Counter() for v in ("allow", "block")}
    for _, url in rows:
        if r := rule(*split(url)):
            for k, h, c in grams(url):
                counts[r.verdict][h, c] += 1
                totals[r.verdict][h] += 1
    size = len({c for v in counts for h, c in counts[v] if h == ""}) + 1

    def p(v, h, c):
        lower = p(v, h[1:], c) if h else 1 / size
        return (counts[v][h, c] + 5 * lower) / (totals[v][h] + 5)

    out = []
    for i, url in rows:
        host, path = split(url)
        r = rule(host, path)
        score = None
        if not r and url:
            s = url.lower() + "\n"
            score = sum(log(p("allow", s[max(0, j - 4):j], c) / p("block", s[max(0, j - 4):j], c)) for j, c in enumerate(s)) / len(s)
        out.append((i, host, path, r and r.pattern, r and r.verdict, score))
    return out


def test_urls_equal_brute_force(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    rows += [(None, "HTTP://A.EXAMPLE.ORG/es/1?x#y"), (900, None), (901, ""), (902, "no scheme"), (903, "x://h#a/b?c://d"), (904, "x://h?/q"), (2, rows[2][1]),
             (905, "http://ÄB.example.net/de/8")]
    got = urls.judge(spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in rows], "page_id long, url string, host string, path string, score double"),
                     queries.RULES).collect()
    want = brute_urls(rows, queries.RULES)
    key = lambda x: repr(x[:4])
    off = []
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4]
        if b[4]:
            assert a[4] == b[4]
        elif b[5] is None:
            assert a[4] == "block"
        else:
            off.append(abs(a[5] - b[5]))
    assert max(off) < 0.1 and sum(off) / len(off) < 2e-3  # n-grams may share a slot
    scores = {a[4]: [x[5] for x in map(tuple, got) if x[4] == a[4] and x[5] is not None] for a in map(tuple, got)}
    assert max(scores["block"]) < min(scores["allow"])


def test_urls_without_seeds(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(df, queries.RULES).orderBy("page_id").collect()] == ["allow", "block"]
    one = urls.judge(spark.createDataFrame([(1, "http://a.org/es/1"), (2, "http://a.b")], "page_id long, url string"), queries.RULES)
    assert [r["verdict"] for r in one.orderBy("page_id").collect()] == ["block", "block"]
    assert urls.judge(df.limit(0), queries.RULES).count() == 0


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_url_scores_of_many_grams_are_exact(spark, max_rows):
    """Unlike text in every URL: the tables fill with the input, and unseen n-grams stay unseen."""
    r = np.random.default_rng(5)
    def url(i):
        return f"http://h{i}.net/" + "".join(map(chr, r.integers(0x4E00, 0x9000, 80)))

    decided = [(url(i), "block" if i % 2 else "allow") for i in range(1500)]
    asked = [decided[0][0], decided[1][0][:40] + "x"] + [url(i) for i in range(20)]
    model = urls.learn(spark.createDataFrame(decided, "url string, verdict string"))
    got = {x["url"]: x["score"] for x in urls.score(spark.createDataFrame([(u,) for u in asked], "url string"), model, ["url"], max_rows).collect()}
    n, t = {}, {}
    for u, verdict in decided:
        s = u.lower() + "\n"
        for i, c in enumerate(s):
            for k in range(min(urls.ORDER, i) + 1):
                n.setdefault((s[i - k:i], c), [0, 0])[verdict == "block"] += 1
                t.setdefault(s[i - k:i], [0, 0])[verdict == "block"] += 1
    size = len({c for h, c in n if not h}) + 1

    def q(h, c, side):
        lower = q(h[1:], c, side) if h else 1 / size
        return (n.get((h, c), (0, 0))[side] + urls.STRENGTH * lower) / (t.get(h, (0, 0))[side] + urls.STRENGTH)

    for u in asked:
        s = u.lower() + "\n"
        want = sum(log(q(s[max(0, i - urls.ORDER):i], c, 0) / q(s[max(0, i - urls.ORDER):i], c, 1)) for i, c in enumerate(s)) / len(s)
        assert got[u] == pytest.approx(want, abs=2e-6), u


# ---- mixing ----------------------------------------------------------------------

def brute_posteriors(rows, labels, domains, fold):
    """Loops over whole words, with numpy's solver; `fold` maps a text to its fold."""
    words = [[w for w in re.split(r"[\s.,;:!?\"'()]+", (t or "").lower()) if w] for _, t, _ in rows]
    known = {(d, tuple(ws)) for (i, _, _), ws in zip(rows, words) for j, d in labels if i == j and d in domains}
    taught = [(d, set(ws)) for d, ws in known if fold[ws] > 0]
    size = Counter(d for d, _ in taught)
    n = Counter((d, w) for d, s in taught for w in s)
    total, weights = len(taught), {}
    for w in {w for _, s in taught for w in s}:
        every = sum(n[d, w] for d in domains)
        q = every / total
        weights[w] = []
        for d in domains:
            odds = log((n[d, w] + 50 * q) / (size[d] + 50) / ((every - n[d, w] + 50 * q) / (total - size[d] + 50)))
            z2 = (n[d, w] - size[d] * q) ** 2 / (size[d] * q * (1 - q) + 1)
            weights[w].append(odds * z2 / (z2 + 9))

    def inputs(ws, i):
        have = [weights[w][i] for w in set(ws) if w in weights]
        return [1.0, sum(have) / (len(set(ws)) + 1) ** 0.5, max(have, default=0.0), log(1 + len(ws)) / 10]

    held = [(d, ws) for d, ws in known if fold[ws] == 0]
    chances = []
    for i, d in enumerate(domains):
        x = np.array([inputs(ws, i) for _, ws in held])
        y = np.array([float(e == d) for e, _ in held])
        beta = np.array([log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0, 0, 0])
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ beta))
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1, 1, 1])
            beta = beta + np.linalg.solve(curve, x.T @ (y - p) - np.array([0, 1, 1, 1]) * beta)
        chances.append([1 / (1 + np.exp(-np.dot(inputs(ws, i), beta))) for ws in words])
    return [(r[0], [c / sum(cs) for c in cs]) for r, *cs in zip(rows, *chances)]


def test_mixing(spark, make_docs, odd_rows):
    rows = [(i, prose(i, 40) + (" scum" if i % 7 == 0 else "") + (" noise noise | |" if i % 5 == 0 else ""), "en") for i in range(300)] + [x for x in odd_rows[-12:] if x[0] != 57]
    rows = [(i if i is None or n < 300 else 1000 + n, t, x) for n, (i, t, x) in enumerate(rows)]
    labels = [(i, "toxic" if i % 7 == 0 else "low" if i % 5 == 0 else "clean") for i in range(0, 300, 2)] + [(1, None), (5000, "clean")]
    targets = {"clean": 0.62, "low": 0.2, "toxic": 0.18}
    labelled = spark.createDataFrame(labels, "doc_id long, domain string")
    got = mixing.mix(make_docs(rows), labelled, targets).collect()
    numbered = mixing.features(make_docs(rows), ["doc_id", "text"])
    folds = (mixing.teachers(numbered, labelled, list(targets)).join(numbered, "_row")
             .select("text", "fold").collect())
    cut = lambda t: tuple(w for w in re.split(r"[\s.,;:!?\"'()]+", t.lower()) if w)
    want = sorted(brute_posteriors(rows, labels, list(targets), {cut(r["text"]): r["fold"] for r in folds}), key=repr)
    have = sorted(((r["doc_id"], [r[f"p_{d}"] for d in targets]) for r in got), key=repr)
    for (i, p), (j, q) in zip(sorted(have, key=lambda x: (x[0] is None, x[0])), sorted(want, key=lambda x: (x[0] is None, x[0]))):
        assert i == j and p == pytest.approx(q, abs=6e-3)
    total = sum(r["n_tokens"] for r in got)
    rates = [1.0] * len(got)
    sums = lambda: [sum(r["n_tokens"] * r[f"p_{d}"] * x for r, x in zip(got, rates)) for d in targets]
    start = now = sums()
    for _ in range(mixing.MAX_STEPS):  # a plain loop of projected gradient steps
        error = [(x - total * s) / h for x, s, h in zip(now, targets.values(), start)]
        rates = [max(0.0, min(4.0, x - sum(r[f"p_{d}"] * e for d, e in zip(targets, error)))) for r, x in zip(got, rates)]
        before, now = now, sums()
        if max(abs(x - y) / h for x, y, h in zip(now, before, start)) < mixing.TOLERANCE:
            break
    assert [r["rate"] for r in got] == pytest.approx(rates, abs=1e-4)
    for d, share in targets.items():
        assert sum(r["n_tokens"] * r[f"p_{d}"] * r["rate"] for r in got) == pytest.approx(share * total, rel=0.02)
    assert all(abs(r["copies"] - r["rate"]) < 1 and 0 <= r["rate"] <= 4 for r in got)
    kept = mixing.filter_documents(make_docs(rows), labelled, targets, anchor="clean")
    assert kept.columns == make_docs(rows).columns and 0 < kept.count() <= len(rows)
    clean = {i for i, d in labels if d == "clean" and i < 300}
    stay = {r["doc_id"] for r in kept.collect()}
    assert len(clean & stay) > 0.9 * len(clean)


def test_mixing_tells_domains_apart(spark):
    """Accuracy on labelled test documents whose labels were left out, and more than one
    posterior on the smallest tables."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = queries.domains(labels).withColumn("out", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    got = mixing.mix(docs, known.filter("not out"), queries.MIX).join(known.filter("out"), "doc_id").collect()
    mean = lambda d, e: (lambda v: sum(v) / len(v))([r[f"p_{d}"] for r in got if r["domain"] == e])
    for d in ("clean", "low", "toxic"):
        others = [mean(d, e) for e in ("clean", "low", "toxic") if e != d]
        assert mean(d, d) > max(others), d
    assert len({r["p_toxic"] for r in got}) > 10


def test_mixing_without_labels(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix(make_docs(odd_rows), none, {"a": 1.0, "b": 1.0}).collect()
    assert len(got) == len(odd_rows) and {r["p_a"] for r in got} == {0.5}
    assert mixing.mix(make_docs(odd_rows).limit(0), none, {"a": 1.0, "b": 1.0}).count() == 0
