"""Exact clustering, vector codes and whole-document packing against plain Python."""

import hashlib
from collections import Counter
from itertools import product
from math import floor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sessionmine.llm import bestfit, clusters, codes, vectors

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "vec_id long, embedding array<float>, label int, q string, cluster string, distance double, code int, _of int, stored int"


def make(spark, rows):
    return spark.createDataFrame([(i, e, label, "q", "c", 0.5, 1, 2, 3) for i, e, label in rows], SCHEMA)


def odd_vectors(seed=0, dims=64):
    """Nulls, other lengths, ties, repeated rows and ids, large and far vectors."""
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(0, 0.3, dims).astype(np.float32).tolist(), int(i % 4)) for i in range(120)]
    rows += [(200 + i, [0.25] * dims, None) for i in range(9)] + [(3, rows[3][1], 3), (3, rows[3][1], 3), (4, rows[5][1], None)]
    rows += [(None, rows[7][1], 1), (300, None, 0), (301, [], 0), (302, [0.5] * (dims - 1), 1), (303, [None] + [0.1] * (dims - 1), 1),
             (304, [float("nan")] + [0.1] * (dims - 1), 2), (305, [float("inf")] * dims, 2), (306, [1000.0] * dims, 2), (307, [-1000.25] * dims, None)]
    return rows


def whole_list(e, scale):
    return [floor(scale * float(x)) for x in e]


def fine(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e)


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def first_nearest(v, centres):
    d = [far(v, c) for c in centres]
    return d.index(min(d)), min(d)


def floored(rows):
    return [sum(c) // len(rows) for c in zip(*rows)]


# ---- clustering --------------------------------------------------------------------

def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, whole_list(e, 64)) for i, e, _ in rows if e is not None and len(e) == 64 and fine(e)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in start[:k]]
    for _ in range(rounds):
        got = [first_nearest(v, centres)[0] for _, v in kept]
        centres = [floored(m) if (m := [v for (_, v), g in zip(kept, got) if g == c]) else old for c, old in enumerate(centres)]
    out = [(i, *first_nearest(v, centres)) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), name[c]) for i, c, d in out)


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors()[:5], [(1, [0.0] * 64, 1)] * 40])
def test_clusters(spark, rows):
    df = clusters.cluster(make(spark, rows))
    assert df.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, df.collect())) == brute_clusters(rows)


def test_clusters_without_vectors(spark):
    assert clusters.cluster(make(spark, odd_vectors()).limit(0)).count() == 0
    assert clusters.cluster(make(spark, [(300, None, 0), (301, [], 0)])).count() == 0
    assert clusters.cluster(make(spark, [(None, [1.0] * 64, 0)])).count() == 0  # no id, so no centroid


def test_bounds_save_distances_and_lose_no_tie():
    r = np.random.default_rng(1)
    centres = r.integers(-50, 50, (16, 64))
    rows = np.concatenate([centres[r.integers(0, 16, 500)] + r.integers(-3, 4, (500, 64)), (centres[:1] + centres[1:2]) // 2, centres[[3, 3]]])
    centres = np.concatenate([centres, centres[:2]])  # equal centroids
    pivots = clusters.spread_out(centres, 8)
    best, distance, exact = clusters.nearest(rows, clusters.to_pivots(rows, pivots), centres, pivots)
    want = [first_nearest(v, centres.tolist()) for v in rows.tolist()]
    assert list(zip(best.tolist(), distance.tolist())) == want
    assert exact < 0.4 * len(rows) * len(centres)


def test_too_large_components_end_the_job():
    with pytest.raises(ValueError):
        vectors.whole(pa.array([[1e30, 0.0]], pa.list_(pa.float64())), 64, 2)


# ---- codes -------------------------------------------------------------------------

def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, whole_list(e, 4096)) for i, e, label in rows if fine(e)]
    fits = sorted((i, v) for i, _, v in kept if i is not None and v and len(v) % parts == 0)
    dims = len(fits[0][1]) if fits else 0
    w = dims // parts
    split = lambda v: [v[p * w:(p + 1) * w] for p in range(parts)]
    start = [split(v) for _, v in fits if len(v) == dims][:entries]
    books = [[s[p] for s in start] for p in range(parts)]
    whole = [split(v) for _, _, v in kept if len(v) == dims and dims]
    for _ in range(rounds if dims else 0):
        for p in range(parts):
            got = [first_nearest(v[p], books[p])[0] for v in whole]
            books[p] = [floored(m) if (m := [v[p] for v, g in zip(whole, got) if g == e]) else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, label, v in kept:
        near = [first_nearest(x, b) for x, b in zip(split(v), books)] if dims and len(v) == dims else None
        code = "".join(f"{n:02x}" for n, _ in near) if near else None
        error = sum(d for _, d in near) if near else None
        out.append((i, label, code, error))
        sums[label] = sums.get(label) if error is None else (sums.get(label) or 0) + error
    return Counter((i, code, error, sums[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize("rows", [odd_vectors(2), odd_vectors(2)[:5], [(1, [0.5] * 16, None)] * 20, odd_vectors(3, 16) + [(None, [1.0] * 16, 1)]])
def test_codes(spark, rows):
    df = codes.encode(make(spark, rows))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, df.collect())) == brute_codes(rows)


def test_codes_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "is_small", lambda df: False)
    assert Counter(map(tuple, codes.encode(make(spark, odd_vectors(4))).collect())) == brute_codes(odd_vectors(4))


def test_codes_without_vectors(spark):
    assert codes.encode(make(spark, odd_vectors()).limit(0)).count() == 0
    got = codes.encode(make(spark, [(1, [0.5] * 7, 3), (2, None, 3), (3, [], None)])).collect()
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got} == {(1, None, None, None), (3, None, None, None)}


@pytest.mark.parametrize("bits", [None, 3, 11])
def test_limb_products_are_exact(bits):
    r = np.random.default_rng(5)
    for top in (1, 100, 1 << 20, (1 << 27) - 1, 1 << 28):
        a, b = r.integers(-top, top + 1, (40, 8)), r.integers(-top, top + 1, (16, 8))
        a[0], b[0] = -top, -top
        assert (codes.products(a, b, bits) == a @ b.T).all()
        back = sum(x.astype(np.int64) << (bits or 24) * i for i, x in enumerate(codes.limbs(a, bits or 24)))
        assert (back == a).all()


# ---- best fit ----------------------------------------------------------------------

def test_fullest_is_the_best_subset_sum():
    r = np.random.default_rng(6)
    for _ in range(80):
        counts = {int(k): int(r.integers(1, 4)) for k in r.integers(1, 30, 5)}
        room = int(r.integers(0, 70))
        best = max(s for n in product(*[range(c + 1) for c in counts.values()]) if (s := sum(a * b for a, b in zip(n, counts))) <= room)
        chosen = bestfit.fullest(counts, room)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


def test_bins_use_every_piece_and_are_few():
    r = np.random.default_rng(7)
    histogram = Counter(np.minimum(2048, r.lognormal(6, 1, 5000).astype(int) + 1).tolist())
    plan, used = bestfit.bins(histogram), Counter()
    for combination, times in plan:
        assert times > 0 and sum(k * n for k, n in combination.items()) <= 2048
        used.update({k: n * times for k, n in combination.items()})
    assert used == histogram
    assert sum(t for _, t in plan) <= -(-sum(k * n for k, n in histogram.items()) // 2048) + 2
    assert bestfit.bins({}) == []


def test_best_fit(spark, make_docs, odd_rows):
    rows = odd_rows + [(400, "a b\n\nc  <|endoftext|> d", "en")]
    docs = make_docs(rows)
    pieces = bestfit.cut(docs, BYTE, end_id=0)
    got = bestfit.pack(pieces).collect()
    plain, want = Tokenizer.from_file(BYTE), Counter()
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((i, n, a, tuple(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert bestfit.pack(bestfit.cut(docs.limit(0), BYTE, end_id=0)).count() == 0


def test_best_fit_keeps_clashing_columns(spark):
    pieces = spark.createDataFrame([(1, 0, 5, 9, 9, "r", "p", 3, 4), (1, 1, 5, 9, 9, "r", "p", 3, 4), (None, None, 2048, 9, 9, "r", "p", 3, 4)],
                                   "doc_id long, piece int, length long, sequence_id int, offset int, row string, part string, own long, first long")
    got = bestfit.pack(pieces)
    assert got.columns == ["doc_id", "piece", "length", "row", "part", "own", "first", "sequence_id", "offset"]
    assert sorted((r["sequence_id"], r["offset"], r["row"], r["own"]) for r in got.collect()) == [(0, 0, "r", 3), (1, 0, "r", 3), (1, 5, "r", 3)]
