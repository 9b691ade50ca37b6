"""Language identification with Kneser-Ney character models (operator 9).

Character 4-grams of all training texts are counted in Spark. Interpolated Kneser-Ney models
of orders 1 to 4 are built from these counts, one per language, and kept in sorted arrays of
n-gram hashes with one column of log-probabilities per language. A text gets the language
with the lowest cross-entropy per character. It is rejected where that cross-entropy lies
far above what texts of this language have, allowing for the text's length.

Models of any size are whole. Those over `MAX_CELLS` are made and sent in pieces, by
language and, within a large one, by the middle of the n-grams; a task holds one piece at a
time and adds up what the pieces say about its texts.

Defined results: a null text and a text without a letter are `und` with score 0 and are
rejected. Ties go to the language that comes first in order. Rows whose `lang` is null teach
nothing; without any training text every row is `und`. Repeated rows count each time and
are judged alike. Further columns are passed through by `filter_documents` only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import slices, stage

ORDER = 4
UNDETERMINED = "und"
#: Languages x 4-grams of one piece of the model.
MAX_CELLS = 16_000_000
#: A text is rejected so many deviations above its language's median; short texts get
#: proportionally more room. The deviation comes from the quartiles, so odd texts among those
#: learned from do not widen it.
MAX_DEVIATIONS = 30.0
MIN_DEVIATION = 0.02
FULL_LENGTH = 400
_SCORE_CHARS = 20
_PRIME = 1_000_003
_U = np.uint64


def _folding() -> np.ndarray:
    """Letters in lower case, every other UTF-16 unit a space (surrogates count as letters)."""
    fold = np.full(65536, 32, np.uint16)
    for c in range(65536):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            fold[c] = c
        elif ch.isalpha():
            low = ch.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


_FOLD = _folding()


def units(text: str) -> np.ndarray:
    """Folded text with single spaces between words and around it; empty without letters."""
    a = _FOLD[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]
    blank = a == 32
    if blank.all() or not any(c.isalpha() for c in text):
        return a[:0]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    a = a[keep]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint16), a[int(a[0] == 32):], np.full(int(a[-1] != 32), 32, np.uint16)])


def grams(a: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each unit after the leading pad, 16 bits a unit."""
    key = np.zeros(len(a) - ORDER + 1, _U)
    for i in range(n):
        key = (key << _U(16)) | a[ORDER - n + i:ORDER - n + i + len(key)].astype(_U)
    return key


def hashes(keys: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits, so equal hashes are equal n-grams."""
    h = keys * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, back, np.concatenate([n for _, n in parts]))
    return keys, counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, counts = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)],
                                          names=["lang", "gram", "n"])

    for part, texts in slices(batches):
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts):
            a = units(text)
            if len(a):
                found.setdefault(lang, []).append(grams(a))
        for lang, keys in found.items():
            new = np.unique(np.concatenate(keys), return_counts=True)
            held[lang] = _merge([held[lang], new]) if lang in held else new
            if len(held[lang][0]) > 1_000_000:
                yield out(lang)
    for lang in list(held):
        yield out(lang)


def count_grams(docs: DataFrame) -> DataFrame:
    """`lang, gram, n` over all rows with a text and a language."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """N-grams of one order: sorted hashes and a row of log-probabilities for each; contexts
    of one unit less: sorted hashes and the log of the weight of the lower order."""

    hashes: np.ndarray
    logp: np.ndarray
    context_hashes: np.ndarray
    context_logw: np.ndarray


@dataclass
class Model:
    languages: tuple[str, ...]
    levels: list[Level]  # orders 1 to ORDER
    unseen: np.ndarray  # log-probability of a unit that no language has

    def logp(self, a: np.ndarray, n: int = ORDER, at: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each unit (or those at `at`) under each language."""
        if n == 0:
            return np.broadcast_to(self.unseen, (len(a) - ORDER + 1 if at is None else len(at), len(self.languages)))
        level = self.levels[n - 1]
        keys = grams(a, n)
        keys = keys if at is None else keys[at]
        h = hashes(keys)
        i, hit = _find(level.hashes, h)
        out = level.logp[i]
        miss = np.flatnonzero(~hit)
        if len(miss):
            lower = self.logp(a, n - 1, miss if at is None else at[miss])
            c, known = _find(level.context_hashes, hashes(keys[miss] >> _U(16)))
            out[miss] = lower + np.where(known[:, None], level.context_logw[c], 0)
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return i, table[i] == wanted


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of 4-grams and 3-grams, by the two units before the last; a 3-gram, its
    context and all 4-grams that end in it are in one part."""
    return (keys >> _U(16) & _U(0xFFFFFFFF)) % _U(_PRIME) % _U(parts)


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)


def build(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Models from `(language, 4-grams, counts)`, languages in order."""
    each = []  # per language and order: n-grams, counts (types of left neighbours below ORDER)
    for _, keys, n in counts:
        order = np.argsort(keys)
        levels = [(keys[order], n[order].astype(float))]
        for size in range(ORDER - 1, 0, -1):
            below = levels[-1][0] & _U((1 << 16 * size) - 1)
            levels.append(tuple(x.astype(float) if i else x for i, x in enumerate(np.unique(below, return_counts=True))))
        each.append(levels[::-1])
    discounts = [[_discount((n == 1).sum(), (n == 2).sum()) for _, n in x] for x in each]
    return assemble(tuple(x[0] for x in counts), each, discounts, len(np.unique(np.concatenate([x[0][0] for x in each]))) + 1)


def assemble(languages: tuple[str, ...], each: list[list[tuple[np.ndarray, np.ndarray]]], discounts: list[list[float]],
             vocabulary: int) -> Model:
    """Models from n-grams in order and their counts, per language and order."""
    k = len(languages)
    model = Model(languages, [], np.zeros(k))
    lower = None
    for size in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([x[size - 1][0] for x in each]))
        contexts = np.unique(keys >> _U(16))
        p, w = np.zeros((len(keys), k)), np.ones((len(contexts), k))
        at_context = np.searchsorted(contexts, keys >> _U(16))
        for j, x in enumerate(each):
            own, n = x[size - 1]
            discount = discounts[j][size - 1]
            c = np.searchsorted(contexts, own >> _U(16))
            total, kinds = np.bincount(c, n, len(contexts)), np.bincount(c, minlength=len(contexts))
            seen = total > 0
            w[seen, j] = discount * kinds[seen] / total[seen]
            p[np.searchsorted(keys, own), j] = (n - discount) / total[c]
        if size == 1:
            below = np.full((len(keys), k), 1 / vocabulary)
            model.unseen = np.log(np.full(k, 1 / vocabulary))
        else:
            i = np.searchsorted(lower[0], keys & _U((1 << 16 * (size - 1)) - 1))
            below = lower[1][i]
        p += w[at_context] * below
        lower = (keys, p)
        if not len(keys):  # a part without n-grams gets one that no text has
            keys, p, contexts, w = np.zeros(1, _U), np.ones((1, k)), np.zeros(1, _U), np.ones((1, k))
        h, ch = hashes(keys), hashes(contexts)
        by, cby = np.argsort(h), np.argsort(ch)
        model.levels.append(Level(h[by], np.log(p[by]).astype(np.float32), ch[cby], np.log(w[cby]).astype(np.float32)))
    return model


@dataclass
class Piece:
    """The models of languages `first` to `last` (not included), in a file: n-grams of orders
    3 and 4 of one part, all of the lower orders."""

    first: int
    last: int
    part: int
    parts: int
    sent: Broadcast

    def model(self) -> Model:
        """Read anew each time, so that a worker has one piece in memory."""
        path = self.sent._path
        return self.sent.load_from_path(path) if path else self.sent.value


@dataclass
class Pieces:
    """A model that is too large to be in one place."""

    languages: tuple[str, ...]
    pieces: list[Piece]


def _plan(rows: list[tuple[str, int]], max_cells: int) -> list[tuple[int, int, int]]:
    """`(first, last, parts)`: runs of languages whose 4-grams x languages stay within
    `max_cells`; a language that exceeds it alone is cut into parts."""
    runs, first = [], 0
    while first < len(rows):
        last = first + 1
        while last < len(rows) and sum(n for _, n in rows[first:last + 1]) * (last + 1 - first) <= max_cells:
            last += 1
        parts = max(1, -(-rows[first][1] // max_cells)) if last == first + 1 else 1
        runs.append((first, last, parts))
        first = last
    return runs


def _by_language(t: pa.Table, languages: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """N-grams in order and their counts for each language, from `lang, gram, n`."""
    lang = t.column("lang").combine_chunks().dictionary_encode()
    codes, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
    keys, n = t.column("gram").to_numpy().view(_U), t.column("n").to_numpy().astype(float)
    out = []
    for x in languages:
        own = np.flatnonzero(codes == names.index(x)) if x in names else np.zeros(0, np.int64)
        own = own[np.argsort(keys[own])]
        out.append((keys[own], n[own]))
    return out


def _pieces(counts: DataFrame, rows: list[tuple[str, int]], max_cells: int) -> Pieces:
    """The model in pieces. Counts of all orders, discounts and the vocabulary come from all
    4-grams, in Spark."""
    languages = tuple(x for x, _ in rows)
    levels = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        below = F.col("gram").bitwiseAND(F.lit((1 << 16 * size) - 1))
        levels[size] = stage(levels[size + 1].groupBy("lang", below.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    discounts = [[0.0] * ORDER for _ in languages]
    for size, level in levels.items():
        for r in level.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2)]).collect():
            discounts[languages.index(r["lang"])][size - 1] = _discount(r["n1"], r["n2"])
    vocabulary = levels[1].select("gram").distinct().count() + 1
    middle = F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFFFFFF)) % F.lit(_PRIME)
    out = []
    for first, last, parts in _plan(rows, max_cells):
        own = F.col("lang").isin(list(languages[first:last]))
        for part in range(parts):
            tables = [levels[size].filter(own & (middle % F.lit(parts) == part) if size > 2 else own).toArrow() for size in range(1, ORDER + 1)]
            split = [_by_language(t, languages[first:last]) for t in tables]
            model = assemble(languages[first:last], [list(x) for x in zip(*split)], discounts[first:last], vocabulary)
            out.append(Piece(first, last, part, parts, counts.sparkSession.sparkContext.broadcast(model)))
    return Pieces(languages, out)


def learn(docs: DataFrame, max_cells: int = MAX_CELLS) -> Model | Pieces | None:
    """A model from all rows of `docs(text, lang)`; None without any. All 4-grams of all
    languages count; over `max_cells` (4-grams x languages) the model comes in pieces."""
    counts = stage(count_grams(docs))
    sizes = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
    rows = sorted((r["lang"], r["k"]) for r in sizes.collect())
    if not rows:
        return None
    languages = [x for x, _ in rows]
    if sum(k for _, k in rows) * len(rows) > max_cells:
        return _pieces(counts, rows, max_cells)
    return build([(x, *y) for x, y in zip(languages, _by_language(counts.toArrow(), languages))])


OUT = "lang_pred string, score double, cross_entropy double, n_units long"
_TYPES = (pa.string(), pa.float64(), pa.float64(), pa.int64())
_NAMES = [x.split()[0] for x in OUT.split(", ")]
_CHUNK = 1_000_000


def _total(a: np.ndarray, model: Model, part: int = 0, parts: int = 1) -> np.ndarray:
    """Minus the sum of the units' log-probabilities under each language, of one part's units
    or of all; long texts are scored in runs that overlap by a context."""
    total = np.zeros(len(model.languages))
    for i in range(ORDER - 1, len(a), _CHUNK):
        run = a[i - ORDER + 1:i + _CHUNK]
        at = np.flatnonzero(part_of(grams(run), parts) == part) if parts > 1 else None
        total -= model.logp(run, at=at).sum(0, dtype=float)
    return total


def _found(a: np.ndarray, total: np.ndarray, languages: tuple[str, ...]) -> tuple:
    n = len(a) - ORDER + 1
    h = total / n
    best = int(h.argmin())
    weight = np.exp((h[best] - h) * _SCORE_CHARS)
    return languages[best], float(1 / weight.sum()), float(h[best]), n


_NOTHING = (UNDETERMINED, 0.0, None, 0)


def predict(text: str | None, model: Model | None) -> tuple:
    """One row of `OUT`."""
    a = units(text) if text and model else np.zeros(0, np.uint16)
    return _found(a, _total(a, model), model.languages) if len(a) else _NOTHING


def predict_all(texts: list[str | None], model: Model | Pieces | None) -> list[tuple]:
    """Rows of `OUT`; each piece of a model is read once."""
    if not isinstance(model, Pieces):
        return [predict(t, model) for t in texts]
    each = [units(t) if t else np.zeros(0, np.uint16) for t in texts]
    totals = np.zeros((len(texts), len(model.languages)))
    for x in model.pieces:
        piece = x.model()
        for total, a in zip(totals, each):
            if len(a):
                total[x.first:x.last] += _total(a, piece, x.part, x.parts)
        del piece
    return [_found(a, total, model.languages) if len(a) else _NOTHING for a, total in zip(each, totals)]


def _scored(docs: DataFrame, model: Model | Pieces | None, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs`, then the columns of `OUT` in a struct named `_found`."""
    sent = None if isinstance(model, Pieces) else docs.sparkSession.sparkContext.broadcast(model)
    pieces = model if sent is None else None
    index = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces if sent is None else sent.value
        for part in batches:
            for cut, texts in slices([part.rename_columns([f"_{i}" for i in range(len(part.schema))])], text=f"_{index}"):
                rows = predict_all(texts, m)
                found = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)
                yield pa.RecordBatch.from_arrays([*cut.columns[:len(keep)], found], names=[*keep, "_found"])

    cols = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*cols, *([] if "text" in keep else [F.col("text").cast("string")]))
    schema = docs.select(*cols).schema.add("_found", T.StructType.fromDDL(OUT))
    return rows.mapInArrow(run, schema)


def _accepted(scored: DataFrame, train: Column | bool) -> Column:
    """Whether the cross-entropy fits the predicted language; limits come from the texts
    that the model was learned from."""
    f = F.col("_found")
    fit = scored.filter(f["cross_entropy"].isNotNull() & F.lit(train)).groupBy(f["lang_pred"].alias("lang")).agg(
        F.percentile_approx(f["cross_entropy"], [0.25, 0.5, 0.75], 10_000).alias("q")).collect()
    if not fit:
        return F.lit(False)
    cases = F.lit(None).cast("double")
    for r in fit:
        wide = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(FULL_LENGTH)) / f["n_units"]))
        cases = F.when(f["lang_pred"] == r["lang"], F.lit(r["q"][1]) + MAX_DEVIATIONS * max((r["q"][2] - r["q"][0]) / 1.349, MIN_DEVIATION) * wide
                       ).otherwise(cases)
    return F.coalesce(f["cross_entropy"] <= cases, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, test: Column | None = None) -> DataFrame:
    """`doc_id, held_out, lang_pred, score, cross_entropy, accepted` for each row of
    `docs(doc_id, text, lang)`; rows where `test` is true are not learned from."""
    test = held_out(F.col("doc_id")) if test is None else test
    model = learn(docs.filter(~test))
    scored = stage(_scored(docs, model, ["doc_id"]).withColumn("held_out", test))
    f = F.col("_found")
    return scored.select("doc_id", "held_out", f["lang_pred"].alias("lang_pred"), f["score"].alias("score"),
                         f["cross_entropy"].alias("cross_entropy"), _accepted(scored, ~F.col("held_out")).alias("accepted"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` in a recognised language, with all their columns."""
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text", "lang") else f"_{i}" for i, c in enumerate(names)])
    scored = stage(_scored(inner, learn(inner), inner.columns))
    return scored.filter(_accepted(scored, True)).drop("_found").toDF(*names)
