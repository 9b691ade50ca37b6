"""Quality rules by distribution divergence (operator 5).

Each language gets two references from the whole corpus: a histogram of character classes
and a histogram of its common words (all others in one cell). A text is compared with every
language by Jensen-Shannon distance and takes the nearest; it fails when it is far from all.
Languages with `language_words` words have references, at every size of the corpus. A text in
a language without one can't be told from junk and skips the comparison; a text without
`lang` is compared.

Defined results: a null or empty text has no words and fails the base rule. Texts under the
length guards skip the comparison they are too short for. Without any language (empty table,
`lang` null everywhere) the comparison keeps every text. Repeated rows are judged alike;
further columns, whatever their names, are passed through by `filter_documents` and left out
by `judge`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, stage

WINDOW = 5
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "mark", "control", "latin", "other")
_SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:!?'\"()-"


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes (-1) are no characters."""
    of = np.full(256, CLASSES.index("mark"), np.int8)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)),
                        ("control", [*range(32), 127]), ("space", [32, *range(9, 14)]), ("stop", _STOPS),
                        ("symbol", _SYMBOLS), ("latin", range(0xC2, 0xCA)), ("other", range(0xCA, 256))):
        of[list(chars)] = CLASSES.index(name)
    of[0x80:0xC2] = -1
    return of


_CLASS_OF = _classes()
_TO_CLASS = (_CLASS_OF[:, None] == np.arange(len(CLASSES))[None, :]).astype(np.int64)
_SPACES = np.array([32, *range(9, 14)])
_NORMAL = bytes(32 if (c < 33 or c in _STOPS) else c + 32 if 65 <= c < 91 else c for c in range(256))


@dataclass(frozen=True)
class Rules:
    """Base limits, length guards and largest distances."""

    min_words: int = 10
    max_repeat_percent: int = 20
    guard_chars: int = 250
    guard_words: int = 50
    max_class_distance: float = 0.30
    max_word_distance: float = 0.46
    common_share: float = 0.002
    slack: float = 0.0005
    language_words: int = 5_000


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes and of the common words."""

    languages: tuple[str, ...]
    classes: np.ndarray
    words: dict[bytes, int]
    word_shares: np.ndarray  # the last cell is "every other word"


def common_words(raw: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without stops at their ends or inside."""
    return raw.translate(_NORMAL).split()


def _candidates(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            by: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), texts):
                if text and lang is not None:
                    by.setdefault(lang, Counter()).update(common_words(text.encode()))
            out = []
            for lang, counts in by.items():
                total = counts.total()
                # What a run leaves out of a word is at most `slack` of the run's words.
                out += [(lang, w, n) for w, n in counts.items() if n > rules.slack * total]
                out.append((lang, None, total))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))],
                names=["lang", "word", "n"])
    return run


def _count(words: dict[bytes, int]):
    k = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts):
                if text and lang is not None:
                    raw = text.encode()
                    row = sums.setdefault(lang, np.zeros(k + 1 + len(CLASSES), np.int64))
                    row[:k + 1] += _word_histogram(raw, words)
                    row[k + 1:] += np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TO_CLASS
        rows = [(lang, i, int(n)) for lang, row in sums.items() for i, n in enumerate(row) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))],
            names=["lang", "cell", "n"])
    return run


def _word_histogram(raw: bytes, words: dict[bytes, int]) -> np.ndarray:
    k = len(words)
    found = common_words(raw)
    get = words.get
    return np.bincount(np.fromiter((get(w, k) for w in found), np.int64, len(found)), minlength=k + 1)


def learn(docs: DataFrame, rules: Rules = Rules()) -> References:
    """References from all texts with a language.

    Common words are those with at least `common_share` of a language's words. The first
    pass finds at most 1 / (common_share - slack) words a language that may reach it (each
    run of rows reports only its frequent ones), the second counts these over all texts.
    Languages with `language_words` words become references if they have common words.
    """
    pairs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = stage(pairs.mapInArrow(_candidates(rules), "lang string, word binary, n long")
                 .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = sums.filter(F.col("word").isNull()).select("lang", F.col("n").alias("total"))
    kept = totals.filter(F.col("total") >= rules.language_words)
    may = (sums.filter(F.col("word").isNotNull()).join(F.broadcast(kept), "lang")
           .filter(F.col("n") >= (rules.common_share - rules.slack) * F.col("total"))
           .select("lang", "word", "total").collect())
    languages = tuple(sorted({r["lang"] for r in may}))
    words = {w: i for i, w in enumerate(sorted({bytes(r["word"]) for r in may}))}
    if not languages:
        return References((), np.zeros((0, len(CLASSES))), {}, np.zeros((0, 1)))
    counted = (pairs.filter(F.col("lang").isin(list(languages)))
               .mapInArrow(_count(words), "lang string, cell int, n long")
               .groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect())
    sums_of = np.zeros((len(languages), len(words) + 1 + len(CLASSES)))
    at = {x: i for i, x in enumerate(languages)}
    for r in counted:
        sums_of[at[r["lang"]], r["cell"]] = r["n"]
    k = len(words)
    in_words, in_classes = sums_of[:, :k + 1], sums_of[:, k + 1:]
    # Words under the share in every language go to the last cell.
    share = in_words / np.maximum(in_words.sum(1, keepdims=True), 1)
    common = [i for i in range(k) if share[:, i].max() >= rules.common_share]
    rest = share.sum(1) - share[:, common].sum(1)
    names = sorted(words, key=words.get)
    return References(languages, in_classes / np.maximum(in_classes.sum(1, keepdims=True), 1),
                      {names[i]: j for j, i in enumerate(common)},
                      np.concatenate([share[:, common], rest[:, None]], 1))


def divergence(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of one histogram to each row of `shares`."""
    at = np.flatnonzero(counts)
    p, q = counts[at] / counts.sum(), shares[:, at]
    mean = (p[None, :] + q) / 2
    left = (p * np.log2(p / mean)).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = np.where(q > 0, q * np.log2(q / mean), 0.0).sum(1) + 1 - q.sum(1)  # all of the cells that only `shares` has
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of `WINDOW` words which occurs twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    if len(number) == n:
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    count = n - WINDOW + 1
    h = np.zeros(count, np.uint64)
    for i in range(WINDOW):
        h = (h ^ mixed[i:i + count]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    if not len(a):
        return 0
    if all((ids[a + i] == ids[b + i]).all() for i in range(WINDOW)):
        twice = np.zeros(count, bool)
        twice[a] = twice[b] = True
    else:  # two windows share a hash: compare the windows themselves
        seen = Counter(zip(*[words[i:i + count] for i in range(WINDOW)]))
        twice = np.fromiter((seen[x] > 1 for x in zip(*[words[i:i + count] for i in range(WINDOW)])), bool, count)
    edge = np.zeros(n + 1, np.int64)
    edge[:count] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
       "nearest string, class_distance double, word_distance double, kept boolean")


def measure(text: str | None, refs: References, rules: Rules, lang: str | None = None) -> tuple:
    """One row of `OUT`."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else ()
    repeats = repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    chars = len(text or "")
    nearest = by_class = by_word = None
    if refs.languages and chars and (lang is None or lang in refs.languages):
        distance = np.zeros(len(refs.languages))
        if chars >= rules.guard_chars:
            to_class = divergence(seen @ _TO_CLASS, refs.classes)
            distance = distance + to_class
        histogram = _word_histogram(raw, refs.words) if n >= rules.guard_words else np.zeros(1)
        if histogram.sum() >= rules.guard_words:
            to_word = divergence(histogram, refs.word_shares)
            distance = distance + to_word
        best = int(distance.argmin())
        nearest = refs.languages[best]
        by_class = float(to_class[best]) if chars >= rules.guard_chars else None
        by_word = float(to_word[best]) if histogram.sum() >= rules.guard_words else None
    kept = not failed and (by_class or 0) <= rules.max_class_distance and (by_word or 0) <= rules.max_word_distance
    return (n, chars - int(seen[_SPACES].sum()), int(seen[list(_SYMBOLS)].sum()), len(lines) - len(set(lines)), repeats,
            failed, nearest if by_class is not None or by_word is not None else None, by_class, by_word, kept)


_TYPES = (*[pa.int64()] * 5, pa.bool_(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def judge(docs: DataFrame, rules: Rules = Rules(), refs: References | None = None) -> DataFrame:
    """`doc_id` and `OUT` for each row of `docs(doc_id, text, lang)`."""
    refs = learn(docs, rules) if refs is None else refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = [measure(t, refs, rules, lang) for t, lang in zip(texts, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]],
                names=["doc_id", *_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("text", "lang")]).mapInArrow(run, f"doc_id {kind}, {OUT}")


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; one row, one decision, so
    repeated and null ids need no join."""
    refs = learn(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            langs = [None if x is None else str(x) for x in part.column(part.schema.get_field_index("lang")).to_pylist()]
            yield part.filter(pa.array([measure(t, refs, rules, x)[-1] for t, x in zip(texts, langs)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
