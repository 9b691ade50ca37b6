"""Text columns: tokens, keys, clips, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import wordlists as wl


def empty() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, however often and in whatever lambda
    the body names it (a column would be computed again for each item of a list)."""
    return F.get(F.transform(F.array(as_col(c)), body), F.lit(0))


def squeeze(c) -> Column:
    """Collapse white space (Unicode too) to single blanks and trim."""
    return F.trim(F.regexp_replace(as_col(c), f"[{wl.SPACE}]+", " "))


def strip(c) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(as_col(c), f"^[{wl.SPACE}]+|[{wl.SPACE}]+$", "")


def clip_head(c, limit: int) -> Column:
    c = as_col(c)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, max(0, limit - 1)), F.lit("…")))


def head_tail_sizes(limit: int) -> tuple[int, int]:
    """Characters kept from the start and from the end of a clipped text."""
    head = max(1, limit * 6 // 10)
    return head, max(1, limit - head - 1)


def clip_head_tail(c, limit: int) -> Column:
    c = as_col(c)
    head, tail = head_tail_sizes(limit)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, head), F.lit("…"), F.substring(c, -tail, tail)))


def tokens(c, stop: list[str] = wl.STOP_WORDS) -> Column:
    """Search tokens: Latin words and CJK bigrams, duplicates and order kept.

    Texts without CJK characters (the common case in bulk data) take a path that
    only filters the matched words.
    """
    low = F.lower(as_col(c))
    runs = F.regexp_extract_all(
        low,
        F.lit(f"([a-z0-9_]{{2,}}|(?<![a-z0-9_])[0-9](?![a-z0-9_])|[{wl.CJK}]+)"),
        F.lit(1))

    def pieces(run: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.length(run) - 1),
                              lambda i: F.substring(run, i, F.lit(2)))
        return (F.when(run.rlike(f"^[{wl.CJK}]{{2,}}"), F.filter(bigrams, lambda b: ~b.isin(stop)))
                .when(run.rlike(f"^[{wl.CJK}]"), F.array(run))
                .when(run.isin(stop), empty())
                .otherwise(F.array(run)))

    mixed = F.flatten(F.transform(runs, pieces))
    latin = F.filter(runs, lambda run: ~run.isin(stop))
    return (F.when(low.rlike(f"[{wl.CJK}]"), mixed)
            .when(low.isNotNull(), latin)
            .otherwise(empty()))


def word_sequence(c) -> Column:
    """Lower-case words and single CJK characters in order, nothing removed."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"([a-z0-9_]+|[\u4e00-\u9fff])"), F.lit(1))


def norm_key(c, max_chars: int | None = None) -> Column:
    """Identity of a statement: case, blanks and punctuation do not count. `max_chars` gives
    the short keys of older tables, which merge texts that differ only later."""
    low = F.regexp_replace(F.lower(as_col(c)), f"[{wl.SPACE}]+", "")
    bare = F.regexp_replace(
        low, "[，。；、！？：,.;!?:'\"“”‘’()（）\\[\\]【】{}<>《》`~@#$%^&*+=|\\\\/-]+", "")
    return bare if max_chars is None else F.substring(bare, 1, max_chars)


def card_key(name, when, domain) -> Column:
    return norm_key(F.concat_ws(" ", as_col(name), as_col(when), F.coalesce(as_col(domain), F.lit(""))))


def normalize_domain(c) -> Column:
    folded = F.lower(squeeze(c))
    alias = F.create_map(*[F.lit(x) for kv in wl.DOMAIN_ALIASES.items() for x in kv])
    named = F.substring(F.coalesce(F.element_at(alias, folded), folded), 1, 48)
    return F.when(folded != "", named)


def sentences(c) -> Column:
    """Sentences of at least four characters."""
    # U+0000 marks the cut after Western punctuation, so that one split does all.
    cut = F.regexp_replace(as_col(c), f"(?<=[.!?;])[{wl.SPACE}]+", "\u0000")
    parts = F.transform(F.split(cut, "[。！？；\n\r\u0000]"), strip)
    return F.filter(parts, lambda s: F.length(s) >= 4)


def first_line(c) -> Column:
    """First line that is not blank, squeezed."""
    return squeeze(F.regexp_extract(as_col(c), f"([^\n]*[^{wl.SPACE}][^\n]*)", 1))


def first_sentence(c) -> Column:
    flat = squeeze(c)
    cut = F.regexp_extract(flat, r"^(.*?(?:[。！？；]|\.(?!\d)))", 1)
    return F.when(cut != "", F.trim(cut)).otherwise(flat)


def contains_any(c, words: list[str]) -> Column:
    """True where the lower-cased text has one of the words in it."""
    low = F.lower(as_col(c))
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word.lower())
    return hit


def nonempty(c) -> Column:
    return F.filter(as_col(c), lambda x: x.isNotNull() & (F.length(x) > 0))


def joined(*parts, sep: str = "\n") -> Column:
    """Join string and array<string> columns, leaving out empty parts."""
    arrays = [as_col(p) for p in parts]
    return F.array_join(nonempty(F.concat(*arrays)), sep)


def one(c) -> Column:
    """A string column as an array with at most one element."""
    c = as_col(c)
    return F.when(c.isNull(), empty()).otherwise(F.array(c))


def arr(c) -> Column:
    """An array column with NULL read as empty."""
    return F.coalesce(as_col(c), empty())


def compact_entry(c, limit: int = 400) -> Column:
    """One line for a hit: drop a title that the body repeats, then clip."""
    lines = F.filter(F.transform(F.split(as_col(c), "\n"), strip), lambda x: x != "")
    title = F.get(lines, F.lit(0))
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1)))
    repeated = (F.size(lines) > 1) & (F.length(title) >= 8) & F.contains(F.array_join(rest, "\n"), title)
    flat = squeeze(F.array_join(F.when(repeated, rest).otherwise(lines), " "))
    return clip_head(flat, limit)


def compact_rule(c, limit: int = 60) -> Column:
    """Short form of a standing rule: its first whole sentence where that fits."""
    flat = squeeze(c)
    sentence = F.trim(F.regexp_extract(flat, "^(.*?[。！？!?;；])", 1))
    return (F.when(F.length(flat) <= limit, flat)
            .when(F.length(sentence).between(8, limit), sentence)
            .otherwise(clip_head(flat, limit)))


def gist(explicit, summary, limit: int = 90) -> Column:
    given = squeeze(F.coalesce(as_col(explicit), F.lit("")))
    return clip_head(F.when(given != "", given).otherwise(first_sentence(summary)), limit)


def symbols_in_text(c) -> Column:
    found = F.regexp_extract_all(
        as_col(c), F.lit(wl.START + r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)" + wl.END), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: F.length(s) >= 4))
