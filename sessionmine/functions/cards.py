"""Columns over knowledge cards: searchable text, symbols, needles, trust."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import wordlists as wl
from .redaction import deidentify
from .text import arr, as_col, clip_head, gist, joined, nonempty, one, squeeze, strip


def api_texts(api) -> Column:
    return F.transform(F.coalesce(as_col(api), F.array().cast("array<struct<symbol:string,signature:string,notes:string>>")),
                       lambda s: F.concat_ws(" ", s["symbol"], F.coalesce(s["signature"], F.lit(""))))


def card_text() -> Column:
    """Search text of a card; example code is left out on purpose."""
    return joined(one("name"), one("subject"), one("applies_to"), one("gist"), one("when"),
                  one("summary"), one("domain"), arr("tags"), api_texts("api"))


def episode_text() -> Column:
    return joined(one("title"), one("summary"), arr("decisions"), arr("todos"), arr("tags"), arr("files"))


def fact_text() -> Column:
    return joined(one("text"), arr("tags"))


def symbols(subject, api) -> Column:
    called = F.transform(F.coalesce(as_col(api), F.array().cast("array<struct<symbol:string,signature:string,notes:string>>")),
                         lambda s: F.trim(s["symbol"]))
    return F.array_distinct(nonempty(F.concat(one(F.trim(as_col(subject))), called)))


def strong_text(domain, tags, symbols_c) -> Column:
    """The fields in which one match already shows relevance."""
    return F.array_join(F.concat(one(domain), arr(tags), arr(symbols_c)), " ")


def confidence(successes, failures) -> Column:
    s, f = F.coalesce(as_col(successes), F.lit(0)), F.coalesce(as_col(failures), F.lit(0))
    return (s + 1) / (s + f + 2)


def is_injectable() -> Column:
    return F.col("archived_at").isNull() & F.col("status").isin("validated", "canonical")


def hard_filter(drafts: bool = False, archived: bool = False, partition: str | None = None) -> Column:
    keep = F.col("status") != "deprecated"
    if not drafts:
        keep = keep & F.col("status").isin("validated", "canonical")
    if not archived:
        keep = keep & F.col("archived_at").isNull()
    if partition is not None:
        keep = keep & (F.col("partition").isNull() | (F.col("partition") == partition))
    return keep


def archivable(now: Column, after_days: int, keep_prefixes: list[str], domain=None) -> Column:
    """A draft that has never been of use to anyone and is not exempt."""
    unused = F.lit(True)
    for counter in ("retrieve_count", "referenced", "successes"):
        unused = unused & (F.coalesce(F.col(counter), F.lit(0)) <= 0)
    name = F.lower(F.trim(F.coalesce(as_col(domain if domain is not None else "domain"), F.lit(""))))
    exempt = F.lit(False)
    for prefix in keep_prefixes:
        exempt = exempt | ((name != "") & name.startswith(prefix))
    old = F.lit(True) if after_days <= 0 else (
        F.unix_millis(now) - F.unix_millis("ts") >= after_days * 86_400_000)
    return (F.col("archived_at").isNull() & (F.col("status") == "draft") & (F.col("kind") != "pitfall")
            & unused & old & ~exempt)


def reference_needles(symbols_c) -> Column:
    """Strings whose presence in a call's arguments shows that the card is in use."""
    bare = F.transform(arr(symbols_c), lambda s: F.trim(F.regexp_replace(s, "<[^<>]*>", " ")))

    def builtin(s: Column) -> Column:
        root = F.regexp_extract(s, r"^([^./#-]*)", 1)
        return s.contains(".prototype.") | s.isin(wl.BUILTIN_NAMES) | root.isin(wl.BUILTIN_ROOTS)

    usable = F.filter(bare, lambda s: (s != "") & ~s.rlike(f"[一-龥{wl.SPACE}]") & ~builtin(s))
    parts = F.flatten(F.transform(usable, lambda s: F.split(s, r"[^A-Za-z0-9_.$#/-]+")))
    trimmed = F.transform(parts, lambda p: F.regexp_replace(
        F.regexp_replace(p, "^[^A-Za-z]+", ""), "[^A-Za-z0-9_$]+$", ""))
    good = F.filter(trimmed, lambda n: (F.length(n) >= 6) & (n.rlike("[./#-]") | n.rlike("[A-Z_$]")))

    def with_tail(n: Column) -> Column:
        tail = F.regexp_extract(n, r"([^./#]*)$", 1)
        return F.when((tail != n) & (F.length(tail) >= 6) & tail.rlike("[A-Z_$]"), F.array(n, tail)).otherwise(F.array(n))

    return F.array_distinct(F.flatten(F.transform(good, with_tail)))


def mentions(raw, needle) -> Column:
    """The needle occurs in the text; a plain identifier must stand alone."""
    raw, needle = as_col(raw), as_col(needle)
    alone = F.rlike(raw, F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), needle, F.lit(r"\E(?![A-Za-z0-9_$])")))
    return F.contains(raw, needle) & (needle.rlike("[./#-]") | alone)


# --- Fixed values: words that carry no observation -----------------------------
VERDICT_WORDS = (
    "ok|okay|fine|good|done|works?|worked|success|confirmed|pass(?:ed)?|正常|没问题|没毛病|无异常|成功|"
    "有效果|有效|通过|已采用|已使用|已应用|符合预期|效果良好|工作正常|一切正常")
EVIDENCE_MIN, EVIDENCE_MAX = 12, 400


def evidence_reason(c) -> Column:
    """Why an outcome's evidence does not count; NULL where it does."""
    value = squeeze(F.coalesce(as_col(c), F.lit("")))
    words = F.regexp_replace(value, f"[\\d%.,，。！!；;、:：{wl.SPACE}\"'`()（）\\[\\]【】{{}}<>/\\\\|~-]", "")
    hollow = (words != "") & (F.regexp_replace(words, f"(?i)(?:{VERDICT_WORDS})", "") == "")
    anchor = value.rlike(
        f"\\d|`[^`]+`|\"[^\"]+\"|'[^']+'|[^{wl.SPACE}]+/[^{wl.SPACE}]+|\\.\\w{{2,6}}{wl.EDGE}")
    return (F.when(as_col(c).isNull(), "not_text")
            .when(value == "", "empty")
            .when(hollow, "content_free")
            .when(F.length(value) < EVIDENCE_MIN, "too_short")
            .when(~anchor, "no_observation"))


def stored_evidence(c) -> Column:
    return clip_head(squeeze(c), EVIDENCE_MAX)


def card_line(limit_name: int = 60) -> Column:
    """One line for a found card."""
    s, f = F.coalesce(F.col("successes"), F.lit(0)), F.coalesce(F.col("failures"), F.lit(0))
    mark = F.when(s > 0, F.concat(F.lit(" ✓"), s.cast("string"))).when(
        f > 0, F.concat(F.lit(" ✗"), f.cast("string"))).otherwise("")
    return F.concat_ws(" — ",
                       F.concat(F.lit("["), F.col("status"), F.lit("]"), mark, F.lit(" "), clip_head(squeeze("name"), limit_name)),
                       gist("gist", "summary"), F.concat(F.lit("id "), short_id("id")))


def short_id(c, prefix: str = "tq_", chars: int = 8) -> Column:
    bare = F.regexp_replace(as_col(c).cast("string"), f"^{prefix}", "")
    return F.concat(F.lit(prefix), F.substring(bare, 1, chars))


def clip_example(c, max_lines: int = 8, max_chars: int = 480) -> Column:
    text = strip(F.array_join(F.slice(F.split(as_col(c), "\r?\n"), 1, max_lines), "\n"))
    return F.when(F.length(text) <= max_chars, text).otherwise(F.substring(text, 1, max_chars - 1))


def deidentify_card(cards, ids, max_lines: int = 8, max_chars: int = 480):
    """De-identify every free-text field of a card table."""
    run = lambda c: deidentify(c, ids)
    texts = ["name", "gist", "when", "summary", "subject", "location", "reuse", "applies_to", "domain"]
    lists = ["steps", "invariants", "pitfalls", "verify", "tags"]
    new = {c: run(F.col(c)) for c in texts if c in cards.columns}
    new |= {c: F.transform(F.col(c), run) for c in lists if c in cards.columns}
    if "api" in cards.columns:
        new["api"] = F.transform("api", lambda s: F.struct(
            run(s["symbol"]).alias("symbol"), run(s["signature"]).alias("signature"), run(s["notes"]).alias("notes")))
    if "example" in cards.columns:
        e = F.col("example")
        new["example"] = F.when(e.isNotNull(), F.struct(
            e["language"].alias("language"), e["kind"].alias("kind"),
            clip_example(run(e["code"]), max_lines, max_chars).alias("code")))
    new["sensitivity"] = F.coalesce(F.col("sensitivity"), F.lit("internal"))
    new["deidentified"] = F.lit(True)
    return cards.withColumns(new)
