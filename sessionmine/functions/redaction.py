"""Redaction, sanitising and de-identification columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import wordlists as wl
from .text import empty, as_col, let, squeeze


def redact(c, rules=wl.CREDENTIAL_RULES) -> Column:
    """Replace credentials by `[REDACTED:rule]`; later rules see earlier marks."""
    out = as_col(c)
    for name, pattern in rules:
        out = F.regexp_replace(out, pattern, f"[REDACTED:{name}]")
    return out


def redact_all(c) -> Column:
    return F.transform(as_col(c), lambda x: redact(x))


def sanitize(c, one_line: bool = False, neutral_braces: bool = False) -> Column:
    """Strip terminal codes and control characters, defuse imitated labels."""
    out = as_col(c)
    for pattern in (
        "\u001b\\][^\u0007\u001b]*(?:\u0007|\u001b\\\\)",
        "\u001b\\[[0-9;?]*[ -/]*[@-~]",
        "\u001b[@-Z\\\\-_]",
        "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]",
    ):
        out = F.regexp_replace(out, pattern, "")
    labels = "|".join(wl.LAYER_LABELS)
    out = F.regexp_replace(
        out, f"(?i)[-*+]([{wl.SPACE}]*\\[[{wl.SPACE}]*(?:{labels}){wl.END})", "•$1")
    if one_line or neutral_braces:
        out = squeeze(out)
    if neutral_braces:
        # A blank after each brace that has another one behind it.
        out = F.regexp_replace(out, r"\{(?=\{)", "{ ")
    return out


def identifier_kind(value: Column) -> Column:
    return (F.when(value.rlike("^[A-Z][A-Z0-9_]{2,}$"), "CONST")
            .when(value.contains("."), "pkg")
            .when(value.rlike("^[A-Z]"), "Class")
            .otherwise("id"))


def detect_identifiers(c) -> Column:
    """Mixed-case names and dotted package names that look private."""
    pascal = F.regexp_extract_all(
        as_col(c), F.lit(wl.START + r"([A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+)" + wl.END), F.lit(1))
    package = F.regexp_extract_all(
        as_col(c), F.lit(wl.START + r"([a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,})" + wl.END), F.lit(1))
    pascal = F.filter(pascal, lambda v: (F.length(v) >= 6) & ~v.isin(wl.COMMON_TERMS))
    return F.array_distinct(F.concat(pascal, package))


def scrub_absolute_paths(c) -> Column:
    return F.regexp_replace(
        as_col(c), f"(^|[{wl.SPACE}\"'(=])/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+", "$1[PATH]")


def deidentify(c, ids, auto_detect: bool = False) -> Column:
    """Replace private identifiers by numbered placeholders, then paths.

    Numbers follow the first position in the raw text; of two names that start
    at the same place the longer one goes first.
    """
    return scrub_absolute_paths(let(c, lambda text: let(
        _found_identifiers(text, ids, auto_detect), lambda found: _marked(text, found))))


def _found_identifiers(text: Column, ids, auto_detect: bool) -> Column:
    names = F.coalesce(as_col(ids), empty())
    if auto_detect:
        names = F.concat(names, detect_identifiers(text))
    usable = F.filter(
        F.array_distinct(names),
        lambda v: (F.length(F.trim(v)) >= 3) & ~v.isin(wl.COMMON_TERMS) & F.contains(text, v))
    return F.array_sort(F.transform(usable, lambda v: F.struct(
        F.position(v, text).alias("at"),
        (-F.length(v)).alias("neg_len"), v.alias("value"), identifier_kind(v).alias("kind"))))


def _marked(text: Column, ranked: Column) -> Column:
    def placeholder(item: Column, i: Column) -> Column:
        same = F.filter(F.slice(ranked, F.lit(1), i + 1), lambda o: o["kind"] == item["kind"])
        return F.struct(
            item["value"].alias("value"),
            F.concat(F.lit("<"), item["kind"], F.size(same).cast("string"), F.lit(">")).alias("mark"))

    return F.aggregate(F.transform(ranked, placeholder), redact(text),
                       lambda acc, p: F.replace(acc, p["value"], p["mark"]))


def scrub_external_paths(c, cwd) -> Column:
    """Absolute paths outside the working directory become `[EXTERNAL-PATH]`."""
    path = r"/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+"
    # Cut the text into paths and everything between them, then join it again.
    pieces = F.regexp_extract_all(as_col(c), F.lit(f"({path}|[^/]+|/)"), F.lit(1))
    base = F.concat(F.regexp_replace(as_col(cwd), "/+$", ""), F.lit("/"))
    return F.array_join(F.transform(pieces, lambda p: F.when(
        p.rlike(f"^{path}$") & ~F.coalesce(F.startswith(p, base), F.lit(False)),
        "[EXTERNAL-PATH]").otherwise(p)), "")


def identifiers_from_paths(paths) -> Column:
    """Names of code files that are specific enough to be private."""
    base = F.transform(F.coalesce(as_col(paths), empty()), lambda p: F.regexp_extract(p, r"([^/\\]*)$", 1))
    ext = "|".join(wl.CODE_EXTENSIONS)
    code = F.filter(base, lambda b: b.rlike(f"(?i)^[^.].*\\.(?:{ext})$"))
    stem = F.transform(code, lambda b: F.regexp_extract(b, r"^(.*)\.[^.]*$", 1))
    return F.array_distinct(F.filter(
        stem,
        lambda s: s.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~s.isin(wl.COMMON_TERMS)
        & (s.rlike("^[A-Z]") | (F.length(s) >= 8))))


def identifier_leaks(c, ids) -> Column:
    """Identifiers (three characters or more) still present in the text."""
    return let(c, lambda text: F.array_distinct(F.filter(
        F.coalesce(as_col(ids), empty()),
        lambda v: (F.length(v) >= 3) & F.contains(text, v))))
