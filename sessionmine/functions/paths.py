"""Columns over paths and tool arguments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import wordlists as wl
from .text import empty, as_col


def base_name(c) -> Column:
    return F.regexp_extract(as_col(c), r"([^/]*)$", 1)


def extension(c) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r"\.([^.]*)$", 1))


def is_source(c) -> Column:
    return extension(c).isin(wl.SOURCE_EXTENSIONS)


def language_of(c) -> Column:
    table = F.create_map(*[F.lit(x) for kv in wl.LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(c)), F.lit("text"))


# --- Fixed values: path and name patterns per code role, first match wins ------
ROLE_PATTERNS = [
    ("test",
     r"(^|/)(test|tests|spec|__tests__|e2e)(/|$)",
     r"\.(test|spec)\.[a-z]+$|(^|[_.-])(test|spec)s?\.|test\.(java|kt|py|go|rs)$"),
    ("build-config",
     None,
     r"\.(json|toml|properties|xml|yml|yaml|gradle|kts)$"
     r"|^(package|pom|build|settings|gradle|go|cargo|pyproject|tsconfig)|mods\.toml$"),
    ("api-client",
     r"(^|/)(api|client|clients|sdk|gateway|remote|integration)(/|$)",
     r"(client|gateway|adapter|sdk)"),
    ("service-layer",
     r"(^|/)(service|services|usecase|usecases|handler|handlers|controller|controllers|app)(/|$)",
     r"(service|handler|controller|usecase)"),
    ("domain-model",
     r"(^|/)(domain|model|models|entity|entities|policy|policies|rule|rules|validator|validators)(/|$)",
     r"(policy|validator|entity|model|rule)"),
    ("config", r"(^|/)(config|configs|settings)(/|$)", None),
]


def role_of(c) -> Column:
    low = F.lower(as_col(c))
    name = base_name(low)
    out = None
    for role, path_pattern, name_pattern in ROLE_PATTERNS:
        test = F.lit(False)
        if path_pattern:
            test = test | low.rlike(path_pattern)
        if name_pattern:
            test = test | name.rlike(name_pattern)
        out = F.when(test, role) if out is None else out.when(test, role)
    return out.otherwise("other")


def keep_inside(paths, cwd) -> Column:
    """Workspace-relative paths only, normalised, distinct, order kept."""
    base = F.concat(F.regexp_replace(as_col(cwd), "/+$", ""), F.lit("/"))

    def relative(p: Column) -> Column:
        t = F.trim(p)
        inside = F.when(F.startswith(t, F.lit("/")),
                        F.when(F.startswith(t, base), F.substr(t, F.length(base) + 1))).otherwise(t)
        usable = (F.length(t).between(1, 300) & (inside != "")
                  & ~F.startswith(inside, F.lit("/")) & ~F.startswith(inside, F.lit("..")))
        return F.when(usable, F.regexp_replace(inside, r"^\./", ""))

    return F.array_distinct(F.filter(F.transform(F.coalesce(as_col(paths), empty()), relative),
                                     lambda p: p.isNotNull() & (p != "")))


def files_from_arguments(arguments) -> Column:
    """Values of the path keys in a JSON object of tool arguments."""
    values = F.array(*[F.get_json_object(as_col(arguments), f"$.{k}") for k in wl.PATH_KEYS])
    return F.filter(values, lambda v: v.isNotNull() & F.length(v).between(1, 300))


def files_from_prose(c) -> Column:
    found = F.regexp_extract_all(as_col(c), F.lit(wl.PROSE_FILE), F.lit(1))
    return F.filter(found, lambda p: ~p.startswith("http"))


def camel_words(c) -> Column:
    """Lower-case words of identifiers: four characters or more, or CJK."""
    split1 = F.regexp_replace(as_col(c), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    split2 = F.regexp_replace(split1, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.split(split2, r"[^A-Za-z0-9一-龥]+"), F.lower)
    return F.filter(words, lambda w: ((F.length(w) >= 4) | w.rlike(r"[一-龥]")) & ~w.rlike(r"^\d+$"))


def prose_terms(c) -> Column:
    """Words of the CJK runs and identifiers in free text."""
    found = F.regexp_extract_all(as_col(c), F.lit(wl.NAMED_TERM), F.lit(1))
    return F.flatten(F.transform(found, camel_words))


def action_terms(arguments) -> Column:
    """What a tool call is about: words of file names and of named things.

    The values of body and path keys are skipped wherever they are nested.
    """
    raw = as_col(arguments)
    names = F.transform(files_from_arguments(raw), lambda p: F.regexp_extract(p, r"([^/\\]*)$", 1))
    from_files = camel_words(F.array_join(names, " "))
    skipped = "|".join(wl.BODY_KEYS + wl.PATH_KEYS)
    # Possessive loops: Java matches them without recursion, whatever the length.
    text = r'"(?:[^"\\]++|\\.)*+"'
    scalar_list = r"\[(?:[^\[\]{}\"]++|" + text + r")*+\]"
    # Drop skipped string values and skipped lists of strings, then all keys.
    kept = F.regexp_replace(raw, r'"(?:' + skipped + r')"\s*:\s*(?:' + text + "|" + scalar_list + ")", "")
    kept = F.regexp_replace(kept, text + r"\s*:", "")
    values = F.regexp_extract_all(kept, F.lit("(" + text + ")"), F.lit(1))
    plain = F.transform(values, lambda v: F.regexp_replace(F.substring(v, 2, F.length(v) - 2), r"\\[nrt]", " "))
    valid = F.try_parse_json(raw).isNotNull()
    from_values = F.flatten(F.transform(plain, prose_terms))
    return F.array_distinct(F.concat(from_files, F.when(valid, from_values).otherwise(empty())))
