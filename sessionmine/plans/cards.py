"""Cards: merge, evict, conflicts, outcomes, references, advice, maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cards as cf, wordlists as wl
from ..functions.paths import action_terms, files_from_arguments
from ..functions.text import arr, as_col, card_key, empty, norm_key, normalize_domain, strip
from ..operators.blocks import Marks, Postings, against
from ..operators.joins import join_null_safe
from ..operators.probes import rarest
from ..operators.ranking import top_per_group
from ..operators.running import running
from ..operators.setjoin import containment, max_containment
from ..operators.shared import cut
from ..operators.sizes import hint, is_small, keep
from .sessions import evidence_words, is_evidence

KEYS = ["scope", "partition", "key"]
# How many entries each list of a card keeps.
LIST_CAPS = {"steps": 24, "invariants": 24, "pitfalls": 24, "verify": 24, "tags": 12, "api": 12, "evidence": 20}
REFERENCE_EPOCH = 2
GENERIC_NEEDLE_CARDS = 3
MAX_CONFLICTS = 8
SEPARATOR = "[./#-]"
#: Characters before and after a separator by which compound needles are found, longest first.
WIDTHS = sorted(((a, b) for a in (6, 3, 1) for b in (6, 3, 1)), key=lambda w: -w[0] - w[1])

_API = "array<struct<symbol:string,signature:string,notes:string>>"
_EVIDENCE = "array<struct<kind:string,repo:string,role:string,hint:string,session_id:string>>"
_SDKS = "array<struct<name:string,version:string>>"
_MAPS = ["framework_versions", "version_constraints", "versions"]


def storable(scope: str, allow_confidential: bool = False) -> Column:
    """Confidential drafts stay inside their project."""
    if scope == "project" or allow_confidential:
        return F.lit(True)
    return F.coalesce("sensitivity", F.lit("internal")) != "confidential"


def drop_restatements(drafts: DataFrame, library: DataFrame, read: DataFrame | None = None,
                      library_ratio: float = 0.6, read_ratio: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Split drafts (`id, text[, session_id]`) into kept and dropped.

    A draft is a restatement where one library record (`id, text`) contains at least
    `library_ratio` of its words, or one record its own session had read
    (`read(session_id, id)`) at least `read_ratio`.
    """
    hits = max_containment(drafts.select("id", "text"), library.select("id", "text"), library_ratio)
    marked = drafts.join(hits.filter(F.col("max_ratio").isNotNull()).select(
        "id", F.lit("library").alias("_lib")), "id", "left")
    if read is not None:
        # Only what the sessions have read is compared, under the session's own key.
        seen = read.select("session_id", "id").distinct().join(library.select("id", "text"), "id")
        pairs = containment(drafts.select("session_id", "id", "text"), seen, read_ratio, by=("session_id",))
        seen = pairs.select(F.col("id_a").alias("id")).distinct().withColumn("_read", F.lit("session"))
        marked = marked.join(seen, "id", "left")
    else:
        marked = marked.withColumn("_read", F.lit(None).cast("string"))
    marked = marked.withColumn("restates", F.coalesce("_read", "_lib"))
    kept = marked.filter(F.col("restates").isNull()).select(drafts.columns)
    return kept, marked.filter(F.col("restates").isNotNull()).select(*drafts.columns, "restates")


def _rows(df: DataFrame, existing: bool) -> DataFrame:
    """Cards and drafts in one shape; stored cards come before all drafts."""
    have = set(df.columns)
    col = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    own = F.coalesce(col("evidence", _EVIDENCE), F.array().cast(_EVIDENCE))
    session = F.array(F.struct(F.lit("session").alias("kind"), *[F.lit(None).cast("string").alias(x) for x in
                                                                 ("repo", "role", "hint")],
                               (F.col("session_id") if "session_id" in have else F.lit(None).cast("string")).alias("session_id")))
    zero = lambda n: F.coalesce(col(n, "long"), F.lit(0)).cast("long").alias(n)
    return df.select(
        "scope", "partition", card_key(strip("name"), strip("when"), "domain").alias("key"),
        F.lit(existing).alias("stored"),
        (F.lit(-1) if existing else F.col("seq")).cast("long").alias("seq"),
        (F.col("id") if existing else F.lit(None).cast("string")).alias("id"), "ts",
        (F.col("updated_at") if existing else F.col("ts")).alias("updated_at"),
        "kind", F.coalesce("status", F.lit("draft")).alias("status"),
        F.coalesce("sensitivity", F.lit("internal")).alias("sensitivity"),
        strip("name").alias("name"), F.when(strip("gist") != "", strip("gist")).alias("gist"),
        strip("when").alias("when"), (F.col("summary") if existing else strip("summary")).alias("summary"),
        "subject", "location", "reuse", "applies_to", "domain", "example", "stack",
        *[arr(c).alias(c) for c in ("steps", "invariants", "pitfalls", "verify", "tags")],
        F.coalesce("api", F.array().cast(_API)).alias("api"),
        own.alias("own_evidence"), session.alias("session_evidence"),
        (F.col("hits") if existing else F.lit(1)).cast("long").alias("hits"),
        *[zero(n) for n in ("applied", "successes", "failures", "retrieve_count", "referenced")],
        col("reference_epoch", "int").alias("reference_epoch"),
        col("archived_at", "timestamp").alias("archived_at"), col("last_verified_at", "timestamp").alias("last_verified_at"),
        (F.col("verifications") if "verifications" in have else F.lit(None).cast(
            "array<struct<outcome:string,evidence:string,at:timestamp,session_id:string,cwd:string,self_reported:boolean>>")
         ).alias("verifications"),
        col("provenance", "string").alias("provenance"))


def merge_cards(drafts: DataFrame, existing: DataFrame | None = None, cap: int | None = None,
                list_caps: dict[str, int | None] = LIST_CAPS) -> DataFrame:
    """Merge drafts into cards by name + trigger + domain.

    The strictly longest summary wins, status and sensitivity only rise, optional fields
    keep their first value, lists join up to `list_caps` (None keeps all of a list).  `created`
    and `merged` tell what happened to each card; `cap` leaves eviction to `evict_cards`.
    """
    d = _rows(drafts, False).filter((F.col("name") != "") & (F.col("when") != "") & (F.col("key") != ""))
    rows = d if existing is None else d.unionByName(_rows(existing, True))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    rank_of = lambda table, c: F.element_at(F.create_map(
        *[F.lit(x) for kv in table.items() for x in kv]), F.col(c))
    body = rows.groupBy(*KEYS).agg(
        F.max("id").alias("id"), F.min("ts").alias("ts"), F.max("updated_at").alias("updated_at"),
        first("kind"), F.max_by("status", rank_of(wl.STATUS_RANK, "status")).alias("status"),
        F.max_by("sensitivity", rank_of(wl.SENSITIVITY_RANK, "sensitivity")).alias("sensitivity"),
        first("name"), first("gist"), first("when"),
        F.max_by("summary", F.struct(F.length("summary"), -F.col("seq"))).alias("summary"),
        *[first(c) for c in ("subject", "location", "reuse", "applies_to", "domain", "example", "provenance")],
        F.min_by("stack.ecosystem", F.when(F.col("stack.ecosystem").isNotNull(), F.col("seq"))).alias("_eco"),
        F.min_by("stack.build_tool", F.when(F.col("stack.build_tool").isNotNull(), F.col("seq"))).alias("_tool"),
        F.sum("hits").alias("hits"),
        *[F.sum(c).alias(c) for c in ("applied", "successes", "failures", "retrieve_count", "referenced")],
        F.max("reference_epoch").alias("reference_epoch"), F.max("archived_at").alias("archived_at"),
        F.max("last_verified_at").alias("last_verified_at"), first("verifications"),
        F.max("stored").alias("stored"), F.min("seq").alias("_first"), F.sum((~F.col("stored")).cast("int")).alias("_drafts"))

    # Evidence of the row that creates a card: its own, else its session; later rows add both.
    made = body.select(*KEYS, F.col("_first"))
    ev = join_null_safe(rows, made, KEYS).withColumn("evidence", F.when(
        F.col("stored"), F.col("own_evidence")).when(
        F.col("seq") == F.col("_first"),
        F.when(F.size("own_evidence") > 0, F.col("own_evidence")).otherwise(F.col("session_evidence"))).otherwise(
        F.concat("own_evidence", "session_evidence")))
    lists = _joined_lists(ev, list_caps)
    new_id = F.concat(F.lit("tq_"), F.substring(F.sha1(F.concat_ws("|", *KEYS)), 1, 32))
    out = join_null_safe(body, lists, KEYS, "left")
    stack = F.struct(
        F.col("_eco").alias("ecosystem"), arr("languages").alias("languages"), F.col("frameworks"),
        *[F.col(m) for m in _MAPS], F.col("sdks"), F.col("_tool").alias("build_tool"))
    out = out.select(
        F.coalesce("id", new_id).alias("id"), "ts", "updated_at", "scope", "partition", "kind", "status", "sensitivity",
        "name", "gist", "when", "summary", arr("steps").alias("steps"), "subject", "location", "reuse", "applies_to",
        arr("invariants").alias("invariants"), "api", "example", arr("pitfalls").alias("pitfalls"),
        arr("verify").alias("verify"), stack.alias("stack"), "domain", arr("tags").alias("tags"), "evidence",
        F.lit(True).alias("deidentified"), "hits", "applied", "successes", "failures", "retrieve_count", "referenced",
        "reference_epoch", "archived_at", "last_verified_at", "verifications", "provenance",
        (~F.col("stored")).alias("created"),
        (F.col("_drafts") - (~F.col("stored")).cast("int")).alias("merged"))
    return out if cap is None else evict_cards(out, cap)


def _joined_lists(rows: DataFrame, list_caps: dict[str, int | None]) -> DataFrame:
    """Ordered distinct unions of all list fields in one exploded table."""
    def items(field: str, c: Column, ident) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(field).alias("f"), ident(x).alias("k"), F.to_json(
            F.struct(x.alias("x"))).alias("j")))

    empty_sdk = F.coalesce("stack.sdks", F.array().cast(_SDKS))
    api_ok = F.filter("api", lambda a: F.trim(a["symbol"]) != "")
    blank = lambda x: F.coalesce(x, F.lit(""))
    parts = [items(c, F.col(c), lambda x: x) for c in ("steps", "invariants", "pitfalls", "verify", "tags")]
    parts += [items("api", api_ok, lambda a: F.trim(a["symbol"])),
              items("evidence", F.col("evidence"), lambda e: F.concat_ws("|", *[blank(e[n]) for n in (
                  "kind", "repo", "role", "hint", "session_id")])),
              items("languages", arr("stack.languages"), lambda x: x),
              items("frameworks", arr("stack.frameworks"), lambda x: x),
              items("sdks", empty_sdk, lambda s: s["name"])]
    for m in _MAPS:
        entries = F.coalesce(F.map_entries(F.col("stack")[m]), F.array().cast("array<struct<key:string,value:string>>"))
        parts.append(items(m, entries, lambda e: e["key"]))
    flat = rows.select(*KEYS, "seq", F.posexplode(F.concat(*parts)).alias("pos", "i"))
    at = F.struct("seq", "pos")
    one = flat.groupBy(*KEYS, "i.f", "i.k").agg(F.min(at).alias("at"), F.min_by("i.j", at).alias("first"),
                                                F.max_by("i.j", at).alias("last"))
    limits = {k: v for k, v in list_caps.items() if v is not None}
    place = F.struct("at.seq", "at.pos")
    if limits:
        caps = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("f"))
        # The longest cap bounds the ranking; open lists (languages, versions) have no cap.
        capped = top_per_group(one.filter(caps.isNotNull()), [*KEYS, "f"], [F.col("at"), F.col("k")],
                               max(limits.values()), "n", salt_by=["k"]).filter(F.col("n") <= caps).drop("n")
        one = capped.unionByName(one.filter(caps.isNull()))
    one = one.withColumn("n", place)

    def field(name: str) -> Column:
        value = "last" if name in _MAPS else "first"
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == name, F.struct("n", "k", F.col(value).alias("j"))))),
                           lambda s: s["j"]).alias(f"_{name}")

    names = [*LIST_CAPS, "languages", "frameworks", "sdks", *_MAPS]
    g = one.groupBy(*KEYS).agg(*[field(n) for n in names])
    get = lambda name, kind: F.transform(F.col(f"_{name}"), lambda j: F.from_json(j, f"x {kind}")["x"])
    text = lambda name: get(name, "string")
    maps = [F.when(F.size(f"_{m}") > 0, F.map_from_entries(get(m, "struct<key:string,value:string>"))).alias(m) for m in _MAPS]
    return g.select(
        *KEYS, *[text(n).alias(n) for n in ("steps", "invariants", "pitfalls", "verify", "tags", "languages")],
        F.when(F.size("_frameworks") > 0, text("frameworks")).alias("frameworks"),
        get("api", _API[6:-1]).alias("api"), get("evidence", _EVIDENCE[6:-1]).alias("evidence"),
        F.when(F.size("_sdks") > 0, get("sdks", _SDKS[6:-1])).alias("sdks"), *maps)


def evict_cards(cards: DataFrame, cap: int) -> DataFrame:
    """The most valuable `cap` cards per scope; cards created in this run go last."""
    value = (F.when(F.col("archived_at").isNotNull(), 0).when(F.col("successes") > 0, 4)
             .when(F.coalesce("referenced", F.lit(0)) > 0, 3)
             .when((F.coalesce("retrieve_count", F.lit(0)) > 0)
                   | (F.size(F.coalesce("verifications", F.array())) > 0), 2).otherwise(1))
    fresh = F.coalesce("created", F.lit(False)) if "created" in cards.columns else F.lit(False)
    return top_per_group(cards, ["scope", "partition"],
                         [fresh.cast("int").desc(), value.desc(), F.col("hits").desc(), F.col("ts").desc(), F.col("id")],
                         cap).drop("rank")


def conflicts(cards: DataFrame, limit: int = MAX_CONFLICTS) -> DataFrame:
    """`id, conflicts_with`: other live cards with the same trigger, the first `limit`."""
    live = (cards.filter(F.col("status") != "deprecated")
            .select("scope", "partition", norm_key("when").alias("trigger"), "ts", "id").filter(F.length("trigger") >= 4))
    keys = ["scope", "partition", "trigger"]
    # One more id than the limit is enough to list others for any card of the group.
    few = top_per_group(live, keys, [F.col("ts"), F.col("id")], limit + 1, "n")
    lists = few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda s: s["id"]).alias("ids"))
    lists = lists.filter(F.size("ids") > 1)
    return join_null_safe(live, lists, keys).select(
        "id", F.slice(F.filter("ids", lambda i: i != F.col("id")), 1, limit).alias("conflicts_with"))


# ---- outcomes ------------------------------------------------------------------

def check_evidence(outcomes: DataFrame) -> DataFrame:
    reason = cf.evidence_reason("evidence")
    return outcomes.withColumn("reason", reason).withColumn("ok", reason.isNull())


def apply_outcomes(cards: DataFrame, outcomes: DataFrame, check: bool = True, chunk: Column | None = None) -> DataFrame:
    """Fold reported outcomes into the cards' counters and trust state.

    States only rise and `deprecated` beats all, so running counts and a maximum give the
    same state as applying the reports one by one.  `chunk` must grow with `at`
    (default: the day).
    """
    o = outcomes
    if check:
        o = check_evidence(o).filter("ok").drop("ok", "reason").withColumn("evidence", cf.stored_evidence("evidence"))
    if "seq" not in o.columns:
        o = o.withColumn("seq", F.lit(0))
    success, self_made = F.col("outcome") == "success", F.coalesce("self_reported", F.lit(False))
    o = o.withColumn("_s", (success & ~self_made).cast("long")).withColumn("_f", (F.col("outcome") == "failure").cast("long"))
    start = cards.select(F.col("id").alias("card_id"), F.coalesce("successes", F.lit(0)).alias("_s0"),
                         F.coalesce("failures", F.lit(0)).alias("_f0"),
                         F.exists(F.coalesce("evidence", F.array().cast(_EVIDENCE)), lambda e: e["kind"] == "code").alias("_code"))
    run = running(o, ["card_id"], ["at", "seq"], F.date_trunc("day", "at") if chunk is None else chunk,
                  sums={"s": F.col("_s"), "f": F.col("_f")})
    run = run.join(start, "card_id")
    s, f = F.col("s") + F.col("_s0"), F.col("f") + F.col("_f0")
    dead = (f >= 2) & (f > s)
    state = F.when(dead, 3).when((s >= 3) & (f == 0) & F.col("_code"), 2).when(s >= 1, 1).otherwise(0)
    ver = F.struct("outcome", "evidence", "at", "session_id",
                   (F.col("cwd") if "cwd" in o.columns else F.lit(None).cast("string")).alias("cwd"),
                   self_made.alias("self_reported"))
    agg = run.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("_applied"), F.sum("_s").alias("_ds"), F.sum("_f").alias("_df"),
        F.max(state).alias("_state"), F.max(F.when(success, F.col("at"))).alias("_ok_at"), F.max("at").alias("_at"))
    last = top_per_group(run.withColumn("v", ver), ["card_id"], [F.col("at").desc(), F.col("seq").desc()], 5, "n",
                         salt_by=["session_id", "at"])
    last = last.groupBy("card_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("_vs"))
    names = F.array(*[F.lit(x) for x in wl.STATUS_RANK])
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in wl.STATUS_RANK.items() for x in kv]), F.col("status"))
    j = cards.join(agg, cards["id"] == agg["card_id"], "left").drop("card_id").join(last, cards["id"] == last["card_id"], "left").drop("card_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    new = {
        "status": F.get(names, F.greatest(rank, zero("_state"))),
        "applied": zero("applied") + zero("_applied"), "successes": zero("successes") + zero("_ds"),
        "failures": zero("failures") + zero("_df"),
        "archived_at": F.when(zero("_ds") == 0, F.col("archived_at")),
        "last_verified_at": F.greatest("last_verified_at", "_ok_at"), "updated_at": F.greatest("updated_at", "_at"),
        "verifications": F.slice(F.concat(F.coalesce("_vs", F.array().cast(_VER)),
                                          F.coalesce("verifications", F.array().cast(_VER))), 1, 5)}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in cards.columns])


_VER = "array<struct<outcome:string,evidence:string,at:timestamp,session_id:string,cwd:string,self_reported:boolean>>"


def usage_counters(events: DataFrame) -> DataFrame:
    """Counts per card from `card_id, event ('retrieve'|'reference'), at`."""
    is_ = lambda n: F.col("event") == n
    return events.groupBy("card_id").agg(
        F.count_if(is_("retrieve")).alias("retrieve_count"), F.count_if(is_("reference")).alias("referenced"),
        F.max(F.when(is_("retrieve"), F.col("at"))).alias("last_retrieved_at"),
        F.max(F.when(is_("reference"), F.col("at"))).alias("last_referenced_at"))


# ---- references -----------------------------------------------------------------

def needles(cards: DataFrame) -> DataFrame:
    """`id, pos, needle`; cards bring `symbols` or `subject` and `api`.

    Kept, since those who look for needles read them several times.
    """
    syms = F.col("symbols") if "symbols" in cards.columns else cf.symbols("subject", "api")
    return keep(cards.select("id", F.posexplode(cf.reference_needles(syms)).alias("pos", "needle")))


def generic_needles(card_needles: DataFrame, min_cards: int = GENERIC_NEEDLE_CARDS) -> DataFrame:
    return (card_needles.groupBy("needle").agg(F.count_distinct("id").alias("n_cards"))
            .filter(F.col("n_cards") >= min_cards))


def around(c, before: int, after: int) -> Column:
    """The characters around each separator of a text that has so many on both sides."""
    return F.regexp_extract_all(as_col(c), F.lit(f"(?=(.{{{before}}}{SEPARATOR}.{{{after}}}))"), F.lit(1))


def needle_hits(calls: DataFrame, card_needles: DataFrame, keys: list[str]) -> DataFrame:
    """`keys..., call_id, id, needle, pos` where a call's `arguments` mention a needle.

    Substring search as equi-joins: a plain identifier must equal a whole identifier of the
    arguments; a compound needle is found by the characters around that separator of it which
    the fewest needles share, as many of them on each side as it has, and then checked in full.
    """
    each = card_needles.select("needle").distinct().withColumn("compound", F.col("needle").rlike(SEPARATOR))
    widths = F.filter(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after"), around("needle", a, b).alias("probes"))
                                for a, b in WIDTHS]), lambda w: F.size(w["probes"]) > 0)
    each = keep(each.withColumn("at", F.when(F.col("compound"), F.get(widths, F.lit(0)))))
    each = each.withColumn("probes", F.when(F.col("compound"), F.col("at.probes")).otherwise(F.array("needle")))
    shared = each.select(F.explode(F.array_distinct("probes")).alias("probe")).groupBy("probe").agg(F.count(F.lit(1)).alias("n"))
    n = card_needles.join(rarest(each, ["needle", "compound"], "probes", shared), "needle")
    plain = F.array_distinct(F.regexp_extract_all("arguments", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)))
    # Only windows of the sizes that some needle is looked for by.
    sizes = each.filter("at IS NOT NULL").select("at.before", "at.after").distinct().collect()
    windows = F.array_distinct(F.concat(empty(), *[around("arguments", w.before, w.after) for w in sizes]))
    probes = calls.select(*keys, "call_id", F.explode(F.concat(
        F.transform(plain, lambda t: F.struct(F.lit(False).alias("compound"), t.alias("probe"))),
        F.transform(windows, lambda t: F.struct(F.lit(True).alias("compound"), t.alias("probe"))))).alias("p"))
    probes = probes.select(*keys, "call_id", "p.compound", "p.probe")
    on = [*[k for k in keys if k in card_needles.columns], "compound", "probe"]
    n = keep(n)
    found = probes.join(hint(n, is_small(n)), on).select(*keys, "call_id", "id", "needle", "pos", "compound").distinct()
    sure = found.filter(~F.col("compound")).drop("compound")
    check = found.filter("compound").drop("compound").join(
        calls.select(*keys, "call_id", "arguments"), [*keys, "call_id"]).filter(
        F.contains("arguments", "needle")).drop("arguments")
    return sure.unionByName(check)


def references(surfaced: DataFrame | None, calls: DataFrame, card_needles: DataFrame,
               generic: DataFrame | None = None) -> DataFrame:
    """First mention per (session, card) of a shown card in a later successful call.

    `surfaced(session_id, id, seq)`, `calls(session_id, call_id, seq, arguments, is_error)`.
    Without `surfaced`, every card counts as shown before the first call: the needles are
    looked for in all calls, and no table of sessions and cards is made.
    """
    usable = card_needles if generic is None else card_needles.join(generic.select("needle"), "needle", "left_anti")
    good = calls.filter(~F.coalesce("is_error", F.lit(False)))
    if surfaced is None:
        found = needle_hits(good, usable.filter(F.col("id").isNotNull()), ["session_id"])
        return _first_mentions(found.join(good.filter(F.col("seq").isNotNull()).select("session_id", "call_id", "seq"), ["session_id", "call_id"]))
    shown = surfaced.groupBy("session_id", "id").agg(F.min("seq").alias("shown_at"))
    mine = shown.join(usable, "id").select("session_id", "id", "pos", "needle")
    hits = needle_hits(good, mine, ["session_id"])
    timed = (hits.join(good.select("session_id", "call_id", "seq"), ["session_id", "call_id"])
             .join(shown, ["session_id", "id"]).filter(F.col("seq") > F.col("shown_at")))
    return _first_mentions(timed)


def _first_mentions(timed: DataFrame) -> DataFrame:
    return timed.groupBy("session_id", "id").agg(F.min(F.struct("seq", "pos", "call_id", "needle")).alias("f")).select(
        "session_id", "id", "f.call_id", "f.seq", "f.needle")


def precise_cards(calls: DataFrame, card_needles: DataFrame) -> DataFrame:
    """`session_id, call_id, id, n_needles`: cards named in the call, or named before in
    the same session in a call on the same file (`n_needles` = 0)."""
    hits = needle_hits(calls, card_needles, ["session_id"])
    direct = keep(hits.groupBy("session_id", "call_id", "id").agg(F.count_distinct("needle").alias("n_needles")))
    on_file = calls.select("session_id", "call_id", "seq", F.explode(files_from_arguments("arguments")).alias("file"))
    first = (direct.join(on_file, ["session_id", "call_id"]).groupBy("session_id", "file", "id")
             .agg(F.min("seq").alias("since")))
    later = (on_file.join(first, ["session_id", "file"]).filter(F.col("seq") > F.col("since"))
             .select("session_id", "call_id", "id").distinct()
             .join(direct, ["session_id", "call_id", "id"], "left_anti").withColumn("n_needles", F.lit(0).cast("long")))
    return direct.unionByName(later)


def advise(calls: DataFrame, cards: DataFrame, precise: DataFrame | None = None, seen: DataFrame | None = None,
           k: int = 1) -> DataFrame:
    """Cards that speak about what a tool call touches, best k per call.

    `cards(id, text, ts[, symbols, archived])`.  On editing tools the cards in `precise`
    come first, and where there are none the word rule decides alone.

    The words of the cards lie in blocks (see `operators.blocks`): the task of a block counts
    what each call shares with all of its cards and lets the best k out. `precise` and `seen`
    are written on the cards as the numbers of calls and sessions.
    """
    pool = cards.filter(~F.coalesce("archived", F.lit(False))) if "archived" in cards.columns else cards
    terms = calls.select("session_id", "call_id", "tool", F.explode(action_terms("arguments")).alias("term")).filter(
        is_evidence("term"))
    # A call that comes twice says its words twice; so do cards that share an id.
    asked = terms.groupBy("session_id", "call_id", "tool").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    asked = cut(asked.withColumn("no", F.monotonically_increasing_id()))
    held = pool.filter(F.col("id").isNotNull()).select("id", "ts", evidence_words(pool).alias("words")).groupBy("id").agg(
        F.collect_list(F.struct("ts")).alias("times"), F.flatten(F.collect_list("words")).alias("words"))
    if precise is not None:
        named = precise.select("session_id", "call_id", "id", (F.coalesce("n_needles", F.lit(0)) >= 2).alias("several")).join(
            asked.filter(F.coalesce(F.col("tool").isin(wl.EDIT_TOOLS), F.lit(True))).select("session_id", "call_id", "no"), ["session_id", "call_id"])
        held = held.join(named.groupBy("id").agg(
            F.collect_set("no").alias("named"), F.collect_set(F.when(F.col("several"), F.col("no"))).alias("several")), "id", "left")
    if seen is not None:
        sessions = asked.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.min("no").alias("session"))
        asked = asked.join(sessions, "session_id", "left")
        held = held.join(seen.join(sessions, "session_id").groupBy("id").agg(F.collect_set("session").alias("seen")), "id", "left")
    lists = [F.coalesce(F.col(c) if c in held.columns else F.lit(None), F.array()).cast("array<long>").alias(c)
             for c in ("named", "several", "seen")]
    held = keep(held.filter(F.size("words") > 0).select("id", F.explode("times.ts").alias("ts"), "words", *lists))
    session = F.col("session") if seen is not None else F.lit(None)
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    unknown = F.col("tool").isNull().alias("unknown")
    best = against(asked.select("no", F.coalesce(session, F.lit(-1)).cast("long").alias("session"), unknown, "terms"), held, "words",
                   f"no long, id {kinds['id']}, ts {kinds['ts']}, n_terms long, n_chars long, exact int, several int, terms array<string>",
                   _most_shared(k))
    best = best.withColumn("terms", F.array_sort("terms")).join(asked.select("session_id", "call_id", "no"), "no")
    order = [F.col("exact").desc(), F.col("several").desc(), F.col("n_terms").desc(), F.col("n_chars").desc(),
             F.col("ts").desc(), F.col("id")]
    return top_per_group(best, ["session_id", "call_id"], order, k).select(
        "session_id", "call_id", "id", "terms", "n_terms", "n_chars", "exact", "rank")


def _most_shared(k: int) -> Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the words that the calls of a batch (`no, session, unknown, terms`) share with each
    card of a block (`id, ts, words, named, several, seen`) and picks the best `k` of each call.

    A card that a call without a tool names comes after those that it doesn't name, with NULL
    for `exact` (and for `several`).
    """
    # One number that sorts as (exact, several, words, characters): sums below 2**53 are exact.
    word, several, exact = 1 << 29, 1 << 60, 1 << 61
    none = np.iinfo(np.int64).min

    def count(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block.sort_by([("ts", "descending"), ("id", "ascending")])  # the first of equal cards is the best
        known = Postings(block["words"].combine_chunks(), by_text=True)
        weights = word + pc.utf8_length(known.words).to_numpy(zero_copy_only=False).astype(np.float64)
        marks = {c: Marks(block[c].combine_chunks()) for c in ("named", "several", "seen")}
        ids, times = block["id"].combine_chunks(), block["ts"].combine_chunks()
        del block
        for batch in batches:
            flat, starts = known.numbers(batch["terms"])
            calls, cards, keys, shared = [], [], [], []
            for i, (no, session, unknown) in enumerate(zip(*(batch[c].to_pylist() for c in ("no", "session", "unknown")))):
                mine = flat[starts[i]:starts[i + 1]]
                mine = mine[mine >= 0]
                if not len(mine):
                    continue
                where = np.concatenate([known.texts[s] for s in known.spans(mine)])
                key = np.bincount(where, np.repeat(weights[mine], known.df[mine]), known.n).astype(np.int64)
                key[key == 0] = none
                key[marks["seen"].of(session)] = none
                for c, more in (("named", exact), ("several", several)):
                    at = marks[c].of(no)
                    key[at[key[at] != none]] += -more if unknown else more
                if k == 1:
                    hits = [key.argmax()]
                else:
                    hits = np.flatnonzero(key >= np.partition(key, known.n - k)[known.n - k]) if k < known.n else range(known.n)
                hits = sorted((-int(key[t]), t) for t in hits if key[t] != none)[:k]
                for less, t in hits:
                    calls.append(no)
                    cards.append(t)
                    keys.append(-less)
                    shared.append(np.intersect1d(mine, known.tokens(t)))
            if calls:
                at, keys = pa.array(cards), np.array(keys, np.int64)
                level = keys // several
                ends = np.cumsum([0, *map(len, shared)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(calls, pa.int64()), ids.take(at), times.take(at),
                    pa.array(keys % several // word, pa.int64()), pa.array(keys % word, pa.int64()),
                    pa.array(level >= 2, mask=level < 0).cast(pa.int32()),
                    pa.array(level % 2 == 1, mask=(level < 0) & (level % 2 == 1)).cast(pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.words.take(pa.array(np.concatenate(shared))))],
                    ["no", "id", "ts", "n_terms", "n_chars", "exact", "several", "terms"])

    return count


def symbol_index(cards: DataFrame) -> DataFrame:
    """`symbol, id`: one row per symbol and card, so a popular symbol stays many rows."""
    syms = F.col("symbols") if "symbols" in cards.columns else cf.symbols("subject", "api")
    return cards.select(F.explode(syms).alias("symbol"), "id").distinct()


# ---- maintenance -----------------------------------------------------------------

def maintain(cards: DataFrame, now, after_days: int = 14, keep_prefixes: tuple[str, ...] = (),
             cap: int = 150) -> DataFrame:
    """Patches `id, domain, archived_at, referenced, reference_epoch, reason` for cards
    that need one: domain names, dead weight, per-domain draft cap, old reference counts."""
    now = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    prefixes = list(keep_prefixes)
    vocab = cards.select("scope", "partition", normalize_domain("domain").alias("known")).filter(
        F.col("known").isNotNull()).distinct()
    # How many cards share (scope, name, trigger): backfilling those could merge them.
    twins = cards.groupBy("scope", "partition", "name", "when").agg(F.count(F.lit(1)).alias("twins"))
    blank = cards.filter(normalize_domain("domain").isNull())
    tagged = (blank.select("scope", "partition", "id", F.posexplode(F.transform("tags", normalize_domain)).alias("pos", "known"))
              )
    tagged = (join_null_safe(tagged, vocab, ["scope", "partition", "known"]).groupBy("id")
              .agg(F.min_by("known", "pos").alias("from_tag")))
    c = join_null_safe(cards, twins, ["scope", "partition", "name", "when"], "left").join(tagged, "id", "left")
    normal = normalize_domain("domain")
    c = c.withColumn("new_domain", F.coalesce(normal, F.when(F.col("twins") <= 1, F.col("from_tag"))))
    c = c.withColumn("old_age", cf.archivable(now, after_days, prefixes))
    # The cap counts drafts still active after the age rule, by their new domain.
    exempt = F.lit(False)
    for p in prefixes:
        exempt = exempt | F.col("new_domain").startswith(p)
    active = c.filter((F.col("status") == "draft") & F.col("archived_at").isNull() & ~F.col("old_age")
                      & F.col("new_domain").isNotNull() & ~exempt)
    groups = ["scope", "partition", "new_domain"]
    sizes = active.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_active")).filter(F.col("n_active") > cap)
    unused = join_null_safe(active.filter(cf.archivable(now, 0, prefixes, domain="new_domain")), sizes, groups)
    over = oldest_excess(unused.select(*groups, "id", "ts", (F.col("n_active") - cap).alias("excess")), groups) \
        if cap > 0 else unused.select("id").limit(0)
    c = c.join(over.select("id", F.lit(True).alias("capped")), "id", "left")
    archive = F.col("old_age") | F.coalesce("capped", F.lit(False))
    stale = (F.coalesce("referenced", F.lit(0)) > 0) & (F.coalesce("reference_epoch", F.lit(0)) < REFERENCE_EPOCH)
    renamed = ~F.col("new_domain").eqNullSafe(F.col("domain"))
    return c.filter(archive | stale | renamed).select(
        "id", F.col("new_domain").alias("domain"), F.when(archive, now).otherwise(F.col("archived_at")).alias("archived_at"),
        F.when(stale, 0).otherwise(F.col("referenced")).alias("referenced"),
        F.when(stale, REFERENCE_EPOCH).otherwise(F.col("reference_epoch")).alias("reference_epoch"),
        F.concat_ws(",", F.when(F.col("old_age"), "aged"), F.when(F.coalesce("capped", F.lit(False)), "capped"),
                    F.when(renamed, "domain"), F.when(stale, "epoch")).alias("reason"))


def oldest_excess(rows: DataFrame, groups: list[str]) -> DataFrame:
    """The `excess` oldest rows of each group, whatever the group's size.

    A count per day finds the day in which the quota ends; only that day's rows are ranked.
    """
    r = rows.withColumn("_day", F.date_trunc("day", "ts"))
    out = running(r.groupBy(*groups, "_day").agg(F.count(F.lit(1)).alias("n"), F.max("excess").alias("excess")),
                  groups, ["_day"], F.date_trunc("year", "_day"), sums={"upto": F.col("n")})
    out = out.withColumn("before", F.col("upto") - F.col("n")).filter(F.col("before") < F.col("excess"))
    r = join_null_safe(r.drop("excess"), out, [*groups, "_day"])
    whole = r.filter(F.col("upto") <= F.col("excess"))
    w = Window.partitionBy(*groups, "_day").orderBy("ts", "id")
    part = (r.filter(F.col("upto") > F.col("excess")).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= F.col("excess") - F.col("before")).drop("_r"))
    return whole.unionByName(part)
