"""Model replies: cut, parse, validate, clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import wordlists as wl
from ..functions.cards import clip_example
from ..functions.redaction import redact, redact_all
from ..functions.text import clip_head, normalize_domain, strip
from ..operators.ranking import top_per_group


def _text(v: Column) -> Column:
    """A JSON string, trimmed; anything else counts as empty."""
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))), F.lit(""))


def _texts(v: Column, limit: int, size: int) -> Column:
    items = F.transform(F.coalesce(v, F.array().cast("array<variant>")), lambda x: clip_head(_text(x), size))
    return F.slice(F.array_distinct(F.filter(items, lambda x: x != "")), 1, limit)


def _variant_list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def ingest_model_output(replies: DataFrame, stacks: DataFrame | None = None) -> dict[str, DataFrame]:
    """`replies(session_id, text)` to episodes, facts, cards, corrections and rejects."""
    # Generators give the object and its parsed form out, so that a reply is cut and parsed once;
    # a filter on plain columns would do it again for itself.
    r = replies.drop("v").select("*", F.explode_outer(F.array(F.regexp_extract("text", r"(?s)(\{.*\})", 1))).alias("_cut"))
    cut = F.col("_cut")
    r = r.select("*", F.explode_outer(F.array(F.when(cut != "", F.try_parse_json(cut)))).alias("v"))
    rejects = r.filter(F.col("v").isNull()).select("session_id", F.when(cut == "", "no_object").otherwise("not_json").alias("reason"))
    ok = r.filter(F.col("v").isNotNull())
    get = lambda base, p: F.try_variant_get(base, p, "variant")
    v = F.col("v")
    summary = clip_head(_text(get(v, "$.summary")), 2000)
    title = clip_head(_text(get(v, "$.title")), 120)
    title = F.when(title != "", title).when(summary != "", clip_head(summary, 120)).otherwise("untitled session")
    episodes = ok.select(
        "session_id", redact(title).alias("title"), redact(summary).alias("summary"),
        *[redact_all(_texts(_variant_list(v, f"$.{n}"), k, size)).alias(n) for n, k, size in (
            ("decisions", 20, 400), ("todos", 20, 400), ("files", 40, 240))],
        redact_all(F.transform(_texts(_variant_list(v, "$.tags"), 8, 48), F.lower)).alias("tags"), F.lit("model").alias("source"))

    def listed(name: str) -> DataFrame:
        return ok.select("session_id", F.posexplode_outer(_variant_list(v, f"$.{name}")).alias("pos", "e")).filter(F.col("pos").isNotNull())

    e = F.col("e")
    kind = _text(get(e, "$.kind"))
    facts = listed("facts").select(
        "session_id", "pos", F.when(kind.isin(wl.FACT_KINDS), kind).otherwise("fact").alias("kind"),
        clip_head(_text(get(e, "$.text")), 400).alias("text")).filter(F.col("text") != "")
    facts = _first(facts, 20).withColumn("text", redact("text"))  # a text never turns empty, so only those kept need it
    fixes = listed("corrections").select("session_id", "pos", *[
        clip_head(_text(get(e, f"$.{n}")), size).alias(out) for n, size, out in (
            ("trigger", 200, "trigger"), ("wrong", 240, "wrong"), ("correctApproach", 300, "correct_approach"))])
    fixes = _first(fixes.filter((F.col("trigger") != "") & (F.col("wrong") != "") & (F.col("correct_approach") != "")), 3).withColumns(
        {c: redact(c) for c in ("trigger", "wrong", "correct_approach")})
    return {"episodes": episodes, "facts": facts, "corrections": fixes, "cards": _cards(listed("techniques"), stacks), "rejects": rejects}


def _first(df: DataFrame, k: int) -> DataFrame:
    """The first k per session; a reply is one row, so this stays within its own list."""
    return top_per_group(df, ["session_id"], [F.col("pos")], k, salts=1).drop("rank", "pos")


def _cards(listed: DataFrame, stacks: DataFrame | None) -> DataFrame:
    get = lambda p: F.try_variant_get("e", p, "variant")
    sub = lambda b, p: F.try_variant_get(b, p, "variant")
    text = lambda n, size: clip_head(_text(get(f"$.{n}")), size)
    opt = lambda n, size: F.when(text(n, size) != "", text(n, size))
    lst = lambda n, k=12, size=400: _texts(F.try_variant_get("e", f"$.{n}", "array<variant>"), k, size)
    kind, sens = _text(get("$.kind")), _text(get("$.sensitivity"))
    nul = lambda c: F.when(c != "", c)
    api = F.transform(F.coalesce(F.try_variant_get("e", "$.api", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.struct(
        clip_head(_text(sub(a, "$.symbol")), 160).alias("symbol"),
        nul(clip_head(_text(sub(a, "$.signature")), 400)).alias("signature"),
        nul(clip_head(_text(sub(a, "$.notes")), 400)).alias("notes")))
    code = clip_example(clip_head(_text(get("$.example.code")), 480))
    lang, ekind = clip_head(_text(get("$.example.language")), 24), _text(get("$.example.kind"))
    example = F.when(code != "", F.struct(
        F.when(lang != "", lang).otherwise("text").alias("language"),
        F.when(ekind.isin("signature", "config"), ekind).otherwise("usage").alias("kind"), redact(code).alias("code")))
    out = listed.select(
        "session_id", "pos", F.when(kind.isin(wl.CARD_KINDS), kind).otherwise("procedure").alias("kind"),
        redact(text("name", 160)).alias("name"), redact(text("when", 240)).alias("when"), redact(text("summary", 600)).alias("summary"),
        *[redact_all(lst(n)).alias(n) for n in ("steps", "invariants", "pitfalls", "verify")],
        opt("subject", 160).alias("subject"), opt("location", 200).alias("location"), opt("reuse", 400).alias("reuse"),
        opt("appliesTo", 120).alias("applies_to"), opt("gist", 120).alias("gist"),
        F.transform(F.slice(F.filter(api, lambda a: a["symbol"] != ""), 1, 12), lambda a: F.struct(
            redact(a["symbol"]).alias("symbol"), redact(a["signature"]).alias("signature"), redact(a["notes"]).alias("notes"))).alias("api"),
        example.alias("example"), redact(normalize_domain(text("domain", 48))).alias("domain"),
        redact_all(F.transform(lst("tags", 8, 48), F.lower)).alias("tags"),
        F.when(sens.isin("public", "confidential"), sens).otherwise("internal").alias("sensitivity"), F.lit("draft").alias("status"))
    out = _first(out.filter((F.col("name") != "") & (F.col("when") != "") & (F.col("summary") != "")), 5)
    return out if stacks is None else out.join(stacks, "session_id", "left")
