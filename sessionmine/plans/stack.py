"""Stack detection from build manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import wordlists as wl

# What a manifest in the root of a repository says
# (path, language, build tool, priority of the build tool).
MANIFESTS = [
    ("build.gradle.kts", "kotlin", "gradle", 1), ("build.gradle.kts", "java", "gradle", 1),
    ("build.gradle", "java", "gradle", 1), ("pom.xml", "java", "maven", 2), ("go.mod", "go", "go", 3),
    ("Cargo.toml", "rust", "cargo", 4), ("pyproject.toml", "python", "pip", 5), ("requirements.txt", "python", "pip", 5),
]
LANGUAGE_ORDER = ["javascript", "typescript", "kotlin", "java", "go", "rust", "python"]

FACTS = "repo STRING, source INT, languages ARRAY<STRING>, frameworks MAP<STRING,STRING>, build_tool STRING, priority INT"


def node_facts(manifests: DataFrame) -> DataFrame:
    """package.json (valid JSON) and tsconfig.json."""
    pkg = "STRUCT<" + ", ".join(f"{f}: MAP<STRING,STRING>" for f in ("dependencies", "devDependencies", "peerDependencies")) + ">"
    p = manifests.filter((F.col("path") == "package.json") & F.try_parse_json("content").isNotNull())
    p = p.select("repo", F.from_json("content", pkg).alias("p"))
    known = lambda c: F.map_filter(F.coalesce(c, F.create_map().cast("map<string,string>")),
                                   lambda k, v: k.isin(wl.KNOWN_FRAMEWORKS) & v.isNotNull())
    # The first of the three lists that names a package gives its version.
    deps, dev, peer = (known(F.col("p")[f]) for f in ("dependencies", "devDependencies", "peerDependencies"))
    dev = F.map_filter(dev, lambda k, v: ~F.map_contains_key(deps, k))
    peer = F.map_filter(peer, lambda k, v: ~F.map_contains_key(deps, k) & ~F.map_contains_key(dev, k))
    ts = manifests.filter(F.col("path") == "tsconfig.json").select("repo", F.lit(True).alias("ts")).distinct()
    return p.join(ts, "repo", "left").select(
        "repo", F.lit(1).alias("source"),
        F.when(F.coalesce("ts", F.lit(False)), F.array(F.lit("javascript"), F.lit("typescript"))).otherwise(
            F.array(F.lit("javascript"))).alias("languages"),
        F.map_concat(deps, dev, peer).alias("frameworks"), F.lit("npm").alias("build_tool"), F.lit(0).alias("priority"))


def generic_facts(manifests: DataFrame) -> DataFrame:
    """Languages and build tools by manifest name."""
    table = manifests.sparkSession.createDataFrame(MANIFESTS, "path STRING, language STRING, build_tool STRING, priority INT")
    return manifests.join(F.broadcast(table), "path").select(
        "repo", F.lit(2).alias("source"), F.array("language").alias("languages"),
        F.create_map().cast("map<string,string>").alias("frameworks"), "build_tool", "priority")


DETECTORS: list[Callable[[DataFrame], DataFrame]] = [node_facts, generic_facts]


def detect_stack(manifests: DataFrame, detectors: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """`repo, stack` from `manifests(repo, path, content)`; detectors may be added."""
    detectors = DETECTORS if detectors is None else detectors
    facts = detectors[0](manifests)
    for d in detectors[1:]:
        facts = facts.unionByName(d(manifests))
    order = F.create_map(*[F.lit(x) for i, l in enumerate(LANGUAGE_ORDER) for x in (l, i)])
    langs = (facts.select("repo", "source", F.explode("languages").alias("l")).groupBy("repo", "l")
             .agg(F.min(F.struct("source", F.coalesce(F.element_at(order, F.col("l")), F.lit(99)))).alias("o")))
    langs = langs.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda s: s["l"]).alias("languages"))
    fw = facts.select("repo", F.explode("frameworks").alias("k", "v")).groupBy("repo", "k").agg(F.min("v").alias("v"))
    fw = fw.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fv"))
    tool = facts.groupBy("repo").agg(F.min_by("build_tool", "priority").alias("tool"))
    none = lambda t: F.lit(None).cast(t)
    return langs.join(tool, "repo").join(fw, "repo", "left").select("repo", F.struct(
        none("string").alias("ecosystem"), "languages", F.map_keys("fv").alias("frameworks"), F.col("fv").alias("framework_versions"),
        none("map<string,string>").alias("version_constraints"), none("map<string,string>").alias("versions"),
        none("array<struct<name:string,version:string>>").alias("sdks"), F.col("tool").alias("build_tool")).alias("stack"))
