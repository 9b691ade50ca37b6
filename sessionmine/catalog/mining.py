"""Source mining over code-like text that Spark derives from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import language_of, role_of
from ..functions.wordlists import END, START
from ..operators.leak import leak_check
from ..plans import mining as m, stack as st
from ..sources import files as sf_
from .common import table, words_sql

DIRS = ["src/service", "src/client", "test", "lib/domain", "config", "src/util"]
EXTS = ["ts", "java", "py", "json", "md", "kt"]


def source_files(spark, sf):
    """Documents as files: neighbouring long words become calls with none or two arguments."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % k + 1).cast("int"))
    code = F.regexp_replace("text", START + "([a-z]{4})[a-z]* ([a-z]{3})[a-z]*" + END, "$1.$2($1, f(x, y))\n")
    code = F.regexp_replace(code, START + "([A-Z][a-z]{2})[a-z]* ([a-z]{2,3})" + END, "$1.$2()\nif ($1) return null\n")
    return d.select(F.col("source").alias("repo"), F.concat(pick(DIRS, 6), F.lit("/F"), n.cast("string"), F.lit("."), pick(EXTS, 6)).alias("path"),
                    F.col("n_chars").alias("length"), code.alias("content"))


SRC = f"""src AS (SELECT source AS repo, doc_id, {DIRS!r}[doc_id % 6 + 1] || '/F' || doc_id || '.' || {EXTS!r}[doc_id % 6 + 1] AS path, n_chars,
  regexp_replace(regexp_replace(text, '\\b([a-z]{{4}})[a-z]* ([a-z]{{3}})[a-z]*\\b', '\\1.\\2(\\1, f(x, y))' || chr(10), 'g'),
  '\\b([A-Z][a-z]{{2}})[a-z]* ([a-z]{{2,3}})\\b', '\\1.\\2()' || chr(10) || 'if (\\1) return null' || chr(10), 'g') AS content FROM documents)"""


def call_sites(spark, sf):
    """Calls per repository, symbol and number of arguments."""
    s = m.call_sites(source_files(spark, sf))
    return s.groupBy("repo", "symbol", F.col("arity").cast("long").alias("arity")).agg(F.count(F.lit(1)).alias("n"))


SITES = SRC + """,
cs AS (SELECT repo, doc_id, path, unnest(regexp_extract_all(content, '\\b([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+)\\s*\\(', 1)) AS symbol,
  unnest(list_transform(regexp_extract_all(content, '\\b[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+\\s*\\((.)', 1), lambda c: CASE WHEN c = ')' THEN 0 ELSE 2 END)) AS arity FROM src)"""
CALL_SITES = f"WITH {SITES} SELECT repo, symbol, arity, count(*) AS n FROM cs GROUP BY ALL"


def symbol_clusters(spark, sf):
    """The five most called symbols of each repository."""
    f = m.with_roles(source_files(spark, sf))
    c = m.cluster_symbols(m.sites_with_roles(f), 2, 5)
    return c.select("repo", "symbol", "occurrences", "n_files", F.array_join("roles", ",").alias("roles"),
                    F.array_join(F.transform("arities", lambda a: a.cast("string")), ",").alias("arities"), "rank")


ROLE_SQL = """CASE WHEN regexp_matches(lower(path), '(^|/)test/') THEN 'test' WHEN ends_with(path, '.json') OR ends_with(path, '.kts') THEN 'build-config'
  WHEN regexp_matches(path, '(^|/)client/') THEN 'api-client' WHEN regexp_matches(path, '(^|/)service/') THEN 'service-layer'
  WHEN regexp_matches(path, '(^|/)domain/') THEN 'domain-model' WHEN regexp_matches(path, '(^|/)config/') THEN 'config' ELSE 'other' END"""
CLUSTERS = f"""WITH {SITES}, g AS (SELECT repo, symbol, count(*) AS occurrences, count(DISTINCT path) AS n_files, array_to_string(list_sort(list(DISTINCT {ROLE_SQL})), ',') AS roles,
  array_to_string(list_sort(list(DISTINCT arity)), ',') AS arities FROM cs GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, symbol) AS rank FROM g) SELECT * FROM r WHERE rank <= 5"""


def code_roles(spark, sf):
    """Files per role and language."""
    f = source_files(spark, sf)
    return f.groupBy(role_of("path").alias("role"), language_of("path").alias("language")).agg(F.count(F.lit(1)).alias("files"))


CODE_ROLES = f"""WITH {SRC} SELECT {ROLE_SQL} AS role, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'py' THEN 'python'
  WHEN 'json' THEN 'json' WHEN 'kt' THEN 'kotlin' ELSE 'text' END AS language, count(*) AS files FROM src GROUP BY 1, 2"""


def guard_lines(spark, sf):
    """Guard lines per repository."""
    return m.guards(source_files(spark, sf)).groupBy("repo").agg(F.count(F.lit(1)).alias("guards"), F.count_distinct("line").alias("kinds"))


GUARD_LINES = f"""WITH {SRC}, l AS (SELECT repo, trim(unnest(string_split(content, chr(10)))) AS line FROM src)
SELECT repo, count(*) AS guards, count(DISTINCT line) AS kinds FROM l WHERE length(line) BETWEEN 1 AND 200
AND regexp_matches(line, '\\b(?:if|unless|when|guard)\\b[^\\n]{{0,160}}?\\b(?:throw|raise|reject|return\\s+(?:null|false|undefined|new\\s+Error|-1))\\b') GROUP BY 1"""

RULES = sf_.ignore_rules(["# generated", "test/", "!test/F8.py", "*.kt", "/config", "lib/**/F1*"])


def scanned_files(spark, sf):
    """Files that the ignore rules and the size limit leave, and those too large."""
    small, large = sf_.select_files(source_files(spark, sf), RULES, max_bytes=4000, max_files=None)
    return small.groupBy("repo").agg(F.count(F.lit(1)).alias("files")).join(
        large.join(source_files(spark, sf).select("path", "repo"), "path").groupBy("repo").agg(F.count(F.lit(1)).alias("large")), "repo", "full").select(
        "repo", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("large", F.lit(0)).alias("large"))


SCANNED = f"""WITH {SRC}, k AS (SELECT * FROM src WHERE NOT starts_with(path, 'test/') AND NOT ends_with(path, '.kt') AND NOT starts_with(path, 'config/')
  AND NOT regexp_matches(path, '(?:^|.*/)lib/.*/F1[^/]*$') AND regexp_extract(path, '\\.([a-z]+)$', 1) IN ('ts', 'java', 'py', 'json'))
SELECT repo, count(*) FILTER (WHERE n_chars <= 4000) AS files, count(*) FILTER (WHERE n_chars > 4000) AS large FROM k GROUP BY 1"""


def changed_files(spark, sf):
    """Files that a cache of every third document's content does not cover."""
    f = source_files(spark, sf)
    n = F.regexp_extract("path", r"F(\d+)", 1).cast("long")
    cache = f.filter(n % 3 == 0).select("repo", "path", m.content_hash().alias("hash"), F.lit(m.PROMPT_VERSION).alias("prompt_version"),
                                        F.when(n % 2 == 0, "").otherwise("other").alias("model"))
    return m.changed_files(f, cache).groupBy("repo").agg(F.count(F.lit(1)).alias("files"))


CHANGED = "SELECT source AS repo, count(*) AS files FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0) GROUP BY 1"


def mined_cards(spark, sf):
    """Rule cards of every repository after de-identification and the leak check."""
    out = m.mine_code(source_files(spark, sf), k=5)
    return out["cards"].select("repo", "symbol", "name", F.sha1("summary").alias("summary"), F.array_join("tags", ",").alias("tags"))


MINED = f"""WITH {SITES}, g AS (SELECT repo, symbol, count(*) AS n, count(DISTINCT path) AS nf, list_filter(list_sort(list(DISTINCT {ROLE_SQL})), lambda x: x <> 'test') AS rl,
  array_to_string(list_sort(list(DISTINCT arity)), '/') AS ar FROM cs GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, symbol) AS rank, CASE WHEN len(rl) > 0 THEN array_to_string(rl, '/') ELSE 'other' END AS role FROM g)
SELECT repo, symbol, 'How this repository calls ' || symbol AS name, sha1(symbol || ': ' || n || ' calls in ' || nf || ' files (' || role || '), number of arguments ' || ar ||
  '. Counted from the source text; read the code for order and preconditions.') AS summary, array_to_string(([lower(split_part(symbol, '.', 1))] || rl)[1:6], ',') AS tags FROM r WHERE rank <= 5"""


def excerpts(spark, sf):
    """Lines around the first uses of the most called symbols."""
    out = m.mine_code(source_files(spark, sf), k=3)
    return out["observations"].join(out["excerpts"], ["repo", "symbol"]).select(
        "repo", "symbol", "occurrences", "worth_modeling", F.length("excerpt").cast("long").alias("chars"), F.sha1("excerpt").alias("digest"))


EXCERPTS = f"""WITH {SITES}, g AS (SELECT repo, symbol, count(*) AS occurrences FROM cs GROUP BY 1, 2 HAVING count(*) >= 2),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, symbol) AS rk FROM g) WHERE rk <= 3),
f AS (SELECT repo, path, {ROLE_SQL} AS role, string_split(content, chr(10)) AS ls FROM src),
l AS (SELECT repo, path, role, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM f),
h AS (SELECT c.repo, c.symbol, occurrences, path, role, greatest(0, no - 2) AS a, least(n_lines, no + 3) - greatest(0, no - 2) + 1 AS size,
  row_number() OVER (PARTITION BY c.repo, c.symbol ORDER BY path, no) AS n FROM l JOIN c ON l.repo = c.repo AND contains(line, symbol || '(')),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY repo, symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM h),
e AS (SELECT s.repo, symbol, any_value(occurrences) AS occurrences,
  substr(string_agg('// ' || s.role || chr(10) || array_to_string(ls[a + 1:a + size - 1], chr(10)), chr(10) ORDER BY n), 1, 4000) AS excerpt
  FROM s JOIN f USING (repo, path) WHERE spent < 40 GROUP BY 1, 2)
SELECT repo, symbol, occurrences, occurrences >= 2 AND len({words_sql('excerpt')}) >= 25 AS worth_modeling, length(excerpt) AS chars, sha1(excerpt) AS digest FROM e"""


def paired_leaks(spark, sf):
    """Answers that quote the question before them for eight words or more."""
    c = table(spark, sf, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string"))
    q = c.filter(F.col("role") != "assistant").select(key.alias("source_id"), "text")
    a = c.filter(F.col("role") == "assistant").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), key.alias("source_id"), "text")
    return leak_check(a, q, paired=True).select("id", F.size("verbatim_runs").cast("long").alias("runs"), "clean")


PAIRED = """
WITH w AS (SELECT role, conv_id * 100 + turn AS id, conv_id || ':' || (turn // 2) AS k, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM conversations),
g AS (SELECT DISTINCT role = 'assistant' AS a, CASE WHEN role = 'assistant' THEN id END AS id, k, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS run FROM w WHERE len(w) >= 8),
h AS (SELECT x.id, count(DISTINCT x.run) AS n FROM g x JOIN g y ON x.a AND NOT y.a AND x.k = y.k AND x.run = y.run GROUP BY 1)
SELECT w.id, coalesce(n, 0) AS runs, coalesce(n, 0) = 0 AS clean FROM w LEFT JOIN h USING (id) WHERE role = 'assistant'
"""

_MANIFESTS = ["package.json", "tsconfig.json", "pom.xml", "go.mod", "Cargo.toml", "requirements.txt", "build.gradle.kts", "README.md"]


def stacks(spark, sf):
    """Stacks of repositories whose manifests come from the pages table."""
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    name = F.element_at(F.array(*[F.lit(x) for x in _MANIFESTS]), (n % 8 + 1).cast("int"))
    dep = F.element_at(F.array(F.lit("react"), F.lit("left-pad"), F.lit("vue")), (n % 3 + 1).cast("int"))
    content = F.when(n % 8 == 0, F.concat(F.lit('{"dependencies": {"'), dep, F.lit('": "^1.'), (n % 9).cast("string"), F.lit('"}}'))).otherwise(F.col("html"))
    s = st.detect_stack(p.select((n % 11).cast("string").alias("repo"), name.alias("path"), content.alias("content")))
    return s.select("repo", F.array_join("stack.languages", ",").alias("languages"), "stack.build_tool",
                    F.coalesce(F.array_join(F.array_sort("stack.frameworks"), ","), F.lit("")).alias("frameworks"))


STACKS = """
WITH p AS (SELECT page_id AS n, page_id % 11 AS r, page_id % 8 AS k FROM pages),
j AS (SELECT r, bool_or(k = 0) AS js, bool_or(k = 0) AND bool_or(k = 1) AS ts, bool_or(k = 6) AS kt, bool_or(k IN (2, 6)) AS ja, bool_or(k = 3) AS go, bool_or(k = 4) AS ru, bool_or(k = 5) AS py,
  bool_or(k = 2) AS mv, bool_or(k = 0 AND n % 3 = 0) AS fr, bool_or(k = 0 AND n % 3 = 2) AS fv FROM p GROUP BY r)
SELECT CAST(r AS VARCHAR) AS repo, concat_ws(',', CASE WHEN js THEN 'javascript' END, CASE WHEN ts THEN 'typescript' END, CASE WHEN kt THEN 'kotlin' END, CASE WHEN ja THEN 'java' END,
  CASE WHEN go THEN 'go' END, CASE WHEN ru THEN 'rust' END, CASE WHEN py THEN 'python' END) AS languages,
  CASE WHEN js THEN 'npm' WHEN kt THEN 'gradle' WHEN mv THEN 'maven' WHEN go THEN 'go' WHEN ru THEN 'cargo' ELSE 'pip' END AS build_tool,
  concat_ws(',', CASE WHEN fr THEN 'react' END, CASE WHEN fv THEN 'vue' END) AS frameworks FROM j WHERE js OR kt OR ja OR go OR ru OR py
"""

QUERIES = {
    "call_sites": (call_sites, CALL_SITES), "symbol_clusters": (symbol_clusters, CLUSTERS), "code_roles": (code_roles, CODE_ROLES),
    "guard_lines": (guard_lines, GUARD_LINES), "scanned_files": (scanned_files, SCANNED), "changed_files": (changed_files, CHANGED),
    "mined_cards": (mined_cards, MINED), "excerpts": (excerpts, EXCERPTS), "paired_leaks": (paired_leaks, PAIRED), "stacks": (stacks, STACKS),
}
