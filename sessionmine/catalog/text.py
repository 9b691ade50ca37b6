"""Text columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors as ef, redaction as rf, text as tf
from ..operators import leak, setjoin
from ..plans import cards as pc, stats
from .common import ERRORS_SQL, documents, error_events, table, tok_sql, words_sql

WS = r"[\s\x{00a0}\x{3000}\x0b]"


def token_profile(spark, sf):
    """Number of search tokens and of distinct ones per document, and the first ten."""
    t = documents(spark, sf).select("id", tf.tokens("text").alias("t"))
    return t.select(F.col("id").alias("doc_id"), F.size("t").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
                    F.array_join(F.slice("t", 1, 10), " ").alias("head"))


TOKEN_PROFILE = f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(t[1:10], ' ') AS head
FROM (SELECT doc_id, {tok_sql('text')} AS t FROM documents)
"""


def norm_keys(spark, sf):
    """Same statement up to case, blanks and punctuation: groups of documents."""
    k = documents(spark, sf).select("id", tf.norm_key("text").alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first_id"))


_PUNCT = ("[，。；、！？：,.;!?:''\"“”‘’()（）\\[\\]【】{}<>《》`~@#$%^&*+=|\\\\/-]+")
NORM_KEY_SQL = f"regexp_replace(regexp_replace(lower(text), '{WS}+', '', 'g'), '{_PUNCT}', '', 'g')"
NORM_KEYS = f"""
SELECT {NORM_KEY_SQL} AS key, count(*) AS docs, min(doc_id) AS first_id FROM documents GROUP BY 1
"""


def redacted(spark, sf):
    """Documents whose text changes when credentials are taken out."""
    d = documents(spark, sf).withColumn("clean", rf.redact("text")).filter(F.col("clean") != F.col("text"))
    return d.select(F.col("id").alias("doc_id"), F.sha1("clean").alias("digest"), F.regexp_count("clean", F.lit(r"\[REDACTED:")).cast("long").alias("marks"))


# The same rules for RE2 (\b is ASCII there).
RULES_SQL = [
    ("private-key", r"-----BEGIN[^\n-]{0,40}PRIVATE KEY-----[\s\S]*?-----END[^\n-]{0,40}PRIVATE KEY-----"),
    ("openai-key", r"\bsk-(?:ant-)?[A-Za-z0-9_-]{16,}\b"), ("github-token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b"),
    ("github-pat", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"), ("aws-key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"), ("google-key", r"\bAIza[A-Za-z0-9_-]{30,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("bearer", r"\bBearer\s+[A-Za-z0-9._~+/-]{20,}={0,2}"),
    ("named-secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|"
                     r"client[_-]?secret|private[_-]?key)\b\s*[:=]\s*[\"'']?[^\s\"'',;]{6,}"),
    ("uri-credentials", r"://[^\s:@/]+:[^\s:@/]{4,}@"),
]


def redact_sql(col: str) -> str:
    for name, p in RULES_SQL:
        col = f"regexp_replace({col}, '{p}', '[REDACTED:{name}]', 'g')"
    return col


REDACTED = f"""
SELECT doc_id, sha1(clean) AS digest, len(regexp_extract_all(clean, '\\[REDACTED:')) AS marks
FROM (SELECT doc_id, text, {redact_sql('text')} AS clean FROM documents) WHERE clean <> text
"""


def redaction_audit(spark, sf):
    """Hits per rule and source."""
    return stats.redaction_audit(table(spark, sf, "documents"), ["source"])


REDACTION_AUDIT = "SELECT source, rule, sum(n)::BIGINT AS hits, count(*) AS docs FROM (" + " UNION ALL ".join(
    f"SELECT source, '{name}' AS rule, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for name, p in RULES_SQL
) + ") WHERE n > 0 GROUP BY source, rule"


def sanitized(spark, sf):
    """Pages as one safe line each, braces made neutral."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.sha1(rf.sanitize("html", neutral_braces=True)).alias("digest"))


SANITIZED = f"""
SELECT page_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(
  html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g'),
  '(?i)[-*+](\\s*\\[\\s*(?:past session|long-term fact|long-term preference|long-term decision|long-term constraint|long-term|recurring failure|technique|episodic|semantic|transient|failure)\\b)', '•\\1', 'g'),
  '{WS}+', ' ', 'g'))) AS digest FROM pages
"""


def sentence_counts(spark, sf):
    """Sentences per message, and the longest one's length."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", tf.sentences("text").alias("s"))
    return c.select("conv_id", "turn", F.size("s").cast("long").alias("n"),
                    F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"),
                    F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


def sentences_sql(col: str) -> str:
    return f"""list_filter(list_transform(string_split_regex(
  regexp_replace({col}, '([.!?;]){WS}+', '\\1' || chr(1), 'g'), '[。！？；\\n\\r]|' || chr(1)),
  lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: length(x) >= 4)"""


SENTENCE_COUNTS = f"""
SELECT conv_id, turn, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest, coalesce(s[1], '') AS first
FROM (SELECT conv_id, turn, {sentences_sql('text')} AS s FROM conversations)
"""


def clips(spark, sf):
    """Head clip, head-and-tail clip, one-line entry, first-sentence gist."""
    d = documents(spark, sf)
    return d.select(F.col("id").alias("doc_id"), F.sha1(tf.clip_head("text", 300)).alias("head"),
                    F.sha1(tf.clip_head_tail("text", 1200)).alias("both"), tf.gist(F.lit(None).cast("string"), "text").alias("gist"))


FLAT = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"


def clip_sql(col: str, n: int) -> str:
    return f"CASE WHEN length({col}) <= {n} THEN {col} ELSE substr({col}, 1, {n - 1}) || '…' END"


CLIPS = f"""
SELECT doc_id, sha1({clip_sql('text', 300)}) AS head,
  sha1(CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 720) || '…' || right(text, 479) END) AS both,
  {clip_sql('g', 90)} AS gist
FROM (SELECT *, CASE WHEN f <> '' THEN trim(f) ELSE flat END AS g FROM (
  SELECT doc_id, text, {FLAT} AS flat, regexp_extract({FLAT}, '^(.*?(?:[。！？；]|\\.(?:[^0-9]|$)))', 1) AS f0,
         CASE WHEN f0 <> '' AND right(f0, 1) NOT IN ('.', '。', '！', '？', '；') THEN substr(f0, 1, length(f0) - 1) ELSE f0 END AS f
  FROM documents))
"""


def error_templates(spark, sf):
    """Templates and fingerprints of the error messages, with counts."""
    e = error_events(spark, sf).withColumn("template", ef.error_template("message"))
    e = e.withColumn("fingerprint", ef.fingerprint("tool", F.lit(None).cast("string"), F.lit(None).cast("string"), "template"))
    return e.groupBy("tool", "template", "fingerprint").agg(F.count(F.lit(1)).alias("n"))


TEMPLATE_STEPS = [
    (r"\b[0-9a-fA-F]{32,}\b", "HASH"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "UUID"), (r"\b0x[0-9a-fA-F]+\b", "ADDR"),
    (r"(?i)(?:/[\w.@-]+)*[\w.@-]+\.(?:ts|tsx|js|jsx|mjs|cjs|json|java|kt|kts|py|go|rs|rb|php|cs|cpp|c|h|md|txt|yml|yaml|toml|xml|gradle|properties|sql)(?::\d+(?::\d+)?)?", "FILE"),
    (r"\b[A-Za-z]:\\(?:[\w .@-]+\\)+[\w .@-]+", "PATH"), (r"(?:/[\w.@-]+){2,}/?", "PATH"), (r"(?i)\bline \d+\b", "line N"),
    (r"\b(?:at|in) \d+:\d+\b", "at N:N"), (r"\b\d{4}-\d{2}-\d{2}[T ][\d:.]+Z?\b", "TIMESTAMP"),
    (r"(?i)\b\d+(?:\.\d+)?\s?(?:ms|us|ns|s|sec|seconds|minutes)\b", "DURATION"),
    (r":(?:6553[0-5]|655[0-2]\d|65[0-4]\d|6[0-4]\d{2}|[1-5]\d{3}|[1-9]\d{2}|[1-9]\d)([^\d.]|$)", ":PORT\\1"),
    (r'"[^"]{0,120}"', "LITERAL"), (r"''[^'']{0,120}''", "LITERAL"), (r"`[^`]{0,120}`", "LITERAL"),
    (r"\b\d+\.\d+(?:\.\d+)*\b", "VER"), (r"\b\d+\b", "N"), (r"\s+", " "),
]


def template_sql(col: str) -> str:
    for p, mark in TEMPLATE_STEPS:
        col = f"regexp_replace({col}, '{p}', '{mark}', 'g')"
    return f"trim({col})"


TEMPLATES_CTE = f"""{ERRORS_SQL},
tpl AS (SELECT *, {template_sql('message')} AS template FROM errs),
obs AS (SELECT *, substr(sha1(tool || '|||' || template), 1, 32) AS fingerprint FROM tpl)"""
ERROR_TEMPLATES = f"WITH {TEMPLATES_CTE} SELECT tool, template, fingerprint, count(*) AS n FROM obs GROUP BY ALL"


def leak_check(spark, sf):
    """Runs of eight words that documents share with the benchmark texts."""
    src = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return leak.shared_runs(documents(spark, sf), src).select(F.col("id").alias("doc_id"), "run")


def grams_sql(frm: str, ident: str) -> str:
    return (f"SELECT DISTINCT {ident} AS id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS run "
            f"FROM (SELECT {ident}, {words_sql('text')} AS w FROM {frm}) WHERE len(w) >= 8")


LEAK_CHECK = f"""
SELECT id AS doc_id, run FROM ({grams_sql('documents', 'doc_id')})
WHERE run IN (SELECT run FROM ({grams_sql('benchmark', 'item_id')}))
"""


def decontaminated(spark, sf):
    """Documents kept and dropped per language."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    src = table(spark, sf, "benchmark").select("text")
    bad = leak.shared_runs(d, src).select("id").distinct().withColumn("bad", F.lit(1))
    return d.select("id", "lang").join(bad, "id", "left").groupBy("lang").agg(
        F.count("bad").alias("dropped"), F.count_if(F.col("bad").isNull()).alias("kept"))


DECONTAMINATED = f"""
WITH bad AS (SELECT DISTINCT id FROM ({grams_sql('documents', 'doc_id')}) WHERE run IN (SELECT run FROM ({grams_sql('benchmark', 'item_id')})))
SELECT lang, count(bad.id) AS dropped, count(*) - count(bad.id) AS kept
FROM documents LEFT JOIN bad ON doc_id = bad.id GROUP BY lang
"""


def containment(spark, sf):
    """Benchmark texts and the document that contains most of their words (at least half)."""
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    r = setjoin.max_containment(a, documents(spark, sf), 0.5)
    return r.select(F.col("id").alias("item_id"), F.round("max_ratio", 6).alias("max_ratio"), F.col("best_id").alias("best_doc"))


CONTAINMENT = f"""
WITH a AS (SELECT DISTINCT item_id, unnest({tok_sql('text')}) AS tok FROM benchmark),
b AS (SELECT DISTINCT doc_id, unnest({tok_sql('text')}) AS tok FROM documents),
n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
p AS (SELECT item_id, doc_id, count(*) AS c FROM a JOIN b USING (tok) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, c / n AS ratio FROM p JOIN n USING (item_id) WHERE c / n >= 0.5),
m AS (SELECT item_id, max(ratio) AS max_ratio FROM r GROUP BY 1)
SELECT item_id, round(max_ratio, 6) AS max_ratio, (SELECT min(doc_id) FROM r WHERE r.item_id = q.item_id AND r.ratio = m.max_ratio) AS best_doc
FROM benchmark q LEFT JOIN m USING (item_id)
"""


def restatements(spark, sf):
    """Messages whose words are mostly inside one document (threshold 0.6)."""
    c = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    r = setjoin.max_containment(c, documents(spark, sf), 0.6).filter(F.col("max_ratio").isNotNull())
    return r.select(F.col("id").alias("message_id"), F.round("max_ratio", 6).alias("max_ratio"), F.col("best_id").alias("best_doc"))


RESTATEMENTS = f"""
WITH a AS (SELECT DISTINCT conv_id * 1000 + turn AS id, unnest({tok_sql('text')}) AS tok FROM conversations),
b AS (SELECT DISTINCT doc_id, unnest({tok_sql('text')}) AS tok FROM documents),
n AS (SELECT id, count(*) AS n FROM a GROUP BY 1),
p AS (SELECT id, doc_id, count(*) AS c FROM a JOIN b USING (tok) GROUP BY 1, 2),
r AS (SELECT id, doc_id, c / n AS ratio FROM p JOIN n USING (id) WHERE c / n >= 0.6),
m AS (SELECT id, max(ratio) AS max_ratio FROM r GROUP BY 1)
SELECT id AS message_id, round(max_ratio, 6) AS max_ratio, min(doc_id) AS best_doc
FROM r JOIN m USING (id) WHERE r.ratio = m.max_ratio GROUP BY 1, 2
"""


def read_restatements(spark, sf):
    """Messages that repeat the library (0.6) or a document their session has read (0.3)."""
    c = table(spark, sf, "conversations")
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "text")
    read = c.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(READ - 1))).alias("i")).distinct().select(
        "session_id", (F.col("session_id") * READ + F.col("i")).alias("id"))
    _, dropped = pc.drop_restatements(c, documents(spark, sf), read, 0.6, 0.3)
    return dropped.select(F.col("id").alias("message_id"), "restates")


READ = 20  # documents a session reads
READ_RESTATEMENTS = f"""
WITH a AS (SELECT DISTINCT conv_id, conv_id * 1000 + turn AS id, unnest({tok_sql('text')}) AS tok FROM conversations),
b AS (SELECT DISTINCT doc_id, unnest({tok_sql('text')}) AS tok FROM documents),
n AS (SELECT id, count(*) AS n FROM a GROUP BY 1),
p AS (SELECT conv_id, id, doc_id, count(*) AS c FROM a JOIN b USING (tok) GROUP BY 1, 2, 3),
r AS (SELECT id, c / n >= 0.6 AS lib, c / n >= 0.3 AND doc_id // {READ} = conv_id AS seen FROM p JOIN n USING (id))
SELECT id AS message_id, CASE WHEN bool_or(seen) THEN 'session' ELSE 'library' END AS restates FROM r WHERE lib OR seen GROUP BY 1
"""


def novelty(spark, sf):
    """Share of a message's words that no document has."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    r = setjoin.novelty(c, documents(spark, sf))
    return r.select(F.col("id").alias("message_id"), F.col("n_tokens"), F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"),
                    F.round("novelty", 6).alias("novelty"))


NOVELTY = f"""
WITH v AS (SELECT DISTINCT unnest({tok_sql('text')}) AS tok FROM documents),
m AS (SELECT conv_id * 1000 + turn AS id, list_distinct({tok_sql('text')}) AS t FROM conversations),
x AS (SELECT id, unnest(t) AS tok FROM m),
g AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE tok NOT IN (SELECT tok FROM v)) AS nn FROM x GROUP BY id)
SELECT m.id AS message_id, coalesce(n, 0) AS n_tokens, coalesce(nn, 0) AS n_new, round(CASE WHEN n > 0 THEN nn / n ELSE 0 END, 6) AS novelty
FROM m LEFT JOIN g ON m.id = g.id
"""


def deidentified(spark, sf):
    """Messages with all their long capitalised words taken out by numbered placeholders."""
    c = table(spark, sf, "conversations")
    ids = F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9_])([A-Z][a-z]{5,})(?![A-Za-z0-9_])"), F.lit(1))
    return c.select("conv_id", "turn", F.sha1(rf.deidentify("text", ids)).alias("digest"))


DEIDENTIFIED = f"""
WITH v AS (SELECT conv_id, turn, text, list_filter(list_distinct(regexp_extract_all(text, '\\b([A-Z][a-z]{{5,}})\\b', 1)),
  lambda x: x NOT IN ('Number','String','Boolean','Object','Promise','Exception','Result','Options','Config','Request','Response','Client','Server')) AS ids FROM conversations),
o AS (SELECT *, list_sort(list_transform(ids, lambda x: {{'at': instr(text, x), 'neg': -length(x), 'v': x}})) AS s FROM v),
m AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: s[i].v || '|<Class' || i || '>') AS marks FROM o)
SELECT conv_id, turn, sha1(regexp_replace(list_reduce(list_prepend({redact_sql('text')}, marks), lambda acc, p: replace(acc, split_part(p, '|', 1), split_part(p, '|', 2))),
  '(^|[\\s"''(=])/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+', '\\1[PATH]', 'g')) AS digest FROM m
"""

QUERIES = {
    "token_profile": (token_profile, TOKEN_PROFILE), "norm_keys": (norm_keys, NORM_KEYS), "redacted": (redacted, REDACTED),
    "redaction_audit": (redaction_audit, REDACTION_AUDIT), "sanitized": (sanitized, SANITIZED),
    "sentence_counts": (sentence_counts, SENTENCE_COUNTS), "clips": (clips, CLIPS), "error_templates": (error_templates, ERROR_TEMPLATES),
    "leak_check": (leak_check, LEAK_CHECK), "decontaminated": (decontaminated, DECONTAMINATED),
    "containment": (containment, CONTAINMENT), "restatements": (restatements, RESTATEMENTS), "read_restatements": (read_restatements, READ_RESTATEMENTS), "novelty": (novelty, NOVELTY),
    "deidentified": (deidentified, DEIDENTIFIED),
}
