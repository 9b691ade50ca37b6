"""Adapters from the test tables to the library's inputs, and shared SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import wordlists as wl
from ..operators.sizes import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The files hold times without a zone; days are counted in UTC, as the SQL twins do.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return spread(df, df.columns[0])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as searchable cards; labels give status and outcome counts."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = (F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 1, "validated").otherwise("draft"))
    return d.select(
        F.lit("technique").alias("layer"), F.col("doc_id").alias("id"), "text", status.alias("status"),
        F.col("source").alias("partition"), F.col("lang").alias("domain"), F.array("source").alias("tags"),
        F.array("lang").alias("langs"),
        F.coalesce("quality", F.lit(0)).cast("long").alias("successes"),
        F.coalesce("toxic", F.lit(0)).cast("long").alias("failures"),
        F.coalesce("quality", F.lit(0)).alias("evidence_count"),
        (F.col("doc_id") % 7).alias("referenced"), F.lit(False).alias("archived"))


def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows of `events` with a message made of their values."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ERROR_KINDS]), (k % 5 + 1).cast("int"))
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("session_id"),
                    F.concat(F.lit("tool"), (k % 3).cast("string")).alias("tool"),
                    kind.alias("message_kind"),
                    F.concat(kind, F.lit(" at line "), k.cast("string"), F.lit(" after "),
                             F.col("value").cast("decimal(10,2)").cast("string"), F.lit(" s")).alias("message"))


ERROR_KINDS = [
    "Cannot find module 'aaa'", "Timeout on port :3000", "Bad version 1.20.1",
    "Read /usr/lib/x/y.json failed", "Hash 0123456789abcdef0123456789abcdef differs",
]

_KINDS_SQL = "[" + ", ".join("'" + k.replace("'", "''") + "'" for k in ERROR_KINDS) + "]"
ERRORS_SQL = f"""errs AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id, 'tool' || CAST(k % 3 AS VARCHAR) AS tool,
         ({_KINDS_SQL})[k % 5 + 1] || ' at line ' || k || ' after ' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || ' s' AS message
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'))"""


def sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP_SQL = sql_list([w for w in wl.STOP_WORDS if w.isascii()])
GATE_STOP_SQL = sql_list([w for w in wl.GATE_STOP_WORDS if w.isascii()])
DIGITS_SQL = sql_list([str(i) for i in range(10)])


def tok_sql(col: str) -> str:
    """Tokens of a text without CJK characters (the test tables have none)."""
    return (f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9_]+'), "
            f"lambda x: (length(x) >= 2 AND x NOT IN ({STOP_SQL})) OR x IN ({DIGITS_SQL}))")


def words_sql(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '[a-z0-9_]+')"


def bm25_ctes(docs_cte: str = "SELECT doc_id AS id, text FROM documents",
              queries_cte: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    """CTEs d, q, dt(id, toks, len), tf(id, term, tf, len), qt(query_id, term), stats, scored."""
    return f"""
d AS ({docs_cte}), q AS ({queries_cte}),
dt AS (SELECT id, {tok_sql('text')} AS toks FROM d),
tf AS (SELECT id, term, count(*) AS tf, any_value(len) AS len
       FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM dt) GROUP BY id, term),
qt AS (SELECT DISTINCT query_id, unnest({tok_sql('text')}) AS term FROM q),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgl FROM dt),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT qt.query_id, tf.id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.len / avgl))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN dfs USING (term), tot GROUP BY qt.query_id, tf.id)"""
