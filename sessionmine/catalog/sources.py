"""Queries that write layers and files to the shared folder and read them back."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..sources import files, layers, replies
from .common import table

RECORD = "id LONG, lang STRING, text STRING"
KEY = bytes(range(32))


def _records(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")


def _digests(df):
    return df.select("id", F.sha1(F.coalesce("text", F.lit(""))).alias("digest"))


def layer_lines(spark, sf):
    """A layer of JSON lines in which every fifth line is cut off: records and bad lines."""
    path = shared_folder(spark)
    whole = F.to_json(F.struct("id", "lang", "text"))
    line = F.when(F.col("id") % 5 == 0, F.concat(F.lit('{"id": '), F.col("id").cast("string"))).otherwise(whole)
    _records(spark, sf).select(line.alias("value")).write.text(path)
    good, bad = layers.read_layer(spark, path, RECORD)
    return _digests(good).unionByName(bad.select(F.lit(None).cast("long").alias("id"), F.sha1("line").alias("digest")))


LAYER_LINES = """SELECT CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS id,
  CASE WHEN doc_id % 5 <> 0 THEN sha1(coalesce(text, '')) ELSE sha1('{"id": ' || doc_id) END AS digest FROM documents"""


def encrypted_layer(spark, sf):
    """Encrypted lines in folders by language, every fourth record added as a plain line; read
    with the key, and without it (only plain lines are left)."""
    path = shared_folder(spark)
    d = _records(spark, sf)
    layers.write_layer(d.filter("id % 4 <> 0"), path, ["lang"], key=KEY)
    d.filter("id % 4 = 0").select(F.to_json(F.struct("id", "lang", "text")).alias("value"), F.col("lang").alias("part_lang")).write.mode(
        "append").partitionBy("part_lang").text(path)
    mine, _ = layers.read_layer(spark, path, RECORD, key=KEY)
    theirs, lost = layers.read_layer(spark, path, RECORD, key=bytes(32))
    sides = _digests(mine).withColumn("side", F.lit("key")).unionByName(_digests(theirs).withColumn("side", F.lit("wrong key")))
    return sides.unionByName(lost.agg(F.count(F.lit(1)).alias("id")).select("id", F.lit("").alias("digest"), F.lit("lost lines").alias("side")))


ENCRYPTED_LAYER = """WITH r AS (SELECT doc_id AS id, sha1(coalesce(text, '')) AS digest FROM documents)
SELECT *, 'key' AS side FROM r UNION ALL SELECT *, 'wrong key' FROM r WHERE id % 4 = 0
UNION ALL SELECT count(*), '', 'lost lines' FROM r WHERE id % 4 <> 0"""


def project_layer(spark, sf):
    """Project `en` and the shared partition of a layer by scope; the project's copy of an id wins."""
    path = shared_folder(spark)
    n = F.col("doc_id") % 3
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 3).alias("id"), "text", F.when(n == 1, "project").otherwise("global").alias("scope"),
        F.when(n == 0, "default").when(n == 1, F.coalesce("lang", F.lit("none"))).otherwise("other").alias("partition_key"))
    layers.write_layer(d, path, ["scope", "partition_key"])
    layers.write_layer(d.filter("partition_key = 'other'"), path, ["scope", "partition_key"])  # replaces this one only
    return _digests_with_scope(layers.read_scopes(spark, path, "en"))


def _digests_with_scope(df):
    return df.select("id", "read_from", F.sha1(F.coalesce("text", F.lit(""))).alias("digest"))


PROJECT_LAYER = """WITH r AS (SELECT doc_id // 3 AS id, CASE WHEN doc_id % 3 = 1 THEN 'project' ELSE 'global' END AS read_from,
  sha1(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND lang = 'en'))
SELECT id, arg_max(read_from, read_from) AS read_from, arg_max(digest, read_from) AS digest FROM r GROUP BY id"""


def appended_counters(spark, sf):
    """Outcome events appended in three batches; counters are their aggregation."""
    path = shared_folder(spark)
    e = table(spark, sf, "events").select(F.col("user_id"), "event_type", "event_id")
    for i in range(3):
        layers.append_events(e.filter(F.col("event_id") % 3 == i), path)
    return spark.read.schema(e.schema).parquet(path).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


COUNTERS = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"

_DIRS = ["src", ".github/workflows", ".hidden", "_gen/a", "node_modules/x", "drop/z", "docs", "src/_internal/deep"]
_NAMES = [("f", ".ts"), ("_f", ".py"), (".f", ".yml"), ("f", ".md")]
IGNORE = "drop/\ndocs/*1.ts\n!docs/*11.ts\n"
MAX_BYTES = 2000


def scanned_tree(spark, sf):
    """All pages written as source files, listed level by level under ignore rules, the
    eligible ones read; `digest` is NULL for those over the size limit."""
    root = shared_folder(spark)
    n = F.col("page_id")
    name = F.element_at(F.array(*[F.concat(F.lit(a), n.cast("string"), F.lit(b)) for a, b in _NAMES]), (F.floor(n / 8) % 4 + 1).cast("int"))
    where = F.element_at(F.array(*[F.lit(d) for d in _DIRS]), (n % 8 + 1).cast("int"))
    planned = table(spark, sf, "pages").select(F.concat_ws("/", where, name).alias("path"), F.coalesce("html", F.lit("")).alias("content"))

    def plant(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                fs.create_dir(f"{base}/{row['path']}".rsplit("/", 1)[0])
                with fs.open_output_stream(f"{base}/{row['path']}") as out:
                    out.write(row["content"].encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rules = spark.createDataFrame([(".gitignore", IGNORE)], planned.schema)
    planned.unionByName(rules).mapInArrow(plant, "n long").agg(F.sum("n")).collect()
    small, large = files.scan_files(spark, root, max_bytes=MAX_BYTES)
    return small.select("path", "length", F.sha1("content").alias("digest")).unionByName(
        large.select("path", "length", F.lit(None).cast("string").alias("digest")))


_DIR_SQL = "[" + ", ".join(f"'{d}'" for d in _DIRS) + "]"
_NAME_SQL = "[" + ", ".join(f"'{a}' || page_id || '{b}'" for a, b in _NAMES) + "]"
SCANNED_TREE = f"""WITH f AS (SELECT {_DIR_SQL}[page_id % 8 + 1] AS dir, {_NAME_SQL}[(page_id // 8) % 4 + 1] AS name, coalesce(html, '') AS html FROM pages)
SELECT dir || '/' || name AS path, octet_length(encode(html)) AS length, CASE WHEN octet_length(encode(html)) <= {MAX_BYTES} THEN sha1(html) END AS digest
FROM f WHERE dir NOT IN ('.hidden', 'node_modules/x', 'drop/z') AND (ends_with(name, '.ts') OR ends_with(name, '.py'))
  AND NOT (dir = 'docs' AND ends_with(name, '1.ts') AND NOT ends_with(name, '11.ts'))"""


def model_replies(spark, sf):
    """Replies with a fact per line of each document; some without an object, some broken."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(F.lit("rule").alias("kind"), x.alias("text")))
    reply = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), lines.alias("facts"))), F.lit("\nDone."))
    n = F.col("doc_id") % 7
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.when(n == 0, "nothing to say").when(
        n == 1, F.concat(F.lit("{broken "), F.regexp_replace(F.coalesce("text", F.lit("")), "[{}]", ""), F.lit("}"))).otherwise(reply).alias("text"))
    got = replies.ingest_model_output(d)
    facts = got["facts"].groupBy("session_id").agg(F.count(F.lit(1)).alias("facts"))
    ok = got["episodes"].join(facts, "session_id", "left").select(
        "session_id", F.col("title").alias("outcome"), F.coalesce("facts", F.lit(0)).alias("facts"))
    return ok.unionByName(got["rejects"].select("session_id", F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("facts")))


MODEL_REPLIES = r"""SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE doc_id % 7 WHEN 0 THEN 'no_object' WHEN 1 THEN 'not_json' ELSE 'T' || doc_id END AS outcome,
  CASE WHEN doc_id % 7 < 2 THEN 0 ELSE least(20, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')))) END AS facts FROM documents"""

QUERIES = {
    "layer_lines": (layer_lines, LAYER_LINES), "encrypted_layer": (encrypted_layer, ENCRYPTED_LAYER),
    "project_layer": (project_layer, PROJECT_LAYER), "appended_counters": (appended_counters, COUNTERS),
    "scanned_tree": (scanned_tree, SCANNED_TREE), "model_replies": (model_replies, MODEL_REPLIES),
}
