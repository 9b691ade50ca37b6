"""Shards by extendible hashing (operator 2).

The directory is indexed by the first bits of a row's hash. It starts with one shard; only a
shard over the byte limit splits on its next bit, until every shard fits. A shard's name is
its bits ('' is the root). The hash has 60 bits of the key's digest and 60 of the text's, so
rows that share a key part on the text's bits.

The level sums come from cells of `STEP` more bits: one pass settles up to `STEP` levels, and
only rows of shards that are still too large go on to the next pass.

Defined results: a null text has 0 bytes, a null key is hashed like an empty one. A single
row over the limit is a shard of its own. Rows with equal keys and texts cannot be told
apart by any bit; where they exceed the limit together, they are numbered off into parts that
fit. An empty table gives an empty result. Further columns are ignored by `assign` and
written by `write`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

BITS = 120
STEP = 8
LIMIT = 64 << 20
_ROW = "_sharding_row"


def _digest_bits(c: Column) -> Column:
    number = F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.lpad(F.bin(number), 60, "0")


def hashed(rows: DataFrame, key: str) -> DataFrame:
    """Each row of `rows` with its size and its `BITS` bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(*rows.columns, F.octet_length(text).cast("long").alias("n_bytes"),
                       F.concat(_digest_bits(F.coalesce(F.col(key).cast("string"), F.lit(""))), _digest_bits(text)).alias("_bits"))


def assign(rows: DataFrame, limit: int = LIMIT, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: the key), `n_bytes, shard, depth, part, shard_bytes` for each
    row of `rows(key, text)`."""
    keep = keep or [key]
    picked = rows.select(*dict.fromkeys([*keep, key]), F.col("text"))
    left = stage(hashed(picked, key).drop("text"))
    done, base = None, 0
    while True:
        cell = F.substring("_bits", 1, min(base + STEP, BITS))
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("_bits").alias("lo"), F.max("_bits").alias("hi"))
        depths = F.explode(F.sequence(F.lit(base), F.lit(min(base + STEP, BITS))))
        levels = cells.select("cell", "b", "lo", "hi", depths.alias("depth"))
        levels = levels.withColumn("shard", F.expr("substring(cell, 1, depth)"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))
        sums = levels.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        sums = sums.filter(fits).select("depth", "shard", "shard_bytes")
        # The first level that fits; deeper ones are never reached.
        settled = (levels.select("cell", "depth", "shard").join(sums, ["depth", "shard"]).groupBy("cell")
                   .agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("s")))
        rows_now = stage(left.withColumn("cell", cell).join(settled, "cell", "left"))
        out = rows_now.filter("s IS NOT NULL").select(*left.columns, "s.shard", "s.depth", "s.shard_bytes")
        done = out if done is None else done.union(out)
        base += STEP
        left = rows_now.filter("s IS NULL").select(*left.columns)
        if base >= BITS or left.isEmpty():
            break
    return _parts(done, limit).select(*keep, "n_bytes", "shard", "depth", "part", "shard_bytes")


def _parts(done: DataFrame, limit: int) -> DataFrame:
    """Number rows of shards that no bit can split into parts that fit the limit."""
    from pyspark.sql import Window

    over = F.col("shard_bytes") > limit
    slot = F.spark_partition_id()
    w = Window.partitionBy("shard", "_slot").orderBy("_bits")
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    stuck = (done.filter(over).withColumn("_slot", slot)
             .withColumn("part", F.struct(F.col("_slot"), F.floor((F.row_number().over(w) - 1) / each).alias("nth")))
             .withColumn("part", (F.col("part._slot") * F.lit(1 << 32) + F.col("part.nth")).cast("long")).drop("_slot"))
    return done.filter(~over).withColumn("part", F.lit(0).cast("long")).unionByName(stuck)


def directory(assigned: DataFrame) -> DataFrame:
    """`shard, part, depth, n_rows, n_bytes`: what each shard holds."""
    return assigned.groupBy("shard", "part", "depth").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


def write(rows: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """Write all columns of `rows`, one folder a shard (`shard_name=...`), and return the
    directory."""
    numbered = stage(rows.withColumn(_ROW, F.monotonically_increasing_id()))
    where = stage(assign(numbered, limit, key, [_ROW]))
    name = F.concat(F.lit("b"), F.col("shard"), F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part"))).otherwise(""))
    (numbered.join(where.select(_ROW, name.alias("shard_name")), _ROW).drop(_ROW).repartition("shard_name")
     .write.partitionBy("shard_name").parquet(path))
    return directory(where)


def oracle(limit: int) -> str:
    """The same shards in DuckDB: the level sums of all depths at once."""
    def bits(c: str) -> str:
        return f"lpad(bin(CAST('0x' || substr(md5({c}), 1, 15) AS BIGINT)), 60, '0')"

    return f"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  {bits("coalesce(CAST(doc_id AS VARCHAR), '')")} || {bits("coalesce(text, '')")} AS h FROM documents),
lv AS (SELECT rid, h, n_bytes, unnest(range(0, {BITS} + 1)) AS depth FROM r),
s AS (SELECT depth, substr(h, 1, depth) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM lv GROUP BY ALL
      HAVING sum(n_bytes) <= {limit} OR count(DISTINCT h) = 1),
m AS (SELECT rid, min(lv.depth) AS depth FROM lv JOIN s ON s.depth = lv.depth AND s.shard = substr(lv.h, 1, lv.depth) GROUP BY rid)
SELECT doc_id, n_bytes, s.shard, CAST(m.depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS part, shard_bytes
FROM r JOIN m USING (rid) JOIN s ON s.depth = m.depth AND s.shard = substr(r.h, 1, m.depth)"""
