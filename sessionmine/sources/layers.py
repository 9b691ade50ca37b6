"""Layer files: JSON lines or arrays, plain or encrypted, partitioned by scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.sizes import keep

PREFIX = "enc:v1:"


def encrypt_line(plain: Column, key: Column) -> Column:
    """`enc:v1:<iv>:<tag>:<ciphertext>` (base64 parts), AES-GCM."""
    # Spark's output is the 12 byte IV, the ciphertext, the 16 byte tag.
    hexed = F.hex(F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM")))
    n = F.length(hexed)
    b64 = lambda h: F.base64(F.unhex(h))
    flat = lambda c: F.regexp_replace(c, r"\s", "")
    return F.concat(F.lit(PREFIX), flat(b64(F.substring(hexed, 1, 24))), F.lit(":"),
                    flat(b64(F.substr(hexed, n - 31))), F.lit(":"), flat(b64(F.substr(hexed, F.lit(25), n - 56))))


def decrypt_line(stored: Column, key: Column) -> Column:
    """The plain line; a line without the prefix is passed on, NULL cannot be decoded."""
    parts = F.split(F.substr(stored, F.lit(len(PREFIX) + 1)), ":")
    iv, tag, data = (F.unbase64(F.get(parts, F.lit(i))) for i in range(3))
    ok = (F.size(parts) == 3) & (F.length(iv) == 12) & (F.length(tag) == 16)
    plain = F.try_aes_decrypt(F.concat(iv, data, tag), key, F.lit("GCM")).cast("string")
    return F.when(~stored.startswith(PREFIX), stored).when(ok, plain)


def _key(key: bytes) -> Column:
    return F.unhex(F.lit(key.hex()))


def read_layer(spark: SparkSession, path: str, schema: str, key: bytes | None = None,
               array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines).  Blank lines are nothing; broken or undecodable lines are bad."""
    if array:
        df = spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
        df = keep(df)  # Spark asks for it before a query on the bad records alone
        return df.filter(F.col("_bad").isNull()).drop("_bad"), df.filter(F.col("_bad").isNotNull()).select(F.col("_bad").alias("line"))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    plain = F.col("value") if key is None else decrypt_line(F.col("value"), _key(key))
    rec = F.from_json("plain", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = lines.select(F.col("value").alias("line"), plain.alias("plain")).withColumn("r", rec)
    bad = F.col("plain").isNull() | F.col("r._bad").isNotNull()
    return df.filter(~bad).select("r.*").drop("_bad"), df.filter(bad).select("line")


def write_layer(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                key: bytes | None = None) -> None:
    """Overwrite a layer; with `partition_by` only the partitions present in `df`.  With a key
    the lines are encrypted; the names of partition folders are not."""
    if key is not None:
        by = [F.col(c).alias(f"part_{c}") for c in partition_by or []]
        df = df.select(encrypt_line(F.to_json(F.struct(*df.columns)), _key(key)).alias("value"), *by)
        partition_by, fmt = [f"part_{c}" for c in partition_by or []], "text"
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def append_events(df: DataFrame, path: str) -> None:
    """Counters are events: appended here, counted by aggregation."""
    df.write.mode("append").parquet(path)


def read_scopes(spark: SparkSession, root: str, project: str, partition: str = "default") -> DataFrame:
    """The project's rows and the global partition's rows of a layer that was written
    partitioned by `scope, partition_key`; a row is tagged with where it was read from and
    the project's copy of an id wins."""
    base = spark.read.parquet(root)
    mine = base.filter((F.col("scope") == "project") & (F.col("partition_key") == project)).withColumn("_rank", F.lit(0))
    shared = base.filter((F.col("scope") == "global") & (F.col("partition_key") == partition)).withColumn("_rank", F.lit(1))
    both = mine.unionByName(shared)
    cols = [c for c in both.columns if c != "_rank"]
    return both.groupBy("id").agg(F.min_by(F.struct(*cols), "_rank").alias("r")).select("r.*").withColumnRenamed("scope", "read_from")


def project_key(cwd: Column) -> Column:
    """Directory name of a project: slug of its last part and a short hash."""
    last = F.regexp_extract(cwd, r"([^/\\]*)[/\\]*$", 1)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 32)
    return F.concat(F.when(slug == "", "root").otherwise(slug), F.lit("-"), F.substring(F.sha1(cwd), 1, 8))


METRIC_DEFAULTS = {"reflections": 0, "skipped": 0, "new_cards": 0, "duplicate_cards": 0, "empty_streak": 0,
                   "backoff": False, "injections": 0, "gate_kept": 0, "gate_dropped": 0, "advisories": 0}


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The metrics row with defaults for what is missing."""
    try:
        df = spark.read.schema(schema).json(path)
        have = df.limit(1).count() > 0
    except Exception as e:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = False
    if not have:
        df = spark.createDataFrame([tuple(METRIC_DEFAULTS.values())], schema)
    return df.na.fill({k: v for k, v in METRIC_DEFAULTS.items() if not isinstance(v, bool)}).withColumn(
        "backoff", F.coalesce("backoff", F.lit(False)))


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
