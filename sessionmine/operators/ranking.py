"""Top-k per group that survives one group holding most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank: str = "rank", salts: int = SALTS,
                  salt_by: list[str] | None = None) -> DataFrame:
    """Rows ranked 1..k per group.

    The group is first cut into `salts` slices by a hash of `salt_by` (default: the id
    column, else the whole row) and each slice keeps its own k best, so the last sort sees
    at most `salts * k` rows per group. Spark also cuts to k before each of the two
    shuffles (window group limit).
    """
    if salts > 1:
        by = salt_by or (["id"] if "id" in df.columns else _plain(df))
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(salts))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w))
              .filter(F.col("_r") <= k).drop("_r", "_salt"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _plain(df: DataFrame) -> list[str]:
    """Columns that can be hashed (maps cannot)."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()
            and "variant" not in f.dataType.simpleString()]
