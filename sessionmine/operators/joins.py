"""Joins whose keys may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

DEFAULT_PARTITION = "default"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys of `left` stay."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    out = left.join(other, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def with_partition(df: DataFrame) -> DataFrame:
    """A missing partition is the default one."""
    return df.withColumn("partition", F.coalesce("partition", F.lit(DEFAULT_PARTITION))) if "partition" in df.columns else df
