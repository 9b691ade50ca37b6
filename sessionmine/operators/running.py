"""Running sums and last values over long ordered groups, in two levels.

A window over one hot key (a session, a fingerprint) would sort that key's whole history
in one task.  Here the history is cut into chunks by a column that grows with the order:
windows run inside (key, chunk); one row per chunk carries what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import join_null_safe
from .sizes import keep


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
            sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None,
            include_current: bool = True, totals: bool = False) -> DataFrame:
    """Add running totals (`sums`) and last non-null values (`lasts`) per key.

    `chunk` must never fall as `order` grows.  With `include_current=False` the values
    describe the rows before the current one. `totals=True` adds `<name>_total`, the sum
    over the whole key.
    """
    sums, lasts = sums or {}, lasts or {}
    base = df.withColumn("_chunk", chunk)
    for name, c in {**sums, **lasts}.items():
        base = base.withColumn(f"_in_{name}", c)
    base = keep(base)  # read by the windows and by the chunk totals
    end = Window.currentRow if include_current else -1
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, end))
    local = base
    for name in sums:
        local = local.withColumn(f"_loc_{name}", F.sum(f"_in_{name}").over(inside))
    for name in lasts:
        local = local.withColumn(f"_loc_{name}", F.last(f"_in_{name}", ignorenulls=True).over(inside))

    at = F.struct(*[F.col(o) for o in order])
    per_chunk = base.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
        *[F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), at)).alias(f"_tot_{n}")
          for n in lasts])
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys)
    carry = per_chunk.select(
        *keys, "_chunk",
        *[F.sum(f"_tot_{n}").over(before).alias(f"_car_{n}") for n in sums],
        *[F.last(f"_tot_{n}", ignorenulls=True).over(before).alias(f"_car_{n}") for n in lasts],
        *[F.sum(f"_tot_{n}").over(whole).alias(f"{n}_total") for n in (sums if totals else {})])

    out = join_null_safe(local, carry, [*keys, "_chunk"])
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.col(f"_loc_{name}"), F.lit(0))
                             + F.coalesce(F.col(f"_car_{name}"), F.lit(0)))
    for name in lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"_loc_{name}"), F.col(f"_car_{name}")))
    extra = [f"{p}{n}" for n in {**sums, **lasts} for p in ("_in_", "_loc_", "_car_")]
    return out.drop("_chunk", *extra)
