"""Running totals that stay parallel when one key holds most of the rows.

A plain window over a key runs in one task. Here every key is cut into chunks of its
order (an hour, a block of line numbers): the window runs per (key, chunk) and the totals
of earlier chunks, a small table, are added by a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, sums: dict[str, Column], totals_of: DataFrame | None = None) -> DataFrame:
    """Add ``name`` = sum of the expression over the earlier rows of the key, for every
    item of ``sums``. ``chunk`` must not decrease along ``order``.

    ``totals_of`` is a cheaper DataFrame with the same rows (fewer columns, no windows) to
    take the chunk totals from; they are computed apart from the rows themselves."""
    keys = list(keys)
    inputs = {f"_in_{name}": value for name, value in sums.items()}
    base = df.withColumn("_chunk", chunk).withColumns(inputs)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns({f"_loc_{name}": F.sum(f"_in_{name}").over(within) for name in sums})
    narrow = base if totals_of is None else totals_of.withColumn("_chunk", chunk).withColumns(inputs)
    totals = narrow.groupBy(*keys, "_chunk").agg(*[F.sum(f"_in_{name}").alias(f"_tot_{name}") for name in sums])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_c"),
        *[F.coalesce(F.sum(f"_tot_{name}").over(earlier), F.lit(0)).alias(f"_pre_{name}") for name in sums])
    same = F.col("_chunk") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(prefix, same, "left")
    return joined.select(*df.columns, *[
        (F.coalesce(F.col(f"_loc_{name}"), F.lit(0)) + F.col(f"_pre_{name}")).alias(name) for name in sums])


def ordinal(df: DataFrame, keys: Sequence[str], line_no: str, name: str = "ordinal", block: int = 65536) -> DataFrame:
    """Position of a row within its key along an integer column, counted from 0."""
    chunk = F.floor(F.col(line_no) / block)
    return running_before(df, keys, [line_no], chunk, {name: F.lit(1)}).withColumn(name, F.col(name).cast("bigint"))
