"""Exact row numbers and running sums within groups, safe when one is huge.

A window over a group sorts all of it in one task. Here the rows are range-
partitioned on (group, order) instead, so a group of any size spreads over as
many slices as it needs, and written to the checkpoint dir once: all readers
below see the same slices even if a task is retried, and nothing upstream runs
twice. Each slice of a group is numbered (or summed) by itself; what lies in a
group's earlier slices is added. Only a group that begins in an earlier slice
needs such an offset, which is one group per slice at most, so the offsets are
a table of as many rows as there are slices.

The order must be total (unique) within a group, as it is for every caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _sliced(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    return materialize(df.repartitionByRange(group, *order).withColumn("_slice", F.spark_partition_id()))


def _with_offsets(local: DataFrame, totals: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """Add to ``names`` of each row the ``totals`` of its group's earlier slices."""
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_slice", F.row_number().over(Window.partitionBy(group).orderBy("_slice")).alias("_k"),
                            *[F.sum(n).over(before).alias(f"_o_{n}") for n in names])
    offsets = offsets.filter(F.col("_k") > 1).drop("_k")  # one row per slice at most
    out = local.join(F.broadcast(offsets), [group, "_slice"], "left")
    for n in names:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
    return out.drop("_slice", *[f"_o_{n}" for n in names])


def rank_within(df: DataFrame, group: str, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Add ``out`` = 1-based position of each row in its group by ``order``."""
    sliced = _sliced(df, group, order)
    local = sliced.withColumn(out, F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order)))
    totals = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias(out))
    ranked = _with_offsets(local, totals, group, [out])
    return ranked.withColumn(out, F.col(out).cast("int")).select(*df.columns, out)


def running_within(df: DataFrame, group: str, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running (inclusive) sums along ``order`` within each group: one
    output column per entry of ``sums`` (name -> value expression)."""
    values = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    sliced = _sliced(values, group, order)
    frame = Window.partitionBy(group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumns({name: F.sum(f"_v_{name}").over(frame) for name in sums})
    totals = sliced.groupBy(group, "_slice").agg(*[F.sum(f"_v_{name}").alias(name) for name in sums])
    return _with_offsets(local, totals, group, list(sums)).select(*df.columns, *sums)
