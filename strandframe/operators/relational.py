"""Relational operators of the engine as DataFrame functions.

Every order-sensitive operator takes a total order from its caller; results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Drops rows whose compared columns equal those of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for c in compare:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = df.withColumn("same_as_before", same & (F.row_number().over(w) > 1))
    return marked.where(~F.col("same_as_before")).drop("same_as_before")


def full_dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    return top_k(df, keys, order, 1).drop("rank")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of each key, with rank. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """The last value up to each row that isn't null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def overlap_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str] = (), touching: bool = True, out: str = "island") -> DataFrame:
    """Numbers runs of overlapping intervals within each key, from 0. touching: [1,2] and [2,3] are one run."""
    w = Window.partitionBy(*keys).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reach if touching else F.col(start) >= reach
    fresh = F.when(apart, 1).otherwise(0)
    return df.withColumn("island_begins", fresh).withColumn(out, F.sum("island_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("island_begins")


def merge_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, touching: bool = True) -> DataFrame:
    """One row for each run of overlapping intervals: its bounds and number of intervals."""
    islands = overlap_islands(df, keys, start, end, touching=touching)
    return islands.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_columns: Sequence[str]) -> DataFrame:
    """Each left row with the next right row of strictly larger on, null if there is none. Right rows of one key and
    on are told apart by right_columns, of which the least is taken. One shuffle for both sides."""
    value = F.struct(F.col(on).alias(on), *(F.col(c).alias(c) for c in right_columns))
    rights = right.where(F.col(on).isNotNull()).select(*keys, on, F.lit(True).alias("asof_is_right"), value.alias("asof_value"))
    both = left.withColumn("asof_is_right", F.lit(False)).unionByName(rights, allowMissingColumns=True)
    # from the largest down, left rows before right rows of equal on, the least of these last: what was seen last is next.
    # A running frame is linear in the rows of a key; one that looks ahead would add them up for each row anew.
    w = Window.partitionBy(*keys).orderBy(F.desc(on), "asof_is_right", F.desc("asof_value")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("asof_next", F.when(F.col(on).isNotNull(), F.last("asof_value", ignorenulls=True).over(w))).where(~F.col("asof_is_right"))
    return found.select(*left.columns, *(F.col("asof_next")[c].alias(f"next_{c}") for c in (on, *right_columns)))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of closed intervals that overlap, of equal keys. Both sides are dealt to bins of the width, joined by key
    and bin, and a pair is kept in the bin of the larger start only; columns must have names of their own."""
    (ls, le), (rs, re_) = left_span, right_span

    def binned(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        return df.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))

    a = binned(left, ls, le, "left_bin")
    b = binned(right, rs, re_, "right_bin")
    for k in keys:
        b = b.withColumnRenamed(k, f"right_{k}")
    on = F.col("left_bin") == F.col("right_bin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"right_{k}"))
    on = on & (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)) & (F.col("left_bin") == F.floor(F.greatest(ls, rs) / width))
    return a.join(b, on).drop("left_bin", "right_bin", *(f"right_{k}" for k in keys))


def interval_anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str], point: str, right_span: tuple[str, str], width: float) -> DataFrame:
    """Left rows whose point lies in no closed right interval of equal keys. Right intervals are dealt to bins."""
    start, end = right_span
    bins = right.where(F.col(start) <= F.col(end)).select(
        *(F.col(k).alias(f"right_{k}") for k in keys), start, end,
        F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("right_bin"),
    )
    a = left.withColumn("left_bin", F.floor(F.col(point) / width))
    on = (F.col("left_bin") == F.col("right_bin")) & (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"right_{k}"))
    return a.join(bins, on, "left_anti").drop("left_bin")
