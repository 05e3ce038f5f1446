"""Ordered per-group state (rank, lag, running sum, max and exclusive or) that survives a hot group.

A plain window sends a whole group to one task. When a group is too big for that, the rows are
range-partitioned on (keys, order) into slices of even size, each slice is scanned on its own, and one
summary row per slice carries the state over from the slices before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import runtime

SLICE = "_slice"


@dataclass
class Ordered:
    """Rows of `df` in `order` inside each `keys` group; every method adds one column."""

    df: DataFrame
    keys: list[str]
    order: list[Column]
    sliced: bool = False

    @staticmethod
    def of(
        df: DataFrame, keys: list[str], order: list[str], *, hot_rows: int | None = None, slices: int | None = None
    ) -> "Ordered":
        """`order` names columns; a leading `-` sorts that one descending."""
        cols = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
        if not runtime.has_hot_group(df.select(*keys) if keys else df, keys, hot_rows):
            return Ordered(df, keys, cols)
        spread = (
            df.repartitionByRange(slices, *keys, *cols) if slices else df.repartitionByRange(*keys, *cols)
        ).withColumn(SLICE, F.spark_partition_id())
        return Ordered(runtime.checkpoint(spread), keys, cols, True)

    def _window(self) -> "Window":
        parts = [*self.keys, SLICE] if self.sliced else self.keys
        window = Window.partitionBy(*parts) if parts else Window.partitionBy()
        return window.orderBy(*self.order)

    def _carried(self, summary: Column, fold: Callable[[Column, "Window"], Column]) -> DataFrame:
        """One row per (keys, slice) with the state left by every earlier slice of the group."""
        sums = self.df.groupBy(*self.keys, SLICE).agg(summary.alias("_state"))
        before = Window.partitionBy(*self.keys).orderBy(SLICE) if self.keys else Window.orderBy(SLICE)
        return sums.select(*self.keys, SLICE, fold(F.col("_state"), before).alias("_carry"))

    def _join(self, df: DataFrame, carried: DataFrame) -> DataFrame:
        on = [*self.keys, SLICE]
        right = carried.select(*[F.col(k).alias(f"_r_{k}") for k in on], "_carry")
        cond = F.lit(True)
        for k in on:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return df.join(runtime.small_side(right), cond, "left").drop(*[f"_r_{k}" for k in on])

    def running_sum(self, name: str, value: Column) -> "Ordered":
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        df = self.df.withColumn(name, F.sum(value).over(frame))
        if self.sliced:
            carried = self._carried(
                F.sum(value), lambda s, w: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1))
            )
            df = self._join(df, carried).withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")
        return Ordered(df, self.keys, self.order, self.sliced)

    def rank(self, name: str) -> "Ordered":
        """1-based position."""
        if not self.sliced:
            return Ordered(
                self.df.withColumn(name, F.row_number().over(self._window()).cast("long")), self.keys, self.order
            )
        return self.running_sum(name, F.lit(1).cast("long"))

    def running_max(self, name: str, value: Column) -> "Ordered":
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        df = self.df.withColumn(name, F.max(value).over(frame))
        if self.sliced:
            carried = self._carried(
                F.max(value), lambda s, w: F.max(s).over(w.rowsBetween(Window.unboundedPreceding, -1))
            )
            df = self._join(df, carried).withColumn(name, F.greatest(name, "_carry")).drop("_carry")
        return Ordered(df, self.keys, self.order, self.sliced)

    def running_xor(self, name: str, value: Column) -> "Ordered":
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        df = self.df.withColumn(name, F.bit_xor(value).over(frame))
        if self.sliced:
            carried = self._carried(
                F.bit_xor(value), lambda s, w: F.bit_xor(s).over(w.rowsBetween(Window.unboundedPreceding, -1))
            )
            carry = F.coalesce("_carry", F.lit(0).cast("long"))
            df = self._join(df, carried).withColumn(name, F.col(name).bitwiseXOR(carry)).drop("_carry")
        return Ordered(df, self.keys, self.order, self.sliced)

    def lag(self, name: str, value: str) -> "Ordered":
        """The value one row earlier in the group, null on its first row."""
        window = self._window()
        if not self.sliced:
            return Ordered(self.df.withColumn(name, F.lag(value).over(window)), self.keys, self.order)
        df = self.df.withColumn("_head", F.row_number().over(window) == 1).withColumn(name, F.lag(value).over(window))
        # The last row of each slice, found without sorting the slice again.
        tail = Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)
        lasts = (
            self.df.withColumn("_next", F.lead(F.lit(1)).over(tail))
            .where(F.col("_next").isNull())
            .select(*self.keys, SLICE, F.col(value).alias("_state"))
        )
        before = Window.partitionBy(*self.keys).orderBy(SLICE) if self.keys else Window.orderBy(SLICE)
        carried = lasts.select(*self.keys, SLICE, F.lag("_state").over(before).alias("_carry"))
        df = (
            self._join(df, carried)
            .withColumn(name, F.when(F.col("_head"), F.col("_carry")).otherwise(F.col(name)))
            .drop("_carry", "_head")
        )
        return Ordered(df, self.keys, self.order, True)

    def done(self) -> DataFrame:
        return self.df.drop(SLICE)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Appends each row's place (from 0) in the order of the scan.

    Rows are written once, where they were read, and none moves: a row knows its place in its partition, and one count per partition tells what lies before it.
    """
    kept = runtime.checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)  # the number of the partition; below it the place inside
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one narrow row per partition
    return placed.withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row", "_part", "_start")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of each group. Spark trims each map task to `n` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
