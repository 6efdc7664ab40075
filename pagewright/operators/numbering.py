"""Numbers and prefix sums in an order, without a window that takes all rows of a key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def saver(rows: DataFrame, save: Callable | None, name: str) -> Callable:
    """`save`, or tables of one's own in the shared folder."""
    if save is not None:
        return save
    from pagewright.plans.knowledge import Stages

    return Stages(rows.sparkSession, name)


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, save: Callable | None = None, tag: str = "sums") -> DataFrame:
    """Rows with `name`: the sum of `value` over the rows of equal `keys` that come before by `order` (columns, and unique
    within a key, or else ties are settled anyhow).

    Rows are cut by range of key and order into parts of like size and written, so that the parts stay what they are. A
    part's sums are few rows; their running sums, and those inside each part, add up to the result. A key of any size
    spreads over as many parts as it fills.
    """
    save = saver(rows, save, "sums")
    parts = rows.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parts = save(tag, parts)
    totals = parts.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = totals.select(*keys, "_part", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")).alias("_before"))
    same = " and ".join(f"p.{k} <=> b.{k}" for k in [*keys, "_part"])
    met = parts.alias("p").join(before.alias("b"), F.expr(same)).select("p.*", "b._before")
    inside = F.sum("_value").over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_value")
    return met.withColumn(name, F.col("_before") + inside).drop("_value", "_part", "_before")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, save: Callable | None = None, tag: str = "numbered") -> DataFrame:
    """Rows with their place, from 0, among those of equal `keys`."""
    return prefix_sums(rows, keys, order, F.lit(1).cast("long"), name, save, tag)
