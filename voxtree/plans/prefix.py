"""Prefix sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtree.session import materialize


def grouped_prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are cut into ranges of (group, order), so that a group that fills many ranges is summed by
    many tasks: once within every range, once over the totals of the ranges before it, of which there
    are no more than partitions. ``order`` must tell the rows of a group apart.
    """
    cut = materialize(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy("_range", *group).agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    )
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, ["_range", *group])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_range", "_before", "_inside")
    )
