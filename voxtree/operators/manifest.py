"""Manifest tables: what was done, and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtree.functions.instants import status_name


def status_counts(records: DataFrame) -> DataFrame:
    """status (in one spelling), n and mean_seconds; unknown and null states are their own."""
    return records.groupBy(status_name(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed_seconds").alias("mean_seconds"))


def without_output(inputs: DataFrame, records: DataFrame) -> DataFrame:
    """The ``inputs`` whose output_swc no completed record names; one without an output is always left to do."""
    done = records.where(status_name(F.col("status")) == "completed").select("output_swc")
    return inputs.join(done, "output_swc", "left_anti").select(*inputs.columns)
