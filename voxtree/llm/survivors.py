"""One record for each file, built field by field from its duplicates.

A single aggregation per file takes, for every attribute, the largest of (has a value, trust in the
record's status, instant, smallest id, value). Aggregates combine on the map side, so a file with very
many records needs no large group and no window.

Defined results: records whose path is null or empty have no known file and are left out; unknown states
rank after failed, null last; an unreadable time is the earliest; records without an id lend their fields
but are never the survivor; empty text counts as no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtree.functions.instants import instant_micros, status_name
from voxtree.functions.paths import resolved_path

#: States from the most to the least trusted.
TRUST = ("completed", "skipped", "timed_out", "failed")
ATTRIBUTES = ("status", "timestamp_utc", "output_swc", "elapsed_seconds", "error_type", "error_message", "traceback", "timeout_seconds", "reason", "loaded_at")


def _rank(status: Column) -> Column:
    name = status_name(status)
    rank = F.when(name.isNull(), len(TRUST) + 1)
    for i, s in enumerate(TRUST):
        rank = rank.when(name == s, i)
    return rank.otherwise(len(TRUST))


def _groups(records: DataFrame, attributes: list[str]) -> DataFrame:
    columns = [c for c in attributes if c in records.columns]
    return records.select(
        resolved_path(F.col("input_path")).alias("file"), "record_id", _rank(F.col("status")).alias("_rank"),
        F.coalesce(instant_micros(F.col("timestamp_utc")), F.lit(-(2**62))).alias("_at"), *columns,
    ).where("file is not null")


def survivors(records: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """file, first_id, survivor_id, n_records and the best value of every attribute, one row per file. The id of the
    surviving record is itself the best value of an attribute; so are the others, each from the record that has it."""
    names = [c for c in attributes if c in records.columns]
    return _survivors(records, names).drop("last_id")


def _survivors(records: DataFrame, names: list[str]) -> DataFrame:
    rows = _groups(records, names)

    def best(name: str) -> Column:
        value = F.col(name)
        if dict(rows.dtypes)[name] == "string":
            value = F.when(F.trim(value) != "", value)
        order = F.struct(
            value.isNotNull().alias("has"), (-F.col("_rank")).alias("trust"), F.col("_at").alias("at"), (-F.col("record_id")).alias("first"), value.alias("value")
        )
        return F.max(order)["value"]

    return rows.groupBy("file").agg(
        F.min("record_id").alias("first_id"), best("record_id").alias("survivor_id"), F.count(F.lit(1)).alias("n_records"), *[best(c).alias(c) for c in names], F.max("record_id").alias("last_id")
    )


def duplicate_groups(records: DataFrame) -> DataFrame:
    """first_id, survivor_id and file of the files with two or more records."""
    return _survivors(records, []).where("first_id <> last_id").select("first_id", "survivor_id", "file")
