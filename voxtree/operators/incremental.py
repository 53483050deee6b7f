"""The records that no successful run has handled in their present version.

``pending`` compares key-and-version pairs with the ledger by one anti-join. The ledger is reduced
before it meets the records: of each record's rows only those of the succeeded run that started last
stay, by an aggregate that combines on the map side, so that a record with very many rows makes no
large group.

Rereading may start at ``low_watermark``, the oldest transaction that was open when the last succeeded
run began, wherever the records carry the time of their last change (``changed``). The manifest only
carries the time of first arrival, which does not move when a value is altered later; its window is
the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtree.functions.instants import instant_micros, status_name

SUCCEEDED = "succeeded"


def version(status: Column, output: Column, timestamp: Column) -> list[Column]:
    """What makes two states of a record the same: the state's name, the output (empty is null) and
    the instant; a time that cannot be read counts as its own text."""
    micros = instant_micros(timestamp)
    text = F.trim(timestamp)
    return [
        status_name(status).alias("v_status"),
        F.when(output != "", output).alias("v_output"),
        F.coalesce(micros.cast("string"), F.when(text != "", text)).alias("v_time"),
    ]


def handled(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """record_id and version as the succeeded run that started last saw them. Of several rows of that
    run the one committed last counts; an unknown start is the earliest."""
    ok = runs.where(status_name(F.col("run_state")) == SUCCEEDED).groupBy("run_id").agg(F.max("started_at").alias("started_at"))
    rows = ledger.where("record_id is not null").join(ok, "run_id").select(
        "record_id", "started_at", "run_id", "committed_at", *version(F.col("status"), F.col("output_swc"), F.col("timestamp_utc"))
    )
    last = rows.groupBy("record_id").agg(
        F.max(F.struct("started_at", "run_id", "committed_at", "v_status", "v_output", "v_time")).alias("last")
    )
    return last.select("record_id", "last.v_status", "last.v_output", "last.v_time")


def low_watermark(runs: DataFrame) -> DataFrame:
    """One row: the start of the oldest run that was open when the last succeeded run began (that run
    itself when none was); null when none succeeded."""
    ok = runs.where(status_name(F.col("run_state")) == SUCCEEDED)
    last = ok.agg(F.max("started_at").alias("last_start"))
    open_then = (F.col("started_at") <= F.col("last_start")) & (F.col("ended_at").isNull() | (F.col("ended_at") > F.col("last_start")))
    return runs.join(F.broadcast(last), open_then).agg(F.min("started_at").alias("low_watermark"))


def pending(records: DataFrame, ledger: DataFrame, runs: DataFrame, changed: str | None = None) -> DataFrame:
    """The records the next run must receive, one row each.

    ``changed`` names a column with the time of a record's last change; records changed before the
    watermark are then not read again. A record without an id can never be in the ledger and is always
    due. Repeated records come out once per distinct version.
    """
    state = ["v_status", "v_output", "v_time"]
    due = records.select(
        F.struct("*").alias("record"), F.col("record_id").alias("_key"), *([F.col(changed).alias("_changed")] if changed else []),
        *version(F.col("status"), F.col("output_swc"), F.col("timestamp_utc")),
    )
    if changed:
        late = F.col("low_watermark").isNull() | F.col("_changed").isNull() | (F.col("_changed") >= F.col("low_watermark"))
        due = due.join(F.broadcast(low_watermark(runs)), late)
    seen = handled(ledger, runs).select(F.col("record_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in state])
    same = F.col("_key") == F.col("_id")
    for c in state:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return due.join(seen, same, "left_anti").dropDuplicates(["_key", *state]).select("record.*")
