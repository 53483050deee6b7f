"""Incremental runs that survive failures: begin, write, commit.

A run state is a folder of two tables. ``runs`` gets one small file when a run begins and one when it ends;
``ledger`` gets the key and version of every record a run has handled, under the run's own folder. Only the
file that marks a run as succeeded makes its rows count, and it is written last, so that a run that dies at
any point leaves nothing that later runs take for done: its records come again, and those of succeeded
runs don't. A run reads again from the oldest transaction that was open when the last succeeded one
began (``low_watermark``); what that overlaps with is removed by key and version against the ledger.

Defined results: a first run receives all records; a run without anything due may still be committed; ending a
run twice, or one that never began, is an error. Runs are numbered from 1.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtree.operators.incremental import SUCCEEDED, pending

RUNS = "run_id int, started_at timestamp, ended_at timestamp, run_state string"
LEDGER = "run_id int, record_id bigint, status string, output_swc string, timestamp_utc string, committed_at timestamp"


class RunState:
    """The runs kept under ``folder``, which every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def runs(self) -> DataFrame:
        """One row a run: its end, where it has one, overrules its beginning."""
        rows = self._read("runs", RUNS).groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("run_state").alias("run_state"))
        return rows.select("run_id", "started_at", "ended_at", "run_state")

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def _note(self, run: int, started: datetime | None, ended: datetime | None, state: str | None) -> None:
        self.spark.createDataFrame([(run, started, ended, state)], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def begin(self, at: datetime) -> int:
        """Open a run; its number."""
        run = (self.runs().agg(F.max("run_id")).first()[0] or 0) + 1
        self._note(run, at, None, None)
        return run

    def due(self, records: DataFrame, changed: str | None = None) -> DataFrame:
        """What an open run must receive; ``changed`` names the time of a record's last change, if it has one."""
        return pending(records, self.ledger(), self.runs(), changed)

    def handle(self, run: int, records: DataFrame, at: datetime) -> None:
        """Note records with the version that the run has seen. A run may do so in several parts; a part that is written
        twice counts once."""
        rows = records.select(F.lit(run).alias("run_id"), "record_id", "status", "output_swc", "timestamp_utc", F.lit(at).cast("timestamp").alias("committed_at"))
        rows.write.mode("append").parquet(f"{self.folder}/ledger/run={run}")

    def end(self, run: int, at: datetime, state: str = SUCCEEDED) -> None:
        """Close a run. Its ledger rows count from here on if it succeeded."""
        known = self.runs().where(F.col("run_id") == run).first()
        if known is None or known["run_state"] is not None:
            raise ValueError(f"run {run} is not open")
        self._note(run, None, at, state)
