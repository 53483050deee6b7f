"""A directory traced as files arrive, and the progress of running traces."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxtree.batch import trace_table
from voxtree.sources import files
from voxtree.sources.formats import SUFFIXES


def watch_directory(spark: SparkSession, directory: str, output_dir: str, manifest_dir: str, checkpoint_dir: str, files_per_batch: int = 64, once: bool = False, **options: object) -> StreamingQuery:
    """Trace every new volume file and write its manifest row as JSON under ``manifest_dir``.

    The file source remembers what it has seen in ``checkpoint_dir``. A batch that is run again after a
    failure finds its skeletons written and overwrites its own folder of the manifest, so that no file is
    traced or listed twice."""
    allowed = tuple(s for group in SUFFIXES.values() for s in group)
    found = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch).load(directory).select("path")
    )

    def run(batch: DataFrame, number: int) -> None:
        # as many rows as files of one trigger
        paths = sorted(unquote(urlparse(p).path) if p.startswith("file:") else p for p in (r["path"] for r in batch.collect()))
        there = files.existing(paths)
        paths = [p for p in paths if p.lower().endswith(allowed) and p in there]
        if paths:
            rows = trace_table(spark, paths, output_dir, **{"on_exists": "skip"} | options)
            rows.write.mode("overwrite").json(f"{manifest_dir}/batch={number}")

    writer = found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress_by_stage(events: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Progress events (input_path, stage, current, total, at), batch or stream: the last of each file and stage
    in every window, so that a viewer is told at most once a window."""
    return (
        events.withWatermark("at", late).groupBy(F.window("at", every), "input_path", "stage")
        .agg(F.max(F.struct("current", "total")).alias("p"), F.count(F.lit(1)).alias("n_events"))
        .select(F.col("window.start").alias("since"), "input_path", "stage", "p.current", "p.total", "n_events")
    )


def throttled(events: list[tuple[str, str, int | None, int | None]], refresh_every: int, seconds: list[float] | None = None, least_seconds: float = float("inf")) -> list[tuple[str, str, int | None, int | None]]:
    """Of one file's events those worth showing. Beside the last one shown an event is news if its stage or total is
    another, if either of them has no count, if it is the first or last step of its stage, if the count
    began again, or if it is ``refresh_every`` steps or ``least_seconds`` further on."""
    shown: list[tuple[str, str, int | None, int | None]] = []
    at = 0.0
    for event, clock in zip(events, seconds or [0.0] * len(events), strict=True):
        _, stage, current, total = event
        _, old_stage, old, old_total = shown[-1] if shown else (None,) * 4
        if (stage, total) != (old_stage, old_total) or None in (current, total, old) or not (0 < current < total and 0 <= current - old < refresh_every and clock - at < least_seconds):
            shown.append(event)
            at = clock
    return shown
