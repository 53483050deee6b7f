"""Many files traced in one job, with a manifest."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from voxtree.api import ON_EXISTS, output_paths, settings, trace_file
from voxtree.kernels.tube import Config
from voxtree.operators.tracing import RECORD, deadline, recorded
from voxtree.sources import files
from voxtree.sources.formats import format_of
from voxtree.sources.volumes import volume_files

MANIFEST = f"input_path string, output_swc string, reason string, {RECORD}"


def resolve_jobs(n: int, cpus: int) -> int:
    """-1 means all; other numbers below 1 are errors."""
    if n == -1:
        return cpus
    if n <= 0:
        raise ValueError("a number of jobs is -1 or at least 1")
    return n


def append_manifest(path: str, records: list[dict]) -> None:
    """One line of JSON for each record; ``reason`` only where there is one."""
    lines = [json.dumps({k: v for k, v in r.items() if k != "reason" or v is not None}, ensure_ascii=True) + "\n" for r in records]
    files.append(path, "".join(lines).encode("ascii"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines as a table; fields that some lines lack are null."""
    return spark.read.schema(MANIFEST).json(path)


def trace_table(
    spark: SparkSession, paths: list[str], output_dir: str, *, figure_dir: str | None = None, on_exists: str = "skip", jobs: int = -1, timeout: float | None = None,
    config: Config | dict | None = None, strategy: str = "lazy",
) -> DataFrame:
    """One manifest row for each file, traced when the rows are read; the skeletons are written by the tasks.

    Files whose outputs exist are skipped without work; a file that fails is a row and not an error."""
    if not paths:
        raise ValueError("there are no files to trace")
    if on_exists not in ON_EXISTS:
        raise ValueError(f"on_exists is one of {', '.join(ON_EXISTS)}")
    there = files.existing(paths)
    for p in paths:
        if p not in there:
            raise FileNotFoundError(p)
        format_of(p)
    c = settings(config)
    deadline(timeout)
    n = resolve_jobs(jobs, spark.sparkContext.defaultParallelism)
    names = ["input_path", "output_swc", "reason", *[f.strip().split(" ")[0] for f in RECORD.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                out = files.joined(output_dir, f"{os.path.basename(path)}.swc")

                def work(path=path, out=out) -> dict:  # noqa: ANN001
                    result = trace_file(path, output_swc=out, figure_dir=figure_dir, on_exists=on_exists, config=c, strategy=strategy, timeout=timeout)
                    return {"status": "skipped", "reason": result.skip_reason, "elapsed_seconds": 0.0} if result.skipped else {}

                yield pd.DataFrame([{"input_path": path, "output_swc": out, "reason": None} | recorded(work, timeout)])[names]

    # one file a task, as files differ much in their work
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), max(n, 1) * 8))
    return rows.mapInPandas(run, MANIFEST)


def trace_files(spark: SparkSession, paths: list[str], output_dir: str, *, manifest_path: str | None = None, progress: Callable[[str, str], None] = lambda *_: None, **options: object) -> list[str]:
    """Trace, append the manifest, and give the sorted outputs of all files that are done or were there."""
    outputs: set[str] = set()
    batch: list[dict] = []
    for row in trace_table(spark, paths, output_dir, **options).toLocalIterator():
        record = row.asDict()
        progress(record["input_path"], record["status"])
        batch.append(record)
        if record["status"] in ("completed", "skipped"):
            outputs.add(record["output_swc"])
        if manifest_path and len(batch) >= 100:
            append_manifest(manifest_path, batch)
            batch = []
    if manifest_path and batch:
        append_manifest(manifest_path, batch)
    return sorted(outputs)


def trace_directory(spark: SparkSession, directory: str, output_dir: str, *, suffixes: tuple[str, ...] | None = None, **options: object) -> list[str]:
    """All volume files of a directory, not of those below it."""
    return trace_files(spark, volume_files(directory, suffixes), output_dir, **options)


def existing_outputs(paths: list[str], output_dir: str, figure_dir: str | None = None) -> list[str]:
    """The input files that have an output already."""
    outputs = {p: output_paths(p, files.joined(output_dir, f"{os.path.basename(p)}.swc"), figure_dir) for p in paths}
    there = files.existing({o for own in outputs.values() for o in own})
    return [p for p, own in outputs.items() if there.intersection(own)]


def now() -> str:
    """The present in the manifest's form."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
