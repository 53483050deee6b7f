"""``spark.read.format("volume")``: volume files as rows.

One task a file, or, with the option ``slab`` on raw files, one for each so many slices, which reads only
their bytes. The option ``pixels`` = false reads headers alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from voxtree.sources import files
from voxtree.sources.decode import decode, encode, read_header
from voxtree.sources.formats import SUFFIXES, format_of

SCHEMA = "path string, format string, shape array<int>, dtype string, metadata map<string,string>, z_first int, data binary"


@dataclass
class _Part(InputPartition):
    path: str
    first: int = 0
    slices: int = 0


def volume_files(path: str, suffixes: tuple[str, ...] | None = None) -> list[str]:
    """The volume files that a file, directory or pattern names, in order; an empty list is an error."""
    allowed = suffixes or tuple(s for group in SUFFIXES.values() for s in group)
    found = [f for f in files.listed(path) if f.lower().endswith(tuple(s.lower() for s in allowed))]
    if not found:
        raise FileNotFoundError(f"no volume files in {path}")
    return found


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "")
        self.pixels = str(options.get("pixels", "true")).lower() != "false"
        self.slab = int(options.get("slab", 0))

    def partitions(self) -> list[_Part]:
        parts = []
        for f in volume_files(self.path):
            if self.slab and self.pixels and format_of(f) == "v3draw":
                depth = read_header(f).volume_shape()[0]
                parts += [_Part(f, z, min(self.slab, depth - z)) for z in range(0, depth, self.slab)]
            else:
                parts.append(_Part(f))
        return parts

    def read(self, part: _Part) -> Iterator[tuple]:
        h = read_header(part.path)
        shape, kind = h.volume_shape(), h.dtype.newbyteorder("<")
        meta = {k: str(v) for k, v in h.metadata.items()}
        if not self.pixels:
            yield part.path, h.format, list(shape), kind.str[1:], meta, 0, None
        elif part.slices:
            step = shape[1] * shape[2] * h.dtype.itemsize
            raw = np.frombuffer(files.read(part.path, h.offset + part.first * step, part.slices * step), h.dtype)
            yield part.path, h.format, [part.slices, *shape[1:]], kind.str[1:], meta, part.first, raw.astype(kind).tobytes()
        else:
            a = decode(files.read(part.path), h.format, os.path.dirname(part.path))
            yield part.path, h.format, list(a.shape), a.dtype.str[1:], meta, 0, a.astype(a.dtype.newbyteorder("<")).tobytes()


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Each row (path, shape, dtype, data) becomes the file of its path's name in the directory."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"], options.get("suffix"), overwrite

    def write(self, rows: Iterator) -> _Written:
        names = []
        for row in rows:
            name = files.joined(self.path, os.path.basename(row["path"]) + (self.kind or ""))
            if files.exists(name) and not self.overwrite:
                raise FileExistsError(name)
            a = np.frombuffer(row["data"], "<" + row["dtype"]).reshape(row["shape"])
            files.write(name, encode(a, format_of(name), name.lower().endswith(".gz")))
            names.append(name)
        return _Written(names)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        for m in messages:
            for f in m.names if m else []:
                files.remove(f)


class VolumeSource(DataSource):
    """The format ``volume``."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(VolumeSource)


def read_volumes(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The volume files of a file, directory or pattern."""
    register(spark)
    return spark.read.format("volume").options(**options).load(path)


def voxels(volumes: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """path, z, y, x, v: one row for each voxel of volumes of 1- or 2-byte whole numbers, ``rows`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shape, dtype, first, data in zip(*(batch[c] for c in ("path", "shape", "dtype", "z_first", "data")), strict=True):
                if dtype.as_py() not in ("u1", "u2"):
                    raise ValueError(f"voxels of type {dtype.as_py()} are not listed")
                values = np.frombuffer(data.as_buffer(), "<" + dtype.as_py()).astype(np.int32)
                for at in range(0, len(values), rows):
                    z, y, x = np.unravel_index(np.arange(at, min(at + rows, len(values))), shape.as_py())
                    columns = [pa.array(c, pa.int32()) for c in (z + first.as_py(), y, x, values[at : at + rows])]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(z), pa.string()), *columns], ["path", "z", "y", "x", "v"])

    return volumes.select("path", "shape", "dtype", "z_first", "data").mapInArrow(run, "path string, z int, y int, x int, v int")
