"""Files by path or URI: local ones, and those of shared and object stores (file, hdfs, s3, gs) through Arrow's file systems.

The same functions serve the driver, which lists, and the tasks, which read and write.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from fnmatch import fnmatchcase
from urllib.parse import unquote

from pyarrow import fs

_WILD = "*?["


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what stands before that in the whole."""
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path), ""
    if path.startswith("file://"):  # blanks may stand for themselves
        return fs.LocalFileSystem(), unquote(path[len("file://") :]), "file://"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: -len(inner)] if path.endswith(inner) else path[: path.index("://") + 3]


def existing(paths: Iterable[str]) -> set[str]:
    """Those of the paths that are there; one request for each file system where it can."""
    groups: dict[str, tuple[fs.FileSystem, dict[str, str]]] = {}
    for p in paths:
        system, inner, before = located(p)
        groups.setdefault(before, (system, {}))[1][inner] = p
    return {names[i.path] for system, names in groups.values() for i in system.get_file_info(list(names)) if i.type != fs.FileType.NotFound}


def exists(path: str) -> bool:
    return bool(existing([path]))


def is_directory(path: str) -> bool:
    system, inner, _ = located(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def listed(path: str) -> list[str]:
    """The files that a file, directory (not those below it) or pattern names, in order. A file of just this name comes
    before what it would match as a pattern."""
    whole = path.rstrip("/") or path
    if "://" not in path:
        system, inner, before = fs.LocalFileSystem(), whole, ""
    else:
        system, inner, before = located(whole)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [before + inner]
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner))
        return sorted(before + i.path for i in found if i.type == fs.FileType.File)
    parts = inner.split("/")
    wild = next((n for n, p in enumerate(parts) if any(c in p for c in _WILD)), None)
    if wild is None:
        return []
    base = "/".join(parts[:wild]) or ("/" if inner.startswith("/") else ".")
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=wild < len(parts) - 1))
    skip = 0 if base == "." else len(base.rstrip("/")) + 1
    fits = lambda name: len(s := name.split("/")) == len(parts) - wild and all(map(fnmatchcase, s, parts[wild:]))
    return sorted(before + i.path for i in found if i.type == fs.FileType.File and fits(i.path[skip:] if base != "." else i.path.removeprefix("./")))


def read(path: str, first: int = 0, size: int | None = None) -> bytes:
    """Bytes of a file; only those that are asked for are read."""
    system, inner, _ = located(path)
    with system.open_input_file(inner) as f:
        f.seek(first)
        return f.read() if size is None else f.read(size)


def write(path: str, data: bytes) -> None:
    """A whole file, seen under its name once it is complete."""
    system, inner, _ = located(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    if isinstance(system, fs.S3FileSystem | fs.GcsFileSystem):  # an object appears when its stream is closed
        with system.open_output_stream(inner, compression=None) as f:
            f.write(data)
        return
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as f:
        f.write(data)
    system.move(part, inner)


def append(path: str, data: bytes) -> None:
    """Bytes at the end of a file, where the file system can append."""
    system, inner, _ = located(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_append_stream(inner, compression=None) as f:
        f.write(data)


def remove(path: str) -> None:
    system, inner, _ = located(path)
    system.delete_file(inner)


def joined(directory: str, *names: str) -> str:
    return "/".join([directory.rstrip("/") or "/", *names]) if "://" in directory else os.path.join(directory, *names)
