"""Overlays of lines on a projection, as PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from voxtree.kernels.forest import Forest
from voxtree.kernels.trace import Chain
from voxtree.kernels.tube import Tube
from voxtree.sources import files

#: The figures of one trace.
KINDS = ("result", "seeds", "chains", "pre_postprocess")
Line = tuple[np.ndarray, tuple[int, int, int]]
RED = (255, 64, 64)


def projection(volume: np.ndarray, log: bool = True) -> np.ndarray:
    """The brightest voxel over z, as log(1 + v) of values above 0 if ``log``."""
    top = np.asarray(volume).max(0).astype(float)
    return np.log1p(np.maximum(top, 0)) if log else top


def forest_lines(forest: Forest | None, colour: tuple[int, int, int] = RED) -> list[Line]:
    """One line from each node to its parent."""
    if forest is None:
        return []
    return [(np.array([forest.at(i)[:2], forest.at(p)[:2]]), colour) for i, p in forest.parent.items() if p != -1]


def tube_line(tube: Tube, share: float = 0.5) -> Line:
    """The axis of a tube, from blue to yellow by ``share``."""
    return np.array([tube.start[:2], tube.end[:2]]), (int(255 * share), int(255 * share), int(255 * (1 - share)))


def depth_shares(values: np.ndarray) -> np.ndarray:
    """Values between their least and greatest; a half where all are equal."""
    span = np.ptp(values)
    return (values - values.min()) / span if span > 0 else np.full(len(values), 0.5)


def chain_lines(chains: list[Chain], seed: int = 0) -> list[Line]:
    """The line of every chain in a colour of its own."""
    rng = np.random.default_rng(seed)
    return [(c.points()[0][:, :2], tuple(int(v) for v in rng.integers(80, 256, 3))) for c in chains]


def drawn(flat: np.ndarray, lines: list[Line]) -> np.ndarray:
    """Grey image with coloured lines, (h, w, 3) bytes."""
    span = np.ptp(flat)
    grey = np.zeros(flat.shape) if span == 0 else (flat - flat.min()) / span * 255
    out = np.repeat(grey.astype(np.uint8)[..., None], 3, 2)
    for points, colour in lines:
        for a, b in zip(points, points[1:], strict=False):
            n = int(np.ceil(np.abs(b - a).max())) + 1
            x, y = np.rint(a[:, None] + (b - a)[:, None] * np.linspace(0, 1, n)).astype(int)
            ok = (x >= 0) & (x < out.shape[1]) & (y >= 0) & (y < out.shape[0])
            out[y[ok], x[ok]] = colour
    return out


def png(pixels: np.ndarray) -> bytes:
    """The bytes of an 8-bit colour PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def save_overlay(flat: np.ndarray, lines: list[Line], path: str) -> None:
    """Draw and write a figure."""
    files.write(path, png(drawn(flat, lines)))
