"""Tracing of single volumes, in stages or at once."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from voxtree import figures
from voxtree.kernels.connect import reconstruct
from voxtree.kernels.forest import Forest
from voxtree.kernels.trace import Chain, Seed, good_chains, grow_chains, scored_seeds, seed_candidates
from voxtree.kernels.tube import Config
from voxtree.kernels.volume import as_volume, closed_mask, estimated_threshold, signal_of
from voxtree.operators.tracing import deadline
from voxtree.sources import files
from voxtree.sources.decode import read_volume
from voxtree.sources.swc import swc_text

Image = str | os.PathLike | np.ndarray
ON_EXISTS = ("error", "skip", "overwrite")


@dataclass
class TraceResult:
    """What a trace gave; ``skipped`` with its reason when an output was there already."""

    path: str | None = None
    threshold: float | None = None
    seeds: list[Seed] = field(default_factory=list)
    chains: list[Chain] = field(default_factory=list)
    forest: Forest | None = None
    raw_forest: Forest | None = None
    outputs: list[str] = field(default_factory=list)
    skipped: bool = False
    skip_reason: str | None = None


def load(image: Image) -> np.ndarray:
    """A path or an array as a volume."""
    return as_volume(image) if isinstance(image, np.ndarray) else read_volume(os.fspath(image))


def settings(config: Config | dict | None) -> Config:
    """A configuration from one, from changes to the default, or the default."""
    return config if isinstance(config, Config) else Config().with_changes(config)


def preprocess_volume(image: Image) -> tuple[np.ndarray, np.ndarray, float]:
    """Signal without background, mask and threshold."""
    signal = signal_of(load(image))
    threshold = estimated_threshold(signal)
    return signal, closed_mask(signal, threshold), threshold


def extract_seeds(image: Image, *, mask: np.ndarray | None = None, threshold: float | None = None, config: Config | dict | None = None, strategy: str = "eager", timeout: float | None = None) -> list[Seed]:
    """Seeds from a given mask, else a given threshold, else by preprocessing; scored unless ``lazy``."""
    c, signal = settings(config), signal_of(load(image))
    if mask is None:
        mask = closed_mask(signal, estimated_threshold(signal) if threshold is None else threshold)
    mask = np.asarray(mask) > 0
    if strategy == "eager":
        return scored_seeds(signal, mask, c, deadline(timeout))
    if strategy != "lazy":
        raise ValueError(f"unknown seed strategy {strategy!r}")
    return seed_candidates(mask, c)


def generate_chains(seeds: list[Seed], image: Image, *, max_seeds: int | None = None, filtered: bool = True, config: Config | dict | None = None, strategy: str = "auto", timeout: float | None = None) -> list[Chain]:
    """Chains from seeds; ``auto`` scores them on the way where they are not yet."""
    c, signal = settings(config), signal_of(load(image))
    chains = grow_chains(signal, np.zeros(signal.shape, bool), c, strategy, max_seeds, deadline(timeout), seeds)
    return good_chains(chains, c) if filtered else chains


def connect_chains(chains: list[Chain], image: Image, *, config: Config | dict | None = None, timeout: float | None = None, raw: bool = False) -> Forest:
    """The forest of chains; no chains are an error."""
    forest = reconstruct([Chain(list(c.tubes), list(c.status)) for c in chains], signal_of(load(image)), settings(config), deadline(timeout), raw)
    if forest is None:
        raise ValueError("there are no chains to connect")
    return forest


def trace_volume(image: Image, *, config: Config | dict | None = None, strategy: str = "eager", timeout: float | None = None, max_seeds: int | None = None, filtered: bool = True, connect: bool = True, progress: Callable[[str, int, int], None] = lambda *_: None) -> TraceResult:
    """All stages of one volume in memory."""
    c, check = settings(config), deadline(timeout)
    signal, mask, threshold = preprocess_volume(image)
    progress("preprocess", 1, 1)
    seeds = scored_seeds(signal, mask, c, check) if strategy == "eager" else seed_candidates(mask, c)
    progress("seeds", len(seeds), len(seeds))
    chains = grow_chains(signal, mask, c, strategy, max_seeds, check, seeds)
    chains = good_chains(chains, c) if filtered else chains
    progress("chains", len(chains), len(chains))
    result = TraceResult(None, threshold, seeds, chains)
    if connect and chains:
        copy = [Chain(list(x.tubes), list(x.status)) for x in chains]
        result.raw_forest = reconstruct(copy, signal, c, check, raw=True)
        result.forest = reconstruct([Chain(list(x.tubes), list(x.status)) for x in chains], signal, c, check)
    progress("nodes", 1, 1)
    return result


def save_swc(forest: Forest, path: str) -> None:
    """Write a forest as an SWC file."""
    f = forest.frame()
    files.write(path, swc_text(f[["node_id", "node_type", "x", "y", "z", "radius", "parent_id"]].to_numpy().tolist()).encode())


def output_paths(image_path: str, output_swc: str | None, figure_dir: str | None) -> list[str]:
    """The files that a trace of a path writes: the skeleton and four figures."""
    name = os.path.basename(image_path)
    out = [output_swc] if output_swc else []
    if figure_dir:
        out += [files.joined(figure_dir, kind, f"{name}.png") for kind in figures.KINDS]
    return out


def trace_file(image_path: str, *, output_swc: str | None = None, figure_dir: str | None = None, on_exists: str = "error", **options: object) -> TraceResult:
    """Trace a file and write its outputs; an existing one is an error, a reason to skip, or overwritten."""
    if on_exists not in ON_EXISTS:
        raise ValueError(f"on_exists is one of {', '.join(ON_EXISTS)}")
    paths = output_paths(image_path, output_swc, figure_dir)
    found = files.existing(paths)
    there = next((p for p in paths if p in found), None)
    if there and on_exists == "error":
        raise FileExistsError(there)
    if there and on_exists == "skip":
        return TraceResult(image_path, outputs=paths, skipped=True, skip_reason="exists")
    volume = read_volume(image_path)
    result = trace_volume(volume, **options)
    result.path, result.outputs = image_path, paths
    if output_swc:
        if result.forest is None:
            raise ValueError("there is no skeleton to write")
        save_swc(result.forest, output_swc)
    if figure_dir:
        flat = figures.projection(volume)
        lines = [figures.forest_lines(result.forest), [figures.tube_line(s.tube) for s in result.seeds if s.tube], figures.chain_lines(result.chains), figures.forest_lines(result.raw_forest)]
        for path, drawn in zip(paths[-len(figures.KINDS) :], lines, strict=True):
            figures.save_overlay(flat, drawn, path)
    return result
