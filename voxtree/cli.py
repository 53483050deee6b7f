"""python -m voxtree.cli INPUT [...]: trace a volume file or a directory of them."""

from __future__ import annotations

import argparse
import sys

from voxtree.api import trace_file
from voxtree.batch import trace_directory
from voxtree.sources import files


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="voxtree", description="Trace tube-like structures in volumes.")
    p.add_argument("input", help="a volume file or a directory")
    p.add_argument("-o", "--output", help="the SWC file, or for a directory the folder of SWC files")
    p.add_argument("--figures", help="a folder for overlays")
    p.add_argument("--manifest", help="a file to append one JSON line for each input to")
    p.add_argument("--jobs", type=int, default=-1, help="files at a time; -1 for all cores")
    p.add_argument("--timeout", type=float, help="seconds for one file")
    p.add_argument("--on-exists", choices=("error", "skip", "overwrite"))
    p.add_argument("--strategy", choices=("eager", "lazy"), default="lazy")
    p.add_argument("--max-seeds", type=int)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if not files.is_directory(a.input):
        out = a.output or f"{a.input}.swc"
        r = trace_file(a.input, output_swc=out, figure_dir=a.figures, on_exists=a.on_exists or "error", strategy=a.strategy, timeout=a.timeout, max_seeds=a.max_seeds)
        print(f"{'skipped' if r.skipped else 'written'}: {out}")
        return 0
    from voxtree.session import get_session

    spark = get_session("voxtree")
    done = trace_directory(
        spark, a.input, a.output or a.input, figure_dir=a.figures, manifest_path=a.manifest, jobs=a.jobs, timeout=a.timeout, on_exists=a.on_exists or "skip", strategy=a.strategy,
        progress=lambda path, status: print(f"{status}: {path}"),
    )
    print(f"{len(done)} outputs")
    return 0


if __name__ == "__main__":
    sys.exit(main())
