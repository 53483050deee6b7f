"""Names of volume formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes of each format.
SUFFIXES = {"tiff": (".tif", ".tiff"), "v3draw": (".v3draw", ".raw"), "v3dpbd": (".v3dpbd",), "nifti": (".nii", ".nii.gz"), "nrrd": (".nrrd", ".nhdr")}


def format_of(path: str) -> str:
    """The format that a file's suffix names, whatever its case."""
    name = path.lower()
    for kind, suffixes in SUFFIXES.items():
        if name.endswith(suffixes):
            return kind
    raise ValueError(f"no volume format has the suffix of {path}")


def format_name(path: Column) -> Column:
    """The same as a column; null for other suffixes."""
    out = None
    for kind, suffixes in SUFFIXES.items():
        test = None
        for s in suffixes:
            here = F.lower(path).endswith(s)
            test = here if test is None else test | here
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out
