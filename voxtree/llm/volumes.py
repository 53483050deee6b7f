"""Oversized images cut into pieces at blank slices.

One Arrow-vectorised pass turns an image into a text with one letter for each unit (a z slice; a row or
a voxel where a slice alone is too large): ``.`` for blank, ``x`` for signal. A bounded-quantifier
pattern then consumes that text: as much as fits, ending where the alternative of the strongest boundary
allows, with any unit as the last resort. Starts, overlaps and the bytes of the pieces come from SQL
array functions and ``substring``, so that pixels never leave the JVM again.

Defined results: an image without a limit (unknown scanner, null limit) or without pixels is not
oversized; a null scanner is the one named in the path; of several rows of a scanner the smallest limit
and overlap count; a null threshold or unknown dtype makes no unit blank; without n_y or n_x the image is
one row of voxels; an overlap that would fill a whole piece is cut to one unit less; a limit below one
voxel gives pieces of one voxel. Repeated rows give repeated pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Names of the pixel types.
DTYPES = {"u8": "u1", "u16le": "<u2", "u16be": ">u2"}


@F.pandas_udf(StringType())
def blank_mask(image: pd.Series, dtype: pd.Series, threshold: pd.Series, unit: pd.Series) -> pd.Series:
    """One letter per ``unit`` bytes: x where any voxel is above the threshold, else a dot."""

    def mask(data: bytes | None, kind: str | None, t: float, size: float) -> str | None:
        if data is None or pd.isna(size) or size < 1:
            return None
        size = int(size)
        n = -(-len(data) // size)
        if kind not in DTYPES or pd.isna(t):
            return "x" * n
        item = np.dtype(DTYPES[kind]).itemsize
        above = np.frombuffer(data, DTYPES[kind], count=len(data) // item) > t
        per = size // item
        whole = len(above) // per
        hit = above[: whole * per].reshape(whole, per).any(1)
        letters = np.where(hit, "x", ".").tolist()
        if whole < n:
            letters.append("x" if above[whole * per :].any() else ".")
        return "".join(letters)

    return pd.Series([mask(*row) for row in zip(image, dtype, threshold, unit, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def _sums_before(sizes: pd.Series) -> pd.Series:
    """The sum of the numbers before each one of a list."""
    return pd.Series([None if n is None else np.cumsum(np.r_[0, n[:-1]]).astype(np.int32) if len(n) else [] for n in sizes], dtype=object)


def _starts(parts: Column) -> Column:
    """Where each of consecutive texts begins."""
    return _sums_before(F.transform(parts, F.length))


def _cuts(most: Column, least: Column) -> Column:
    """The pattern of a run of ``least`` to ``most`` units, by where it ends: with the rest of the image, between
    two blank units, beside one; each first in the upper half, then anywhere; else wherever it is full."""
    least = F.least(F.greatest(least, F.lit(1)), most)
    half = F.greatest(F.floor(most / 2), least)

    def run(low: Column, high: Column) -> Column:
        """``low`` to ``high`` units; nothing where there are none."""
        return F.when(low <= high, F.concat(F.lit("[.x]{"), low.cast("string"), F.lit(","), high.cast("string"), F.lit("}"))).otherwise("(?!)")

    def ending_blank(low: Column) -> Column:
        return F.concat(run(low - 1, most - 1), F.lit(r"\."))

    return F.concat(
        run(F.lit(1), most), F.lit(r"\z|"), ending_blank(half), F.lit(r"(?=\.)|"), ending_blank(half), F.lit("|"), run(half, most), F.lit(r"(?=\.)|"),
        ending_blank(least), F.lit("|"), run(least, most), F.lit(r"(?=\.)|"), run(F.lit(1), most),
    )


def oversized(results: DataFrame, scanners: DataFrame) -> DataFrame:
    """The oversized images, with limit, overlap and the sizes of a voxel, row and slice in bytes."""
    limits = scanners.where("scanner_name is not null").groupBy(F.col("scanner_name").alias("_scanner")).agg(
        F.min("max_image_bytes").alias("_limit"), F.min("overlap_slices").alias("_overlap")
    )
    named = F.regexp_extract("image_path", r"^/*vol/+([^/]+)/", 1)
    kind = F.lower(F.trim("dtype"))
    item = F.when(kind.isin("u16le", "u16be"), 2).otherwise(1)
    return (
        results.select("result_id", "image_path", "scanner_name", "threshold", kind.alias("dtype"), "n_y", "n_x", "signal_image")
        .withColumn("_scanner", F.coalesce("scanner_name", named))
        .join(limits, "_scanner")
        .where(F.octet_length("signal_image") > F.col("_limit"))
        .withColumn("_item", item)
        .withColumn("_row", F.when(F.col("n_x") > 0, F.col("n_x").cast("bigint") * F.col("_item")))
        .withColumn("_slice", F.when(F.col("n_y") > 0, F.col("_row") * F.col("n_y")))
    )


def _consumed(results: DataFrame, scanners: DataFrame) -> DataFrame:
    """The oversized images with ``mask``, ``_unit`` bytes a letter, ``most`` letters of a piece, ``shared`` with the
    piece before, and ``parts``: what each piece consumes of the mask."""
    limit, overlap = F.col("_limit"), F.greatest(F.coalesce("_overlap", F.lit(0)), F.lit(0))
    slice_fits, row_fits = F.col("_slice") <= limit, F.col("_row") <= limit
    unit = F.when(slice_fits, F.col("_slice")).when(row_fits, F.col("_row")).otherwise(F.col("_item"))
    fresh = F.col("most") - F.col("shared")
    # a first piece has nothing to look back on: it may fill the limit and must be as long as what is shared
    pattern = F.concat(F.lit(r"\A(?:"), _cuts(F.col("most"), F.col("shared")), F.lit(")|"), _cuts(fresh, F.lit(0)))
    return (
        oversized(results, scanners).withColumn("_unit", unit)
        .withColumn("most", F.greatest(F.floor(limit / F.col("_unit")), F.lit(1)).cast("int"))
        .withColumn("shared", F.least(F.coalesce((F.col("_slice") / F.col("_unit")).cast("int") * overlap, F.lit(0)), F.col("most") - 1).cast("int"))
        .withColumn("mask", blank_mask("signal_image", "dtype", "threshold", F.col("_unit").cast("double")))
        .withColumn("parts", F.regexp_extract_all("mask", pattern, F.lit(0)))
    )


def blank_runs(results: DataFrame, scanners: DataFrame) -> DataFrame:
    """result_id, z_first, z_last of the longest runs of blank slices that lie between others; -1, -1 for
    an oversized image without any.

    The boundaries of the splitter: what its pieces consume is told apart into blank and other units, blanks on
    both sides of a cut are one run, and a run holds the slices whose units are all blank."""
    runs = F.flatten(F.transform("parts", lambda p: F.regexp_extract_all(p, F.concat(F.lit(r"\.{1,"), F.col("most").cast("string"), F.lit("}|x{1,"), F.col("most").cast("string"), F.lit("}")), F.lit(0))))
    per, n = F.expr("_slice div _unit"), F.size("runs")
    blank = lambda i: F.get("runs", i).startswith(".")
    edge = lambda i: ~F.coalesce(blank(i), F.lit(False))
    at = F.sequence(F.lit(0), n - 1)
    first = F.transform(F.filter(at, lambda i: blank(i) & edge(i - 1)), lambda i: F.get("starts", i))
    stop = F.transform(F.filter(at, lambda i: blank(i) & edge(i + 1)), lambda i: F.get("starts", i) + F.length(F.get("runs", i)))
    slices = F.ceil(F.length("mask") / per)
    spans = F.filter(
        F.zip_with(first, stop, lambda a, b: F.struct(F.ceil(a / per).cast("int").alias("z_first"), F.when(b == F.length("mask"), slices - 1).otherwise(F.floor(b / per) - 1).cast("int").alias("z_last"))),
        lambda s: (s["z_first"] > 0) & (s["z_first"] <= s["z_last"]) & (s["z_last"] < slices - 1),
    )
    none = F.array(F.struct(F.lit(-1).alias("z_first"), F.lit(-1).alias("z_last")))
    return (
        _consumed(results, scanners).drop("signal_image").withColumn("runs", runs).withColumn("starts", _starts(F.col("runs")))
        .select("result_id", F.inline(F.when(F.size(spans) > 0, spans).otherwise(none)))
        .distinct()
    )


def split_oversized(results: DataFrame, scanners: DataFrame) -> DataFrame:
    """image_path, result_id, piece, n_pieces, first_byte, n_bytes, z_first, z_last, cut (how the piece
    ends: end, blank, forced) and the ``data`` of every piece."""
    pieces = (
        _consumed(results, scanners).withColumn("starts", _starts(F.col("parts")))
        .select("*", F.size("parts").alias("n_pieces"), F.posexplode(F.arrays_zip("parts", "starts")).alias("piece", "p"))
    )
    start, end = F.col("p.starts"), F.col("p.starts") + F.length("p.parts")
    first = F.greatest(start - F.col("shared"), F.lit(0)).cast("bigint") * F.col("_unit")
    stop = F.least(end.cast("bigint") * F.col("_unit"), F.octet_length("signal_image").cast("bigint"))
    beside = F.substring(F.col("mask"), end, F.lit(2)).contains(".")
    return pieces.select(
        "image_path", "result_id", "piece", "n_pieces", first.alias("first_byte"), (stop - first).alias("n_bytes"),
        F.floor(first / F.col("_slice")).cast("int").alias("z_first"), F.floor((stop - 1) / F.col("_slice")).cast("int").alias("z_last"),
        F.when(F.col("piece") == F.col("n_pieces") - 1, "end").when(beside, "blank").otherwise("forced").alias("cut"),
        F.substring(F.col("signal_image"), (first + 1).cast("int"), (stop - first).cast("int")).alias("data"),
    )
