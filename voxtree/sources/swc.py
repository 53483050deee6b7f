"""SWC and ESWC files as tables, and tables as SWC files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The node types that each reading mode keeps (all, axon, dendrites, their parts).
MODES = {"t": None, "a": (1, 2), "d": (1, 3, 4), "da": (1, 4), "db": (1, 3)}
COLUMNS = ("node_id", "node_type", "x", "y", "z", "radius", "parent_id")
_CASTS = ("int", "int", "float", "float", "float", "float", "int")


def read_swc(spark: SparkSession, paths: str | Sequence[str], mode: str = "t", scale: Sequence[float] = (1.0, 1.0, 1.0), extended: bool = False) -> DataFrame:
    """One row for each node: path, row (order in the file), the seven columns and, of extended files, the
    further columns as an array of numbers in ``extra``.

    Lines that begin with # or i and empty lines are skipped. Positions are multiplied with ``scale`` and
    radii with the product of its first two. A line with fewer than seven columns, or with text where a
    number must be, raises an error when the rows are read.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("row", "line")
    )
    kept = lines.where(~F.col("line").rlike(r"^[#i]") & (F.trim("line") != ""))
    parts = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    rows = kept.select("path", "row", parts.alias("p"))
    enough = F.when(F.size("p") >= 7, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("fewer than seven columns in "), F.col("path"), F.lit(" line "), (F.col("row") + 1).cast("string"))))
    rows = rows.select("path", "row", enough.alias("p"))
    values = [F.col("p")[i].cast(t).alias(n) for i, (n, t) in enumerate(zip(COLUMNS, _CASTS, strict=True))]
    extra = [F.transform(F.slice("p", 8, F.greatest(F.size("p") - 7, F.lit(0))), lambda v: v.cast("double")).alias("extra")] if extended else []
    nodes = rows.select("path", "row", *values, *extra)
    if MODES[mode] is not None:
        nodes = nodes.where(F.col("node_type").isin(*MODES[mode]))
    factors = dict(zip("xyz", scale, strict=True)) | {"radius": scale[0] * scale[1]}
    return nodes.withColumns({c: (F.col(c) * k).cast("float") for c, k in factors.items() if k != 1})


def number_text(column: str | Column) -> Column:
    """Three decimals without trailing zeros; halves go to the even digit, small negatives to -0."""
    c = (F.col(column) if isinstance(column, str) else column).cast("float").cast("double")  # as such files hold them
    text = F.regexp_replace(F.bround(c.cast("decimal(38,12)"), 3).cast("decimal(38,3)").cast("string"), r"\.?0+$", "")
    return F.when((c < 0) & (text == "0"), "-0").otherwise(text)


def swc_lines(nodes: DataFrame) -> Column:
    """The line of each node."""
    return F.concat_ws(
        " ", F.col("node_id").cast("string"), F.coalesce("node_type", F.lit(0)).cast("string"), *[number_text(c) for c in ("x", "y", "z", "radius")], F.coalesce("parent_id", F.lit(-1)).cast("string")
    )


def write_swc(nodes: DataFrame, directory: str, key: str = "neuron_id", order: str = "node_id") -> None:
    """One folder ``key=value`` for each skeleton with a single text file of its lines in ``order``."""
    header = F.lit("# id type x y z r pid")
    rows = nodes.select(key, F.col(order).cast("bigint").alias("_at"), swc_lines(nodes).alias("value"))
    heads = nodes.select(key).distinct().select(key, F.lit(-(2**62)).alias("_at"), header.alias("value"))
    both = heads.unionByName(rows)
    both.withColumn("_task", F.xxhash64(key)).repartition("_task").sortWithinPartitions(key, "_at").select(key, "value").write.mode("errorifexists").partitionBy(key).text(directory)


def swc_text(nodes: Sequence[Sequence[float]]) -> str:
    """The text of one skeleton given as rows of the seven columns."""

    def short(v: float) -> str:
        return f"{v:.3f}".rstrip("0").rstrip(".")

    body = [f"{int(i)} {int(t)} {short(x)} {short(y)} {short(z)} {short(r)} {int(p)}" for i, t, x, y, z, r, p in nodes]
    return "\n".join(["# id type x y z r pid", *body]) + "\n"
