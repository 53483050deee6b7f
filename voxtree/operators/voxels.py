"""Volumes as long tables (z, y, x, v), one row for each voxel of a dense volume.

``keys`` names further columns that tell volumes apart. Neighbourhoods are built one axis after the
other with windows along lines of voxels, so that a 26-neighbour stencil moves each row three times
instead of multiplying it by 26. Grey levels are functions of histograms, of which a volume has one row
per level. Null values of v count as nothing; voxels that are missing count as outside.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtree.kernels.levels import background_level, refined_level, triangle_level, two_class_level
from voxtree.operators.graphs import connected_components

AXES = ("z", "y", "x")


# ---- lines of voxels ----


def _beside(column: Column, axis: str, step: int, keys: Sequence[str]) -> Column:
    """The value of the neighbour along an axis, null outside."""
    line = Window.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis)
    move = F.lead if step > 0 else F.lag
    return F.when(move(axis, 1).over(line) == F.col(axis) + step, move(column, 1).over(line))


def _along(vox: DataFrame, name: str, axis: str, keys: Sequence[str], how: Callable[..., Column], out: str) -> DataFrame:
    return vox.withColumn(out, how(F.col(name), _beside(F.col(name), axis, -1, keys), _beside(F.col(name), axis, 1, keys)))


def _sum3(a: Column, b: Column, c: Column) -> Column:
    return a + F.coalesce(b, F.lit(0)) + F.coalesce(c, F.lit(0))


def box(vox: DataFrame, name: str, how: Callable[..., Column], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``how`` (of three columns) over the 3 x 3 x 3 box around each voxel."""
    step = vox.withColumn(out, F.col(name))
    for axis in ("x", "y", "z"):
        step = _along(step, out, axis, keys, how, out)
    return step


# ---- grey levels ----


def histogram(vox: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin (whole level), n and n_above (values of the bin that are not whole)."""
    level = F.floor("v").cast("bigint")
    return vox.where("v is not null").groupBy(*keys, level.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") > level, 1)).alias("n_above"), F.max("v").cast("double").alias("top")
    )


def dense_histogram(vox: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """bin and n with the empty levels between the first and the last."""
    h = histogram(vox, keys).select(*keys, "bin", "n")
    ends = h.groupBy(*keys).agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    bins = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("bin"))
    return bins.join(h, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def _counts(pdf: pd.DataFrame, name: str = "n") -> tuple[np.ndarray, int]:
    low = int(pdf["bin"].min())
    out = np.zeros(int(pdf["bin"].max()) - low + 1, np.int64)
    out[pdf["bin"].to_numpy() - low] = pdf[name].to_numpy()
    return out, low


def _per_volume(table: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], dict], fields: str) -> DataFrame:
    """One row of results for each volume from its histogram rows."""
    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), fields])
    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys} | function(pdf)
        return pd.DataFrame([row])[[*keys, *names]]

    return table.groupBy(*keys).applyInPandas(run, schema)


def background(vox: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, level, lowest: the common background level and the lowest grey level."""
    return _per_volume(histogram(vox, keys), keys, lambda p: {"level": background_level(*_counts(p)), "lowest": int(p["bin"].min())}, "level bigint, lowest bigint")


def _with_scalars(vox: DataFrame, scalars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row of scalars per volume; without keys that is a single row."""
    return vox.join(scalars, list(keys)) if keys else vox.join(F.broadcast(scalars.limit(1)))


def subtract_background(vox: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """v minus the background level, not below 0 where the level is above the lowest."""
    rest = F.col("v") - F.col("level")
    joined = _with_scalars(vox, background(vox, keys), keys)
    return joined.withColumn("v", F.when(F.col("level") <= F.col("lowest"), rest).otherwise(F.greatest(rest, F.lit(0)))).drop("level", "lowest")


def threshold_mask(vox: DataFrame, threshold: float) -> DataFrame:
    """m: 1 where v is above the threshold, else 0."""
    if threshold < 0:
        raise ValueError("a threshold is not negative")
    return vox.withColumn("m", F.coalesce((F.col("v") > threshold).cast("int"), F.lit(0)))


def foreground_ratio(vox: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """The share of voxels above a threshold."""
    return vox.groupBy(*keys).agg(F.avg((F.col("v") > threshold).cast("double")).alias("ratio"))


def triangle_threshold(vox: DataFrame, keys: Sequence[str] = (), cap_at_max: bool = True) -> DataFrame:
    """threshold by the triangle rule; the peak and tail are sought below the highest level if ``cap_at_max``."""

    def level(pdf: pd.DataFrame) -> dict:
        counts, low = _counts(pdf)
        return {"threshold": triangle_level(counts, low, low + len(counts) - 2 if cap_at_max else None)}

    return _per_volume(histogram(vox, keys), keys, level, "threshold double")


def two_class_threshold(vox: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """threshold, below and above: the level between two classes and the classes' means."""
    return _per_volume(
        histogram(vox, keys), keys, lambda p: dict(zip(("threshold", "below", "above"), map(float, two_class_level(*_counts(p))), strict=True)), "threshold double, below double, above double"
    )


def refined_threshold(vox: DataFrame, source: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """threshold: the triangle level of ``source`` (v), raised by the shares of ``vox`` above it."""
    image = histogram(vox, keys).withColumn("of", F.lit("image"))
    both = image.unionByName(histogram(source, keys).withColumn("of", F.lit("source")))

    def level(pdf: pd.DataFrame) -> dict:
        image, values = pdf[pdf["of"] == "image"], pdf[pdf["of"] == "source"]
        if not len(values):
            return {"threshold": None}
        total = image["n"].sum()

        def above(t: float) -> float:
            return float((image["n"] * (image["bin"] > t)).sum() + (image["n_above"] * (image["bin"] == t)).sum()) / total

        counts, low = _counts(values)
        if len(counts) == 1:
            return {"threshold": max(float(values["top"].max()) - 1, 0.0)}
        first = triangle_level(counts, low, int(values["top"].max()) - 1)
        return {"threshold": refined_level(first, above, counts, low, float(values["top"].max()))}

    return _per_volume(both, keys, level, "threshold double")


# ---- stencils ----


def local_maxima(vox: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels above 0, not below any later and above every earlier one of their 26 neighbours."""
    rows = _along(vox, "v", "x", keys, F.greatest, "_row")
    planes = _along(rows, "_row", "y", keys, F.greatest, "_plane")
    y_before, y_after = _beside(F.col("_row"), "y", -1, keys), _beside(F.col("_row"), "y", 1, keys)
    x_before, x_after = _beside(F.col("v"), "x", -1, keys), _beside(F.col("v"), "x", 1, keys)
    z_before, z_after = _beside(F.col("_plane"), "z", -1, keys), _beside(F.col("_plane"), "z", 1, keys)
    beside = planes.withColumns({"_e1": x_before, "_l1": x_after, "_e2": y_before, "_l2": y_after}).withColumns({"_e3": z_before, "_l3": z_after})
    later, earlier = F.greatest("_l1", "_l2", "_l3"), F.greatest("_e1", "_e2", "_e3")
    keep = (F.col("v") > 0) & F.coalesce(F.col("v") >= later, F.lit(True)) & F.coalesce(F.col("v") > earlier, F.lit(True))
    return beside.where(keep).select(*vox.columns)


def _raster_id(vox: DataFrame, keys: Sequence[str]) -> Column:
    """A number for each voxel of all volumes in raster order, unique within a volume."""
    return (F.col("z").cast("bigint") * 2**40) + (F.col("y").cast("bigint") * 2**20) + F.col("x")


def _links(voxels: DataFrame, keys: Sequence[str], reach: int, extra: Column | None = None) -> DataFrame:
    """Pairs (keys, u, v) of listed voxels that are neighbours, by later neighbours only."""
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and sum(map(abs, o)) <= reach]
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in offsets])
    names = list(keys) + ["_val"]
    base = voxels.select(*keys, *AXES, "_id", (extra if extra is not None else F.lit(0)).alias("_val"))
    far = base.select(*keys, F.col("_id").alias("u"), "_val", *[F.col(a).alias(f"_{a}") for a in AXES], F.inline(steps))
    far = far.select(*names, "u", *[(F.col(f"_{a}") + F.col(f"d{a}")).alias(a) for a in AXES])
    return far.join(base.withColumnRenamed("_id", "v"), [*names, *AXES]).select(*keys, "u", "v")


def components(mask: DataFrame, keys: Sequence[str] = (), neighbours: int = 26) -> DataFrame:
    """The voxels with m = 1 and ``label``: the raster number of the first voxel of their component."""
    on = mask.where("m = 1").withColumn("_id", _raster_id(mask, keys))
    found = connected_components(on.select(*keys, F.col("_id").alias("node")), _links(on, keys, {6: 1, 18: 2, 26: 3}[neighbours]), keys)
    return on.join(found.withColumnRenamed("node", "_id"), [*keys, "_id"]).drop("_id").withColumnRenamed("component", "label")


def plateau_maxima(vox: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first voxel of each plateau of equal non-zero values that no 18-neighbour exceeds."""
    # the 18 neighbours are those of the three planes through a voxel
    high = None
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        plane = _along(_along(vox, "v", a, keys, F.greatest, "_h"), "_h", b, keys, F.greatest, f"_p{a}{b}").drop("_h")
        part = plane.select(*keys, *AXES, f"_p{a}{b}")
        high = part if high is None else high.join(part, [*keys, *AXES])
    beaten = F.greatest("_pxy", "_pxz", "_pyz") > F.col("v")
    filled = vox.join(high, [*keys, *AXES]).where("v <> 0").withColumn("_beaten", beaten | (F.col("v") < 0)).withColumn("_id", _raster_id(vox, keys))
    zones = connected_components(filled.select(*keys, F.col("_id").alias("node")), _links(filled, keys, 2, F.col("v")), keys)
    marked = filled.join(zones.withColumnRenamed("node", "_id"), [*keys, "_id"])
    lost = marked.groupBy(*keys, "component").agg(F.max("_beaten").alias("_lost")).where("not _lost").withColumnRenamed("component", "_id")
    return marked.where("_id = component").join(lost, [*keys, "_id"], "left_semi").select(*vox.columns)


def neighbour_counts(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n_on and n_there: true voxels, and voxels at all, among the 26 neighbours."""
    counted = box(box(mask.withColumn("_one", F.lit(1)), "m", _sum3, "_on", keys), "_one", _sum3, "_there", keys)
    return counted.withColumns({"n_on": F.col("_on") - F.col("m"), "n_there": F.col("_there") - 1}).drop("_one", "_on", "_there")


def connectivity_filter(mask: DataFrame, least: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """m stays where at least ``least`` of 26 neighbours are true, in proportion at the borders."""
    return neighbour_counts(mask, keys).withColumn("m", F.when((F.col("m") == 1) & (F.col("n_on") * 26 >= least * F.col("n_there")), 1).otherwise(0)).drop("n_on", "n_there")


def dilate(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """3 x 3 x 3 dilation; outside is false."""
    return box(mask, "m", F.greatest, "m", keys)


def erode(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """3 x 3 x 3 erosion; outside is true."""
    return box(mask, "m", F.least, "m", keys)


def closing(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dilation, then erosion."""
    return erode(dilate(mask, keys), keys)


def opening(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Erosion, then dilation."""
    return dilate(erode(mask, keys), keys)


def squared_distance(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """d2: exact squared distance to the nearest false voxel or the border just outside."""
    line = Window.partitionBy(*keys, "z", "y").orderBy("x")
    off = F.when(F.col("m") == 0, F.col("x"))
    before = F.coalesce(F.last(off, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.first(off, True).over(line.rowsBetween(0, Window.unboundedFollowing)), F.max("x").over(whole) + 1)
    d = mask.withColumn("d2", F.pow(F.least(F.col("x") - before, after - F.col("x")), 2).cast("bigint"))
    for axis in ("y", "z"):
        others = [*keys, *[a for a in AXES if a != axis]]
        lines = d.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(axis, "d2", "m"))).alias("line"))
        n = F.size("line")
        nearest = F.transform(
            "line",
            lambda p: F.struct(  # noqa: B023
                p[axis].alias(axis), p["m"].alias("m"),  # noqa: B023
                F.least(
                    F.array_min(F.transform("line", lambda q: q["d2"] + (q[axis] - p[axis]) * (q[axis] - p[axis]))),  # noqa: B023
                    F.pow(F.least(p[axis] + 1, n - p[axis]), 2).cast("bigint"),  # noqa: B023
                ).alias("d2"),
            ),
        )
        d = lines.select(*others, F.inline(nearest))
    return d.select(*keys, *AXES, "m", "d2")


def interior(vox: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels on no face of a volume of the given (z, y, x) shape."""
    keep = F.lit(True)
    for a, n in zip(AXES, shape, strict=True):
        keep &= F.col(a).between(1, n - 2)
    return vox.where(keep)


def projection(vox: DataFrame, keys: Sequence[str] = (), log: bool = False) -> DataFrame:
    """y, x and the largest value over z, as log(1 + v) of values above 0 if ``log``."""
    top = F.max("v")
    return vox.groupBy(*keys, "y", "x").agg((F.log1p(F.greatest(top, F.lit(0)).cast("double")) if log else top).alias("v"))


# ---- samples ----


def nearest_sample(vox: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (px, py, pz) with s: the value of the nearest voxel, null outside."""
    at = points.select("*", *[F.expr(f"cast(p{a} + 0.5 as int)").alias(f"_{a}") for a in AXES])
    here = vox.select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col("v").cast("double").alias("s"))
    return at.join(here, [f"_{a}" for a in AXES], "left").drop(*[f"_{a}" for a in AXES])


def trilinear_sample(vox: DataFrame, points: DataFrame, id_column: str) -> DataFrame:
    """``id_column`` and s: the blend of the eight voxels around (px, py, pz), null if one is outside."""
    corners = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in itertools.product((0, 1), repeat=3)])
    at = points.select(id_column, *[F.floor(f"p{a}").cast("int").alias(f"b{a}") for a in AXES], *[(F.col(f"p{a}") - F.floor(f"p{a}")).alias(f"f{a}") for a in AXES])
    eight = at.select("*", F.inline(corners))
    weight = F.lit(1.0)
    for a in AXES:
        weight = weight * F.when(F.col(f"d{a}") == 1, F.col(f"f{a}")).otherwise(1 - F.col(f"f{a}"))
    eight = eight.select(id_column, weight.alias("w"), *[(F.col(f"b{a}") + F.col(f"d{a}")).alias(a) for a in AXES])
    hit = eight.join(vox.select(*AXES, F.col("v").cast("double").alias("v")), list(AXES), "left")
    return hit.groupBy(id_column).agg(F.when(F.count("v") == 8, F.sum(F.col("w") * F.col("v"))).alias("s"))


def weighted_centroid(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mean of px, py, pz weighted with s; null where the weights add up to 0."""
    total = F.sum("s")
    return samples.where("s is not null and not isnan(s)").groupBy(*keys).agg(*[F.when(total != 0, F.sum(F.col("s") * F.col(f"p{a}")) / total).alias(f"c{a}") for a in ("x", "y", "z")])


def template_scores(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of samples s with weights w: dot, mean of s where w > 0 (0 if none), where w < 0, and correlation.
    Missing samples are skipped in sums, while the means of the correlation divide by all of them."""
    s = F.when(~F.isnan("s"), F.col("s"))
    n = F.count(F.lit(1))
    base = samples.select(*keys, s.alias("s"), "w")
    means = base.groupBy(*keys).agg((F.sum("s") / n).alias("ms"), (F.sum(F.when(F.col("s").isNotNull(), F.col("w"))) / n).alias("mw"))
    both = base.join(means, list(keys)).where("s is not null")
    ds, dw = F.col("s") - F.col("ms"), F.col("w") - F.col("mw")
    spread = F.sum(ds * ds) * F.sum(dw * dw)
    return both.groupBy(*keys).agg(
        F.sum(F.col("s") * F.col("w")).alias("dot"), F.coalesce(F.avg(F.when(F.col("w") > 0, F.col("s"))), F.lit(0.0)).alias("mean_inside"),
        F.coalesce(F.avg(F.when(F.col("w") < 0, F.col("s"))), F.lit(0.0)).alias("mean_outside"),
        F.when(spread > 0, F.sum(ds * dw) / F.sqrt(spread)).otherwise(0.0).alias("correlation"),
    )


# ---- graphs and shapes of voxels ----


def maximum_filter(vox: DataFrame, offsets: Sequence[tuple[int, int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Voxels above 0 and above all of the listed (z, y, x) neighbours that there are. For any footprint: each voxel
    is sent to as many places as it has offsets, combined on the map side."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in offsets])
    sent = vox.select(*keys, *[F.col(a).alias(f"_{a}") for a in AXES], "v", F.inline(steps)).select(*keys, *[(F.col(f"_{a}") - F.col(f"d{a}")).alias(a) for a in AXES], "v")
    best = sent.groupBy(*keys, *AXES).agg(F.max("v").alias("_best"))
    return vox.join(best, [*keys, *AXES], "left").where((F.col("v") > 0) & (F.col("_best").isNull() | (F.col("v") > F.col("_best")))).select(*vox.columns)


def lattice_edges(vox: DataFrame, threshold: float, scale: float, keys: Sequence[str] = ()) -> DataFrame:
    """u < v, w: links of all voxels to their later 26 neighbours with the cost of the way between."""
    from voxtree.functions.geometry import voxel_weight

    base = vox.select(*keys, *AXES, "v", _raster_id(vox, keys).alias("_id"))
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
    steps = F.array(*[F.struct(F.lit(float(sum(map(abs, o))) ** 0.5).alias("step"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in offsets])
    far = base.select(*keys, F.col("_id").alias("u"), F.col("v").alias("a"), *[F.col(c).alias(f"_{c}") for c in AXES], F.inline(steps))
    far = far.select(*keys, "u", "a", "step", *[(F.col(f"_{c}") + F.col(f"d{c}")).alias(c) for c in AXES])
    met = far.join(base.select(*keys, *AXES, F.col("_id").alias("v"), F.col("v").alias("b")), [*keys, *AXES])
    return met.select(*keys, "u", "v", voxel_weight(F.col("step"), F.col("a"), F.col("b"), F.lit(threshold), F.lit(scale)).alias("w"))


def face_voxels(vox: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels on a face, with ``faces``: on how many (1 face, 2 edge, 3 corner). Every dimension is at least two."""
    if min(shape) < 2:
        raise ValueError("faces need two voxels along every axis")
    on = sum((F.col(a).isin(0, n - 1).cast("int") for a, n in zip(AXES, shape, strict=True)), F.lit(0))
    return vox.withColumn("faces", on).where("faces > 0")


def segment_voxels(segments: DataFrame) -> DataFrame:
    """id, x, y, z: the distinct whole points of segments (r, s, len, theta, psi, sx, sy, sz)."""
    from voxtree.functions.geometry import rotate

    rx, ry = F.greatest(F.col("r") * F.col("s"), F.lit(1e-8)), F.greatest(F.col("r"), F.lit(1e-8))
    reach = lambda c: F.sequence(-F.ceil(c).cast("int"), F.ceil(c).cast("int"))
    disc = segments.withColumn("_x", F.explode(reach(rx))).withColumn("_y", F.explode(reach(ry))).where(F.pow(F.col("_x") / rx, 2) + F.pow(F.col("_y") / ry, 2) <= 1)
    full = disc.withColumn("_z", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("len") - 1, F.lit(0))).cast("int"))))
    local = tuple(F.col(c).cast("double") for c in ("_x", "_y", "_z"))
    world = rotate(local, F.col("theta"), F.col("psi"))
    return full.select("id", *[F.rint(w + F.col(f"s{a}")).cast("int").alias(a) for a, w in zip("xyz", world, strict=True)]).distinct()


def path_lengths(points: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """keys and the length of the line through px, py, pz in order."""
    line = Window.partitionBy(*keys).orderBy(order)
    step = sum((F.pow(F.col(f"p{a}") - F.lag(f"p{a}").over(line), 2) for a in ("x", "y", "z")), F.lit(0.0))
    return points.withColumn("_d", F.sqrt(step)).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))
