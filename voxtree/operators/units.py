"""Lengths recorded in several units, in micrometres.

Which unit a file is in has two witnesses. The history of its source (the scanner), in order of time,
is segmented by an exact penalised changepoint search over the logarithm of the files' radii, where the
level of a segment differs from the source's own in micrometres by a known factor (1000, 1/1000, or the voxel
size): each segment is marked with the unit to reverse. The search is a shortest path over files and
units; ranges of the history are reduced to small cost matrices in parallel, the matrices are chained,
and every range is then traced back between its two fixed ends, so that no task ever holds a whole
history. What is stated of a file counts: what its own text says, else the unit text, else the source's
default. So the search is made twice at once: by the numbers alone (``history_unit``, so that files whose
numbers contradict their statement can be found), and through the stated units as fixed points, the
level of micrometres being that of the source's stated files. The second decides each file of which
nothing is stated.

Defined results: a null or empty source is the one named in the image path; unreadable statements are
none; of several statements in one file the first counts, values that carry units come after comments;
a file without nodes, or with no positive radius, has no say in its source's history and takes the unit
of the segment it lies in; a source of few stated files has the level of micrometres that the numbers
give; repeated rows of a neuron give one row (the largest values). Lengths whose unit is unknown stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtree.operators.swc_lines import _FIELD, _S, LENGTH_UNIT
from voxtree.session import materialize

UNITS = ("um", "nm", "mm", "voxel")
_UM = r"(?:[uµμ]m|microns?|micromet(?:er|re)s?)"
_VOXEL = r"(?:vox(?:els?)?|px|pixels?)"
_ANY = rf"({LENGTH_UNIT}|{_VOXEL})(?![a-zµμ0-9])"
_NUM = r"[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?"
#: What a comment must say for its unit to be that of the coordinates; a number is the length of one unit.
STATEMENT = (
    rf"(?i)(?:\b1\s+units?\s*(?:=|:|is|are)\s*({_NUM})\s*|\b(?:length_units?|units?)\s*(?:=|:|is|are|in)?\s*|\bcoordinates\s+(?:are\s+)?(?:given\s+)?in\s+"
    rf"|\bradii\s+(?:are\s+)?(?:given\s+)?in\s+|\bradius\s+are\s+(?:in\s+)?|\ball\s+lengths\s+(?:are\s+)?(?:in\s+)?|\bpositions\s+are\s+(?:in\s+)?|\bindex\s+space[^()\n]*\()\s*{_ANY}"
)
#: Micrometres in one unit.
_FACTOR = {"um": 1.0, "nm": 1e-3, "mm": 1e3}


def unit_name(text: Column) -> Column:
    """um, nm, mm or voxel for any spelling; else null."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike(rf"\A{_UM}\z"), "um")
        .when(t.rlike(r"\A(?:nm|nanomet(?:er|re)s?)\z"), "nm")
        .when(t.rlike(r"\A(?:mm|millimet(?:er|re)s?)\z"), "mm")
        .when(t.rlike(rf"\A{_VOXEL}\z"), "voxel")
    )


def stated_unit(text: Column) -> Column:
    """The unit that the first statement in a comment text gives."""
    unit = unit_name(F.regexp_extract(text, STATEMENT, 2))
    k = F.regexp_extract(text, STATEMENT, 1).try_cast("double")
    um = k * F.when(unit == "um", 1.0).when(unit == "nm", 1e-3).when(unit == "mm", 1e3)
    near = lambda v: F.abs(F.log10(um) - v) < 1e-6
    scaled = F.when(near(0), "um").when(near(-3), "nm").when(near(3), "mm")
    return F.when(k.isNull() | (unit == "voxel"), unit).otherwise(scaled)


def _line_evidence(lines: DataFrame) -> DataFrame:
    """Of each file in raw lines: the first statement, the unit most values carry, and its radii."""
    raw = F.col("raw_line")
    comment = F.regexp_extract(raw, r'(?s)\A(?:"[^"]*+"|[^"#]++)*+#(.*)\z', 1)
    says = F.when(raw.contains("#"), stated_unit(comment))
    value = rf'(?s)\A{_S}*+(?:{_FIELD}{_S}++){{5}}"?+([0-9.eE+-]++){_S}*+([a-zA-Zµμ]*)'
    radius = F.regexp_extract(raw, value, 1).try_cast("double")
    unit = F.when(F.length(F.regexp_extract(raw, value, 2)) > 0, unit_name(F.regexp_extract(raw, value, 2)))
    rows = lines.where("neuron_id is not null and raw_line is not null").select(
        "neuron_id", "line_no", says.alias("says"), F.when((radius > 0) & (radius < float("inf")), F.log10(radius)).alias("log_r"), unit.alias("unit")
    )
    counts = [F.count(F.when(F.col("unit") == u, 1)).alias(f"n_{u}") for u in UNITS]
    found = rows.groupBy("neuron_id").agg(
        F.min(F.when(F.col("says").isNotNull(), F.struct("line_no", "says"))).alias("first"), F.sum("log_r").alias("sum_log"), F.count("log_r").alias("n"), *counts
    )
    most = F.greatest(*[F.col(f"n_{u}") for u in UNITS])
    carried = F.coalesce(*[F.when((F.col(f"n_{u}") == most) & (most > 0), u) for u in UNITS])
    return found.select("neuron_id", F.coalesce(F.col("first.says"), carried).alias("line_says"), "sum_log", "n")


def _node_evidence(nodes: DataFrame) -> DataFrame:
    r = F.col("radius").cast("double")
    log_r = F.when((r > 0) & (r < float("inf")), F.log10(r))
    return nodes.where("neuron_id is not null").groupBy("neuron_id").agg(F.sum(log_r).alias("sum_log"), F.count(log_r).alias("n"))


def resolution_parts(text: Column, default: Column) -> dict[str, Column]:
    """``unit`` (um, nm, mm, px_per_um, mixed) and ``size``: micrometres per voxel in x, y and z.

    Reads three numbers in x, y, z order unless named otherwise, or two as lateral and axial; each in
    the unit behind it, else the only one in the text, else the default.
    """
    t = F.lower(text)
    found = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(rf"({LENGTH_UNIT})(?![a-zµμ])"), F.lit(1)), unit_name))
    inverse = t.rlike(rf"{_VOXEL}\s*(?:/|per)\s*{LENGTH_UNIT}|[0-9]\s*/\s*{LENGTH_UNIT}(?![a-zµμ])")
    unit = F.when(inverse, "px_per_um").when(F.size(found) == 0, F.lower(F.trim(default))).when(F.size(found) == 1, found[0]).otherwise("mixed")
    one = F.when(unit != "mixed", unit)
    pair = rf"({_NUM})\s*({LENGTH_UNIT}(?![a-zµμ]))?"
    numbers = F.transform(F.regexp_extract_all(t, F.lit(pair), F.lit(1)), lambda v: v.try_cast("double"))
    units = F.transform(F.regexp_extract_all(t, F.lit(pair), F.lit(2)), unit_name)
    micro = F.zip_with(
        numbers, units,
        lambda v, u: F.when(inverse | (F.coalesce(u, one) == "px_per_um"), F.when(v > 0, 1 / v)).otherwise(
            v * F.when(F.coalesce(u, one) == "um", 1.0).when(F.coalesce(u, one) == "nm", 1e-3).when(F.coalesce(u, one) == "mm", 1e3)
        ),
    )
    backwards = t.rlike(r"z\s*[=:]?\s*[0-9.]+[^xyz]*y\s*[=:]?\s*[0-9.]+[^xyz]*x\s*[=:]?\s*[0-9.]")
    size = (
        F.when(F.size(micro) == 3, F.when(backwards, F.reverse(micro)).otherwise(micro))
        .when(F.size(micro) == 2, F.array(micro[0], micro[0], micro[1]))
        .when(F.size(micro) == 1, F.array(micro[0], micro[0], micro[0]))
    )
    return {"unit": F.when(text.isNotNull() & (F.trim(text) != ""), unit), "size": size}


# ---- the history of a source ----

_STATES = len(UNITS)


def _costs(y: np.ndarray, voxel: np.ndarray, base: float, spread: float) -> np.ndarray:
    """Cost of each file under each unit; a file without radii costs nothing under any."""
    levels = np.stack([np.full(len(y), base), np.full(len(y), base + 3), np.full(len(y), base - 3), base - voxel], 1)
    cost = ((y[:, None] - levels) / spread) ** 2 / 2
    cost[:, 3] = np.where(np.isnan(voxel), np.inf, cost[:, 3])
    cost[np.isnan(y)] = 0
    return cost


def _through(cost: np.ndarray, stated: pd.Series) -> np.ndarray:
    """The costs of paths through the stated units."""
    cost = cost.copy()
    for state, unit in enumerate(UNITS):
        rows = (stated == unit).to_numpy()
        cost[rows] = np.inf
        cost[rows, state] = 0
    return cost


def _best_path(cost: np.ndarray, penalty: float, first: int | None, last: int | None) -> np.ndarray:
    """The exact minimum of costs plus penalties for changes, between given ends."""
    n = len(cost)
    step = penalty * (1 - np.eye(_STATES))
    total = cost[0].copy()
    if first is not None:
        total[np.arange(_STATES) != first] = np.inf
    back = np.zeros((n, _STATES), int)
    for i in range(1, n):
        way = total[:, None] + step
        back[i] = way.argmin(0)
        total = way.min(0) + cost[i]
    state = np.empty(n, int)
    state[-1] = total.argmin() if last is None else last
    for i in range(n - 1, 0, -1):
        state[i - 1] = back[i, state[i]]
    return state


def _ends(cost: np.ndarray, penalty: float) -> np.ndarray:
    """Least cost through all files for each pair of first and last unit."""
    step = penalty * (1 - np.eye(_STATES))
    way = np.where(np.eye(_STATES, dtype=bool), cost[0][:, None], np.inf)
    for row in cost[1:]:
        way = (way[:, :, None] + step[None]).min(1) + row
    return way


def segment_history(files: DataFrame, least_spread: float = 0.01, penalty: float = 4.0, least_stated: int = 3) -> DataFrame:
    """``files`` (source, at, neuron_id, level, voxel, and stated where units are) with ``history_unit`` and ``unit``.

    level: mean log10 of the radii as recorded; voxel: log10 of the voxel size in micrometres.
    ``history_unit`` is what the numbers alone say, ``unit`` what they say given the stated units; from
    ``least_stated`` files on, these give the source's level of micrometres.
    ``penalty`` is the cost of a change, in units of half a squared deviation; the usual deviation of a
    file's level is estimated from the files (median absolute deviation), at least ``least_spread``.
    """
    if "stated" not in files.columns:
        files = files.withColumn("stated", F.lit(None).cast("string"))
    middle = lambda v: F.percentile_approx(v, 0.5)
    # what remains of a source's levels without powers of 1000 is that of micrometres
    rest = lambda v: v - 3 * F.round(v / 3)
    level, stated = F.col("level"), F.col("stated")
    told = level - F.when(stated == "um", 0).when(stated == "nm", 3).when(stated == "mm", -3).when(stated == "voxel", -F.col("voxel"))
    base = materialize(
        files.groupBy("source").agg(middle(rest(level)).alias("base"), F.when(F.count(told) >= least_stated, middle(told)).alias("told_base"))
        .withColumn("told_base", F.coalesce("told_base", "base"))
    )
    deviation, told_deviation = rest(level) - F.col("base"), F.coalesce(told - F.col("told_base"), rest(level - F.col("told_base")))
    spread = files.join(base, "source").agg(
        (1.48 * middle(F.abs(deviation))).alias("spread"), (1.48 * middle(F.abs(told_deviation))).alias("told_spread")
    )
    cut = materialize(
        files.join(base, "source").join(F.broadcast(spread)).repartitionByRange("source", "at", "neuron_id").withColumn("block", F.spark_partition_id())
    )

    def costs(pdf: pd.DataFrame) -> list[np.ndarray]:
        """By the numbers alone, and through what is stated."""
        y, voxel = pdf["level"].to_numpy(float), pdf["voxel"].to_numpy(float)
        base_, spread, told_base, told_spread = (0.0 if pd.isna(v) else float(v) for v in pdf[["base", "spread", "told_base", "told_spread"]].iloc[0])
        alone = _costs(y, voxel, base_, max(spread, least_spread))
        return [alone, _through(_costs(y, voxel, told_base, max(told_spread, least_spread)), pdf["stated"])]

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "neuron_id"])
        ways = [_ends(c, penalty).ravel().tolist() for c in costs(pdf)]
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "block": [pdf["block"].iloc[0]], "ways": [ways]})

    def fix_ends(ways: list[np.ndarray]) -> list[tuple[int, int]]:
        step, total, back = penalty * (1 - np.eye(_STATES)), None, []
        for way in ways:
            # into the first unit of this range from the last of the one before
            enter = np.zeros(_STATES) if total is None else (total[:, None] + step).min(0)
            source = np.zeros(_STATES, int) if total is None else (total[:, None] + step).argmin(0)
            both = enter[:, None] + way
            back.append((both.argmin(0), source))
            total = both.min(0)
        last, ends = int(total.argmin()), []
        for first_of, source in reversed(back):
            first = int(first_of[last])
            ends.append((first, last))
            last = int(source[first])
        return ends[::-1]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        ends = [fix_ends([np.array(w[k]).reshape(_STATES, _STATES) for w in pdf["ways"]]) for k in range(2)]
        out = pdf[["source", "block"]].copy()
        out["first"], out["last"] = zip(*[([a for a, _ in both], [b for _, b in both]) for both in zip(*ends, strict=True)], strict=True)
        return out

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "neuron_id"])
        ends = zip(pdf["first"].iloc[0], pdf["last"].iloc[0], strict=True)
        alone, given = (np.array(UNITS)[_best_path(c, penalty, int(a), int(b))] for c, (a, b) in zip(costs(pdf), ends, strict=True))
        return pd.DataFrame({"neuron_id": pdf["neuron_id"], "history_unit": alone, "unit": given})

    blocks = cut.groupBy("source", "block").applyInPandas(reduce, "source string, block int, ways array<array<double>>")
    ends = blocks.groupBy("source").applyInPandas(chain, "source string, block int, first array<int>, last array<int>")
    marked = cut.join(ends, ["source", "block"]).groupBy("source", "block").applyInPandas(trace, "neuron_id bigint, history_unit string, unit string")
    return files.join(marked, "neuron_id", "left")


def file_units(neurons: DataFrame, scanners: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """neuron_id, swc_unit, history_unit, stated_by, resolution_unit, voxel_um (x, y, z)."""
    facts = neurons.where("neuron_id is not null").groupBy("neuron_id").agg(
        *[F.max(c).alias(c) for c in ("image_path", "scanner_name", "resolution", "unit_text", "header_text", "traced_at")]
    )
    known = scanners.where("scanner_name is not null").groupBy(F.col("scanner_name").alias("source")).agg(F.max("default_unit").alias("default_unit"), F.max("default_res_unit").alias("default_res_unit"))
    named = F.regexp_extract("image_path", r"^/*vol/+([^/]+)/", 1)
    source = F.coalesce(F.when(F.trim("scanner_name") != "", F.trim("scanner_name")), F.when(named != "", named), F.lit(""))
    evidence = (
        _node_evidence(nodes).withColumn("line_says", F.lit(None).cast("string")).unionByName(_line_evidence(lines))
        .groupBy("neuron_id").agg(F.max("line_says").alias("line_says"), (F.sum("sum_log") / F.sum("n")).alias("level"))
    )
    parts = resolution_parts(F.col("resolution"), F.col("default_res_unit"))
    files = (
        facts.withColumn("source", source).join(known, "source", "left").join(evidence, "neuron_id", "left")
        .select(
            "neuron_id", "source", F.col("traced_at").cast("timestamp").alias("at"), "level", parts["unit"].alias("resolution_unit"), parts["size"].alias("voxel_um"),
            F.coalesce(stated_unit(F.col("header_text")), "line_says").alias("own"), unit_name(F.col("unit_text")).alias("noted"), unit_name(F.col("default_unit")).alias("usual"),
        )
        .withColumn("voxel", F.when(F.col("voxel_um")[0] > 0, F.log10(F.col("voxel_um")[0])))
        .withColumn("stated", F.coalesce("own", "noted", "usual"))
    )
    files = materialize(files)
    marked = segment_history(files)
    return marked.select(
        "neuron_id",
        F.coalesce("stated", "unit").alias("swc_unit"),
        "history_unit",
        F.when(F.col("own").isNotNull(), "file").when(F.col("noted").isNotNull(), "unit_text").when(F.col("usual").isNotNull(), "default").otherwise("history").alias("stated_by"),
        "resolution_unit",
        "voxel_um",
    )


def foreign_units(units: DataFrame) -> DataFrame:
    """neuron_id, quantity (swc, resolution) and unit of all that is not in micrometres."""
    both = F.array(
        F.struct(F.lit("swc").alias("quantity"), F.col("swc_unit").alias("unit")), F.struct(F.lit("resolution").alias("quantity"), F.col("resolution_unit").alias("unit"))
    )
    return units.select("neuron_id", F.inline(both)).where("unit <> 'um'")


def to_micrometres(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """``nodes`` with x_um, y_um, z_um, radius_um. Voxel coordinates count voxels, radii those along x."""
    u = units.select(F.col("neuron_id").alias("_neuron"), F.col("swc_unit").alias("_unit"), F.col("voxel_um").alias("_voxel"))
    factor = F.when(F.col("_unit") == "um", 1.0).when(F.col("_unit") == "nm", 1e-3).when(F.col("_unit") == "mm", 1e3)
    axis = {"x": 0, "y": 1, "z": 2, "radius": 0}
    scaled = [(F.col(f"node.{c}").cast("double") * F.when(F.col("_unit") == "voxel", F.col("_voxel")[i]).otherwise(factor)).alias(f"{c}_um") for c, i in axis.items()]
    held = nodes.select(F.struct(*[c for c in nodes.columns if c not in [f"{a}_um" for a in axis]]).alias("node"))
    return held.join(u, F.col("node.neuron_id") == F.col("_neuron"), "left").select("node.*", *scaled)
