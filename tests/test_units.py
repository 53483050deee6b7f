from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtree.operators import units as u

SCANNER = [("a", "um", "um"), ("b", "nm", "px_per_um"), ("c", None, None), ("a", None, "mm")]


@pytest.mark.parametrize(
    "text,unit",
    [("units: µm", "um"), ("LENGTH_UNIT NM", "nm"), ("units=nanometers", "nm"), ("1 unit = 0.001 mm", "um"), ("1 unit is 1000 nm", "um"), ("1 unit is 1e-6 mm", "nm"), ("1 unit = 0.001 um", "nm"), ("1 unit = 1 vox", "voxel"), ("1 unit = 1000 um", "mm"),
     ("1 unit = 7 um", None), ("coordinates in Micrometers", "um"), ("x y z and radius are μm", "um"), ("positions and radii given in nm", "nm"), ("all lengths MM", "mm"), ("positions are px indices", "voxel"), ("index space, not scaled (voxels)", "voxel"),
     ("slice thickness 2 mm", None), ("laser line 561 nm", None), ("fixed 5 h, section 60 um", None), ("plate 2 of 12 mm well", None), ("bleach depth about 30 um\n units: mm", "mm"), ("", None), (None, None)],
)
def test_statements(spark, text, unit):
    assert spark.createDataFrame([(text,)], "t string").select(u.stated_unit(F.col("t"))).first()[0] == unit


@pytest.mark.parametrize(
    "text,unit,size",
    [("0.2,0.2,0.4", "um", [0.2, 0.2, 0.4]), ("[200, 200, 1000] nm", "nm", [0.2, 0.2, 1.0]), ("z=2 y=1 x=1 UM", "um", [1, 1, 2]), ("2.5/µm, 2.5/µm, 1/µm", "px_per_um", [0.4, 0.4, 1]), ("0.5 µm/0.5 µm/0.4 µm", "um", [0.5, 0.5, 0.4]), ("400nm;400nm;1um", "mixed", [0.4, 0.4, 1]),
     ("lateral 0.4 micron / axial 0.0004 mm", "mixed", [0.4, 0.4, 0.4]), ("xy 500 nm, z 0.5 µm", "mixed", [0.5, 0.5, 0.5]), ("0.2 UM lateral, 0.4 UM axial", "um", [0.2, 0.2, 0.4]), ("5 px per um (z: 2)", "px_per_um", [0.2, 0.2, 0.5]), ("x 2 y 2 z 1 voxels/micrometer", "px_per_um", [0.5, 0.5, 1]),
     ("5.000e-04 mm/5.000e-04 mm/8.000e-04 mm", "mm", [0.5, 0.5, 0.8]), ("1;1;0.5 pixels per micron", "px_per_um", [1, 1, 2]), ("", None, None), (None, None, None), ("about", "um", None), ("0/um 0/um 0/um", "px_per_um", [None] * 3)],
)
def test_resolutions(spark, text, unit, size):
    p = u.resolution_parts(F.col("t"), F.lit("um"))
    got = spark.createDataFrame([(text,)], "t string").select(p["unit"].alias("u"), p["size"].alias("s")).first()
    assert got.u == unit
    assert (got.s is None) == (size is None) and (size is None or got.s == pytest.approx(size))


def test_path_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cost = rng.exponential(3, (6, 4))
        path = u._best_path(cost, 2.0, None, None)
        total = lambda p: sum(cost[i, s] for i, s in enumerate(p)) + 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert total(path) == pytest.approx(min(map(total, product(range(4), repeat=6))))
        ends = u._ends(cost, 2.0)
        for a, b in product(range(4), repeat=2):
            assert ends[a, b] == pytest.approx(min(total(p) for p in product(range(4), repeat=6) if p[0] == a and p[-1] == b))
            assert total(u._best_path(cost, 2.0, a, b)) == pytest.approx(ends[a, b])


def test_history(spark):
    rng = np.random.default_rng(2)
    kinds = ["um"] * 40 + ["nm"] * 30 + ["um"] * 5 + ["mm"] * 20 + ["voxel"] * 25
    shift = {"um": 0, "nm": 3, "mm": -3, "voxel": 0.7}
    rows = [("s", i, i, float(shift[k] + rng.normal(0, 0.02)) if i % 17 else None, -0.7) for i, k in enumerate(kinds)]
    df = spark.createDataFrame([(s, int(a), int(n), lv, v) for s, a, n, lv, v in rows], "source string, at int, neuron_id bigint, level double, voxel double").repartition(3)
    got = {r.neuron_id: r.history_unit for r in u.segment_history(df).collect()}
    assert [got[i] for i in range(len(kinds))] == kinds


NEURON = "neuron_id bigint, image_path string, scanner_name string, resolution string, unit_text string, header_text string, traced_at timestamp, swc_unit string"
NODE = "neuron_id bigint, node_id int, x float, y float, z float, radius float, swc_unit string"
LINE = "neuron_id bigint, line_no int, raw_line string"


def test_files(spark):
    rows = [(1, "/vol/a/b/f", "a", "1 1 1", None, None), (2, "/vol/b/b/f", None, "2 2 4", None, None), (3, "/x", "a", None, "NM", "# units: mm"), (4, None, None, None, "MM", ""), (5, "/vol/c/x", "c", "1,1,1", "junk", None), (6, "/x", "a", "0.5,0.5,1", None, None), (7, "/x", "a", "1", None, None)]
    neurons = spark.createDataFrame([(*r, None, "clash") for r in [*rows, rows[0]]], NEURON)
    scanners = spark.createDataFrame(SCANNER, "scanner_name string, default_unit string, default_res_unit string")
    nodes = spark.createDataFrame([(n, 1, 10.0, 10.0, 10.0, r, "clash") for n, r in ((1, 1.0), (2, 1000.0), (3, 0.001), (5, 1000.0), (None, 1.0), (1, None), (1, 0.0))], NODE)
    lines = spark.createDataFrame([(6, 3, "# coordinates in voxel"), (6, 1, "1 2 3 4 5 6 -1"), (7, 1, "1 2 3nm 4nm 5nm 6nm -1"), (7, 2, None), (None, 1, "# units: nm")], LINE)
    units = u.file_units(neurons, scanners, nodes, lines)
    got = {r.neuron_id: (r.swc_unit, r.stated_by, r.resolution_unit) for r in units.collect()}
    assert got == {1: ("um", "default", "um"), 2: ("nm", "default", "px_per_um"), 3: ("mm", "file", None), 4: ("mm", "unit_text", None), 5: ("nm", "history", None), 6: ("voxel", "file", "um"), 7: ("nm", "file", "um")}
    found = {tuple(r) for r in u.foreign_units(units).collect()}
    assert found == {(2, "swc", "nm"), (2, "resolution", "px_per_um"), (3, "swc", "mm"), (4, "swc", "mm"), (5, "swc", "nm"), (6, "swc", "voxel"), (7, "swc", "nm")}
    scaled = u.to_micrometres(spark.createDataFrame([(6, 1, 10.0, 10.0, 10.0, 1.0, "c"), (2, 1, 10.0, 10.0, 10.0, 1.0, "c"), (99, 1, 1.0, 1.0, 1.0, 1.0, "c")], NODE), units)
    assert scaled.columns == [*NODE.replace(",", "").split()[::2], "x_um", "y_um", "z_um", "radius_um"]
    out = {r.neuron_id: (r.x_um, r.z_um, r.radius_um) for r in scaled.collect()}
    assert out[6] == (5.0, 10.0, 0.5) and out[2] == pytest.approx((0.01, 0.01, 0.001)) and out[99] == (None, None, None)


def test_statements_decide_what_states_nothing(spark):
    """Scanner c has no default: what its other files state says which of its numbers are micrometres."""
    said = {1: "um", 2: "um", 4: "nm", 6: "um", 9: "voxel"}
    radius = {1: 50.0, 2: 51.0, 3: 50.5, 4: 50000.0, 5: 50500.0, 6: 49.0, 7: 49.5, 9: 25.0, 10: 25.2}
    neurons = spark.createDataFrame([(n, "/x", "c", "2 2 2 um", None, f"# units: {said[n]}" if n in said else None, None, None) for n in (*radius, 8, 11)], NEURON)
    scanners = spark.createDataFrame(SCANNER, "scanner_name string, default_unit string, default_res_unit string")
    nodes = spark.createDataFrame([(n, 1, 1.0, 1.0, 1.0, r, None) for n, r in radius.items()], NODE)
    lines = spark.createDataFrame([(8, 1, "1 2 3 4 5 48.5 -1"), (8, 2, "2 2 3 4 5 1e999 1")], LINE)
    got = {r.neuron_id: (r.swc_unit, r.stated_by) for r in u.file_units(neurons, scanners, nodes, lines).collect()}
    nothing = {3: "um", 5: "nm", 7: "um", 8: "um", 10: "voxel", 11: "voxel"}
    assert got == {**{n: (unit, "file") for n, unit in said.items()}, **{n: (unit, "history") for n, unit in nothing.items()}}


def test_infinite_radius_in_a_line(spark):
    lines = spark.createDataFrame([(1, 1, "1 2 3 4 5 10 -1"), (1, 2, "2 2 3 4 5 1e999 1")], LINE)
    assert [tuple(r) for r in u._line_evidence(lines).select("sum_log", "n").collect()] == [(1.0, 1)]


def test_search_through_statements(spark):
    rng = np.random.default_rng(3)
    stated = [None, "mm", None, None, "um", None, "voxel", None]
    levels, shift = rng.choice([0.0, 3.0, -3.0], 8) + rng.normal(0, 0.3, 8), {"um": 0, "nm": 3, "mm": -3, "voxel": 0.7}
    df = spark.createDataFrame([("s", i, i, float(v), -0.7, s) for i, (v, s) in enumerate(zip(levels, stated, strict=True))], "source string, at int, neuron_id bigint, level double, voxel double, stated string")
    # one statement each says nothing of the level of the source; a wide deviation makes neighbours matter
    rows = {r.neuron_id: r for r in u.segment_history(df, least_spread=2.0, least_stated=9).collect()}
    rest = sorted(levels - 3 * np.round(levels / 3))
    best = {}
    for base in rest:  # whichever of these the approximate median is
        cost = np.array([[((v - base - shift[k]) / 2.0) ** 2 / 2 for k in u.UNITS] for v in levels])
        ways = [w for w in product(range(4), repeat=8) if all(s is None or u.UNITS[k] == s for k, s in zip(w, stated, strict=True))]
        total = lambda w: sum(cost[i, k] for i, k in enumerate(w) if stated[i] is None) + 4.0 * sum(a != b for a, b in zip(w, w[1:], strict=False))  # noqa: B023, E731
        best[base] = [u.UNITS[k] for k in min(ways, key=total)]
    got = [rows[i].unit for i in range(8)]
    assert all(s is None or g == s for g, s in zip(got, stated, strict=True)) and got in best.values()
    alone = u.segment_history(df.drop("stated"), least_spread=2.0)
    assert {r.neuron_id: r.history_unit for r in alone.collect()} == {n: r.history_unit for n, r in rows.items()}


def test_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (NEURON, "scanner_name string, default_unit string, default_res_unit string", NODE, LINE)]
    assert u.file_units(*empty).count() == 0
