import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtree.kernels import forest as f
from voxtree.operators import graphs, spatial, trees


def roots_of(n, edges):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("seed,in_task", [(0, 10**6), (1, 10**6), (1, 0)])
def test_components_and_forest(spark, seed, in_task):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(0, i) for i in range(60, 80)] + [(i, i + 1) for i in range(80, 99)]
    df = spark.createDataFrame([("g", u, v, float(rng.randrange(9)), i) for i, (u, v) in enumerate(edges)], "k string, u bigint, v bigint, w double, edge bigint")
    nodes = spark.range(100).selectExpr("'g' as k", "id as node")
    got = {r.node: r.component for r in graphs.connected_components(nodes, df, ["k"], in_task).collect()}
    want = roots_of(100, edges)
    assert [got[i] for i in range(100)] == want
    picked = graphs.minimum_spanning_forest(df, ["k"], in_task).collect()
    assert len(picked) == 100 - len(set(want)) and roots_of(100, [(r.u, r.v) for r in picked]) == want
    order = sorted((r.w, r.edge) for r in df.collect() if r.u != r.v)
    by = {r.edge: (r.u, r.v) for r in df.collect()}
    chosen = []
    for _, e in order:
        if len(set(roots_of(100, [by[c] for c in [*chosen, e]]))) < len(set(roots_of(100, [by[c] for c in chosen]))):
            chosen.append(e)
    assert {r.edge for r in picked} == set(chosen)
    assert {r.node: r.degree for r in graphs.degrees(df).collect()} == {i: sum((u == i) + (v == i) for u, v in edges) for i in range(100) if any(i in e for e in edges)}
    assert graphs.distinct_edges(df, ["k"]).count() == len(set(edges)) and graphs.neighbours(df, ["k"]).count() == 2 * len(edges)
    assert graphs.minimum_spanning_forest(df.limit(0), ["k"]).count() == 0


def test_boxes(spark):
    rng = np.random.default_rng(3)
    low = rng.random((120, 3)) * 200
    high = low + rng.random((120, 3)) * 40
    rows = [(i, *[float(v) for pair in zip(low[i], high[i], strict=True) for v in pair]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = [(r.i, r.j) for r in spatial.boxes_within(df, 5.0).collect()]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0) ** 2).sum() <= 25}
    assert set(got) == want and len(got) == len(want)
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(low)], "id int, px double, py double, pz double")
    near = {r.id: r.nearest for r in spatial.nearest_within(pts, pts.where("id % 2 = 0"), 30.0).collect()}
    d = ((low[:, None] - low[None, ::2]) ** 2).sum(-1)
    assert near == {i: int(d[i].argmin()) * 2 for i in range(120) if d[i].min() <= 900}


def line(points, radius=1.0):
    return f.Forest.of(range(1, len(points) + 1), [0] * len(points), np.array(points, float), [radius] * len(points), [-1, *range(1, len(points))])


def links(x):
    return {i: p for i, p in x.parent.items()}


def test_passes():
    zig = f.remove_zigzags(line([(0, 0, 0), (5, 0, 0), (3, 1, 0), (8, 1, 0)]))
    assert links(zig) == {1: -1, 3: 1, 4: 3}
    spur = f.Forest.of([1, 2, 3, 4, 5, 9], [0] * 6, np.zeros((6, 3)), [1] * 6, [-1, 1, 2, 2, 4, -1])
    assert set(links(f.remove_spurs(spur))) == {1, 2, 4, 5}
    close = f.merge_close(line([(0, 0, 0), (0, 0, 0.001), (5, 0, 0), (9, 0, 0)]))
    assert links(close) == {1: -1, 3: 1, 4: 3}
    over = f.Forest.of([1, 2, 3, 4, 5], [0] * 5, np.array([(0, 0, 0), (6, 0, 0), (4, 0, 0), (2, 5, 0), (2, -5, 0)], float), [1] * 5, [-1, 1, 2, 3, 3])
    assert 2 not in f.remove_overshoots(over).rows
    thick = f.downsample(line([(i, 0, 0) for i in range(20)], 3.0))
    assert len(thick.rows) < 8 and len(thick.roots()) == 1
    points = np.array([(0, 0, 0), (9, 0, 0), (1, 0, 0), (2, 0, 0), (20, 0, 0), (0, 9, 0)], float)
    assert links(f.tune_branches(f.Forest.of(range(1, 7), [0] * 6, points, [1] * 6, [-1, 1, 2, 3, 2, 1])))[3] == 1
    assert links(f.tune_branches(f.Forest.of(range(1, 6), [0] * 5, points[:5], [1] * 5, [-1, 1, 2, 3, 2])))[3] == 2


def test_trunks():
    t = f.Forest.of([1, 2, 3, 4], [0] * 4, np.array([(0, 0, 0), (10, 0, 0), (10, 3, 0), (10, -4, 0)], float), [1] * 4, [-1, 1, 2, 2])
    assert f.trunk_length(t, 1) == pytest.approx(14)
    single = f.Forest.of([7], [0], np.zeros((1, 3)), [1], [-1])
    assert f.trunk_length(single, 7) == 0
    many = [(10 * k + i, 10 * k + i - 1 if i else -1, (k * 100.0, i * (1.0 if k < 5 else 3.0), 0.0)) for k in range(10) for i in range(4)]
    forest = f.Forest.of([m[0] for m in many], [0] * 40, np.array([m[2] for m in many]), [1] * 40, [m[1] for m in many])
    assert {i // 10 for i in f.remove_short_trees(forest).rows} == {5, 6, 7, 8, 9}
    assert len(f.remove_short_trees(single).rows) == 1


def test_cycles_end():
    c = f.Forest.of([1, 2, 3], [None, 1, 2], np.zeros((3, 3)), [1] * 3, [3, 1, 2])
    assert len(c.roots()) == 1
    assert len(f.postprocess(c).rows) <= 3


def test_tree_tables(spark):
    rng = random.Random(9)
    rows = [(n, i, 0, rng.random() * 9, rng.random() * 9, rng.random() * 9, 1.0, rng.randrange(0, i) if rng.random() < 0.95 else None, None) for n in (1, 2) for i in range(1, 60)]
    s = "neuron_id bigint, node_id int, node_type int, x double, y double, z double, radius double, parent_id int, loaded_at timestamp"
    nodes = trees.current_nodes(spark.createDataFrame([*rows, rows[3], (None,) * 9], s))
    keys = lambda df: sorted((r.neuron_id, r.node_id) for r in df.collect())
    up = {(r[0], r[1]): (r[0], r[7]) for r in rows}
    assert keys(trees.roots(nodes)) == sorted(k for k, p in up.items() if p not in up)
    assert keys(trees.tips(nodes)) == sorted(k for k in up if k not in up.values())
    assert keys(trees.bifurcations(nodes)) == sorted(k for k in up if list(up.values()).count(k) > 1)
    at = {(r[0], r[1]): np.array(r[3:6]) for r in rows}
    cable = {r.neuron_id: r.cable for r in trees.cable_lengths(nodes).collect()}
    for n in (1, 2):
        assert cable[n] == pytest.approx(sum(np.linalg.norm(at[k] - at[p]) for k, p in up.items() if k[0] == n and p in at))
    assert keys(trees.remove_spurs(nodes)) == keys(trees.per_tree(nodes, f.remove_spurs))
    assert trees.postprocess(nodes).count() <= nodes.count() and trees.trunk_lengths(nodes).count() == len(trees.roots(nodes).collect())
    assert trees.per_tree(nodes.limit(0), f.rewrite).count() == 0 and trees.postprocess(nodes.limit(0)).count() == 0


def test_trees_as_one_neuron(spark):
    """Passes by tree give what they give on the whole neuron."""
    rng = random.Random(4)
    rows = []
    for tree in range(14):
        base = 100 * tree
        for i in range(40 if tree % 3 else 6):
            up = None if i == 0 else base + max(0, i - rng.choice([1, 1, 1, 2, 5]))
            x = i * 0.9 + rng.random()
            rows.append((1, base + i, 0, x, rng.random() * 2 + tree * 20, rng.random(), rng.uniform(0.2, 1.5), up))
    nodes = spark.createDataFrame(rows, "neuron_id bigint, node_id int, node_type int, x double, y double, z double, radius double, parent_id int")
    whole = f.Forest.of([r[1] for r in rows], [0] * len(rows), np.array([r[3:6] for r in rows]), [r[6] for r in rows], [r[7] for r in rows])
    got = {(r.node_id, r.parent_id) for r in trees.postprocess(nodes).collect()}
    want = f.postprocess(whole)
    assert got == {(i, p) for i, p in want.parent.items()} and 0 < len(got) < len(rows)


def test_somata_and_lengths(spark):
    # 1 is the soma; 2 and 3 below it, 4 below 2, 5 below 3; 6 a loose root with 7; 8 and 9 a cycle; neuron 2 has no node of type 1
    rows = [(1, 1, 1, 0, -1), (1, 2, 3, 3, 1), (1, 3, 3, 5, 1), (1, 4, 3, 4, 2), (1, 5, 3, 9, 3), (1, 6, 1, 20, 99), (1, 7, 3, 27, 6), (1, 8, 3, 0, 9), (1, 9, 3, 0, 8), (2, 1, 3, 0, -1), (2, 5, 3, 0, -1), (2, 7, 3, 0, None)]
    nodes = spark.createDataFrame([(n, i, t, float(x), 0.0, 0.0, 1.0, p, "clash") for n, i, t, x, p in rows], "neuron_id bigint, node_id int, node_type int, x double, y double, z double, radius double, parent_id int, root_id string")
    ids = lambda df: {(r.neuron_id, r.node_id) for r in df.collect()}
    assert ids(trees.somata(nodes)) == {(1, 1), (1, 6), (2, 1), (2, 5), (2, 7)}
    assert ids(trees.somata(nodes, strict=True)) == {(1, 1), (2, 1), (2, 5)}
    assert ids(trees.somata(nodes, strict=True, multiple=False)) == {(1, 1), (2, 1)} == ids(trees.somata(nodes, multiple=False))
    starts = nodes.where("neuron_id = 1").unionByName(nodes.where("node_id = 1"))
    got = {r.node_id: r.length for r in trees.lengths_from(nodes.drop("root_id"), starts).where("neuron_id = 1").collect()}
    assert got == {1: 13.0, 2: 10.0, 4: 9.0, 3: 4.0, 5: 0.0, 6: 7.0, 7: 0.0}
    assert trees.lengths_from(nodes.limit(0), starts).count() == 0


def test_hot_cells_are_not_sent_everywhere(spark):
    """A cell of n boxes is cut by its share of the work; its rows aren't written once for each ``most`` boxes."""
    sides = [F.lit(v).alias(f"{a}{k}") for a in "xyz" for k, v in ((0, 1.0), (1, 1.5))]
    boxes = spark.range(400).select("id", *sides)
    a, b, by = spatial.salted(boxes, 0.1, 2.0, most=10)
    parts = b.select(*by).distinct().count()
    assert 1 < parts <= 25 and a.count() + b.count() <= 2 * 400 * 5
    got = {(r.i, r.j) for r in spatial.boxes_within(boxes, 0.1, 2.0, most=10).collect()}
    assert got == {(i, j) for j in range(400) for i in range(j)}
    lone = spatial.boxes_within(boxes, 0.1, 2.0, most=1000)
    assert lone.count() == lone.distinct().count() == len(got)
