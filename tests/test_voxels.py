import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtree.kernels import levels, volume
from voxtree.operators import voxels

RNG = np.random.default_rng(7)


def table(spark, a, name="v", key=None):
    rows = [(*map(int, i), float(v) if a.dtype.kind == "f" else int(v)) for i, v in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, f"z int, y int, x int, {name} {'double' if a.dtype.kind == 'f' else 'int'}")
    return df.withColumn("image", F.lit(key)) if key else df


def dense(df, name, shape):
    out = np.zeros(shape, float)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


def brute_maxima(a):
    out = np.zeros(a.shape, bool)
    for p in np.ndindex(a.shape):
        ok = a[p] > 0
        for o in itertools.product((-1, 0, 1), repeat=3):
            q = tuple(np.add(p, o))
            if any(o) and all(0 <= c < n for c, n in zip(q, a.shape, strict=True)):
                ok &= a[p] >= a[q] if o > (0, 0, 0) else a[p] > a[q]
        out[p] = ok
    return out


def brute_distance(m):
    padded = np.pad(m, 1)
    off = np.argwhere(~padded)
    return np.array([0 if not m[p] else ((off - np.add(p, 1)) ** 2).sum(1).min() for p in np.ndindex(m.shape)]).reshape(m.shape)


@pytest.mark.parametrize("seed", range(3))
def test_stencils(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 5, (3, 5, 6))
    m = a > 1
    df, mask = table(spark, a, key="k").unionByName(table(spark, a * 0 + 9, key="other")), table(spark, m.astype(int), "m")
    assert np.array_equal(dense(voxels.local_maxima(df, ["image"]).where("image = 'k'").withColumn("o", F.lit(1)), "o", a.shape), brute_maxima(a))
    assert np.array_equal(volume.local_maxima(a), brute_maxima(a))
    assert np.array_equal(dense(voxels.plateau_maxima(df, ["image"]).where("image = 'k'").withColumn("o", F.lit(1)), "o", a.shape), volume.plateau_maxima(a))
    d2 = brute_distance(m)
    assert np.array_equal(volume.squared_distance(m), d2)
    assert np.array_equal(dense(voxels.squared_distance(mask).where("m = 1"), "d2", a.shape), d2)
    for n in (6, 18, 26):
        lab = volume.labels(m, {6: volume.OFFSETS_6, 18: volume.OFFSETS_18, 26: volume.OFFSETS_26}[n])
        got = {(r.z, r.y, r.x): r.label for r in voxels.components(mask, neighbours=n).collect()}
        want = {tuple(map(int, p)): tuple(map(int, np.unravel_index(lab[tuple(p)], a.shape))) for p in np.argwhere(m)}
        assert {p: (v >> 40, v >> 20 & (1 << 20) - 1, v & (1 << 20) - 1) for p, v in got.items()} == want
    assert np.array_equal(dense(voxels.connectivity_filter(mask), "m", a.shape), volume.well_connected(m))
    assert np.array_equal(dense(voxels.closing(voxels.connectivity_filter(mask)), "m", a.shape), volume.closed_mask(a.astype(float), 1))
    assert np.array_equal(dense(voxels.dilate(mask), "m", a.shape), volume.box(m, np.maximum, False))
    assert np.array_equal(dense(voxels.erode(mask), "m", a.shape), volume.box(m, np.minimum, True))
    assert np.array_equal(dense(voxels.subtract_background(table(spark, a + 3)), "v", a.shape), volume.signal_of(a + 3))


@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_levels(values, shift):
    v = np.array(values) + shift
    counts, low = volume.histogram(v)
    level = levels.background_level(counts, low)
    assert level <= v.max() or low >= 2
    t, c1, c2 = levels.two_class_level(counts, low)
    assert low <= t <= v.max()
    if t < v.max() and len(counts) > 1:
        assert c1 == pytest.approx(v[v <= t].mean() if (v <= t).any() else c1) and c2 == pytest.approx(v[v > t].mean() if (v > t).any() else c2)
    tri = levels.triangle_level(counts, low)
    assert low - 1 <= tri <= v.max()


def test_level_cases():
    assert levels.background_level(np.array([95, 1, 1, 3]), 0) == 0
    assert levels.background_level(np.array([10, 50, 30, 10]), 0) == 1
    assert levels.background_level(np.array([10, 40, 20, 60, 9]), 0) == 3
    # the start lies below the lowest level and counts from the end: all bins are searched, and levels counted from the start
    assert levels.background_level(np.array([30, 40, 20, 10]), 12) == 6
    assert levels.triangle_level(np.array([0, 10, 5, 4, 3, 2, 1]), 0) == 2
    assert levels.triangle_level(np.array([7]), 4) == 3 and levels.triangle_level(np.array([3, 3]), 4) == 4
    with pytest.raises(ValueError):
        levels.triangle_level(np.array([1, 2]), 5, 4)
    finder = lambda c, low: float(low + c.argmax())
    share = {10: 0.2, 12: 0.15, 14: 0.04}
    counts = np.array([0, 0, 1, 0, 2, 0])
    assert levels.refined_level(10, lambda t: share.get(t, 0.01), counts, 10, 16, finder) == 14
    assert levels.refined_level(10, lambda t: 0.001, counts, 10, 16, finder) == 10


def test_samples(spark):
    a = RNG.random((4, 5, 6))
    p = RNG.random((40, 3)) * [7, 6, 5] - 0.7
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id int, px double, py double, pz double")
    lin, near = volume.sample(a, p), volume.sample(a, p, 0)
    got = {r.id: r.s for r in voxels.trilinear_sample(table(spark, a), df, "id").collect()}
    got0 = {r.id: r.s for r in voxels.nearest_sample(table(spark, a), df).collect()}
    for i in range(40):
        assert (got[i] is None) == np.isnan(lin[i]) and (got[i] is None or got[i] == pytest.approx(lin[i]))
        assert got0[i] is None if np.isnan(near[i]) else got0[i] == near[i]
    x, y, z = 1.25, 2.5, 0.75
    want = sum(a[int(z) + k, int(y) + j, int(x) + i] * (x % 1 if i else 1 - x % 1) * (y % 1 if j else 1 - y % 1) * (z % 1 if k else 1 - z % 1) for i, j, k in itertools.product((0, 1), repeat=3))
    assert volume.sample(a, np.array([[x, y, z]]))[0] == pytest.approx(want)


def test_shapes():
    assert volume.as_volume(np.zeros((2, 3))).shape == (1, 2, 3) and volume.as_volume(np.zeros((1, 2, 3, 4))).shape == (2, 3, 4)
    with pytest.raises(ValueError):
        volume.as_volume(np.zeros((2, 2, 3, 4)))
    with pytest.raises(ValueError):
        volume.closed_mask(np.zeros((2, 2, 2)), -1)
    with pytest.raises(ValueError):
        volume.estimated_threshold(np.zeros((3, 3, 3)))
    assert volume.bounding_box(np.array([[1.0, 1, 1], [3, 3, 3]]), (4, 9, 9)) == (0, 0, 0, 5, 5, 3)
