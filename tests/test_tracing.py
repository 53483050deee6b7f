import json
import math
import os

import numpy as np
import pytest

from voxtree import api, batch, figures
from voxtree.cli import main
from voxtree.kernels import connect, trace, tube, volume
from voxtree.kernels.tube import Config, Tube
from voxtree.operators import tracing
from voxtree.sources.decode import write_volume
from voxtree.streaming.watch import throttled, watch_directory

CFG = Config()


def phantom(lines, shape=(31, 41, 66), radius=2.5, noise=8):
    z, y, x = np.indices(shape)
    a = np.zeros(shape)
    for p, q in lines:
        p, q = np.array(p, float), np.array(q, float)
        d = q - p
        t = np.clip(((x - p[0]) * d[0] + (y - p[1]) * d[1] + (z - p[2]) * d[2]) / (d @ d), 0, 1)
        r2 = (x - p[0] - t * d[0]) ** 2 + (y - p[1] - t * d[1]) ** 2 + (z - p[2] - t * d[2]) ** 2
        a = np.maximum(a, 200 * np.exp(-r2 / radius**2 / 1.2))
    return np.floor(a + np.random.default_rng(0).random(shape) * noise)


ONE = [((5, 20, 15), (60, 20, 15))]
FORK = [((5, 20, 15), (35, 20, 15)), ((35, 20, 15), (60, 35, 15)), ((35, 20, 15), (60, 5, 15))]


def test_template():
    grid, w = tube.template()
    assert len(grid) == 213 and len(tube.template(0.81)[0]) == 69 and len(tube.angle_grid(11)) == 307
    assert w.max() == pytest.approx(1) and np.abs(tube.weights(np.array([3.0]), np.array([1.5]), 2.66)).sum() == pytest.approx(1)
    v = np.array([1.0, 2.0, np.nan, 4.0])
    assert tube.dot_score(v, np.ones(4)) == 7 and tube.mean_inside(v, np.array([1, -1, 1, 1])) == 2.5 and tube.mean_outside(v, np.array([1, -1, 1, 1])) == 2
    assert tube.correlation(v[[0, 1, 3]], v[[0, 1, 3]]) == pytest.approx(1) and tube.correlation(np.ones(3), v[:3]) == 0


def test_geometry():
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = Tube(rng.uniform(1, 4), rng.random(3) * 9, rng.uniform(0, math.pi), rng.uniform(0, 6.2), rng.uniform(0.5, 2), 11)
        assert np.allclose(t.world(t.local(np.array([1.0, 2, 3]))), [[1, 2, 3]])
        g = t.flipped()
        assert np.allclose(g.start, t.end) and np.allclose(g.end, t.start) and np.allclose(g.axis, -t.axis) and np.allclose(g.center, t.center)
        assert t.contains(t.center) and not t.contains(t.end + t.axis) and t.contains(t.end + 0.4 * t.axis)
        d, at = t.surface(t.center + np.array([30.0, 0, 0]))
        assert d[0] == pytest.approx(np.linalg.norm(at[0] - t.center - [30, 0, 0]))
        assert t.surface(t.center)[0][0] == 0
        v = t.voxels()
        assert all(t.copy(radius=t.radius + 1, length=13, start=t.start - t.axis).contains(p) for p in v[::17])
    assert np.allclose(tube.angles_of(tube.axis(0.5, 1.0)), [0.5, 1.0])
    d, p = connect.segment_distance(*np.array([(0, 0, 0), (9, 0, 0), (4, 3, -5), (4, 3, 5.0)]))
    assert d == 3 and p.tolist() == [4, 0, 0]


def test_fit_and_length():
    signal = volume.signal_of(phantom(ONE))
    t = Tube.centred(2.0, np.array([30.0, 21, 15]), 11)
    t.recenter(signal)
    t.orient(signal)
    t.fit(signal, CFG)
    assert abs(t.axis[0]) > 0.99 and abs(t.center[1] - 20) < 1 and t.score > 0.7
    for mode in ("grid", "hemisphere_uniform"):
        u = Tube.centred(2.0, np.array([30.0, 20, 15]), 11)
        u.orient(signal, mode)
        assert abs(u.axis[0]) > 0.9
    with pytest.raises(ValueError):
        t.orient(signal, "none")
    end = Tube(2.5, np.array([56.0, 20, 15]), math.pi / 2, math.pi / 2)
    end.find_length(signal)
    assert end.length < 9


def test_one_tube():
    signal = volume.signal_of(phantom(ONE))
    mask = volume.closed_mask(signal, 40)
    for strategy in ("lazy", "eager"):
        chains = trace.grow_chains(signal, mask, CFG, strategy)
        assert len(chains) == 1 and 50 < chains[0].path_length < 70
        f = connect.reconstruct(chains, signal, CFG)
        assert len(f.roots()) == 1 and not [i for i in f.rows if len(f.children[i]) > 1]
        assert all(abs(f.at(i)[1] - 20) < 2 and abs(f.at(i)[2] - 15) < 2 for i in f.rows)
    assert connect.reconstruct([], signal, CFG) is None
    with pytest.raises(ValueError):
        trace.seed_candidates(np.ones((1, 5, 5), bool), CFG)
    tiers = Config(seed_tiers=((0, 10**6),))
    assert trace.seed_candidates(mask, tiers) == []


def test_fork():
    r = api.trace_volume(phantom(FORK), strategy="lazy")
    forks = [i for i in r.forest.rows if len(r.forest.children[i]) > 1]
    assert len(r.chains) == 2 and len(r.forest.roots()) == 1 and len(forks) == 1
    assert np.linalg.norm(r.forest.at(forks[0]) - [35, 20, 15]) < 6
    assert len(r.raw_forest.rows) >= len(r.forest.rows)


def test_dark_gap():
    image = phantom([((3, 20, 15), (36, 20, 15)), ((50, 20, 15), (90, 20, 15))], (31, 41, 96))
    signal = volume.signal_of(image)
    chains = trace.grow_chains(signal, volume.closed_mask(signal, 60), CFG, "lazy")
    assert len(chains) == 2
    again = lambda c: len(connect.reconstruct([trace.Chain(list(x.tubes)) for x in chains], signal, c, raw=True).roots())
    assert again(CFG) == 2 and again(Config(geodesic_limit=0, connect_distance=16.0)) == 1
    cost, path = connect.shortest_path(np.ones((3, 3, 5)), np.array([0, 1, 1]), np.array([4, 1, 1]), np.zeros(3, int), np.array([4, 2, 2]), None, 0.5, 1.0)
    assert path == [(x, 1, 1) for x in range(5)] and cost == pytest.approx(4 * (2 / (1 + math.exp(0.5)) + 1e-5))


def test_rules():
    hook = lambda n, a, b, end, c: connect.Link(a, b, "HL", end, 3, np.zeros(3), np.zeros(3), 0, 0, c)
    links = [hook(0, 0, 1, 0, 0.5), hook(1, 1, 0, 0, 0.4), hook(2, 0, 2, 0, 0.3), hook(3, 0, 3, 0, 0.3), hook(4, 0, 4, 1, 0.9)]
    assert connect.without_redundant(links) == [links[1], links[3], links[4]]
    line = lambda x: trace.Chain([Tube(1, np.array([x + 10.0 * k, 0, 0]), math.pi / 2, math.pi / 2) for k in range(2)])
    on, side = connect.Link(0, 1, "LINK", 1, 0, np.zeros(3), np.zeros(3), 2.0, 0, 0.5), connect.Link(0, 2, "HL", 1, 1, np.zeros(3), np.zeros(3), 2.0, 0, 0.5)
    connect.penalise_crossovers([on, side], [line(0.0), line(22.0), line(50.0)])
    assert (on.cost, side.cost) == (0.5, 1.5)
    assert connect.spanning_forest(4, [(0, 1, 0.0), (1, 2, 5.0), (0, 2, 1.0), (2, 1, 0.5)]) == [(0, 1), (1, 2)]
    chain = trace.Chain([Tube(1, np.array([10.0 * k, 0, 0]), math.pi / 2, math.pi / 2, heading="forward") for k in range(3)])
    assert chain.points()[0][:, 0].round(6).tolist() == [0, 10, 20, 30] and chain.path_length == pytest.approx(30)
    at, place = connect.interpolate(chain, np.array([15.0, 4, 0]), np.array([0.0, 1, 0]))
    assert at == 2 and place.round(6).tolist() == [15, 0, 0] and len(chain.tubes) == 4
    assert connect.interpolate(chain, np.array([0.5, 4, 0]), np.array([0.0, 1, 0]))[0] is None
    few = [trace.Chain([Tube(1, np.zeros(3), score=0.1, mean=1.0)])] * 3
    assert trace.good_chains(few, CFG) == few
    many = [trace.Chain([Tube(1, np.zeros(3), score=0.9, mean=5.0)])] * 60 + [trace.Chain([Tube(1, np.zeros(3), score=0.1, mean=m)]) for m in (1.0, 9.0) for _ in range(30)]
    assert len(trace.good_chains(many, CFG)) == 90
    with pytest.raises(TypeError):
        Config().with_changes({"nothing": 1})


def test_table(spark):
    image = phantom(FORK).astype("u1")
    rows = [("fork", image.tobytes(), "u1", list(image.shape)), ("flat", b"\0" * 27, "u1", [3, 3, 3]), ("bad", b"\0", "u1", [3, 3, 3]), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "id string, data binary, dtype string, shape array<int>")
    traced = tracing.trace_images(df)
    got = {r.id: r for r in traced.collect()}
    assert got["fork"].status == "completed" and len(got["fork"].nodes) > 5 and got["flat"].status == "failed" and got["bad"].error_type == "ValueError" and got["none"].status == "failed"
    assert tracing.nodes_of(traced).where("parent_id = -1").count() == 1 and tracing.seeds_of(traced).where("seed_id is not null").count() > 0
    for rows_of in (tracing.seeds_of, tracing.tubes_of, tracing.nodes_of):
        assert {(r.id, r.status) for r in rows_of(traced).select("id", "status").distinct().collect()} == {(r.id, r.status) for r in got.values()}
    stats = tracing.chain_stats(tracing.tubes_of(traced))
    assert tracing.filter_chains(stats).count() == stats.count() == 2
    late = tracing.trace_images(df.where("id = 'fork'"), timeout=1e-6).first()
    assert late.status == "timed_out" and late.error_type == "TraceTimeoutError"
    for wrong in ({"strategy": "x"}, {"timeout": 0}):
        with pytest.raises(ValueError):
            tracing.trace_images(df, **wrong)
    with pytest.raises(ValueError):
        tracing.trace_array(image, CFG, until="x")


def test_stages():
    image = phantom(FORK)
    seeds = api.extract_seeds(image, strategy="lazy")
    assert [s.point.tolist() for s in seeds] == [s.point.tolist() for s in api.extract_seeds(image, threshold=api.preprocess_volume(image)[2], strategy="lazy")]
    with pytest.raises(ValueError):
        api.generate_chains(seeds, image, strategy="eager")
    chains = api.generate_chains(seeds, image, config={"min_chain_length": 20})
    assert len(api.connect_chains(chains, image).roots()) == 1
    with pytest.raises(ValueError):
        api.connect_chains([], image)
    with pytest.raises(tracing.TraceTimeout):
        api.trace_volume(image, timeout=1e-9)


def test_files(spark, tmp_path):
    a = phantom(FORK).astype("u1")
    write_volume(a, str(tmp_path / "in" / "a.v3draw"))
    write_volume(a * 0, str(tmp_path / "in" / "b.tif"))
    out = str(tmp_path / "out" / "a.swc")
    r = api.trace_file(str(tmp_path / "in" / "a.v3draw"), output_swc=out, figure_dir=str(tmp_path / "fig"), strategy="lazy")
    assert open(out).readline().startswith("#") and all(open(p, "rb").read(4) == b"\x89PNG" for p in r.outputs[1:]) and len(r.outputs) == 5
    with pytest.raises(FileExistsError):
        api.trace_file(str(tmp_path / "in" / "a.v3draw"), output_swc=out)
    assert api.trace_file(str(tmp_path / "in" / "a.v3draw"), output_swc=out, on_exists="skip").skipped
    manifest = str(tmp_path / "log" / "m.jsonl")
    done = batch.trace_directory(spark, str(tmp_path / "in"), str(tmp_path / "swc"), manifest_path=manifest)
    assert done == [str(tmp_path / "swc" / "a.v3draw.swc")]
    done = batch.trace_directory(spark, str(tmp_path / "in"), str(tmp_path / "swc"), manifest_path=manifest)
    lines = [json.loads(x) for x in open(manifest)]
    assert sorted(x["status"] for x in lines) == ["completed", "failed", "failed", "skipped"] and ["reason" in x for x in lines if x["status"] == "skipped"] == [True] and len(done) == 1
    assert batch.read_manifest(spark, manifest).where("reason is null").count() == 3
    for bad, error in (([], ValueError), (["/none.tif"], FileNotFoundError), ([manifest], ValueError)):
        with pytest.raises(error):
            batch.trace_files(spark, bad, str(tmp_path))
    with pytest.raises(ValueError):
        batch.resolve_jobs(0, 4)
    assert batch.existing_outputs([str(tmp_path / "in" / "a.v3draw"), str(tmp_path / "in" / "b.tif")], str(tmp_path / "swc")) == [str(tmp_path / "in" / "a.v3draw")]
    assert main([str(tmp_path / "in" / "a.v3draw"), "-o", str(tmp_path / "cli.swc")]) == 0 and os.path.exists(tmp_path / "cli.swc")


def test_watch(spark, tmp_path):
    write_volume(phantom(FORK).astype("u1"), str(tmp_path / "in" / "a b.v3draw"))
    (tmp_path / "in" / "notes.txt").write_text("x")

    def run():
        watch_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "state"), once=True).awaitTermination()
        return sorted((os.path.basename(r.input_path), r.status) for r in spark.read.json(str(tmp_path / "log")).collect())

    assert run() == [("a b.v3draw", "completed")]
    write_volume(phantom(FORK).astype("u1"), str(tmp_path / "in" / "c.tif"))
    assert run() == [("a b.v3draw", "completed"), ("c.tif", "completed")]


def test_throttle():
    events = [("f", "load", None, None)] + [("f", "chains", i, 240) for i in range(241)]
    assert [e[2] for e in throttled(events, 50)] == [None, 0, 50, 100, 150, 200, 240]
    some = [("f", "s", 0, 240), *[("f", "s", i, 240) for i in range(1, 151)], ("f", "r", None, None), ("f", "s", 240, 240)]
    assert throttled(some, 50) == [some[0], some[50], some[100], some[150], *some[-2:]]
    again = [("f", "s", 100, 240), ("f", "s", 0, 240), ("f", "s", 1, 240), ("f", "s", 5, 500), ("f", "s", 3, 500), ("f", "s", 4, 500), ("f", "s", 4, None)]
    assert throttled(again, 50) == [again[0], again[1], again[3], again[4], again[6]]
    assert throttled(some[:4], 50, [0.0, 1.0, 2.0, 3.0], 2.0) == [some[0], some[2]]


def test_figures():
    flat = np.zeros((5, 6))
    assert figures.drawn(flat, [(np.array([[0, 0], [4, 4.0]]), (9, 8, 7))])[2, 2].tolist() == [9, 8, 7]
    assert figures.depth_shares(np.array([2.0, 2.0])).tolist() == [0.5, 0.5] and figures.depth_shares(np.array([1.0, 3.0])).tolist() == [0, 1]
    assert figures.projection(np.array([[[-5.0]], [[1.0]]]))[0, 0] == pytest.approx(math.log(2))


def test_failed_images_leave_a_row(spark):
    """An image of another size than its shape is named; a flat one has nothing to find."""
    image = phantom(FORK).astype("u1")
    rows = [("fork", image.tobytes(), "u1", list(image.shape)), ("flat", b"\0" * 27, "u1", [3, 3, 3]), ("bad", b"\0", "u1", [3, 3, 3]), ("none", b"", "u1", [0, 3, 3])]
    df = spark.createDataFrame(rows, "id string, data binary, dtype string, shape array<int>")
    for found in (tracing.connections(df), tracing.end_to_end_paths(df)):
        got = {(r.id, r.status, r.error_type) for r in found.collect()}
        assert ("bad", "failed", "ValueError") in got and {g[0] for g in got if g[1] == "failed"} == {"bad"} and {g[0] for g in got} == {"fork", "flat", "bad", "none"}
    assert tracing.end_to_end_paths(df).where("id = 'fork' and status = 'completed' and cost is not null").count() > 0


def test_filter_traces_once(spark):
    """The facts of an image are not found by a second run of what gives its chains."""
    rows = [("a", c, s, b) for c, (s, b) in enumerate([(0.9, 5.0), (0.1, 6.0), (0.1, 4.0)])] + [("b", 0, 0.1, 1.0)]
    stats = spark.createDataFrame(rows, "id string, chain_id int, mean_score double, mean_brightness double").mapInPandas(lambda pdfs: pdfs, "id string, chain_id int, mean_score double, mean_brightness double")
    kept = tracing.filter_chains(stats, least=2)
    assert sorted((r.id, r.chain_id) for r in kept.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_sampled_as_the_field():
    """The same bits as sampling the field's points, inside the image and over its borders."""
    image = np.random.default_rng(1).random((20, 24, 28)) * 100
    rows = np.array([[2.0, 0.3, 1.0, 1.0], [3.3, 1.2, 4.0, 0.7], [1.0, 2.0, 0.1, 2.5]])
    for frozen in (False, True):
        image.flags.writeable = not frozen  # what is derived from a frozen image is kept
        for start in (np.array([12.0, 11.0, 5.0]), np.array([1.0, 22.5, -3.0]), np.array([-50.0, 0.0, 0.0])):
            points, w = tube.field_of(rows, 11.0)
            values, weight = tube.sampled(image, rows, start, 11.0)
            assert np.array_equal(values, volume.sample(image, points + start), equal_nan=True) and np.array_equal(w, weight)
    image.flags.writeable = True
    image[:] = 7
    assert set(tube.sampled(image, rows, np.array([12.0, 11.0, 5.0]), 11.0)[0][0]) == {7.0}


def test_climb_scores_what_it_needs():
    """Trials after a good first one, and the same search twice, are left out."""
    sizes = []

    def rate(x):
        sizes.append(len(x))
        return -((x[:, 0] - 5.0) ** 2)

    top = tube.climb(np.array([3.0, 0.5, 0.5, 1.0]), rate, CFG)
    assert abs(top[0] - 5) < 0.2 and sizes[:3] == [9, 1, 8]
    sizes.clear()
    tube.climb(np.array([5.0, 0.5, 0.5, 1.0]), lambda x: rate(x) * 0 - np.abs(x[:, 1] - 0.5) * 0 + (x[:, 0] == 5.1), CFG)
    assert sizes == [9, 1, 2]


@pytest.mark.parametrize("levels", [1, 4, 250])
def test_settled_path_as_a_queue(levels):
    """The way of a queue, also where many ways cost the same; the queue still serves ways that pass a group."""
    image = np.random.default_rng(levels).integers(0, levels, (7, 9, 8)).astype(float)
    top = np.array(image.shape[::-1]) - 1
    for start, end in ((np.array([0, 0, 0]), top), (np.array([3, 8, 0]), np.array([4, 0, 6])), (top, top)):
        lonely = np.zeros(image.shape, bool)
        lonely[tuple(start[::-1])] = True  # a group of the start alone changes nothing
        queue = connect.shortest_path(image, start, end, np.zeros(3, int), top, lonely, levels / 2, 20.0)
        assert connect.shortest_path(image, start, end, np.zeros(3, int), top, None, levels / 2, 20.0) == queue


def test_ways_of_large_images_take_little(monkeypatch):
    """Without a group no place goes through a queue one at a time."""
    monkeypatch.setattr(connect.heapq, "heappop", lambda _: pytest.fail("one at a time"))
    cost, path = connect.shortest_path(np.zeros((12, 12, 12)), np.zeros(3, int), np.full(3, 11), np.zeros(3, int), np.full(3, 11), None, 5.0, 1.0)
    assert len(path) == 12 and cost > 0
