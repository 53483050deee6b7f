import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtree.llm.volumes import blank_runs, oversized, split_oversized

SCHEMA = "result_id bigint, image_path string, scanner_name string, threshold double, dtype string, n_z int, n_y int, n_x int, signal_image binary, _limit int, mask string"
LIMITS = "scanner_name string, max_image_bytes bigint, overlap_slices int"


def image(mask, per=6, dtype="u8"):
    item = {"u8": "u1", "u16le": "<u2", "u16be": ">u2"}[dtype]
    return b"".join((np.full(per, 9) if m == "x" else np.r_[np.zeros(per - 1), 3]).astype(item).tobytes() for m in mask)


def runs(mask):
    out, i = [], 0
    while i < len(mask):
        j = i
        while j < len(mask) and mask[j] == mask[i]:
            j += 1
        if mask[i] == "." and i > 0 and j < len(mask):
            out.append((i, j - 1))
        i = j
    return out or [(-1, -1)]


MASKS = ["x..x.x", "......", "xxxxxx", "..xx..", "x.", ".x", "x.x.x.x..x", "x" * 40, "." * 500 + "x" + "." * 500 + "x"]


def test_runs(spark):
    rows = [(i, "/vol/s/b/f", "s" if i % 2 else None, 3.0, d, None, 2, 3, image(m, 6, d), 1, "m") for i, (m, d) in enumerate((m, d) for m in MASKS for d in ("u8", "u16le", "u16be"))]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = spark.createDataFrame([("s", 5, 1), ("s", 9, 3), (None, 1, 1)], LIMITS)
    want = {(i, *r) for i, m in enumerate(m for m in MASKS for _ in range(3)) for r in runs(m)}
    got = blank_runs(df.unionByName(df), limits).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_runs_across_pieces(spark):
    """Limits of several slices: blanks on both sides of a cut are one run, with and without an overlap."""
    df = spark.createDataFrame([(i, "/vol/s/b/f", "s", 3.0, "u8", None, 2, 3, image(m), 1, "m") for i, m in enumerate(MASKS)], SCHEMA)
    for limit, overlap in ((13, 0), (19, 1), (31, 4), (40, None)):
        large = [i for i, m in enumerate(MASKS) if 6 * len(m) > limit]
        got = sorted(map(tuple, blank_runs(df, spark.createDataFrame([("s", limit, overlap)], LIMITS)).collect()))
        assert got == sorted((i, *r) for i in large for r in runs(MASKS[i]))


def test_odd_rows(spark):
    rows = [
        (1, "/vol/none/b/f", None, 3.0, "u8", 1, 2, 3, image("x.x"), 1, ""), (2, "/vol/s/b/f", "s", None, "u8", 1, 2, 3, image("x.x"), 1, ""), (3, "/vol/s/b/f", "s", 3.0, "f8", 1, 2, 3, image("x.x"), 1, ""),
        (4, "/vol/s/b/f", "s", 3.0, "u8", 1, None, None, image("x.x"), 1, ""), (5, "/vol/s/b/f", "s", 3.0, "u8", 1, 2, 3, None, 1, ""), (6, "/vol/s/b/f", "s", 3.0, "u8", 1, 2, 3, b"", 1, ""), (7, None, None, None, None, None, None, None, None, None, None),
        (8, "/vol/s/b/f", "s", 3.0, " U8 ", 1, 2, 3, image("x.x") + b"\x01", 1, ""),
    ]
    limits = spark.createDataFrame([("s", 5, 1), ("t", None, None)], LIMITS)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, blank_runs(df, limits).collect())) == [(2, -1, -1), (3, -1, -1), (4, -1, -1), (8, 1, 1)]
    assert {r.result_id for r in split_oversized(df, limits).collect()} == {2, 3, 4, 8}
    assert oversized(spark.createDataFrame([], SCHEMA), limits).count() == 0
    assert split_oversized(df, spark.createDataFrame([], LIMITS)).count() == 0


def check(pieces, data, limit, slice_bytes, overlap, mask):
    pieces = sorted(pieces, key=lambda p: p.piece)
    assert pieces[0].first_byte == 0 and pieces[-1].first_byte + pieces[-1].n_bytes == len(data)
    for p in pieces:
        assert p.data == data[p.first_byte : p.first_byte + p.n_bytes] and p.n_bytes == len(p.data) <= max(limit, 1)
    for a, b in zip(pieces, pieces[1:], strict=False):
        shared = a.first_byte + a.n_bytes - b.first_byte
        most = limit // slice_bytes
        keep = min(overlap, most - 1) if most else 0
        assert shared == keep * slice_bytes if most else shared >= 0
        cut = (a.first_byte + a.n_bytes) // slice_bytes
        if most and a.cut == "forced":  # no slice beside an allowed cut is blank
            first = max(keep, 1) if a.piece == 0 else a.first_byte // slice_bytes + keep + 1
            last = most if a.piece == 0 else a.first_byte // slice_bytes + most
            assert cut == last and "." not in mask[first - 1 : last + 1]


def test_pieces(spark):
    rng = np.random.default_rng(3)
    rows, limits, facts = [], [], {}
    for i in range(60):
        mask = "".join(rng.choice(["x", "."], rng.integers(2, 60), p=[0.8, 0.2] if i % 2 else [0.95, 0.05]))
        limit, overlap = int(rng.integers(1, 80)), int(rng.integers(0, 9))
        rows.append((i, "/vol/q/b/f", f"s{i}", 3.0, "u8", None, 2, 3, image(mask), 0, "m"))
        limits.append((f"s{i}", limit, overlap))
        facts[i] = (image(mask), limit, overlap, mask)
    got = split_oversized(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(limits, LIMITS)).collect()
    for i, (data, limit, overlap, mask) in facts.items():
        own = [p for p in got if p.result_id == i]
        if len(data) <= limit:
            assert not own
        else:
            check(own, data, limit, 6, overlap, mask)


@settings(max_examples=50, deadline=None)
@given(st.text("x.", min_size=1, max_size=30))
def test_runs_twin(mask):
    assert all(set(mask[a : b + 1]) == {"."} for a, b in runs(mask) if a >= 0)
