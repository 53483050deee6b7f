import gzip
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtree.sources import decode as d
from voxtree.sources.formats import format_name, format_of
from voxtree.sources.swc import number_text, read_swc, swc_text, write_swc
from voxtree.sources.volumes import read_volumes, volume_files, voxels

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("kind,name", [("v3draw", "a.v3draw"), ("tiff", "a.TIF"), ("nifti", "a.nii"), ("nifti", "a.nii.gz"), ("nrrd", "a.nrrd")])
@pytest.mark.parametrize("dtype", ["u1", "u2", "f4"])
def test_round_trip(tmp_path, kind, name, dtype):
    a = (RNG.random((3, 4, 5)) * 200).astype(dtype)
    path = str(tmp_path / name)
    d.write_volume(a, path)
    assert format_of(path) == kind
    assert np.array_equal(d.read_volume(path), a) and d.read_header(path).volume_shape() == (3, 4, 5)
    with pytest.raises(FileExistsError):
        d.write_volume(a, path)
    d.convert(path, str(tmp_path / "b.v3draw"), overwrite=True)
    assert np.array_equal(d.read_volume(str(tmp_path / "b.v3draw")), a)


def vaa(key, order, code, dims, body):
    return key + (b"L" if order == "<" else b"B") + struct.pack(order + "h4i", code, *dims) + body


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("code,kind", [(1, "u1"), (2, "u2"), (4, "f4")])
def test_raw(order, code, kind):
    a = (RNG.random((2, 3, 4)) * 250).astype(order + kind)
    data = vaa(d.RAW_KEY, order, code, (4, 3, 2, 1), a.tobytes())
    assert np.array_equal(d.decode(data, "v3draw"), a)
    for bad in (data[:-1], data + b"x", data[:30], b"x" + data[1:], data[:24] + b"Q" + data[25:]):
        with pytest.raises(ValueError):
            d.decode(bad, "v3draw")
    with pytest.raises(NotImplementedError):
        d.decode(vaa(d.RAW_KEY, order, 33, (1, 1, 1, 1), b"x"), "v3draw")


def test_packed_bytes():
    body = bytes([2, 10, 20, 30]) + bytes([33 + 4, 0b11_10_01_00, 0b01]) + bytes([128 + 3, 7])
    want = [10, 20, 30, 30, 31, 33, 32, 33, 7, 7, 7, 7]
    assert d.decode(vaa(d.PACKED_KEY, "<", 1, (12, 1, 1, 1), body), "v3dpbd").ravel().tolist() == want
    for bad in (body[:-1], body + b"\0", bytes([200])):
        with pytest.raises(ValueError):
            d.decode(vaa(d.PACKED_KEY, "<", 1, (12, 1, 1, 1), bad), "v3dpbd")


@pytest.mark.parametrize("order", "<>")
def test_packed_words(order):
    word = lambda *v: struct.pack(f"{order}{len(v)}H", *v)

    def bits(width, *v):
        text = "".join(f"{x:0{width}b}" for x in v)
        text += "0" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))

    body = bytes([1]) + word(1000, 3) + bytes([31 + 3]) + bits(3, 4, 5, 7) + bytes([79 + 2]) + bits(4, 8, 15) + bytes([182 + 2]) + bits(5, 16, 31) + bytes([222 + 2]) + word(65535)
    want = [1000, 3, 7, 6, 3, 11, 4, 20, 5, 65535, 65535]
    assert d.decode(vaa(d.PACKED_KEY, order, 2, (11, 1, 1, 1), body), "v3dpbd").ravel().tolist() == want
    wrap = bytes([0]) + word(0) + bytes([31 + 1]) + bits(3, 5)
    assert d.decode(vaa(d.PACKED_KEY, order, 2, (2, 1, 1, 1), wrap), "v3dpbd").ravel().tolist() == [0, 65535]
    with pytest.raises(NotImplementedError):
        d.decode(vaa(d.PACKED_KEY, order, 33, (2, 1, 1, 1), wrap), "v3dpbd")


def test_variants():
    a = np.arange(24, dtype="u2").reshape(2, 3, 4)
    strip = zlib.compress(a[0].tobytes())
    tags = [(256, 4, 4), (257, 4, 3), (258, 3, 16), (259, 3, 8), (273, 4, 8), (279, 4, len(strip))]
    at = 8 + len(strip)
    page = b"II*\0" + struct.pack("<I", at) + strip + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    assert np.array_equal(d.decode(page, "tiff")[0], a[0])
    nrrd = b"NRRD0004\ntype: uint16\ndimension: 3\nsizes: 4 3 2\nendian: big\nencoding: raw\n# note\n\n" + a.astype(">u2").tobytes()
    assert np.array_equal(d.decode(nrrd, "nrrd"), a)
    nii = bytearray(gzip.decompress(d.encode(a, "nifti", True)))
    struct.pack_into("<3f", nii, 108, 352.0, 2.0, 1.0)
    assert np.array_equal(d.decode(bytes(nii), "nifti"), a * 2.0 + 1)
    with pytest.raises(ValueError):
        format_of("a.png")


def test_spark_source(spark, tmp_path):
    vols = {f"{i}.v3draw": RNG.integers(0, 60000, (5, 3, 4)).astype("u2") for i in range(3)} | {"t.tif": RNG.integers(0, 255, (2, 3, 4)).astype("u1")}
    for name, v in vols.items():
        d.write_volume(v, str(tmp_path / name))
    (tmp_path / "notes.txt").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_volumes(spark, str(tmp_path)).collect()}
    assert set(rows) == set(vols)
    for name, v in vols.items():
        assert np.array_equal(np.frombuffer(rows[name].data, "<" + rows[name].dtype).reshape(rows[name].shape), v)
    heads = read_volumes(spark, str(tmp_path), pixels=False)
    assert heads.where("data is null").count() == 4 and heads.where("format = 'tiff'").first().shape == [2, 3, 4]
    slabs = read_volumes(spark, str(tmp_path / "0.v3draw"), slab=2)
    assert sorted((r.z_first, r.shape[0]) for r in slabs.collect()) == [(0, 2), (2, 2), (4, 1)]
    v = {(r.z, r.y, r.x): r.v for r in voxels(slabs).collect()}
    assert v == {i: int(x) for i, x in np.ndenumerate(vols["0.v3draw"])}
    out = tmp_path / "out"
    read_volumes(spark, str(tmp_path)).write.format("volume").mode("append").option("suffix", ".nrrd").save(str(out))
    assert np.array_equal(d.read_volume(str(out / "1.v3draw.nrrd")), vols["1.v3draw"])
    with pytest.raises(FileNotFoundError):
        volume_files(str(tmp_path / "none*.tif"))
    names = ["a.TIF", "b.nii.gz", "c.raw", "d.txt"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(format_name(F.col("p"))).collect()] == ["tiff", "nifti", "v3draw", None]


def test_swc(spark, tmp_path):
    f = tmp_path / "a.swc"
    f.write_text("# c\nid x\n\n1 1 0 0 0 1 -1\r\n2 2 1.5 2 3 .5 1\n 3 3 1e1 2 3 1 1 7 8\n")
    rows = read_swc(spark, str(f), extended=True).orderBy("row").collect()
    assert [(r.node_id, r.node_type, r.x, r.parent_id, r.extra) for r in rows] == [(1, 1, 0.0, -1, []), (2, 2, 1.5, 1, []), (3, 3, 10.0, 1, [7.0, 8.0])]
    assert [r.node_id for r in read_swc(spark, str(f), mode="d").collect()] == [1, 3]
    assert read_swc(spark, str(f), scale=(2, 3, 4)).where("node_id = 2").first()[4:8] == (3.0, 6.0, 12.0, 3.0)
    with pytest.raises(ValueError):
        read_swc(spark, str(f), mode="x")
    f.write_text("1 2 3\n")
    with pytest.raises(Exception, match="fewer than seven"):
        read_swc(spark, str(f)).collect()
    nums = [0.0, 1.0, 1.25, 0.0005, -0.0001, 242710.8125, 100.0, 0.1]
    got = spark.createDataFrame([(v,) for v in nums], "v double").select(number_text("v")).collect()
    assert [r[0] for r in got] == [f"{np.float32(v):.3f}".rstrip("0").rstrip(".") for v in nums]
    nodes = spark.createDataFrame([(1, 2, 0, 1.0, 2.0, 3.0, 0.5, 1), (1, 1, 1, 0.0, 0.0, 0.0, 1.0, None)], "neuron_id bigint, node_id int, node_type int, x double, y double, z double, radius double, parent_id int")
    write_swc(nodes, str(tmp_path / "swc"))
    text = "".join(p.read_text() for p in (tmp_path / "swc" / "neuron_id=1").glob("part*"))
    assert text == swc_text([(1, 1, 0, 0, 0, 1, -1), (2, 0, 1, 2, 3, 0.5, 1)])


def test_files_by_uri(spark, tmp_path):
    """Paths and URIs name the same files; names that look like patterns come first."""
    from voxtree.sources import files

    v = np.arange(24, dtype="u1").reshape(2, 3, 4)
    folder = tmp_path / "in put"
    for name in ("a[1].v3draw", "b.v3draw", "deep/c.v3draw"):
        d.write_volume(v, str(folder / name))
    plain, uri = str(folder), f"file://{folder}".replace(" ", "%20")
    assert [os.path.basename(f) for f in volume_files(plain)] == ["a[1].v3draw", "b.v3draw"] == [os.path.basename(f) for f in volume_files(uri)]
    assert all((d.read_volume(f) == v).all() for f in volume_files(uri))
    assert volume_files(f"{plain}/a[1].v3draw") == [f"{plain}/a[1].v3draw"] and volume_files(f"{plain}/[b].v3*") == [f"{plain}/b.v3draw"]
    assert [os.path.basename(f) for f in volume_files(f"{plain}/*/*.v3draw")] == ["c.v3draw"]
    with pytest.raises(FileNotFoundError):
        volume_files(f"{plain}/none*")
    out = f"file://{tmp_path}/out/x.v3draw"
    d.write_volume(v, out)
    assert (d.read_volume(out) == v).all() and d.read_header(out).volume_shape() == (2, 3, 4) and files.exists(out) and not files.exists(out + "y")
    with pytest.raises(FileExistsError):
        d.write_volume(v, out)
    assert read_volumes(spark, f"file://{tmp_path}/out", slab=1).count() == 2
    files.append(f"file://{tmp_path}/log/m", b"1")
    files.append(f"{tmp_path}/log/m", b"2")
    assert files.read(f"{tmp_path}/log/m") == b"12" and files.existing([out, f"{tmp_path}/log/m", "/none"]) == {out, f"{tmp_path}/log/m"}
