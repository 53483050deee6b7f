"""Volume files as arrays: V3DRAW, PBD, TIFF, NIfTI-1 and NRRD, and the arrays as files.

All decoders take bytes, so that they work on files and on columns of binaries alike. Bytes of the result
are in (z, y, x) order, with two exceptions that readers of these formats expect: NIfTI keeps the order of
its axes, and NRRD lists its axes from the slowest.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from voxtree.kernels.volume import as_volume
from voxtree.sources import files
from voxtree.sources.formats import format_of

# The first bytes of the raw and the packed format, and their pixel types.
RAW_KEY, PACKED_KEY = b"raw_image_stack_by_hpeng", b"v3d_volume_pkbitdf_encod"
RAW_TYPES = {1: "u1", 2: "u2", 4: "f4", 33: "u1"}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
NRRD_TYPES = {
    "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1", "signed char": "i1", "int8": "i1", "int8_t": "i1", "short": "i2", "int16": "i2", "int16_t": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2",
    "int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4", "longlong": "i8", "int64": "i8", "int64_t": "i8", "ulonglong": "u8", "uint64": "u8", "uint64_t": "u8", "float": "f4", "double": "f8",
}
_VAA_HEADER = 43


@dataclass
class Header:
    """What a file says of its volume before any pixel is read."""

    format: str
    shape: tuple[int, ...]
    dtype: np.dtype
    offset: int = 0
    metadata: dict[str, str] = field(default_factory=dict)

    def volume_shape(self) -> tuple[int, int, int]:
        """Without single axes, and with leading ones up to three."""
        dims = tuple(d for d in self.shape if d != 1)
        if len(dims) > 3:
            raise ValueError(f"{len(dims)} dimensions are too many for a volume")
        return (1,) * (3 - len(dims)) + dims


def _vaa_header(data: bytes, key: bytes, name: str) -> Header:
    if len(data) < _VAA_HEADER:
        raise ValueError("the file ends inside its header")
    if data[: len(key)] != key:
        raise ValueError("the file does not begin as its format does")
    order = {b"B": ">", b"L": "<"}.get(data[24:25])
    if order is None:
        raise ValueError(f"unknown byte order {data[24:25]!r}")
    code, *dims = struct.unpack(f"{order}h4i", data[25:_VAA_HEADER])
    if code not in RAW_TYPES:
        raise ValueError(f"unknown pixel type {code}")
    return Header(name, tuple(dims[::-1]), np.dtype(order + RAW_TYPES[code]), _VAA_HEADER, {"order": order, "type": str(code), "dims_xyzc": ",".join(map(str, dims))})


def _raw_pixels(data: bytes, h: Header) -> np.ndarray:
    if h.metadata["type"] == "33":
        raise NotImplementedError("pixels of type 33 are not decoded")
    body = data[h.offset :]
    if len(body) != int(np.prod(h.shape)) * h.dtype.itemsize:
        raise ValueError("the file's length does not fit its header")
    return np.frombuffer(body, h.dtype).reshape(h.shape)


def _bits(data: bytes, width: int, count: int) -> np.ndarray:
    """``count`` numbers of ``width`` bits, highest first."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: width * count].reshape(count, width)
    return bits @ (1 << np.arange(width - 1, -1, -1))


#: Of each packed format: codes below ``literal`` copy, codes from ``repeat`` on repeat, those between hold
#: differences of (first code, bits, largest positive difference).
_PACKED = {1: (33, 128, ((33, 2, 2),)), 2: (32, 223, ((32, 3, 4), (80, 4, 8), (183, 5, 16)))}


def unpack(data: bytes, size: int, item: int, order: str) -> np.ndarray:
    """The pixels of a packed stream of 1- or 2-byte values."""
    literal, repeat, ranges = _PACKED[item]
    kind = np.dtype(order + f"u{item}")
    out, at, done, last = np.empty(size, f"u{item}"), 0, 0, 0
    while at < len(data):
        code, at = data[at], at + 1
        if code < literal:
            n, take = code + 1, (code + 1) * item
        elif code >= repeat:
            n, take = code - repeat + 1, item
        else:
            first, width, top = next(r for r in reversed(ranges) if code >= r[0])
            n = code - first + 1
            take = (n * width + 7) // 8
        block = data[at : at + take]
        if len(block) < take or done + n > size:
            raise ValueError("a packed block does not fit")
        at += take
        if code < literal or code >= repeat:
            out[done : done + n] = np.frombuffer(block, kind)
        else:
            if item == 1:  # four differences a byte, lowest bits first
                steps = ((np.frombuffer(block, np.uint8)[:, None] >> np.array([0, 2, 4, 6])) & 3).ravel()[:n].astype(np.int64)
                steps[steps == 3] = -1
            else:
                steps = _bits(block, width, n).astype(np.int64)
                steps = np.where(steps > top, top - steps, steps)
            out[done : done + n] = (last + np.cumsum(steps)) & (0xFF if item == 1 else 0xFFFF)
        done += n
        last = int(out[done - 1])
    if done != size:
        raise ValueError("the unpacked size does not fit the header")
    return out


def _packed_pixels(data: bytes, h: Header) -> np.ndarray:
    if h.metadata["type"] not in ("1", "2"):
        raise NotImplementedError(f"packed pixels of type {h.metadata['type']} are not decoded")
    return unpack(data[h.offset :], int(np.prod(h.shape)), h.dtype.itemsize, h.metadata["order"]).reshape(h.shape)


# ---- TIFF ----

_TIFF_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _tiff_pages(data: bytes) -> tuple[str, list[dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file of 32-bit offsets")
    at, pages = struct.unpack(order + "I", data[4:8])[0], []
    while at:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in _TIFF_SIZES:
                continue
            code = f"{count}s" if kind == 2 else _TIFF_SIZES[kind] * count
            place = at + 2 + 12 * k + 8
            if struct.calcsize(order + code) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = struct.unpack_from(order + code, data, place)
        pages.append(tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    if not pages:
        raise ValueError("a TIFF file without pages")
    return order, pages


def _tiff_header(data: bytes) -> Header:
    order, pages = _tiff_pages(data)
    p = pages[0]
    bits, kind = p.get(258, (1,))[0], {1: "u", 2: "i", 3: "f"}[p.get(339, (1,))[0]]
    if bits % 8 or p.get(277, (1,))[0] != 1:
        raise ValueError("only single samples of whole bytes are read")
    text = p[270][0].rstrip(b"\0").decode("utf-8", "replace") if 270 in p else ""
    same = [q for q in pages if (q[257][0], q[256][0]) == (p[257][0], p[256][0])]
    n = len(same)
    if n == 1 and text.startswith("ImageJ") and (m := re.search(r"^images=(\d+)", text, re.MULTILINE)):
        n = int(m[1])
    return Header("tiff", (n, p[257][0], p[256][0]) if n > 1 else (p[257][0], p[256][0]), np.dtype(f"{order}{kind}{bits // 8}"), 0, {"order": order, "pages": str(n)} | ({"description": text} if text else {}))


def _tiff_pixels(data: bytes, h: Header) -> np.ndarray:
    _, pages = _tiff_pages(data)
    out, want = [], int(np.prod(h.shape[-2:])) * h.dtype.itemsize
    if len(pages) == 1 and len(h.shape) == 3:
        start = pages[0][273][0]
        return np.frombuffer(data, h.dtype, int(np.prod(h.shape)), start).reshape(h.shape)
    for p in pages[: h.shape[0] if len(h.shape) == 3 else 1]:
        how, body = p.get(259, (1,))[0], bytearray()
        for start, n in zip(p[273], p[279], strict=True):
            strip = data[start : start + n]
            if how in (8, 32946):
                strip = zlib.decompress(strip)
            elif how != 1:
                raise NotImplementedError(f"TIFF compression {how} is not read")
            if p.get(317, (1,))[0] == 2:
                rows = np.frombuffer(strip, h.dtype).reshape(-1, h.shape[-1])
                strip = np.cumsum(rows, 1, dtype=h.dtype.newbyteorder("=")).astype(h.dtype).tobytes()
            body += strip
        if len(body) < want:
            raise ValueError("a TIFF page is too short")
        out.append(np.frombuffer(bytes(body[:want]), h.dtype).reshape(h.shape[-2:]))
    return np.stack(out).reshape(h.shape)


# ---- NIfTI-1 ----


def _nifti_header(data: bytes) -> Header:
    order = next((o for o in "<>" if len(data) >= 348 and struct.unpack(o + "i", data[:4])[0] == 348), None)
    if order is None:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", data[40:56])
    (code,) = struct.unpack(order + "h", data[70:72])
    if code not in NIFTI_TYPES:
        raise ValueError(f"unknown NIfTI type {code}")
    zooms = struct.unpack(order + "8f", data[76:108])[1 : dim[0] + 1]
    offset, slope, shift = struct.unpack(order + "3f", data[108:120])
    meta = {"zooms": ",".join(f"{z:g}" for z in zooms), "slope": repr(slope), "shift": repr(shift), "order": order}
    return Header("nifti", tuple(dim[1 : dim[0] + 1]), np.dtype(order + NIFTI_TYPES[code]), int(offset) or 352, meta)


def _nifti_pixels(data: bytes, h: Header) -> np.ndarray:
    a = np.frombuffer(data, h.dtype, int(np.prod(h.shape)), h.offset).reshape(h.shape, order="F")
    slope, shift = float(h.metadata["slope"]), float(h.metadata["shift"])
    return a * slope + shift if np.isfinite(slope) and slope not in (0.0, 1.0) or (slope == 1.0 and shift) else a


# ---- NRRD ----


def _nrrd_header(data: bytes) -> Header:
    if not data.startswith(b"NRRD000"):
        raise ValueError("not an NRRD file")
    end = re.search(rb"\r?\n\r?\n", data)
    text = data[: end.start() if end else len(data)].decode("ascii", "replace")
    fields = {k.strip().lower(): v.strip() for k, _, v in (ln.partition(":") for ln in text.splitlines()[1:] if not ln.startswith("#")) if v}
    kind = NRRD_TYPES.get(fields.get("type", ""))
    if kind is None:
        raise ValueError(f"unknown NRRD type {fields.get('type')!r}")
    order = ">" if fields.get("endian", "little") == "big" else "<"
    sizes = tuple(map(int, fields["sizes"].split()))
    return Header("nrrd", sizes[::-1], np.dtype(order + kind), end.end() if end else len(data), fields)


def _nrrd_pixels(data: bytes, h: Header, directory: str | None = None) -> np.ndarray:
    body, name = data[h.offset :], h.metadata.get("data file") or h.metadata.get("datafile")
    if name:
        body = files.read(files.joined(directory or ".", name))
    how = h.metadata.get("encoding", "raw")
    if how in ("gzip", "gz"):
        body = gzip.decompress(body)
    elif how in ("text", "txt", "ascii"):
        return np.array(body.split(), h.dtype).reshape(h.shape)
    elif how != "raw":
        raise NotImplementedError(f"NRRD encoding {how} is not read")
    return np.frombuffer(body, h.dtype, int(np.prod(h.shape))).reshape(h.shape)


# ---- all formats ----

_HEADERS = {"v3draw": lambda d: _vaa_header(d, RAW_KEY, "v3draw"), "v3dpbd": lambda d: _vaa_header(d, PACKED_KEY, "v3dpbd"), "tiff": _tiff_header, "nifti": _nifti_header, "nrrd": _nrrd_header}
_PIXELS = {"v3draw": _raw_pixels, "v3dpbd": _packed_pixels, "tiff": _tiff_pixels, "nifti": _nifti_pixels}


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def header_of(data: bytes, kind: str) -> Header:
    """The header in a file's bytes."""
    return _HEADERS[kind](_plain(data) if kind == "nifti" else data)


def decode(data: bytes, kind: str, directory: str | None = None) -> np.ndarray:
    """The volume in a file's bytes, in native byte order."""
    data = _plain(data) if kind == "nifti" else data
    h = _HEADERS[kind](data)
    a = _nrrd_pixels(data, h, directory) if kind == "nrrd" else _PIXELS[kind](data, h)
    return np.ascontiguousarray(as_volume(a.astype(a.dtype.newbyteorder("="), copy=False)))


def read_header(path: str) -> Header:
    """The header of a file; of raw formats no pixel is read."""
    kind = format_of(path)
    return header_of(files.read(path, 0, _VAA_HEADER if kind in ("v3draw", "v3dpbd") else None), kind)


def read_volume(path: str) -> np.ndarray:
    """The volume in a file."""
    return decode(files.read(path), format_of(path), os.path.dirname(path))


def encode(volume: np.ndarray, kind: str, compressed: bool = False) -> bytes:
    """A volume as the bytes of a file; packed files are not written."""
    a = as_volume(np.asarray(volume))
    little = np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"), copy=False))
    if kind == "v3draw":
        code = {"u1": 1, "u2": 2, "f4": 4}.get(a.dtype.str[1:])
        if code is None:
            raise ValueError(f"{a.dtype} is not a type of this format")
        return RAW_KEY + b"L" + struct.pack("<h4i", code, *a.shape[::-1], 1) + little.tobytes()
    if kind == "nrrd":
        names = {v: k for k, v in reversed(NRRD_TYPES.items())}
        head = f"NRRD0004\ntype: {names[a.dtype.str[1:]]}\ndimension: 3\nsizes: {' '.join(map(str, a.shape[::-1]))}\nendian: little\nencoding: gzip\n\n"
        return head.encode() + gzip.compress(little.tobytes(), mtime=0)
    if kind == "nifti":
        code = {v: k for k, v in NIFTI_TYPES.items()}[a.dtype.str[1:]]
        head = bytearray(352)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, 3, *a.shape, 1, 1, 1, 1)
        struct.pack_into("<2h", head, 70, code, a.dtype.itemsize * 8)
        struct.pack_into("<8f", head, 76, *[1.0] * 8)
        struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
        head[344:348] = b"n+1\0"
        body = bytes(head) + little.tobytes(order="F")
        return gzip.compress(body, mtime=0) if compressed else body
    if kind == "tiff":
        form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        out, page = bytearray(b"II*\0" + struct.pack("<I", 8)), a[0].nbytes
        for i in range(len(a)):
            tags = [(256, 4, a.shape[2]), (257, 4, a.shape[1]), (258, 3, a.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, a.shape[1]), (279, 4, page), (339, 3, form)]
            start = len(out) + 2 + 12 * len(tags) + 4
            following = start + page if i + 1 < len(a) else 0
            out += struct.pack("<H", len(tags))
            for tag, kind_, value in tags:
                out += struct.pack("<HHII", tag, kind_, 1, start if tag == 273 else value)
            out += struct.pack("<I", following) + little[i].tobytes()
        return bytes(out)
    raise ValueError(f"files of the format {kind} are not written")


def write_volume(volume: np.ndarray, path: str, overwrite: bool = False) -> None:
    """Write a file in the format of its suffix."""
    if not overwrite and files.exists(path):
        raise FileExistsError(path)
    files.write(path, encode(volume, format_of(path), path.lower().endswith(".gz")))


def convert(source: str, target: str, overwrite: bool = False) -> None:
    """A file in another format."""
    write_volume(read_volume(source), target, overwrite)
