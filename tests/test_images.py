"""Image files that the tests write, line by line in every form."""

import struct
import zlib

import numpy as np
import pytest

from tidewake.sources import images, readers


def png(x: np.ndarray, kinds=(0, 1, 2, 3, 4), colour: int = 0, palette: np.ndarray | None = None) -> bytes:
    h, w, channels = x.shape
    size = x.dtype.itemsize
    lines = x.astype(x.dtype.newbyteorder(">")).tobytes()
    stride, step = w * channels * size, channels * size
    rows = [lines[i * stride : (i + 1) * stride] for i in range(h)]
    out, above = b"", bytes(stride)
    for i, row in enumerate(rows):
        kind, told = kinds[i % len(kinds)], bytearray()
        for j in range(stride):
            a, b, c = row[j - step] if j >= step else 0, above[j], above[j - step] if j >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            told.append((row[j] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out, above = out + bytes([kind]) + bytes(told), row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = chunk(b"IHDR", struct.pack(">2I5B", w, h, 8 * size, colour, 0, 0, 0))
    body += chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    data = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


def tiff(x: np.ndarray, order: str = "<", packing: int = 1, rows: int = 3) -> bytes:
    h, w, channels = x.shape
    kind = x.dtype.newbyteorder(order)
    strips = [x[i : i + rows].astype(kind).tobytes() for i in range(0, h, rows)]
    strips = strips if packing == 1 else [zlib.compress(s) for s in strips]
    starts = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    far = 8 + sum(map(len, strips))
    n, form = len(strips), {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8 * x.dtype.itemsize), (259, 3, 1, packing), (273, 4, n, far if n > 1 else starts[0]), (277, 3, 1, channels), (279, 4, n, far + 4 * n if n > 1 else len(strips[0])), (339, 3, 1, form)]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, far + 8 * n) + b"".join(strips) + struct.pack(f"{order}{n}I", *starts) + struct.pack(f"{order}{n}I", *map(len, strips))
    value = lambda k, v: struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)
    return out + struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "2HI", t, k, c) + value(k, v) for t, k, c, v in tags) + bytes(4)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize(("channels", "colour"), [(1, 0), (3, 2), (2, 4), (4, 6)])
def test_png(kind, channels, colour):
    x = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (11, 7, channels)).astype(kind)
    want = x[..., 0] if channels < 3 else x[..., :3] @ np.array([0.299, 0.587, 0.114])
    assert np.allclose(images.png(png(x, colour=colour)), want)


def test_png_with_a_palette_and_others():
    palette = np.random.default_rng(2).integers(0, 255, (5, 3)).astype(np.uint8)
    x = np.arange(20, dtype=np.uint8).reshape(4, 5, 1) % 5
    assert np.allclose(images.png(png(x, colour=3, palette=palette)), palette[x[..., 0]] @ np.array([0.299, 0.587, 0.114]))
    for bad in (b"GIF89a", png(x)[:28] + b"\x01" + png(x)[29:]):
        with pytest.raises(ValueError):
            images.png(bad)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
@pytest.mark.parametrize("packing", [1, 8])
def test_tiff(order, kind, packing):
    x = (np.random.default_rng(3).random((8, 5, 1)) * 200).astype(kind)
    for rows in (3, 8):
        assert np.allclose(images.tiff(tiff(x, order, packing, rows)), x[..., 0])
    with pytest.raises(ValueError):
        images.tiff(tiff(x, order, 5))


def test_patches_of_all_kinds(spark, tmp_path):
    (tmp_path / "oil").mkdir()
    (tmp_path / "lookalike").mkdir()
    x = np.full((3, 4, 1), 100, np.uint8)
    np.save(tmp_path / "oil" / "a.npy", x[..., 0])
    (tmp_path / "oil" / "b.png").write_bytes(png(x))
    (tmp_path / "lookalike" / "c.TIF").write_bytes(tiff(x))
    (tmp_path / "lookalike" / "d.txt").write_text("no image")
    got = sorted((r.path[-5:], r.label, r.h, r.w, set(r.db)) for r in readers.labelled_patches(spark, str(tmp_path)).collect())
    assert got == [("a.npy", 1, 3, 4, {20.0}), ("b.png", 1, 3, 4, {20.0}), ("c.TIF", 0, 3, 4, {20.0})]
