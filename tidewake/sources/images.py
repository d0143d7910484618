"""Grey levels of labelled patches' image files: PNG without interlace, and TIFF of uncompressed or deflated strips.

Small helpers of ``readers.labelled_patches``; a file is one crop of some hundred
pixels a side.  Colours become grey by the usual weights (0.299, 0.587, 0.114),
opacity is passed over.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_GREY = np.array([0.299, 0.587, 0.114])


def grey(x: np.ndarray) -> np.ndarray:
    """(h, w, channels) as (h, w): one or two channels are grey (and opacity), three or four colours (and opacity)."""
    return x[..., 0].astype(float) if x.shape[-1] < 3 else x[..., :3] @ _GREY


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """The bytes of each line; a line names how it was predicted from what lies left and above."""
    out = np.zeros((h + 1, stride), np.uint8)
    for i in range(h):
        kind, line = raw[i * (stride + 1)], np.frombuffer(raw, np.uint8, stride, i * (stride + 1) + 1)
        above, now = out[i].astype(np.int64), out[i + 1]
        if kind in (0, 2):
            now[:] = line if kind == 0 else (line + above) & 255
        elif kind == 1:
            for c in range(step):
                now[c::step] = np.cumsum(line[c::step], dtype=np.int64) & 255
        elif kind in (3, 4):
            for j in range(stride):
                left, corner = (int(now[j - step]), int(above[j - step])) if j >= step else (0, 0)
                up = int(above[j])
                guess = (left + up) // 2
                if kind == 4:
                    near = left + up - corner
                    guess = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
                now[j] = (int(line[j]) + guess) & 255
        else:
            raise ValueError(f"line of kind {kind}")
    return out[1:]


def png(content: bytes) -> np.ndarray:
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, data, palette = 8, b"", None
    w = h = depth = colour = 0
    while at < len(content):
        (n,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">2I5B", body)
            if interlace or depth not in (8, 16):
                raise ValueError("PNG files must have 8 or 16 bits and no interlace")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    channels, size = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], depth // 8
    lines = _unfiltered(zlib.decompress(data), h, w * channels * size, channels * size)
    x = np.ascontiguousarray(lines).view(">u2" if size == 2 else np.uint8).reshape(h, w, channels)
    return grey(palette[x[..., 0]] if colour == 3 else x)


def tiff(content: bytes) -> np.ndarray:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    kinds = {1: "B", 3: "H", 4: "I"}
    (at,) = struct.unpack(order + "I", content[4:8])
    tags = {}
    for i in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        entry = content[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "2HI", entry[:8])
        if kind in kinds:
            size = struct.calcsize(kinds[kind]) * n
            start = struct.unpack(order + "I", entry[8:])[0]
            tags[tag] = struct.unpack(f"{order}{n}{kinds[kind]}", entry[8 : 8 + size] if size <= 4 else content[start : start + size])
    w, h, packing = tags[256][0], tags[257][0], tags.get(259, (1,))[0]
    channels, bits, form = tags.get(277, (1,))[0], tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    if packing not in (1, 8, 32946) or bits not in (8, 16, 32) or tags.get(317, (1,))[0] != 1 or tags.get(284, (1,))[0] != 1 or 273 not in tags:
        raise ValueError("TIFF files must hold strips of 8, 16 or 32 bits, uncompressed or deflated")
    strips = (content[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
    data = b"".join(s if packing == 1 else zlib.decompress(s) for s in strips)
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    return grey(np.frombuffer(data, kind, w * h * channels).reshape(h, w, channels))
