"""PNG images as grey levels: chunks, inflate, row filters, interlacing, every colour type and depth of the format.

Fixed values (of the format and of the usual luma): SIGNATURE, CHANNELS by colour type, PASSES of interlacing, LUMA in 1/65536.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
LUMA = np.array([19595, 38470, 7471])
#: Pixels of the largest image that is opened; a larger one is an error, so a few bytes can't fill a worker.
MAX_PIXELS = 1 << 27


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the image ends within a chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise ValueError("a chunk is cut or its checksum is wrong")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def _averaged(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    out = [0] * step
    for v, u in zip(row.tolist(), up.tolist()):
        out.append((v + (out[-step] + u) // 2) & 255)
    return np.array(out[step:], dtype=np.uint8)


def _predicted(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    out, above = [0] * step, [0] * step + up.tolist()
    for i, v in enumerate(row.tolist()):
        a, b, c = out[i], above[i + step], above[i]
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        out.append((v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255)
    return np.array(out[step:], dtype=np.uint8)


def _summed(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    padded = np.pad(row, (0, -len(row) % step)).reshape(-1, step)
    return np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(row)]


FILTERS = [lambda row, up, step: row, _summed, lambda row, up, step: row + up, _averaged, _predicted]


def _samples(raw: bytes, at: int, w: int, h: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """(h, w, channels) samples as stored, 16-bit ones by their high byte; and where the next pass begins."""
    length = (w * channels * depth + 7) // 8
    step, up, rows = max(1, channels * depth // 8), np.zeros(length, np.uint8), []
    for _ in range(h):
        if raw[at] >= len(FILTERS):
            raise ValueError("unknown row filter")
        up = FILTERS[raw[at]](np.frombuffer(raw, np.uint8, length, at + 1), up, step)
        rows.append(up)
        at += 1 + length
    packed = np.array(rows).reshape(h, length)
    if depth == 16:
        packed = packed[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(packed, axis=1)[:, : w * depth].reshape(h, w, depth)
        packed = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
    return packed.reshape(h, w, channels), at


def grey(data: bytes) -> np.ndarray:
    """(height, width) levels of 0 to 255; alpha is left out, palettes are looked up. Anything broken is a ValueError."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    body: dict[bytes, bytes] = {}
    for kind, part in _chunks(data):
        body[kind] = body.get(kind, b"") + part
    if len(body.get(b"IHDR", b"")) != 13 or b"IEND" not in body:
        raise ValueError("no header or no end")
    w, h, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", body[b"IHDR"])
    if not w or not h or w * h > MAX_PIXELS or depth not in DEPTHS.get(colour, ()) or packing or filtering or interlaced > 1:
        raise ValueError("a header that can't be read")
    n = CHANNELS[colour]
    parts = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else [(0, 0, 1, 1)])]
    parts = [p for p in parts if p[4] > 0 and p[5] > 0]
    size = sum(ph * (1 + (pw * n * depth + 7) // 8) for *_, pw, ph in parts)
    try:
        raw = zlib.decompressobj().decompress(body.get(b"IDAT", b""), size)
    except zlib.error as e:
        raise ValueError("pixels that can't be inflated") from e
    if len(raw) < size:
        raise ValueError("pixels are missing")
    out, at = np.zeros((h, w, n), np.uint8), 0
    for x, y, dx, dy, pw, ph in parts:
        out[y::dy, x::dx], at = _samples(raw, at, pw, ph, n, depth)
    if colour == 3:
        table = np.frombuffer(body.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if out.max() >= len(table):
            raise ValueError("a colour beyond the palette")
        out = table[out[:, :, 0]]
    elif depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    return out[:, :, 0] if out.shape[2] < 3 else ((out[:, :, :3] @ LUMA + 32768) >> 16).astype(np.uint8)


def encoded(samples: np.ndarray, colour: int = 0, depth: int = 8, palette: np.ndarray | None = None) -> bytes:
    """A PNG image of (h, w, channels) samples as they are stored, not interlaced; the row filters take turns."""
    h, w, n = samples.shape
    if depth == 16:
        packed = np.repeat(samples, 2, axis=2).reshape(h, -1)
    elif depth < 8:
        bits = np.unpackbits(samples.reshape(h, w, 1), axis=2)[:, :, 8 - depth :]
        packed = np.packbits(bits.reshape(h, -1), axis=1)
    else:
        packed = samples.reshape(h, -1)
    step = max(1, n * depth // 8)
    here = packed.astype(np.int64)
    left, up = np.pad(here, ((0, 0), (step, 0)))[:, : here.shape[1]], np.pad(here, ((1, 0), (0, 0)))[:h]
    corner = np.pad(up, ((0, 0), (step, 0)))[:, : here.shape[1]]
    pa, pb, pc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    guess = [0 * here, left, up, (left + up) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))]
    rows = b"".join(bytes([y % 5]) + ((here[y] - guess[y % 5][y]) & 255).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))
    table = b"" if palette is None else chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return SIGNATURE + head + table + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
