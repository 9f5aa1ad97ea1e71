"""PNG files as arrays: all colour types and depths, interlaced or not, in numpy.

Filters that depend on the pixel to the left are undone along diagonals: all rows of an image advance
together, one pixel behind the row above, so no loop runs over single pixels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the PNG standard: signature, samples of each colour type, the seven passes (x, y, step x, step y).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
PLAIN, LEFT, UP, MEAN, PAETH = range(5)


class BadImage(ValueError):
    """What is wrong with an image file."""


def size_of(data: bytes) -> tuple[int, int, int, int, bool]:
    """Width, height, bits a sample, colour type, interlaced: from the first 29 bytes."""
    if not data:
        raise BadImage("empty file")
    if len(data) < 29 or data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise BadImage("no PNG header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if not width or not height or colour not in SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise BadImage("impossible PNG header")
    return width, height, depth, colour, bool(interlaced)


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        check = data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise BadImage(f"damaged chunk at byte {at}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise BadImage("file ends early")


def _unfiltered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the lines (height, bytes) with their filters undone; ``step`` bytes lie between a byte and its left one."""
    if kinds.max(initial=0) > PAETH:
        raise BadImage("unknown filter")
    height, width = lines.shape
    if not np.isin(kinds, (MEAN, PAETH)).any():
        out = lines.copy()
        for r in range(height):
            if kinds[r] == LEFT:
                row = np.zeros(-(-width // step) * step, np.uint8)
                row[:width] = lines[r]
                out[r] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
            elif kinds[r] == UP and r:
                out[r] += out[r - 1]
        return out
    across = -(-width // step)
    raw = np.zeros((height, across * step), np.int16)
    raw[:, :width] = lines
    raw = raw.reshape(height, across, step)
    out = np.zeros_like(raw)
    kind = kinds.astype(np.int8)[:, None]
    last, older = np.zeros((height + 1, step), np.int16), np.zeros((height + 1, step), np.int16)  # row 0 stands above the image
    for t in range(across + height - 1):
        low, high = max(0, t - across + 1), min(height, t + 1)
        rows = np.arange(low, high)
        left, up, corner = last[low + 1 : high + 1], last[low:high], older[low:high]
        if low == 0 and t:
            up, corner = up.copy(), corner.copy()
            up[0] = corner[0] = 0
        if t < height:
            left = left.copy()
            left[t - low] = 0  # this row begins
            corner = corner.copy()
            corner[t - low] = 0
        k = kind[low:high]
        a, b = np.abs(up - corner), np.abs(left - corner)
        c = np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([k == LEFT, k == UP, k == MEAN, k == PAETH], [left, up, (left + up) >> 1, paeth], 0)
        value = (raw[rows, t - rows] + guess) & 255
        out[rows, t - rows] = value
        older, last = last, last.copy()
        last[low + 1 : high + 1] = value
    return out.reshape(height, across * step)[:, :width].astype(np.uint8)


def _samples(raw: bytes, at: int, width: int, height: int, depth: int, per: int) -> tuple[np.ndarray, int]:
    """One (partial) image of (height, width, samples) from the inflated bytes, and where the next begins."""
    line = (width * per * depth + 7) // 8
    end = at + height * (line + 1)
    if len(raw) < end:
        raise BadImage("too little image data")
    table = np.frombuffer(raw, np.uint8, height * (line + 1), at).reshape(height, line + 1)
    flat = _unfiltered(table[:, 1:], table[:, 0], max(1, per * depth // 8))
    if depth == 16:
        flat = flat[:, ::2]  # the high byte
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return flat[:, : width * per].reshape(height, width, per), end


def decode(data: bytes, max_pixels: int) -> np.ndarray:
    """(height, width, channels) bytes; channels are R, G, B or one grey, transparency is left out.

    ``BadImage`` if the file is damaged or has more than ``max_pixels`` pixels: those are never inflated.
    """
    width, height, depth, colour, interlaced = size_of(data)
    if width * height > max_pixels:
        raise BadImage(f"{width} x {height} pixels, {max_pixels} allowed")
    packed, palette = [], None
    for kind, body in _chunks(data):
        if kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
    per = SAMPLES[colour]
    most = (height + 7 * bool(interlaced) + 7) * ((width * per * depth + 7) // 8 + 9) * 2 + 64
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), most)
    except zlib.error as error:
        raise BadImage(f"damaged image data: {error}") from None
    if interlaced:
        cube, at = np.empty((height, width, per), np.uint8), 0
        for x, y, dx, dy in PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                cube[y::dy, x::dx], at = _samples(raw, at, w, h, depth, per)
    else:
        cube, _ = _samples(raw, 0, width, height, depth, per)
    if colour == 3:
        if palette is None or cube.max() >= len(palette):
            raise BadImage("colour outside the palette")
        return palette[cube[:, :, 0]]
    if colour == 0 and depth < 8:
        cube = cube * np.uint8(255 // ((1 << depth) - 1))
    return cube[:, :, :1] if per <= 2 else cube[:, :, :3]


def encode(cube: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """A PNG file of (height, width, 1 or 3) bytes; ``kinds`` are the filters of its lines (by default none)."""
    height, width, per = cube.shape
    lines = np.ascontiguousarray(cube, np.uint8).reshape(height, width * per).astype(np.int16)
    kinds = np.zeros(height, np.uint8) if kinds is None else np.asarray(kinds, np.uint8)
    left = np.pad(lines, ((0, 0), (per, 0)))[:, :-per]
    up, corner = np.pad(lines, ((1, 0), (0, 0)))[:-1], np.pad(left, ((1, 0), (0, 0)))[:-1]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    k = kinds[:, None]
    guess = np.select([k == LEFT, k == UP, k == MEAN, k == PAETH], [left, up, (left + up) >> 1, paeth], 0)
    table = np.concatenate([k, ((lines - guess) & 255).astype(np.uint8)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if per == 1 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(table.tobytes(), 1)) + chunk(b"IEND", b"")
