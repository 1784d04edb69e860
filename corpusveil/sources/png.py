"""PNG images as arrays and back, with the standard library only.

Bit depths 8 and below, all colour types, without interlacing; 16-bit samples keep their high
byte. Anything else raises ValueError, so that a file goes to a provider or gives an error row."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(content: bytes):
    at = len(MAGIC)
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    """Undoes the row filters, runs of rows with one filter at once; step: bytes per pixel."""
    lines = raw[: rows * (stride + 1)].reshape(rows, stride + 1)
    kinds, lines = lines[:, 0], lines[:, 1:]
    if not kinds.any():
        return lines
    out = np.zeros((rows + 1, stride), np.uint8)
    heads = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])).tolist()
    for y, end in zip(heads, [*heads[1:], rows], strict=True):
        kind, new, some = kinds[y], out[y + 1 : end + 1], lines[y:end]
        if kind == 0:
            new[:] = some
        elif kind == 1:
            whole = stride - stride % step
            new[:, :whole] = np.cumsum(some[:, :whole].reshape(end - y, -1, step), axis=1, dtype=np.uint8).reshape(end - y, whole)
        elif kind == 2:
            np.cumsum(some, axis=0, dtype=np.uint8, out=new)
            new += out[y]
        elif kind in (3, 4):
            for k, line in enumerate(some.tolist(), y):
                now, above = [0] * step + line, [0] * step + out[k].tolist()
                for i in range(step, len(now)):
                    a, b, c = now[i - step], above[i], above[i - step]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    now[i] = (now[i] + guess) & 255
                out[k + 1] = now[step:]
        else:
            raise ValueError("Not a readable PNG image")
    return out[1:]


def decode(content: bytes) -> np.ndarray:
    """Rows x columns x channels (1 grey, 2 grey and alpha, 3 RGB, 4 RGBA), 8 bits each."""
    if not content.startswith(MAGIC):
        raise ValueError("Not a PNG image")
    head, palette, data = None, None, []
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[6] or head[3] not in SAMPLES or not head[0] or not head[1]:
        raise ValueError("Not a readable PNG image")
    width, height, depth, colour = head[:4]
    samples = SAMPLES[colour]
    stride = -(-width * samples * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) < height * (stride + 1):
        raise ValueError("Not a readable PNG image")
    rows = _unfiltered(raw, height, stride, max(1, samples * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
        rows = rows if colour == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
    image = rows[:, : width * samples].reshape(height, width, samples)
    return palette[np.minimum(image[:, :, 0], len(palette) - 1)] if colour == 3 and palette is not None else image


def encode(image: np.ndarray) -> bytes:
    """Rows as differences from the one above, which makes up for the fast compression."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width, channels = image.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    raw = np.zeros((height, width * channels + 1), np.uint8)
    rows = image.reshape(height, -1)
    raw[:1, 1:], raw[1:, 0] = rows[:1], 2
    np.subtract(rows[1:], rows[:-1], out=raw[1:, 1:])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a decoded image, alpha left out."""
    if image.shape[2] < 3:
        return image[:, :, 0]
    if (image[:, :, 0] == image[:, :, 1]).all() and (image[:, :, 1] == image[:, :, 2]).all():
        return image[:, :, 0]
    #: Weights of red, green and blue.
    return np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
