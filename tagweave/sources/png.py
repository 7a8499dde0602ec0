"""PNG files of 8 bits a channel to arrays and back: the one codec that stages over files need without a library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One row of bytes; ``step`` bytes lie between a byte and its left neighbour."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        columns = line.reshape(-1, step)
        return np.cumsum(columns, axis=0, dtype=np.uint8).reshape(-1)
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i, value in enumerate(out):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            corner = up[i - step] if i >= step else 0
            guess = min((left, up[i], corner), key=lambda n, p=left + up[i] - corner: abs(p - n))
        out[i] = (value + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def decoded(data: bytes | None) -> np.ndarray | None:
    """height x width x 3 or 4 (grey and palettes become colours); null for what is no plain 8-bit PNG."""
    if not data or not data.startswith(SIGNATURE):
        return None
    packed, palette, head = b"", None, None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        return None
    w, h, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, ValueError):
        return None
    out, above = np.empty((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
    image = out.reshape(h, w, channels)
    if palette is not None and head[3] == 3:
        return palette[image[:, :, 0]]
    return image if channels > 2 else np.concatenate([image[:, :, :1]] * 3 + [image[:, :, 1:]], axis=2)


def strips(data: bytes | None, lines: int):
    """(top, lines x width x 3 or 4, width, height) of a plain 8-bit colour PNG, unpacked line by line; nothing for any other file."""
    if not data or not data.startswith(SIGNATURE):
        return
    head, unpack, left, above, held, top = None, zlib.decompressobj(), b"", None, [], 0
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            if head[2] != 8 or head[6] or head[3] not in (2, 6):
                return
            w, h, channels = head[0], head[1], CHANNELS[head[3]]
            above = np.zeros(w * channels, np.uint8)
        elif kind == b"IDAT" and head is not None:
            while body:
                left += unpack.decompress(body, 1 << 20)
                body = unpack.unconsumed_tail
                size, at = 1 + w * channels, 0
                while len(left) - at >= size:
                    above = _unfiltered(left[at], np.frombuffer(left, np.uint8, size - 1, at + 1), above, channels)
                    held.append(above)
                    at += size
                    if len(held) == lines:
                        yield top, np.stack(held).reshape(-1, w, channels), w, h
                        top, held = top + lines, []
                left = left[at:]
    if held:
        yield top, np.stack(held).reshape(-1, w, channels), w, h


def encoded(image: np.ndarray) -> bytes:
    """An array of 1, 3 or 4 channels as a PNG file."""
    image = np.asarray(image, np.uint8)
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, channels = image.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
