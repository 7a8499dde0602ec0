"""Image sizes from ranged reads of the header: PNG, GIF, BMP, JPEG, WebP, and the box trees of AVIF and HEIF.

A reader is a function (offset, length) -> bytes, shorter at the end of the file.  Only what the walk over segments or boxes
asks for is read, never a whole image.  Sizes are those stored, before any rotation that metadata asks for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

Reader = Callable[[int, int], bytes]
Size = tuple[int, int]

# What the formats begin with, and the brands of HEIF files.
PNG, GIF, JPEG, BMP = b"\x89PNG\r\n\x1a\n", b"GIF8", b"\xff\xd8", b"BM"
BRANDS = (b"avif", b"avis", b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1")
_STEPS = 4096  # boxes or segments looked at before a file counts as broken


def cached(read: Reader, first: int = 1 << 14) -> Reader:
    """A reader that asks for the first bytes once."""
    head = read(0, first)

    def at(offset: int, length: int) -> bytes:
        if offset + length <= len(head) or len(head) < first:
            return head[offset : offset + length]
        return read(offset, length)

    return at


def _bmp(at: Reader) -> Size:
    if struct.unpack("<I", at(14, 4))[0] == 12:
        return struct.unpack("<HH", at(18, 4))
    w, h = struct.unpack("<ii", at(18, 8))
    return w, abs(h)


def _webp(at: Reader) -> Size | None:
    kind = at(12, 4)
    if kind == b"VP8X":
        d = at(24, 6)
        return 1 + int.from_bytes(d[:3], "little"), 1 + int.from_bytes(d[3:6], "little")
    if kind == b"VP8L":
        n = struct.unpack("<I", at(21, 4))[0]
        return 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", at(26, 4))
        return w & 0x3FFF, h & 0x3FFF
    return None


def _jpeg(at: Reader) -> Size | None:
    """The first frame header; a marker may be preceded by fill bytes."""
    place = 2
    for _ in range(_STEPS):
        d = at(place, 9)
        if len(d) < 4 or d[0] != 0xFF:
            return None
        kind = d[1]
        if kind == 0xFF:
            place += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            place += 2
        elif kind in (0xD9, 0xDA):
            return None
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", d[5:9])
            return w, h
        else:
            place += 2 + struct.unpack(">H", d[2:4])[0]
    return None


def _boxes(at: Reader, start: int, end: int | None) -> Iterator[tuple[bytes, int, int | None]]:
    """(kind, first byte of the payload, its end) of the boxes from ``start`` on; an end of None is that of the file."""
    for _ in range(_STEPS):
        d = at(start, 16)
        if (end is not None and start + 8 > end) or len(d) < 8:
            return
        size, kind = struct.unpack(">I4s", d[:8])
        head = 8
        if size == 1:
            if len(d) < 16:
                return
            size, head = struct.unpack(">Q", d[8:16])[0], 16
        if size and size < head:
            return
        stop = start + size if size else end
        yield kind, start + head, stop
        if stop is None:
            return
        start = stop


def _primary(at: Reader, start: int) -> int:
    d = at(start, 8)
    return struct.unpack(">H", d[4:6])[0] if d[0] == 0 else struct.unpack(">I", d[4:8])[0]


def _properties_of(at: Reader, start: int, stop: int, item: int) -> list[int]:
    """Numbers (from 1) of the properties that an association box gives an item."""
    d = at(start, stop - start)
    version, wide, place = d[0], d[3] & 1, 8
    for _ in range(struct.unpack(">I", d[4:8])[0]):
        named = struct.unpack_from(">H" if version < 1 else ">I", d, place)[0]
        place += 2 if version < 1 else 4
        count = d[place]
        place += 1
        if named == item:
            found = struct.unpack_from(f">{count}{'H' if wide else 'B'}", d, place)
            return [n & (0x7FFF if wide else 0x7F) for n in found]
        place += count * (2 if wide else 1)
    return []


def _heif(at: Reader) -> Size | None:
    """The extent that belongs to the primary item."""
    for kind, start, end in _boxes(at, 0, None):
        if kind != b"meta":
            continue
        item, extents, wanted = None, {}, []
        inside = list(_boxes(at, start + 4, end))
        for child, a, _ in inside:
            if child == b"pitm":
                item = _primary(at, a)
        for child, a, b in inside:
            if child != b"iprp":
                continue
            for part, c, d in _boxes(at, a, b):
                if part == b"ipco":
                    for number, (name, e, _) in enumerate(_boxes(at, c, d), 1):
                        if name == b"ispe":
                            extents[number] = struct.unpack(">II", at(e + 4, 8))
                elif part == b"ipma" and item is not None:
                    wanted += _properties_of(at, c, d, item)
        return next((extents[n] for n in wanted if n in extents), None)
    return None


def size(at: Reader) -> Size | None:
    """(width, height), or None for what cannot be read."""
    head = at(0, 32)
    try:
        if head.startswith(PNG):
            return struct.unpack(">II", head[16:24])
        if head.startswith(GIF):
            return struct.unpack("<HH", head[6:10])
        if head.startswith(JPEG):
            return _jpeg(at)
        if head.startswith(BMP):
            return _bmp(at)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(at)
        if head[4:8] == b"ftyp":
            length = min(struct.unpack(">I", head[:4])[0], 1 << 10)
            brands = at(8, max(0, length - 8))
            if any(brands[k : k + 4] in BRANDS for k in (0, *range(8, len(brands), 4))):
                return _heif(at)
    except (struct.error, IndexError):
        pass
    return None
