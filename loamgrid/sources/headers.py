"""What the headers of spatial files say: small readers of bytes, used by ``header_catalog`` and the table function ``file_header``."""

from __future__ import annotations

import struct

#: (kind, n, xmin, ymin, xmax, ymax, width, height, fields): rows or points of a file, its bounds, a raster's size, a table's columns.
Header = tuple[str | None, int | None, float | None, float | None, float | None, float | None, int | None, int | None, list[str] | None]
SCHEMA = "kind string, n long, xmin double, ymin double, xmax double, ymax double, width long, height long, fields array<string>"
NOTHING: Header = (None,) * 9

#: Tags of a TIFF directory, and the size and code of its number types.
TIFF_WIDTH, TIFF_HEIGHT, TIFF_SCALE, TIFF_TIE = 256, 257, 33550, 33922
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


class Window:
    """Bytes of a file of which only some stretches are at hand; reading what isn't gives None."""

    def __init__(self, *stretches: tuple[int, bytes]):
        self.stretches = stretches

    def read(self, form: str, at: int) -> tuple | None:
        size = struct.calcsize(form)
        for start, data in self.stretches:
            if start <= at and at + size <= start + len(data):
                return struct.unpack_from(form, data, at - start)
        return None


def las(w: Window) -> Header:
    """Point count and bounds; version 1.4 has a count of its own that isn't limited to 32 bits."""
    minor, legacy, box = w.read("<B", 25), w.read("<I", 107), w.read("<4d", 179)
    if legacy is None or box is None:
        return NOTHING
    wide = w.read("<Q", 247) if minor and minor[0] >= 4 else None
    xmax, xmin, ymax, ymin = box
    return ("las", wide[0] if wide else legacy[0], xmin, ymin, xmax, ymax, None, None, None)


def shp(w: Window) -> Header:
    box = w.read("<4d", 36)
    return ("shp", None, *box, None, None, None) if box else NOTHING


def dbf(w: Window) -> Header:
    """Record count and field names."""
    n, size = w.read("<I", 4), w.read("<H", 8)
    fields, at = [], 32
    while size and at + 32 <= size[0] and (mark := w.read("<B", at)) and mark[0] != 0x0D:
        name = w.read("<11s", at)
        if name is None:
            break
        fields.append(name[0].split(b"\0")[0].decode("latin-1"))
        at += 32
    return ("dbf", n[0], None, None, None, None, None, None, fields) if n and size else NOTHING


def tiff(w: Window) -> Header:
    """Size of the first image, and its bounds where it has a pixel scale and a tie point; both byte orders, and BigTIFF."""
    order = "<" if w.read("2s", 0) == (b"II",) else ">"
    version = w.read(order + "H", 2)
    big = version == (43,)
    first = w.read(order + ("Q" if big else "I"), 8 if big else 4)
    count = w.read(order + ("Q" if big else "H"), first[0]) if first else None
    if count is None:
        return ("tiff", *NOTHING[1:])
    step, inline, begin = (20, 8, first[0] + 8) if big else (12, 4, first[0] + 2)
    tags: dict[int, tuple] = {}
    for k in range(min(count[0], 4096)):
        entry = w.read(order + ("HHQ" if big else "HHI"), begin + k * step)
        if entry is None:
            break
        tag, kind, n = entry
        code = TIFF_TYPES.get(kind)
        if tag not in (TIFF_WIDTH, TIFF_HEIGHT, TIFF_SCALE, TIFF_TIE) or code in (None, "s") or n > 64:
            continue
        form, at = f"{order}{n}{code}", begin + k * step + step - inline
        if struct.calcsize(form) > inline:
            there = w.read(order + ("Q" if big else "I"), at)
            at = there[0] if there else -1
        value = w.read(form, at) if at >= 0 else None
        if value:
            tags[tag] = value
    width, height = (tags.get(t, (None,))[0] for t in (TIFF_WIDTH, TIFF_HEIGHT))
    box: tuple = (None,) * 4
    scale, tie = tags.get(TIFF_SCALE), tags.get(TIFF_TIE)
    if width and height and scale and tie and len(tie) >= 6:
        left, top = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        box = (left, top - height * scale[1], left + width * scale[0], top)
    return ("tiff", None, *box, width, height, None)


def csv(head: bytes, lines: int | None) -> Header:
    """Lines, and the names of the first one."""
    first = head.split(b"\n", 1)[0].decode("utf-8", "replace").strip("\r\ufeff")
    return ("csv", lines, None, None, None, None, None, None, first.split(",") if first else [])


def header_of(path: str | None, head: bytes | None, lines: int | None = None, directory: tuple[int, bytes] | None = None) -> Header:
    """The header of a file from its first bytes, and for a TIFF also a stretch from its directory on; unknown kinds give nulls."""
    name, head = (path or "").lower(), bytes(head or b"")
    w = Window((0, head), *([directory] if directory else []))
    if head[:4] == b"LASF":
        return las(w)
    if head[:4] == b"\0\0\x27\x0a":
        return shp(w)
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return tiff(w)
    if name.endswith(".dbf") and head[:1] and head[0] & 7 in (3, 4):
        return dbf(w)
    if name.endswith((".csv", ".tsv")):
        return csv(head, lines if lines is not None else head.count(b"\n"))
    return NOTHING
