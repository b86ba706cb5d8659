"""File headers: a dict with the columns of the header relation."""

from __future__ import annotations

from gridloom.codec.binary import MAP_MAGIC, FormatError, Reader, Writer
from gridloom.functions.mercator import tile_of

DEBUG, START, START_ZOOM, LANGUAGE, COMMENT, CREATED_BY = 0x80, 0x40, 0x20, 0x10, 0x08, 0x04


def read_body(r: Reader) -> dict:
    """The header from the file version on, without magic and size."""
    h: dict = {"file_version": r.number(4), "file_size": r.number(8), "creation_date": r.number(8)}
    h |= {k: r.number(4, signed=True) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    if h["min_lat"] > h["max_lat"] or h["min_lon"] > h["max_lon"]:
        raise FormatError("R03", "the box ends before it starts")
    h |= {"tile_size": r.number(2), "projection": r.text()}
    flags = r.number(1)
    h["has_debug"] = bool(flags & DEBUG)
    start = [r.number(4, signed=True), r.number(4, signed=True)] if flags & START else [None, None]
    h |= dict(zip(("start_lat", "start_lon"), start))
    h["start_zoom"] = r.number(1) if flags & START_ZOOM else None
    for name, bit in (("language", LANGUAGE), ("comment", COMMENT), ("created_by", CREATED_BY)):
        h[name] = r.text() if flags & bit else None
    for name in ("poi_tags", "way_tags"):
        h[name] = [r.text() for _ in range(r.number(2))]
    h["zoom_intervals"] = []
    for si in range(r.number(1)):
        base, low, high = (r.number(1) for _ in range(3))
        if not low <= base <= high:
            raise FormatError("R04", f"interval {si}: base {base} is not within {low}..{high}")
        h["zoom_intervals"].append({"si": si, "base": base, "min": low, "max": high, "pos": r.number(8), "size": r.number(8)})
    return h


def read_header(data, actual_size: int | None = None) -> dict:
    """Checks R01-R08 as far as the header goes. ``header_end`` is where the sub-files may begin."""
    if not len(data):
        raise FormatError("R01", "the file is empty")
    r = Reader(data)
    if r.take(len(MAP_MAGIC)) != MAP_MAGIC:
        raise FormatError("R02", "no map file")
    declared = r.number(4)
    start = r.at
    h = read_body(r)
    if r.at - start != declared:
        raise FormatError("R05", f"the header says {declared} bytes and has {r.at - start}")
    if actual_size is not None and h["file_size"] != actual_size:
        raise FormatError("R06", f"the header says {h['file_size']} bytes, the file has {actual_size}")
    return h | {"header_size": declared, "header_end": r.at}


def write_body(h: dict) -> bytes:
    w = Writer()
    w.number(h["file_version"], 4)
    w.number(h["file_size"], 8)
    w.number(h["creation_date"], 8)
    for k in ("min_lat", "min_lon", "max_lat", "max_lon"):
        w.number(h[k], 4, signed=True)
    w.number(h["tile_size"], 2)
    w.text(h["projection"])
    present = ((DEBUG, h["has_debug"] or None), (START, h["start_lat"]), (START_ZOOM, h["start_zoom"]), (LANGUAGE, h["language"]), (COMMENT, h["comment"]), (CREATED_BY, h["created_by"]))
    w.number(sum(bit for bit, value in present if value is not None), 1)
    if h["start_lat"] is not None:
        w.number(h["start_lat"], 4, signed=True)
        w.number(h["start_lon"], 4, signed=True)
    if h["start_zoom"] is not None:
        w.number(h["start_zoom"], 1)
    for k in ("language", "comment", "created_by"):
        if h[k] is not None:
            w.text(h[k])
    for k in ("poi_tags", "way_tags"):
        w.number(len(h[k]), 2)
        for tag in h[k]:
            w.text(tag)
    w.number(len(h["zoom_intervals"]), 1)
    for z in h["zoom_intervals"]:
        for k in ("base", "min", "max"):
            w.number(z[k], 1)
        w.number(z["pos"], 8)
        w.number(z["size"], 8)
    return bytes(w)


def write_header(h: dict) -> bytes:
    body = write_body(h)
    return MAP_MAGIC + len(body).to_bytes(4, "big") + body


def grid_of(h: dict, z: dict) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 of a sub-file's tiles."""
    x0, y1 = tile_of(h["min_lat"] / 1e6, h["min_lon"] / 1e6, z["base"])
    x1, y0 = tile_of(h["max_lat"] / 1e6, h["max_lon"] / 1e6, z["base"])
    if x0 > x1 or y0 > y1:
        raise FormatError("R23", f"interval {z['si']} has no grid")
    return x0, y0, x1, y1
