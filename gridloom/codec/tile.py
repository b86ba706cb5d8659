"""Tile bodies and zoom blobs. A feature is a dict with the value columns of the feature relation.

In these dicts ``tags`` holds dictionary ids; the sources and sinks turn them into strings and back.
"""

from __future__ import annotations

import re

from gridloom.codec.binary import POI_SIGNATURE, SIGNATURE_BYTES, TILE_SIGNATURE, WAY_SIGNATURE, FormatError, Reader, Writer

_POI_RE, _WAY_RE = re.compile(rb"\*\*\*POIStart\d+\*\*\*"), re.compile(rb"---WayStart\d+---")
NAME, HOUSE, ELEVATION = 0x80, 0x40, 0x20
REFERENCE, LABEL, BLOCKS, ENCODING = 0x20, 0x10, 0x08, 0x04


def _read_poi(r: Reader, debug: bool) -> dict:
    if debug and not _POI_RE.match(r.take(SIGNATURE_BYTES)):
        raise FormatError("R14", "point signature missing")
    f = {"lat": r.signed(), "lon": r.signed()}
    special = r.number(1)
    f["layer"] = (special >> 4) - 5
    f["tags"] = [r.unsigned() for _ in range(special & 15)]
    flags = r.number(1)
    f["name"] = r.text() if flags & NAME else None
    f["house_number"] = r.text() if flags & HOUSE else None
    f["elevation"] = r.signed() if flags & ELEVATION else None
    return f


def _read_way(r: Reader, debug: bool, light: bool = False) -> dict:
    if debug and not _WAY_RE.match(r.take(SIGNATURE_BYTES)):
        raise FormatError("R15", "way signature missing")
    size = r.unsigned()
    start = r.at
    f: dict = {"sub_tile_bitmap": r.number(2)}
    special = r.number(1)
    f["layer"] = (special >> 4) - 5
    f["tags"] = [r.unsigned() for _ in range(special & 15)]
    flags = r.number(1)
    f["name"] = r.text() if flags & NAME else None
    f["house_number"] = r.text() if flags & HOUSE else None
    f["reference"] = r.text() if flags & REFERENCE else None
    f["label_lat"], f["label_lon"] = (r.signed(), r.signed()) if flags & LABEL else (None, None)
    f["explicit_num_blocks"], f["encoding"] = bool(flags & BLOCKS), bool(flags & ENCODING)
    n = r.unsigned() if flags & BLOCKS else 1
    if light:  # coordinates stay bytes
        rest = start + size - r.at
        if not 0 <= rest <= r.left:
            raise FormatError("R22", f"{rest} bytes of coordinates, {r.left} left")
        f["block_bytes"], f["blocks"], f["num_blocks"] = r.take(rest), None, n
        return f
    f["blocks"] = [[[[r.signed(), r.signed()] for _ in range(r.unsigned())] for _ in range(r.unsigned())] for _ in range(n)]
    if r.at - start != size:
        raise FormatError("R21", f"the way says {size} bytes and has {r.at - start}")
    return f


def read_tile(data, x: int, y: int, zooms: int, debug: bool = False, light: bool = False, check: bool = False) -> tuple[list[list[dict]], list[list[dict]]]:
    """Points and ways per zoom row. ``check`` also compares the stored way offset (R16)."""
    r = Reader(data)
    if debug and r.take(SIGNATURE_BYTES).rstrip(b"\0 ") != (TILE_SIGNATURE % (x, y)).encode():
        raise FormatError("R13", f"no signature of tile {x},{y}")
    counts = [(r.unsigned(), r.unsigned()) for _ in range(zooms)]
    offset = r.unsigned()
    start = r.at
    pois = [[_read_poi(r, debug) for _ in range(p)] for p, _ in counts]
    if check and r.at - start != offset:
        raise FormatError("R16", f"ways start at {r.at - start}, not at {offset}")
    ways = [[_read_way(r, debug, light) for _ in range(w)] for _, w in counts]
    return pois, ways


def stored_way_offset(data, zooms: int, debug: bool = False) -> int:
    """Where the ways of a tile start behind its zoom table, as it says itself."""
    r = Reader(data)
    if debug:
        r.take(SIGNATURE_BYTES)
    for _ in range(2 * zooms):
        r.unsigned()
    return r.unsigned()


def _write_poi(w: Writer, f: dict) -> None:
    w.signed(f["lat"])
    w.signed(f["lon"])
    _write_tags(w, f)
    flags = (NAME if f["name"] is not None else 0) | (HOUSE if f["house_number"] is not None else 0) | (ELEVATION if f["elevation"] is not None else 0)
    w.number(flags, 1)
    if f["name"] is not None:
        w.text(f["name"])
    if f["house_number"] is not None:
        w.text(f["house_number"])
    if f["elevation"] is not None:
        w.signed(f["elevation"])


def _write_tags(w: Writer, f: dict) -> None:
    if len(f["tags"]) > 15:
        raise ValueError("a feature has at most 15 tags")
    w.number(((f["layer"] or 0) + 5) << 4 | len(f["tags"]), 1)
    for t in f["tags"]:
        w.unsigned(t)


def _write_way(w: Writer, f: dict) -> None:
    b = Writer()
    b.number(f["sub_tile_bitmap"], 2)
    _write_tags(b, f)
    blocks = f["blocks"] or []
    counted = bool(f.get("explicit_num_blocks")) or len(blocks) != 1
    parts = ((NAME, f["name"]), (HOUSE, f["house_number"]), (REFERENCE, f["reference"]), (LABEL, f["label_lat"]), (BLOCKS, counted or None), (ENCODING, f["encoding"] or None))
    b.number(sum(bit for bit, value in parts if value is not None), 1)
    for k in ("name", "house_number", "reference"):
        if f[k] is not None:
            b.text(f[k])
    if f["label_lat"] is not None:
        b.signed(f["label_lat"])
        b.signed(f["label_lon"])
    if counted:
        b.unsigned(len(blocks))
    for segments in blocks:
        b.unsigned(len(segments))
        for nodes in segments:
            b.unsigned(len(nodes))
            for lat, lon in nodes:
                b.signed(lat)
                b.signed(lon)
    w.unsigned(len(b))
    w += b


def write_tile(pois: list[list[dict]], ways: list[list[dict]], x: int, y: int, debug: bool = False) -> bytes:
    """The body of a tile; one list of points and one of ways per zoom row."""
    points, lines = Writer(), Writer()
    n = 0
    for out, rows, write, signature in ((points, pois, _write_poi, POI_SIGNATURE), (lines, ways, _write_way, WAY_SIGNATURE)):
        for row in rows:
            for f in row:
                if debug:
                    out.padded(signature % n, SIGNATURE_BYTES)
                    n += 1
                write(out, f)
    w = Writer()
    if debug:
        w.padded(TILE_SIGNATURE % (x, y), SIGNATURE_BYTES)
    for p, q in zip(pois, ways):
        w.unsigned(len(p))
        w.unsigned(len(q))
    w.unsigned(len(points))
    return bytes(w + points + lines)


def tile_violations(data, x: int, y: int, zooms: int, debug: bool, n_poi_tags: int, n_way_tags: int) -> list[tuple[str, str]]:
    """(rule, detail) of everything that is wrong in a tile; reading stops at the first structural fault."""
    found = []
    try:
        pois, ways = read_tile(data, x, y, zooms, debug, check=True)
    except FormatError as e:
        if e.rule != "R16":
            return [(e.rule, str(e))]
        found.append((e.rule, str(e)))
        pois, ways = read_tile(data, x, y, zooms, debug)
    for rows, layer_rule, tag_rule, n in ((pois, "R17", "R19", n_poi_tags), (ways, "R18", "R20", n_way_tags)):
        for row in rows:
            for f in row:
                if f["layer"] > 5:
                    found.append((layer_rule, f"layer {f['layer']}"))
                found += [(tag_rule, f"tag {t} of {n}") for t in f["tags"] if t >= n]
    return found


def zoom_bytes(data, x: int, y: int, zooms: int, debug: bool = False) -> list[bytes]:
    """Each zoom row of a tile as a blob of its own."""
    pois, ways = read_tile(data, x, y, zooms, debug)
    return [write_blob(p, w) for p, w in zip(pois, ways)]


def write_blob(pois: list[dict], ways: list[dict]) -> bytes:
    """A zoom row that stands alone: counts, length of the points, points, ways."""
    points, lines = Writer(), Writer()
    for f in pois:
        _write_poi(points, f)
    for f in ways:
        _write_way(lines, f)
    w = Writer()
    for n in (len(pois), len(ways), len(points)):
        w.unsigned(n)
    return bytes(w + points + lines)


def read_blob(blob: bytes) -> tuple[list[dict], list[dict]]:
    if not blob:
        return [], []
    r = Reader(blob)
    n_pois, n_ways, _ = r.unsigned(), r.unsigned(), r.unsigned()
    return [_read_poi(r, False) for _ in range(n_pois)], [_read_way(r, False) for _ in range(n_ways)]


def _present(v):
    return (v is not None, v if v is not None else 0)


def poi_order(f: dict):
    """The total order of points in a zoom row; what follows a name only breaks ties."""
    return (f["layer"], f["lon"], f["lat"], len(f["tags"]), f["tags"], f["name"] is not None, f["name"] or "", f["house_number"] is not None, f["house_number"] or "", _present(f["elevation"]))


def way_order(f: dict):
    label = (f["label_lat"] is not None, f["label_lon"] or 0, f["label_lat"] or 0)
    shape = tuple(len(b) for b in f["blocks"])
    nodes = tuple(tuple((len(s), tuple((n[1], n[0]) for n in s)) for s in b) for b in f["blocks"])
    return (f["layer"], len(f["blocks"]), len(f["tags"]), label, f["tags"], f["name"] or "", f["house_number"] or "", f["reference"] or "", shape, nodes, f["sub_tile_bitmap"], f["encoding"], f["explicit_num_blocks"])


def normalised(pois: list[dict], ways: list[dict]) -> tuple[list[dict], list[dict]]:
    """Tags sorted in each feature, features in their total order."""
    return (
        sorted(({**f, "tags": sorted(f["tags"])} for f in pois), key=poi_order),
        sorted(({**f, "tags": sorted(f["tags"])} for f in ways), key=way_order),
    )


def remapped(rows: list[dict], ids: list[int | None]) -> list[dict]:
    """Features under another dictionary; one with a tag that it lacks is dropped."""
    out = []
    for f in rows:
        tags = [ids[t] if t < len(ids) else None for t in f["tags"]]
        if None not in tags:
            out.append({**f, "tags": tags})
    return out
