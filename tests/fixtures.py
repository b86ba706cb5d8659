"""Small map files, built without Spark."""

from __future__ import annotations

import random

from gridloom.codec.binary import INDEX_SIGNATURE
from gridloom.codec.header import grid_of, write_header
from gridloom.codec.tile import write_tile

INTERVALS = [(7, 0, 7), (12, 8, 12), (14, 13, 16)]


def header(**changes) -> dict:
    h = {
        "file_version": 3, "file_size": 0, "creation_date": 1700000000000, "min_lat": 52484000, "min_lon": 13379000, "max_lat": 52510000, "max_lon": 13420000,
        "tile_size": 256, "projection": "Mercator", "has_debug": False, "start_lat": None, "start_lon": None, "start_zoom": None, "language": None, "comment": None, "created_by": None,
        "poi_tags": ["amenity=a", "amenity=b", "shop=c"], "way_tags": ["road=x", "road=y", "water=z"],
        "zoom_intervals": [{"si": i, "base": b, "min": lo, "max": hi, "pos": 0, "size": 0} for i, (b, lo, hi) in enumerate(INTERVALS)],
    }
    return {**h, **changes}


def poi(rng: random.Random, n_tags: int = 3) -> dict:
    opt = lambda v: v if rng.random() < 0.5 else None
    return {"lat": rng.randint(-9000, 9000), "lon": rng.randint(-9000, 9000), "layer": rng.randint(-5, 5), "tags": rng.sample(range(n_tags), rng.randint(0, n_tags)), "name": opt(f"näme {rng.random()}"), "house_number": opt(str(rng.randint(1, 99))), "elevation": opt(rng.randint(-416, 8848))}


def way(rng: random.Random, n_tags: int = 3) -> dict:
    opt = lambda v: v if rng.random() < 0.5 else None
    label = opt((rng.randint(-900, 900), rng.randint(-900, 900))) or (None, None)
    blocks = [[[[rng.randint(-70000, 70000), rng.randint(-70000, 70000)] for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 3))] for _ in range(rng.choice((1, 1, 1, 2)))]
    return {"sub_tile_bitmap": rng.randint(0, 65535), "layer": rng.randint(-5, 5), "tags": rng.sample(range(n_tags), rng.randint(0, n_tags)), "name": opt("w\"q\\uote"), "house_number": opt("1a"), "reference": opt("R 1"), "label_lat": label[0], "label_lon": label[1], "encoding": rng.random() < 0.5, "explicit_num_blocks": len(blocks) != 1, "blocks": blocks}


def build(h: dict, bodies: dict, water: set = frozenset()) -> bytes:
    """bodies: (si, x, y) -> bytes of the tile."""
    h = {**h, "zoom_intervals": [dict(z) for z in h["zoom_intervals"]]}
    parts, at = [], len(write_header(h))
    for z in h["zoom_intervals"]:
        x0, y0, x1, y1 = grid_of(h, z)
        cells = [(x, y) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]
        head = INDEX_SIGNATURE if h["has_debug"] else b""
        offset, index, data = len(head) + 5 * len(cells), b"", b""
        for x, y in cells:
            body = bodies.get((z["si"], x, y), b"")
            index += ((((z["si"], x, y) in water) << 39) | offset).to_bytes(5, "big")
            offset += len(body)
            data += body
        z["pos"], z["size"] = at, offset
        at += offset
        parts.append(head + index + data)
    h["file_size"] = at
    return write_header(h) + b"".join(parts)


def random_map(seed: int, **changes) -> bytes:
    rng = random.Random(seed)
    h = header(**changes)
    bodies, water = {}, set()
    for z in h["zoom_intervals"]:
        x0, y0, x1, y1 = grid_of(h, z)
        rows = z["max"] - z["min"] + 1
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                if rng.random() < 0.3:
                    water.add((z["si"], x, y))
                if rng.random() < 0.8:
                    pois = [[poi(rng, len(h["poi_tags"])) for _ in range(rng.choice((0, 0, 1, 3)))] for _ in range(rows)]
                    ways = [[way(rng, len(h["way_tags"])) for _ in range(rng.choice((0, 0, 1, 2)))] for _ in range(rows)]
                    if any(pois) or any(ways):
                        bodies[z["si"], x, y] = write_tile(pois, ways, x, y, h["has_debug"])
    return build(h, bodies, water)


def edited(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at + len(new) :]
