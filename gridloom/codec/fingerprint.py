"""The published digest of a map file: XXH3 per feature, sums per zoom row, SHA-256 over header and tiles.

Sums make it blind to the order of features, and the sum over a feature's tag strings to the order of
tags and to the dictionary. What is packed below, in which order and width, is fixed by the digest.
"""

from __future__ import annotations

import struct

import xxhash

from gridloom.codec.binary import Writer
from gridloom.codec.tile import BLOCKS, ELEVATION, ENCODING, HOUSE, LABEL, NAME, REFERENCE

_WORD = (1 << 64) - 1


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


class TagHashes(dict):
    """Dictionary id -> hash of the tag string, filled as needed."""

    def __init__(self, tags: list[str]):
        super().__init__()
        self.tags = tags

    def __missing__(self, i: int) -> int:
        h = self[i] = xxhash.xxh3_64_intdigest(_raw(self.tags[i]))
        return h


def _chain(h: int, parts: list[bytes | None]) -> int:
    for p in parts:
        if p is not None:
            h = xxhash.xxh3_64_intdigest(p, h)
    return h


def _flags(*bits: tuple[int, bool]) -> int:
    return sum(bit for bit, on in bits if on)


def poi_hash(f: dict, tags: TagHashes) -> int:
    given = {k: f[k] is not None for k in ("name", "house_number", "elevation")}
    flags = _flags((NAME, given["name"]), (HOUSE, given["house_number"]), (ELEVATION, given["elevation"]))
    total = sum(tags[t] for t in f["tags"]) & _WORD
    head = struct.pack("<iiBBBQ", f["lat"], f["lon"], f["layer"] + 5, len(f["tags"]), flags, total)
    texts = [_raw(f[k]) if given[k] else None for k in ("name", "house_number")]
    return _chain(xxhash.xxh3_64_intdigest(head), [*texts, struct.pack("<i", f["elevation"]) if given["elevation"] else None])


def way_hash(f: dict, tags: TagHashes) -> int:
    """Takes a way as the light reader gives it: its coordinates as bytes."""
    texts = [_raw(f[k]) if f[k] is not None else None for k in ("name", "house_number", "reference")]
    label = f["label_lat"] is not None
    flags = _flags(*((bit, t is not None) for bit, t in zip((NAME, HOUSE, REFERENCE), texts)), (LABEL, label), (BLOCKS, f["explicit_num_blocks"]), (ENCODING, f["encoding"]))
    total = sum(tags[t] for t in f["tags"]) & _WORD
    head = struct.pack("<HBBBQ", f["sub_tile_bitmap"], f["layer"] + 5, len(f["tags"]), flags, total)
    shape = Writer()
    if f["explicit_num_blocks"]:
        shape.unsigned(f["num_blocks"])
    shape += f["block_bytes"]
    return _chain(xxhash.xxh3_64_intdigest(head), [*texts, struct.pack("<ii", f["label_lat"], f["label_lon"]) if label else None, bytes(shape)])


def zoom_sums(pois: list[list[dict]], ways: list[list[dict]], poi_tags: TagHashes, way_tags: TagHashes) -> bytes:
    """Per zoom row the sums of its points and of its ways; each starts from the count."""
    out = b""
    for p, w in zip(pois, ways):
        sums = (len(p) + sum(poi_hash(f, poi_tags) for f in p), len(w) + sum(way_hash(f, way_tags) for f in w))
        out += struct.pack("<QQ", *(s & _WORD for s in sums))
    return out


def header_bytes(h: dict, ignore_comment: bool = False, ignore_timestamp: bool = False) -> bytes:
    def text(k: str) -> bytes:
        raw = _raw(h[k] or "")
        return struct.pack("<I", len(raw)) + raw

    out = struct.pack("<iiiiI", *(h[k] for k in ("min_lat", "min_lon", "max_lat", "max_lon", "tile_size"))) + text("projection") + struct.pack("<B", h["start_zoom"] or 0) + text("language")
    out += (b"" if ignore_comment else text("comment")) + text("created_by") + (b"" if ignore_timestamp else struct.pack("<Q", h["creation_date"]))
    out += struct.pack("<I", len(h["zoom_intervals"]))
    return out + b"".join(struct.pack("<BBB", z["base"], z["min"], z["max"]) for z in h["zoom_intervals"])
