"""The text form of a map: writing tiles as lines, and reading them back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile(r'[\\"\x00-\x1f]')


def quote(text: str) -> str:
    return '"' + _SPECIAL.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def _value(v) -> str:
    return "true" if v is True else "false" if v is False else quote(v) if isinstance(v, str) else str(v)


def header_lines(h: dict) -> Iterator[str]:
    yield "[header]"
    for k in ("header_size", "file_version", "file_size", "creation_date", "min_lat", "min_lon", "max_lat", "max_lon", "tile_size", "projection", "has_debug"):
        yield f"{k} = {_value(h.get(k, 0))}"
    for flag, keys in (("has_map_start", (("start_lat", "start_lat"), ("start_lon", "start_lon"))), ("has_start_zoom", (("start_zoom", "start_zoom"),)), ("has_language_preference", (("language_preference", "language"),)), ("has_comment", (("comment", "comment"),)), ("has_created_by", (("created_by", "created_by"),))):
        present = h[keys[0][1]] is not None
        yield f"{flag} = {_value(present)}"
        if present:
            yield from (f"{name} = {_value(h[k])}" for name, k in keys)
    for k in ("poi_tags", "way_tags"):
        yield from ("", f"{k} = [", *(f"  {quote(t)}," for t in h[k]), "]")
    yield ""
    for z in h["zoom_intervals"]:
        yield from ("[[zoom_intervals]]", f"base_zoom = {z['base']}", f"min_zoom = {z['min']}", f"max_zoom = {z['max']}", f"pos = {z['pos']}", f"size = {z['size']}", "")


def tile_lines(si: int, x: int, y: int, is_water: bool, features: list[dict] | None, low: int, first_way_offset: int = 0) -> Iterator[str]:
    """``features``: points then ways in zoom order, with tag strings; None for a tile without a body, which reads like an empty one."""
    yield from ("[[tiles]]", f'id = "{si}/{x}/{y}"', f"si = {si}", f"x = {x}", f"y = {y}", f"is_water = {_value(is_water)}")
    if features is None:
        yield from ("first_way_offset = 0", "")
        return
    yield f"first_way_offset = {first_way_offset}"
    for f in features:
        poi = f["kind"] == "poi"
        yield from ("", "[[tiles.pois]]" if poi else "[[tiles.ways]]", f"zi_index = {f['zoom'] - low}")
        for k in ("lat", "lon", "layer") if poi else ("layer", "sub_tile_bitmap", "encoding"):
            yield f"{k} = {_value(f[k])}"
        yield "tags = [" + ", ".join(map(quote, f["tags"])) + "]"
        for k in ("name", "house_number", "elevation") if poi else ("name", "house_number", "reference", "label_lat", "label_lon"):
            if f[k] is not None:
                yield f"{k} = {_value(f[k])}"
        if not poi:
            yield "blocks = ["
            for block in f["blocks"]:
                yield from ("  [", *("    [" + ", ".join(f"[{a}, {b}]" for a, b in nodes) + "]," for nodes in block), "  ],")
            yield "]"
    yield ""


def _parse(text: str):
    return text == "true" if text in ("true", "false") else json.loads(text)


def _entries(lines: Iterator[str]) -> Iterator[tuple[str, object]]:
    """(key, value) pairs; a section's name comes as (section, None). Lists may span lines."""
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            yield line.strip("[]"), None
            continue
        key, _, value = line.partition(" = ")
        if value == "[":
            part = []
            for more in lines:
                part.append(more.strip())
                if more.rstrip("\n") == "]":
                    break
            value = "[" + re.sub(r",\s*(?=\])", "", "".join(part))
        yield key, _parse(value)


def read_dump(lines: Iterable[str]) -> tuple[dict, list[dict]]:
    """The header and the tiles with their features (tag strings, zoom as zi_index).

    Only header-sized parts are kept besides one list of tiles; use it per file section for large dumps.
    """
    h: dict = {"zoom_intervals": [], "poi_tags": [], "way_tags": []}
    tiles: list[dict] = []
    at: dict = h
    names = {"language_preference": "language"}
    for key, value in _entries(iter(lines)):
        if value is None:
            if key == "header":
                at = h
            elif key == "zoom_intervals":
                at = {}
                h["zoom_intervals"].append(at)
            elif key == "tiles":
                at = {"features": None}
                tiles.append(at)
            else:
                at = {"kind": "poi" if key == "tiles.pois" else "way"}
                tiles[-1]["features"].append(at)
        else:
            at[names.get(key, key)] = value
            if key == "first_way_offset":
                at["features"] = []
    for k in ("start_lat", "start_lon", "start_zoom", "language", "comment", "created_by"):
        h.setdefault(k, None)
    h["zoom_intervals"] = [{"si": i, "base": z["base_zoom"], "min": z["min_zoom"], "max": z["max_zoom"], "pos": 0, "size": 0} for i, z in enumerate(h["zoom_intervals"])]
    return h, tiles
