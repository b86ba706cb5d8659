"""Sink for one map file: tiles are encoded by tasks, laid out in index order and streamed to the file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.codec.binary import INDEX_SIGNATURE
from gridloom.codec.header import grid_of, write_header
from gridloom.codec.tile import normalised, write_tile
from gridloom.schemas import FEATURE_COLUMNS
from gridloom.session import cut_lineage


def guard(path: str, force: bool) -> None:
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} exists; pass force to replace it")


def tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(si, x, y, is_water, bytes) as a batch."""
    types = dict(si=pa.int32(), x=pa.int32(), y=pa.int32(), is_water=pa.bool_(), bytes=pa.binary())
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def encode_tiles(features: DataFrame, header: dict) -> DataFrame:
    """si, x, y, bytes: one row per tile with features. Dictionaries are at most 65,535 strings each by the format."""
    ids = {k: {t: i for i, t in reversed(list(enumerate(header[f"{k}_tags"])))} for k in ("poi", "way")}
    intervals = {z["si"]: (z["min"], z["max"]) for z in header["zoom_intervals"]}
    debug = header["has_debug"]
    facts = features.sparkSession.sparkContext.broadcast((ids, intervals, debug))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag_ids, ranges, signed = facts.value
        for b in batches:
            bodies = []
            for si, x, y, rows in zip(*(c.to_pylist() for c in b.columns)):
                low, high = ranges[si]
                parts = {"poi": [[] for _ in range(high - low + 1)], "way": [[] for _ in range(high - low + 1)]}
                for f in sorted(rows, key=lambda f: f["ord"] if f["ord"] is not None else 0):
                    parts[f["kind"]][f["zoom"] - low].append({**f, "tags": [tag_ids[f["kind"]][t] for t in f["tags"] or []]})
                sorted_rows = [normalised(p, w) for p, w in zip(parts["poi"], parts["way"])]
                body = write_tile([p for p, _ in sorted_rows], [w for _, w in sorted_rows], x, y, signed)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bodies, pa.binary())], names=["si", "x", "y", "bytes"])

    value = [c for c in FEATURE_COLUMNS if c not in ("map_id", "si", "x", "y")]
    grouped = features.groupBy("si", "x", "y").agg(F.collect_list(F.struct(*value)).alias("rows"))
    return grouped.mapInArrow(encode, "si int, x int, y int, bytes binary")


def write_map_file(header: dict, tiles: DataFrame, path: str, force: bool = False, default_water: bool = False) -> dict:
    """Writes si, x, y, is_water, bytes (null: no body) as a map file; returns the header as written.

    Encoded tiles are kept once in the shared folder; the driver sees the index (five bytes a tile in
    the file anyway) and then the bodies one after another, never all of them.
    """
    guard(path, force)
    stored = cut_lineage(tiles.select("si", "x", "y", "is_water", "bytes"))
    debug, parts, index_bytes = header["has_debug"], {}, {}
    for z in header["zoom_intervals"]:
        x0, y0, x1, y1 = grid_of(header, z)
        n = (x1 - x0 + 1) * (y1 - y0 + 1)
        parts[z["si"]] = [x0, y0, x1 - x0 + 1, np.full(n, default_water), np.zeros(n, np.int64)]
        index_bytes[z["si"]] = 5 * n + (len(INDEX_SIGNATURE) if debug else 0)
    inside = F.lit(False)
    for z in header["zoom_intervals"]:
        x0, y0, x1, y1 = grid_of(header, z)
        inside = inside | ((F.col("si") == z["si"]) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    stored = stored.where(inside)
    for r in stored.select("si", "x", "y", "is_water", F.coalesce(F.length("bytes"), F.lit(0)).alias("n")).toLocalIterator():
        x0, y0, width, water, length = parts[r.si]
        i = (r.x - x0) + width * (r.y - y0)
        water[i], length[i] = bool(r.is_water), r.n
    h = {**header, "zoom_intervals": [dict(z) for z in header["zoom_intervals"]], "file_size": 0}
    at = len(write_header(h))
    for z in h["zoom_intervals"]:
        z["pos"], z["size"] = at, index_bytes[z["si"]] + int(parts[z["si"]][4].sum())
        at += z["size"]
    h["file_size"] = at
    partial = f"{path}.part"
    with open(partial, "wb") as f:
        f.write(write_header(h))
        for z in h["zoom_intervals"]:
            _, _, _, water, length = parts[z["si"]]
            if debug:
                f.write(INDEX_SIGNATURE)
            offset = index_bytes[z["si"]] + np.r_[0, np.cumsum(length)[:-1]]
            entries = (offset.astype(np.uint64) | (water.astype(np.uint64) << np.uint64(39))).astype(">u8")
            f.write(entries.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes())
            bodies = stored.where((F.col("si") == z["si"]) & (F.length("bytes") > 0)).orderBy("y", "x").select("bytes")
            for r in bodies.toLocalIterator(prefetchPartitions=True):
                f.write(r.bytes)
    os.replace(partial, path)
    return h

