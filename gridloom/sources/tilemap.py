"""Spark data source ``tilemap``: binary tiled maps as header, tile index, raw tiles or features.

Option ``part``: header, tile_index, tile_raw or feature. The path may be a file, a folder, a glob
or several of these separated by commas. A partition is a stretch of one sub-file's index; tasks
read the bytes they need and nothing else. Filters on si, x and y are pushed down to the index.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from gridloom import schemas
from gridloom.codec.binary import INDEX_SIGNATURE, FormatError, Reader
from gridloom.codec.header import grid_of, read_header
from gridloom.codec.patch import read_patch_file
from gridloom.codec.tile import read_tile

SCHEMAS = {"header": schemas.HEADER, "tile_index": schemas.TILE, "tile_raw": schemas.TILE_RAW, "feature": schemas.FEATURE}
#: Tiles per partition.
STRETCH = 4096


def files_of(path: str) -> list[str]:
    out: list[str] = []
    for p in path.split(","):
        p = p.strip().removeprefix("file://")
        out += sorted(glob.glob(os.path.join(p, "*.map"))) if os.path.isdir(p) else sorted(glob.glob(p)) or [p]
    return out


def map_id_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def map_ids(paths: list[str]) -> dict[str, str]:
    """File names without ending, or whole paths where two files have the same name."""
    names = [map_id_of(p) for p in paths]
    return {p: n if names.count(n) == 1 else p for p, n in zip(paths, names)}


def load_header(path: str) -> dict:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(1 << 16)
        if len(head) == 1 << 16:  # dictionaries may make it longer; the size is declared up front
            head += f.read(int.from_bytes(head[20:24], "big"))
    return read_header(head, size)


@dataclass
class Stretch(InputPartition):
    path: str
    name: str = ""
    si: int = 0
    start: int = 0
    stop: int = 0


def index_entries(path: str, h: dict, z: dict, start: int, stop: int) -> Iterator[tuple[int, int, bool, int, int]]:
    """(x, y, is_water, offset, length) of index entries start..stop; checks R09-R12."""
    x0, y0, x1, y1 = grid_of(h, z)
    width = x1 - x0 + 1
    n = width * (y1 - y0 + 1)
    skip = len(INDEX_SIGNATURE) if h["has_debug"] else 0
    with open(path, "rb") as f:
        f.seek(z["pos"])
        if skip and f.read(skip) != INDEX_SIGNATURE:
            raise FormatError("R09", f"no index signature in interval {z['si']}")
        f.seek(z["pos"] + skip + 5 * start)
        raw = f.read(5 * (min(stop, n - 1) + 1 - start))
    values = [int.from_bytes(raw[i : i + 5], "big") for i in range(0, len(raw) - 4, 5)]
    if len(values) < min(stop, n) - start:
        raise FormatError("R07", "the index is cut short")
    offsets = [v & ((1 << 39) - 1) for v in values] + ([z["size"]] if stop >= n else [])
    for i in range(min(stop, n) - start):
        a, b = offsets[i], offsets[i + 1]
        if a < skip + 5 * n:
            raise FormatError("R10", f"offset {a} lies in the index")
        if a > z["size"]:
            raise FormatError("R11", f"offset {a} lies past {z['size']}")
        if b < a:
            raise FormatError("R12", f"offset {b} after {a}")
        y, x = divmod(start + i, width)
        yield x0 + x, y0 + y, bool(values[i] >> 39), a, b - a


def feature_rows(map_id: str, si: int, x: int, y: int, z: dict, h: dict, body: bytes) -> Iterator[dict]:
    pois, ways = read_tile(body, x, y, z["max"] - z["min"] + 1, h["has_debug"])
    for kind, rows in (("poi", pois), ("way", ways)):
        names = h[f"{kind}_tags"]
        for zi, row in enumerate(rows):
            for i, f in enumerate(row):
                yield {**f, "tags": [names[t] for t in f["tags"]], "map_id": map_id, "si": si, "x": x, "y": y, "zoom": z["min"] + zi, "kind": kind, "ord": i}


class TileMapReader(DataSourceReader):
    def __init__(self, options: dict, arrow: pa.Schema):
        self.part, self.path, self.arrow = options.get("part", "feature"), options["path"], arrow
        self.stretch = int(options.get("stretch", STRETCH))
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self) -> list[Stretch]:
        out = []
        for path, name in map_ids(files_of(self.path)).items():
            if self.part == "header":
                out.append(Stretch(path, name))
                continue
            h = load_header(path)
            for z in h["zoom_intervals"]:
                if not self._wanted("si", z["si"]):
                    continue
                x0, y0, x1, y1 = grid_of(h, z)
                width, lo, hi = x1 - x0 + 1, 0, (x1 - x0 + 1) * (y1 - y0 + 1)
                rows = [y for y in range(y0, y1 + 1) if self._wanted("y", y)] if self.tests else None
                if rows is not None:
                    lo, hi = ((rows[0] - y0) * width, (rows[-1] - y0 + 1) * width) if rows else (0, 0)
                out += [Stretch(path, name, z["si"], i, min(i + self.stretch, hi)) for i in range(lo, hi, self.stretch)]
        return out

    def _wanted(self, column: str, value: int) -> bool:
        tests = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
        return all(tests[op](value, v) for c, op, v in self.tests if c == column)

    def read(self, p: Stretch) -> Iterator[pa.RecordBatch]:
        names = self.arrow.names
        rows: list[dict] = []
        for row in self._rows(p):
            rows.append(row)
            if len(rows) == 2000:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=self.arrow)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=self.arrow)

    def _rows(self, p: Stretch) -> Iterator[dict]:
        h, name = load_header(p.path), p.name
        if self.part == "header":
            from decimal import Decimal

            yield {**h, "map_id": name, "file_size": Decimal(h["file_size"]), "creation_date": Decimal(h["creation_date"])}
            return
        z = h["zoom_intervals"][p.si]
        with open(p.path, "rb") as f:
            for x, y, water, offset, length in index_entries(p.path, h, z, p.start, p.stop):
                if not (self._wanted("x", x) and self._wanted("y", y)):
                    continue
                body = None
                if self.part != "tile_index" and length:
                    f.seek(z["pos"] + offset)
                    body = f.read(length)
                if self.part == "feature":
                    if body:
                        yield from feature_rows(name, p.si, x, y, z, h, body)
                else:
                    yield {"map_id": name, "si": p.si, "x": x, "y": y, "is_water": water, "offset": offset, "length": length, "bytes": body}


class PushingReader(TileMapReader):
    """With filter pushdown; only usable where the session allows it."""

    def pushFilters(self, filters):
        ops = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in"}
        for f in filters:
            op = ops.get(type(f))
            if op and f.attribute in (("si",), ("x",), ("y",)):
                self.tests.append((f.attribute[0], op, f.value))
            else:
                yield f


class TileMapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilemap"

    def schema(self) -> str:
        part = self.options.get("part", "feature")
        if part not in SCHEMAS:
            raise ValueError(f"part is one of {', '.join(SCHEMAS)}")
        return SCHEMAS[part]

    def reader(self, schema: StructType) -> TileMapReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = PushingReader if self.options.get("pushdown") == "true" else TileMapReader
        return kind(dict(self.options), to_arrow_schema(schema))


class PatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.base = options["path"], options["base"]

    def partitions(self) -> list[Stretch]:
        return [Stretch(self.path)]  # one compressed stream cannot be split

    def read(self, p: Stretch):
        h = load_header(files_of(self.base)[0])
        tags = (h["poi_tags"], h["way_tags"])
        for n, path in enumerate(self.path.split(",")):
            with open(path, "rb") as f:
                new, records = read_patch_file(f.read(), tags)
            tags = (new["poi_tags"], new["way_tags"])
            for si, x, y, flags, patches in records:
                low = new["zoom_intervals"][si]["min"]
                for zi, patch in patches.items() or [(None, None)]:
                    yield (n, si, x, y, flags, None if zi is None else low + zi, patch)


class PatchSource(DataSource):
    """``tilemap_patch``: change-log files as rows; option ``base`` names the map the first one applies to."""

    @classmethod
    def name(cls) -> str:
        return "tilemap_patch"

    def schema(self) -> str:
        return "version int, " + schemas.CHANGE

    def reader(self, schema: StructType) -> PatchReader:
        return PatchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileMapSource)
    spark.dataSource.register(PatchSource)


def read_part(spark: SparkSession, path: str, part: str, **options) -> DataFrame:
    register(spark)
    push = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    r = spark.read.format("tilemap").option("part", part).option("pushdown", push)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)
