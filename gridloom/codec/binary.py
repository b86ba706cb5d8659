"""Bytes of the tiled map format: variable-length numbers, strings, and where reading failed."""

from __future__ import annotations

# Fixed values of the file formats.
MAP_MAGIC = b"mapsforge binary OSM"
PATCH_MAGIC = b"mfd\x05"
INDEX_SIGNATURE = b"+++IndexStart+++"
TILE_SIGNATURE, POI_SIGNATURE, WAY_SIGNATURE = "###TileStart%d,%d###", "***POIStart%d***", "---WayStart%d---"
SIGNATURE_BYTES = 32
END_OF_RECORDS = 0xFF


class FormatError(ValueError):
    """A broken rule of the format; ``rule`` is its id (R01, R02, ...)."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"{rule}: {message}")
        self.rule = rule


class Reader:
    """A cursor over bytes. Every read checks that the bytes are there."""

    def __init__(self, data, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        stop = self.at + n
        if n < 0 or stop > self.end:
            raise FormatError("R07", f"{n} bytes wanted, {self.end - self.at} left")
        out = bytes(self.data[self.at : stop])
        self.at = stop
        return out

    def number(self, size: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(size), "big", signed=signed)

    def unsigned(self) -> int:
        """Groups of seven bits, lowest first; at most five of them."""
        value = shift = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                break
            shift += 7
            if shift > 32:
                raise FormatError("R08", "number longer than 32 bits")
        return value

    def signed(self) -> int:
        """As unsigned, but the last byte holds six bits and the sign."""
        value = shift = 0
        while (byte := self.take(1)[0]) & 0x80:
            value |= (byte & 0x7F) << shift
            shift += 7
            if shift > 28:
                raise FormatError("R08", "number longer than 32 bits")
        value |= (byte & 0x3F) << shift
        return -value if byte & 0x40 else value

    def text(self) -> str:
        return self.take(self.unsigned()).decode("utf-8", "surrogateescape")

    @property
    def left(self) -> int:
        return self.end - self.at


class Writer(bytearray):
    def number(self, value: int, size: int, signed: bool = False) -> None:
        self += int(value).to_bytes(size, "big", signed=signed)

    def unsigned(self, value: int) -> None:
        if not 0 <= value < 1 << 32:
            raise ValueError(f"{value} is no unsigned 32-bit number")
        while value > 0x7F:
            self.append(0x80 | value & 0x7F)
            value >>= 7
        self.append(value)

    def signed(self, value: int) -> None:
        rest, sign = abs(value), 0x40 if value < 0 else 0
        if rest >= 1 << 31:
            raise ValueError(f"{value} does not fit")
        while rest > 0x3F:
            self.append(0x80 | rest & 0x7F)
            rest >>= 7
        self.append(rest | sign)

    def text(self, value: str) -> None:
        raw = value.encode("utf-8", "surrogateescape")
        self.unsigned(len(raw))
        self += raw

    def padded(self, value: str, size: int) -> None:
        self += value.encode()[:size].ljust(size, b"\0")
