"""Change-log files: byte patches of zoom rows against their former state, and the record stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import BinaryIO

import zstandard

from gridloom.codec.binary import END_OF_RECORDS, PATCH_MAGIC, FormatError, Reader, Writer
from gridloom.codec.header import read_body, write_body
from gridloom.codec.binary import MAP_MAGIC

WATER, EMPTY = 0x01, 0x02
#: Bytes a copy needs to pay off, and how many places of the old bytes are tried per position.
LEAST_COPY, TRIES = 4, 32


def encode(target: bytes, reference: bytes) -> bytes:
    """``target`` as copies out of ``reference`` and literal bytes."""
    places: dict[bytes, list[int]] = {}
    for i in range(len(reference) - LEAST_COPY + 1):
        places.setdefault(reference[i : i + LEAST_COPY], []).append(i)
    out, literal, at = Writer(), bytearray(), 0

    def flush() -> None:
        if literal:
            out.unsigned((len(literal) - 1) << 1 | 1)
            out.extend(literal)
            literal.clear()

    while at < len(target):
        best, where = 0, 0
        for p in places.get(target[at : at + LEAST_COPY], ())[-TRIES:]:
            n, most = LEAST_COPY, min(len(target) - at, len(reference) - p)
            step = most - n
            while step:  # doubling comparison of slices: far fewer steps than byte by byte
                if target[at + n : at + n + step] == reference[p + n : p + n + step]:
                    n += step
                    step = min(step, most - n)
                else:
                    step //= 2
            if n > best:
                best, where = n, p
        if best:
            flush()
            out.unsigned((best - 1) << 1)
            out.unsigned(where)
            at += best
        else:
            literal.append(target[at])
            at += 1
    flush()
    return bytes(out)


def decode(patch: bytes, reference: bytes) -> bytes:
    r, out = Reader(patch), bytearray()
    while r.left:
        head = r.unsigned()
        n = (head >> 1) + 1
        if head & 1:
            out += r.take(n)
        else:
            at = r.unsigned()
            if at + n > len(reference):
                raise FormatError("R07", f"copy of {at}..{at + n} out of {len(reference)} bytes")
            out += reference[at : at + n]
    return bytes(out)


def write_tag_diff(w: Writer, old: list[str], new: list[str]) -> None:
    at = {t: i for i, t in enumerate(old)}
    w.unsigned(len(new))
    for t in new:
        w.unsigned(at.get(t, -1) + 1)
        if t not in at:
            w.text(t)


def read_tag_diff(r: Reader, old: list[str]) -> list[str]:
    out = []
    for _ in range(r.unsigned()):
        ref = r.unsigned()
        if ref > len(old):
            raise FormatError("R07", f"tag reference {ref} of {len(old)}")
        out.append(old[ref - 1] if ref else r.text())
    return out


def write_patch_file(header: dict, old_tags: tuple[list[str], list[str]], records: Iterable[tuple[int, int, int, int, dict[int, bytes]]]) -> bytes:
    """records: (si, x, y, flags, patches by zoom row), in any order."""
    body = Writer()
    last = (-1, 0, 0)
    for si, y, x, flags, patches in sorted((si, y, x, flags, p) for si, x, y, flags, p in records):
        body.number(si, 1)
        same_si = si == last[0]
        body.unsigned(y - last[1] if same_si else y)
        body.unsigned(x - last[2] if same_si and y == last[1] else x)
        last = (si, y, x)
        body.number(flags, 1)
        if not flags & EMPTY:
            body.unsigned(sum(1 << zi for zi in patches))
            for zi in sorted(patches):
                body.unsigned(len(patches[zi]))
                body += patches[zi]
    body.number(END_OF_RECORDS, 1)
    packed = zstandard.ZstdCompressor(level=19).compress(bytes(body))
    w = Writer(PATCH_MAGIC)
    head = _full_header({**header, "poi_tags": [], "way_tags": []})
    w.unsigned(len(head))
    w += head
    write_tag_diff(w, old_tags[0], header["poi_tags"])
    write_tag_diff(w, old_tags[1], header["way_tags"])
    w.unsigned(len(packed))
    w += packed
    return bytes(w)


def _full_header(h: dict) -> bytes:
    body = write_body(h)
    return MAP_MAGIC + len(body).to_bytes(4, "big") + body


def _head(r: Reader) -> tuple[dict, Reader]:
    if r.take(len(PATCH_MAGIC)) != PATCH_MAGIC:
        raise FormatError("R02", "no change-log file")
    n = r.unsigned()
    head = Reader(r.take(n))
    head.take(len(MAP_MAGIC) + 4)
    return read_body(head), r


def read_patch_header(f: BinaryIO, old_tags: tuple[list[str], list[str]]) -> dict:
    """The new header with its dictionaries; the records are not unpacked."""
    header, r = _head(Reader(f.read()))
    for k, old in zip(("poi_tags", "way_tags"), old_tags):
        header[k] = read_tag_diff(r, old)
    return header


def patch_records(f: BinaryIO) -> Iterator[tuple[int, int, int, int, dict[int, bytes]]]:
    """(si, x, y, flags, patches by zoom row) of a change-log file, without its dictionaries."""
    _, r = _head(Reader(f.read()))
    for _ in range(2):
        for _ in range(r.unsigned()):
            if not r.unsigned():
                r.take(r.unsigned())
    yield from _records(r)


def read_patch_file(data: bytes, old_tags: tuple[list[str], list[str]]) -> tuple[dict, list[tuple[int, int, int, int, dict[int, bytes]]]]:
    """The new header with its dictionaries, and the records (si, x, y, flags, patches)."""
    header, r = _head(Reader(data))
    for k, old in zip(("poi_tags", "way_tags"), old_tags):
        header[k] = read_tag_diff(r, old)
    return header, list(_records(r))


def _records(r: Reader) -> Iterator[tuple[int, int, int, int, dict[int, bytes]]]:
    with zstandard.ZstdDecompressor().stream_reader(bytes(r.take(r.unsigned()))) as stream:  # a stream need not store its size
        body = Reader(stream.read())
    last = (-1, 0, 0)
    while (si := body.number(1)) != END_OF_RECORDS:
        dy, dx = body.unsigned(), body.unsigned()
        same_si = si == last[0]
        y = last[1] + dy if same_si else dy
        x = last[2] + dx if same_si and dy == 0 else dx
        last = (si, y, x)
        flags, patches = body.number(1), {}
        if not flags & EMPTY:
            mask, zi = body.unsigned(), 0
            while mask:
                if mask & 1:
                    patches[zi] = body.take(body.unsigned())
                mask >>= 1
                zi += 1
        yield si, x, y, flags, patches
