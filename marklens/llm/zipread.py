"""ZIP and ZIP64 directories read by ranges: where the members of a package lie, without extracting any of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

#: Bytes of the directory that are read at once, and the longest tail that can hold the end record and its comment.
DIRECTORY_BLOCK = 1 << 20
TAIL = 65535 + 22

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class Member(NamedTuple):
    name: str
    method: int  # 0: stored, 8: deflated
    packed: int  # bytes in the package
    size: int  # bytes unpacked
    header: int  # where its local header starts


def _at(file, start: int, n: int) -> bytes:
    file.seek(start)
    got = file.read(n)
    if len(got) != n:
        raise ValueError(f"package ends at {start + len(got)}, bytes up to {start + n} were expected")
    return bytes(got)


def _end(file, size: int) -> tuple[int, int, int]:
    """Start and length of the central directory, and what lies before the package's own first byte."""
    tail = _at(file, size - min(size, TAIL), min(size, TAIL))
    at = len(tail)
    while True:
        at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP package")
        if at + 22 <= len(tail):
            *_, length, start, comment = struct.unpack_from("<4s4H2LH", tail, at)
            if at + 22 + comment == len(tail):
                break
        at += 3  # the mark may begin one byte earlier
    place = size - len(tail) + at
    if place >= 20 and (found := _at(file, place - 20, 20))[:4] == _LOCATOR:
        # the ZIP64 record stands right before its locator; the given place is off by whatever was put before the package
        given = struct.unpack("<4sLQL", found)[2]
        for where in (given, place - 20 - 56):
            if 0 <= where <= place - 76 and (record := _at(file, where, 56))[:4] == _END64:
                length, start = struct.unpack("<4sQ2H2L4Q", record)[-2:]
                return where - length, length, where - length - start
        raise ValueError("ZIP64 locator without its record")
    return place - length, length, place - length - start


def _zip64(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            at += 4
            out = []
            for value in (size, packed, header):
                if value == 0xFFFFFFFF:
                    value = struct.unpack_from("<Q", extra, at)[0]
                    at += 8
                out.append(value)
            return tuple(out)
        at += 4 + n
    return size, packed, header


def members(file, size: int) -> Iterator[Member]:
    """Entries of the central directory of a seekable file, in order; the directory passes in blocks."""
    start, left, before = _end(file, size)
    if start < 0 or before < 0:
        raise ValueError("directory lies outside the package")
    held = b""
    while left or held:
        need = 46
        if len(held) >= 46:
            if held[:4] != _ENTRY:
                raise ValueError("broken directory entry")
            _, _, _, flags, method, _, _, _, packed, unpacked, n, m, k, _, _, _, header = struct.unpack_from("<4s6H3L5H2L", held)
            need = 46 + n + m + k
            if len(held) >= need:
                unpacked, packed, header = _zip64(held[46 + n : 46 + n + m], unpacked, packed, header)
                if flags & 1:
                    raise ValueError("encrypted member")
                yield Member(held[46 : 46 + n].decode("utf-8" if flags & 0x800 else "cp437"), method, packed, unpacked, header + before)
                held = held[need:]
                continue
        if not left:
            raise ValueError("directory ends inside an entry")
        take = min(left, max(DIRECTORY_BLOCK, need - len(held)))
        held += _at(file, start, take)
        start, left = start + take, left - take


def data_start(file, member: Member) -> int:
    """Where the bytes of a member begin: behind its local header, whose lengths are its own."""
    head = _at(file, member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no local header for {member.name}")
    n, m = struct.unpack_from("<2H", head, 26)
    return member.header + 30 + n + m
