"""Reading ZIP directories by range: where stored members lie, without extracting anything."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

# Signatures and fixed sizes of the ZIP format.
END, END_SIZE = b"PK\x05\x06", 22
END64, LOCATOR64, LOCATOR64_SIZE = b"PK\x06\x06", b"PK\x06\x07", 20
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
MOST_COMMENT = 0xFFFF
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
EXTRA64 = 0x0001
STORED = 0

ReadAt = Callable[[int, int], bytes]


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def directory(read_at: ReadAt, size: int) -> list[Member]:
    """The members of an archive of ``size`` bytes, from its central directory, ZIP64 or not."""
    tail_at = max(0, size - END_SIZE - MOST_COMMENT)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0:
        if at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HLL", tail, at + 10)
    if count == FULL16 or length == FULL32 or start == FULL32:
        locator = read_at(tail_at + at - LOCATOR64_SIZE, LOCATOR64_SIZE)
        if locator[:4] != LOCATOR64:
            raise ValueError("no locator of a ZIP64 directory")
        end = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != END64:
            raise ValueError("no end of a ZIP64 directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    entries, at, members = read_at(start, length), 0, []
    for _ in range(count):
        if entries[at: at + 4] != ENTRY:
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, full = struct.unpack_from("<LL", entries, at + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<HHH", entries, at + 28)
        header = struct.unpack_from("<L", entries, at + 42)[0]
        name = entries[at + ENTRY_SIZE: at + ENTRY_SIZE + name_n]
        extra = entries[at + ENTRY_SIZE + name_n: at + ENTRY_SIZE + name_n + extra_n]
        wide = iter(_wide_fields(extra))
        full = next(wide) if full == FULL32 else full
        packed = next(wide) if packed == FULL32 else packed
        header = next(wide) if header == FULL32 else header
        members.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, full, packed, header))
        at += ENTRY_SIZE + name_n + extra_n + comment_n
    return members


def _wide_fields(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            return list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
        at += 4 + n
    return []


def stored_at(read_at: ReadAt, member: Member) -> int:
    """Where the bytes of a stored member begin in the archive."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed and cannot be read by range")
    head = read_at(member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + name_n + extra_n
