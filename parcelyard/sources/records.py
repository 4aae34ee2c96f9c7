"""Records of the ZIP format as bytes: headers, descriptors, directory and end records, and their parser.

Numbers are little-endian. Signatures and field orders are fixed values of the format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

LOCAL, DIRECTORY, END, END64, LOCATOR64, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
STORE, DEFLATE, AES = 0, 8, 99
ENCRYPTED, HAS_DESCRIPTOR, UTF8 = 0x0001, 0x0008, 0x0800
VERSION, VERSION64, TIME, DATE = 20, 45, 0, 33  #: all entries are of 1980-01-01 00:00
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class ArchiveError(Exception):
    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status, self.message = status, message


@dataclass
class Entry:
    name: bytes
    flag: int
    method: int
    crc: int
    packed: int
    size: int
    offset: int
    directory: bool

    @property
    def text(self) -> str:
        """The name as text: UTF-8 if it is that, else code page 437."""
        try:
            return self.name.decode("utf-8")
        except UnicodeDecodeError:
            return self.name.decode("cp437")

    @property
    def encrypted(self) -> bool:
        return bool(self.flag & ENCRYPTED)


def local_header(e: Entry) -> bytes:
    """With a descriptor to follow, checksum and sizes are zero here."""
    if len(e.name) > MAX16:
        raise ArchiveError("unsupported", f"path too long for zip entry: {e.text}")
    later = bool(e.flag & HAS_DESCRIPTOR)
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, e.flag, e.method, TIME, DATE, *((0, 0, 0) if later else (e.crc, e.packed, e.size)), len(e.name), 0) + e.name


def descriptor(e: Entry) -> bytes:
    return struct.pack("<IIII", DESCRIPTOR, e.crc, e.packed, e.size) if e.flag & HAS_DESCRIPTOR else b""


def directory_record(e: Entry) -> bytes:
    """Only an offset beyond 32 bits gets a zip64 field."""
    far = e.offset > MAX32
    extra = struct.pack("<HHQ", 1, 8, e.offset) if far else b""
    fixed = struct.pack("<IHHHHHHIIIHHHHHII", DIRECTORY, VERSION, VERSION64 if far else VERSION, e.flag, e.method, TIME, DATE, e.crc, e.packed, e.size, len(e.name), len(extra), 0, 0, 0, 0x10 if e.directory else 0, MAX32 if far else e.offset)
    return fixed + e.name + extra


def end_records(count: int, size: int, offset: int) -> bytes:
    """End of the directory, after the zip64 records if a number does not fit."""
    out = b""
    if count > MAX16 or size > MAX32 or offset > MAX32:
        out = struct.pack("<IQHHIIQQQQ", END64, 44, VERSION64, VERSION64, 0, 0, count, count, size, offset) + struct.pack("<IIQI", LOCATOR64, 0, offset + size, 1)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, min(count, MAX16), min(count, MAX16), min(size, MAX32), min(offset, MAX32), 0)


class Ranges:
    """Exact reads by position from a seekable file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, offset: int, n: int, message: str) -> bytes:
        if offset < 0 or n < 0 or offset > self.size or n > self.size - offset:
            raise ArchiveError("invalid_job", message)
        self.file.seek(offset)
        parts, left = [], n
        while left:
            part = self.file.read(left)
            if not part:
                raise ArchiveError("io_error", "short read")
            parts.append(part)
            left -= len(part)
        return b"".join(parts)


def directory_range(r: Ranges) -> tuple[int, int, int]:
    """Count, size and offset of the directory, from the end of the file."""
    if r.size < 22:
        raise ArchiveError("invalid_job", "archive is too small to be a valid zip file")
    tail_at = max(0, r.size - 22 - MAX16)
    tail = r.read(tail_at, r.size - tail_at, "archive is too small to be a valid zip file")
    at = tail.rfind(struct.pack("<I", END), 0, len(tail) - 18)
    if at < 0:
        raise ArchiveError("invalid_job", "end of central directory record not found")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if MAX16 == count or MAX32 in (size, offset):
        where = tail_at + at - 20
        if where < 0:
            raise ArchiveError("invalid_job", "zip64 locator is missing")
        locator = r.read(where, 20, "zip64 locator is missing")
        if struct.unpack_from("<I", locator)[0] != LOCATOR64:
            raise ArchiveError("invalid_job", "zip64 locator signature not found")
        record = r.read(struct.unpack_from("<Q", locator, 8)[0], 56, "zip64 end of central directory points outside the archive")
        if struct.unpack_from("<I", record)[0] != END64:
            raise ArchiveError("invalid_job", "zip64 end of central directory signature not found")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    if offset > r.size or size > r.size - offset:
        raise ArchiveError("invalid_job", "central directory points outside the archive")
    return count, size, offset


def parse_directory(r: Ranges) -> Iterator[Entry]:
    return (e for _, e in placed_entries(r))


def placed_entries(r: Ranges, at: int = 0, most: int | None = None) -> Iterator[tuple[int, Entry]]:
    """Entries with the places of their records in the directory: ``most`` of them from the place ``at`` on."""
    count, size, offset = directory_range(r)
    # A record of a slice has 46 bytes and three fields of 16-bit lengths, so no more than that is read
    body = r.read(offset + at, size - at if most is None else min(size - at, most * (46 + 3 * MAX16)), "central directory points outside the archive")
    base, at, size = at, 0, len(body)
    for _ in range(count if most is None else most):
        if at + 46 > size:
            raise ArchiveError("invalid_job", "truncated central directory entry")
        sig, _, _, flag, method, _, _, crc, packed, full, n_name, n_extra, n_comment, _, _, external, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", body, at)
        if sig != DIRECTORY:
            raise ArchiveError("invalid_job", "invalid central directory signature")
        end = at + 46 + n_name + n_extra + n_comment
        if end > size:
            raise ArchiveError("invalid_job", "central directory entry exceeds archive size")
        name = body[at + 46 : at + 46 + n_name]
        extra = body[at + 46 + n_name : at + 46 + n_name + n_extra]
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if k + 4 + n > len(extra):
                raise ArchiveError("invalid_job", "zip extra field exceeds entry size")
            if kind == 1:
                field, j = extra[k + 4 : k + 4 + n], 0
                wide = []
                for value in (full, packed, where):
                    if value == MAX32:
                        if j + 8 > n:
                            raise ArchiveError("invalid_job", "zip64 extra field is truncated")
                        value = struct.unpack_from("<Q", field, j)[0]
                        j += 8
                    wide.append(value)
                full, packed, where = wide
            k += 4 + n
        yield base + at, Entry(name, flag, method, crc, packed, full, where, name.endswith(b"/") or bool(external & 0x10))
        at = end


def locate(r: Ranges, e: Entry) -> tuple[int, int]:
    """Offset of an entry's data, and the two bytes that verify a password, from its local header."""
    head = r.read(e.offset, 30, "local file header points outside the archive")
    sig, _, flag, method, time, _, _, _, _, n_name, n_extra = struct.unpack("<IHHHHHIIIHH", head)
    if sig != LOCAL:
        raise ArchiveError("invalid_job", "invalid local file header signature")
    if method != e.method:
        raise ArchiveError("invalid_job", "local header compression method mismatch")
    data = e.offset + 30 + n_name + n_extra
    if data > r.size or e.packed > r.size - data:
        raise ArchiveError("invalid_job", "file data exceeds archive size")
    return data, time if flag & HAS_DESCRIPTOR else e.crc >> 16
