"""ZIP archives of stored members: a writer for streams, and a reader that parses the directories itself and reads ranges.

Sizes and places are kept in ZIP64 fields always, so archives and members may pass 4 GB and 65,535 members; the reader
takes archives with and without them.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

_LOCAL, _CENTRAL, _AFTER = b"PK\x03\x04", b"PK\x01\x02", b"PK\x07\x08"
_END, _END64, _FIND64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_FLAGS, _DATE = 0x0808, 0x21  # sizes follow the data, names are UTF-8; 1980-01-01


class Writer:
    """Writes members one after the other to a stream that need not seek."""

    def __init__(self, out):
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]  # name, place, crc, size
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, _FLAGS, 0, 0, _DATE, 0, _FULL32, _FULL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Returns the place of the data in its member."""
        was = self.open[3]
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self._put(data)
        return was

    def end(self) -> None:
        _, _, crc, size = self.open
        self._put(_AFTER + struct.pack("<IQQ", crc, size, size))
        self.members.append(self.open)
        self.open = None

    def close(self) -> None:
        start = self.at
        for raw, place, crc, size in self.members:
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, _FLAGS, 0, 0, _DATE, crc, _FULL32, _FULL32, len(raw), 28, 0, 0, 0, 0, _FULL32) + raw + struct.pack("<HHQQQ", 1, 24, size, size, place))
        end, n = self.at, len(self.members)
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, end - start, start))
        self._put(_FIND64 + struct.pack("<IQI", 0, end, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    place: int  # of the local header


class BadArchive(ValueError):
    pass


class Reader:
    """``read(place, size)`` is all it needs of a file."""

    def __init__(self, read, size: int):
        self.read = read
        self.members = {m.name: m for m in self._directory(size)}

    def _directory(self, size: int):
        tail = self.read(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)  # the signature may stand in a comment
        if at < 0:
            raise BadArchive("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        end = size - len(tail) + at
        if (n == _FULL16 or _FULL32 in (length, start)) and end >= 20:
            find = self.read(end - 20, 20)
            if find[:4] == _FIND64:
                record = self.read(struct.unpack_from("<Q", find, 8)[0], 56)
                if record[:4] != _END64:
                    raise BadArchive("no ZIP64 end of central directory")
                n, length, start = struct.unpack_from("<QQQ", record, 32)
        data, p = self.read(start, length), 0
        for _ in range(n):
            if data[p : p + 4] != _CENTRAL:
                raise BadArchive("broken central directory")
            flags, method, _, _, crc, packed, full, n_name, n_extra, n_note, _, _, _, place = struct.unpack_from("<HHHHIIIHHHHHII", data, p + 8)
            name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = data[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, size_ = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # has only the fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, q + 4))
                    full = next(wide) if full == _FULL32 else full
                    packed = next(wide) if packed == _FULL32 else packed
                    place = next(wide) if place == _FULL32 else place
                q += 4 + size_
            yield Member(name, method, crc, full, place)
            p += 46 + n_name + n_extra + n_note

    def data_start(self, name: str) -> int:
        """Where a stored member's bytes begin in the file."""
        m = self.members[name]
        if m.method != 0:
            raise BadArchive(f"{name} is compressed; ranges can be read of stored members only")
        head = self.read(m.place, 30)
        if head[:4] != _LOCAL:
            raise BadArchive("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return m.place + 30 + n_name + n_extra
