"""Workbooks in the older binary format (xls): sheet rows as text cells.

Such a file is a container of sector chains; its stream ``Workbook`` is a sequence of records, of which
those of cell values, shared strings and sheet places are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Fixed values of the container: signature, end of a chain, bytes of a directory entry.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
END_OF_CHAIN = 0xFFFFFFFE
ENTRY = 128
#: Record types.
EOF, FORMULA, FILEPASS, CONTINUE, BOUNDSHEET, MULRK, RSTRING, SST, LABELSST, NUMBER, LABEL, BOOLERR, STRING, RK = (
    0x000A, 0x0006, 0x002F, 0x003C, 0x0085, 0x00BD, 0x00D6, 0x00FC, 0x00FD, 0x0203, 0x0204, 0x0205, 0x0207, 0x027E,
)
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Container:
    """Named streams of a compound file."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self.content = content
        shift, mini_shift = struct.unpack_from("<HH", content, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        n_fat, directory, _, self.cutoff, mini_fat, _, difat, n_difat = struct.unpack_from("<8I", content, 44)
        sectors = list(struct.unpack_from("<109I", content, 76))
        for _ in range(n_difat):  # more places of the table's sectors
            more = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors, difat = [*sectors, *more[:-1]], more[-1]
        self.fat = self._numbers(b"".join(self._sector(s) for s in sectors[:n_fat]))
        self.mini_fat = self._numbers(self._chain(mini_fat))
        entries = self._chain(directory)
        self.entries = {}
        for at in range(0, len(entries), ENTRY):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            if kind in (2, 5):
                name = entries[at : at + max(length - 2, 0)].decode("utf-16-le")
                start, size = struct.unpack_from("<II", entries, at + 116)
                self.entries["/" if kind == 5 else name] = start, size

    def _sector(self, number: int) -> bytes:
        return self.content[(number + 1) * self.size : (number + 2) * self.size]

    @staticmethod
    def _numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])

    @staticmethod
    def _places(start: int, table: tuple[int, ...]) -> Iterator[int]:
        for _ in range(len(table)):
            if start >= len(table):
                return
            yield start
            start = table[start]
        if start < len(table):
            raise ValueError("a chain of sectors has no end")

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._places(start, self.fat)))

    def stream(self, name: str) -> bytes:
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        small, n = self._chain(self.entries["/"][0]), self.mini_size
        return b"".join(small[i * n : (i + 1) * n] for i in self._places(start, self.mini_fat))[:size]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Type and data of the records from ``at`` on, up to an end record; the data of records that continue one come with it."""
    kind, parts = None, []
    while at + 4 <= len(stream):
        new, length = struct.unpack_from("<HH", stream, at)
        data = stream[at + 4 : at + 4 + length]
        at += 4 + length
        if new == CONTINUE and parts:
            parts.append(data)
            continue
        if parts:
            yield kind, parts
        if new == EOF:
            return
        kind, parts = new, [data]
    if parts:
        yield kind, parts


class Text:
    """Reads strings from a record and those that continue it."""

    def __init__(self, parts: list[bytes], at: int = 0) -> None:
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at == len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
            piece = self.parts[self.part][self.at : self.at + n]
            self.at, n, out = self.at + len(piece), n - len(piece), out + piece
        return out

    def string(self, length_bytes: int = 2) -> str:
        length = int.from_bytes(self.take(length_bytes), "little")
        flags = self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        wide, out = flags & 1, []
        while length:
            if self.at == len(self.parts[self.part]):  # the next record says anew how wide characters are
                self.part, self.at = self.part + 1, 1
                wide = self.parts[self.part][0] & 1
            n = min(length, (len(self.parts[self.part]) - self.at) // (2 if wide else 1))
            out.append(self.take(2 * n if wide else n).decode("utf-16-le" if wide else "latin-1"))
            length -= n
        self.take(4 * runs + extra)
        return "".join(out)


def number(value: float) -> str:
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def packed(value: int) -> float:
    """A number of 30 bits: an integer or the high bits of a double, or a hundredth of these."""
    if value & 2:
        out = float((value - (1 << 32) if value >> 31 else value) >> 2)
    else:
        out = struct.unpack("<d", struct.pack("<II", 0, value & 0xFFFFFFFC))[0]
    return out / 100 if value & 1 else out


def cells(stream: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """Row, column and text of the cells of the sheet that begins at ``at``."""
    pending = None
    for kind, parts in records(stream, at):
        data = parts[0]
        row, column = struct.unpack_from("<HH", data) if len(data) >= 4 else (0, 0)
        if kind == LABELSST:
            yield row, column, shared[struct.unpack_from("<I", data, 6)[0]]
        elif kind == NUMBER:
            yield row, column, number(struct.unpack_from("<d", data, 6)[0])
        elif kind == RK:
            yield row, column, number(packed(struct.unpack_from("<I", data, 6)[0]))
        elif kind == MULRK:
            for k in range((len(data) - 6) // 6):
                yield row, column + k, number(packed(struct.unpack_from("<I", data, 6 + 6 * k)[0]))
        elif kind in (LABEL, RSTRING):
            yield row, column, Text(parts, 6).string()
        elif kind == BOOLERR:
            yield row, column, ERRORS.get(data[6], "#N/A") if data[7] else str(data[6])
        elif kind == FORMULA:
            pending = None
            if data[12:14] != b"\xff\xff":
                yield row, column, number(struct.unpack_from("<d", data, 6)[0])
            elif data[6] == 0:
                pending = row, column
            elif data[6] in (1, 2):
                yield row, column, ERRORS.get(data[8], "#N/A") if data[6] == 2 else str(data[8])
        elif kind == STRING and pending:
            yield *pending, Text(parts).string()
            pending = None


def parsed_xls(content: bytes, sheet: int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """Row number, from 1, and cells, as text, of a sheet's rows that have any; cells that are not there are None."""
    container = Container(content)
    if "Workbook" not in container.entries:
        raise ValueError("no workbook of 1997 or later")
    stream, places, shared = container.stream("Workbook"), [], []
    for kind, parts in records(stream):
        if kind == FILEPASS:
            raise ValueError("the workbook is encrypted")
        if kind == BOUNDSHEET:
            places.append(struct.unpack_from("<I", parts[0])[0])
        if kind == SST:
            text = Text(parts, 8)
            shared = [text.string() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
    rows: dict[int, dict[int, str]] = {}
    for row, column, text in cells(stream, places[sheet], shared):
        rows.setdefault(row, {})[column] = text
    for row in sorted(rows):
        yield row + 1, [rows[row].get(c) for c in range(max(rows[row]) + 1)]
