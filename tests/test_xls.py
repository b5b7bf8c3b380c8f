"""Workbooks in the older binary format, from files that are put together here record by record."""

import struct

import pytest

from tickloom.sources import files, prices, workbooks, xls


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def string(text, wide=None):
    wide = any(ord(c) > 255 for c in text) if wide is None else wide
    return struct.pack("<HB", len(text), wide) + text.encode("utf-16-le" if wide else "latin-1")


def cell(kind, row, column, data):
    return record(kind, struct.pack("<HHH", row, column, 0) + data)


def book(cell_records, shared=b"", sheets=1):
    """A record stream of so many sheets, of which the last has the cells."""
    bof = record(0x0809, struct.pack("<HH", 0x0600, 5) + bytes(12))
    names = [f"s{i}".encode() for i in range(sheets)]
    size = len(bof) + sum(4 + 8 + len(n) for n in names) + len(shared) + 4
    bodies, places = [], []
    for i in range(sheets):
        places.append(size + sum(map(len, bodies)))
        bodies.append(record(0x0809, bytes(16)) + (cell_records if i == sheets - 1 else cell(0x0203, 0, 0, struct.pack("<d", 7.0))) + record(0x000A))
    bounds = b"".join(record(0x0085, struct.pack("<IBBBB", p, 0, 0, len(n), 0) + n) for p, n in zip(places, names))
    return bof + bounds + shared + record(0x000A) + b"".join(bodies)


def compound(stream, name="Workbook"):
    """A container whose only stream is in sectors, or if it is short in the container's stream of small sectors."""
    sector, small = 512, len(stream) < 4096
    body = stream + bytes(-len(stream) % (64 if small else sector))
    n_small = len(body) // 64 if small else 0
    data = body + bytes(-len(body) % sector)
    n = len(data) // sector
    # sectors: 0 table, 1 directory, 2 table of small sectors, then data
    chain = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *range(4, 3 + n), 0xFFFFFFFE]
    fat = struct.pack("<128I", *chain, *[0xFFFFFFFF] * (128 - len(chain)))
    minis = [*range(1, n_small), 0xFFFFFFFE] if small else []
    mini_fat = struct.pack("<128I", *minis, *[0xFFFFFFFF] * (128 - len(minis)))

    def entry(title, kind, start, size):
        raw = title.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + bytes(48) + struct.pack("<IQ", start, size)

    root = entry("Root Entry", 5, 3 if small else 0xFFFFFFFE, len(data) if small else 0)
    directory = (root + entry(name, 2, 0 if small else 3, len(stream))).ljust(sector, b"\0")
    header = xls.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0, 0)
    return header + struct.pack("<108I", *[0xFFFFFFFF] * 108) + fat + directory + mini_fat + data


def shared_strings(*texts, cut=None):
    body = struct.pack("<II", len(texts), len(texts)) + b"".join(map(string, texts))
    return record(0x00FC, body) if cut is None else record(0x00FC, body[:cut]) + record(0x003C, body[cut:])


ALL = (
    cell(0x00FD, 0, 0, struct.pack("<I", 1)) + cell(0x0203, 0, 2, struct.pack("<d", 2.5)) + cell(0x027E, 2, 0, struct.pack("<I", (44927 << 2) | 2))
    + cell(0x027E, 2, 1, struct.pack("<I", ((1 << 32) - (150 << 2)) | 3)) + cell(0x027E, 2, 2, struct.pack("<I", struct.unpack("<Q", struct.pack("<d", 0.5))[0] >> 32))
    + record(0x00BD, struct.pack("<HH", 3, 1) + struct.pack("<HI", 0, (5 << 2) | 2) + struct.pack("<HI", 0, (6 << 2) | 2) + struct.pack("<H", 2))
    + cell(0x0204, 4, 0, string("plain")) + cell(0x0204, 4, 1, string("größer 漢")) + cell(0x0205, 4, 2, b"\x01\x00") + cell(0x0205, 4, 3, b"\x2a\x01")
    + cell(0x0006, 5, 0, struct.pack("<d", 9.25) + bytes(8)) + cell(0x0006, 5, 1, b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + record(0x0207, string("made"))
    + cell(0x0006, 5, 2, b"\1\0\1\0\0\0\xff\xff" + bytes(8)) + cell(0x0006, 5, 3, b"\3\0\0\0\0\0\xff\xff" + bytes(8)) + cell(0x0201, 6, 0, b"")
)
EXPECTED = [
    (1, ["two", None, "2.5"]), (3, ["44927", "-1.5", "0.5"]), (4, [None, "5", "6"]), (5, ["plain", "größer 漢", "1", "#N/A"]), (6, ["9.25", "made", "1"]),
]


@pytest.mark.parametrize("sheets", [1, 3])
@pytest.mark.parametrize("padding", [0, 9000])
def test_all_kinds_of_cells(sheets, padding):
    stream = book(ALL, shared_strings("one", "two")) if sheets == 1 else book(ALL, shared_strings("one", "two"), sheets)
    content = compound(stream + bytes(padding))
    assert list(xls.parsed_xls(content, sheets - 1)) == EXPECTED
    if sheets > 1:
        assert list(xls.parsed_xls(content)) == [(1, ["7"])]


def test_strings_that_go_on_in_another_record():
    texts = ["a" * 50, "漢" * 50, "", "ende"]
    whole = 8 + 3 + 50
    labels = b"".join(cell(0x00FD, i, 0, struct.pack("<I", i)) for i in range(4))
    expected = [(i + 1, [t]) for i, t in enumerate(texts)]
    for cut in (whole, whole + 3):  # between two strings, and before the first character of one
        made = shared_strings(*texts, cut=cut)
        if cut == whole + 3:
            body = struct.pack("<II", 4, 4) + b"".join(map(string, texts))
            made = record(0x00FC, body[:cut]) + record(0x003C, b"\x01" + body[cut:])
        assert list(xls.parsed_xls(compound(book(labels, made)))) == expected
    # narrow in the first record, wide in the second
    first = struct.pack("<II", 1, 1) + struct.pack("<HB", 6, 0) + b"abc"
    mixed = record(0x00FC, first) + record(0x003C, b"\x01" + "漢字x".encode("utf-16-le"))
    assert list(xls.parsed_xls(compound(book(cell(0x00FD, 0, 0, struct.pack("<I", 0)), mixed)))) == [(1, ["abc漢字x"])]
    # formatted and annotated: runs and an extension after the characters
    rich = struct.pack("<II", 2, 2) + struct.pack("<HBHI", 2, 12, 1, 3) + b"hi" + bytes(4) + b"ext" + string("next")
    two = b"".join(cell(0x00FD, i, 0, struct.pack("<I", i)) for i in range(2))
    assert list(xls.parsed_xls(compound(book(two, record(0x00FC, rich))))) == [(1, ["hi"]), (2, ["next"])]


def test_files_that_are_no_such_workbooks():
    with pytest.raises(ValueError, match="compound"):
        list(xls.parsed_xls(b"PK" + bytes(600)))
    with pytest.raises(ValueError, match="1997"):
        list(xls.parsed_xls(compound(book(ALL), "Book")))
    with pytest.raises(ValueError, match="encrypted"):
        list(xls.parsed_xls(compound(record(0x002F, bytes(4)))))


def test_readers_of_both_kinds_of_workbooks(spark, tmp_path):
    labels = lambda rows: b"".join(
        cell(0x0204, r, c, string(x)) if isinstance(x, str) else cell(0x0203, r, c, struct.pack("<d", x)) for r, row in enumerate(rows) for c, x in enumerate(row) if x is not None
    )
    sheet = [["Fund", None], ["as of", "today"], ["Ticker", "Weight"], ["A", 5.5], [None, 1.0], ["B & C", "x"], ["", None]]
    vendor = [["(tic) Ticker Symbol", "datadate", "prccd", "ajexdi", "cshtrd"], ["A", 44927.0, 10.0, 0.5, 3.0], [" A", "2023-01-02", 8.0, 0.5, None]]
    for suffix, made in (("xls", lambda rows: compound(book(labels(rows)))), ("xlsx", workbooks.sheet_bytes)):
        (tmp_path / f"h.{suffix}").write_bytes(made(sheet))
        (tmp_path / f"v.{suffix}").write_bytes(made(vendor))
        held = files.holdings_sheet(spark, str(tmp_path / f"h.{suffix}")).orderBy("rid").collect()
        assert [(r.ticker, r.weight) for r in held] == [("A", 0.055), (None, 0.01), ("B & C", None)]
        panel = prices.VendorPrices.open(spark, str(tmp_path / f"v.{suffix}")).with_volume(["A"], "2023-01-01", "2023-01-02").orderBy("date").collect()
        assert [(str(r.date), r.adj_close, r.volume) for r in panel] == [("2023-01-01", 5.0, 3.0), ("2023-01-02", 4.0, None)]
    both = workbooks.read_workbooks(spark, f"{tmp_path}/h.*").groupBy("path").count().collect()
    assert len(both) == 2
    with pytest.raises(ValueError, match="one workbook"):
        workbooks.with_header(workbooks.read_workbooks(spark, f"{tmp_path}/h.*"))
    with pytest.raises(TypeError):
        files.read_by_suffix(spark, "/tmp/x.ods")
