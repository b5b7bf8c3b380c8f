"""Tables of html pages: a tag tokeniser with a stack of open tables, over Arrow batches of pages.

Entities are decoded, cells that span rows or columns fill all the places that they span, a table in a
cell is a table of its own, and end tags may be left out where html allows it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of html: the most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
#: Elements whose text no reader sees, and those that part words.
UNSEEN = {"script", "style", "template"}
BREAKS = {"br", "p", "div", "li", "hr"}


class Grid:
    """A table's rows so far, its open row, and cells of earlier rows that reach into it."""

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.row: list[str | None] | None = None
        self.text: list[str] | None = None
        self.span = (1, 1)
        self.reaching: dict[int, tuple[int, str]] = {}  # column -> rows left, text

    def begin_row(self) -> None:
        self.end_row()
        self.row = []

    def begin_cell(self, columns: int, rows: int) -> None:
        self.end_cell()
        if self.row is None:
            self.row = []
        self.text, self.span = [], (columns, rows)

    def end_cell(self) -> None:
        if self.text is None:
            return
        text, self.text = " ".join("".join(self.text).split()), None
        self._fill()
        for _ in range(self.span[0]):
            if self.span[1] > 1:
                self.reaching[len(self.row)] = (self.span[1], text)
            self.row.append(text)

    def end_row(self) -> None:
        self.end_cell()
        if self.row is None:
            return
        self._fill()
        while self.reaching and len(self.row) <= max(self.reaching):  # a short row under a cell further right
            self.row.append("")
            self._fill()
        self.rows.append(self.row)
        self.row = None
        self.reaching = {c: (n - 1, t) for c, (n, t) in self.reaching.items() if n > 1}

    def _fill(self) -> None:
        """Puts in what cells of earlier rows have at the next places."""
        at = len(self.row)
        while at in self.reaching:
            self.row.append(self.reaching[at][1])
            at += 1


class TableParser(HTMLParser):
    """tables: all tables of a page in the order in which they begin."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[Grid] = []
        self.open: list[Grid] = []
        self.unseen = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "table":
            self.open.append(Grid())
            self.tables.append(self.open[-1])
        elif self.open:
            table, given = self.open[-1], dict(attrs)
            if tag == "tr":
                table.begin_row()
            elif tag in ("td", "th"):
                table.begin_cell(span(given.get("colspan"), MOST_COLUMNS), span(given.get("rowspan"), MOST_ROWS))
            elif tag in BREAKS and table.text is not None:
                table.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif self.open and tag == "table":
            self.open.pop().end_row()
        elif self.open and tag == "tr":
            self.open[-1].end_row()
        elif self.open and tag in ("td", "th"):
            self.open[-1].end_cell()

    def handle_data(self, data: str) -> None:
        if self.open and not self.unseen and self.open[-1].text is not None:
            self.open[-1].text.append(data)


def span(value: str | None, most: int) -> int:
    digits = (value or "").strip()
    return min(max(int(digits), 1), most) if digits.isascii() and digits.isdigit() and len(digits) < 10 else 1


def parsed_tables(page: str | None) -> list[list[list[str]]]:
    """Rows of cells of every table of a page."""
    parser = TableParser()
    parser.feed(page or "")
    parser.close()
    for table in parser.open:
        table.end_row()
    return [t.rows for t in parser.tables]


def html_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of pages, table (from 0 on each page), rid (from 1 in each table) and cells: a row for
    each table row. Null pages and pages without tables have none."""
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType([*(pages.schema[c] for c in kept), *T._parse_datatype_string("table int, rid int, cells array<string>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(len(kept)).to_pylist()):
                rows = [(t, r, cells) for t, table in enumerate(parsed_tables(page)) for r, cells in enumerate(table, 1)]
                if rows:
                    table, rid, cells = zip(*rows, strict=True)
                    same = pa.array([i] * len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(same) for c in batch.columns[:-1]), pa.array(table, pa.int32()), pa.array(rid, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=schema.names
                    )

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`")).mapInArrow(run, schema)


def table_values(pages: DataFrame, name: str, html: str = "html") -> DataFrame:
    """value: the texts, but empty ones, below the header cell ``name`` of each page's first table whose first row has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for page in batch.column(0).to_pylist():
                for rows in parsed_tables(page):
                    if rows and name in rows[0]:
                        at = rows[0].index(name)
                        found += [r[at] for r in rows[1:] if at < len(r) and r[at]]
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    return pages.select(F.col(f"`{html}`")).mapInArrow(run, "value string")
