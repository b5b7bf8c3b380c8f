"""Workbooks (xlsx and xls): rows of cells from files that Spark lists and reads, and xlsx back.

A workbook is one file of bounded size, so a task parses it whole; many workbooks are many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .xls import SIGNATURE, parsed_xls

#: Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ROWS = "path string, rid long, cells array<string>"


def column_index(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    out = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def parsed(content: bytes, sheet: int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """Row number and cells, as text, of a sheet's rows; cells that are not there are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"))
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheets[sheet].get(f"{LINKS}id")]
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        number = 0
        for _, row in ElementTree.iterparse(book.open(name)):
            if row.tag != f"{MAIN}row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for cell in row.iter(f"{MAIN}c"):
                at = column_index(cell.get("r", "")) if cell.get("r") else len(cells)
                kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                text = texts(cell) if kind == "inlineStr" else value.text if value is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                cells += [None] * (at - len(cells)) + [text]
            yield number, cells
            row.clear()


def workbook_rows(files: DataFrame, sheet: int = 0) -> DataFrame:
    """path, rid, cells of the rows of workbooks given as path and content, as Spark's binaryFile source
    lists them. What a file is, xls or xlsx, is told by its first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = list((parsed_xls if content[:8] == SIGNATURE else parsed)(content, sheet))
                numbers, cells = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["path", "rid", "cells"]
                )

    return files.select("path", "content").mapInArrow(run, ROWS)


def read_workbooks(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """path, rid, cells of all workbooks at path, a file, folder or pattern."""
    return workbook_rows(spark.read.format("binaryFile").load(path), sheet)


def with_header(rows: DataFrame) -> DataFrame:
    """Named string columns of one sheet's rows (rid, cells): the first row has the names.

    The header row alone is read at once, as a plan needs its column names. Rows of several files are
    an error, as their columns may stand in another order."""
    if "path" in rows.columns and rows.select("path").distinct().limit(2).count() > 1:
        raise ValueError("the rows are of more than one workbook")
    first = rows.where(F.size("cells") > 0).orderBy("rid").select("rid", "cells").first()
    names = [(i, c) for i, c in enumerate(first.cells if first else []) if c is not None]
    below = rows.where(F.col("rid") > (first.rid if first else 0))
    return below.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in names])


def serial_date(value: Column) -> Column:
    """A date from a workbook's day number, or from ISO text."""
    days = value.try_cast("double")
    return F.when(days.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(days).cast("int"))).otherwise(value.try_cast("date"))


def sheet_bytes(rows: list[list[str | float | None]]) -> bytes:
    """A workbook of one sheet: numbers as such, all else as text in the cells."""

    def cell(x: str | float | None) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, (int, float)):
            return f"<c><v>{x!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'

    body = "".join(f'<row r="{i}">{"".join(map(cell, row))}</row>' for i, row in enumerate(rows, 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKS[1:-1]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def as_workbooks(rows: DataFrame) -> DataFrame:
    """path, content: a workbook for each path of rows (path, rid, cells); cells that read as numbers are such."""

    def run(table: pa.Table) -> pa.Table:
        def typed(x: str | None) -> str | float | None:
            return float(x) if x is not None and re.fullmatch(r"-?\d+(\.\d+)?", x) else x

        ordered = table.sort_by("rid")
        cells: list[list] = []
        for rid, row in zip(ordered.column("rid").to_pylist(), ordered.column("cells").to_pylist(), strict=True):
            cells += [[]] * (rid - 1 - len(cells)) + [[typed(x) for x in row]]
        return pa.table({"path": [ordered.column("path")[0].as_py()], "content": pa.array([sheet_bytes(cells)], pa.binary())})

    return rows.groupBy("path").applyInArrow(run, "path string, content binary")
