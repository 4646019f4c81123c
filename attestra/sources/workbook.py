"""Workbooks (xlsx) as a Python data source: a zip of XML, read without other libraries."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: What a file that is no workbook raises.
BadBook = (zipfile.BadZipFile, ElementTree.ParseError)


def sheets(path: str | BinaryIO) -> list[tuple[str, str]]:
    """(name, part of the archive) of each sheet in order."""
    with zipfile.ZipFile(path) as book:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")
        return [(s.get("name"), "xl/" + targets[s.get(_REL)].lstrip("/").removeprefix("xl/")) for s in found]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(path: str | BinaryIO, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet (the first by default) as texts; empty cells are null."""
    parts = dict(sheets(path))
    part = parts[sheet] if sheet else next(iter(parts.values()))
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        with book.open(part) as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for cell in row:
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    value = cell.find(f"{_NS}v")
                    if cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield out
                row.clear()


class Workbook(DataSource):
    """format("attestra_workbook"), option sheet; all columns are strings named by the first row."""

    @classmethod
    def name(cls) -> str:
        return "attestra_workbook"

    def schema(self) -> StructType:
        head = next(rows(self.options["path"], self.options.get("sheet")), [])
        return StructType([StructField(h if h else f"column_{i}", StringType()) for i, h in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet"), len(schema))


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a zipped sheet is one stream

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        body = rows(self.path, self.sheet)
        next(body, None)
        for r in body:
            yield tuple((r + [None] * self.width)[: self.width])
