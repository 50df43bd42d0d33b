"""Workbooks out: each task streams its rows into workbooks of its own, which become visible when all tasks have ended.

A sheet holds at most ROWS rows and a cell CELL characters, as spreadsheet programs demand: longer tables become more workbooks, and a longer text is an
error, never cut. A task writes under hidden names, so one that is lost or runs twice leaves nothing that a reader sees; the commit moves the files of the tasks that count. An
empty table becomes one workbook with a header.

Numbers and truth values are cells of their kind, other values texts, nulls no cells. Characters that XML cannot hold are written as ``_xHHHH_``, a text that looks so already is marked; the reader undoes both.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isfinite

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a sheet with its header, characters of a cell.
ROWS, CELL = 1_048_576, 32_767

_ODD = re.compile(r"[\x00-\x08\x0B-\x1F￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_MARK = re.compile(r"_x([0-9A-Fa-f]{4})_")
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def escaped(text: str) -> str:
    """The text as XML that gives it back."""
    text = _ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def unescaped(text: str) -> str:
    """What is left of escaped() after XML's own references."""
    return _MARK.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def letters_of(place: int) -> str:
    """A column's letters: 0 is A, 26 is AA."""
    out, place = "", place + 1
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(ref: str, value: object, number: bool) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    text = str(value)
    if number and (isinstance(value, int) or isfinite(value)):
        return f'<c r="{ref}"><v>{text}</v></c>'
    if len(text) > CELL:
        raise ValueError(f"cell {ref} has {len(text)} characters; a workbook's cell holds {CELL}")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escaped(text)}</t></is></c>'


def _book(names: list[str], system: pf.FileSystem, path: str, rows: Iterator[str]) -> None:
    """One workbook of one sheet; parts are streamed, so memory does not grow with the rows."""
    with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/{part}" ContentType="{_KIND}.{kind}+xml"/>' for part, kind in (("xl/workbook.xml", "sheet.main"), ("xl/worksheets/sheet1.xml", "worksheet")))
        book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_LINKS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_LINKS}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{_XML}<worksheet xmlns="{_SHEET}"><sheetData><row r="1">'.encode())
            sheet.write("".join(_cell(f"{letters_of(k)}1", name, False) for k, name in enumerate(names)).encode())
            sheet.write(b"</row>")
            for row in rows:
                sheet.write(row.encode())
            sheet.write(b"</sheetData></worksheet>")


@dataclass
class Written(WriterCommitMessage):
    hidden: list[str] = field(default_factory=list)


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, most: int = ROWS):
        self.path, self.names, self.overwrite, self.most = path.rstrip("/"), [f.name for f in schema], overwrite, most
        self.letters = [letters_of(k) for k in range(len(self.names))]
        self.numbers = [f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") for f in schema]

    def _folder(self) -> tuple[pf.FileSystem, str]:
        from metaspan.sources.files import opened

        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        return system, inner

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = self._folder()
        done, held = Written(), self._lines(iterator)
        line = next(held, None)
        while line is not None:
            name = f".{uuid.uuid4().hex}.xlsx"
            first, line = line, None

            def rows() -> Iterator[str]:
                nonlocal line
                yield f'<row r="2">{self._cells(first, 2)}</row>'
                for k in range(3, self.most + 1):
                    if (own := next(held, None)) is None:
                        return
                    yield f'<row r="{k}">{self._cells(own, k)}</row>'
                line = next(held, None)

            _book(self.names, system, f"{inner}/{name}", rows())
            done.hidden.append(name)
        return done

    def _lines(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def _cells(self, line: tuple, k: int) -> str:
        return "".join([_cell(f"{c}{k}", value, number) for c, value, number in zip(self.letters, line, self.numbers)])

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = self._folder()
        before = [f for f in system.get_file_info(pf.FileSelector(inner)) if f.is_file and f.base_name.endswith(".xlsx")]
        hidden = [name for m in messages if m is not None for name in m.hidden]
        if not hidden:
            hidden = [f".{uuid.uuid4().hex}.xlsx"]
            _book(self.names, system, f"{inner}/{hidden[0]}", iter(()))
        run = uuid.uuid4().hex
        for k, name in enumerate(hidden):
            system.move(f"{inner}/{name}", f"{inner}/part-{k:05d}-{run}.xlsx")
        for file in before:  # earlier tables, if they are replaced, and what lost tasks left
            if file.base_name not in hidden and (self.overwrite or file.base_name.startswith(".")):
                system.delete_file(file.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = self._folder()
        for name in [name for m in messages if m is not None for name in m.hidden]:
            system.delete_file(f"{inner}/{name}")
