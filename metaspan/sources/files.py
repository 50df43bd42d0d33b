"""Data sources for files that Spark has no reader for: flat files of several encodings, and workbooks.

``flat_files`` reads byte ranges. A file's head tells its columns and which encodings it can be in; each range is decoded strictly by the first of them
that fits, so every byte is read once and checked while it is decoded, and no range depends on another. Line ends are single
bytes in all supported encodings, so a range begins after the first line end at or behind its start, as usual. Values that hold line ends are not for this source.

``workbook`` streams the rows of a sheet out of the zipped parts, a sheet to a task, and writes as ``sheets`` says. Cells are text: shared and inline strings, numbers as written, TRUE and FALSE.

Files are found and opened by pyarrow.fs, on driver and executors alike, so paths are those of a store that both can reach.
"""

from __future__ import annotations

import codecs
import csv
import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as pf
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from metaspan.sources import sheets

#: Encodings in the order in which they are tried, as Python names them.
ENCODINGS = ("utf-8", "cp949", "euc-kr")
#: Bytes of a file that tell its columns and possible encodings, of a range, and of text that is parsed at once.
HEAD, RANGE, BLOCK = 1 << 16, 32 << 20, 4 << 20
#: Rows of a workbook's batch.
ROWS = 4096


def opened(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (pf.LocalFileSystem(), path)


def found(path: str, suffix: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder (not of those below it) that end so."""
    system, inner = opened(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == pf.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else [f for f in system.get_file_info(pf.FileSelector(inner)) if f.is_file and fnmatch.fnmatchcase(f.base_name, f"*{suffix}") and not f.base_name.startswith((".", "_"))]
    return sorted((head + f.path, f.size) for f in files)


def possible(head: bytes, whole: bool) -> list[str]:
    """Encodings that the head decodes in; a character that the head's end cuts does not count."""
    out = []
    for name in ENCODINGS:
        try:
            codecs.getincrementaldecoder(name)().decode(head, final=whole)
        except UnicodeDecodeError:
            continue
        out.append(name)
    return out


def decoded(content: bytes, names: list[str], path: str) -> str:
    """The text in the first encoding that fits."""
    for name in names:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path} is in none of the encodings {', '.join(names)}")


def header_of(text: str, separator: str) -> list[str]:
    """Column names without byte-order mark and outer blanks; a blank one goes by its place."""
    line = next(csv.reader(io.StringIO(text.split("\n", 1)[0].removesuffix("\r")), delimiter=separator), [])
    return named(line)


def named(line: list[str | None]) -> list[str]:
    """Names of columns from a header's cells: clean, none blank, none twice."""
    out: dict[str, None] = {}
    for k, cell in enumerate(line):
        name = again = (cell or "").replace("﻿", "").strip() or f"_c{k}"
        n = 1
        while again in out:
            again, n = f"{name}_{n}", n + 1
        out[again] = None
    return [*out]


def parsed(text: str, columns: list[str], separator: str, nulls: list[str], skip_bad: bool) -> pa.Table:
    """Lines as text columns: short ones are filled with nulls and long ones cut, unless bad lines are skipped."""
    bad = []

    def handler(row: pc.InvalidRow) -> str:
        bad.append(row)
        return "skip"

    content = text.encode()
    read = pc.ReadOptions(column_names=columns, block_size=len(content) + 1, use_threads=False)
    parse = pc.ParseOptions(delimiter=separator, invalid_row_handler=handler)
    convert = pc.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), null_values=nulls, strings_can_be_null=True)
    table = pc.read_csv(io.BytesIO(content), read, parse, convert)
    if not bad or skip_bad:
        return table
    none, width = set(nulls), len(columns)
    rows = [[None if v in none else v for v in (row + [""] * width)[:width]] for row in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if row]
    return pa.table({c: pa.array(column, pa.string()) for c, column in zip(columns, zip(*rows))})


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    columns: list[str]
    encodings: list[str]


class FlatFiles(DataSource):
    """Options: path, suffix, separator, nulls (texts that are null, between line ends), skip_bad."""

    @classmethod
    def name(cls) -> str:
        return "flat_files"

    def schema(self) -> StructType:
        names = list(dict.fromkeys(c for file in self.files() for c in file.columns))
        return StructType([StructField(c, StringType()) for c in [*names, "file_path", "file_name"]])

    def reader(self, schema: StructType) -> FlatFileReader:
        return FlatFileReader(schema, self.files(), dict(self.options))

    def files(self) -> list[Range]:
        if not hasattr(self, "_files"):
            self._files = []
            for path, size in found(self.options["path"], self.options.get("suffix", "")):
                system, inner = opened(path)
                with system.open_input_file(inner) as file:
                    head = file.read(HEAD)
                names = possible(head, len(head) == size)
                if not names:
                    raise ValueError(f"{path} is in none of the encodings {', '.join(ENCODINGS)}")
                text = codecs.getincrementaldecoder(names[0])().decode(head)
                self._files.append(Range(path, 0, size, header_of(text, self.options.get("separator", ",")) if head else [], names))
            if not self._files:
                raise FileNotFoundError(f"{self.options['path']} holds no file *{self.options.get('suffix', '')}")
        return self._files


class FlatFileReader(DataSourceReader):
    def __init__(self, schema: StructType, files: list[Range], options: dict[str, str]):
        self.names, self.files, self.options = [f.name for f in schema], files, options

    def partitions(self) -> list[Range]:
        size = int(self.options.get("range", RANGE))
        return [Range(f.path, at, min(at + size, f.end), f.columns, f.encodings) for f in self.files if f.columns for at in range(0, f.end, size)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        separator, nulls, skip = self.options.get("separator", ","), self.options.get("nulls", "").split("\n"), self.options.get("skip_bad", "false") == "true"
        system, inner = opened(part.path)
        with system.open_input_file(inner) as file:
            for block in _lines(file, part.start, part.end):
                text = decoded(block, part.encodings, part.path)
                if text.strip("\r\n"):
                    table = parsed(text, part.columns, separator, nulls, skip)
                    yield from self._batches(table, part)

    def _batches(self, table: pa.Table, part: Range) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        fixed = {"file_path": part.path, "file_name": part.path.rsplit("/", 1)[-1]}
        columns = [pa.array([fixed[c]] * n, pa.string()) if c in fixed else table[c] if c in part.columns else pa.nulls(n, pa.string()) for c in self.names]
        yield from pa.table(columns, names=self.names).to_batches()


def _lines(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Whole lines that begin in [start, end), but not the file's first, in blocks."""
    at = max(start - 1, 0)
    file.seek(at)
    held, dropped = b"", False  # what precedes the first line end belongs to the range before; in the first range it is the header
    while True:
        more = file.read(BLOCK)
        content = held + more
        if not dropped:
            cut = content.find(b"\n")
            if cut < 0:
                if not more:
                    return
                at, held = at + len(content), b""
                if at >= end:
                    return
                continue
            content, at, dropped = content[cut + 1 :], at + cut + 1, True
        if at >= end:
            return
        last = content.rfind(b"\n") + 1 if more else len(content)
        if at + last > end:  # the last line that begins in the range ends at the first line end from its last byte on
            stop = content.find(b"\n", max(end - at - 1, 0))
            if stop >= 0:
                yield content[: stop + 1]
                return
        if last:
            yield content[:last]
        held, at = content[last:], at + last
        if not more:
            return


@dataclass
class Sheet(InputPartition):
    path: str
    part: str


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_CELL, _VALUE = f"{_MAIN}c", f"{_MAIN}v"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _texts(element: ElementTree.Element) -> str:
    """The text of a string item, without phonetic hints."""
    found = [t.text or "" for child in element for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else [])]
    return sheets.unescaped("".join(found))


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    """The rows of a sheet, streamed; shared strings are read once and looked up."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as file:
            for _, element in ElementTree.iterparse(file):
                if element.tag == f"{_MAIN}si":
                    shared.append(_texts(element))
                    element.clear()
    with book.open(part) as file:
        root, due = None, 1
        places: dict[str, int] = {}
        for event, element in ElementTree.iterparse(file, ("start", "end")):
            if root is None:
                root = element
            if event == "end" and element.tag == f"{_MAIN}row":
                row: list[str | None] = []
                for cell in element.iterfind(_CELL):
                    letters = cell.get("r", "").rstrip("0123456789")
                    if letters not in places:
                        places[letters] = reduce(lambda place, c: 26 * place + ord(c) - 64, letters, 0)
                    row += [None] * (places[letters] - 1 - len(row))
                    kind, value = cell.get("t", "n"), cell.find(_VALUE)
                    text = None if value is None else value.text
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        inline = cell.find(f"{_MAIN}is")
                        text = None if inline is None else _texts(inline)
                    elif kind == "b" and text is not None:
                        text = "TRUE" if text == "1" else "FALSE"
                    row.append(text)
                number = int(element.get("r", due))
                yield from ([] for _ in range(number - due))  # rows that the file leaves out
                due = number + 1
                yield row
                element.clear()
                for child in root:
                    if child.tag == f"{_MAIN}sheetData":
                        child.clear()  # rows that have been read


def sheets_of(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of sheets and the parts that hold them, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(_LINK)]
        out[sheet.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


class Workbook(DataSource):
    """Options: path (a file, or a folder of workbooks with equal columns), sheet (a name; the first one without it), suffix, nulls; to write: path (a folder), rows (of a sheet, at most)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        names: dict[str, None] = {}
        for sheet in self.sheets():
            names |= dict.fromkeys(_header(sheet))
        return StructType([StructField(c, StringType()) for c in names])

    def sheets(self) -> list[Sheet]:
        out = []
        for path, _ in found(self.options["path"], self.options.get("suffix", ".xlsx")):
            system, inner = opened(path)
            with system.open_input_file(inner) as file, zipfile.ZipFile(file) as book:
                parts = sheets_of(book)
                out.append(Sheet(path, parts[self.options["sheet"]] if "sheet" in self.options else next(iter(parts.values()))))
        return out

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.sheets(), dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> sheets.WorkbookWriter:
        return sheets.WorkbookWriter(self.options["path"], schema, overwrite, int(self.options.get("rows", sheets.ROWS)))


def _header(sheet: Sheet) -> list[str]:
    system, inner = opened(sheet.path)
    with system.open_input_file(inner) as file, zipfile.ZipFile(file) as book:
        return named(next(sheet_rows(book, sheet.part), []))


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, sheets: list[Sheet], options: dict[str, str]):
        self.names, self.sheets, self.options = [f.name for f in schema], sheets, options

    def partitions(self) -> list[Sheet]:
        return self.sheets

    def read(self, part: Sheet) -> Iterator[pa.RecordBatch]:
        nulls = {*self.options.get("nulls", "").split("\n")}
        system, inner = opened(part.path)
        with system.open_input_file(inner) as file, zipfile.ZipFile(file) as book:
            rows = sheet_rows(book, part.part)
            header = {c: k for k, c in reversed([*enumerate(named(next(rows, [])))])}
            places = [header.get(c) for c in self.names]
            while some := list(islice(rows, ROWS)):
                cell = lambda row, k: None if k is None or k >= len(row) or row[k] in nulls else row[k]
                yield pa.RecordBatch.from_arrays([pa.array([cell(row, k) for row in some], pa.string()) for k in places], names=self.names)
