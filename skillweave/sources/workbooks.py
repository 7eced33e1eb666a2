"""Workbooks (zipped XML) as rows, with the standard library: shared and inline strings, dates by cell style, blank cells.

Files are read by Spark's binary source, from any store that Spark reads, one workbook a row; sheets are streamed element by
element. What a cell shows leaves as text: whole numbers without a fraction, dates and times in ISO form, true and false;
errors and blanks are null. Blank rows are skipped, as in delimited text.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: number formats that show a date or a time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_ROWS = "file string, sheet string, row long, names array<string>, cells array<string>"
#: Rows that leave a task at once.
BATCH = 2000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ET.Element) -> str:
    """The runs of a string, without phonetic notes."""
    out = []
    for x in node:
        if _local(x.tag) == "t":
            out.append(x.text or "")
        elif _local(x.tag) == "r":
            out.append(_text(x))
    return "".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _is_date(code: str) -> bool:
    """Whether a format code shows a date or a time: a date letter outside quotes, escapes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.|\*.', "", code, flags=re.I).split(";")[0]
    return bool(re.search(r"[ymdhs]", bare, re.I)) and "general" not in bare.lower()


class Workbook:
    """Sheets and styles of one workbook; rows are read on demand."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        part = lambda p: ET.fromstring(self.zip.read(p)) if p in names else None
        book, links = part("xl/workbook.xml"), part("xl/_rels/workbook.xml.rels")
        targets = {x.get("Id"): x.get("Target") for x in links} if links is not None else {}
        self.sheets: list[tuple[str, str]] = []
        self.start = datetime(1899, 12, 30)
        for x in book.iter():
            if _local(x.tag) == "sheet":
                link = next(v for k, v in x.attrib.items() if _local(k) == "id")
                target = targets[link]
                self.sheets.append((x.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
            elif _local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true"):
                self.start = datetime(1904, 1, 1)
        shared, styles = part("xl/sharedStrings.xml"), part("xl/styles.xml")
        self.shared = [_text(x) for x in shared if _local(x.tag) == "si"] if shared is not None else []
        codes: dict[int, str] = {}
        self.dates: list[bool] = []
        for group in styles if styles is not None else []:
            if _local(group.tag) == "numFmts":
                codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in group}
            elif _local(group.tag) == "cellXfs":
                ids = [int(x.get("numFmtId", 0)) for x in group]
                self.dates = [i in _DATE_FORMATS or i in codes and _is_date(codes[i]) for i in ids]

    def _shown(self, cell: ET.Element) -> str | None:
        kind, value = cell.get("t", "n"), next((x for x in cell if _local(x.tag) == "v"), None)
        if kind == "inlineStr":
            inside = next((x for x in cell if _local(x.tag) == "is"), None)
            return None if inside is None else _text(inside)
        raw = None if value is None else value.text
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return "true" if raw.strip() == "1" else "false"
        if kind in ("str", "d"):
            return raw
        style = int(cell.get("s", 0))
        number = float(raw)
        if style < len(self.dates) and self.dates[style]:
            at = self.start + timedelta(days=number)
            at = (at + timedelta(microseconds=500_000)).replace(microsecond=0)
            if number < 1:
                return at.strftime("%H:%M:%S")
            return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, path: str) -> Iterator[list[str | None]]:
        """The rows of a sheet that hold anything, each as long as its last cell."""
        with self.zip.open(path) as stream:
            data = None
            for event, node in ET.iterparse(stream, ("start", "end")):
                name = _local(node.tag)
                if event == "start":
                    data = node if name == "sheetData" else data
                    continue
                if name != "row":
                    continue
                cells: list[str | None] = []
                for cell in node:
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = self._shown(cell)
                if any(c not in (None, "") for c in cells):
                    yield cells
                if data is not None:
                    data.clear()


def header(cells: list[str | None]) -> list[str]:
    """Column names: blanks are named by their place, repeated names numbered."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name, n = c or f"Unnamed: {i}", 0
        while (name if not n else f"{name}.{n}") in out:
            n += 1
        out.append(name if not n else f"{name}.{n}")
    return out


def sheet_rows(spark: SparkSession, path: str | list[str], sheet: str | None = None) -> DataFrame:
    """(file, sheet, row, names, cells): the rows of one sheet of every workbook at the path, the first sheet unless named.

    row 0 is the header and has names only; the others have as many cells as there are names, null where a cell is blank.
    A workbook without the sheet gives no rows.
    """

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                book = Workbook(data)
                for name, part in [x for x in book.sheets if sheet is None or x[0] == sheet][:1]:
                    names: list[str] | None = None
                    out = []
                    for n, cells in enumerate(book.rows(part)):
                        if names is None:
                            names = header(cells)
                            out.append((file, name, 0, names, None))
                        else:
                            out.append((file, name, n, None, [c or None for c in (cells + [None] * len(names))[: len(names)]]))
                        if len(out) == BATCH:
                            yield _batch(out)
                            out = []
                    yield _batch(out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    texts = pa.list_(pa.string())
    kinds = [pa.string(), pa.string(), pa.int64(), texts, texts]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _ROWS.split(", ")])


def read_workbook(spark: SparkSession, path: str | list[str], schema: str | None = None, sheet: str | None = None) -> DataFrame:
    """The rows of one sheet of every workbook at the path as columns by the header's names.

    Without a schema all columns are text: the names of the workbooks together, in the order of the first (by file) that
    has them. With one, its columns are taken by name and cast; null where a workbook lacks them. Workbooks without rows
    give none.
    """
    rows = sheet_rows(spark, path, sheet)
    heads = rows.filter("row = 0").select("file", "names")
    if schema is None:
        found = [n for r in heads.groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect() for n in r.names]
        fields = [T.StructField(n, T.StringType()) for n in dict.fromkeys(found)]
    else:
        fields = T._parse_datatype_string(schema).fields
    cells = rows.filter("row > 0").select("file", "cells").join(heads, "file").select(F.map_from_arrays("names", "cells").alias("m"))
    return cells.select(*[F.try_element_at("m", F.lit(f.name)).cast(f.dataType).alias(f.name) for f in fields])
