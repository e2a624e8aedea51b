"""Workbooks (.xlsx, .xlsm): a folder of them is read like a folder of CSV files.

Spark distributes the files, one per task; a small reader turns the sheet of one file into rows of
(kind, text) cells.  Inference, casts and numbering are those of the other sources.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions.names import normalize_headers
from ..operators.infer import CELL
from ..session import stage
from ..types import Field, validate_fields
from .delimited import check_file_type

# The built-in number formats that show dates, and the two day counts in use.
DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})
EPOCH_1900, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
BATCH_ROWS = 5000
ROW_SCHEMA = "file string, line long, cells array<struct<kind:string,text:string>>"


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _all(root, tag: str) -> list:
    return [e for e in root.iter() if _tag(e) == tag]


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_string(item) for item in root]


def _string(item) -> str:
    """Text of a rich or plain string, phonetic hints left out."""
    parts = []
    for child in item:
        if _tag(child) == "t":
            parts.append(child.text or "")
        elif _tag(child) == "r":
            parts += [t.text or "" for t in child if _tag(t) == "t"]
    return "".join(parts)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")) for f in _all(root, "numFmt")
        if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)
    }
    styles = next((e for e in root if _tag(e) == "cellXfs"), [])
    return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | custom}


def _active_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the active sheet inside the archive, and whether days count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = next(iter(_all(root, "workbookView")), None)
    sheets = _all(root, "sheet")
    sheet = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
    relation = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == relation)
    settings = next(iter(_all(root, "workbookPr")), None)
    uses_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    return (target[1:] if target.startswith("/") else f"xl/{target}"), uses_1904


def _place(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell(element, strings: list[str], dates: set[int], epoch: datetime.datetime) -> dict | None:
    kind = element.get("t", "n")
    if kind == "inlineStr":
        inner = next((e for e in element if _tag(e) == "is"), None)
        return {"kind": "text", "text": _string(inner)} if inner is not None else None
    raw = next((e.text for e in element if _tag(e) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return {"kind": "text", "text": strings[int(raw)]}
    if kind == "b":
        return {"kind": "boolean", "text": "true" if raw == "1" else "false"}
    if kind == "d":
        return {"kind": "datetime", "text": raw}
    if kind != "n":
        return {"kind": "text", "text": raw}
    if int(element.get("s", 0)) in dates:
        moment = epoch + datetime.timedelta(milliseconds=round(float(raw) * 86_400_000))
        if float(raw) < 1:
            return {"kind": "time", "text": moment.time().isoformat()}
        return {"kind": "datetime", "text": moment.isoformat()}
    if re.fullmatch(r"-?[0-9]+", raw):
        return {"kind": "integer", "text": raw}
    return {"kind": "decimal", "text": repr(float(raw))}


def sheet_rows(content: bytes) -> Iterator[list[dict | None]]:
    """Rows of the active sheet with cached values; rows without any value are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheet, uses_1904 = _active_sheet(book)
        strings, dates = _shared_strings(book), _date_styles(book)
        epoch = EPOCH_1904 if uses_1904 else EPOCH_1900
        with book.open(sheet) as stream:
            for _, element in ElementTree.iterparse(stream):
                if _tag(element) != "row":
                    continue
                row: list[dict | None] = []
                for cell in element:
                    place = _place(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (place + 1 - len(row))
                    row[place] = _cell(cell, strings, dates, epoch)
                element.clear()
                if any(c is not None for c in row):
                    yield row


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            pending: list[tuple] = []
            for line, row in enumerate(sheet_rows(content)):
                pending.append((path, line, row))
                if len(pending) == BATCH_ROWS:
                    yield pd.DataFrame(pending, columns=["file", "line", "cells"])
                    pending = []
            if pending:
                yield pd.DataFrame(pending, columns=["file", "line", "cells"])


def read_workbooks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Workbooks that share one header, as (kind, text) cell columns in file order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    names = files.inputFiles()
    if not names:
        raise WorkspaceError("empty_file", "No files to read")
    for name in names:
        check_file_type(name)
    # files are small and slow to parse: one task each, whatever their size
    return parse_workbooks(files.repartitionByRange(len(names), "path"))


def parse_workbooks(files: DataFrame) -> DataFrame:
    """The same for workbooks given as rows of (path, content).

    The result is staged, hence a plain file scan that ``plans.imports.scan`` takes.
    """
    lines = stage(files.select("path", "content").mapInPandas(_read_batches, ROW_SCHEMA), "workbooks")
    headers = lines.filter("line = 0").select("file", F.col("cells.text").alias("header"))
    kinds = headers.groupBy("header").agg(F.min("file").alias("file")).limit(2).collect()
    if not kinds:
        raise WorkspaceError("empty_file", "The workbooks have no rows")
    if len(kinds) > 1:
        raise WorkspaceError("workbook_header_mismatch", "The workbooks do not share one header")
    fields = normalize_headers(kinds[0]["header"])
    validate_fields([Field(n, "text") for n in fields])
    body = lines.filter("line > 0").orderBy("file", "line")
    return stage(body.select(*[F.get("cells", F.lit(i)).cast(CELL).alias(n) for i, n in enumerate(fields)]), "workbook-rows")
