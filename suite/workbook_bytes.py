"""Makes small workbooks out of table rows, so that the workbook scan has files to read."""

from __future__ import annotations

import datetime
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, datetime.datetime):
        days = (value - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
        return f'<c s="1"><v>{days!r}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(rows: list[list]) -> bytes:
    body = "".join("<row>" + "".join(_cell(v) for v in row) + "</row>" for row in rows)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml", STYLES)
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    return buffer.getvalue()


def group_workbook(frame: pd.DataFrame) -> pd.DataFrame:
    """One workbook per (bounded) group of rows; the group number is its name."""
    group = int(frame["book"].iloc[0])
    data = frame.drop(columns=["book"]).sort_values(frame.columns[1])
    plain = [[None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in row] for row in data.astype(object).values.tolist()]
    return pd.DataFrame({"path": [f"book-{group:09d}.xlsx"], "content": [workbook([list(data.columns), *plain])]})
