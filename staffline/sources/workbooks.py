"""Workbook folder source (S1, S3): every ``.xlsx`` under a folder → rows per sheet.

``binaryFile`` lists and reads the files (one file per row, so a folder of workbooks spreads
over the cluster); ``mapInPandas`` opens each file with the standard library (an .xlsx is a zip
of XML parts) and emits one row per sheet row: (path, sheet, row_no, cells, error) where
``cells`` maps the trimmed, lower-cased header of the sheet's first row to the cell text.
Dates stored as Excel serial numbers in date-formatted cells come out as 'yyyy-MM-dd HH:mm:ss'.
A file that cannot be read gives one row with ``error`` set instead of failing the job.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HEADER_NAMES, SHEET_NAMES, TABLE_SCHEMAS, conform

OUT_SCHEMA = "path string, sheet string, row_no int, cells map<string,string>, error string"

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
# Built-in number formats that show dates (ECMA-376 part 1, 18.8.30).
_DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
_EPOCH = dt.datetime(1899, 12, 30)


def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for nf in root.iterfind("m:numFmts/m:numFmt", _NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dy]|m{1,2}(?![a-z])", code)) and "h" not in code[:1]
    out = []
    for xf in root.iterfind("m:cellXfs/m:xf", _NS):
        fid = int(xf.get("numFmtId", "0"))
        out.append(fid in _DATE_FORMAT_IDS or custom.get(fid, False))
    return out


def _serial_to_text(v: str) -> str:
    d = _EPOCH + dt.timedelta(days=float(v))
    return d.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")


def parse_workbook(path: str, content: bytes):
    """Yield (path, sheet, row_no, cells, error) for every data row of every sheet."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
    dates = _date_styles(z)
    rels = {r.get("Id"): r.get("Target") for r in
            ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_PKG_REL)}
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    for sh in wb.iterfind("m:sheets/m:sheet", _NS):
        target = rels[sh.get(_REL)].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        root = ET.fromstring(z.read(part))
        header: dict[int, str] = {}
        for i, row in enumerate(root.iterfind("m:sheetData/m:row", _NS)):
            values: dict[int, str] = {}
            for c in row.iterfind("m:c", _NS):
                t, s, ref = c.get("t"), c.get("s"), c.get("r")
                v = c.find("m:v", _NS)
                if t == "inlineStr":
                    val = _text(c)
                elif v is None:
                    continue
                elif t == "s":
                    val = shared[int(v.text)]
                elif t in ("str", "e"):
                    val = v.text or ""
                elif t == "b":
                    val = "TRUE" if v.text == "1" else "FALSE"
                elif s is not None and int(s) < len(dates) and dates[int(s)]:
                    val = _serial_to_text(v.text)
                else:
                    val = v.text
                values[_col_index(ref)] = val
            if i == 0:
                header = {k: v.strip().lower() for k, v in values.items() if v is not None and v.strip()}
                continue
            cells = {h: values.get(k) for k, h in header.items()}  # every header, blank cells as null
            if any(v is not None for v in cells.values()):
                yield (path, sh.get("name"), i, cells, None)


def _parse_batches(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                out.extend(parse_workbook(path, bytes(content)))
            except Exception as ex:  # noqa: BLE001 - a broken file is reported, not fatal
                out.append((path, None, None, None, f"{type(ex).__name__}: {ex}"))
        yield pd.DataFrame(out, columns=["path", "sheet", "row_no", "cells", "error"])


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """All sheet rows of every .xlsx under ``folder`` (S3: other files are not read)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", "true").load(folder).select("path", "content"))
    return files.mapInPandas(_parse_batches, OUT_SCHEMA)


def workbook_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull()).select("path", "error")


def sheet_table(rows: DataFrame, table: str, keep_path: bool = False) -> DataFrame:
    """One of our tables (company / staff / reviews) from the workbook rows: the reference sheet
    name selects the rows, headers map to our column names, values are conformed to the table
    schema (text dates coerced, ids cast). A missing sheet gives an empty table. Reviews get
    ``seq`` = the row number in the sheet (input order decides ties)."""
    from ..schema import STAFF_OPTIONAL

    sheets = [k for k, v in SHEET_NAMES.items() if v == table]
    r = rows.where(F.col("error").isNull() & F.lower(F.trim("sheet")).isin(sheets))
    schema = TABLE_SCHEMAS[table]
    optional = STAFF_OPTIONAL if table == "staff" else None

    def cell(name: str):
        heads = [h for h, ours in HEADER_NAMES.items() if ours == name] + [name]
        return F.coalesce(*[F.col("cells").getItem(h) for h in heads]).alias(name)

    cols = [F.col("row_no").cast("long").alias("seq") if f.name == "seq" else cell(f.name) for f in schema.fields]
    for f in (optional.fields if optional else []):
        if f.name == "has_exit_type":  # whether the row's own sheet has the header
            heads = [h for h, ours in HEADER_NAMES.items() if ours == "exit_type"] + ["exit_type"]
            cols.append(F.arrays_overlap(F.map_keys("cells"), F.array(*[F.lit(h) for h in heads])).alias(f.name))
        else:
            cols.append(cell(f.name))
    if keep_path:  # which workbook (upload) each row came from
        return conform(r.select(*cols, "path"), schema, optional, keep=("path",))
    return conform(r.select(*cols), schema, optional)
