"""Spreadsheet workbooks (Office Open XML) as tables: every row of every sheet, ranges, formulas.

A workbook is a zip of small XML parts and read whole by one task; many workbooks are read
side by side. Values come as text, dates as their serial numbers (see casts.excel_date).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"

ROWS = "source_file string, sheet string, place int, i int, cells array<string>, formulas array<string>"
REFERENCE = re.compile(r"\$?([A-Za-z]+)\$?(\d+)")


def column_of(letters: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def letters_of(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _texts(node) -> str:
    """The runs of a string item; phonetic guides are no part of it."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


def rows_of(content: bytes) -> Iterator[tuple[str, int, int, list[str | None], list[str | None]]]:
    """Sheet, its place, row number, values and formulas of each row that the file holds."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(REL)}
        for place, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
            target = targets[sheet.get(LINK)]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            number = 0
            for _, row in ElementTree.iterparse(z.open(path)):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                formulas: list[str | None] = []
                for cell in row.findall(f"{MAIN}c"):
                    found = REFERENCE.fullmatch(cell.get("r") or "")
                    at = column_of(found[1]) if found else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    formulas += [None] * (at + 1 - len(formulas))
                    value, formula, inline = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}f"), cell.find(f"{MAIN}is")
                    kind = cell.get("t")
                    if inline is not None:
                        cells[at] = _texts(inline)
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value.text, value.text) if kind == "b" else value.text
                    if formula is not None:
                        formulas[at] = formula.text or ""
                yield sheet.get("name"), place, number, cells, formulas
                row.clear()


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """source_file, sheet, place (of the sheet), i (row number from 1), cells and formulas of every row of every sheet."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("source_file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["source_file", "sheet", "place", "i", "cells", "formulas"]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple] = []
                for row in rows_of(content.as_py()):
                    held.append((name, *row))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, ROWS)


def sheet_named(rows: DataFrame, name: str) -> DataFrame:
    """Rows of the sheets with a name, whatever its case."""
    return rows.filter(F.lower("sheet") == name.lower())


def sheet_range(rows: DataFrame, name: str, reference: str) -> DataFrame:
    """source_file, i and one text column for each column letter of a range such as A1:N607; rows that the file leaves out are none."""
    (left, top), (right, bottom) = (REFERENCE.fullmatch(x).groups() for x in reference.split(":"))
    lo, hi = column_of(left), column_of(right)
    some = sheet_named(rows, name).filter(F.col("i").between(int(top), int(bottom)))
    return some.select("source_file", "i", *[F.get("cells", F.lit(c)).alias(letters_of(c)) for c in range(lo, hi + 1)])


def with_header(ranged: DataFrame) -> DataFrame:
    """A range of one workbook, its first row taken as names (text columns)."""
    first = ranged.orderBy("i").first()
    letters = [c for c in ranged.columns if c not in ("source_file", "i")]
    named = {c: (first[c] or c).strip() for c in letters}
    return ranged.filter(F.col("i") > first["i"]).select(*[F.col(c).alias(named[c]) for c in letters])


def formulas(rows: DataFrame) -> DataFrame:
    """source_file, sheet, cell (as B7), formula and its stored value."""
    each = rows.select("source_file", "sheet", "i", "cells", F.posexplode("formulas").alias("c", "formula")).filter("formula IS NOT NULL")
    a, b, c = F.floor((F.col("c") - 26) / 676), F.floor((F.col("c") - 26) / 26) % 26, F.col("c") % 26
    letter = F.concat(F.when(F.col("c") >= 702, F.char(64 + a)).otherwise(""), F.when(F.col("c") >= 26, F.char(65 + b)).otherwise(""), F.char(65 + c))
    return each.select("source_file", "sheet", F.concat(letter, F.col("i").cast("string")).alias("cell"), "formula", F.get("cells", F.col("c")).alias("value"))


def sheets(rows: DataFrame) -> DataFrame:
    """A line for each sheet: its place, last row, widest row, filled cells and formulas."""
    filled = F.size(F.filter("cells", lambda x: x.isNotNull()))
    made = F.size(F.filter("formulas", lambda x: x.isNotNull()))
    return rows.groupBy("source_file", "sheet", "place").agg(F.max("i").alias("rows"), F.max(F.size("cells")).alias("columns"), F.sum(filled).alias("filled"), F.sum(made).alias("formulas"))
