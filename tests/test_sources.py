"""Scans over small files of the shapes that the studies read."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from lacuna.functions import casts
from lacuna.sources import readers, workbooks


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


PRICES = "Time,Open,High,Low,Latest,Change,%Change,Volume,Open Int\n2026-01-02,400,410,395,405,5,1.25%,1K,12\n2026-01-05,405,406,400,401,-4,-0.99%,,13\n\"Downloaded from a vendor as of 01-06-2026\"\n"


def test_delimited_with_header_footer_and_mark(spark, tmp_path):
    path = write(tmp_path, one="\ufeff" + PRICES)
    assert readers.header_of(spark, path)[0] == "Time"
    out = readers.delimited(spark, path)
    dated = out.filter(casts.iso_date(F.col("Time")).isNotNull()).orderBy("Time").collect()
    assert [(r.Time, r.Latest, r["%Change"]) for r in dated] == [("2026-01-02", "405", "1.25%"), ("2026-01-05", "401", "-0.99%")]


def test_delimited_keeps_quotes_and_line_ends_in_fields(spark, tmp_path):
    path = write(tmp_path, one='name,note\n"A, ""the"" ship","two\nlines"\nB,\n')
    got = [tuple(r) for r in readers.delimited(spark, path, multi_line=True).collect()]
    assert got == [('A, "the" ship', "two\nlines"), ("B", None)]


def test_many_files_and_the_latest_one(spark, tmp_path):
    write(tmp_path, **{"is7h26_daily_2": PRICES, "is7k26_daily_1": PRICES.replace("405,5", "505,5")})
    out = readers.by_file(spark, f"{tmp_path}/is7*.csv", readers.header_of(spark, f"{tmp_path}/is7h26_daily_2.csv"), r"^(is7[a-z]\d\d)_")
    assert {(r.symbol, r.Latest) for r in out.filter("Time = '2026-01-02'").collect()} == {("IS7H26", "405"), ("IS7K26", "505")}
    last = readers.latest_snapshot(readers.delimited(spark, f"{tmp_path}/*.csv", readers.header_of(spark, f"{tmp_path}/is7h26_daily_2.csv")))
    assert {r.snapshot for r in last.collect()} == {"is7k26_daily_1.csv"}


def test_positional_columns_below_a_preamble(spark, tmp_path):
    path = write(tmp_path, one="Prices of a town\n\nnote,,\nDate,TMT,Ingot,Billet\n46000,51000,,47000\n46001, 51500 ,45000,\n")
    out = readers.positional(readers.numbered_lines(spark, path), 4, ["serial", "tmt", "ingot", "billet"]).filter("serial != ''")
    got = out.select(casts.excel_date(casts.number(F.col("serial"))).alias("d"), "tmt", "ingot").orderBy("serial").collect()
    assert [(r.d, r.tmt, r.ingot or None) for r in got] == [(dt.date(1899, 12, 30) + dt.timedelta(46000), "51000", None), (dt.date(1899, 12, 30) + dt.timedelta(46001), "51500", "45000")]


def test_wide_rows_and_quoted_line_ends(spark, tmp_path):
    wide = ",".join(f"v{i}" for i in range(30))
    path = write(tmp_path, one=f'{wide}\nx,"a, b","he said ""no""","one\ntwo",end\n')
    rows = readers.cells(readers.numbered_lines(spark, path, quoted=True)).orderBy("i").collect()
    assert rows[0].cells == wide.split(",")
    assert rows[1].cells[:5] == ["x", "a, b", 'he said "no"', "one\ntwo", "end"]
    plain = readers.cells(readers.numbered_lines(spark, path)).orderBy("i").collect()
    assert plain[2].cells[0].startswith("two") and readers.cells(readers.numbered_lines(spark, path), 3).first().cells == ["v0", "v1", "v2"]


SHEET = """Title,,
Section one: tons,,
Month,Value,Contract
2025-01,"1,200",SC1!
2025-02,1300,SC2!
Section two,,
2025-02,1400,SC1!
2025-03,7,SC1!
2025-03,8,SC2!
End of tables,,
2025-04-03,50,
2025-04-10,60,
2025-04,55,
2025-05,56,SC1!
"""


@pytest.fixture()
def sheet(spark, tmp_path):
    return readers.cells(readers.numbered_lines(spark, write(tmp_path, sheet=SHEET)))


def test_months_between_two_markers_the_last_of_a_period_wins(sheet):
    assert {r.period: r.value for r in readers.between_markers(sheet, "Section two", "End of", 1).collect()} == {"2025-02": "1400", "2025-03": "8"}


def test_months_anywhere_and_of_one_contract(sheet):
    got = [(r.period, r.month_end, r.value) for r in readers.month_rows(sheet).orderBy("i").collect()]
    assert got[0] == ("2025-01", dt.date(2025, 1, 31), "1,200") and [p for p, *_ in got] == ["2025-01", "2025-02", "2025-02", "2025-03", "2025-03", "2025-04", "2025-05"]
    assert [(r.period, r.value) for r in readers.of_contract(sheet, 2, "sc1!").orderBy("i").collect()] == [("2025-01", "1,200"), ("2025-02", "1400"), ("2025-03", "7"), ("2025-05", "56")]


def test_days_and_months_of_one_sheet(sheet):
    got = {r.month_end: r.value for r in readers.two_grains(sheet).collect()}
    assert got[dt.date(2025, 4, 30)] == "55" and got[dt.date(2025, 5, 31)] == "56"  # the month's own row stands below its days


def test_columns_by_fragments_of_their_names(spark):
    df = spark.createDataFrame([], "`Observation Date` string, `Price INR per mt` string")
    assert readers.column_like(df, "price", "INR") == "Price INR per mt"
    with pytest.raises(ValueError):
        readers.column_like(df, "volume")


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@pytest.fixture()
def book(spark, tmp_path):
    parts = {
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Prices" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {NS}><si><t>Date</t></si><si><r><t>Pri</t></r><r><t>ce</t></r><rPh><t>x</t></rPh></si></sst>",
        "xl/worksheets/sheet1.xml": f"""<worksheet {NS}><sheetData>
<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>Note</t></is></c></row>
<row r="3"><c r="A3"><v>46000</v></c><c r="B3"><f>A3*2</f><v>92000</v></c><c r="AB3" t="b"><v>1</v></c></row>
<row r="5"><c r="B5" t="e"><f>1/0</f><v>#DIV/0!</v></c><c r="D5"/></row></sheetData></worksheet>""",
        "xl/worksheets/sheet2.xml": f"<worksheet {NS}><sheetData/></worksheet>",
    }
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return workbooks.workbook(spark, str(tmp_path / "book.xlsx"))


def test_workbook_rows_ranges_and_formulas(book):
    rows = {r.i: r for r in book.collect()}
    assert sorted(rows) == [2, 3, 5] and rows[2].cells == ["Date", "Price", None, "Note"] and rows[3].cells[27] == "TRUE" and rows[5].cells[1] == "#DIV/0!"
    ranged = workbooks.sheet_range(book, "PRICES", "A2:D5")
    assert ranged.columns == ["source_file", "i", "A", "B", "C", "D"]
    table = workbooks.with_header(ranged)
    assert table.columns == ["Date", "Price", "C", "Note"] and {r.Price for r in table.collect()} == {"92000", "#DIV/0!"}
    dated = table.select(casts.excel_date(casts.number(F.col("Date"))).alias("d")).filter("d IS NOT NULL").collect()
    assert [r.d for r in dated] == [dt.date(1899, 12, 30) + dt.timedelta(46000)]
    assert {(r.cell, r.formula, r.value) for r in workbooks.formulas(book).collect()} == {("B3", "A3*2", "92000"), ("B5", "1/0", "#DIV/0!")}
    assert [(r.sheet, r.rows, r["columns"], r.filled, r.formulas) for r in workbooks.sheets(book).collect()] == [("Prices", 5, 28, 7, 2)]
    assert workbooks.sheet_named(book, "empty").count() == 0


def test_column_letters():
    for i, name in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")):
        assert workbooks.letters_of(i) == name and workbooks.column_of(name) == i


def test_letters_of_wide_formulas(spark):
    rows = spark.createDataFrame([("f", "s", 0, 7, [None] * 703, [None] * 26 + ["x"] + [None] * 674 + ["y", "z"])], workbooks.ROWS)
    assert {r.cell for r in workbooks.formulas(rows).collect()} == {"AA7", "ZZ7", "AAA7"}
