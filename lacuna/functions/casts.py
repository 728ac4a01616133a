"""Lenient parsing of text columns. What does not parse is NULL; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delivery-month letters of futures contracts, January to December (fixed values).
MONTH_LETTERS = "FGHJKMNQUVXZ"


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def number(text: Column, drop: str = "[,%\\s]") -> Column:
    """A double from text with thousands commas, percent signs and spaces."""
    return no_nan(F.regexp_replace(text, drop, "").try_cast("double"))


def magnitude(text: Column) -> Column:
    """12.5K, 3M and 1B as numbers; plain numbers as they are."""
    plain = F.upper(F.regexp_replace(text, "[,\\s]", ""))
    unit = F.regexp_extract(plain, "([KMB])$", 1)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return no_nan(F.regexp_replace(plain, "[KMB]$", "").try_cast("double")) * scale


def iso_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def day_first(text: Column) -> Column:
    """16-Apr-2026."""
    return F.try_to_date(text, "d-MMM-yyyy")


def excel_date(serial: Column) -> Column:
    """A spreadsheet's day number; day 0 is 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.round(serial).cast("int"))


def any_date(text: Column) -> Column:
    """ISO, US month/day/year, or a day number between 20000 and 80000."""
    serial = text.try_cast("double")
    return F.coalesce(iso_date(F.substring(text, 1, 10)), F.try_to_date(text, "M/d/yyyy"), F.when(serial.between(20000, 80000), excel_date(serial)))


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def key(text: Column) -> Column:
    return F.upper(F.trim(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def contract(symbol: Column, root: str) -> Column:
    """(month, year, serial) of root + month letter + two digits of the year; serial counts months."""
    letter = F.regexp_extract(symbol, f"^{root}([{MONTH_LETTERS}])(\\d{{2}})$", 1)
    year = F.regexp_extract(symbol, f"^{root}([{MONTH_LETTERS}])(\\d{{2}})$", 2)
    month = F.when(letter != "", F.call_function("instr", F.lit(MONTH_LETTERS), letter).cast("int"))
    full = F.when(year != "", 2000 + year.try_cast("int"))
    return F.struct(month.alias("month"), full.alias("year"), (full * 12 + month - 1).alias("serial"))


def kind(text: Column) -> Column:
    """null, bool, int, float or text: what a cell looks like."""
    x = F.trim(text)
    return (
        F.when(F.coalesce(x, F.lit("")) == "", "null")
        .when(F.lower(x).isin("true", "false"), "bool")
        .when(x.rlike(r"^[+-]?\d+$"), "int")
        .when(x.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float")
        .otherwise("text")
    )


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def months_apart(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
