"""Scans. Everything is read as text under an explicit schema and cast by lacuna.functions.casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of the first file."""
    return [c.lstrip("﻿") for c in spark.read.option("header", True).option("multiLine", True).csv(path).columns]


def delimited(spark: SparkSession, path: str, names: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV with a header, all text. Quotes are doubled inside quotes; a byte order mark is dropped."""
    names = names or header_of(spark, path)
    return spark.read.schema(strings(names)).option("header", True).option("enforceSchema", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def of_contract(rows: DataFrame, column: int, contract: str, value: int = 1) -> DataFrame:
    """Rows of months whose cell in a column names the contract: period, month_end and value."""
    return month_rows(rows.filter(F.upper(F.col("cells")[column]) == contract.upper()), value)


def by_file(spark: SparkSession, path: str, names: Sequence[str], pattern: str) -> DataFrame:
    """Many CSVs as one table with source_file and symbol, the first group of pattern in the file name, upper case."""
    out = delimited(spark, path, names).withColumn("source_file", F.col("_metadata.file_name"))
    return out.withColumn("symbol", F.upper(F.regexp_extract("source_file", pattern, 1)))


def latest_snapshot(df: DataFrame) -> DataFrame:
    """Rows of the file whose name is last; df: a scan that still has _metadata."""
    named = df.withColumn("snapshot", F.col("_metadata.file_name"))
    last = named.agg(F.max("snapshot").alias("__last"))
    return named.join(F.broadcast(last), F.col("snapshot") == F.col("__last")).drop("__last")  # one row


def numbered_lines(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Lines of small text files with their place: source_file, i, line. A file is read whole, as its sections need order.

    quoted: line ends between quotes belong to their field.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("v"))
    ends = "\r?\n"
    if quoted:  # what stands outside quotes is every other part
        parts = F.transform(F.split("v", '"', -1), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, ends, "\x01")).otherwise(x))
        whole, ends = whole.withColumn("v", F.concat_ws('"', parts)), "\x01"
    return whole.select("source_file", F.posexplode(F.split("v", ends)).alias("i", "line"))


def cells(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Adds cells, the line's ragged fields, trimmed; as many as the longest line may have, or `most` of them."""
    if most is None:
        most = lines.agg(F.max(F.size(F.split("line", ",", -1)))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(most))
    parsed = F.from_csv("line", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    return lines.withColumn("__p", parsed).withColumn("cells", F.array(*[F.trim(F.col(f"__p.c{i}")) for i in range(most)])).drop("__p")


def positional(lines: DataFrame, skip: int, names: Sequence[str]) -> DataFrame:
    """Fields by place of the lines after the first `skip`."""
    rows = cells(lines.filter(F.col("i") >= skip), len(names))
    return rows.select("source_file", "i", *[F.col("cells")[k].alias(n) for k, n in enumerate(names)])


def anchored(rows: DataFrame, header: str) -> DataFrame:
    """The rows between a header (first cell) and the next row with an empty first cell. rows: see cells()."""
    first = F.coalesce(F.col("cells")[0], F.lit(""))
    marks = rows.filter(first == header).groupBy("source_file").agg(F.min("i").alias("lo"))
    after = rows.join(marks, "source_file").filter(F.col("i") > F.col("lo"))
    ends = after.filter(first == "").groupBy("source_file").agg(F.min("i").alias("hi"))
    return after.join(ends, "source_file", "left").filter(F.col("hi").isNull() | (F.col("i") < F.col("hi"))).drop("lo", "hi")


MONTH = r"^\d{4}-\d{2}$"


def section_months(rows: DataFrame, marker: str, value: int = 1, header: str = "Month") -> DataFrame:
    """period and value of the months below the header of the section that a row with the marker begins; it ends at the first other text."""
    first = F.coalesce(F.col("cells")[0], F.lit(""))
    start = rows.filter(F.contains(first, F.lit(marker))).groupBy("source_file").agg(F.min("i").alias("s"))
    below = rows.join(start, "source_file").filter(F.col("i") > F.col("s"))
    head = below.filter(first == header).groupBy("source_file").agg(F.min("i").alias("h"))
    body = below.join(head, "source_file").filter(F.col("i") > F.col("h"))
    stop = body.filter((first != "") & (first != header) & ~first.rlike(MONTH)).groupBy("source_file").agg(F.min("i").alias("e"))
    kept = body.join(stop, "source_file", "left").filter(first.rlike(MONTH) & (F.col("e").isNull() | (F.col("i") < F.col("e"))))
    return kept.select("source_file", "i", first.alias("period"), F.col("cells")[value].alias("value"))


def between_markers(rows: DataFrame, start: str, stop: str, value: int) -> DataFrame:
    """period and value of the months between two rows that begin with the markers; the last of a period wins."""
    first = F.coalesce(F.col("cells")[0], F.lit(""))
    lo = rows.filter(F.startswith(first, F.lit(start))).groupBy("source_file").agg(F.min("i").alias("lo"))
    hi = rows.join(lo, "source_file").filter((F.col("i") > F.col("lo")) & F.startswith(first, F.lit(stop))).groupBy("source_file", "lo").agg(F.min("i").alias("hi"))
    kept = rows.join(hi, "source_file").filter((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")) & first.rlike(MONTH))
    return kept.groupBy("source_file", first.alias("period")).agg(F.max_by(F.col("cells")[value], F.col("i")).alias("value"), F.max("i").alias("i"))


def month_rows(rows: DataFrame, value: int = 1, pattern: str = r"^20\d{2}-\d{2}$") -> DataFrame:
    """Every row whose first cell is a month, wherever it stands: period, month_end and value."""
    first = F.coalesce(F.col("cells")[0], F.lit(""))
    return rows.filter(first.rlike(pattern)).select("source_file", "i", first.alias("period"), F.last_day(F.try_to_date(F.concat(first, F.lit("-01")), "yyyy-MM-dd")).alias("month_end"), F.col("cells")[value].alias("value"))


def two_grains(rows: DataFrame, value: int = 1) -> DataFrame:
    """A sheet with rows of days and rows of months as one month-end series; of a month the last row of the sheet wins."""
    first = F.coalesce(F.col("cells")[0], F.lit(""))
    days = rows.filter(first.rlike(r"^\d{4}-\d{2}-\d{2}$")).select("source_file", "i", F.try_to_date(first, "yyyy-MM-dd").alias("d"), F.col("cells")[value].alias("value"))
    weekly = days.groupBy("source_file", F.last_day("d").alias("month_end")).agg(F.max_by("value", "d").alias("value"), F.max("i").alias("i"))
    months = month_rows(rows, value).select("source_file", "month_end", "value", "i")
    return weekly.unionByName(months).groupBy("source_file", "month_end").agg(F.max_by("value", "i").alias("value"))


def sections(rows: DataFrame, banners: dict[str, str]) -> DataFrame:
    """Adds section: the name of the banner (text a first cell contains) seen last above the row."""
    from pyspark.sql.window import Window

    first = F.coalesce(F.col("cells")[0], F.lit(""))
    name = F.coalesce(*[F.when(F.contains(first, F.lit(text)), F.lit(label)) for text, label in banners.items()])
    so_far = Window.partitionBy("source_file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(name, ignorenulls=True).over(so_far)).filter(name.isNull())


def column_like(df: DataFrame, *fragments: str) -> str:
    """The first column whose name contains all fragments, whatever their case."""
    for c in df.columns:
        if all(f.lower() in c.lower() for f in fragments):
            return c
    raise ValueError(f"no column like {fragments} in {df.columns}")


# -- markup


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1)


def hidden_fields(html: Column) -> Column:
    """Map of the names and values of hidden inputs."""
    tags = F.regexp_extract_all(html, F.lit(r"""(<input\b[^>]*\btype\s*=\s*["']hidden["'][^>]*>)"""), 1)
    return F.map_from_entries(F.transform(tags, lambda t: F.struct(attribute(t, "name"), attribute(t, "value"))))


def without_tags(html: Column) -> Column:
    """Text of markup: tags out, the common character references decoded, white space squeezed."""
    text = F.regexp_replace(html, "<[^>]+>", "")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, code, char)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def table_rows(df: DataFrame, html: str) -> DataFrame:
    """One row a table row with cells, their texts, and its ordinal from 1; other columns stay."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    out = df.select(*[c for c in df.columns if c != html], F.posexplode(rows).alias("place", "tr"))
    return out.withColumn("cells", F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1), without_tags)).withColumn("ordinal", F.col("place") + 1).drop("place", "tr")


def chart_points(html: Column, labels: str, values: str, points: int) -> Column:
    """(label, value) pairs of two arrays in a script, by the patterns that find them; null unless both have `points` items."""
    items = lambda p: F.transform(F.split(F.regexp_extract(html, p, 1), ","), lambda x: F.trim(F.regexp_replace(x, "['\"]", "")))
    a, b = items(labels), items(values)
    return F.when((F.size(a) == points) & (F.size(b) == points), F.transform(F.arrays_zip(a.alias("label"), b.alias("value")), lambda z: F.struct(z["label"].alias("label"), z["value"].try_cast("double").alias("value"))))


def document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document as one row."""
    return spark.read.option("multiLine", True).json(path)

