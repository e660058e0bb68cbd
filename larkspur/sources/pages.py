"""Model parameters inside pages: numbers after a phrase, tables in back quotes, objects in scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"


def quoted(text: str) -> str:
    """A pattern for text as it stands."""
    return "".join(c if c.isalnum() or c in " _<>=:,;'\"`" else f"\\{c}" for c in text)


def number_after(html: Column, phrase: str) -> Column:
    """The first number right after a phrase; null if there is none."""
    return F.nullif(F.regexp_extract(html, quoted(phrase) + r"\s*" + _NUMBER, 1), F.lit("")).try_cast("double")


def object_after(html: Column, name: str, schema: str) -> Column:
    """The object or list that ``const NAME=`` sets: the reader stops at its end, whatever follows. Null if there is none or it does not read."""
    return F.from_json(F.nullif(F.regexp_extract(html, rf"(?s)const\s+{quoted(name)}\s*=\s*([\[{{].*)", 1), F.lit("")), schema)


def table_rows(pages: DataFrame, html: str, name: str, columns: list[tuple[int, str, str]], keep: list[str]) -> DataFrame:
    """One row for each line of the table that ``const NAME=`...` `` sets: columns are (position, name, type); what does not read is null."""
    body = F.nullif(F.regexp_extract(html, rf"(?s)const\s+{quoted(name)}\s*=\s*`([^`]*)`", 1), F.lit(""))
    lines = pages.select(*keep, F.explode(F.split(F.trim(body), r"\r?\n")).alias("line")).where("line != ''")
    cells = lines.withColumn("cells", F.split("line", "\t"))
    return cells.select(*keep, *[F.get("cells", F.lit(at)).try_cast(kind).alias(column) for at, column, kind in columns])
