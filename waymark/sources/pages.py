"""Elements and tables of HTML pages, as column expressions over a table of page texts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add title, items (inner texts of list items) and links (targets)."""
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return pages.withColumn("title", F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)).withColumn("items", every(r"(?s)<li[^>]*>(.*?)</li>")).withColumn("links", every(r'<a [^>]*href="([^"]*)"'))


class Tables(HTMLParser):
    """Rows of all tables of a page. A stack holds the open tables, so nested ones stay apart; cells and rows that are not closed end where the next one begins or an outer one ends."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int | None, int, list[str]]] = []  # table, the table around it, row, cells
        self.open: list[dict] = []
        self.count = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append({"table": self.count, "around": self.open[-1]["table"] if self.open else None, "row": -1, "cells": None, "cell": None})
            self.count += 1
        elif self.open and tag == "tr":
            self.end_row()
            self.begin_row()
        elif self.open and tag in ("td", "th"):
            self.end_cell()
            if self.open[-1]["cells"] is None:
                self.begin_row()
            self.open[-1]["cell"] = []

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th"):
            self.end_cell()
        elif self.open and tag in ("tr", "tbody", "thead", "tfoot"):
            self.end_row()
        elif self.open and tag == "table":
            self.end_row()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        for t in self.open:  # text of a nested table belongs to the cell around it as well
            if t["cell"] is not None:
                t["cell"].append(data)

    def begin_row(self) -> None:
        self.open[-1]["row"] += 1
        self.open[-1]["cells"] = []

    def end_cell(self) -> None:
        t = self.open[-1]
        if t["cell"] is not None:
            t["cells"].append(" ".join("".join(t["cell"]).replace("\u00a0", " ").split()))
            t["cell"] = None

    def end_row(self) -> None:
        self.end_cell()
        t = self.open[-1]
        if t["cells"] is not None:
            self.rows.append((t["table"], t["around"], t["row"], t["cells"]))
            t["cells"] = None

    def of(self, html: str) -> list[tuple[int, int | None, int, list[str]]]:
        self.feed(html)
        self.close()
        while self.open:
            self.handle_endtag("table")
        return sorted(self.rows, key=lambda r: (r[0], r[2]))


def table_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table, around, row and cells (texts) of every row of every table; tables are numbered from 0 in the order in which they begin, and ``around`` is the number of the table that a nested one stands in.

    The pages go through the standard library's tokenizer in Arrow batches, as open elements are a matter of order. Null pages have no rows.
    """
    kind = pages.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *row) for i, text in enumerate(batch.column(1).to_pylist()) if text for row in Tables().of(text)]
            i, table, around, row, cells = zip(*found, strict=True) if found else ((),) * 5
            cols = [batch.column(0).take(pa.array(i, pa.int32())), pa.array(table, pa.int32()), pa.array(around, pa.int32()), pa.array(row, pa.int32()), pa.array(cells, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "table", "around", "row", "cells"])

    numbers = [StructField(n, IntegerType()) for n in ("table", "around", "row")]
    schema = StructType([StructField(key, kind), *numbers, StructField("cells", ArrayType(StringType()))])
    return pages.select(key, html).mapInArrow(run, schema)


def two_way_stops(rows: DataFrame, key: str) -> DataFrame:
    """Rows of four cells (number, stop, number, stop) from the first numeric one on, as (key, table, direction, ordinal, name)."""
    first = F.min(F.when(F.element_at("cells", 1).rlike(r"^\d+$"), F.col("row"))).over(Window.partitionBy(key, "table"))
    four = rows.where(F.size("cells") >= 4).withColumn("first", first).where(F.col("row") >= F.col("first"))
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), F.element_at("cells", c).alias("number"), F.element_at("cells", c + 1).alias("name")) for d, c in (("outbound", 1), ("inbound", 3))])
    out = four.select(key, "table", "row", F.explode(sides).alias("s")).where(F.col("s.name") != "")
    return out.select(key, "table", "s.direction", F.coalesce(F.col("s.number").try_cast("int"), F.col("row")).alias("ordinal"), "s.name")


def one_way_stops(rows: DataFrame, key: str, skipped: list[str]) -> DataFrame:
    """Rows of two cells (name, street) without header words, numbered in order."""
    head = F.lit(False)
    for word in skipped:
        head = head | F.lower(F.element_at("cells", 1)).contains(word)
    kept = rows.where((F.size("cells") >= 2) & ~head & (F.element_at("cells", 1) != ""))
    number = F.row_number().over(Window.partitionBy(key, "table").orderBy("row"))
    return kept.select(key, "table", number.alias("ordinal"), F.element_at("cells", 1).alias("name"), F.element_at("cells", 2).alias("street"))


def timetables(rows: DataFrame, key: str) -> DataFrame:
    """Rows below the header as maps from header to cell, with the first cell as the departure."""
    head = F.first("cells").over(Window.partitionBy(key, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    width = F.least(F.size("head"), F.size("cells"))
    body = rows.withColumn("head", head).where((F.col("row") > 0) & (F.size("cells") > 0))
    entries = F.map_from_entries(F.array_distinct(F.arrays_zip(F.transform(F.slice("head", F.lit(1), width), lambda h, i: F.concat(h, F.when(h == "", i.cast("string")).otherwise(F.lit("")))).alias("key"), F.slice("cells", F.lit(1), width).alias("value"))))
    return body.select(key, "table", "row", F.element_at("cells", 1).alias("departure"), entries.alias("timeline"))


def line_ranges(texts: DataFrame, ranges: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each text that fall into its ranges (key, part, first_line, last_line; counted from 1)."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("at", F.col("at") + 1)
    return lines.join(ranges, key).where(F.col("at").between(F.col("first_line"), F.col("last_line"))).select(key, "part", "at", "line")
