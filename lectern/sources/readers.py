"""Readers by suffix, gold sets, and grids of tables."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".txt", ".md", ".markdown")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the text files below a folder; other suffixes are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.where(F.lower("path").rlike(r"\.(txt|md|markdown)$"))


def read_gold_json(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of JSON files: arrays over any lines, or an object on each line as write_gold_json writes them."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    line = first["value"].strip().lstrip("\ufeff") if first else "["
    return spark.read.option("multiLine", not (line.startswith("{") and line.endswith("}"))).json(path)


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions; lists are separated by semicolons and empty entries go, a quote in a quoted field is doubled."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    lists = {c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "") for c in ("gold_chunk_uids", "gold_pages") if c in raw.columns}
    return raw.withColumns(lists)


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows, self.cell, self.spans, self.size = [], None, {}, (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            a = dict(attrs)
            whole = lambda x: max(1, int(x)) if x and x.isdigit() else 1
            self.size, self.cell = (whole(a.get("rowspan")), whole(a.get("colspan"))), []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            value, row, at = " ".join("".join(self.cell).split()), len(self.rows) - 1, len(self.rows[-1])
            while (row, at) in self.spans:
                self.rows[-1].append(self.spans[row, at])
                at += 1
            for down in range(self.size[0]):
                for right in range(self.size[1]):
                    self.spans[row + down, at + right] = value
            self.rows[-1] += [value] * self.size[1]
            self.cell = None


def html_grid(html: str) -> list[list[str]]:
    """Cells of an HTML table; spanning cells repeat their value."""
    parser = _Grid()
    parser.feed(html or "")
    return parser.rows


def markdown_grid(text: str) -> list[list[str]]:
    """Cells of a pipe table, without its rule line."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in (text or "").split("\n") if line.strip().startswith("|")]
    return [r for r in rows if not all(c and set(c) <= {"-", ":"} for c in r)]
