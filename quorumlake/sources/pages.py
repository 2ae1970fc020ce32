"""Bill texts and simple pages (S15-S18): parsers per file, spread over the files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bill_parts(data: bytes) -> tuple[str | None, str | None, str | None]:
    """(text of the body, of the summary, error) of a bill's XML; white space as single blanks."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        return None, None, str(e)
    flat = lambda e: re.sub(r"\s+", " ", " ".join(e.itertext())).strip() if e is not None else None
    return flat(root.find(".//Body")), flat(root.find(".//Summary")), None


def bill_parts_of(files: DataFrame) -> DataFrame:
    """path, body, summary, error of every bill in `files` (path, content); a null content is an error."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            got = [bill_parts(b"" if c is None else bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "body": [g[0] for g in got], "summary": [g[1] for g in got], "error": [g[2] for g in got]})

    return files.select("path", "content").mapInPandas(run, "path string, body string, summary string, error string")


def bill_texts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of the bills in all files below a path."""
    return bill_parts_of(spark.read.format("binaryFile").load(path))


class _Tiles(HTMLParser):
    """Text of elements by class inside repeated tiles, and the first link of each tile."""

    VOID = {"br", "img", "hr", "meta", "link", "input"}

    def __init__(self, tile: str, fields: dict[str, str]) -> None:
        super().__init__()
        self.tile, self.fields, self.rows, self.stack = tile, fields, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if self.tile in classes:
            self.rows.append({"link": None, **{f: "" for f in self.fields}})
        self.stack.append((tag, classes))
        if self.inside() and tag == "a" and self.rows[-1]["link"] is None:
            self.rows[-1]["link"] = a.get("href")

    def handle_endtag(self, tag: str) -> None:
        while self.stack:
            if self.stack.pop()[0] == tag:
                break

    def inside(self) -> bool:
        return any(self.tile in c for _, c in self.stack)

    def handle_data(self, data: str) -> None:
        if not self.inside():
            return
        for f, cls in self.fields.items():
            if any(cls in c for _, c in self.stack):
                self.rows[-1][f] += data


def tiles(pages: DataFrame, page: str, tile: str, fields: dict[str, str]) -> DataFrame:
    """One row per tile of each page: link and the text of the fields (name -> class). Null pages have none."""
    names = ["link", *fields]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for text in pdf[page]:
                p = _Tiles(tile, fields)
                p.feed(text or "")
                p.close()
                out += [{k: re.sub(r"\s+", " ", v).strip() if v is not None else None for k, v in r.items()} for r in p.rows]
            yield pd.DataFrame(out, columns=names)

    return pages.select(page).mapInPandas(run, ", ".join(f"{n} string" for n in names))


def next_sitting(documents: DataFrame, number: str, *keys: str) -> DataFrame:
    """keys, `next`: the sitting to ask for next, one after the highest whole number; numbers with letters don't count."""
    return documents.groupBy(*keys).agg((F.coalesce(F.max(F.col(number).try_cast("int")), F.lit(0)) + 1).alias("next"))
