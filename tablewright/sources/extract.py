"""Tables out of loose HTML and out of article XML, as rasters of cell ids."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Budgets of one table.
ROWS, COLUMNS, CELLS, SLOTS, SPAN_TEXT = 1000, 256, 10_000, 100_000, 32
FOUND = "key string, table_index int, caption string, raster array<array<int>>, texts array<string>, error string"


class Table:
    """Sections in the order head, body, foot; each a list of rows of (text, rowspan text, colspan text)."""

    def __init__(self) -> None:
        self.sections: dict[str, list[list[tuple[str, str | None, str | None]]]] = {"thead": [], "tbody": [], "tfoot": []}
        self.caption = ""


def span(text: str | None) -> int:
    """A span's number, 1 where there is none; ValueError for text that is no number or too long."""
    if text is None:
        return 1
    text = text.strip()
    if not text.isascii() or not text.isdigit() or len(text) > SPAN_TEXT:
        raise ValueError("bad_span")
    return int(text)


def rasterize(table: Table) -> tuple[list[list[int]], list[str]]:
    """The grid of cell ids and the texts by id. A cell takes the first free column of its row; a row span ends with
    its section, span 0 reaches its end; short rows are filled with cells of their own, numbered last.
    ValueError with a code for overlapping cells, bad spans, an empty table or a broken budget."""
    taken: dict[tuple[int, int], int] = {}
    texts: list[str] = []
    top = width = 0
    for rows in table.sections.values():
        for r, row in enumerate(rows):
            col = 0
            for text, rowspan, colspan in row:
                height, across = span(rowspan), span(colspan)
                if across == 0 or across > COLUMNS:
                    raise ValueError("bad_colspan")
                height = len(rows) - r if height == 0 else min(height, len(rows) - r)
                while (top + r, col) in taken:
                    col += 1
                for i in range(height):
                    for j in range(across):
                        if (top + r + i, col + j) in taken:
                            raise ValueError(f"overlapping({len(texts)})")
                        taken[top + r + i, col + j] = len(texts)
                texts.append(text)
                col += across
                width = max(width, col)
                if width > COLUMNS or len(texts) > CELLS or len(taken) > SLOTS:
                    raise ValueError("over_budget")
        top += len(rows)
    if not top or not width:
        raise ValueError("empty_table")
    if top > ROWS or top * width > SLOTS:
        raise ValueError("over_budget")
    raster = []
    for r in range(top):
        line = []
        for c in range(width):
            if (r, c) not in taken:
                taken[r, c] = len(texts)
                texts.append("")
            line.append(taken[r, c])
        raster.append(line)
    return raster, texts


class Reader(HTMLParser):
    """Collects the tables of loose HTML, an outer one before those inside it; their text is their own cell's too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append(Table())
            self.open.append({"table": self.tables[-1], "section": "tbody", "row": None, "cell": None})
        elif self.open:
            at = self.open[-1]
            if tag in ("thead", "tbody", "tfoot"):
                self.close_row(at)
                at["section"] = tag
            elif tag == "tr":
                self.close_row(at)
                at["row"] = []
            elif tag in ("td", "th"):
                self.close_cell(at)
                if at["row"] is None:
                    at["row"] = []
                spans = dict(attrs)
                at["cell"] = [[], spans.get("rowspan"), spans.get("colspan")]
            else:
                self.handle_data(" ")

    def close_cell(self, at):
        if at["cell"] is not None:
            pieces, rows, cols = at["cell"]
            at["row"].append((" ".join("".join(pieces).split()), rows, cols))
            at["cell"] = None

    def close_row(self, at):
        self.close_cell(at)
        if at["row"] is not None:
            at["table"].sections[at["section"]].append(at["row"])
            at["row"] = None

    def handle_endtag(self, tag):
        if self.open:
            at = self.open[-1]
            if tag in ("td", "th"):
                self.close_cell(at)
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                self.close_row(at)
            elif tag == "table":
                self.close_row(at)
                self.open.pop()

    def handle_data(self, data):
        for at in self.open:
            if at["cell"] is not None:
                at["cell"][0].append(data)


def html_tables(source: str) -> list[Table]:
    reader = Reader()
    reader.feed(source)
    reader.close()
    while reader.open:
        reader.close_row(reader.open.pop())
    return reader.tables


def article_tables(source: str) -> list[Table]:
    """The tables of an article in document order, with the caption of the nearest table wrap; strict XML."""
    bare = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    text = lambda e: " ".join(" ".join(e.itertext()).split())
    out: list[Table] = []

    def read(element, caption: str) -> None:
        if bare(element) == "table-wrap":
            caption = next((text(e) for e in element if bare(e) == "caption"), "")
        if bare(element) == "table":
            table = Table()
            table.caption = caption
            out.append(table)
            for part in element:
                section = bare(part) if bare(part) in table.sections else "tbody"
                for row in [part] if bare(part) == "tr" else [e for e in part if bare(e) == "tr"]:
                    table.sections[section].append([(text(c), c.get("rowspan"), c.get("colspan")) for c in row if bare(c) in ("td", "th")])
        for child in element:
            read(child, caption)

    read(ElementTree.fromstring(source), "")
    return out


def extract(documents: DataFrame, key: str, column: str, form: str = "html") -> DataFrame:
    """One row per table of every document: key, table_index, caption, raster, texts by cell id, error. A table that
    breaks a rule, or a document that is no XML, has an error and no raster; null documents hold no table."""
    tables = html_tables if form == "html" else article_tables

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, source in zip(part["key"], part["source"]):
                try:
                    found = tables(source or "") if form == "html" or source else []
                except ElementTree.ParseError:
                    rows.append((name, None, None, None, None, "malformed_xml"))
                    continue
                for n, table in enumerate(found):
                    try:
                        raster, texts = rasterize(table)
                        rows.append((name, n, table.caption, raster, texts, None))
                    except ValueError as error:
                        rows.append((name, n, table.caption, None, None, str(error)))
            out = pd.DataFrame(rows, columns=["key", "table_index", "caption", "raster", "texts", "error"])
            yield out.astype({"table_index": "Int32"})

    return documents.selectExpr(f"cast(`{key}` AS string) AS key", f"cast(`{column}` AS string) AS source").mapInPandas(run, FOUND)
