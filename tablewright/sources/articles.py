"""Tables out of article XML, with what their surroundings say of them, and the article's own ids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.ids import article_name
from tablewright.sources.extract import Table, rasterize

CONTEXT = (
    "struct<source_path: string, table_id: string, wrap_path: string, wrap_id: string, label: string, caption: string, "
    "caption_external: boolean, notes: array<string>, source_table: string>"
)
FOUND = f"key string, table_index int, context {CONTEXT}, raster array<array<int>>, texts array<string>, error string"


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    first: int
    last: int = 0
    nodes: list[Element | str] = field(default_factory=list)

    def elements(self, *names: str) -> list[Element]:
        return [n for n in self.nodes if isinstance(n, Element) and (not names or n.name in names)]

    def text(self) -> str:
        """All texts inside, a blank between any two, white space as one blank."""
        pieces, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                pieces.append(node)
            else:
                todo += reversed(node.nodes)
        return " ".join(" ".join(pieces).split())


def parse(source: bytes) -> Element:
    """The root element of an XML document, names without their prefixes, bound or not. expat.ExpatError if it is none."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    root = Element("", {}, 0)
    open_ = [root]

    def start(name: str, attributes: dict) -> None:
        element = Element(name.partition(":")[2] or name, attributes, parser.CurrentByteIndex)
        open_[-1].nodes.append(element)
        open_.append(element)

    def end(name: str) -> None:
        at = parser.CurrentByteIndex
        open_.pop().last = source.find(b">", at) + 1  # of the end tag, or of the tag that is both

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: open_[-1].nodes.append(data)
    parser.Parse(source, True)
    return root.elements()[0]


def notes(wrap: Element) -> list[str]:
    """The notes under a wrap, one for each part of its foot and each of a group of them; empty ones left out."""
    out, todo = [], [e for foot in wrap.elements("table-wrap-foot") for e in foot.elements()][::-1]
    while todo:
        node = todo.pop()
        if node.name == "fn-group":
            todo += node.elements()[::-1]
        elif said := node.text():
            out.append(said)
    return out


def said(element: Element, name: str) -> str:
    return " ".join(t for e in element.elements(name) if (t := e.text()))


def context(table: Element, path: str, wrap: Element | None, wrap_path: str, source: bytes) -> dict:
    caption = said(wrap, "caption") if wrap else ""
    return {
        "source_path": path, "table_id": table.attributes.get("id", ""), "wrap_path": wrap_path, "wrap_id": wrap.attributes.get("id", "") if wrap else "",
        "label": said(wrap, "label") if wrap else "", "caption": caption or said(table, "caption"), "caption_external": bool(caption),
        "notes": notes(wrap) if wrap else [], "source_table": source[table.first : table.last].decode("utf-8", "replace"),
    }


def read_table(element: Element) -> Table:
    table = Table()
    for part in element.elements():
        section = part.name if part.name in table.sections else "tbody"
        for row in [part] if part.name == "tr" else part.elements("tr"):
            table.sections[section].append([(c.text(), c.attributes.get("rowspan"), c.attributes.get("colspan")) for c in row.elements("td", "th")])
    return table


def tables(source: bytes) -> list[tuple[Table, dict]]:
    """The tables of an article in document order, an outer one before those inside it, each with its context: the
    places of the table and of the nearest wrap around it (numbers of elements from 1, from the root), their ids, and the
    wrap's label, caption and notes. Without a caption of the wrap the table's own counts, as internal."""
    root = parse(source)
    out, todo = [], [(root, "1", None, "")]
    while todo:
        element, path, wrap, wrap_path = todo.pop()
        if element.name == "table":
            out.append((read_table(element), context(element, path, wrap, wrap_path, source)))
        if element.name == "table-wrap":
            wrap, wrap_path = element, path
        todo += [(child, f"{path}/{n}", wrap, wrap_path) for n, child in enumerate(element.elements(), 1)][::-1]
    return out


def article_tables(articles: DataFrame, key: str, column: str) -> DataFrame:
    """One row per table of every article: key, table_index, context, raster, texts by cell id and error. An article that
    is no XML has one row with the error malformed_xml; a table that breaks a rule has its context, an error and no raster;
    null articles hold no table. `column` is a text, or bytes in the encoding that the XML declares."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, source in zip(part["key"], part["source"]):
                try:
                    found = tables(bytes(source)) if source is not None else []
                except expat.ExpatError:
                    rows.append((name, None, None, None, None, "malformed_xml"))
                    continue
                for n, (table, told) in enumerate(found):
                    try:
                        raster, texts = rasterize(table)
                        rows.append((name, n, told, raster, texts, None))
                    except ValueError as error:
                        rows.append((name, n, told, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["key", "table_index", "context", "raster", "texts", "error"]).astype({"table_index": "Int32"})

    return articles.selectExpr(f"cast(`{key}` AS string) AS key", f"cast(`{column}` AS binary) AS source").mapInPandas(run, FOUND)


def article_ids(articles: DataFrame, key: str, column: str) -> DataFrame:
    """(key, single, ids, error): whether a document is one article, alone or in a set of one, and the ids of type pmc or
    pmcid in its front, as they are written, in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, source in zip(part["key"], part["source"]):
                try:
                    root = parse(bytes(source)) if source is not None else Element("", {}, 0)
                except expat.ExpatError:
                    rows.append((name, False, [], "malformed_xml"))
                    continue
                articles_ = [root] if root.name == "article" else root.elements("article") if root.name == "pmc-articleset" else []
                kinds = lambda e: e.attributes.get("pub-id-type", "").lower() in ("pmc", "pmcid")
                met = [i.text() for a in articles_ for f in a.elements("front") for m in f.elements("article-meta") for i in m.elements("article-id") if kinds(i)]
                rows.append((name, len(articles_) == 1, met, None))
            yield pd.DataFrame(rows, columns=["key", "single", "ids", "error"])

    return articles.selectExpr(f"cast(`{key}` AS string) AS key", f"cast(`{column}` AS binary) AS source").mapInPandas(run, "key string, single boolean, ids array<string>, error string")


def identities(found: DataFrame) -> DataFrame:
    """(key, identity) of article_ids: ok if the document is one article whose ids all name `key` (PMC123), else
    malformed_xml, nonarticle_root or identity_mismatch."""
    digits = F.transform("ids", lambda i: article_name(F.regexp_replace(F.upper(i), "^PMC", "")))
    same = (F.size("ids") > 0) & F.forall(digits, lambda d: F.coalesce(d == F.col("key"), F.lit(False)))
    return found.select("key", F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("single"), "nonarticle_root").when(same, "ok").otherwise("identity_mismatch").alias("identity"))


LICENCE = "struct<status: string, license_type: string, license_url: string, license_text_excerpt: string, redistribution_status: string>"
EXCERPT = 1024


def licence(root: Element) -> tuple:
    """What an article says of its licence, which is evidence and no permission: the type and text of the first license
    element and the target of the first link in it."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.name == "license":
            links = [node]
            target = None
            while links and target is None:
                at = links.pop()
                if at.name == "ext-link":
                    target = at.attributes.get("xlink:href", at.attributes.get("href"))
                links += at.elements()[::-1]
            return "evidence_found_unverified", node.attributes.get("license-type", "unknown"), target, node.text()[:EXCERPT], "requires_manual_review"
        todo += node.elements()[::-1]
    return "missing", None, None, "", "requires_manual_review"


def provenance(articles: DataFrame, key: str, column: str) -> DataFrame:
    """(key, sha256, bytes, license): the hash and size of each article's raw bytes, and the evidence of its licence, null
    where the article is no XML. `column` is a text, or bytes."""

    @F.pandas_udf(LICENCE)
    def evidence(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for source in sources:
            try:
                rows.append(licence(parse(bytes(source))))
            except (expat.ExpatError, TypeError):  # no XML, or null
                rows.append((None,) * 5)
        return pd.DataFrame(rows, columns=["status", "license_type", "license_url", "license_text_excerpt", "redistribution_status"])

    raw = articles.selectExpr(f"cast(`{key}` AS string) AS key", f"cast(`{column}` AS binary) AS source")
    told = raw.select("key", F.sha2("source", 256).alias("sha256"), F.octet_length("source").cast("long").alias("bytes"), evidence("source").alias("license"))
    return told.withColumn("license", F.when(F.col("license.status").isNotNull(), F.col("license")))
