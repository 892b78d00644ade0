"""Table markup made safe to show: the structure and the text stay, all else goes."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that stay, those that are shown as another one, those that go with all that they hold.
KEPT = frozenset("table thead tbody tfoot tr th td caption colgroup col p span div br strong b em i sup sub small code abbr ul ol li".split())
SHOWN = {"italic": "em", "bold": "strong", "monospace": "code"}
BLOCKED = frozenset("script style template iframe frame frameset object embed applet form input button select textarea video audio picture source track img image svg math canvas link meta base noscript foreignobject".split())
VOID = frozenset("br col area base embed frame hr img input link meta param source track wbr".split())
SCOPES = ("row", "col", "rowgroup", "colgroup")
#: The attributes that stay, by element, with the least value of a number.
SPANS = {"td": {"colspan": 1, "rowspan": 0}, "th": {"colspan": 1, "rowspan": 0}, "colgroup": {"span": 1}, "col": {"span": 1}}
MOST_SPAN = 100_000
#: What an open element's start ends: cells end cells, rows end cells and rows, sections all three.
ENDED = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "thead": {"td", "th", "tr", "thead", "tbody", "tfoot"}, "li": {"li"}, "p": {"p"}}
ENDED |= {"tbody": ENDED["thead"], "tfoot": ENDED["thead"]}


def kept_attributes(tag: str, given: list[tuple[str, str | None]]) -> str:
    """The attributes that stay, in their order: spans as plain numbers, known scopes of a header cell. The first of a name counts."""
    out, met = [], set()
    for name, value in given:
        value = (value or "").strip()
        if name in met:
            continue
        met.add(name)
        least = SPANS.get(tag, {}).get(name)
        if least is not None and value.isascii() and value.isdigit() and len(value) <= 32 and least <= int(value) <= MOST_SPAN:
            out.append(f' {name}="{int(value)}"')
        elif tag == "th" and name == "scope" and value in SCOPES:
            out.append(f' scope="{value}"')
    return "".join(out)


class Cleaner(HTMLParser):
    """Writes what stays of one source. `open` holds (element, how it is shown), shown None inside a blocked one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, str | None]] = []

    @property
    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1] is None

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in BLOCKED:
            if tag not in VOID:
                self.open.append((tag, None))
            return
        while self.open and self.open[-1][0] in ENDED.get(tag, ()):
            self.pop()
        shown = tag if tag in KEPT else SHOWN.get(tag, "span")
        self.out.append(f"<{shown}{kept_attributes(shown, attrs)}>")
        if tag not in VOID:
            self.open.append((tag, shown))
        elif shown == "span":
            self.out.append("</span>")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        inner = len(self.open)
        while inner and self.open[inner - 1][0] != tag:
            inner -= 1
            if self.open[inner][0] in ("table", *BLOCKED):  # an end tag ends nothing outside the table or the blocked element
                return
        if inner:
            while len(self.open) >= inner:
                self.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(escape(data, quote=False))

    def pop(self):
        shown = self.open.pop()[1]
        if shown is not None:
            self.out.append(f"</{shown}>")


def cleaned(source: str) -> str:
    cleaner = Cleaner()
    cleaner.feed(source)
    cleaner.close()
    while cleaner.open:
        cleaner.pop()
    return "".join(cleaner.out)


def clean_tables(df: DataFrame, column: str) -> DataFrame:
    """df with `column` cleaned: only elements that show structure or text, any other as a span; of the attributes only spans
    that are numbers in range and known scopes; active elements go with all that they hold, comments too. Open elements are
    ended. Null stays null."""

    @F.pandas_udf("string")
    def clean(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in sources:
            yield part.map(cleaned, na_action="ignore")

    return df.withColumn(column, clean(F.col(column)))
