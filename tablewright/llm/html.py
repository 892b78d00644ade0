"""Main-text extraction by wrappers inferred from the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import text_chunks, write

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Fixed values of HTML: an unfinished tag at the end; elements without content, with raw text, that end an open paragraph, that stay inside a line.
UNFINISHED = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements that hold text of an article rather than an article.
TEXTUAL = HEADINGS | set("p li ul ol dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th address details summary hr".split())
# What does not belong to an article, by element and, as a prior, by the words of its class, id and role.
OUTSIDE = set("nav header footer aside form button select menu dialog head script style noscript template svg math iframe textarea title object canvas".split())
OUTSIDE_WORDS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget navigation complementary contentinfo search alert gdpr consent signup".split())
# Words that say less on a text's own element: a heading may be called a header, a paragraph be about a search. There
# they count only where the text is constant or mostly links.
WEAK_WORDS = set("alert banner header login masthead promoted related search social widget".split())
# An element that is often drawn around a whole page.
WRAPPING = {"form"}
# Priors that an element is the article: how many times its text counts.
INSIDE, INSIDE_WEIGHT = {"article", "main"}, 30.0
INSIDE_WORDS, INSIDE_WORDS_WEIGHT = set("article content entry main post story articlebody maincontent text body".split()), 12.0
#: The share of a region's weighted text that a part must hold to become the region.
LEADING = 0.8
#: Pages on which a text must be one and the same to be template rather than slot.
TEMPLATE_PAGES = 3
WORDS = re.compile(r"[a-z]+")
TEXT = "#"
# Flags of a wrapper's node: its group is optional, or repeats.
OPTIONAL, REPEATED = "?", "+"


def label(name: str, attributes: str) -> str:
    """An element's name with the words of its class, id and role."""
    found = sorted({w for a in ATTRIBUTE.finditer(attributes) for w in WORDS.findall((a[2] or a[3] or a[4] or "").lower())}) if attributes else []
    return " ".join([name, *found])


class Prior(NamedTuple):
    """What a label tells: its element, whether that or its words are outside an article, how its text counts."""

    name: str
    outside: bool
    named_outside: bool
    weight: float
    weakly: bool


@lru_cache(1 << 14)
def prior(label: str) -> Prior:
    name, *marks = label.split(" ")
    weight = INSIDE_WEIGHT if name in INSIDE else INSIDE_WORDS_WEIGHT if INSIDE_WORDS & set(marks) else 1.0
    named = OUTSIDE_WORDS & set(marks)
    return Prior(name, name in OUTSIDE, name not in ("html", "body") and bool(named), weight, name in TEXTUAL and bool(named) and named <= WEAK_WORDS)


class Node:
    """An element of a page, a text of one, or a node of a wrapper. A page's node has a slot in the wrapper, if any;
    a wrapper's has a number and what the pages have there."""

    __slots__ = ("label", "flags", "kids", "text", "links", "slot", "mass", "out", "number", "pages", "template")

    def __init__(self, label: str, flags: str = "") -> None:
        self.label, self.flags, self.text, self.links, self.slot, self.mass, self.out = label, flags, "", 0, None, 0.0, False
        self.kids: list[Node] = []

    @property
    def prior(self) -> Prior:
        return prior(self.label)


class Group:
    """Neighbouring entries of a page or wrapper that repeat together."""

    __slots__ = ("entries", "flags", "slot")

    def __init__(self, entries: list) -> None:
        self.entries, self.flags, self.slot = entries, "", None


def parse(source: str) -> Node:
    """The block structure of a page, texts being nodes of their own. Unclosed elements end where HTML's rules or
    their parents end them; elements that stay inside a line dissolve into their text, as blanks where they break
    it, unless their class names them as no part of an article."""
    root = Node("#page")
    stack, names, at, end = [root], [root.label], 0, len(source)
    opened: Counter[str] = Counter()  # names on the stack, so that a closing tag without an element costs nothing
    kept: list[list] = []  # open elements inside a line that did not dissolve: name, open ones of that name within, depth
    linked = 0
    pieces: dict[int, list[str]] = {}
    texts: list[Node] = []

    def close(depth: int) -> None:
        for name in names[depth:]:
            opened[name] -= 1
        del stack[depth:], names[depth:]
        while kept and kept[-1][2] >= depth:
            kept.pop()

    def open_(name: str, node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        names.append(name)
        opened[name] += 1

    def say(text: str) -> None:
        kids = stack[-1].kids
        if not kids or kids[-1].label != TEXT:
            kids.append(Node(TEXT))
            texts.append(kids[-1])
            pieces[id(kids[-1])] = []
        pieces[id(kids[-1])].append(text)
        if linked:
            kids[-1].links += len(text)

    while at < end:
        token = TOKEN.search(source, at)
        stop = token.start() if token else end
        if stop > at:
            say(source[at:stop] if token else UNFINISHED.sub("", source[at:stop]))
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        closing, name = token[1], token[2].lower()
        if name in RAW and not closing:
            ended = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
            at = ended.end() if ended else end
            continue
        if name in INLINE or name in VOID:
            if name == "a":
                linked = 0 if closing else 1
            if name in ("br", "img", "wbr"):
                say(" ")
            elif name in VOID:
                stack[-1].kids.append(Node(name))
            elif not closing and token[3] and OUTSIDE_WORDS & set((named := label(name, token[3])).split(" ")[1:]):
                open_(name, Node(named))
                kept.append([name, 0, len(stack) - 1])
            elif kept and kept[-1][0] == name:
                if not closing:
                    kept[-1][1] += 1
                elif kept[-1][1]:
                    kept[-1][1] -= 1
                else:
                    close(kept[-1][2])
            continue
        linked = 0
        if closing:
            if name == "p":
                while kept and kept[-1][2] == len(stack) - 1:
                    close(len(stack) - 1)
                if names[-1] == "p":
                    close(len(stack) - 1)
            elif opened[name]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if names[d] == name))
            continue
        if names[-1] == "p":
            close(len(stack) - 1)
        if name in ENDS:
            while names[-1] in ENDS[name]:
                close(len(stack) - 1)
        open_(name, Node(label(name, token[3]) if token[3] else name))
    for node in texts:
        node.text = " ".join(entities.unescape("".join(pieces[id(node)])).split())
        node.links = min(node.links, len(node.text))
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [k for k in node.kids if k.label != TEXT or k.text]
        todo.extend(node.kids)
    return root


# A level of a page or wrapper is a list of entries [label, flags, instances]: neighbours with one label are one
# repeated entry, and so are neighbours whose labels alternate (a Group).


def add(flags: str, more: str) -> str:
    return "".join(f for f in (OPTIONAL, REPEATED) if f in flags or f in more)


def unit(entry: list) -> tuple[str, ...] | None:
    """The labels that a group's entry repeats; None for other entries."""
    if not entry[0].startswith("("):
        return None
    one = entry[2][0]
    return tuple(e[0] for e in one.entries) if isinstance(one, Group) else tuple(k.label for k in one.kids)


def level(node) -> list:
    if isinstance(node, Group):
        return node.entries
    entries = [[k.label, k.flags, [k]] for k in node.kids]
    return fold(entries) if len(entries) > 1 else entries


def grouped(entries: list) -> list:
    return ["(" + "|".join(e[0] for e in entries) + ")", "", [Group(entries)]]


def fold(entries: list) -> list:
    """Entries with what repeats side by side made one: single labels, then sequences of them, also of folded ones."""
    if len({e[0] for e in entries}) == len(entries) and not any(e[0].startswith("(") for e in entries):
        return entries
    out: list = []
    places: dict[str, list[int]] = defaultdict(list)

    def put(entry: list) -> None:
        if out and out[-1][0] == entry[0]:
            out[-1] = [entry[0], add(add(out[-1][1], entry[1]), REPEATED), out[-1][2] + entry[2]]
        elif out and OPTIONAL not in out[-1][1] and isinstance(out[-1][2][-1], Group) and out[-1][2][-1].entries[-1][0] == entry[0]:
            ending = out[-1][2][-1].entries  # the group's last part goes on
            ending[-1] = [entry[0], add(add(ending[-1][1], entry[1]), REPEATED), ending[-1][2] + entry[2]]
        else:
            places[entry[0]].append(len(out))
            out.append(entry)

    def take(n: int) -> list:
        taken = out[-n:]
        del out[-n:]
        for entry in taken:
            places[entry[0]].pop()
        return taken

    for entry in entries:
        put(entry)
        while len(places[out[-1][0]]) > 1:
            n = places[out[-1][0]][-1] - places[out[-1][0]][-2]
            if len(out) < 2 * n or [e[0] for e in out[-n:]] != [e[0] for e in out[-2 * n : -n]]:
                break
            later, earlier = take(n), take(n)
            one, two = grouped(earlier), grouped(later)
            put([one[0], REPEATED, one[2] + two[2]])
        last = next((k for k in range(len(out) - 2, max(-1, len(out) - 10), -1) if out[k][0].startswith("(")), None)
        if last is not None and unit(out[last]) == tuple(e[0] for e in out[last + 1 :]):
            put(grouped(take(len(out) - last - 1)))
    return out


def wrap(entries: list, units: set[tuple[str, ...]]) -> list:
    """Entries with each sequence that the other side knows as a group made a group, the longest first."""
    for known in sorted(units, key=lambda u: (-len(u), u)):
        labels, out, i = [e[0] for e in entries], [], 0
        while i < len(entries):
            if tuple(labels[i : i + len(known)]) == known:
                out.append(grouped(entries[i : i + len(known)]))
                i += len(known)
            else:
                out.append(entries[i])
                i += 1
        if len(out) < len(entries):
            entries = fold(out)
    return entries


def units(entries: list) -> set[tuple[str, ...]]:
    return {u for e in entries if (u := unit(e))}


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in space linear in the lists: what precedes and follows the
    middle of a is aligned with the parts of b where both together are longest."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    code: dict[str, int] = {}
    x = np.array([code.setdefault(s, len(code)) for s in a], np.int64)
    y = np.array([code.setdefault(s, len(code)) for s in b], np.int64)

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int64)
        for v in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
        return row

    pairs = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and x[i] == y[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and x[k - 1] == y[m - 1]:
            k, m = k - 1, m - 1
            pairs.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            at = np.flatnonzero(y[j:m] == x[i])
            if len(at):
                pairs.append((i, j + int(at[0])))
            continue
        half = (i + k) // 2
        cut = j + int((lengths(x[i:half], y[j:m]) + lengths(x[half:k][::-1], y[j:m][::-1])[::-1]).argmax())
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(pairs)


def aligned(a: list, b: list) -> list:
    """The entries that generalise two levels: what only one has becomes optional, what either repeats repeats."""
    a, b = wrap(a, units(b)), wrap(b, units(a))
    out: list = []
    i = j = 0
    for p, q in [*common([e[0] for e in a], [e[0] for e in b]), (len(a), len(b))]:
        out += [[e[0], add(e[1], OPTIONAL), e[2]] for e in [*a[i:p], *b[j:q]]]
        if p < len(a):
            out.append([a[p][0], add(a[p][1], b[q][1]), a[p][2] + b[q][2]])
        i, j = p + 1, q + 1
    return fold(out)


def generalise(nodes: list) -> Node:
    """The wrapper of pages or wrappers, a union-free regular expression: at each level, from the top, the nodes that
    fall together are aligned one after the other."""
    root = Node(nodes[0].label)
    todo = [(root, nodes)]
    while todo:
        made, parts = todo.pop()
        entries = level(parts[0])
        for part in parts[1:]:
            entries = aligned(entries, level(part))
        for name, flags, instances in entries:
            made.kids.append(Node(name, flags))
            if name != TEXT:
                todo.append((made.kids[-1], instances))
    return root


def dump(wrapper: Node) -> str:
    """A wrapper as JSON of label, flags and number of children of each node, parents before children."""
    flat: list = []
    todo = [wrapper]
    while todo:
        node = todo.pop()
        flat += [node.label, node.flags, len(node.kids)]
        todo.extend(reversed(node.kids))
    return json.dumps(flat)


def load(text: str, seen: dict[int, tuple[int, int, bool]] | None = None) -> Node:
    """A wrapper, its nodes numbered in order, with what the pages have by number: pages, unlinked characters, and
    whether the text is template. An element's mass is the characters a page has in its slots on average."""
    flat = json.loads(text)
    top = Node("")
    waiting = [(top, 1)]  # nodes and how many children they still lack
    nodes: list[Node] = []
    for at in range(0, len(flat), 3):
        while not waiting[-1][1]:
            waiting.pop()
        parent, lack = waiting[-1]
        waiting[-1] = (parent, lack - 1)
        node = Node(flat[at], flat[at + 1])
        node.number = len(nodes)
        node.pages, node.mass, node.template = (seen or {}).get(node.number, (0, 0, False))
        node.template = node.template and node.label == TEXT
        node.mass = 0.0 if node.template else float(node.mass)
        parent.kids.append(node)
        nodes.append(node)
        waiting.append((node, flat[at + 2]))
    outside(top.kids[0])
    for node in reversed(nodes):
        node.mass += sum(kid.mass for kid in node.kids if not kid.out)
    for node in nodes:
        node.mass /= max(1, node.pages)
    return top.kids[0]


def outside(root: Node, strict: bool = True) -> None:
    """Marks the nodes that are no part of an article. By element: always, but for one that is drawn around pages, which
    goes only if it holds neither the first heading, nor an article, nor half of the page's text outside links. By class
    words: unless the page's body or its first heading is in them, or the words say little and the text is neither
    template nor mostly links. Not strict: by element only, and nothing that is drawn around pages."""
    order = [root]
    for node in order:
        order.extend(node.kids)
    titled: set[int] = set()
    held: set[int] = set()
    said: dict[int, int] = {}
    linked: dict[int, int] = {}
    for node in reversed(order):
        name = prior(node.label).name
        if name == "h1" or any(id(k) in titled for k in node.kids):
            titled.add(id(node))
        if name in INSIDE or any(id(k) in held for k in node.kids):
            held.add(id(node))
        said[id(node)] = len(node.text) + sum(said[id(k)] for k in node.kids)
        linked[id(node)] = node.links + sum(linked[id(k)] for k in node.kids)
    plain = said[id(root)] - linked[id(root)]
    for node in order:
        known, own = prior(node.label), said[id(node)] - linked[id(node)]
        node.out = known.outside
        if known.name in WRAPPING:
            node.out = strict and not (id(node) in titled or id(node) in held or 2 * own > plain)
        elif strict and known.named_outside and not node.out and id(node) not in titled:
            constant = node.slot is not None and any(k.slot is not None and k.slot.template for k in node.kids)
            node.out = not known.weakly or constant or 2 * linked[id(node)] > said[id(node)]


def match(page: Node, wrapper: Node) -> None:
    """Gives the page's nodes their slots in the wrapper; what has no place there keeps None."""
    todo = [([page], wrapper)]
    while todo:
        nodes, slot = todo.pop()
        theirs = [k.label for k in slot.kids]
        known = {tuple(k.label for k in kid.kids) for kid in slot.kids if kid.label.startswith("(")}
        for node in nodes:
            node.slot = slot
            if theirs:
                entries = wrap(level(node), known)
                todo.extend((entries[i][2], slot.kids[j]) for i, j in common([e[0] for e in entries], theirs))


def in_order(page: Node) -> Iterator[Node]:
    todo = [page]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.kids))


def extract(page: Node, wrapper: Node) -> str:
    """The main text of a page, its blocks in order.

    The region of the article is found from the top: a part becomes the region while it holds LEADING of the slot
    text there, by the average over the host's pages (the page's own for what has no slot), links left out and the
    priors of its element and class words multiplied in. Of a region everything is kept but what is outside by
    element or class words and what is template, the same on TEMPLATE_PAGES or more pages, before the first or after the
    last text that is not, headings excepted. Headings and texts right before a region that is no article element belong
    to it, unless they are template. If nothing is left, all text that is not outside is taken, then all that is not by
    element.
    """
    match(page, wrapper)
    return main_blocks(page) or main_blocks(page, strict=False)


def main_blocks(page: Node, strict: bool = True) -> str:
    outside(page, strict)
    order = [page]
    for node in order:
        order.extend(node.kids)
    for node in reversed(order):
        if node.label == TEXT:
            node.mass = float(len(node.text) - node.links)
        else:
            node.mass = sum(k.mass for k in node.kids if not k.out)

    region, heads = [page], []
    while True:
        parts: dict[object, list[Node]] = {}
        own = 0.0
        for node in region:
            for kid in node.kids:
                if kid.label == TEXT:
                    own += kid.mass
                elif not kid.out and kid.kids:
                    parts.setdefault(kid.label if kid.slot is None else kid.slot.number, []).append(kid)
        parts = {k: v for k, v in parts.items() if any(n.mass for n in v)}
        if not parts:
            break
        weight = {k: v[0].prior.weight for k, v in parts.items()}
        score = {k: weight[k] * (v[0].slot.mass if v[0].slot is not None and v[0].slot.mass else sum(n.mass for n in v)) for k, v in parts.items()}
        best = max(score, key=score.__getitem__)
        if parts[best][0].prior.name in TEXTUAL or (len(parts[best]) > 1 and weight[best] == 1) or score[best] < LEADING * (own + sum(score.values())):
            break
        if weight[best] < INSIDE_WEIGHT:
            kids = [k for node in region for k in node.kids]
            before = kids[: next(i for i, k in enumerate(kids) if k is parts[best][0])]
            near = next((i for i, k in enumerate(reversed(before)) if k.prior.name not in TEXTUAL), len(before))
            heads += [k for i, k in enumerate(before) if k.prior.name in HEADINGS and weight[best] == 1 or i >= len(before) - near and varies(k)]
        region = parts[best]

    def blocks(tops: list[Node], constant: bool) -> list[str]:
        found: list[str] = []
        fixed: list[bool] = []
        todo = [(n, n) for n in reversed(tops)]
        line = None  # the element whose line goes on, as an element left out inside it does not break it
        while todo:
            node, parent = todo.pop()
            if node.label != TEXT:
                line = line if node.prior.name in INLINE else None
            else:
                template = not constant and parent.prior.name not in HEADINGS and node.slot is not None and node.slot.template
                if line is parent:
                    found[-1] += " " + node.text
                    fixed[-1] = fixed[-1] and template
                else:
                    found.append(node.text)
                    fixed.append(template)
                line = parent
            if not node.out:
                todo.extend((k, node) for k in reversed(node.kids))
        varying = [i for i, f in enumerate(fixed) if not f]
        return found[varying[0] : varying[-1] + 1] if varying else []

    return "\n".join(blocks(heads + region, False) or blocks(heads + region, True) or blocks([page], True))


def varies(node: Node) -> bool:
    """Whether an element before the article's region has text that is neither template nor outside."""
    todo = [node]
    while todo:
        now = todo.pop()
        if now.label == TEXT and not (now.slot is not None and now.slot.template):
            return True
        if not now.out:
            todo.extend(now.kids)
    return False


def host(url):
    """The host of a URL in lower case; empty for a null or odd one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, fan_in: int = 256) -> DataFrame:
    """(host, wrapper string) from (host, html) of all pages. Equal structures of a host count once; they are merged
    in order `fan_in` at a time until a host has one, so no group grows with a host and the order and partitions of
    the pages make no difference."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in text_chunks(batches, "html"):
            made = {(name, dump(generalise([parse(t.decode("utf-8", "replace"))]))) for name, t in zip(batch.column("host").to_pylist(), sources)}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in (0, 1)], names=["host", "wrapper"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [dump(generalise([load(t) for t in sorted(rows["wrapper"])]))]})

    found = write(pages.mapInArrow(read, "host string, wrapper string").distinct()).df
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        lots = F.ceil(F.col("of_host") / fan_in)
        sizes = found.groupBy("host").agg(F.count("*").alias("of_host"))
        dealt = found.join(sizes, "host").withColumn("lot", F.pmod(F.xxhash64("wrapper"), lots))
        found = write(dealt.groupBy("host", "lot").applyInPandas(join, "host string, wrapper string").distinct()).df


#: Wrappers together up to this many characters are broadcast; beyond, they are joined to the pages.
BROADCAST_CHARS = 1 << 25


def by_wrapper(pages: DataFrame, known: DataFrame, columns: list[str], run: Callable, schema, pages_per_lot: int = 20_000) -> DataFrame:
    """run(batch, sources, wrappers) over pages (host, html and `columns`) with each page's loaded wrapper.

    known: host, wrapper, seen. A small set of wrappers is broadcast; a large one is joined to pages dealt over lots
    of about `pages_per_lot`, so that no host fills a task.
    """
    size = known.agg(F.sum(F.length("wrapper") + 40 * F.size("seen"))).first()[0] or 0
    as_dict = lambda seen: {s["node"]: (s["pages"], s["chars"], s["template"]) for s in seen}
    if size <= BROADCAST_CHARS:
        table = {r["host"]: (r["wrapper"], as_dict(r["seen"])) for r in known.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(table)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[str, Node] = {}
            for batch, sources in text_chunks(batches, "html"):
                names = batch.column("host").to_pylist()
                for name in set(names).difference(loaded):
                    loaded[name] = load(*shared.value[name])
                yield from run(batch, sources, [loaded[n] for n in names])

        return pages.select("host", "html", *columns).mapInArrow(mapped, schema)

    lots = pages.groupBy("host").agg(F.ceil(F.count("*") / pages_per_lot).alias("lots"))
    spread = known.join(lots, "host").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots").cast("int") - 1)))
    dealt = pages.join(F.broadcast(lots.where("lots > 1")), "host", "left").withColumn("lot", F.pmod(F.xxhash64("html"), F.coalesce("lots", F.lit(1))).cast("int"))
    joined = dealt.join(spread.select("host", "lot", "wrapper", "seen"), ["host", "lot"]).select("host", "html", "wrapper", "seen", *columns)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Node] = {}
        for batch, sources in text_chunks(batches, "html"):
            if len(loaded) > 2000:
                loaded.clear()
            names = batch.column("host").to_pylist()
            for k, name in enumerate(names):
                if name not in loaded:
                    loaded[name] = load(batch.column("wrapper")[k].as_py(), as_dict(batch.column("seen")[k].as_py()))
            yield from run(batch, sources, [loaded[n] for n in names])

    return joined.mapInArrow(mapped, schema)


SEEN = "array<struct<node:int,pages:long,chars:long,template:boolean>>"


def slots(pages: DataFrame, made: DataFrame) -> DataFrame:
    """(host, wrapper, seen): what all pages of a host have at each node of its wrapper: on how many pages, how many
    characters of its own outside links, and whether it is one and the same text on pages that differ, hence template."""

    def run(batch: pa.RecordBatch, sources: list[bytes], found: list[Node]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, int], list[int]] = {}
        for name, source, wrapper in zip(batch.column("host").to_pylist(), sources, found):
            page = parse(source.decode("utf-8", "replace"))
            match(page, wrapper)
            whole = xxhash.xxh64_intdigest(source) >> 1
            here: dict[int, list[Node]] = defaultdict(list)
            for node in in_order(page):
                if node.slot is not None:
                    here[node.slot.number].append(node)
            for number, parts in here.items():
                said = xxhash.xxh64_intdigest("\n".join(t.text for t in parts).encode("utf-8", "replace")) >> 1
                now = tally.setdefault((name, number), [0, 0, said, said, whole, whole])
                now[0] += 1
                now[1] += sum(len(t.text) - t.links for t in parts)
                now[2:] = min(now[2], said), max(now[3], said), min(now[4], whole), max(now[5], whole)
        names = ["host", "node", "pages", "chars", "text_from", "text_to", "page_from", "page_to"]
        rows = [(*k, *v) for k, v in tally.items()]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], names=names)

    nothing = made.withColumn("seen", F.array().cast(SEEN))
    tallied = by_wrapper(pages, nothing, [], run, "host string, node int, pages long, chars long, text_from long, text_to long, page_from long, page_to long")
    of_node = tallied.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.min("text_from").alias("a"), F.max("text_to").alias("b"), F.min("page_from").alias("c"), F.max("page_to").alias("d"))
    template = (F.col("a") == F.col("b")) & (F.col("c") != F.col("d")) & (F.col("pages") >= TEMPLATE_PAGES)
    of_host = of_node.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "chars", template.alias("template"))).alias("seen"))  # as many as the wrapper has nodes
    return write(made.join(of_host, "host", "left").select("host", "wrapper", F.coalesce("seen", F.array().cast(SEEN)).alias("seen"))).df


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page by its host's wrapper.

    Null html counts as empty and gives empty text; pages without a host share a wrapper. A block is what
    stands between the tags of elements that break lines; its white space becomes single blanks. Repeated
    rows come out once each; other columns are ignored; an empty table gives no rows. Neither the order of the
    rows nor their partitions make a difference.
    """
    dealt = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    known = slots(dealt, wrappers(dealt.select("host", "html")))

    def run(batch: pa.RecordBatch, sources: list[bytes], found: list[Node]) -> Iterator[pa.RecordBatch]:
        out = [extract(parse(s.decode("utf-8", "replace")), wrapper) for s, wrapper in zip(sources, found)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = dealt.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return by_wrapper(dealt, known, ["page_id", "url"], run, schema)
