"""Pages to rows: the one place where markup is tokenised in Python; all after it is relational."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "dt", "dd", "a", "div", "span"}
SKIPPED = {"script", "style", "noscript", "template"}
SCHEMA = "page_id long, url string, seq int, tag string, level int, text string, href string, tr int, cell int, parent int"


class _Blocks(HTMLParser):
    """Rows (seq, tag, level, text, href, tr, cell, parent) of a page, in the order of their opening tags; parent is the
    number of the row around, or -1."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []
        self.skip = self.depth = self.tr = self.cell = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ("ul", "ol"):
            self.depth += 1
        elif tag == "tr":
            self.tr, self.cell = self.tr + 1, 0
        elif tag == "br":
            self.handle_data("\n")
        elif tag in BLOCKS:
            if tag in ("li", "p", "td", "th", "dt", "dd"):
                self._close(tag, self.depth)
            if tag in ("td", "th"):
                self.cell += 1
            row = [len(self.rows), tag, self.depth, [], dict(attrs).get("href"), self.tr, self.cell if tag in ("td", "th") else 0, self.open[-1][0] if self.open else -1]
            self.rows.append(row)
            self.open.append(row)

    def _close(self, tag, depth=None):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag and (depth is None or self.open[k][2] == depth):
                del self.open[k:]
                return

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            self.open = [r for r in self.open if r[2] < self.depth or r[1] != "li"]
            self.depth = max(0, self.depth - 1)
        elif tag in BLOCKS:
            self._close(tag)

    def handle_data(self, data):
        if not self.skip:
            for row in self.open:
                row[3].append(data)


def _spread(pages: DataFrame) -> DataFrame:
    """Pages in partitions by page_id: pages of few files would be parsed in as few tasks."""
    return pages.select("page_id", "url", "html").repartition("page_id")


def html_blocks(pages: DataFrame) -> DataFrame:
    """Rows of each page (page_id, url, html).  Null and empty pages have none; bad markup is read as far as it goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"]):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                out += [(page_id, url, r[0], r[1], r[2], " ".join("".join(r[3]).split()), *r[4:]) for r in parser.rows]
            yield pd.DataFrame(out, columns=["page_id", "url", "seq", "tag", "level", "text", "href", "tr", "cell", "parent"])

    return _spread(pages).mapInPandas(run, SCHEMA)


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = ("h1", "h2", "h3", "h4")
LINE_SCHEMA = "page_id long, url string, seq int, text string, path array<int>, tags array<string>"


class _Lines(HTMLParser):
    """Texts of a page with the elements around them, by number and tag, and a row without text for each heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[tuple[int, str]] = [(0, "")]
        self.number, self.data = 0, ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.number += 1
        if tag in VOID:
            return
        self.open.append((self.number, tag))
        if tag in HEADINGS:
            self._row(None)

    def handle_endtag(self, tag):
        self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][1] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.data += data

    def flush(self):
        data, self.data = self.data.strip(), ""
        if data and not any(t in SKIPPED for _, t in self.open):
            self._row(data)

    def _row(self, data):
        self.rows.append((len(self.rows), data, [n for n, _ in self.open], [t for _, t in self.open]))


def html_lines(pages: DataFrame) -> DataFrame:
    """The texts of each page in order, with the elements around each: numbers rise in the order of opening tags.

    Headings of the first four ranks have a row more, with a null text.  Null and empty pages have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"]):
                parser = _Lines()
                parser.feed(html or "")
                parser.close()
                parser.flush()
                out += [(page_id, url, *r) for r in parser.rows]
            yield pd.DataFrame(out, columns=["page_id", "url", "seq", "text", "path", "tags"])

    return _spread(pages).mapInPandas(run, LINE_SCHEMA)


OUTLINE_SCHEMA = "page_id long, url string, body string, labels map<string, string>, sections array<string>"


def _labels(rows: list[tuple]) -> dict[str, str]:
    """The first two cells of each table row (label, lower-cased, and value), of equal labels the first."""
    tables: dict = defaultdict(lambda: defaultdict(list))
    for _, text, path, tags in rows:
        at = tags.index("tr") if text is not None and "tr" in tags else None
        cell = max((tags.index(t) for t in ("td", "th") if t in tags), default=-1)
        if at is not None and cell > at:
            tables[path[at]][path[cell]].append(text)
    out: dict[str, str] = {}
    for _, cells in sorted(tables.items()):
        if len(cells) >= 2:
            label, value = (" ".join(cells[n]) for n in sorted(cells)[:2])
            out.setdefault(label.lower(), value)
    return out


def _sections(rows: list[tuple], heading: re.Pattern) -> list[str]:
    """What stands beside each heading that matches, up to the next heading beside it, in the order of headings.

    A heading that ends at once is in the order of openings, so only elements count that begin
    behind it within the same parent; bare text beside it does not.
    """
    beside: dict[int, list[int]] = defaultdict(list)
    names: dict[int, list[str]] = {}
    for _, text, path, tags in rows:
        if text is None:
            beside[path[-2]].append(path[-1])
            if tags[-1] != "h1":
                names[path[-1]] = []
        else:
            for number in path:
                if number in names:
                    names[number].append(text)
    wanted = {n for n, parts in names.items() if parts and heading.search(" ".join(parts).lower())}
    found: dict[int, list[str]] = defaultdict(list)
    for _, text, path, _ in rows if wanted else ():
        if text is not None:
            for parent, element in zip(path, path[1:]):
                at = bisect_right(beside[parent], element) - 1 if parent in beside else -1
                if at >= 0 and beside[parent][at] != element and beside[parent][at] in wanted:
                    found[beside[parent][at]].append(text)
    return [" ".join(parts) for _, parts in sorted(found.items())]


def html_outlines(pages: DataFrame, heading: str) -> DataFrame:
    """A row a page with text: its texts (``html_lines``), one a line, the labels of its table rows, and the sections of headings that match.

    All are of one page, so pages are parsed once and nothing is joined, sent or shuffled behind that.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(heading)
        for b in batches:
            out = []
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"]):
                parser = _Lines()
                parser.feed(html or "")
                parser.close()
                parser.flush()
                texts = [r[1] for r in parser.rows if r[1] is not None]
                if texts:
                    out.append((page_id, url, "\n".join(texts), _labels(parser.rows), _sections(parser.rows, wanted)))
            yield pd.DataFrame(out, columns=["page_id", "url", "body", "labels", "sections"])

    return _spread(pages).mapInPandas(run, OUTLINE_SCHEMA)
