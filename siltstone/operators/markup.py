"""HTML as Markdown: headings, lists, tables, links, quotes and code are kept.

Pages are read tag by tag, so open or misplaced tags end no page early: a block
that isn't closed ends where the next one begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import shipped

# Elements without text of the page, and elements that stand on lines of their own.
SILENT = {"script", "style", "template", "noscript", "head", "svg", "iframe", "object"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "form", "fieldset", "address", "dl", "dt", "dd", "details", "summary", "body", "html", "hr"}
MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~"}
_SPACE = re.compile(r"[ \t\n\v\f\r]+")


class Reader(HTMLParser):
    """Blocks of Markdown of one page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []  # (an item of a list, text)
        self.text: list[str] = []
        self.lead = ""  # what the next block begins with: a heading's hashes
        self.silent: list[str] = []
        self.lists: list[tuple[str, int]] = []  # (kind, number of the last item)
        self.marker = False
        self.quotes = 0
        self.links: list[str | None] = []
        self.fenced: list[str] | None = None
        self.tables: list[list[list[str]]] = []
        self.outer: list[list[str]] = []  # the text around each open cell

    def flush(self) -> None:
        said = re.sub(r" *\x00 *", "  \n", _SPACE.sub(" ", "".join(self.text))).strip(" \n")
        self.text = []
        if self.tables:  # a block in a cell is a part of the cell
            if said:
                self.text = [said.replace("  \n", " "), " "]
            return
        if not said:
            return
        self.emit(self.lead + said)
        self.lead = ""

    def emit(self, said: str) -> None:
        item, indent = bool(self.lists), ""
        if item:
            depth = len(self.lists) - 1
            widths = [len(self._mark(i)) for i in range(depth + 1)]
            indent = " " * sum(widths)
            if self.marker:
                first = " " * sum(widths[:-1]) + self._mark(depth)
                said = first + said.replace("\n", "\n" + indent)
                self.marker = False
            else:
                item = False
                said = indent + said.replace("\n", "\n" + indent)
        quote = "> " * self.quotes
        self.blocks.append((item, "\n".join(quote + x for x in said.split("\n")) if quote else said))

    def _mark(self, i: int) -> str:
        kind, n = self.lists[i]
        return "- " if kind == "ul" else f"{n}. "

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.silent = []
        if self.silent or tag in SILENT:
            if tag in SILENT:
                self.silent.append(tag)
            return
        if self.fenced is not None and tag != "pre":
            return
        a = dict(attrs)
        if tag in ("ul", "ol"):
            self.flush()
            start = a.get("start") or ""
            self.lists.append((tag, int(start) - 1 if start.isdigit() else 0))
        elif tag == "li":
            self.flush()
            if not self.lists:
                self.lists.append(("ul", 0))
            kind, n = self.lists[-1]
            self.lists[-1] = (kind, n + 1)
            self.marker = True
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.lead = "#" * int(tag[1]) + " "
        elif tag == "blockquote":
            self.flush()
            self.quotes += 1
        elif tag == "pre":
            self.flush()
            self.fenced = []
        elif tag == "br":
            self.text.append("\x00")
        elif tag == "code":
            self.text.append("`")
        elif tag in MARKS:
            self.text.append(MARKS[tag])
        elif tag == "a":
            self.links.append(a.get("href") or None)
            if self.links[-1]:
                self.text.append("[")
        elif tag == "img" and a.get("alt"):
            self.text.append(f"![{a['alt']}]({a.get('src') or ''})")
        elif tag == "table":
            self.flush()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._end_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self._end_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.outer.append(self.text)
            self.text = []
        elif tag in BLOCKS:
            self.flush()

    def _end_cell(self) -> None:
        if self.tables and len(self.outer) >= len(self.tables):
            said = _SPACE.sub(" ", "".join(self.text).replace("\x00", " ")).strip()
            self.tables[-1][-1].append(said.replace("|", "\\|"))
            self.text = self.outer.pop()

    def _end_table(self) -> None:
        self._end_cell()
        rows = [r for r in self.tables.pop() if any(r)]
        if not rows:
            return
        if self.tables:  # a table in a cell is the cell's text
            self.text.append(" ".join(c for r in rows for c in r if c) + " ")
            return
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        self.emit("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))

    def _end_code(self) -> None:
        raw, self.fenced = "".join(self.fenced or []), None
        raw = raw.removeprefix("\n").rstrip()
        if self.tables:
            self.text.append(raw)
        elif raw:
            fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", raw)), default=0))
            self.emit(f"{fence}\n{raw}\n{fence}")

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if self.fenced is not None:
            if tag == "pre":
                self._end_code()
            return
        if tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
            self.marker = False
        elif tag == "li":
            self.flush()
            self.marker = False
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.lead = ""
        elif tag == "blockquote":
            self.flush()
            self.quotes = max(0, self.quotes - 1)
        elif tag == "code":
            self.text.append("`")
        elif tag in MARKS:
            self.text.append(MARKS[tag])
        elif tag == "a" and self.links:
            url = self.links.pop()
            if url:
                self.text.append(f"]({url})")
        elif tag in ("td", "th") and self.tables:
            self._end_cell()
        elif tag == "table" and self.tables:
            self._end_table()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.fenced is not None:
            self.fenced.append(data)
        elif not self.tables or self.outer:  # text between cells is none of a table's
            self.text.append(data.replace("\x00", ""))

    def result(self) -> str:
        self.close()
        if self.fenced is not None:
            self._end_code()
        while self.tables:
            self._end_table()
        self.flush()
        out = ""
        for i, (item, said) in enumerate(self.blocks):
            tight = i and item and self.blocks[i - 1][0]
            out += ("" if not i else "\n" if tight else "\n\n") + said
        return out


def markdown_of(html: str) -> str:
    reader = Reader()
    reader.feed(html)
    return reader.result()


def converted(pages: DataFrame, html: str = "html", into: str = "body") -> DataFrame:
    """Pages with their Markdown in place of the HTML; a null page is an empty text."""
    shipped(pages.sparkSession)
    kept = [c for c in pages.columns if c != html]
    spec = ", ".join(f"`{n}` {t}" for n, t in pages.select(*kept).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):  # bounds what is held besides the batch
                part = b.slice(i, 256)
                said = pa.array([markdown_of(x) if x else "" for x in part.column(part.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], said], names=[*kept, into])

    return pages.select(*kept, F.col(html).cast("string").alias(html)).mapInArrow(run, f"{spec}, `{into}` string")
