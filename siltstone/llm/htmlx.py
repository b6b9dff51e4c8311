"""Main text of web pages by equivalence-class template deduction.

Arasu and Garcia-Molina, "Extracting structured data from Web pages" (SIGMOD
2003). Two kinds of tokens are gathered for each host: the opening or closing of
a container element, told apart by the path of containers around it with their
class, id, role and place among equal siblings; and the whole text of a block.
Tokens that occur once a page and whose occurrence vectors over the host's pages
are equal form an equivalence class; vectors are never gathered, an order-free
fingerprint of (page, count) stands for each. A class counts on two pages or
more, whatever share of the host's pages has them, so each layout of a host has
its own. A second pass over the pages tests the order of each class; elements
that stand out of order on any page leave it. The classes are then nested by the
paths of their elements; the gaps between elements are the template's slots.

A text in a class with elements, so on every page of a layout, is part of the
template and not of any slot's data; a slot whose text over all its pages is
mostly links is a list of links. Both are left out, as is what an element's name
or marks call boilerplate. Where a page has elements for its content, what is
left there is its main text, and template text goes there only if marks call it
boilerplate as well.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Batches, Scratch, map_arrow

#: Fixed: element names by their role in a page.
RAW = frozenset("script style noscript template iframe textarea title svg math select button option object canvas xmp noembed noframes audio video".split())
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table figure details dialog menu search fieldset".split()
)
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address hr figcaption summary hgroup legend center".split()
)
BOILER_NAMES = frozenset("head nav header footer aside form menu dialog search fieldset".split())
CONTENT_NAMES = frozenset("article main".split())
#: Fixed: words in a class, id or role that mark an element's part in a page.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored banner promo promotion cookie cookies consent gdpr "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments "
    "respond replies reply disqus share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login popup modal pagination pager complementary contentinfo".split()
)
#: Words that may mark real paragraphs too: within content the template decides.
WEAK_WORDS = frozenset("notice notices alert side discussion follow overlay widget skip search copyright legal tags".split())
CONTENT_WORDS = frozenset("article content main post entry story articlebody".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z))""", re.S)
_MARK = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
#: Pages on which a text stands at least to be part of a template.
TEXT_PAGES = 3
#: Characters of templates, as counted, up to which they are broadcast.
MAX_BROADCAST = 16 * 1024 * 1024


def _marks(attributes: str) -> str:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    out = ["hidden:"] if "display:none" in attributes.replace(" ", "").lower() else []
    for m in _MARK.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "aria-label":
            continue
        out.append(f"{name}:{_DIGITS.sub('0', value.lower())}")
    return " ".join(out)


def _part(name: str, marks: str) -> int:
    """-2 for a boilerplate element, -1 for one that may be, 1 for a content element, else 0."""
    if name in BOILER_NAMES:
        return -2
    if name in CONTENT_NAMES:
        return 1
    if marks and name not in ("html", "body"):
        words = set(_WORD.findall(re.sub(r"(class|id|role|itemprop|hidden):", " ", marks)))
        if words & BOILER_WORDS or "hidden:" in marks:
            return -2
        if words & WEAK_WORDS:
            return -1
        if words & CONTENT_WORDS:
            return 1
    return 0


class Block(NamedTuple):
    text: str
    token: int
    """Index of the last element token before it."""
    part: int
    """-2 in a boilerplate element, -1 in one that may be, else 0."""
    content: bool
    links: float
    """Share of its characters in links."""


class Page:
    """Element tokens of a page in order, and its text blocks."""

    def __init__(self, source: str | None):
        self.tokens: list[int] = []
        self.blocks: list[Block] = []
        self._text: list[str] = []
        self._links = 0
        self._stack: list[tuple[str, int, int, dict[str, int]]] = []
        self._top: dict[str, int] = {}
        self._in_link = False
        self._own = 0  # part of the paragraph or item itself
        if source:
            self._read(source)
        self._end_block()

    def _end_block(self) -> None:
        if self._text:
            raw = "".join(self._text)
            text = " ".join(html.unescape(raw).split())
            if text:
                parts = [x[2] for x in self._stack]
                part = min(min(parts, default=0), self._own, 0)
                self.blocks.append(Block(text, len(self.tokens) - 1, part, 1 in parts, self._links / max(1, len(raw))))
            self._text, self._links = [], 0

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            i = s.find("<", at)
            if i < 0:
                self._add(s[at:])
                break
            m = _TAG.match(s, i)
            if m is None:  # a bare < is text
                self._add(s[at : i + 1])
                at = i + 1
                continue
            if i > at:
                self._add(s[at:i])
            at = m.end()
            closing, name, attributes, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
            if not name:
                continue  # comment or declaration
            if not end:
                break  # the page ends inside a tag
            name = name.lower()
            if name in RAW and not closing:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(s, at)
                    at = close.end() if close else n
                self._add(" ")
                continue
            if name == "a":
                self._in_link = not closing
            elif name == "br":
                self._add(" ")
            elif name in BLOCKS:
                self._end_block()
                self._own = 0
                if name in CONTAINERS:
                    self._container(name, bool(closing), attributes)
                elif not closing and "=" in attributes:
                    self._own = _part(name, _marks(attributes))

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._links += len(text)

    def _container(self, name: str, closing: bool, attributes: str) -> None:
        if not closing:
            if attributes.rstrip().endswith("/") and name not in ("html", "head", "body"):
                attributes = attributes.rstrip()[:-1]
            if name == "body" and any(x[0] == "head" for x in self._stack):
                self._pop("head")
            marks = _marks(attributes)
            above, siblings = (self._stack[-1][1], self._stack[-1][3]) if self._stack else (0, self._top)
            kind = f"{name}[{marks}]"
            nth = siblings[kind] = siblings.get(kind, 0) + 1
            key = _hash(f"{above}/{kind}{nth}") & ~1  # odd numbers are closings
            part = _part(name, marks)
            if name == "header" and any(x[2] == 1 for x in self._stack):
                part = 0
            self._stack.append((name, key, part, {}))
            self.tokens.append(key)
        else:
            self._pop(name)

    def _pop(self, name: str) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                self.tokens.append(self._stack[k][1] | 1)
                del self._stack[k:]
                return


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    x = xxhash.xxh3_64_intdigest(text)
    return x - 2**64 if x >= 2**63 else x


def _tally(batches: Batches) -> Batches:
    """For each host and token what this batch adds: pages, occurrences, vector fingerprint, place, and the text right after it."""
    for batch in batches:
        tally: dict[tuple[str, int, bool], list[int]] = {}
        for key, host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Page(source)
            counts: dict[tuple[int, bool], int] = {}
            first: dict[int, int] = {}
            for i, t in enumerate(page.tokens):
                counts[t, False] = counts.get((t, False), 0) + 1
                first.setdefault(t, i)
            slots: dict[int, list[int]] = {}
            for x in page.blocks:
                said = _hash(x.text), True
                counts[said] = counts.get(said, 0) + 1
                if x.token >= 0:
                    slot = slots.setdefault(page.tokens[x.token], [0, 0])
                    slot[0] += len(x.text)
                    slot[1] += int(len(x.text) * x.links)
            marks: dict[int, int] = {}
            for (t, is_text), n in counts.items():
                if n not in marks:
                    marks[n] = _hash(f"{key}:{n}")
                x = tally.setdefault((host, t, is_text), [0, 0, 0, 0, 0, 0])
                x[0] += 1
                x[1] += n
                x[2] ^= marks[n]
                if not is_text:
                    x[3] += first[t]
                    if t in slots:
                        x[4] += slots[t][0]
                        x[5] += slots[t][1]
        rows = [(*k, *v) for k, v in tally.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(_TALLY)
        kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_TALLY)


_TALLY = ["host", "token", "is_text", "pages", "total", "vector", "place", "chars", "links"]
_TALLY_SCHEMA = "host string, token long, is_text boolean, pages long, total long, vector long, place long, chars long, links long"


def classes(rows: list[dict]) -> list[list[dict]]:
    """Equivalence classes of a host's elements, each in page order, largest support first.

    Elements that occur once a page belong together if their occurrence vectors
    are equal. A class needs two pages, unless the host has only one.
    """
    n = max((r["pages"] for r in rows), default=0)
    by: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["pages"] == r["total"] and r["pages"] >= min(2, n):
            by.setdefault((r["pages"], r["vector"]), []).append(r)
    found = [sorted(c, key=lambda r: (r["place"] / r["pages"], r["token"])) for c in by.values()]
    return sorted(found, key=lambda c: (-c[0]["pages"], -len(c), c[0]["token"]))


def misplaced(tokens: list[int], place: dict[int, tuple[int, int]]) -> set[int]:
    """A page's tokens that are out of their class's order: those outside a longest run that keeps it.

    ``place``: class and rank of each token of a class.
    """
    seen: dict[int, list[tuple[int, int]]] = {}
    for t in tokens:
        if t in place:
            seen.setdefault(place[t][0], []).append((place[t][1], t))
    out = set()
    for run in seen.values():
        if all(a[0] < b[0] for a, b in zip(run, run[1:])):
            continue
        ends: list[int] = []
        at: list[int] = []
        before: list[int] = []
        for k, (rank, _) in enumerate(run):
            i = bisect_left(ends, rank)
            ends[i : i + 1] = [rank]
            at[i : i + 1] = [k]
            before.append(at[i - 1] if i else -1)
        kept, k = set(), at[-1]
        while k >= 0:
            kept.add(k)
            k = before[k]
        out |= {t for k, (_, t) in enumerate(run) if k not in kept}
    return out


def deduce(rows: list[dict], broken: set[int] = frozenset(), texts: tuple[int, ...] | list[int] = ()) -> dict:
    """A host's template: its elements in order, the slots that are lists of links, and the hashes of its texts.

    ``rows`` are the host's elements with their sums, ``broken`` those that
    ``misplaced`` found on any page, ``texts`` the texts whose vectors equal a
    class's. Classes are nested by their elements' paths: a closing needs its
    opening in the template.
    """
    members = [r for c in classes(rows) for r in c if r["token"] not in broken]
    opened = {r["token"] for r in members}
    members = [r for r in members if not r["token"] & 1 or r["token"] ^ 1 in opened]
    members.sort(key=lambda r: (r["place"] / r["pages"], r["token"]))
    return {"tokens": [r["token"] for r in members], "links": [r["token"] for r in members if 2 * r["links"] > r["chars"]], "texts": sorted(texts)}


def template_texts(rows: list[dict], classes_of: list[list[dict]]) -> list[int]:
    """Texts that occur once a page, on ``TEXT_PAGES`` pages or more, with the vector of a class of elements."""
    vectors = {(c[0]["pages"], c[0]["vector"]) for c in classes_of}
    return [r["token"] for r in rows if r["pages"] == r["total"] and r["pages"] >= TEXT_PAGES and (r["pages"], r["vector"]) in vectors]


def _places(batches: Batches) -> Batches:
    """The classes of each host, as lists of tokens in order."""
    for batch in batches:
        out = [json.dumps([[r["token"] for r in c] for c in classes(rows)]) for rows in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "template"])


def _disorder(batches: Batches) -> Batches:
    """Tokens that are out of order on any page of this partition, once each."""
    told: set[tuple[str, int]] = set()
    made: dict[str, dict] = {}
    for batch in batches:
        new = set()
        for host, source, places in zip(*batch.columns, strict=True):
            t = places.as_py()
            if t is None:
                continue
            if t not in made:
                made[t] = {x: (k, i) for k, c in enumerate(json.loads(t)) for i, x in enumerate(c)}
            new |= {(host.as_py(), x) for x in misplaced(Page(source.as_py()).tokens, made[t])}
        new -= told
        told |= new
        cols = list(zip(*sorted(new), strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["host", "token"])


def _templates(batches: Batches) -> Batches:
    for batch in batches:
        out = [json.dumps(deduce(r, set(b or ()), t or ())) for r, b, t in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "template"])


def main_text(source: str | None, template: dict | None) -> str:
    """Main text of a page under its host's template (``deduce``).

    A text after an element outside the template belongs to the slot of the last
    template element before it. A page of which nothing is left is read by its
    own elements alone.
    """
    page = Page(source)
    template = template or {"tokens": (), "links": (), "texts": ()}
    known, links, texts = (template[k] if isinstance(template[k], (set, frozenset)) else set(template[k]) for k in ("tokens", "links", "texts"))
    slot_of, last = [], None
    for t in page.tokens:
        last = t if t in known else last
        slot_of.append(last)
    live = [x for x in page.blocks if x.part > -2]
    content = [x for x in live if x.content]
    if content:
        chosen = [x for x in content if x.part == 0 or _hash(x.text) not in texts]
    else:
        live = [x for x in live if x.part == 0]
        chosen = [x for x in live if x.links <= 0.5 and _hash(x.text) not in texts and not (x.token >= 0 and slot_of[x.token] in links)]
        chosen = chosen or [x for x in live if x.links <= 0.5]
    return "\n\n".join(x.text for x in chosen)


def _extract(batches: Batches) -> Batches:
    for batch in batches:
        page_id, url, source, template = batch.columns
        made: dict[str, dict] = {}
        out = []
        for s, t in zip(source, template, strict=True):
            t = t.as_py()
            if t is not None and t not in made:
                made[t] = {k: frozenset(v) for k, v in json.loads(t).items()}
            out.append(main_text(s.as_py(), made.get(t)))
        n = pa.array([len(x) for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays([page_id, url, pa.array(out, pa.string()), n], names=["page_id", "url", "text", "n_chars"])


def host_of(url: str) -> Column:
    """Lower-cased host of a URL, without port and user; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":.*$", ""))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    Null or empty html gives an empty text; very long pages are read whole.
    Pages without a host in their url share one template. Rows that repeat a
    page are extracted each, and each counts in its host's vectors. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of("url"))
    tally = map_arrow(hosted.select(F.monotonically_increasing_id().alias("page"), "host", "html"), _tally, _TALLY_SCHEMA)
    sums = tally.groupBy("host", "token", "is_text").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "place", "chars", "links")), F.bit_xor("vector").alias("vector"))
    scratch = Scratch(pages.sparkSession, "html")
    once = scratch.save(sums.where(f"pages = total and (not is_text or pages >= {TEXT_PAGES})"), "once")
    # Classes first: what goes to a host's task is bounded by its markup, not its pages.
    most = once.where("not is_text").groupBy("host").agg(F.max("pages").alias("n"))
    elements = once.where("not is_text").join(most, "host").where("pages >= least(2, n)")
    fields = [c for c in _TALLY if c not in ("host", "is_text")]
    grouped = scratch.save(elements.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("rows")), "classes")
    vectors = elements.select("host", "pages", "vector").distinct()
    said = once.where("is_text").join(vectors, ["host", "pages", "vector"], "left_semi")
    said = said.groupBy("host").agg(F.collect_list("token").alias("texts"))
    places = scratch.save(map_arrow(grouped, _places, "host string, template string"), "places")
    tested = _with_templates(hosted, places).select("host", "html", "template")
    broken = map_arrow(tested, _disorder, "host string, token long").groupBy("host").agg(F.collect_set("token").alias("broken"))
    all_of = grouped.join(broken, "host", "left").join(said, "host", "left").select("host", "rows", "broken", "texts")
    templates = scratch.save(map_arrow(all_of, _templates, "host string, template string"), "templates")
    return map_arrow(_with_templates(hosted, templates).select("page_id", "url", "html", "template"), _extract, "page_id long, url string, text string, n_chars long")


def _with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates that fit go to the pages; many hosts' templates meet their pages in a shuffled join, whose hot hosts adaptive execution splits."""
    size = templates.agg(F.sum(F.length("host") + F.length("template"))).first()[0] or 0
    return pages.join(F.broadcast(templates) if size <= MAX_BROADCAST else templates.hint("merge"), "host", "left")
