import html as h
import random
import re

import pyarrow as pa

from siltstone.llm import htmlx
from siltstone.llm.htmlx import Page, classes, deduce, extract_pages, main_text, misplaced, template_texts

SCHEMA = "page_id long, url string, html string, template string"


def page(body, menu="Home"):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">{menu}</a></li></ul></nav>{body}<footer>&copy; x</footer></body></html>'


def test_article_pages_against_a_regular_expression(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        ps = ["".join(rnd.choice("abc &<é ") for _ in range(30)) for _ in range(rnd.randint(0, 5))]
        body = '<div class="ad">Buy</div><article><h1>Head &amp; x</h1>' + "".join(f"<p>{h.escape(p)}</p>" for p in ps) + "</article>"
        rows.append((i, f"http://h{i % 3}.example.com/p{i}", page(body), "x"))
    want = {}
    for i, _, s, _ in rows:
        parts = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", s, re.S)[1])
        want[i] = "\n\n".join(t for t in (" ".join(h.unescape(p).split()) for p in parts) if t)
    rows += [(100, None, None, None), (101, "", "", None), (102, "nohost", "<p>Alone &amp; short", None), (103, "http://h1.example.com/", page("<article><p>cut <b>off</b> here &am"), None),
             (104, "http://h1.example.com/", "<html><body><nav>x</nav><article><p>ends in a tag <a hre", None)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: got[i].text for i in want} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert (got[100].text, got[101].text, got[102].text) == ("", "", "Alone & short")
    assert got[103].text.startswith("cut off here &am") and got[104].text == "ends in a tag"
    assert extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def tally(pages):
    """(element rows, text rows) of pages of one host."""
    batch = pa.RecordBatch.from_pylist([{"k": i, "u": "a.b", "h": s} for i, s in enumerate(pages)])
    rows = [r for b in htmlx._tally(iter([batch])) for r in b.to_pylist()]
    return [r for r in rows if not r["is_text"]], [r for r in rows if r["is_text"]]


def template(pages, broken=frozenset()):
    elements, texts = tally(pages)
    return deduce(elements, broken, template_texts(texts, classes(elements)))


def plain(i, notice="We use cookies on this site. Read how and why before you go on.", tail="All rights reserved"):
    """Containers without any marks."""
    return f'<html><body><div><a href="/">Home</a> <a href="/n">News {i}</a></div><div>{notice}</div><div><p>Story number {i} of the day.</p><p>It goes on for a while, part {i * 7}.</p></div><div>{tail}</div></body></html>'


def story(i):
    return f"Story number {i} of the day.\n\nIt goes on for a while, part {i * 7}."


def test_pages_without_any_marks(spark):
    """Link bar, fixed notice and fixed last line go by the template alone; without it they stay."""
    pages = [plain(i) for i in range(6)]
    t = template(pages)
    assert [main_text(p, t) for p in pages] == [story(i) for i in range(6)]
    for gone in (None, t | {"texts": ()}):
        assert main_text(pages[2], gone) != story(2)
    rows = [(i, "http://plain.example.com/", p, None) for i, p in enumerate(pages)]
    assert {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: story(i) for i in range(6)}


def test_a_link_that_is_text_on_one_page():
    """The slot is a list of links over all pages, also where one entry isn't a link."""
    bar = lambda i: "<div>" + " ".join(f'<a href="/{k}">Part {k}</a>' if k != i else f"Part {k}" for k in range(6)) + "</div>"
    pages = [f"<body>{bar(i)}<div>Where am I? {i}</div></body>" for i in range(6)]
    lone = pages[3].replace('<a href="/', "<b x='").replace("</a>", "</b>")
    t = template(pages)
    assert main_text(lone, t) == "Where am I? 3" != main_text(lone, None)


def test_vectors_decide():
    """Two layouts on four pages each; a story that four pages of both carry is no template text, though their numbers are equal."""
    a = [f"<body><div>{'One and the same story.' if i < 2 else f'Story {i}.'}</div><section>Layout A</section></body>" for i in range(4)]
    b = [f"<body><ul><li>{'One and the same story.' if i < 2 else f'Tale {i}.'}</ul><aside>x</aside><section><div>Layout B</div></section></body>" for i in range(4)]
    elements, texts = tally(a + b)
    t = deduce(elements, set(), template_texts(texts, classes(elements)))
    assert main_text(a[0], t) == "One and the same story." == main_text(b[1], t)
    assert main_text(a[3], t) == "Story 3."
    for r in elements + texts:
        r["vector"] = 0  # vectors that tell nothing
    t = deduce(elements, set(), template_texts(texts, classes(elements)))
    assert main_text(a[3], t) == "Story 3." and main_text(a[0], t) != main_text(b[1], t)


def test_copies_are_no_template():
    """Two copies among other pages, and a host whose pages are all copies."""
    pages = [plain(i // 2) for i in range(8)]
    t = template(pages)
    assert [main_text(p, t) for p in pages] == [story(i // 2) for i in range(8)]
    same = [plain(1, notice="x", tail="y")] * 4
    assert story(1) in main_text(same[0], template(same))


def vectors(pages):
    out = {}
    for i, p in enumerate(pages):
        for t in Page(p).tokens:
            out.setdefault(t, {}).setdefault(i, 0)
            out[t][i] += 1
    return out


def test_classes_against_gathered_vectors():
    """Fingerprints give the classes that whole occurrence vectors give."""
    rnd = random.Random(3)
    parts = [lambda i: "<div class='a'>x</div>", lambda i: "<section><ul></ul></section>", lambda i: f"<div>{i}<div>b</div></div>", lambda i: "<table></table>" * (i % 3), lambda i: "<nav>n</nav>"]
    for _ in range(20):
        pages = ["<body>" + "".join(f(i) for f in parts if rnd.random() < 0.7) + "</body>" for i in range(rnd.randint(1, 9))]
        want = {}
        for t, v in vectors(pages).items():
            if set(v.values()) == {1} and len(v) >= min(2, len(pages)):
                want.setdefault(frozenset(v), set()).add(t)
        got = classes(tally(pages)[0])
        assert sorted(map(sorted, want.values())) == sorted(sorted(r["token"] for r in c) for c in got)
        place = {t: k for k, t in enumerate(Page(pages[0]).tokens)}
        for c in got:
            if all(r["token"] in place for r in c):
                assert [place[r["token"]] for r in c] == sorted(place[r["token"]] for r in c)


def test_template_without_content_elements():
    """No article: the varying slot is the text; the static one and the links go."""
    pages = [page(f'<div class="top">Always the same line</div><div class="x{i}">Story number {i} of the day</div><div class="rel"><a href="#">Link {i}</a></div>') for i in range(5)]
    assert main_text(pages[2], template(pages)) == "Story number 2 of the day"


def test_boilerplate_inside_the_article():
    body = '<article><header><h1>Title</h1></header><p>One<br>two</p><aside>side</aside><div class="comments"><p>Nice!</p></div><p class="ad">Buy</p><div style="display: none">no</div><form><p>Mail</p></form><p>Three</p></article>'
    assert main_text(page(body), template([page(body)] * 3)) == "Title\n\nOne two\n\nThree"


def test_marks_that_real_paragraphs_have_too():
    """Within content a notice goes if the template has its text, and stays if its text is the page's own."""
    pages = [page(f'<article><p>Text {i}</p><p class="alert">Mind {i} things</p><section class="legal"><p>The law of {i}</p></section><p class="notice">Fixed notice</p></article>') for i in range(4)]
    assert main_text(pages[1], template(pages)) == "Text 1\n\nMind 1 things\n\nThe law of 1"
    assert main_text(pages[1], None).endswith("Fixed notice")


def test_odd_markup():
    assert [b[0] for b in Page('<p title="a > b">x < y &lt; z<!-- > --></p><style>p{}</style>q').blocks] == ["x < y < z", "q"]
    assert Page("<p>a<script>never closed").blocks[0][0] == "a"


def test_layouts_on_under_half_of_the_pages(spark):
    """Three layouts of a host, each on a third of its pages: each page keeps its own varying slot and drops its own static one."""
    rows = []
    for i in range(12):
        k = "abc"[i % 3]
        rows.append((i, "http://many.example.com/", page(f'<div class="t{k}">Static {k} line</div><div class="s{k}">Story {i} told</div>'), None))
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Story {i} told" for i in range(12)}


def test_tokens_out_of_order_leave_their_class():
    place = {t: (0, i) for i, t in enumerate(range(2, 12, 2))} | {90: (1, 0)}
    assert misplaced([2, 4, 90, 6, 8, 10], place) == set()
    assert misplaced([10, 2, 4, 6, 90, 8], place) == {10}
    pages = [page(f'<div class="p">{i}</div><section class="q">Text {i}</section>') for i in range(4)]
    whole = template(pages)
    out = template(pages, {whole["tokens"][5]})
    assert whole["tokens"][5] not in out["tokens"] and len(out["tokens"]) < len(whole["tokens"])


def test_deep_long_and_repeated_pages(spark):
    """No depth or length ends the reading; rows that repeat a page are each read."""
    deep = lambda i: "<body>" + "<div>" * 300 + f"<div>Fixed words here</div><div>Deep story {i}</div>" + "</div>" * 300 + "</body>"
    long = page("<article>" + "".join(f"<p>Paragraph {k} of very many.</p>" for k in range(30_000)) + "</article>")
    rows = [(i, "http://deep.example.com/", deep(i), "x") for i in (0, 1, 2, 2, 3)] + [(9, "http://long.example.com/", long, "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert sorted((r.page_id, r.text) for r in got if r.page_id < 9) == [(i, f"Deep story {i}") for i in (0, 1, 2, 2, 3)]
    assert [r.text.count("\n\n") for r in got if r.page_id == 9] == [29_999]
