import pytest

from siltstone.operators import chunks as C
from siltstone.operators.markup import converted, markdown_of


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h1>A &amp; B</h1><p>one\n  two <b>bold</b> <i>it</i> <code>x&lt;y</code></p><h3>C</h3>", "# A & B\n\none two **bold** _it_ `x<y`\n\n### C"),
        ("<ul><li>a<li>b<ol start=3><li>c</li><li>d<p>more</p></li></ol></li><li>e</ul>after", "- a\n- b\n  3. c\n  4. d\n\n     more\n\n- e\n\nafter"),
        ("<table><tr><th>k<th>v</tr><tr><td>a|b<td><p>x</p><p>y</p></tr><tr><td>only</tr></table>", "| k | v |\n| --- | --- |\n| a\\|b | x y |\n| only |  |"),
        ("<table><tr><td>o<table><tr><td>i1<td>i2</table></td><td>p</table>", "| o i1 i2 | p |\n| --- | --- |"),
        ("<p>see <a href='http://h/x'>the page</a>, <a>none</a> <img src=i.png alt=pic></p>", "see [the page](http://h/x), none ![pic](i.png)"),
        ("<pre>\n  a\n    <b>b</b> ```\n</pre><p>x</p>", "````\n  a\n    b ```\n````\n\nx"),
        ("<blockquote><p>q1</p><p>q2<br>q3</p></blockquote>z", "> q1\n\n> q2  \n> q3\n\nz"),
        ("<head><title>t</title></head><body><script>if (a < b) {}</script><style>p{}</style>x<!-- no --></body>", "x"),
        ("<p>open <b>never closed<p>next</div></td></li><h2>h", "open **never closed\n\nnext\n\n## h"),
        ("a < b & c &copy; &nope; &#x41;<", "a < b & c © &nope; A<"),
        ("", ""),
        ("<table></table><ul></ul><p> \n </p>", ""),
        ("<h2>\n a\n b </h2><ul><li><p>x</p></li><li></li><li>y</li></ul>", "## a b\n\n- x\n- y"),
    ],
)
def test_markdown(html, want):
    assert markdown_of(html) == want


def test_pages_become_chunks_by_heading(spark):
    """HTML to Markdown to chunks; extra columns stay, null and long pages are whole."""
    long = "<h1>L</h1>" + "".join(f"<p>{'w' * 50} {i}</p>" for i in range(2000))
    rows = [(1, "<h1>T</h1><p>a</p><h2>S</h2><ul><li>b</li></ul>", "k"), (2, None, None), (3, long, "k")]
    out = converted(spark.createDataFrame(rows, "id long, html string, extra string").repartition(2))
    assert out.columns == ["id", "extra", "body"] and {r.id: len(r.body) for r in out.collect()}[2] == 0
    docs = out.selectExpr("string(id) id", "'t' title", "body", "cast(map() as map<string,string>) metadata")
    got = sorted((r.document_id, r.chunk_index, r.title, r.text[:12]) for r in C.chunked(docs, "markdown").collect())
    assert got[:2] == [("1", 0, "T", "T\na"), ("1", 1, "T > S", "T > S\n- b")] and sum(d == "3" for d, *_ in got) > 20
    assert converted(spark.createDataFrame([], "id long, html string")).collect() == []
