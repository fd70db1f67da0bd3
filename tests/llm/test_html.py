import time
from html.parser import HTMLParser

import pytest

from tidegrid.llm import core
from tidegrid.llm.html import extract, html_text, op1

CASES = {
    "a <b>bold</b>  word<br>next": "a bold word\nnext",
    "<p>one<p>two</p>three": "one\n\ntwo\n\nthree",
    "<title>t</title><style>p{}</style><script>var x='</p>';</script><p>seen": "seen",
    "<head><title>t</title>early text": "early text",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>after": "- a\n- b\n  - c\n- d\n\nafter",
    "<ol start=3><li>x</li><li value=9>y</li><li>z</li></ol>": "3. x\n9. y\n10. z",
    "<table><tr><th>name<th>n<tr><td>alpha<td>1<tr><td>b<td>23</table>": "name  | n\nalpha | 1\nb     | 23",
    "<table><tr><td colspan=2>wide cell<td>x</tr><tr><td>a<td>b<td>c</table>": "wide cell | x\na | b | c",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r | 1\n  | 2",
    "<table>stray<tr><td>in</table>": "stray\n\nin",
    "<p>x</p><div hidden>no</div><span style='color:red; display: none'>no</span><div>y": "x\n\ny",
    "<pre>\n a  b\n\tc</pre>d": " a  b\n        c\n\nd",
    "&lt;b&gt; &amp;amp; &copy; &#65;&#x42; &unknown;": "<b> &amp; © AB &unknown;",
    "a<!-- no --->b<!doctype x>c</nope>d < e <3": "abcd < e <3",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<h1>A</h2><div>b</div><div>c</div>": "A\n\nb\nc",
    "x <a href=\"q>r\">y</a><input type=hidden value=n><input type=submit value=Go>": "x yGo",
    "<p>a<!-- open": "a",
    "<a title=\"open": "",
    "": "",
    "<br><br>x<br><br>y": "\n\nx\n\ny",
    "<textarea> a\n b</textarea>": " a\n b",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert extract(html).lstrip("\n") == CASES[html].lstrip("\n")


@pytest.mark.parametrize("html", ["<div>" * 20000 + "x", "<p" * 30000, "<a b='" * 20000, "<table><tr><td>" * 3000 + "x", "</p>" * 20000, "<ul><li>" * 5000 + "x", "&" * 50000, "<" * 50000, "<b>" * 5000 + "<p>" * 5000, "x " * 300000])
def test_hostile_pages(html):
    began = time.process_time()
    extract(html)
    assert time.process_time() - began < 20


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_whole_table_keeps_every_visible_character(spark):
    d = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in core.table(spark, d, "pages").collect()}
    got = op1(spark, d).collect()
    assert len(got) == len(html)
    for r in got:
        p = Plain()
        p.feed(html[r.page_id])
        p.close()
        bare = lambda s: sorted(s.replace("|", "").replace("-", "").split()) if False else sorted("".join(s.split()))
        extra = sum(line.lstrip().startswith("- ") for line in r.text.split("\n"))
        assert abs(len(bare(r.text)) - extra - len(bare("".join(p.words)))) == 0, r.page_id


def test_awkward_rows(spark):
    rows = [(1, "u", "<p>a", 3, "x"), (1, "u", "<p>a", 3, "x"), (None, None, None, None, None), (2, None, "", None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_text(pages, carry=("url", "text"))
    assert got.columns == ["page_id", "url", "text", "text", "n_chars", "n_lines"]
    assert sorted(map(repr, (tuple(r)[3:] for r in got.collect()))) == sorted(map(repr, [("a", 1, 1)] * 2 + [("", 0, 0)] * 2))
    assert html_text(pages.limit(0)).count() == 0
