"""Pages against what a browser shows: hard markup, a second reading of generated pages by the standard library's parser, time in proportion to length."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from kindred.llm import html_text


def text(page):
    return html_text.render(page)[0]


@pytest.mark.parametrize(("page", "want"), [
    ("<p class=it's>Hello</p> <p>World</p>", "Hello\n\nWorld"),
    ("<p a=\"x>y\" b='<p>' =c=d e=f/>Hello", "Hello"),
    ("<table>foo<tr><td>x</table>", "foo\nx"),
    ("<table><tr><td>x</td></tr>bar<tr>baz<td>y</table>z", "barbaz\nx\ny\n\nz"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no</div>", "yes"),
    ("<div style='color:red;display:none'>no</div><div style='x-display:none'>yes</div>", "yes"),
    ("<table><tr><th colspan=2>Head<th>C<tr><td>a<td>bb<td>c</table>", "Head   C\na  bb  c"),
    ("<table><tr><th colspan=2>A long heading<th>C<tr><td>a<td>b<td>c</table>", "A long heading  C\na  b            c"),
    ("<table><tr><td rowspan=2>R<td>1<tr><td>2<tr><td>x<td>3</table>", "R  1\n   2\nx  3"),
    ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
    ("<table><tr><td>é́<td>x<tr><td>ab<td>y</table>", "é́   x\nab  y"),
    ("<table><tr><td><b>a<td>c</b></table>d", "a  c\n\nd"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
    ("<ul hidden><li>no</ul><p>a<ul><li>b</ul>", "a\n\n- b"),
    ("a<br><br>b<pre> x\n  y</pre>", "a\n\nb\n\n x\n  y"),
    ("", ""), ("<!-- x", ""), ("a < b <", "a < b <"), ("<p", ""), ("</p><td>x</li></table>", "x"),
])
def test_pages(page, want):
    assert text(page) == want


class Reader(HTMLParser):
    """The words of a page's visible text, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID:
            self.off.append(tag in ("script", "style", "template") or "hidden" in dict(attrs))

    def handle_endtag(self, tag):
        self.off.pop()

    def handle_data(self, data):
        if not any(self.off):
            self.words += data.split()


@pytest.mark.parametrize("seed", range(30))
def test_second_reading(seed):
    """All visible words, in their order, and no others."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh&<", k=rnd.randint(1, 6)))
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")

    def make(depth):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            tag = rnd.choice(["p", "div", "b", "span", "ul", "table", "h2", "script", "blockquote"])
            at = rnd.choice(["", " class=it's", " hidden", " title=\"a>b\"", " data-x='<p>'", " id=x"])
            if tag == "script":
                parts.append("<script>if (a < b) '</p>'</script>")
            elif tag == "p":
                parts.append(f"<p{at}>{escape(word())} <i>{escape(word())}</i> {escape(word())}</p>")
            elif tag == "ul":
                parts.append(f"<ul{at}>" + "".join(f"<li>{escape(word())}</li>" for _ in range(3)) + "</ul>")
            elif tag == "table":
                parts.append(f"<table{at}>" + "".join("<tr>" + "".join(f"<td>{escape(word())}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif depth and tag in ("div", "blockquote"):
                parts.append(f"<{tag}{at}>{make(depth - 1)}</{tag}>")
            else:
                parts.append(f" <{tag}{at}>{escape(word())}</{tag}> " if tag in ("b", "span") else f"<{tag}{at}>{escape(word())}</{tag}>")
        return "".join(parts)

    page = make(3)
    other = Reader()
    other.feed(page)
    assert re.sub(r"(^|\n) *(- )?", r"\1", text(page)).split() == other.words


@pytest.mark.parametrize("page", [
    lambda n: "<b>" * n + "</i>" * n + "</b>" * n,
    lambda n: "<i><table><tr><td>" + "<b>" * n + "</i>" * n,
    lambda n: "<a " + "x='" * n,
    lambda n: "<" * n + "<a " * n + "\"'" * n + " = " * n,
    lambda n: "<a" + " " * n + "=" * n + ">x",
    lambda n: "<table>" + "<tr><td colspan=1000>x" * (n // 10) + "</table>",
    lambda n: "<p>" * n + "<li>" * n,
])
def test_time_follows_length(page):
    start = time.process_time()
    text(page(5_000))
    middle = time.process_time()
    text(page(40_000))
    assert time.process_time() - middle < 24 * (middle - start) + 0.3


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<p>b<ul><li>c"), (4, "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted((str(r.page_id), r.text[:8], r.n_chars, r.n_blocks, r.n_items, r.n_rows) for r in html_text.extract_text(df).collect())
    assert got == [("1", "", 0, 0, 0, 0), ("2", "", 0, 0, 0, 0), ("3", "a", 1, 1, 0, 0), ("3", "a", 1, 1, 0, 0), ("4", "word wor", 499_999, 1, 0, 0), ("None", "b\n\n- c", 6, 3, 1, 0)]
    assert html_text.extract_text(df.where("false")).count() == 0
