"""Pages' text, headings, facts and cells against Python's own HTML parser and hand-made fixtures."""

import re
from html.parser import HTMLParser

import duckdb
import pytest

from tallyfold.plans import registry
from tallyfold.sources import html as H
from tallyfold.sources.markup import Page

from .test_queries import rows


class Pieces(HTMLParser):
    """Texts between tags, and bold runs, which end at their end tag, a paragraph's start or their block's end."""

    def __init__(self, html):
        super().__init__()
        self.pieces, self.bold, self.now, self.raw = [], [], None, None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.raw = tag if tag in ("script", "style") else None
        if tag == "p":
            self.now = None
        if tag in ("b", "strong"):
            self.now = []
            self.bold.append(self.now)

    def handle_endtag(self, tag):
        self.raw = None
        if tag in ("b", "strong", "p", "article", "body"):
            self.now = None

    def handle_data(self, data):
        if not self.raw:
            self.pieces.append(data)
            if self.now is not None and data.strip():
                self.now.append(data.strip())


def test_all_pages_against_the_parser_of_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    want = {r.page_id: Pieces(r.html) for r in pages.collect()}
    for r in H.parsed(pages).collect():
        text = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(want[r.page_id].pieces)))
        assert r.text == text and "&amp;" not in r.text
        bold = [" ".join(b) for b in want[r.page_id].bold]
        assert [e.text for e in r.elements if e.tag in ("b", "strong")] == [b for b in bold if 0 < len(b) <= 200]


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<h1>AT&amp;T caf&eacute;&#160;&#x41;</h1>", {"h1": ["AT&T café\xa0A"]}),
        ("<div>a<div>b</div>c</div>", {"div": ["a b c", "b"]}),
        ("<p>one<p>two<br>three<img src='x>y'>four", {"p": ["one", "two three four"]}),
        ("<p><b>bold<p>not bold", {"p": ["bold", "not bold"], "b": ["bold"]}),
        ("<h2>head<p>body</h2>more", {"h2": ["head"], "p": ["body more"]}),
        ("<b>a<b>b</b>c</b>", {"b": ["a b c", "b"]}),
        ("<div><b>x</div>y</b>z", {"div": ["x"], "b": ["x"]}),
        ("<b>x<div>y</b>z</div>w", {"div": ["y z"], "b": ["x y z w"]}),
        ("<span title=\"a > b\">in</span><a>out", {"span": ["in"], "a": ["out"]}),
        ("<noscript><h1>hidden</h1></noscript><h1>shown</h1><script>if (a < b) '<h1>no</h1>'</script>", {"h1": ["shown"]}),
        ("<!-- <h1>no</h1> --><!DOCTYPE x><?php <h1> ?><h1>a < b</h1", {"h1": ["a < b"]}),
        ("<strong>unended &amp", {"strong": ["unended &"]}),
        ("</p></div><p", {}),
        ("", {}),
    ],
)
def test_elements(html, texts):
    got = {}
    for e in Page(html).elements():
        got.setdefault(e["tag"], []).append(e["text"])
    assert got == texts


def cells(html):
    return [(c["table_number"], c["row_header"], c["col_header"], c["value"]) for c in Page(html).cells()]


def test_tables():
    assert cells("<table><tr><td>k<td>a<td>b<tr><td>x<td>1<td>-</table>") == [(1, "x", "a", "1")]
    assert cells("<table><thead><tr><td>t</td></tr><tr><th>k</th><th>A&amp;B</th></tr></thead><tbody><tr><td></td><td>5</td><td>6</td></tr></table>") == [(1, "", "A&B", "5"), (1, "", "", "6")]
    assert cells("<table><tr><td>only</td><td>one</td></tr></table>") == []
    inner = "<table><tr><th>h</th><th>v</th></tr><tr><td>r</td><td><table><tr><td>p</td><td>q</td></tr><tr><td>s</td><td>7</td></tr></table></td></tr></table>"
    got = cells(inner)
    assert (1, "r", "v", "p q s 7") in got and (1, "s", "v", "7") in got and (2, "s", "q", "7") in got


def test_facts_and_headings(spark):
    page = (
        "<ix:nonFraction name='us-gaap:Assets' contextRef=\"c&amp;1\" unitRef=USD scale='3'><span>1,</span> 200</ix:nonFraction><ix:nonNumeric name='dei:X'>" + "<p>ab</p>" * 300 + "</ix:nonNumeric>"
        "<div style='FONT-SIZE: 12pt; font-weight:700'>Risk &amp; <span>Reward</span></div><span style='font-size:9pt'>tiny</span><p style='font-size:15pt'>Large</p><td>Item 1A.</td><a>item 1a.</a><b>1,234</b><b>" + "w " * 13 + "</b>"
    )
    d = H.parsed(spark.createDataFrame([(1, page), (2, None), (3, "<h3>" + "x" * 300 + "</h3>")], "page_id long, html string"))
    assert [(r.name, r.context, r.value, r.unit, r.scaled) for r in H.facts(d).collect()] == [("us-gaap:Assets", "c&1", "1,200", "x10^3", 1200000.0)]
    assert [r.value for r in H.text_facts(d).collect()] == ["ab" * 100]
    assert [(r.text, r.font_size, r.is_bold) for r in H.styled_headings(d).orderBy("pos").collect()] == [("Risk & Reward", 12.0, True), ("Large", 15.0, False)]
    assert [r.text for r in H.section_markers(d).collect()] == ["Item 1A."]
    assert H.bold_headings(d).count() == H.level_headings(d).count() == 0
    assert [r.level for r in H.headings(d).orderBy("level", "pos").collect()] == [9, 9, 10, 10]


def test_pages_of_headings():
    html = "<h1>First</h1>" + "x" * 6000 + "<h1>Second</h1>"
    assert Page(html).raw[0] == "First" and len(Page(html).raw) == 3


def test_long_and_deep_markup_ends():
    assert len(Page("<div>" * 20_000 + "x").nodes) == 20_000
    assert Page("<a <a " * 20_000).raw == [] and Page('<a "' * 5_000 + "b").elements() is not None
    assert Page("<p>" * 50_000).flat == [] and Page("<" * 100_000).flat == ["<" * 100_000]


@pytest.mark.parametrize("name", ["html_text", "html_headings", "heading_dedupe", "clean_headings", "section_text", "section_chunks"])
def test_references_without_semicolon_against_sql(spark, tmp_path, name):
    """Headings that were cut inside a reference."""
    cut = ["token = &quot", "token = &quot;", "A &amp", "A &amp;", "A &ampx;", "A &quotx;", "&quot&amp;", "A &copy", "A &middot;", "a &quo", "a & b", "&amp;quot;"]
    pages = [(i, "https://a.b/c", f"<title>{c}</title><h1>{c}</h1><p>{'word ' * 20}{c}</p>") for i, c in enumerate(cut)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = registry.queries()[name](spark, str(tmp_path))
    got = duck.execute(registry.oracles()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())
