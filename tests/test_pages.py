"""Page extraction on a small paper page with the markup the operators know."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import headings as hd
from sparkfolio.operators import links as lk, pages as pg

PAGE = """
<!DOCTYPE html><html><head><title>no</title><script>var a = "<p>x</p>";</script></head><body>
<div class="ltx_page_footer">Footer text</div>
<article class="ltx_document">
<h1 class="ltx_title ltx_title_document">A Study of
 Widgets<span class="ltx_note_mark">1</span></h1>
<p class="ltx_p">Find it at <a href="https://github.com/ann/widgets.git">our code</a>.</p>
<div class="ltx_abstract"><h6 class="ltx_title ltx_title_abstract">Abstract</h6><p class="ltx_p">We study widgets &amp; more.</p></div>
<section class="ltx_section"><h2 class="ltx_title ltx_title_section"><span class="ltx_tag">1</span> Introduction</h2>
<p class="ltx_p">Not kept.</p></section>
<section class="ltx_section"><h2 class="ltx_title ltx_title_section">2 Widget Core</h2>
<p class="ltx_p">Core idea <math alttext="\\alpha_{1}\\leq 2" display="inline"><mi>junk</mi></math>. We train on 8 A100 GPUs for days.</p>
<section><h3 class="ltx_title ltx_title_subsection">2.1 Training Details</h3><p class="ltx_p">Batch of 32.</p>
<section><h4 class="ltx_title ltx_title_subsubsection">2.1.1 Schedule</h4><p class="ltx_p">Cosine.</p></section></section>
<section><h3 class="ltx_title ltx_title_subsection">2.2 Losses</h3><p class="ltx_p">Plain loss.</p></section></section>
<section class="ltx_section"><h2 class="ltx_title ltx_title_section">3 Experiments</h2>
<p class="ltx_p">We compare with the baseline from <a href="https://github.com/bob/base">Bob</a>.</p>
<figure class="ltx_table" id="S3.T1"><figcaption class="ltx_caption"><span class="ltx_tag">Table 1: </span>Main scores</figcaption>
<table class="ltx_tabular"><tr><th rowspan="2">Model</th><th colspan="2">Score</th></tr><tr><td>Dev</td><td>Test</td></tr>
<tr><td>Ours</td><td>1.5</td><td>2.5</td></tr></table></figure>
<table class="ltx_tabular"><tr><td>layout only</td></tr></table></section>
<section class="ltx_section"><h2 class="ltx_title ltx_title_section">4 What Comes Next</h2><p class="ltx_p">After tests.</p></section>
<section class="ltx_appendix"><h2 class="ltx_title ltx_title_appendix">Appendix A Proof Details</h2><p class="ltx_p">Hidden proof.</p></section>
<section class="ltx_bibliography"><h2 class="ltx_title ltx_title_bibliography">References</h2><ul>
<li class="ltx_bibitem"><span class="ltx_tag ltx_tag_bibitem">[1]</span><span class="ltx_bibblock">A. Author.</span>
<span class="ltx_bibblock">Learning about widgets.</span><span class="ltx_bibblock">arXiv:2101.00001v2, 2021.</span></li>
<li class="ltx_bibitem"><span class="ltx_bibblock">B. Writer (2019). Gears and their friends. In Proc. <a href="https://doi.org/10.1000/xyz.1">doi</a></span></li>
<li class="ltx_bibitem"><span class="ltx_bibblock">C. "A quoted title here", vol. 3. <a href="https://github.com/bib/only">code</a></span></li>
</ul></section></article><footer>Bye</footer></body></html>
"""
BROKEN = ["", "<", "<div", "</p></p></div>", "<p class=ltx_p>open <b>never closed", "<table class='ltx_tabular'><tr><td>x", "a & b &#99999999; &bogus;", "<!-- open comment"]


@pytest.fixture(scope="module")
def page(spark):
    df = spark.createDataFrame([("p1", PAGE)], "page_id string, html string")
    ev = pg.routed_events(df)
    heads = pg.headings(ev)
    return df, ev, heads, pg.scoped_events(ev, heads)


def test_sections(page):
    got = {r["section"]: r["text"] for r in pg.sections(page[0]).collect()}
    assert got["abstract"] == "We study widgets & more."
    assert got["methodology"].startswith("2 Widget Core\nCore idea α_1≤ 2. We train on 8 A100 GPUs for days.")
    assert "2.2 Losses\nPlain loss." in got["methodology"] and "Batch of 32" not in got["methodology"]
    assert got["setup"].startswith(pg.HARDWARE_PREFIX + "\nWe train on 8 A100 GPUs for days.\n")
    assert "Batch of 32." in got["setup"] and "Cosine." in got["setup"]
    assert "[Table 1 Main scores]\nModel | Score | Score" in got["experiments"] and "After tests." in got["experiments"]
    assert not any("Hidden proof" in t or "Not kept" in t or "Footer" in t or "Learning about" in t for t in got.values())


def test_headings(page):
    rows = [(r["title"], r["top_kind"], r["sub_kind"]) for r in page[2].orderBy("pos").collect()]
    assert rows == [
        ("1 Introduction", None, None), ("2 Widget Core", "methodology", None), ("2.1 Training Details", "methodology", "setup"),
        ("2.1.1 Schedule", "methodology", "setup"), ("2.2 Losses", "methodology", None), ("3 Experiments", "experiments", None),
        ("4 What Comes Next", "experiments", None), ("Appendix A Proof Details", None, None), ("References", "references", None)]
    assert pg.doc_title(page[1]).first()["title"] == "A Study of Widgets"


def test_tables(page):
    rows = pg.tables(page[1], page[3]).collect()
    assert len(rows) == 1
    t = rows[0]
    assert (t["label"], t["caption"], t["section"]) == ("Table 1", "Main scores", "3 Experiments")
    assert t["rows"] == [["Model", "Score", "Score"], ["Model", "Dev", "Test"], ["Ours", "1.5", "2.5"]]


def test_references(page):
    rows = pg.references(page[1], pg.anchors(page[3])).orderBy("ref_index").collect()
    assert [(r["title"], r["arxiv_id"], r["doi"]) for r in rows] == [
        ("Learning about widgets", "2101.00001", None), ("Gears and their friends", None, "10.1000/xyz.1"), ("A quoted title here", None, None)]
    assert rows[0]["text"] == "A. Author. Learning about widgets. arXiv:2101.00001v2, 2021."


def test_links(page):
    rows = {r["url"]: r for r in lk.links(page[3], pg.anchors(page[3])).collect()}
    assert set(rows) == {"https://github.com/ann/widgets", "https://github.com/bob/base", "https://github.com/bib/only"}
    own, base, bib = (rows[u] for u in ("https://github.com/ann/widgets", "https://github.com/bob/base", "https://github.com/bib/only"))
    assert own["is_primary"] and own["context"] == "Find it at our code ."
    assert not base["is_primary"] and not base["in_bibliography"]
    assert bib["in_bibliography"] and not bib["is_primary"]
    assert [r["url"] for r in lk.code_urls(lk.links(page[3], pg.anchors(page[3]))).collect()] == ["https://github.com/ann/widgets"]


def test_link_forms(spark):
    urls = ["https://www.github.com/A/b.git.", "https://github.com/login/x", "https://github.com/only", "http://demo.github.io/page/",
            "https://sub.arxiv.org/abs/1", "https://arxiv.org/abs/1", "https://huggingface.co/m/n?x=1", "https://lab.example.edu/p", "ftp://x.org", "https://github.com/dginev/ar5iv"]
    df = spark.createDataFrame([(u,) for u in urls], "href string")
    got = {r["href"]: (r["url"], r["kind"]) for r in lk.with_normal_link(df).collect()}
    assert got == {
        urls[0]: ("https://github.com/A/b", "github"), urls[2]: ("https://github.com/only", "other"),
        urls[3]: ("https://demo.github.io/page", "project_page"), urls[6]: ("https://huggingface.co/m/n", "other"),
        urls[7]: ("https://lab.example.edu/p", "unknown")}


def test_malformed_pages_never_raise(spark):
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(BROKEN)], "page_id string, html string")
    assert pg.sections(df).count() == 0
    ev = pg.routed_events(df)
    assert ev.filter("kind = 'text'").count() >= 3


@pytest.mark.parametrize("title,appendix,seen,expected", [
    ("Abstract", False, False, "abstract"), ("References", False, False, "references"), ("Limitations and Future Work", False, True, "limitations"),
    ("Experimental Setup", False, False, "setup"), ("Hyper-parameters", True, True, "setup"), ("Evaluation", False, False, "experiments"),
    ("Implementation", False, False, "setup"), ("Discussion", False, True, "limitations"), ("Related Work", False, False, None),
    ("Conclusion", False, True, None), ("Proposed Method", False, False, "methodology"), ("More Details", True, True, "setup"),
    ("Details of Proofs", True, True, None), ("Glossary", True, False, None), ("Key Design Choices", False, False, "methodology"),
    ("A Closer Look", False, True, "experiments"), ("A Closer Look", False, False, "methodology"), ("", False, False, None)])
def test_top_headings(spark, title, appendix, seen, expected):
    row = spark.range(1).select(hd.classify_top(F.lit(title), F.lit(appendix), F.lit(seen)).alias("k")).first()
    assert row["k"] == expected


@pytest.mark.parametrize("title,expected", [
    ("Training details", "setup"), ("Implementation", "setup"), ("Implementation results", None), ("Limitations", "limitations"),
    ("Ablation", None), ("Hardware", "setup"), ("Dataset settings", "setup"), ("Results", None), ("", None)])
def test_sub_headings(spark, title, expected):
    assert spark.range(1).select(hd.classify_sub(F.lit(title)).alias("k")).first()["k"] == expected


def test_caption_without_cells_becomes_a_line(spark):
    html = ('<h2 class="ltx_title ltx_title_section">Method</h2><p>Text.</p><figure class="ltx_table"><figcaption class="ltx_caption">'
            '<span class="ltx_tag">Table 2:</span> An image table</figcaption><img src="x.png"></figure>')
    got = {r["section"]: r["text"] for r in pg.sections(spark.createDataFrame([("a", html)], "page_id string, html string")).collect()}
    assert got["methodology"] == "Method\nText.\n[Table 2 An image table]"


def test_span_overlap(spark):
    cell = lambda t, c=1, r=1: {"text": t, "colspan": c, "rowspan": r}
    grid = [[cell("a", 1, 3), cell("b")], [cell("c", 1, 2)], [], [cell("d")]]
    schema = "g array<array<struct<text:string,colspan:int,rowspan:int>>>"
    out = spark.createDataFrame([(grid,)], schema).select(pg.expand_spans("g").alias("g")).first()["g"]
    assert out == [["a", "b"], ["a", "c"], ["a", "c"], ["d"]]


class _Stack(HTMLParser):
    """Start, end and void tags and texts as a stack of open elements sees them."""

    def __init__(self, text: str):
        super().__init__()
        self.stack, self.out = [], []
        self.feed(text)
        self.close()

    def shown(self):
        return not set(self.stack) & set(pg.SKIP_TAGS)

    def handle_starttag(self, tag, attrs):
        if tag in pg.VOID:
            self.out += [("void", tag)] * self.shown()
            return
        self.stack.append(tag)
        self.out += [("open", tag)] * self.shown()

    def handle_startendtag(self, tag, attrs):
        self.out += [("void", tag)] * self.shown()

    def handle_endtag(self, tag):
        while tag in self.stack:
            self.out += [("close", self.stack[-1])] * self.shown()
            if self.stack.pop() == tag:
                break

    def handle_data(self, data):
        self.out += [("text", " ".join(data.split()))] * self.shown()


UNCLOSED = [
    "<div><p>one<p>two<b>bold</div>after", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<div><nav>menu<a>x</div>shown", "<form><p>hidden</form><p>shown</p></form>",
    "</div><p>x</i></p></p>", "<table><tr><td>1<td>2<tr><td>3</table>end", "<section><header>h<section>s</section>t</section>u</header>v", "<p>open <i>to <b>the end",
    "<div><div><span></div>x</span></div>y", "<p>a<br>b<br/>c<img src=x></p>", "<head><title>t</head><body>b", "", "plain",
]


def test_unclosed_elements_end_with_their_parent(spark):
    df = spark.createDataFrame(list(enumerate(UNCLOSED)), "page_id long, html string")
    got = {}
    for r in pg.page_events(df).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append((r["kind"], " ".join(r["text"].split()) if r["kind"] == "text" else r["tag"]))
    assert {k: v for k, html in enumerate(UNCLOSED) if (v := _Stack(html).out)} == got


def test_every_close_names_its_opener(spark):
    df = spark.createDataFrame(list(enumerate(UNCLOSED)), "page_id long, html string")
    ev = pg.page_events(df)
    closes = ev.filter("kind = 'close'").select("page_id", F.col("opener.pos").alias("at"), "tag", "pos")
    opens = ev.filter("kind = 'open'").select("page_id", F.col("pos").alias("at"), F.col("tag").alias("name"))
    assert closes.join(opens, ["page_id", "at"], "left").filter("name is null or name <> tag or pos <= at").count() == 0
    assert closes.groupBy("page_id", "at").count().filter("count > 1").count() == 0
    assert ev.groupBy("page_id", "pos").count().filter("count > 1").count() == 0


NESTED = """<article class="ltx_document"><section class="ltx_section"><h2 class="ltx_title ltx_title_section">1 Results</h2>
<figure class="ltx_table"><figcaption class="ltx_caption"><span class="ltx_tag">Table 4: </span>Outer</figcaption>
<div class="ltx_figure"><div class="ltx_figure"><div class="ltx_figure"><div class="ltx_figure">
<table class="ltx_tabular"><tr><td>deep<td>1</table></div></div></div></div></figure>
<figure class="ltx_table"><figcaption class="ltx_caption"><span class="ltx_tag">Table 5: </span>Outside</figcaption>
<figure class="ltx_table"><figcaption class="ltx_caption"><span class="ltx_tag">Tab. 6: </span>Inside</figcaption>
<table class="ltx_tabular"><tr><td>a<td>b<tr><td>c<td>d</table></figure></figure>
<figure class="ltx_table"><figcaption class="ltx_caption"><span class="ltx_tag">Table 7: </span>Bare</figcaption></figure>
<table class="ltx_tabular" id="S1.T9"><tr><td>x<td>y<tr><td>z</table></section></article>"""


def test_captions_at_any_depth_and_unclosed_cells(spark):
    ev = pg.routed_events(spark.createDataFrame([(1, NESTED)], "page_id long, html string"))
    scoped = pg.scoped_events(ev, pg.headings(ev))
    tabs = pg.tables(ev, scoped)
    got = [(r["label"], r["caption"], r["rows"]) for r in tabs.orderBy("table_index").collect()]
    assert got == [("Table 4", "Outer", [["deep", "1"]]), ("Table 6", "Inside", [["a", "b"], ["c", "d"]]), ("Table 9", "", [["x", "y"], ["z"]])]
    assert [r["piece"].strip() for r in pg.empty_container_lines(scoped, ev, tabs).collect()] == ["[Table 7 Bare]"]
