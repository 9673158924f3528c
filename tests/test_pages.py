"""Sections of pages: the browser's rule, broken markup, size, and what the plan moves."""

import time

from pyspark.sql import functions as F

from scriptorium.functions import markup
from scriptorium.operators import segments as S


def segs(spark, html, read=S.browser_html):
    rows = read(spark.createDataFrame([("d", html)], "doc_id string, html string")).orderBy("seg_pos").collect()
    return [(r.sid, r.sec_heading, r.sec_level, r.src_text, r.is_figure, r.in_box, r.fig_label) for r in rows]


def test_the_article_s_container_is_chosen(spark):
    body = '<p>Outside of it all, a sentence.</p><{0}><section><h2>In</h2><p>Inside of the container, yes.</p></section></{1}><section><h2>Out</h2><p>Behind the container, a sentence.</p></section>'
    for opens, closes in (('div class="x main-content"', "div"), ("div data-component='article-body'", "div"), ('main class="c-article-body"', "main"), ("article", "article")):
        got = segs(spark, f"<html><body>{body.format(opens, closes)}</body></html>")
        assert [g[:4] for g in got] == [("d:s000-in:p01", "In", 1, "Inside of the container, yes.")]
    got = segs(spark, f"<html><body>{body.format('span', 'span')}</body></html>")
    assert [g[1] for g in got] == ["In", "Out"]


def test_boxes_lists_figures_and_levels(spark):
    got = segs(spark, """<article><section data-title="Abstract"><p>The abstract comes first of all.</p></section>
      <section data-title="A"><div><h3>Sub <i>one</i> &amp; two</h3></div><p>A plain paragraph stands here.</p><ul><li><p>Paragraphs of plain items stay here.</p></li></ul>
        <div class="c-article-box wide"><p>Two of the following criteria:</p><p>&nbsp;</p><ol><li><span class="u-custom-list-number">a</span><p>first of them</p></li><li>second</li></ol><p>The box goes on with this.</p></div>
        <figure><p>What the figure shows is this.</p><figcaption>Fig. 1 | <b>X</b></figcaption></figure><p>Short</p><p>Short.</p></section>
      <section data-title="B"><p>No heading but a title of its own.</p><section><h4>Inner</h4><p>Inner words belong to the outer one.</p></section></section>
      <section data-title="References"><p>A reference that nobody reads here.</p></section><section><p>No title, so not a section at all.</p></section></article>""")
    assert got == [
        ("d:s000-abstract:p01", "Abstract", 1, "The abstract comes first of all.", False, False, ""),
        ("d:s001-sub-one-two:p01", "Sub one & two", 2, "A plain paragraph stands here.", False, False, ""),
        ("d:s001-sub-one-two:p02", "Sub one & two", 2, "Paragraphs of plain items stay here.", False, False, ""),
        ("d:s001-sub-one-two:p03", "Sub one & two", 2, "Two of the following criteria: a. first of them; 2. second", False, True, ""),
        ("d:s001-sub-one-two:p04", "Sub one & two", 2, "The box goes on with this.", False, True, ""),
        ("d:s001-sub-one-two:p05", "Sub one & two", 2, "What the figure shows is this.", True, False, "Fig. 1 | X"),
        ("d:s001-sub-one-two:p06", "Sub one & two", 2, "Short.", False, False, ""),
        ("d:s002-inner:p01", "Inner", 1, "No heading but a title of its own.", False, False, ""),
        ("d:s002-inner:p02", "Inner", 1, "Inner words belong to the outer one.", False, False, ""),
    ]


def test_broken_markup(spark):
    page = "<section data-title='A'><p>One is left open here<p>Two <b>is, too<div><p>Three is fine here.</p></div></p></b><!-- <p>no text of ours</p> --><script>var x = '<p>no text here</p>';</script><p>Four ends with the page"
    assert [g[3] for g in segs(spark, page, S.section_html)] == ["One is left open here", "Two is, too", "Three is fine here.", "Four ends with the page"]
    pages = spark.createDataFrame([("a", None), ("b", ""), ("c", "no tags, just words here"), ("d", "</p></section><section>")], "doc_id string, html string")
    assert S.section_html(pages).count() == 0 and S.browser_html(pages).count() == 0


def test_a_page_of_many_tags_in_one_pass(spark):
    def page(n):
        return "<section data-title='A'>" + "".join(f"<div><ul><li><p>Words of paragraph <b>{i}</b> stand here.</p></li></ul></div>" for i in range(n)) + "</section>"

    took = []
    for n in (20_000, 40_000):
        text, began = page(n), time.time()
        assert len(markup.section_blocks(text, frozenset())) == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 1
    deep = "<section data-title='A'>" + "<div>" * 20_000 + "<p>Deep words stand here.</p>" + "</div>" * 20_000
    assert [b[4] for b in markup.section_blocks(deep, frozenset())] == ["Deep words stand here."]
    pages = spark.createDataFrame([("x", page(5_000))], "doc_id string, html string")
    got = S.section_html(pages).agg(F.count("*").alias("n"), F.max("index").alias("i"), F.max("seg_pos").alias("p")).first()
    assert tuple(got) == (5_000, 5_000, 5_000)


def test_no_text_is_shuffled(spark):
    pages = spark.createDataFrame([("x", "<p></p>")], "doc_id string, html string")
    for read in (S.section_html, S.browser_html):
        assert "Exchange" not in read(pages)._jdf.queryExecution().executedPlan().toString()
