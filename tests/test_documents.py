import pytest
from pyspark.sql import functions as F

from scriptorium.operators import layout as L
from scriptorium.plans import base as B
from scriptorium.operators import segments as S
from scriptorium.operators import timeline as M
from scriptorium.sinks import render as R
from scriptorium.sources import readers, schemas

PAGE = """<html><h1 class="c-article-title x">The <i>Title</i></h1>
<section data-title="Introduction"><figure><figcaption>Fig. 1: A thing</figcaption><p>The caption text is here.</p></figure>
<p>First paragraph with words.</p><p>Too short</p><h3>Sub one</h3><p>Criteria are the following:</p><ol><li>alpha one</li><li>beta two</li></ol>
<h3>Sub one</h3><p>Under the second heading.</p><h4>Deep one</h4><p>Deep words are here.</p><table><p>no table text here</p></table></section>
<section data-title="References"><p>A reference goes right here.</p></section><section data-title="Empty"><h3>Nothing</h3></section></html>"""


def test_html_sections(spark):
    pages = spark.createDataFrame([("d", PAGE)], "doc_id string, html string")
    got = [(r["sid"], r["sec_heading"], r["sec_level"], r["src_text"], r["is_figure"]) for r in S.section_html(pages).orderBy("seg_pos").collect()]
    assert got == [
        ("d#introduction#fig01", "Introduction", 1, "The caption text is here.", True),
        ("d#introduction#02", "Introduction", 1, "First paragraph with words.", False),
        ("d#introduction/sub-one#01", "Sub one", 2, "Criteria are the following: 1. alpha one; 2. beta two", False),
        ("d#introduction/sub-one-2#01", "Sub one", 2, "Under the second heading.", False),
        ("d#introduction/deep-one#01", "Deep one", 3, "Deep words are here.", False),
    ]
    assert pages.select(S.html_title(F.col("html"), F.col("doc_id"))).first()[0] == "The Title"
    assert S.invariants(S.section_html(pages)).count() == 0
    web = S.section_html(pages, "web").orderBy("seg_pos").first()
    assert (web["sid"], web["index"]) == ("d:s000-introduction:p01", 0)


def test_nested_blocks_stay_whole(spark):
    pages = spark.createDataFrame(B.NESTED_PAGES, "doc_id string, html string")
    got = [(r["sid"], r["src_text"]) for r in S.section_html(pages).where("doc_id = 'n'").orderBy("seg_pos").collect()]
    assert got == [(r[1], r[4]) for r in B.NESTED_ROWS if r[0] == "n"]


def test_flat_pages_without_article_or_with_attributes(spark):
    html = [(1, '<html><body><p class="x">One two three.<p>Four five &#8217;six&#x2019; &amp;amp;</p></body></html>'), (2, "<p>No body at all here.</p>"), (3, "<article><p>a b</p></article>"), (4, None)]
    got = sorted((r["page_id"], r["seg_pos"], r["src_text"]) for r in S.flat_html(spark.createDataFrame(html, "page_id int, html string")).collect())
    assert got == [(1, 1, "One two three."), (1, 2, "Four five ’six’ &amp;"), (2, 1, "No body at all here.")]


def test_upper_median_and_paths(spark):
    rows = spark.createDataFrame([("d", "p", 3), ("d", "p", 5), ("d", "q", 9), ("d", "q", 4)], "doc_id string, sec_path string, n_words int")
    assert tuple(S.document_stats(rows).first()) == ("d", 2, 4, 21, 5, 9)
    heads = spark.createDataFrame([("d", 1, "A", 1), ("d", 2, "B", 2), ("d", 3, None, None), ("d", 4, "C", 1), ("d", 5, None, None)], "doc_id string, seg_pos int, heading string, level int")
    got = [(r["h1"], r["h2"]) for r in S.fill_forward(heads, ["doc_id"], ["seg_pos"]).orderBy("seg_pos").collect()]
    assert got == [("A", None), ("A", "B"), ("A", "B"), ("C", None), ("C", None)]


@pytest.fixture(scope="module")
def laid(spark):
    return B.laid_out(spark)


def test_layout(laid):
    lines, rects, width = laid
    lay = L.layout(L.in_rects(lines, rects), width).first()
    assert (lay["body_size"], lay["body_font"], lay["n_columns"]) == (9.0, "Serif", 2) and lay["bases"] == [40.0, 320.0]
    kinds = {r["text"][:14]: r["kind"] for r in L.classify(L.in_rects(lines, rects), L.layout(lines, width)).collect()}
    assert kinds["A Title of the"] == "title" and kinds["The abstract o"] == "abstract" and kinds["Methods of stu"] == "h1" and kinds["Fig. 1 | A cap"] == "figure"
    assert kinds["goes on in a s"] == "figure" and kinds["boxed words in"] == "region" and kinds["What follows i"] == "runin" and kinds["Effects of fas"] == "other"


def test_line_segments(laid):
    rows = L.segment_lines(*laid).orderBy("seg_pos").collect()
    assert [(r["sec_heading"], r["sec_level"]) for r in rows] == [("Abstract", 1), ("Methods of study", 1), ("Methods of study", 1), ("Methods of study", 1), ("Effects of fasting on inflammation and oxidative stress.", 3)]
    assert rows[1]["src_text"].endswith("last words end here.") and rows[2]["src_text"].startswith("Indented") and rows[2]["indented"]
    assert rows[4]["sid"] == "p#methods-of-study/effects-of-fasting-on-inflammation-and#01" and len({r["sid"] for r in rows}) == 5
    lines = L.reading_order(L.classify(L.in_rects(*laid[:2]), L.layout(laid[0], laid[2])))
    assert L.title(lines).first()["title"] == "A Title of the Paper"


def test_web_paragraphs(spark):
    items = spark.createDataFrame([("d", 1, "Methods", 9.0), ("d", 2, "w " * 160 + "end.", 9.0), ("d", 3, "Large heading", 14.0), ("d", 4, "some words that stay at the end", 9.0)], "doc_id string, pos int, text string, size double")
    got = [(r["sec_heading"], len(r["src_text"]) > 300) for r in L.web_paragraphs(items).orderBy("seg_pos").collect()]
    assert got == [("Methods", True), ("Large heading", False)]


def test_gather_spans(spark):
    rows = [("p", 0, 1, 1, 1, 0, 9.0, 16, "Serif-Bold", "Head. ", 40.0, 100.0, 80.0), ("p", 0, 1, 2, 1, 0, 9.0, 0, "Serif", "body", 80.0, 100.0, 120.0), ("p", 0, 1, 3, 1, 0, 5.0, 1, "Serif", "12", 120.0, 100.0, 125.0), ("p", 0, 2, 1, 0, 1, 9.0, 0, "Serif", "sideways", 0.0, 0.0, 1.0)]
    got = L.gather(spark.createDataFrame(rows, "doc_id string, page int, line int, seq int, dir_x int, dir_y int, size double, flags int, font string, text string, x0 double, y0 double, x1 double")).collect()
    assert len(got) == 1 and (got[0]["text"], got[0]["head_text"], got[0]["rest_text"], got[0]["bold"], got[0]["all_bold"]) == ("Head. body", "Head.", "body", True, False)


def test_sentence_times(spark):
    rows = spark.createDataFrame([("a", "这是第一句话。这是第二句话！还有第三句话？最后一句结尾。", 8.0), ("b", " ", 2.0)], "sid string, t string, d double")
    got = M.proportional(rows, "sid", "t", "d").orderBy("ord").collect()
    assert len(got) == 4 and got[0]["start"] == 0 and abs(got[-1]["end"] - 8.0) <= 0.05
    assert all(abs(a["end"] - b["start"]) < 0.002 and a["duration"] > 0 for a, b in zip(got, got[1:], strict=False))


def test_timeline_and_alignment(spark):
    segs = spark.createDataFrame([("d", 1, 2.0), ("d", 2, 3.0), ("d", 3, 1.0)], "doc_id string, seg_pos int, duration_sec double")
    got = [(r["start_sec"], r["end_sec"]) for r in M.timeline(segs).orderBy("seg_pos").collect()]
    assert got == [(0.0, 2.0), (2.288, 5.288), (5.576, 6.576)]
    spans = spark.createDataFrame([([(0.5, 1.0), (1.5, 2.0), (1.8, 3.0)],)], "s array<struct<start:double,end:double>>").select(M.smoothed(F.col("s"), F.lit(4.0)).alias("s")).first()["s"]
    assert [tuple(x) for x in spans] == [(0.0, 1.5), (1.5, 2.0), (2.0, 4.0)]
    words = spark.createDataFrame([(["cat", "cat", "dog", "nope", "end"], "cat a cat dog end")], "w array<string>, t string").select(M.locate_words(F.col("w"), F.col("t")).alias("x")).first()["x"]
    assert [(x["word"], x["s"]) for x in words] == [("cat", 0), ("cat", 6), ("dog", 10), ("end", 14)]
    aligned = spark.createDataFrame([("一。二。", [("a", 0.0, 1.0), ("b", 1.0, 2.0)])], "t string, s array<struct<text:string,start:double,end:double>>").select(M.align_sentences(F.col("t"), F.col("s")).alias("x")).first()["x"]
    assert [x["text"] for x in aligned] == ["一。", "二。"]


def test_renderers(spark):
    segs = spark.createDataFrame([("d", "s1", "a", "Intro", 1, 1, "one\ntwo"), ("d", "s2", "a", "Intro", 1, 2, "three"), ("d", "s3", "b", "End", 1, 3, "four")], "doc_id string, sid string, sec_path string, sec_heading string, sec_level int, seg_pos int, src_text string")
    tr = spark.createDataFrame([("s1", "一"), ("s3", "四")], "sid string, zh string")
    assert R.translation_markdown(segs, tr).first()["content"] == "## Intro\n\n一\n\n（未翻译）\n\n## End\n\n四"
    both = R.interleaved(segs, tr, "en").first()
    assert both["missing"] == 1 and both["content"].startswith("## Intro\n\n> one\n> two\n\n一")
    times = spark.createDataFrame([("d", 0, 0.0, 1.5, "一"), ("d", 1, 1.5, 62.25, "二")], "doc_id string, ord int, start_sec double, end_sec double, text string")
    assert R.vtt(times).first()["content"] == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.500\n一\n\n2\n00:00:01.500 --> 00:01:02.250\n二\n"
    assert R.lrc(times).first()["content"] == "[00:00.00]一\n[00:01.50]二"
    nested = R.nested(segs.withColumn("index", F.lit(1)), spark.createDataFrame([("d", "T")], "doc_id string, title string")).first()
    assert [len(s["segments"]) for s in nested["sections"]] == [2, 1]


def test_sources(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"doc_id": "d", "title": "T", "unknown": 1, "sections": [{"heading": "H", "level": 1, "segments": [{"sid": "d#h#01", "src_text": "words", "sec_path": "h", "extra": 2}]}]}')
    docs = readers.json_table(spark, str(tmp_path), schemas.DOCUMENT)
    row = readers.segments_of(docs).first()
    assert (row["sid"], row["seg_pos"], row["col"], row["fig_label"], row["sec_heading"]) == ("d#h#01", 1, 0, "", "H")
    rows = readers.glossary_rows("terms:\n- {term: a, zh: 甲, mode: hard_replace}\n- {term: '', zh: x}\n- {term: b, zh: 乙}\n")
    assert [(r["term"], r["mode"]) for r in rows] == [("a", "hard_replace"), ("b", "prompt_hint")]
    assert [r["zh"] for r in readers.glossary_rows("# note\na | 甲 | hard_replace | n\nb | 乙\nbroken\n")] == ["甲", "乙"]
    with pytest.raises(ValueError, match="mode"):
        readers.glossary_rows("- {term: a, zh: b, mode: what}")
    assert readers.polyphone_rules("rules: [{word: ab, tts: x}, {word: abc, tts: y}]", "rules: [{word: ab, tts: z}]") == [("abc", "y"), ("ab", "z")]
    assert readers.load_env("A_B_C='x'\n# c\nD=2") == {"A_B_C": "x", "D": "2"}
    first = readers.first_available(spark.createDataFrame([("a", None), ("b", "1")], "doc_id string, text string"), spark.createDataFrame([("a", "2"), ("b", "3")], "doc_id string, text string"))
    assert {tuple(r) for r in first.collect()} == {("a", "2"), ("b", "1")}
    assert readers.resolve_doc(docs) == "d"
    with pytest.raises(ValueError, match="none found"):
        readers.resolve_doc(docs.where("false"))
    preset = spark.createDataFrame([("p",)], "x string")
    assert readers.or_preset(preset.where("false"), preset).count() == 1 and readers.or_preset(preset, preset).count() == 1
