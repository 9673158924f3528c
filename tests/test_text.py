import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import segments as S


def run(spark, f, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in out]


def test_slugs(spark):
    titles = ["Non-antibiotic drugs.", "DNA or RNA synthesis.", "colon,rectal and anal cancer", "A" * 80, "x" * 39 + "-" + "y" * 10, "a" * 35 + "化", "a" * 36 + "化", "化" * 9, "", "!!"]
    want = ["non-antibiotic-drugs", "dna-or-rna-synthesis", "colon-rectal-and-anal-cancer", "a" * 40, "x" * 39, "a" * 35 + "u5316", "a" * 36, "u5316" * 8, "sec", "sec"]
    assert run(spark, T.slug, *titles) == want


def test_normalisation_is_exact_and_idempotent(spark):
    given = ["共2，373例患者", "12，345，678", "２，３７３", "分组为1，2，3组", "第一，第二，第三", "另一项任务 任务 里", "慢慢地走", "许多许多年", "the the task", "这是一个任务\n\n任务到此结束"]
    want = ["共2,373例患者", "12,345,678", "2,373", "分组为1，2，3组", "第一，第二，第三", "另一项任务 里", "慢慢地走", "许多许多年", "the the task", "这是一个任务\n\n任务到此结束"]
    assert run(spark, T.normalize_zh, *given) == want
    assert run(spark, lambda c: T.normalize_zh(T.normalize_zh(c)), *given) == want


def test_reading_length(spark):
    got = run(spark, T.reading_length, "", "铁死亡", "T2DM", "BRCA1-BARD1", "53BP1", "与 T2DM 相关", "BRCA1-BARD1 与 53BP1 轴拮抗决定 HR 或 NHEJ 的选择。", None)
    assert got == [0, 3, 1, 1, 1, 4, 15, 0]


def test_spoken_text(spark):
    rules = [("栓塞", "栓色"), ("黏膜", "粘膜"), ("血栓栓塞", "血栓栓色")]
    got = run(spark, lambda c: T.spoken(c, rules), "RAI 与 DGBI", "IBS-C 与 ABCDEFGH", "肺血栓栓塞 黏膜", "好——是……  完", None)
    assert got == ["R-A-I 与 D-G-B-I", "IBS-C 与 ABCDEFGH", "肺血栓栓色 粘膜", "好，是。 完", ""]


def test_sentences(spark):
    assert run(spark, T.en_sentences, "See Fig. 3 for this. Values of 1.5 rose, e.g. in mice. Done!", "", "no end") == [["See Fig. 3 for this.", "Values of 1.5 rose, e.g. in mice.", "Done!"], [], ["no end"]]
    assert run(spark, T.zh_sentences, "一。二；\n三") == [["一。", "二；\n", "三"]]


def test_paragraph_html(spark):
    raw = 'barrier<sup><a data-test="citation-ref" href="#x">1</a></sup>. A&nbsp;<b>bold</b>   move<sup>2,3</sup> &amp; so <table><tr>x</tr></table>on. Reprinted with permission from ref. 61, Elsevier.'
    assert run(spark, T.clean_paragraph, raw) == ["barrier [1]. A bold move [2,3] & so on.".replace(" [", "[")]
    assert run(spark, T.unescape_all, "a &eacute; &#233;") == ["a é é"]


def test_dates_and_ids(spark):
    rows = [("2026", "Sep", "18", ""), ("2026", "9", "", ""), ("2026", "", "", ""), ("", "", "", "2026 Sep-Oct"), ("", "", "", "2026"), ("", "", "", "Winter 2026")]
    got = spark.createDataFrame(rows, "y string, m string, d string, f string").select(T.feed_date(F.col("y"), F.col("m"), F.col("d"), F.col("f")).alias("x")).collect()
    assert [r["x"] for r in got] == ["2026-09-18", "2026-09-00", "2026", "2026-09", "2026-00", "Winter 2026"]
    assert run(spark, T.doc_id_of_doi, "10.1038/nrdp.2018.8", "", "10.1038/a/b") == ["nrdp.2018.8", "", "a/b"]
    assert run(spark, T.field_of_journal, "Nature reviews bioengineering", "Nature reviews. Molecular cell biology", "", None) == ["bioengineering", "molecular-cell-biology", "unknown", "unknown"]


@pytest.mark.parametrize(("f", "given", "want"), [(T.lrc_time, 83.456, "[01:23.46]"), (T.vtt_time, 3725.5, "01:02:05.500"), (T.clock, 83.9, "01:23"), (T.minutes_zh, 125.0, "2 分 5 秒")])
def test_times(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "x double").select(f(F.col("x"))).first()[0] == want


def test_sound_lengths(spark):
    row = spark.range(1).select(T.silence_seconds(F.lit(300)).alias("a"), T.mp3_seconds(F.lit(14400)).alias("b"), T.rate_to_speed(F.lit("+20%")).alias("c"), T.rate_to_speed(F.lit("bad")).alias("d"), T.rate_to_speed(F.lit("-80%")).alias("e")).first()
    assert tuple(row) == (0.288, 2.4, 1.2, 1.0, 0.5)


def test_numbers_and_keys(spark):
    assert run(spark, T.numbers, "高达81%，共2,373例 T2DM x5 1.5.") == [["81", "2,373", "1.5"]]
    import hashlib

    key = spark.range(1).select(T.content_key(F.lit("A"), F.lit("b"), F.lit(""))).first()[0]
    assert key == hashlib.sha256(b"A\x1fb\x1f\x1f").hexdigest()


def test_initials(spark):
    rows = [("MSN", "medial septal nucleus"), ("SIF", "suppression-induced forgetting"), ("T1", "Table"), ("RT", "rate of the time"), ("AB", "alpha and many other big words here now")]
    got = spark.createDataFrame(rows, "a string, f string").select(T.initials_fit(F.col("a"), F.col("f")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, True, False, True, False]


def test_join_lines(spark):
    got = spark.createDataFrame([(["inflammation and oxi-", "dative  stress", "a--", "b"],)], "l array<string>").select(T.join_lines(F.col("l"))).first()[0]
    assert got == "inflammation and oxidative stress a-- b"


def test_lines_lose_blanks_and_nothing_else(spark):
    """A number at a line's end is no blank: what is trimmed does not follow the line's place."""
    rows = spark.createDataFrame([("d", "0 zero 0\n 1 one 1 \n2 two 2\n \n33")], "doc_id string, text string")
    assert [r.src_text for r in S.text_segments(rows).orderBy("seg_pos").collect()] == ["0 zero 0", "1 one 1", "2 two 2", "33"]
    joined = rows.select(T.join_lines(F.split("text", "\n")).alias("t")).first().t
    assert joined == "0 zero 0 1 one 1 2 two 2 33"
