import pytest
from pyspark.sql import functions as F

from scriptorium.operators import abbrev as A
from scriptorium.operators import cache as C
from scriptorium.operators import glossary as G
from scriptorium.plans import base as B

SEGMENTS = [("doc#intro#01", 1, "Inhibitory control is central to retrieval stopping."), ("doc#intro#02", 2, "Transdiagnostic factors underlie intrusive thinking."), ("doc#intro#03", 3, "The hippocampus shows GABAergic inhibition during suppression.")]
TERMS = [
    {"term": "inhibitory control", "zh": "抑制控制", "mode": G.HARD, "aliases": ["抑制性控制"]},
    {"term": "transdiagnostic", "zh": "跨诊断", "mode": G.HINT},
    {"term": "GABAergic inhibition", "zh": "GABA 能抑制", "mode": G.HARD},
]


@pytest.fixture(scope="module")
def segs(spark):
    return spark.createDataFrame(SEGMENTS, "sid string, seg_pos int, src_text string")


def test_hits(spark, segs):
    got = {(r["sid"][-1], r["term"]) for r in G.hits(segs, G.terms_frame(spark, TERMS)).collect()}
    assert got == {("1", "inhibitory control"), ("2", "transdiagnostic"), ("3", "GABAergic inhibition")}


@pytest.mark.parametrize(("text", "term", "hit"), [("Inhibitory-Control task", "inhibitory control", True), ("intrusive thoughts", "intrusive thought", True), ("CLASSIFY", "SIF", False), ("flares", "LAR", False), ("the aDLPFC here", "DLPFC", True), ("LARs rose", "LAR", True)])
def test_term_patterns(spark, text, term, hit):
    rows = spark.createDataFrame([("s", 1, text)], "sid string, seg_pos int, src_text string")
    assert (G.hits(rows, G.terms_frame(spark, [{"term": term, "zh": "x"}])).count() == 1) is hit


def test_custom_pattern_and_rejected(spark, segs):
    t = [{"term": "x", "zh": "y", "pattern": "retriev(al|e)"}, {"term": "hippocampus", "zh": "海马", "status": "rejected"}]
    assert [r["sid"] for r in G.hits(segs, G.terms_frame(spark, t)).collect()] == ["doc#intro#01"]


def test_scopes(spark):
    t = spark.createDataFrame(B.SCOPED, "ord int, term string, zh string, mode string, scope string, status string")
    d = spark.createDataFrame(B.READERS, "doc_id string, field string")
    got = {(r["doc_id"], r["term"]): r["zh"] for r in G.resolve(t, d).collect()}
    assert got["paper-A", "MSN"] == "内侧隔核" and got["paper-B", "MSN"] == "中型棘状神经元" and got["paper-C", "MTL"] == "膜转运实验室" and ("paper-D", "MTL") not in got
    assert G.conflicts(t, d).count() == 4
    with pytest.raises(Exception, match="conflicting"):
        G.resolve(t, d, strict=True).collect()
    with pytest.raises(Exception, match="unknown scope"):
        G.resolve(t.withColumn("scope", F.lit("planet:mars")), d).collect()


def test_protected_replacement(spark):
    terms = [{"term": "IBS", "zh": "肠易激综合征", "mode": G.HARD}, {"term": "IBS-C", "zh": "便秘型肠易激综合征", "mode": G.HARD}, {"term": "DLPFC", "zh": "背外侧前额叶", "mode": G.HARD}, {"term": "SSRT", "zh": "停止信号反应时", "mode": G.HARD, "aliases": ["停止时"]}]
    given = ["该病的全称为肠易激综合征，英文缩写为 IBS。", "肠易激综合征（IBS）是常见病。", "许多 IBS 患者经常就诊。", "针对 IBS-C 和 IBS 患者的试验。", "左侧 rDLPFC 激活", "动作停止指标（SSRT）与停止时", "XIBS 与 IBSx"]
    want = ["该病的全称为肠易激综合征，英文缩写为 IBS。", "肠易激综合征（IBS）是常见病。", "许多 肠易激综合征 患者经常就诊。", "针对 便秘型肠易激综合征 和 肠易激综合征 患者的试验。", "左侧 右侧背外侧前额叶 激活", "动作停止指标（停止信号反应时）与停止信号反应时", "XIBS 与 IBSx"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", G.hard_replace(F.col("t"), terms).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in rows] == want


def test_invalidation(spark, segs):
    def dirty(terms, version="v1", rows=segs, model="m"):
        cache = C.keyed(segs, G.terms_frame(spark, TERMS), "m", "v1").select("key", F.lit("v").alias("value"))
        return sorted(r["sid"][-1] for r in C.dirty(rows, G.terms_frame(spark, terms), cache, model, version).collect())

    alter = lambda name, **kw: [t | kw if t["term"] == name else t for t in TERMS]
    assert dirty(TERMS) == []
    assert dirty(alter("inhibitory control", zh="抑制调控", aliases=["x"])) == []
    assert dirty(alter("transdiagnostic", note="改")) == ["2"] and dirty(alter("transdiagnostic", zh="跨诊断的")) == ["2"]
    assert dirty(TERMS, version="v2") == ["1", "2", "3"] and dirty(TERMS, model="n") == ["1", "2", "3"]
    assert dirty(TERMS, rows=segs.withColumn("src_text", F.when(F.col("seg_pos") == 1, "New text.").otherwise(F.col("src_text")))) == ["1"]


def test_glossary_upserts(spark):
    a = spark.createDataFrame([("A", "1"), ("b", "2")], "term string, zh string")
    b = spark.createDataFrame([(" a ", "9"), ("c", "3")], "term string, zh string")
    assert sorted(map(tuple, G.upsert(a, b).collect())) == [(" a ", "9"), ("b", "2"), ("c", "3")]
    assert sorted(map(tuple, G.merged(b, a).collect())) == [(" a ", "9"), ("b", "2"), ("c", "3")]
    assert [tuple(r) for r in G.add_missing(a, b).collect()] == [("c", "3")]
    assert [tuple(r) for r in G.delete(a, b).collect()] == [("b", "2")]
    own = a.withColumn("scope", F.lit("doc:x"))
    assert G.promote(own, b.withColumn("scope", F.lit("global")), "b").count() == 3
    with pytest.raises(ValueError, match="already"):
        G.promote(own, b.withColumn("scope", F.lit("global")), "A")


def test_landing_and_density(spark, segs):
    t = G.terms_frame(spark, TERMS)
    rows = segs.withColumn("zh", F.when(F.col("seg_pos") == 1, "抑制性控制很重要").otherwise("GABA 能抑制，GABA 能抑制"))
    got = {r["term"]: tuple(r)[2:] for r in G.landing(rows, t).collect()}
    assert got == {"inhibitory control": (1, 1, "doc#intro#01"), "GABAergic inhibition": (1, 0, None)}
    assert {r["term"]: r["n_missing"] for r in G.landing(rows, t, accept_aliases=True).collect()} == {"inhibitory control": 0, "GABAergic inhibition": 0}
    assert [(r["term"], r["n"]) for r in G.density(rows, t).collect()] == [("GABAergic inhibition", 4)]


def test_definitions(spark):
    rows = [*B.ABBREVIATION_TEXTS, ("d4", "type 2 diabetes mellitus (T2DM) and as in post-traumatic stress disorder (PTSD)")]
    got = {tuple(r)[:2] + (r["full"],) for r in A.definitions(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "abbr", "full").collect()}
    assert got == {*B.DEFINITIONS, ("d4", "PTSD", "post-traumatic stress disorder")}


def test_judge(spark):
    rows = spark.createDataFrame([(0, "SAME thing"), (1, "一致"), (2, "不同：前者\n后者")], "i int, a string")
    assert [r[0] for r in rows.orderBy("i").select(A.judged(F.col("a"))).collect()] == [None, None, "不同：前者"]


def test_provider_failures_stay_in_their_row(spark):
    def call(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    got = {r["p"]: (r["value"], r["error"]) for r in C.complete(rows, "p", call).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}


def test_tracks(spark, segs):
    cache = spark.createDataFrame([], "key string, value string")
    tr = C.translate(segs, G.terms_frame(spark, TERMS), cache, TERMS, script=[("Inhibitory", "抑制性控制 ２，３７３")])
    first = tr.where("seg_pos = 1").first()
    assert first["zh"] == "抑制控制 2,373" and first["zh_raw"] == "抑制性控制 ２，３７３" and not first["hit"]
    sc = C.rewrite(segs, tr.where("seg_pos < 3"))
    assert [r["error"] for r in sc.orderBy("seg_pos").collect()] == [None, None, "no translation"]
    stats = C.run_stats(sc.join(tr.select("sid", "hit"), "sid")).first()
    assert (stats["total"], stats["failed"]) == (3, 1)



@pytest.mark.parametrize("limit", [20_000, 2])
def test_substrings_meet_by_runs_of_characters(spark, monkeypatch, limit):
    """The same with few terms, broadcast, and many, met by narrow rows; no loop over pairs."""
    monkeypatch.setattr(G, "BROADCAST_TERMS", limit)
    terms = ["the", "a", "b c", "Über", "终于", "来", "xyzzy", "heth", "aaaa", "", "😀x"]
    rows = [("1", 1, "The heath; aaaaa"), ("2", 2, "über b c"), ("2", 3, "终于来到"), ("3", 4, ""), ("4", 5, "😀😀x the THE"), ("4", 5, "😀😀x the THE"), ("5", 6, "a.b c")]
    table = spark.createDataFrame([*rows, ("6", 7, None)], "sid string, seg_pos int, src_text string")
    got = G.web_hits(table, G.terms_frame(spark, [{"term": t, "zh": "z"} for t in terms]))
    want = sorted((s, t) for s, _, x in rows for t in terms if t and t.lower() in x.lower())
    assert sorted((r.sid, r.term) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    zh = G.density(table.withColumnRenamed("src_text", "zh"), G.terms_frame(spark, [{"term": t, "zh": t} for t in terms]), 20)
    assert {(r.term, r.n) for r in zh.collect()} == {(t, n) for t in terms if t and (n := sum((x or "").count(t) for _, _, x in rows))}
    assert "NestedLoop" not in zh._jdf.queryExecution().executedPlan().toString()


def test_a_hundred_thousand_terms(spark):
    """Terms beyond what is broadcast: substrings and patterns equal a look-up of each word."""
    n = 100_000
    terms = spark.range(n).selectExpr(
        "cast(id as int) as ord", "concat('w', lower(conv(id, 10, 26)), 'q') as term", "'z' as zh", "'hard_replace' as mode", "'' as note", "cast(array() as array<string>) as aliases",
        "cast(null as string) as pattern", "true as prefix_variants", "'suggested' as status", "'global' as scope", "'' as full_en",
    ).withColumn("term", F.translate("term", "0123456789", "qrstuvwxyz"))
    words = [r.term for r in terms.where("ord % 1000 = 7").collect()]
    rows = spark.createDataFrame([(str(i), i, f"x {w} y" if i % 2 else f"x{w}y") for i, w in enumerate(words)], "sid string, seg_pos int, src_text string")
    known = {r.term for r in terms.select("term").collect()}
    want = {(r.sid, r.src_text[a:z]) for r in rows.collect() for a in range(len(r.src_text)) for z in range(a + 1, len(r.src_text) + 1) if r.src_text[a:z] in known}
    assert {(r.sid, r.term) for r in G.web_hits(rows, terms).collect()} == want
    assert {(r.sid, r.term) for r in G.hits(rows, terms).collect()} >= {(str(i), w) for i, w in enumerate(words) if i % 2}
