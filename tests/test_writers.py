"""Searches that widen, browser feeds, glossary files, fields and checkpoints of runs."""

import json
import os
import urllib.parse

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import feed as E
from scriptorium.operators import glossary as G
from scriptorium.sinks import render, stages
from scriptorium.sources import literals, readers


@pytest.mark.parametrize(("days", "found", "asked"), [
    (7, ["1"], [("7", "20")]), (8, ["1"], [("8", "50")]), (31, ["1"], [("31", "100")]), (31, [], [("31", "100")]), (7, [], [("7", "20"), ("30", "50")]), (30, [], [("30", "100")]),
])
def test_a_search_without_results_is_widened(days, found, asked):
    seen = []

    def get(url):
        q = urllib.parse.parse_qs(urllib.parse.urlparse(url).query)
        seen.append((q["term"][0].split('"last ')[1].split(" ")[0], q["retmax"][0]))
        return json.dumps({"esearchresult": {"idlist": found}})

    parts = readers.FeedReader({"base": "http://x", "term": "a", "days": str(days), "widening": "true"}, get).partitions()
    assert seen == asked and [p.ids for p in parts] == [found]


def test_a_search_that_does_not_widen():
    seen = []

    def get(url):
        seen.append(urllib.parse.parse_qs(urllib.parse.urlparse(url).query)["retmax"])
        return json.dumps({"esearchresult": {"idlist": []}})

    readers.FeedReader({"base": "http://x", "term": "a"}, get).partitions()
    assert seen == [["500"]]


RECORD = "pmid string, doi string, journal string, journal_abbr string, title string, abstract string, year string, month string"


def test_browser_items(spark):
    long = "a" * 50
    rows = [
        ("1", "10.1038/s1", "Nature Reviews Cancer", "Nat Rev Cancer", " Pathophysiology of sleep ", long, "2026", "Mar"),
        ("2", None, "J", None, "Sleep", f" {long} ", "2026", None), ("3", "", None, None, "Sleep", long, None, "Mar"),
        ("4", None, "J", None, "Short", "a" * 49, "2026", None), ("5", None, "J", None, " ", long, "2026", None), ("6", None, "J", None, "None", None, None, None),
    ]
    got = {r.doc_id: r for r in E.browser_items(spark.createDataFrame(rows, RECORD), literals.rewritten_title).collect()}
    assert sorted(got) == ["pmid-2", "pmid-3", "s1"]
    one, two, three = got["s1"], got["pmid-2"], got["pmid-3"]
    assert (one.title_en, one.title_zh, one.journal, one.pub_date) == ("Pathophysiology of sleep", "的病理生理学 sleep", "Nat Rev Cancer", "2026-Mar")
    assert one.brief == "前沿探讨：的病理生理学 sleep" and one.detail == long and not one.has_reader
    assert (two.title_zh, two.journal, two.pub_date, two.abstract) == ("", "J", "2026", long)
    assert (three.journal, three.pub_date) == ("Nature Reviews", "近期") and three.brief.startswith("前沿综述：Nature Reviews ")


def test_glossary_files_are_read_back(spark, tmp_path):
    terms = [
        {"term": "a: b", "zh": "甲", "mode": G.HARD, "note": "two\nlines, \"quoted\" # no comment", "aliases": ["x", "y: z"], "scope": "global", "status": "approved"},
        {"term": "- c", "zh": "yes", "mode": G.HINT, "scope": "doc:d1", "full_en": "c d"}, {"term": "e", "zh": "1", "mode": G.HINT, "scope": "global", "prefix_variants": False, "pattern": r"e\d+"},
    ]
    frame = G.terms_frame(spark, terms)
    columns = ["term", "zh", "mode", "note", "aliases", "pattern", "prefix_variants", "status", "scope", "full_en"]
    want = sorted(frame.select(*columns).collect())
    content = {r.scope: r.content for r in render.glossary_yaml(frame).collect()}
    back = [x for scope in sorted(content) for x in readers.glossary_rows(content[scope])]
    assert sorted(G.terms_frame(spark, back).select(*columns).collect()) == want
    # Files: one of each scope; a second write replaces those scopes alone.
    root = f"file://{tmp_path}/glossaries"
    render.write_glossaries(frame, root)
    render.write_glossaries(frame.where("scope = 'global'").limit(1), root)
    read = {r.scope: r.value for r in spark.read.text(root, wholetext=True).collect()}
    assert read["doc:d1"] == content["doc:d1"] and len(readers.glossary_rows(read["global"])) == 1
    assert render.glossary_yaml(frame.limit(0)).count() == 0


def test_a_promoted_term_is_approved_and_leaves_its_document(spark):
    own = G.terms_frame(spark, [{"term": "A b", "zh": "x", "scope": "doc:d"}, {"term": "c", "zh": "y", "scope": "doc:d"}])
    both = G.promote(own, G.terms_frame(spark, [{"term": "z", "zh": "z"}]), "a B")
    assert [(r.scope, r.status) for r in both.where("term = 'A b'").collect()] == [("global", "approved")]
    assert [r.term for r in G.delete(own, spark.createDataFrame([("a b",)], "term string")).collect()] == ["c"]


def test_fields_are_remembered(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, field string")
    known = frame([("a", "x"), ("b", "x"), ("c", "x"), ("z", "q")])
    asked = frame([("a", None), ("b", "y"), ("c", "x"), ("d", " "), ("e", "w"), ("e", "v"), ("e", None)])
    now, keeps = stages.remembered(known, asked)
    assert sorted(map(tuple, now.collect())) == [("a", "x", False), ("b", "y", True), ("c", "x", False), ("d", None, False), ("e", "v", False)]
    assert sorted(map(tuple, keeps.collect())) == [("a", "x"), ("b", "y"), ("c", "x"), ("e", "v"), ("z", "q")]


def test_checkpoints_go_by_document_and_kind(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    mark = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, kind string, sid string, value string")
    asked = spark.createDataFrame([("a", "x")], "doc_id string, field string")
    stages.save_state(spark, root, asked, mark(("a", "translations", "a#1", "1"), ("a", "translations", "a#2", "2"), ("b", "translations", "b#1", "3")))
    stages.save_state(spark, root, asked.limit(0), mark(("a", "scripts", "a#1", "4")))
    now, kept = stages.save_state(spark, root, asked.withColumn("field", F.lit(None).cast("string")), mark(("a", "translations", "a#1", "5")))
    assert [tuple(r) for r in now.collect()] == [("a", "x", False)]
    want = [("a", "scripts", "a#1", "4"), ("a", "translations", "a#1", "5"), ("b", "translations", "b#1", "3")]
    assert sorted(map(tuple, kept.collect())) == want
    # A run that finds nothing new leaves all as it is; a version without its marker is none.
    newest = max(render._versions(spark, f"{root}/checkpoints"))
    os.remove(f"{tmp_path}/state/checkpoints/version={newest:012d}/_SUCCESS")
    _, kept = stages.save_state(spark, root, asked.limit(0), mark(("a", "translations", "a#1", "5")).limit(0))
    assert sorted(map(tuple, kept.collect())) == [("a", "scripts", "a#1", "4"), ("a", "translations", "a#1", "1"), ("a", "translations", "a#2", "2"), ("b", "translations", "b#1", "3")]
