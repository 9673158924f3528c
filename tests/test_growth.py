"""What the work of a query grows with: steps that are made once, and pairs that no shuffle carries."""

import glob
import json
import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.llm import mixing, pii, shard
from scriptorium.operators import abbrev as A
from scriptorium.operators import glossary as G
from scriptorium.operators import layout as L
from scriptorium.plans import base as B
from scriptorium.plans import queries as Q
from scriptorium.sinks import puts

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_taken_from_a_text_once(spark):
    assert plan(Q.abbr_defs(spark, SF)).count("regexp_extract_all(lower(") <= 2


def test_names_beyond_the_start_of_a_text(spark, tmp_path):
    """Names stand behind long runs of short words, and where the start of the text is cut."""
    r, rows = random.Random(5), []
    for i in range(60):
        pad = r.choice(["", "of in ", "x1 "]) * r.choice([0, 1, 70, 400])
        rows.append((i, pad + " ".join("".join(r.choice("abcdef") for _ in range(r.randint(3, 60))) for _ in range(r.randint(5, 14)))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["text"] for x in B.abbreviated(spark, str(tmp_path))[0].collect()}
    import re

    for i, text in rows:
        words = [w for w in re.findall("[a-z]{3,}", text.lower()) if w not in B.T.STOP_WORDS]
        assert (str(i) in got) == (len(words) >= B.NAME_WORDS)
        if str(i) in got:
            assert all(" ".join(words[3 * k : 3 * k + 3]) in got[str(i)] for k in range(3))


def test_pairs_of_documents_and_entries_go_to_no_shuffle(spark):
    names = ["alpha beta", "axe box", "alpha-beta", "arm band"]
    defs = [(f"d{i}", "AB", names[i % 4]) for i in range(40)]
    prose = [(f"d{i}", "AB and AB") for i in range(40)]
    terms = [(k, "AB", f"z{k}", ["alpha beta", "", "axe box", "else"][k % 4]) for k in range(30)] + [(50, "XY", "y", "arm band"), (None, "AB", "n", "arm band")]
    d = spark.createDataFrame(defs, "doc_id string, abbr string, full string")
    p = spark.createDataFrame(prose, "doc_id string, text string")
    g = spark.createDataFrame(terms, "ord int, term string, zh string, full_en string")
    out = A.disambiguate(d, g, p)
    norm = lambda t: t.replace("-", " ")
    want = set()
    for doc, abbr, full in defs:
        for o, t, zh, name in terms:
            if t == abbr:
                others = sorted((k, z) for k, _, z, f in terms if f and norm(f) == norm(full) and k is not None and k != o)
                verdict = "unknown" if not name else "resolved" if norm(name) == norm(full) else "conflict"
                want.add((doc, abbr, full, 2, o, verdict, others[0][1] if others else None))
    got = [tuple(r) for r in out.select("doc_id", "abbr", "full", "n", "ord", "verdict", "reusable_zh").collect()]
    assert len(got) == len(want) and set(got) == want
    # Nothing is grouped after the join by abbreviation, which is the last one.
    lines = plan(out).splitlines()
    assert not any("Aggregate" in x for x in lines[: next(k for k, x in enumerate(lines) if "Join" in x)])


def test_all_documents_teach(spark, monkeypatch):
    """A model counts the candidates of every document, however many there are."""
    rows = spark.range(45_000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'call +1 555 123 4567 now' else concat('order 12 34 ', id % 7) end as text")
    weights = []
    tree = pii.Trees.__init__
    monkeypatch.setattr(pii.Trees, "__init__", lambda self, x, y, w: (weights.append((y * w).sum()), tree(self, x, y, w))[1])
    pii.learn(rows)
    halves = rows.where("doc_id % 2 = 0 and pmod(xxhash64(cast(doc_id as string)), 2) = 0").count()
    assert weights and max(weights) == halves


def test_shards_follow_the_mixture(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(i, "x" * r.randint(1, 60), "aa", r.choice(["src0", "src1", "src4", None]), 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    monkeypatch.setattr(shard, "BYTE_LIMIT", 4096)
    place = {x["doc_id"]: (x["slot"], x["ordinal"]) for x in mixing.place(docs).collect()}
    pipeline.mix_sources(spark, docs, "").write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/mixed")
    for mixed in (spark.read.parquet(f"{tmp_path}/mixed"), spark.createDataFrame(pipeline.mix_sources(spark, docs, "").collect(), docs.schema)):
        got = {x["doc_id"]: x for x in pipeline.shards(spark, mixed, "").collect()}
        assert set(got) == {x[0] for x in rows} and all(x["shard_bytes"] <= 4096 for x in got.values())
        order = [got[i]["shard"] for i in sorted(got, key=lambda i: place[i])]
        assert len(set(order)) > 4 and order == sorted(order)


def test_lines_meet_the_rectangles_of_their_page_once(spark):
    lines = [("p", 0, 10.0, 20.0, 100.0, "a"), ("p", 0, 250.0, 20.0, 100.0, "b"), ("p", 1, 60.0, 40.0, 80.0, "c"), ("p", 1, 151.5, 240.0, 262.0, "e"), ("q", 0, 10.0, 20.0, 100.0, "f"), (None, 0, 10.0, 20.0, 100.0, "g")]
    rects = [("p", 0, 0.0, 0.0, 300.0, 200.0), ("p", 0, 0.0, 0.0, 300.0, 200.0), ("p", 1, 50.0, 50.0, 250.0, 150.0), ("p", 1, None, 0.0, 1.0, 1.0), (None, 0, 0.0, 0.0, 300.0, 200.0)]
    d = spark.createDataFrame(lines, "doc_id string, page int, y0 double, x0 double, x1 double, text string")
    r = spark.createDataFrame(rects, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    out = L.in_rects(d, r)
    assert sorted((x["text"], x["in_rect"]) for x in out.collect()) == [("a", True), ("b", False), ("c", True), ("e", True), ("f", False), ("g", False)]
    assert plan(out).count("Join") == 1


def test_documents_are_typeset_without_a_shuffle(spark):
    for rows in B.typeset(spark, SF):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_a_layout_reads_counts_not_lines(spark):
    """No text is kept for a layout, and nothing but the counts is read twice."""
    kept = []
    spans, _, _, pages = B.typeset(spark, SF)
    L.span_layouts(spans, pages, lambda d: kept.append(d) or d)
    assert kept and all({"text", "raw", "sizes"}.isdisjoint(d.columns) for d in kept)


def test_lines_are_shuffled_and_sorted_once_to_be_classified(spark):
    lines, rects, width = B.laid_out(spark)
    how = L.layout(lines, width)
    marked = L.marks(L.in_rects(lines, rects))
    marked = spark.createDataFrame(marked.collect(), marked.schema)
    got = L.reading_order(L.classify(marked, spark.createDataFrame(how.collect(), how.schema)))
    text = got._jdf.queryExecution().executedPlan().toString()
    # The lines and the layouts go to their documents; the join sorts both, the windows share one order.
    assert text.count("Exchange hashpartitioning") + text.count("Exchange REPARTITION") <= 2 and text.count("Sort [") <= 3
    assert sorted((r["page"], r["y0"], r["x0"], r["kind"]) for r in got.collect()) == sorted(B.LINE_KINDS)


def test_segments_are_made_where_their_document_is(spark):
    """From classified lines to segments no line is joined, read twice or shuffled, and a heading is named on its own line."""
    lines, rects, width = B.laid_out(spark)
    how = L.layout(lines, width)
    marked = L.marks(L.in_rects(lines, rects))
    marked = spark.createDataFrame(marked.collect(), marked.schema)
    got = L.paragraphs(L.reading_order(L.classify(marked, spark.createDataFrame(how.collect(), how.schema))))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") + text.count("Exchange REPARTITION") <= 2
    assert plan(got).count("Join") == 1 and plan(got).count("[‘’“”]") == 1
    assert len({r["sid"] for r in got.collect()}) == len(B.LINE_SEGMENTS)


def test_pages_are_made_of_all_texts_once(spark):
    kept = []
    spans, drawings, images, pages = B.typeset(spark, SF, lambda d: kept.append(d) or spark.createDataFrame(d.collect(), d.schema))
    assert len(kept) == 1 and plan(spans).count("parquet") == 1
    assert all("parquet" not in plan(d) for d in (drawings, images, pages))


def test_lines_alike_are_counted_together(spark):
    """Measures are those of each line by itself: lines of no, one and several fonts, sizes out of bounds, no text."""
    long = "word " * 12
    rows = [
        ("d", 40.0, long, [9.0, 9.04], {"Serif": 50, "Sans": 9}), ("d", 40.0, long, [9.0, 9.04], {"Sans": 9, "Serif": 50}), ("d", 40.0, long, [9.0, 9.04], {"Sans": 50, "Serif": 9}), ("d", 40.0, long, [9.0], {"Serif": 7}),
        ("d", 40.0, long + "more", [9.0], {"Serif": 11}), ("d", 41.0, "short", [9.0], {"Serif": 5}), ("d", 42.0, None, [9.0], {"Serif": 3}), ("d", 40.0, long, [40.0], {"Serif": 2}), ("e", 1.0, "x", [], {}), ("e", 1.0, "y", None, None),
    ] * 2
    lines = spark.createDataFrame(rows, "doc_id string, x0 double, text string, sizes array<double>, font_chars map<string,int>")
    want = {}

    def add(n, *key):
        want[key] = None if n is None and want.get(key) is None else (want.get(key) or 0) + (n or 0)

    for doc, x0, text, sizes, fonts in rows:
        n, top = None if text is None else len(text), max(sizes) if sizes else None
        add(0, doc, "line", None, None, None)
        for s in sizes or []:
            if 5 <= s <= 16:
                add(n, doc, "size", round(s, 1), None, None)
        for font, k in (fonts or {}).items():
            add(k, doc, "font", top, font, None)
        if (n or 0) >= L.PROSE_MIN_LENGTH:
            add(1, doc, "edge", top, min(fonts, key=lambda f: (-fonts[f], f)), x0)
    got = {tuple(r)[:5]: r["n"] for r in L.measures(lines).collect()}
    assert got == want


def test_lines_are_put_together_and_end_as_patterns_say(spark):
    texts = ["ends.", "ends", "so?\")", "so\"?x", "a:’”", ")", "", "a.)\n", "a.\n)", "b)\r\n", "c.\u2028", "two  three", " x", "in\u00a0side", "hy-", "dash--", "end-\t", "-", None, "a\tb", "é…”", "no.\"\n\n"]
    ends = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.ends_sentence(F.col("t")).alias("got"), F.regexp_replace("t", "[\"”’)]+$", "").rlike(r"[.?!:]$").alias("want"))
    assert [r for r in ends.collect() if r["got"] != r["want"]] == []
    r = random.Random(2)
    lists = spark.createDataFrame([([r.choice(texts) for _ in range(r.randint(0, 5))],) for _ in range(400)], "a array<string>")
    whole = F.array_join(F.transform("a", lambda t: F.trim(t)), "\n")
    want = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"(?<!-)-\n", ""), "\n", " "), r"(?U)\s+", " "), "^ | $", "")
    assert [x for x in lists.select("a", T.join_lines(F.col("a")).alias("got"), want.alias("want")).collect() if x["got"] != x["want"]] == []


def test_edges_and_few_letters(spark):
    """A line's neighbours are those of its column, other kinds between them left out; three letters anywhere are more than few."""
    r = random.Random(4)
    rows = [(k % 3, n, n // 9, n // 5 % 2, r.choice([1.0, 2.5, 7.0, 9.0]), r.choice(["body", "runin", "h1", "figure"])) for k in range(3) for n in range(120)]
    got = L.right_edge(spark.createDataFrame(rows, "doc_id int, pos int, page int, col int, x1 double, kind string")).collect()
    want = set()
    for doc in range(3):
        own = [x for x in sorted(rows) if x[0] == doc and x[5] in ("body", "runin")]
        for k, x in enumerate(own):
            near = sorted(y[4] for y in own[max(0, k - L.WINDOW) : k + L.WINDOW + 1] if y[2:4] == x[2:4])
            want.add((doc, x[1], near[int(len(near) * 0.85)] if len(near) >= L.MIN_WINDOW else None))
    assert {(x["doc_id"], x["pos"], x["edge"]) for x in got} == want and len(got) == len(want)
    texts = ["", "a", "a1b", "a1b2c", "abc", "....a....b", "终A于b", None, "é é é", "a\nb\nc"]
    few = spark.createDataFrame([(t,) for t in texts], "t string").select(~F.col("t").rlike(L.THREE_LETTERS), F.regexp_count("t", F.lit("[A-Za-z]")) <= 2)
    assert all(x[0] == x[1] for x in few.collect())


def test_pages_reach_python_in_small_batches(spark):
    text = Q.html_sections_web(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in text and "ArrowEvalPython" not in text


def test_answers_are_parsed_once_in_either_way(spark):
    assert plan(Q.digest_payload_json(spark, SF)).lower().count("from_json") + plan(Q.digest_payload_json(spark, SF)).lower().count("jsontostructs") <= 2


def test_a_lot_that_is_through_is_one_file(spark, tmp_path):
    """A commit reads as many files as there are lots, whatever the number of calls; a task run again adds to what its lot has."""
    odd = ['q"\\', "n\nr\r\u2028", "é😀", "", "\0"]
    rows = spark.createDataFrame([(f"k{k}{odd[k % 5]}", f"p{k}{odd[k % 5]}") for k in range(300)], "key string, prompt string")
    call = lambda prompts, keys: [f"<{p}>" for p in prompts]
    for n in (200, 300):
        puts.ask(rows.limit(n), "prompt", call, f"file://{tmp_path}/cache")
        found = glob.glob(f"{tmp_path}/cache/attempts/lot=*/answers-*")
        assert len(found) == 1
        with open(found[0], newline="\n") as f:
            assert len({json.loads(x)["key"] for x in f}) == n
    got = puts.put_once(rows, "prompt", call, f"file://{tmp_path}/cache")
    assert {(r.key, r.value, r.cached) for r in got.collect()} == {(r.key, f"<{r.prompt}>", True) for r in rows.collect()}


def test_a_lot_that_is_folded_while_it_is_read_is_read_again(tmp_path, monkeypatch):
    lot, left = f"file://{tmp_path}/lot", []
    first = puts.Lot(lot)
    first.note({"a": "1"})
    first.note({"b": "2"})
    listed = puts._at

    class Late:
        def __init__(self, disk):
            self.disk = disk

        def __getattr__(self, name):
            return getattr(self.disk, name)

        def get_file_info(self, what):
            found = self.disk.get_file_info(what)
            if not left:
                left.append(len(found))
                first.close()
            return found

    monkeypatch.setattr(puts, "_at", lambda address: (Late(listed(address)[0]), listed(address)[1]))
    second = puts.Lot(lot)
    assert left == [2] and second.known == {"a": "1", "b": "2"} and len(second.files) == 1


def test_a_put_reads_its_answers_by_one_join(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, prompt string")
    puts.put_once(rows.limit(1), "prompt", lambda p, k: p, f"file://{tmp_path}/cache")
    got = puts.put_once(rows, "prompt", lambda p, k: p, f"file://{tmp_path}/cache")
    assert {tuple(r) for r in got.select("key", "value", "cached").collect()} == {("a", "x", True), ("b", "y", False)}
    # The other is that of the errors.
    assert plan(got).count("Join") == 2


def test_few_terms_are_looked_for_without_runs_of_characters(spark, monkeypatch):
    """A text's rows are the terms that it holds, not its runs; more terms meet by their runs, with the same result."""
    for q in (Q.term_hits_web, Q.term_density):
        assert "regexp_extract_all" not in plan(q(spark, SF))
    terms = ["The", "the", "he", "a", "b c", "Über", "终于", "", "😀x", "a.b", "nowhere"]
    rows = [(str(k), x) for k, x in enumerate(["The heath; aaaa", "über b c", "终于来到", "", None, "😀😀x the THE", "the", "the"])]
    table = spark.createDataFrame([*rows, rows[0]], "sid string, src_text string")
    want = sorted((s, t) for s, x in [*rows, rows[0]] for t in terms if t and x and t.lower() in x.lower())
    for few in (G.FEW_NEEDLES, 3):
        monkeypatch.setattr(G, "FEW_NEEDLES", few)
        got = G.web_hits(table, G.terms_frame(spark, [{"term": t, "zh": "z"} for t in terms]))
        assert sorted((r.sid, r.term) for r in got.collect()) == want
    assert G.web_hits(table, G.terms_frame(spark, [{"term": "", "zh": "z"}])).count() == 0
