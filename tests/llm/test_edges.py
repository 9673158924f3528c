"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decon, jaccard, kernel, langid, linededup, lmscore, mixing, pii, quality, shard, topk

LONG = "lorem ipsum dolor sit amet " * 20_000
SAME = "the quick brown fox jumps over the lazy dog again and again until night falls on the quiet hill"
ROWS = [
    (1, SAME, "en", "a"), (1, SAME, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", "b"), (5, SAME, "fr", "b"),
    (6, " \n\t ", "en", ""), (None, SAME, "en", "a"), (7, "12345 67890 \n 12345", "fr", "a"), (8, "x" * 100_000, "en", "c"), (9, "퟿ 中文 é", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["sig", "fp", "rank", "slot", "ordinal", "key", "n_lines", "dropped", "score", "kind", "item_id", "k", "bytes", "shard", "cell", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        d = d.selectExpr("*", f"'clash' as {c}")
    return d.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, SAME), (2, None), (3, "too short"), (4, ""), (5, "퟿ 中文 é")], "item_id long, text string")


RUNS = {
    "shard": lambda d, lb, b: shard.assign(d),
    "pii": lambda d, lb, b: pii.detect(d),
    "mixing": lambda d, lb, b: mixing.place(d),
    "lines": lambda d, lb, b: linededup.dedup_lines(d),
    "jaccard": lambda d, lb, b: jaccard.jaccard_classes(d),
    "quality": lambda d, lb, b: quality.classify(d, lb),
    "lm": lambda d, lb, b: lmscore.scored(d, lb),
    "lang": lambda d, lb, b: langid.identify(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_each_row(name, docs, labels, bench):
    assert RUNS[name](docs, labels, bench).count() == len(ROWS)


def values(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=str)


def per_row(of):
    """(doc_id, ...) as expected of each row."""
    return sorted(((i, *of(i, t, s)) for i, t, _, s in ROWS), key=str)


def blank(t):
    return not (t or "").strip()


def test_values_of_shards_and_places(docs):
    size = sum(len((t or "").encode()) for _, t, _, _ in ROWS)
    assert values(shard.assign(docs), "doc_id", "shard", "depth", "shard_bytes", "shard_rows", "oversized") == per_row(lambda i, t, s: ("r", 0, size, len(ROWS), False))
    got = mixing.place(docs).collect()
    assert sorted((str(r["source"]), r["ordinal"], r["block"]) for r in got) == sorted((str(s), n, 0) for s, k in (("a", 5), ("b", 2), ("c", 2), ("", 1), (None, 1)) for n in range(k))
    assert len({(r["source"], r["slot"]) for r in got}) == len({r["slot"] for r in got}) == 5


def test_values_of_classes(docs):
    n = {SAME: 15, LONG: 5}

    def of(i, t, s):
        return (0, i) if blank(t) else (n.get(t, 1), 1 if t == SAME else i)

    assert values(jaccard.jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == per_row(of)


def test_values_of_lines(docs):
    assert values(linededup.dedup_lines(docs), "doc_id", "text", "n_lines", "dropped", "rank") == per_row(lambda i, t, s: (t, 0 if t is None else t.count("\n") + 1, [], "clash"))
    many = docs.unionByName(docs.withColumn("text", F.concat(F.lit("0 "), "text")))
    # SAME stands in four rows, alone on its line; with a digit before it, in four others.
    got = [r for r in linededup.dedup_lines(many, min_docs=4).collect() if r["doc_id"] in (1, 5, None)]
    assert len(got) == 8 and all((r["text"], r["dropped"]) == ("", [0]) for r in got)


def test_values_of_spans(docs):
    got = pii.detect(docs)
    assert values(got, "doc_id", "text", *[f"all_{k}" for k in pii.KINDS]) == per_row(lambda i, t, s: (t or "", [], [], [], []))


def test_values_of_scores(docs, labels):
    got = quality.classify(docs, labels).collect()
    by_text = {}
    for r, t in zip(sorted(got, key=lambda r: str(r["doc_id"])), [t for _, t in sorted(((i, t) for i, t, _, _ in ROWS), key=lambda x: str(x[0]))], strict=True):
        by_text.setdefault(t or "", set()).add(r["score"])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert all(len(v) == 1 for v in by_text.values()) and not [r for r in got if r["doc_id"] is None and r["held_out"]]
    words = lambda t: len((t or "").split())
    assert values(lmscore.scored(docs, labels), "doc_id", "n_tokens") == per_row(lambda i, t, s: (words(t),))
    assert all(r["score"] == 0 for r in lmscore.scored(docs, labels).where("n_tokens = 0").collect())
    for r in langid.identify(docs).collect():
        letterless = r["doc_id"] in (2, 3, 6, 7)
        assert (r["lang_pred"] == "und") == letterless and (not letterless or (r["score"] == 0 and r["rejected"]))


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(kernel, "SLICE_BYTES", 1 << 16)
    long = "alpha beta gamma delta " * 20_000
    docs = spark.createDataFrame([(1, long, "en"), (2, "short text of words", "en"), (3, long, "en")], "doc_id long, text string, lang string")
    assert values(jaccard.jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == [(1, 4, 1), (2, 1, 2), (3, 4, 1)]
    assert values(linededup.dedup_lines(docs), "doc_id", "dropped") == [(1, [0]), (2, []), (3, [0])]
    assert [r["n_tokens"] for r in lmscore.scored(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).orderBy("doc_id").collect()] == [80_000, 4, 80_000]
    item = spark.createDataFrame([(1, "gamma delta alpha beta gamma delta alpha beta")], "item_id long, text string")
    assert {r["doc_id"] for r in decon.contaminated(docs, item).collect()} == {1, 3}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(name, empty, labels, bench):
    assert RUNS[name](empty, labels, bench).collect() == []


def test_filters_keep_columns(spark, docs, empty, bench):
    for out in (jaccard.keep_one(docs), decon.keep_clean(docs, bench), langid.keep_identified(docs), mixing.mixed(docs)):
        assert out.columns == docs.columns
    for out in (jaccard.keep_one(empty), decon.keep_clean(empty, bench), langid.keep_identified(empty), mixing.mixed(empty)):
        assert out.count() == 0
    assert mixing.mixed(docs).count() == len(ROWS)


def test_contamination(docs, empty, bench, spark):
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decon.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 1.0), (5, 1, 1.0), (None, 1, 1.0), (9, 5, 1.0)}
    assert decon.contaminated(empty, bench).count() == 0
    assert decon.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, []), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [-1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as score", "'y' as g")
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).orderBy("rank").collect()]
    assert [g[2] for g in got] == [6, 6, 7, 8] and [g[3] for g in got] == [81920] * 3 + [-65536]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(none, none).count() == 0
