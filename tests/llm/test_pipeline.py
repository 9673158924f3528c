"""The pipeline and each of its stages against a brute-force version."""

import hashlib
import random

import pytest

import corpus_pipeline as pipeline
from scriptorium.llm import langid, mixing, shard

from test_operators import brute_classes, edited, naive_alignment, text_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(71)
    langs = {"aa": ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)], "bb": ["".join(r.choice("klmnopqr") for _ in range(r.randint(2, 8))) for _ in range(300)]}
    items = [(k, text_of(langs["aa"], 30, r)) for k in range(6)]
    texts = []
    for i in range(260):
        lang = "aa" if i % 3 else "bb"
        texts.append((text_of(langs[lang], r.randint(25, 80), r), lang))
    texts += [(t, lang) for base, lang in texts[:30] for t in edited([base], r, langs[lang])]
    for k in range(8):
        w = items[k % 6][1].split()
        w[5] = "other"
        texts.append((" ".join([text_of(langs["aa"], 20, r), *w, text_of(langs["aa"], 20, r)]), "aa"))
    texts += [("\u0436\u044b\u0437\u043d\u044c \u0445\u043e\u0440\u043e\u0448\u0430 \u0438 \u0436\u0438\u0442\u044c " * 20, None), ("1234 !!", "aa"), (None, None), ("", "bb"), (texts[0][0].upper(), "aa")]
    rows = [(i, t, lang, r.choice(["src0", "src0", "src0", "src1", "other", None]), len(t or "")) for i, (t, lang) in enumerate(texts)]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, items


def by_id(rows):
    return {r[0]: tuple(r) for r in rows}


def test_pipeline(spark, corpus):
    top, rows, items = corpus
    docs, seen = spark.read.parquet(f"{top}/documents.parquet"), []
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, top)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    assert all(d.columns == [c.split()[0] for c in COLUMNS.split(", ")] for d in seen[:-1])
    every, left = by_id(rows), [by_id(d.collect()) for d in seen[:-1]]
    # What stays is as it was.
    assert all(every[i] == r for d in left for i, r in d.items())
    # Language: texts of the two languages stay; those of another script or without letters go.
    gone = {i for i, t, _, _, _ in rows if not t or not any(c.isalpha() and c.isascii() for c in t)}
    assert set(left[0]) == set(every) - gone
    # One document of each class.
    classes = brute_classes([(i, r[1]) for i, r in sorted(left[0].items())], 5, 80)
    assert set(left[1]) == {c for _, _, c in classes}

    def leaks(t):
        for _, item in items:
            a, b = item.split(), t.lower().split()
            grams = {tuple(b[k : k + 4]) for k in range(len(b) - 3)}
            if any(tuple(a[k : k + 4]) in grams for k in range(len(a) - 3)) and naive_alignment(a, b) >= 0.4 * len(a):
                return True
        return False

    assert set(left[2]) == {i for i, r in left[1].items() if not leaks(r[1])}
    # The mixture holds all rows, in the order of their slots.
    slot = {r["doc_id"]: (r["slot"], r["ordinal"]) for r in mixing.place(seen[2]).collect()}
    order = [r["doc_id"] for r in mixing.mixed(seen[2]).collect()]
    assert set(left[3]) == set(left[2]) and [slot[i] for i in order] == sorted(slot[i] for i in order)
    size = sum(len(r[1].encode()) for r in left[3].values())
    want = {(i, "r", 0, size, len(left[3]), False) for i in left[3]}
    assert {tuple(r) for r in seen[4].collect()} == want
    assert {tuple(r) for r in pipeline.run(spark, top).collect()} == want
    # With a limit that splits.
    small = shard.assign(seen[3], 4096).collect()
    assert len({r["shard"] for r in small}) > 1
    for r in small:
        bits = bin(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(r["shard"][1:]) and r["shard_bytes"] <= 4096
    assert langid.MARGIN_BITS > 0
