"""Token counts of whole texts against the library, with splices, wider overlaps and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "don't", "we'll", "internationalization", "THE", "https://example.org/a?b=c&d=e", " " * 60, "é", "İß", "😀", "한국어", "中文字"]


def library(text):
    return len(tokens.tokenizer(PATH).encode(text, add_special_tokens=False).ids)


def mixed(r, size):
    out = ""
    while len(out) < size:
        out += r.choice(SPECIAL) + r.choice(["", "", " ", "\n"]) if r.random() < 0.3 else r.choice("abcdefgh ,.0123́中 ") * r.choice([1, 1, 2])
    return out


def test_spliced_counts_equal_the_library(spark):
    r = random.Random(3)
    rows = [(k, mixed(r, r.randint(50, 6000))) for k in range(60)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, chunk=400, overlap=150)
    assert {(x.doc_id, x.n_tokens, x.n_bytes) for x in got.collect()} == {(k, library(t), len(t.encode())) for k, t in rows}


def test_every_common_cut_is_a_boundary():
    r = random.Random(4)
    for _ in range(20):
        t = mixed(r, 3000)
        whole = library(t)
        _, (_, tail) = tokens.cuts(t[:1700], 0, [(0, 0), (1548, 1652)], PATH)
        n, (head,) = tokens.cuts(t[1500:], 1500, [(1548, 1652)], PATH)
        for c in tail.keys() & head.keys():
            assert tail[c] + n - head[c] == whole


def test_overlaps_widen_where_no_cut_is_common(spark):
    # White space over whole overlaps: no cut lies in the narrow ones.
    t = "word " * 100 + " " * 3000 + "word " * 100
    u = "a" * 5000
    rows = [(1, t), (2, t), (3, u), (4, "short"), (5, u + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    narrow = tokens.spliced(docs.select(F.sha2("text", 256).alias("digest"), "text").where("doc_id = 1"), PATH, 1000, 100, "narrow")
    assert [x.n_tokens for x in narrow.collect()] == [None]
    got = tokens.token_counts(docs, PATH, chunk=1000, overlap=100)
    assert {(x.doc_id, x.n_tokens) for x in got.collect()} == {(k, library(x)) for k, x in rows}


def test_edges(spark):
    rows = [(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "x" * 100_000), (4, " \n\t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "seq", "n_tokens", "n_bytes", "piece", "n", "cut")})
    got = tokens.token_counts(docs, PATH, chunk=1000, overlap=100)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x.doc_id, x.n_tokens, x.n_bytes) for x in got.collect()), key=str) == sorted(((k, library(t or ""), len((t or "").encode())) for k, t in rows), key=str)
    assert {x.digest for x in got.collect()} == {"clash"}
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_have_the_tokens_of_their_text(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 50)
    r = random.Random(9)
    space = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x0b", "\x1c", "\x85", " ", " ́", "​"]
    texts = ["".join(r.choice([*SPECIAL, *"abc.,!é0"]) + r.choice(["", *space]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    assert tokens.lengths(texts, PATH) == [library(t) for t in texts]
