"""The operators against brute force and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import decon, jaccard, kernel, langid, linededup, lmscore, mixing, pii, quality, registry, shard, topk


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]


def text_of(words, n, r):
    return " ".join(r.choice(words) for _ in range(n))


def brute_classes(rows, n, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def edited(rows, r, words):
    """Copies with some words replaced, from none to a quarter."""
    out = []
    for t in rows:
        for _ in range(r.randint(0, 6)):
            w = t.split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 85, 3)])
def test_jaccard_classes_equal_brute_force(spark, n, percent, seed):
    r, words = random.Random(seed), vocabulary(seed)
    base = [text_of(words, k, r) for k in (1, 2, 3, 5, 9, 10, 11, 12, 15, 19, 20, 25, 30, 40, 60, 90, 140, 250, 400, 900)]
    common = text_of(words, 30, r)
    texts = base + edited(base, r, words) + [common + " " + text_of(words, k, r) for k in (3, 5, 8, 20, 60)] + ["The QUICK\tfox", "the quick\nfox", "É é", "é é", "", None]
    rows = list(enumerate(texts))
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent)
    assert {tuple(x) for x in got.collect()} == brute_classes(rows, n, percent)


def test_rows_without_an_id_link_as_others_do(spark):
    r, words = random.Random(77), vocabulary(77)
    a = [r.choice(words) for _ in range(60)]
    chain = [" ".join(a), " ".join(a[:-4] + ["p", "q", "r", "s"]), " ".join(["k", "l", "m", "n"] + a[4:-4] + ["p", "q", "r", "s"])]
    lone = [text_of(words, 50, r) for _ in range(3)]
    near = [t + " more" for t in lone]
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (None, chain[1]), (None, lone[0]), (None, near[0]), (9, lone[1]), (None, near[1]), (9, near[1]), (None, ""), (None, None), (8, lone[2])]
    for percent in (80, 85):
        named = [(k if d is None else d, t) for k, (d, t) in enumerate(rows, 100)]
        want = {n: c for n, _, c in brute_classes([(k, t) for k, (_, t) in enumerate(rows)], 5, percent)}
        classes = {}
        for k, c in want.items():
            classes.setdefault(c, []).append(rows[k][0])
        least = {c: min((d for d in ids if d is not None), default=None) for c, ids in classes.items()}
        got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, percent)
        assert sorted(((x.doc_id, x.component_id) for x in got.collect()), key=str) == sorted(((d, least[want[k]]) for k, (d, _) in enumerate(rows)), key=str)
        assert len(named) == len(rows)


def test_keep_one_judges_rows_not_ids(spark):
    r, words = random.Random(51), vocabulary(51)
    a, b, c = (text_of(words, 40, r) for _ in range(3))
    near = a + " more"
    rows = [(1, a, "x"), (1, a, "x"), (2, near, "x"), (2, b, "y"), (3, c, "z"), (3, c.upper(), "w"), (4, "", "e"), (4, None, "n"), (5, "", "e"), (6, b, "y"), (None, a, "q"), (7, near, "x")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    left = sorted((str(x["doc_id"]), x["text"] or "", x["source"]) for x in got)
    three = [x for x in left if x[0] == "3"]
    assert len(three) == 1 and three[0][1].lower() == c
    assert [x for x in left if x[0] != "3"] == sorted([("1", a, "x"), ("2", b, "y"), ("4", "", "e"), ("4", "", "n"), ("5", "", "e"), ("None", a, "q")])


def test_large_buckets_are_joined_in_blocks(spark, monkeypatch):
    # A chain of near copies in one bucket, held against each other in blocks of four.
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    r, words = random.Random(52), vocabulary(52)
    base = text_of(words, 40, r).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 12):
            w[3 * k] = f"v{k}" if i % 2 else f"u{k}"
        rows.append((i, " ".join(w)))
    for n, percent in ((1, 85), (3, 80)):
        got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent)
        assert {tuple(x) for x in got.collect()} == brute_classes(rows, n, percent)


def test_light_segments_lose_no_link():
    r = np.random.default_rng(5)
    for percent in (80, 90):
        for n in (10, 14, 20, 33, 60, 120, 300, 1000):
            s = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            own = set(jaccard.signatures(s, percent)[0].tolist())
            for _ in range(60):
                d = jaccard.differences(percent, len(s))
                out = r.integers(0, d + 1)
                kept = r.permutation(s)[: len(s) - out]
                t = np.unique(np.concatenate((kept, r.integers(0, 2**63, max(0, (d - out) // 2)).astype(np.uint64))))
                both = len(np.intersect1d(s, t))
                if len(t) and 100 * both >= percent * (len(s) + len(t) - both) and len(s) != both:
                    assert own & set(jaccard.signatures(t, percent)[0].tolist()), (percent, n)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(6)
    for n, m in ((5, 9), (100, 80), (1000, 1100), (50, 3000)):
        pool = np.unique(r.integers(0, 2**63, 4000).astype(np.uint64))
        a, b = np.unique(r.choice(pool, n)), np.unique(r.choice(pool, m))
        assert jaccard.apart_at_least(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_words_are_exact():
    texts = ["", " a", "a", "AbC abc", "longerthaneightbytes longerthaneightbytez", "tab\tnl\nvt\x0bff\x0ccr\rx", "é É", "a\x00b", "z" * 1000 + " " + "z" * 1001]
    h, offs, _ = kernel.word_hashes([t.encode() for t in texts])
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert np.diff(offs).tolist() == [len(w) for w in words]
    flat = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for w in words for x in w]
    assert len(set(h.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(h.tolist(), flat, strict=True)}) == len(set(flat))


def brute_pii(t):
    out = {}
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        out[kind] = []
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in odd) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = [
    "mail a.b+c@x-y.co.uk, é 😀 d@e.f@g.h and x@y", "a@b.c_d@e.f .@x.y %@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 000255.1.2.3 1.2.3.999 12.34.56.78", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 5500005555555559",
    "+1 (555) 123-4567 +12 +1234567 +12345678 +49 30 1234567890123456 ++44 20 7946 0958 ", "1--2 3 4 5 " + "9" * 30, "9" * 20_000 + "." + "8" * 20_000, "a" * 50_000 + "@", "a.b" * 10_000 + "@c" + ".d" * 20_000, "1-" * 30_000, "", None, "+1" + " " * 10_000 + "x",
    "call +1 (599) 555-3756 now, card 4637089055456426 ok", "1.2.3.4", "@@@ ...", "mail me@here.org me@here.org",
]


def test_pii_base_spans_equal_brute_force(spark):
    rows = list(enumerate(PII))
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in found.select("doc_id", pii.listed("base").alias("base"), pii.listed("all").alias("every"), *[f"base_{k}" for k in pii.KINDS]).collect()}
    for i, t in rows:
        want = [x for k in pii.KINDS for x in brute_pii(t)[k]]
        assert got[i]["base"] == ",".join(want), t and t[:60]
        assert set(want) <= set(got[i]["every"].split(",")) | {""}


def test_pii_boosting_adds_spans_and_leaves_clean_text(spark):
    r = random.Random(3)
    good = [(i, f"my phone is +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} thanks") for i in range(300)]
    clean = [(1000 + i, f"version {r.randint(1, 9)} of {r.randint(10, 99)} items 10 20 30 40 50 60") for i in range(300)]
    extra = [(5000, "my phone is (555) 555-1234 thanks")]
    got = {x["doc_id"]: x["all_phone"] for x in pii.detect(spark.createDataFrame(good + clean + extra, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in clean)
    assert [(x["s"], x["e"]) for x in got[5000]] == [(12, 26)]
    red = {x["doc_id"]: x["text"] for x in pii.redact(pii.detect(spark.createDataFrame(good, "doc_id long, text string"))).collect()}
    assert set(red.values()) == {"my phone is [PHONE] thanks"}


def test_pii_finds_common_formats_that_the_base_patterns_miss(spark):
    r, rows, want = random.Random(15), [], {}
    for i in range(200):
        n, host = f"{r.randint(200, 999)}", f"host{r.randint(1, 99)}"
        for kind, lead, span in (("phone", "my phone is ", f"+1 ({n}) 555-{r.randint(1000, 9999)}"), ("phone", "my phone is ", f"({n}) 555-{r.randint(1000, 9999)}"), ("email", "mail to ", f"jo{n}@{host}.com"), ("email", "mail to ", f"jo{n} at {host} dot com"), ("email", "mail to ", f"jo{n} @ {host}.com")):
            want[len(rows)] = (kind, len(lead), len(lead) + len(span))
            rows.append((len(rows), f"{lead}{span} thanks"))
        for clean in (f"version {r.randint(1, 9)} of items 10 20 30 40 50 60", f"they met at noon{n}. Then all left", f"they write at noon{n}. Then all left"):
            rows.append((len(rows), clean))
    for x in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got = [(k, s["s"], s["e"]) for k in ("email", "phone") for s in x[f"all_{k}"]]
        assert got == ([want[x["doc_id"]]] if x["doc_id"] in want else []), dict(rows)[x["doc_id"]]


def test_shards_fit_and_split_only_where_needed(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 400)) for i in range(3000)] + [(9999, "y" * 9000)]
    limit = 5000
    got = shard.assign(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert len(got) == len(rows)
    size, names = {}, {x["doc_id"]: x["shard"] for x in got}
    for i, t in rows:
        size[names[i]] = size.get(names[i], 0) + len(t)
        bits = bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(names[i][1:])
    over = {x["shard"] for x in got if x["oversized"]}
    assert all(n <= limit for s, n in size.items() if s not in over) and over == {names[9999]}
    parents = {}
    for i, t in rows:
        parents[names[i][:-1]] = 0
    for i, t in rows:
        bits = "r" + bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        for p in parents:
            if bits.startswith(p):
                parents[p] += len(t)
    assert all(n > limit for n in parents.values())


def test_period_deviates_by_less_than_one_block():
    for parts in ({"a": 6, "b": 5, "c": 2, "d": 1}, {"x": 1}, {str(i): 1 + i % 7 for i in range(25)}):
        total, done = sum(parts.values()), dict.fromkeys(parts, 0)
        for slot, name, nth in mixing.period(parts):
            assert done[name] == nth
            done[name] += 1
            assert all(abs(done[k] - (slot + 1) * parts[k] / total) < 1 for k in parts)
        assert done == parts


def test_mixture_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", None])) for i in range(2000)]
    parts, default, block = {"a": 3, "b": 2}, 1, 7
    got = mixing.place(spark.createDataFrame(rows, "doc_id long, source string"), parts, default, block).collect()
    weights = {s: parts.get(s, default) for _, s in rows}
    once = mixing.period({str(s): w for s, w in weights.items()})
    total, want = sum(weights.values()), {}
    for s in weights:
        own = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i, x in rows if x == s)
        for k, (_, i) in enumerate(own):
            b = k // block
            want[i] = (s, b, k)
    assert {x["doc_id"]: (x["source"], x["block"], x["ordinal"]) for x in got} == want
    slots = {}
    for x in got:
        slots.setdefault((x["source"], x["block"]), set()).add(x["slot"])
    assert all(len(v) == 1 for v in slots.values()) and len({next(iter(v)) for v in slots.values()}) == len(slots)
    for (s, b), v in slots.items():
        w = weights[s] / total
        assert b / w - 1e-9 <= next(iter(v)) + 1 and next(iter(v)) + 1 <= -(-(b + 1) * total // weights[s])


def test_recurring_templates_go(spark):
    r, words = random.Random(8), vocabulary(8)
    rows = [(i, "\n".join([text_of(words, 12, r), f"Printed on 2024-{i:02d} page {i} of 99", f"Licensed under the terms of {words[i]} open licence agreement below", "", text_of(words, 3, r)])) for i in range(30)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for x in got:
        lines = dict(rows)[x["doc_id"]].split("\n")
        assert x["dropped"] == [1, 2] and x["text"] == "\n".join([lines[0], "", lines[4]]) and x["n_lines"] == 5
    few = linededup.dedup_lines(spark.createDataFrame(rows[:5], "doc_id long, text string")).collect()
    assert all(x["dropped"] == [] for x in few)


def test_fields_of_any_place_become_fields(spark):
    r, words = random.Random(61), vocabulary(61)
    names, towns = [f"na{w}" for w in words[:200]], [f"to{w}" for w in words[200:]]
    passage = [text_of(words, 60, r).split()] * 2
    passage[1] = list(passage[0])
    passage[1][40] = "edited"
    rows = []
    for i in range(200):
        lines = [
            f"Posted by {names[i]} in {towns[i]}",  # short, two rare fields, one of them among the leading tokens
            f"Posted in {towns[i % 4]} by {names[i % 7]} for {names[7 + i % 9]} and all friends",  # fields of common values
            f"{names[i]} wrote this long line for the {names[-i - 1]} {towns[i]} and for nobody else",  # fields at both ends, one of two words
            text_of(words, 9, r),
            " ".join(passage[0] if i == 3 else passage[1] if i == 77 else [text_of(words, 60, r)]),  # a passage in two documents, one of them edited
        ]
        rows.append((i, "\n".join(lines)))
    for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x["dropped"] == ([0, 1, 2, 4] if x["doc_id"] in (3, 77) else [0, 1, 2])


def test_lines_are_dropped_by_row_not_by_id(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BATCH_BYTES", 400)
    monkeypatch.setattr(linededup, "RANGE_TOKENS", 50)
    licence = "All of this is licensed to you"
    rows = [(i, f"own{i} line{'a' * i}\n{licence}", "c") for i in range(10)]
    rows += [(100, "keep me alpha\nkeep me beta", "x"), (100, licence + "\nsecond", "y"), (None, "keep me gamma\nkeep me delta", "x"), (None, "first\n" + licence, "y"), (200, licence, "z"), (200, licence, "z"), (300, None, "n"), (301, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string").repartition(3)
    got = sorted((str(x["doc_id"]), x["text"], x["dropped"]) for x in linededup.dedup_lines(docs).collect() if x["text"] is not None and (x["doc_id"] is None or x["doc_id"] >= 100))
    assert got == [("100", "keep me alpha\nkeep me beta", []), ("100", "second", [0]), ("200", "", [0]), ("200", "", [0]), ("301", "", []), ("None", "first", [1]), ("None", "keep me gamma\nkeep me delta", [])]


def test_quality_on_held_out_rows(spark):
    r, words = random.Random(2), vocabulary(2)
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.3
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in text_of(words, r.randint(20, 90), r).split(" "))))
        labels.append((i, int(not bad), 0))
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    held = [x for x in got if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)


def test_quality_of_a_text_does_not_depend_on_its_neighbours():
    r, words = random.Random(31), vocabulary(31)
    texts = [text_of(words, n, r).encode() for n in (0, 1, 3, 40, 41, 43, 200, 2000)] * 8
    net = quality.Network()
    net.fit([t + b"!!" * (i % 2) for i, t in enumerate(texts)], np.arange(len(texts)) % 2.0, epochs=1)
    mixed = [t.decode() for t in texts] + [None, "é" * 300, "x" * (quality.SLICE + 5), "a"]
    alone = [net.scores([t])[0] for t in mixed]
    assert net.scores(mixed).tolist() == alone and net.scores(mixed[::-1]).tolist() == alone[::-1]
    # The whole-number network against a plain reading of the definition.
    f = net.frozen
    for t in (texts[3], texts[6]):
        n = max(1, -(-len(t) // quality.BLOCK))
        raw = t + b"\0" * (n * quality.BLOCK + quality.WIDTH - quality.STRIDE - len(t))
        resp = [[sum(float(f.embed[raw[w * quality.STRIDE + b], e]) * float(f.filters[b * quality.EMBED + e, k]) for b in range(quality.WIDTH) for e in range(quality.EMBED)) for k in range(quality.FILTERS)] for w in range(n * quality.PER_BLOCK)]
        tops = [[max(row[k] for row in resp[b * quality.PER_BLOCK : (b + 1) * quality.PER_BLOCK]) + float(f.bias[k]) for k in range(quality.FILTERS)] for b in range(n)]
        chunk = [sum(max(0.0, *(x[k] for x in tops[b : b + 2])) * f.out[k] for k in range(quality.FILTERS)) + f.shift[0] for b in range(max(1, n - 1))]
        want = 1 / (1 + math.exp(-sum(chunk) / len(chunk) * net.scale))
        assert net.scores([t.decode()])[0] == pytest.approx(want, abs=1e-12)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    v = r.normal(0, 0.2, (700, 24)).astype(np.float32)
    v[300:400] = v[300]
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5).collect()}
    for i in range(0, 700, 50):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(700) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -n) for n, j in best]


def test_top_k_of_wide_vectors_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(260):
        high = [1.0, 2.0**12, 2.0**20, 2.0**40, 2.0**52][i % 5] if i < 200 else 0.01
        rows.append((i, [float(x) for x in r.normal(0, high, int(r.integers(1, 9)))]))
    for i in range(260, 290):  # apart by less than a double holds
        rows.append((i, [2.0**27 + i, 2.0**27 - i, 1.0, float(i % 3)]))
    rows += [(i, [1e308, 1e-300]) for i in range(300, 303)] + [(350, [-1e308, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(frame, frame.where("vec_id % 50 = 0 or vec_id > 255"), 5).collect()}
    whole = {i: [math.floor(Fraction(v) * 256) for v in x] for i, x in rows}
    most = 2**63 - 1
    for i in [i for i, _ in rows if i % 50 == 0 or i > 255]:
        best = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(whole[i], whole[j])))), j) for j, _ in rows if j != i)
        if abs(best[4][0]) < most:
            assert [got[i, n + 1] for n in range(5)] == [(j, -s) for s, j in best[:5]], i


def test_bounds_are_carried_and_hold_back_candidates():
    r = np.random.default_rng(9)
    q, ids = r.integers(-200, 200, (40, 16)), np.arange(3000)
    rows = np.floor(r.normal(0, 60, (3000, 16))).astype(np.int64)
    bar = np.full(40, -np.inf)
    found = [topk.search(q, np.arange(9000, 9040), rows[a : a + 500], ids[a : a + 500], 5, bar) for a in range(0, 3000, 500)]
    assert len(found[-1][0]) < len(found[0][0])
    i, j, s = (np.concatenate([f[n] for f in found]) for n in range(3))
    for k in range(40):
        best = sorted(zip((-s[i == k]).tolist(), j[i == k].tolist()))[:5]
        assert best == sorted(zip((-(rows @ q[k])).tolist(), ids.tolist()))[:5]


def test_lm_scores_prefer_the_target(spark):
    r, good, bad = random.Random(5), vocabulary(5), vocabulary(6)
    rows = [(i, text_of(good if i % 2 else bad, 80, r)) for i in range(400)] + [(1000, ""), (1001, None)]
    labels = [(i, i % 2, 0) for i in range(0, 200)]
    got = {x["doc_id"]: x for x in lmscore.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert max(got[i]["score"] for i in range(201, 400, 2)) < min(got[i]["score"] for i in range(200, 400, 2))
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[1]["n_tokens"] == 80


def test_lm_scores_equal_brute_force_beyond_any_table_of_slots(spark, monkeypatch):
    # Hundreds of thousands of distinct words, several batches and ranges.
    monkeypatch.setattr(lmscore, "RANGE_WORDS", 1 << 17)
    monkeypatch.setattr(lmscore, "BATCH_BYTES", 1 << 20)
    r = random.Random(21)
    rows = [(i, " ".join(f"w{r.randrange(10**9)}" if r.random() < 0.8 else f"c{r.randrange(50)}" for _ in range(1000))) for i in range(400)]
    rows += [(None, "c1 c2"), (7000, ""), (7001, "c1"), (7002, "c7 c7 c7 c7"), (399, "c1 c2 c1 c2 c9"), (8000, "the copy of a text"), (8001, "the copy of a text")]
    labels = [(i, 1, 0) for i in range(0, 400, 3)] + [(7002, 1, 0), (7002, 1, 0), (7001, 0, 1)]
    goal = {i for i, q, _ in labels if q}
    got = lmscore.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    single, double = [Counter(), Counter()], [Counter(), Counter()]
    start = [0, 0]
    for i, t in rows:
        w = t.split()
        for m in range(1 + (i in goal)):
            single[m].update(w)
            double[m].update(zip([None, *w], w))
            start[m] += bool(w)
    total, size = [sum(c.values()) for c in single], len(single[0])
    assert size > 250_000 and len(got) == len(rows)

    def loss(m, w, held):
        one, two = Counter(w if held else []), Counter(zip([None, *w], w) if held else [])
        scale = total[1] / total[0] if m == 0 else 1
        out = 0.0
        for a, b in zip([None, *w], w):
            before = start[m] - held if a is None else single[m][a] - one[a]
            alone = ((single[m][b] - one[b]) * scale + 1) / ((total[m] - held * len(w)) * scale + size + 1)
            out -= math.log2(0.6 * (double[m][a, b] - two[a, b]) / max(1, before) + 0.4 * alone)
        return out / len(w)

    text = {i: t for i, t in rows if i != 399}
    for x in got:
        if x["doc_id"] in (0, 1, 57, 200, 7001, 7002, 8000, 8001, None):
            w = text[x["doc_id"]].split()
            assert x["ce_background"] == pytest.approx(loss(0, w, 1), abs=1e-6) and x["n_tokens"] == len(w)
            assert x["ce_target"] == pytest.approx(loss(1, w, int(x["doc_id"] in goal)), abs=1e-6) and x["score"] == x["ce_target"] - x["ce_background"]
    scores = {x["doc_id"]: x for x in got}
    assert scores[7000]["score"] == 0 and scores[8000]["ce_background"] < scores[1]["ce_background"] / 2


def test_language_id_on_held_out_rows(spark):
    r, langs = random.Random(9), {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    rows = []
    for i in range(600):
        lang = r.choice(list(langs))
        rows.append((i, " ".join("".join(r.choice(langs[lang]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 60))), lang))
    rows += [(1000, "жызнь хороша и жить хорошо " * 20, None), (1001, "1234 !!", "aa"), (1002, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    held = [i for i, _, _ in rows[:600] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.98
    assert not any(got[i]["rejected"] for i in range(600)) and got[1000]["rejected"]
    assert got[1001]["lang_pred"] == got[1002]["lang_pred"] == "und" and got[1002]["score"] == 0
    assert {x["doc_id"] for x in langid.keep_identified(docs).collect()} == set(range(600))


KN = {"x": {"abab": 5, "baba": 4, "ab c": 2, "  ab": 3, " abc": 1}, "y": {"cdcd": 3, "dcdc": 3, " cd ": 1}}


def naive_kneser_ney(counts, alphabet, before, c):
    """The interpolated probability of a character by the recursion itself."""
    uniform, levels = 1 / (alphabet + 1), {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(n, before, c):
        if n == 0:
            return uniform
        level, own = levels[n], {g: v for g, v in levels[n].items() if g[:-1] == before}
        n1, n2 = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        low = p(n - 1, before[1:], c)
        if not own:
            return low
        return (max(own.get(before + c, 0) - d, 0) + d * len(own) * low) / sum(own.values())

    return p(4, before, c)


def test_kneser_ney_sums_to_one_and_equals_the_recursion():
    model = langid.kneser_ney(KN)
    for before in ("aba", "  a", "zzz", "dcd", "b c"):
        total = np.zeros(2)
        for c in "abcd q":  # the five that were seen at an end, and one for all others
            cp = np.array([ord(x) for x in before + c], dtype=np.uint32)
            n = model.loss(cp, np.array([0, 4])) - model.loss(cp[:3], np.array([0, 3]))
            total += 2.0 ** -n[0]
            assert 2.0 ** -n[0] == pytest.approx([naive_kneser_ney(KN[k], 5, before, c) for k in "xy"], rel=1e-4)
        assert total == pytest.approx(1, abs=1e-4)


def test_language_of_a_text_does_not_depend_on_its_neighbours():
    model = langid.kneser_ney(KN)
    texts = ["abab", "cdcd baba", "", " ab", "...ab!", "1", None, "d", "ab c" * 500, "zz", "cd"]
    alone = [langid.cross_entropy(model, [t])[0][0].tolist() for t in texts]
    for order in (list(range(len(texts))), list(range(len(texts)))[::-1], [3, 0, 3, 10, 5, 1]):
        assert langid.cross_entropy(model, [texts[i] for i in order])[0].tolist() == [alone[i] for i in order]


def naive_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_recurrence():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 25)).astype(np.uint64), r.integers(0, 6, r.integers(1, 40)).astype(np.uint64)
        assert decon.align(a, b)[0] == naive_alignment(a.tolist(), b.tolist())


def test_edited_passages_are_found_and_others_left(spark):
    r, words = random.Random(12), vocabulary(12, 3000)
    items = [(k, text_of(words, 40, r)) for k in range(20)]
    docs, want = [], set()
    for i in range(200):
        w = text_of(words, 300, r).split(" ")
        if i % 5 == 0:
            k = i // 5 % 20
            p = items[k][1].split(" ")
            for _ in range(6):
                p[r.randrange(len(p))] = r.choice(words)
            del p[r.randrange(len(p))]
            w[150:150] = p
            want.add((i, k))
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decon.contaminated(d, b).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert {x["doc_id"] for x in decon.keep_clean(d, b).collect()} == set(range(200)) - {i for i, _ in want}


def test_short_items_match_word_for_word(spark):
    items = [(1, "five words of one item"), (2, "The  answer"), (3, "one two three four"), (4, "x")]
    docs = [(1, "here are five WORDS of one item indeed"), (2, "five words of another item"), (3, "the\nanswer"), (4, "the answer is x"), (5, "zero one two three four five"), (6, "one two three for"), (7, "x"), (8, "x x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"], x["score"]) for x in decon.contaminated(d, b).collect()} == {(1, 1, 5), (3, 2, 2), (5, 3, 4), (7, 4, 1)}
    assert {x["doc_id"] for x in decon.keep_clean(d, b).collect()} == {2, 4, 6, 8}


def test_contaminated_equals_brute_force(spark):
    r, words = random.Random(41), vocabulary(41, 60)
    items = [(k, text_of(words, r.randint(1, 14), r)) for k in range(25)]
    docs = [(i, text_of(words, r.randint(0, 40), r)) for i in range(150)] + [(200 + k, items[k][1]) for k in range(10)]
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decon.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for k, item in items:
            a, b = item.split(), t.split()
            n = min(len(a), 4)
            seeded = any(a[x : x + n] == b[y : y + n] for x in range(len(a) - n + 1) for y in range(len(b) - n + 1)) and (len(a) > 3 or a == b)
            score = naive_alignment(a, b)
            if seeded and score >= (len(a) if len(a) < 8 else math.ceil(0.4 * len(a))):
                want[i, k] = score
    assert got.keys() <= want.keys()
    assert all(s <= want[k] for k, s in got.items()) and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("copies", [5, 50, 1000])
def test_an_edited_passage_is_found_however_often_it_occurs(spark, copies):
    r, words = random.Random(13), vocabulary(13, 3000)
    item = text_of(words, 40, r)
    p = item.split(" ")
    for i in (0, 4, 8, 12, 16, 20, 24, 35):
        p[i] = f"other{i}"
    assert naive_alignment(item.split(" "), p) >= 0.4 * 40
    docs = [(i, " ".join([text_of(words, 30, r), *(p if i < copies else []), text_of(words, 30, r)])) for i in range(copies + 20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {x["doc_id"] for x in decon.contaminated(d, b).collect()} == set(range(copies))
    assert {x["doc_id"] for x in decon.keep_clean(d, b).collect()} == set(range(copies, copies + 20))


def test_every_operator_is_registered():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
