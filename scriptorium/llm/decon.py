"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set, taken in blocks of bounded size; each block is held against all
passages. Every word n-gram of an item is a seed, however many documents hold it: copies of one passage
make its n-grams frequent, so that frequency can't tell a copy from a common phrase. The seeds are found in
every document, and the item is aligned with the passage around them, word by word (match 1, mismatch and
gap -1); a bound by common words leaves out passages that can't reach the threshold.
A document is contaminated by an item where the best local score reaches `threshold` of the item's words.
A passage that shares no `SEED_WORDS` words in a row with the item has no seed and is not found.

An item of fewer than `MIN_WORDS` words must stand in the document word for word; one of fewer than
`SEED_WORDS` words, which any text may hold by chance, must be all of the document's words. Null, empty and
blank texts and items match nothing; null ids are kept as they are. Documents are read whole, in slices of
bounded memory. Rows of one document id are reported once per item, with the best score; `keep_clean` keeps
extra columns. Without benchmark rows nothing is contaminated; an empty table of documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, importable, shingles, slices, word_hashes

SEED_WORDS = 4
MIN_WORDS = 8
THRESHOLD = 0.4
BLOCK_BYTES = 8 << 20
#: Meetings of seeds and items that are looked at in one go, but for those of a single document.
MEETINGS = 1 << 20


class Items:
    """A block of test items: word hashes, and where each seed stands in them."""

    def __init__(self, ids: list[int], texts: list, threshold: float = THRESHOLD):
        self.ids, self.words = [], []
        for first, run in slices(texts):
            h, offs, _ = word_hashes(run)
            for d in range(len(run)):
                if offs[d + 1] > offs[d]:
                    self.ids.append(ids[first + d])
                    self.words.append(h[offs[d] : offs[d + 1]])
        parts = [shingles(w, np.array([0, len(w)]), SEED_WORDS)[0] for w in self.words]
        self.gram = np.concatenate(parts) if parts else np.zeros(0, dtype=U)
        self.item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        # The score that an item asks for; a short one stands in a document word for word.
        self.need = np.where(self.size < MIN_WORDS, self.size, np.ceil(threshold * self.size).astype(np.int64))
        at = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[at], self.item[at], self.place[at]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The best Smith-Waterman score of two word sequences and its end in `b` (linear gaps; one vector step for each word of `a`)."""
    ramp = np.arange(len(b) + 1, dtype=np.int32)
    row = np.zeros(len(b) + 1, dtype=np.int32)
    best, end = 0, 0
    for w in a:
        step = np.maximum(row - 1, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(b == w, 1, -1))
        row = np.maximum.accumulate(step + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def passages(items: Items, h: np.ndarray, offs: np.ndarray, at: np.ndarray, hits: np.ndarray, low: np.ndarray, count: np.ndarray, known: dict[tuple[int, bytes], int]) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, score) where `hits`, places of seeds, each of `count` items from `low` on, lead to a passage that reaches the threshold."""
    seed = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    where = np.repeat(hits, count)
    doc = np.searchsorted(at, where, side="right") - 1
    begin = where - at[doc] - items.place[seed]
    item = items.item[seed]
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    size = items.size[item]
    # Seeds of one item whose diagonals lie within half its length belong to one passage.
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:] // 2)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(doc)) - 1
    best: dict[tuple[int, int], int] = {}
    for s, e in zip(starts, ends, strict=True):
        d, k = int(doc[s]), int(item[s])
        n = len(items.words[k])
        need = int(items.need[k])
        if best.get((d, k), 0) >= n:
            continue
        left = max(offs[d], offs[d] + begin[s] - n // 2)
        right = min(offs[d + 1], offs[d] + begin[e] + n + n // 2)
        part = h[left:right]
        if len(part) < need:
            continue
        # A score needs as many words in common; a cheap bound before the alignment.
        if int(np.isin(items.words[k], part).sum()) < need:
            continue
        mark = (k, part.tobytes())
        if mark not in known:
            if len(known) > 20_000:
                known.clear()
            known[mark] = align(items.words[k], part)[0]
        best[d, k] = max(best.get((d, k), 0), known[mark])
    for (d, k), score in best.items():
        if score >= items.need[k]:
            yield d, k, score


def matches(items: Items, texts: list) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, score) for each contaminated text."""
    if not len(items.gram):
        return
    known: dict[tuple[int, bytes], int] = {}
    for first, run in slices(texts):
        h, offs, _ = word_hashes(run)
        g, at = shingles(h, offs, SEED_WORDS)
        lo = np.searchsorted(items.gram, g)
        lo[lo == len(items.gram)] = 0
        hits = np.flatnonzero(items.gram[lo] == g)
        if not len(hits):
            continue
        count = np.searchsorted(items.gram, g[hits], side="right") - lo[hits]
        begun = np.flatnonzero(np.diff(np.searchsorted(at, hits, side="right"), prepend=-1))
        cuts = begun[np.flatnonzero(np.diff((np.cumsum(count) - count)[begun] // MEETINGS, prepend=-1))]
        for x, y in zip(cuts, np.append(cuts[1:], len(hits)), strict=True):
            for d, k, score in passages(items, h, offs, at, hits[x:y], lo[hits[x:y]], count[x:y], known):
                yield first + d, k, score


def blocks(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Items]:
    """The items in blocks of some BLOCK_BYTES; a block is dealt by hash of the item's id."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = int(size // BLOCK_BYTES) + 1
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in part], [r["text"] for r in part], threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, similarity (score by item length) of each contaminated document and item."""
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks(benchmark, threshold):
        def of(frames: Iterator[pd.DataFrame], items: Items = items) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = list(matches(items, f["text"].tolist()))
                if got:
                    ids = f["doc_id"].astype("Int64")
                    yield pd.DataFrame({"doc_id": ids.iloc[[d for d, _, _ in got]].to_numpy(), "item_id": [items.ids[k] for _, k, _ in got], "score": [s for _, _, s in got], "similarity": [s / int(items.size[k]) for _, k, s in got]})

        part = rows.mapInPandas(of, "doc_id long, item_id long, score long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("similarity").alias("similarity"))


def leaking(items: Items):
    """A function of a text column: whether an item of the block contaminates the text."""

    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=bool)
        for d, _, _ in matches(items, texts.tolist()):
            out[d] = True
        return pd.Series(out)

    return leaks


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that no test item contaminates; columns as they come."""
    importable(docs.sparkSession)
    for items in blocks(benchmark, threshold):
        docs = docs.where(~leaking(items)(F.col("text").cast("string")))
    return docs
