"""LM scoring by cross-entropy difference.

Two matched bigram models, one of the target texts and one of the background (all documents), share one
vocabulary, all words of the corpus, and one smoothing; the background's counts are scaled to the target's
size, so that both smooth alike. Words and pairs of words are counted exactly, by hashes of 63 bits, so what
is gathered grows with the corpus. A word's loss under a model is -log2 of the bigram estimate interpolated
with the smoothed unigram; a text's score is the mean over its words of target loss less background loss
(lower: closer to the target). A text is scored by the counts of all others: its own are taken out of each
model that holds it.

The documents are cut into batches, which hold their words by number; texts are not shuffled. Which documents
are targets is joined by id alone. Each batch gives and asks the counts of its distinct words and pairs, dealt
by ranges of the hash; a range adds up what the batches gave and answers each of them in the order of its
hashes; a batch and its answers meet again for the scores. The batches lie in buckets, so that only counts and
places of targets are shuffled. No task holds more than a batch or a range. The
rows between them number batches times ranges: at a hundred times the size, give both ten times the bytes.

Target texts are the documents that labels mark as good. Null, empty and blank texts have no words and a
score of 0. Null ids belong to the background only. Rows that repeat an id are texts of their own, and all of
them are targets where the id is one; an id that labels repeat is one target. Extra columns are ignored.
Without targets the target model is uniform. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, by_frequency, importable, mix, pack, slices, spans, stage, stage_by, unpack, word_hashes

#: Bytes of text in a batch of documents (each counts some more), and words for each range of hashes.
BATCH_BYTES, DOC_BYTES, RANGE_WORDS = 8 << 20, 32, 2 << 20
PAIR_SHARE = 0.6
BATCH = "batch long, n_words long, ids array<long>, sizes binary, vocabulary binary, words binary"
KEYS = "batch long, range int, keys binary, n binary, t binary"
ANSWER = "batch long, range int, n binary, t binary, words long, n_words long, t_words long"


def batches(docs: DataFrame) -> DataFrame:
    """The batches of all of `docs(doc_id, text)`, in the shared folder: ids, words of each text, and words as numbers in the batch's vocabulary."""
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def whole() -> pd.DataFrame:
            ids, word, n = zip(*held, strict=True)
            vocabulary, at = by_frequency(np.concatenate(word))
            row = {"batch": number, "n_words": len(at), "ids": [i for x in ids for i in x], "sizes": pack(np.concatenate(n)), "vocabulary": pack(vocabulary), "words": pack(at)}
            return pd.DataFrame([row])

        for f in frames:
            ids = [None if pd.isna(i) else int(i) for i in f["doc_id"]]
            for first, run in slices(f["text"].tolist()):
                word, offs, _ = word_hashes(run)
                held.append((ids[first : first + len(run)], word & ~U(1), np.diff(offs)))
                size += sum(len(b) + DOC_BYTES for b in run)
                if size >= BATCH_BYTES:
                    yield whole()
                    number, held, size = number + 1, [], 0
        if held:
            yield whole()

    return stage_by(rows.mapInPandas(of, BATCH), "batch", "lm-batches")


def targets(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(batch, goal): the places of each batch's target texts."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    places = held.select("batch", F.posexplode("ids").alias("place", "id")).join(good.hint("merge"), "id")
    return stage(places.groupBy("batch").agg(F.sort_array(F.collect_list("place")).alias("goal")), "lm-targets")


class Words:
    """A batch's words and pairs: the distinct keys in order, and the key of each text's words, pairs and contexts."""

    def __init__(self, sizes: bytes, vocabulary: bytes, words: bytes, goal: object):
        self.size = unpack(sizes).astype(np.int64)
        word = unpack(vocabulary)[unpack(words).astype(np.int64)]
        begins = (np.cumsum(self.size) - self.size)[self.size > 0]
        before = np.zeros(len(word), dtype=U)
        before[1:] = word[:-1]
        before[begins] = U(0)  # the start of a text, a word of its own
        # The lowest bit tells words from pairs.
        pair = mix(word + mix(before + U(0x9E3779B97F4A7C15))) | U(1)
        self.keys, at = np.unique(np.concatenate((word, pair, np.zeros(len(begins), dtype=U))), return_inverse=True)
        n = len(word)
        self.word, self.pair, starts = at[:n], at[n : 2 * n], at[2 * n :]
        self.context = np.roll(self.word, 1)
        self.context[begins] = starts
        self.goal = np.zeros(len(self.size), dtype=bool)
        if isinstance(goal, (list, np.ndarray)):
            self.goal[np.asarray(goal, dtype=np.int64)] = True
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.start_text = np.flatnonzero(self.size > 0)
        self._starts = starts

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs in the batch, and in its target texts."""
        every = np.concatenate((self.word, self.pair, self._starts))
        owner = np.concatenate((self.text, self.text, self.start_text))
        return np.bincount(every, minlength=len(self.keys)), np.bincount(every[self.goal[owner]], minlength=len(self.keys))

    def own(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """For each key `at`, how often it stands among the keys `of` in its own text."""
        span = len(self.keys)
        keys, n = np.unique(self.text * span + of, return_counts=True)
        asked = self.text * span + at
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[place] == asked, n[place], 0)


def given(held: DataFrame, goals: DataFrame, parts: int) -> DataFrame:
    """(batch, range, keys, n, t): each batch's keys and their counts by range."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                w = Words(r.sizes, r.vocabulary, r.words, r.goal)
                n, t = w.counts()
                rows = [(r.batch, k, pack(np.diff(w.keys[x:y], prepend=U(0))), pack(n[x:y]), pack(t[x:y])) for k, x, y in spans(w.keys, parts)]
                yield pd.DataFrame(rows, columns=["batch", "range", "keys", "n", "t"])

    rows = held.drop("ids", "n_words").join(goals.hint("merge"), "batch", "left")
    return rows.mapInPandas(of, KEYS)


def answered(asked: DataFrame) -> DataFrame:
    """Each batch's keys' counts over the whole corpus, in the order of the keys; as batch -1, each range's number of words, and of their occurrences."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(b), dtype=U) for b in f["keys"]]
        whole, at = np.unique(np.concatenate(keys), return_inverse=True)
        n, t = (np.bincount(at, weights=np.concatenate([unpack(b) for b in f[c]]).astype(np.float64)).astype(np.int64) for c in ("n", "t"))
        words = (whole & U(1) == 0) & (whole > 0)
        r, ends = int(f["range"].iloc[0]), np.cumsum([len(k) for k in keys])
        rows = [(int(b), r, pack(n[at[e - len(k) : e]]), pack(t[at[e - len(k) : e]]), 0, 0, 0) for b, k, e in zip(f["batch"], keys, ends, strict=True)]
        rows.append((-1, r, None, None, int(words.sum()), int(n[words].sum()), int(t[words].sum())))
        return pd.DataFrame(rows, columns=["batch", "range", "n", "t", "words", "n_words", "t_words"])

    return stage(asked.groupBy("range").applyInPandas(of, ANSWER), "lm-counts")


def losses(w: Words, count: np.ndarray, total: int, vocabulary: int, held: np.ndarray, scale: float) -> np.ndarray:
    """Each text's mean loss by a model of these counts, less the texts' own where the model holds them (`held`)."""
    text = w.text
    mine = held[text].astype(np.float64)
    single = (count[w.word] - mine * w.own(w.word, w.word)) * scale + 1
    single /= (total - mine * w.size[text]) * scale + vocabulary + 1
    starts = w.context != np.roll(w.word, 1)
    context = count[w.context] - mine * np.where(starts, 1, w.own(w.context, w.word))
    pair = count[w.pair] - mine * w.own(w.pair, w.pair)
    loss = -np.log2(PAIR_SHARE * pair / np.maximum(context, 1) + (1 - PAIR_SHARE) * single)
    return np.bincount(text, weights=loss, minlength=len(w.size)) / np.maximum(w.size, 1)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, score for every row of `docs(doc_id, text)`."""
    held = batches(docs)
    goals = targets(held, labels)
    parts = int(held.agg(F.sum("n_words")).first()[0] or 0) // RANGE_WORDS + 1
    answers = answered(given(held, goals, parts))
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n_words", "t_words")]).first()
    vocabulary, totals = sums["words"], (sums["n_words"], sums["t_words"])
    scale = totals[1] / totals[0] if totals[1] else 1.0

    def of(held_rows: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        own = held_rows.iloc[0]
        goals_of = f.loc[f["range"] == -2, "goal"].tolist()
        rest = f[f["range"] >= 0].sort_values("range")
        w = Words(own["sizes"], own["vocabulary"], own["words"], goals_of[0] if goals_of else None)
        n, t = (np.concatenate([unpack(b) for b in rest[c]] or [np.zeros(0, dtype=U)]).astype(np.float64) for c in ("n", "t"))
        if len(w.word):
            base, goal = losses(w, n, totals[0], vocabulary, np.ones(len(w.size), dtype=bool), scale), losses(w, t, totals[1], vocabulary, w.goal, 1.0)
        else:
            base = goal = np.zeros(len(w.size))
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in own["ids"]], dtype="Int64"), "n_tokens": w.size, "ce_target": goal, "ce_background": base})

    told = answers.where("batch >= 0").select("batch", "range", "n", "t").unionByName(goals.withColumn("range", F.lit(-2)), allowMissingColumns=True)
    rows = held.drop("n_words").groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(of, "doc_id long, n_tokens long, ce_target double, ce_background double")
    rows = rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", "ce_target", "ce_background")
    return rows.withColumn("score", F.col("ce_target") - F.col("ce_background"))
