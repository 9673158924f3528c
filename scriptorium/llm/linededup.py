"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count, then by its `LEADING` first tokens: by a token that at least
`min_docs` documents have at that place in lines of that count, else by the node's wildcard; tokens with a
digit are variable fields from the start. In a leaf each further position is generalised from what stands there:
a token is constant where at least `min_docs` of the leaf's documents have it there (so that rare values become
a field), or, read more strictly, where at least half of the leaf's documents do (so that common values become
one, too). Each reading gives a template of constants and fields. A template with fields but for digits must
have constants at three positions and at `AGREE` of all. A line of `LONG_TOKENS` tokens and more is a passage:
its templates are the whole line, and the line with one of `BLOCKS` blocks behind the leading tokens as a field.

A template that `min_docs` documents have recurs, or `long_docs` for a passage, and every line that has a
recurring template is dropped, from all documents.

Counts are exact, by hashes of 64 bits: batches of documents give the keys of a round (leading tokens,
tokens of a leaf, templates) by ranges of the hash and get back how many documents have each. Texts are
shuffled once, to meet their dropped lines by a hash of the text, not by id: rows that share an id, or have
none, lose their own lines alone. Each row counts as a document. Null, empty and blank texts have no lines to
drop; blank lines are never dropped. Texts of any length are read whole. Extra columns pass through; those
named `n_lines` or `dropped` are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import GIVEN, U, by_frequency, gives, importable, mix, pack, slices, stage, summed, unpack, word_hashes

LEADING = 3
LONG_TOKENS, BLOCKS = 50, 4
MIN_DOCS, LONG_DOCS = 8, 2
#: Constants a template with fields must have: so many, and this share of its positions.
AGREE_TOKENS, AGREE = 3, 0.6
#: Bytes of text in a batch of documents, and tokens for each range of hashes.
BATCH_BYTES, RANGE_TOKENS = 16 << 20, 4 << 20
BATCH = "batch long, n_tokens long, texts binary, owner binary, number binary, size binary, vocabulary binary, words binary, long_keys binary"
_FIELD = U(0x2A5F3C1E9B7D8642)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def tokens(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all lines, digit tokens alike, and the number of tokens of each line."""
    h, offs, starts = word_hashes(lines)
    if len(h):
        raw = np.frombuffer(b" ".join(lines) + b" ", dtype=np.uint8)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
        h = np.where(digits[np.append(starts[1:], len(raw))] > digits[starts], _FIELD, h)
    return h, np.diff(offs)


def _places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and position of each token."""
    line = np.repeat(np.arange(len(size)), size)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)


def passage_keys(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(lines, 1 + BLOCKS) template keys of long lines."""
    line, pos = _places(size)
    at = mix(pos.astype(U) + U(0x632BE59BD9B4E019))
    placed, free = mix(h + at), mix(_FIELD + at)
    total = np.zeros(len(size), dtype=U)
    np.add.at(total, line, placed)
    block = np.where(pos >= LEADING, (pos - LEADING) * BLOCKS // np.repeat(np.maximum(size - LEADING, 1), size), -1)
    path = mix(size.astype(U) * U(0x9E3779B97F4A7C15))
    out = np.empty((len(size), 1 + BLOCKS), dtype=U)
    out[:, 0] = mix(total + path)
    for k in range(BLOCKS):
        own = block == k
        change = np.zeros(len(size), dtype=U)
        np.add.at(change, line[own], free[own] - placed[own])
        out[:, k + 1] = mix(total + change + path + U(k + 1))
    return out


def batches(docs: DataFrame) -> DataFrame:
    """The lines of all of `docs(__a, __b, text)` in batches, in the shared folder; __a and __b are the text's hash."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size, first_doc = TaskContext.get().partitionId() << 32, [], 0, 0

        def whole() -> pd.DataFrame:
            texts, owner, no, count, h = (np.concatenate(x) for x in zip(*held, strict=True))
            wide = count >= LONG_TOKENS
            at = np.repeat(wide, count)
            words, place = by_frequency(h[~at])
            cols = (texts, owner, no, count, words, place, passage_keys(h[at], count[wide]).ravel())
            return pd.DataFrame([(number, len(h), *map(pack, cols))], columns=[c.split()[0] for c in BATCH.split(", ")])

        for f in frames:
            marks = np.stack((f["__a"].to_numpy(dtype=np.int64), f["__b"].to_numpy(dtype=np.int64)), axis=1).view(U)
            for first, run in slices(f["text"].tolist()):
                lines, count = [], []
                for b in run:
                    parts = b.split(b"\n")
                    lines.extend(parts)
                    count.append(len(parts))
                h, n = tokens(lines)
                owner, no = _places(np.array(count))
                some = n > 0
                held.append((marks[first : first + len(run)].ravel(), first_doc + owner[some], no[some], n[some], h))
                first_doc += len(run)
                size += sum(len(b) + 32 for b in run)
                if size >= BATCH_BYTES:
                    yield whole()
                    number, held, size, first_doc = number + 1, [], 0, 0
        if held:
            yield whole()

    return stage(docs.select("__a", "__b", "text").mapInPandas(of, BATCH), "line-batches")


class Lines:
    """A batch's lines through the rounds: the keys to be counted, and what follows from their counts."""

    def __init__(self, own: pd.Series, min_docs: int, long_docs: int):
        self.min_docs, self.long_docs = min_docs, long_docs
        self.texts = unpack(own["texts"]).view(np.int64).reshape(-1, 2)
        self.owner, self.number, self.size = (unpack(own[c]).astype(np.int64) for c in ("owner", "number", "size"))
        self.short, self.long = np.flatnonzero(self.size < LONG_TOKENS), np.flatnonzero(self.size >= LONG_TOKENS)
        self.passages = unpack(own["long_keys"]).reshape(-1, 1 + BLOCKS)
        self.count = self.size[self.short]
        self.token = unpack(own["vocabulary"])[unpack(own["words"]).astype(np.int64)]
        self.line, self.pos = _places(self.count)
        self.head, self.digit = self.pos < LEADING, self.token == _FIELD

    def _leading(self) -> np.ndarray:
        """The tokens that may lead: their places."""
        at = np.flatnonzero(self.head & ~self.digit)
        self.key = np.zeros(len(self.token), dtype=U)
        self.key[at] = mix(self.token[at] + mix((self.count[self.line[at]] * 64 + self.pos[at]).astype(U) + U(0xA24BAED4963EE407)))
        return at

    def asked(self, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, lines) of the round after these answers; each key is to be counted in its line's document."""
        lead = self._leading()
        if not answers:
            return self.key[lead], self.short[self.line[lead]]
        self.constant = np.zeros(len(self.token), dtype=bool)
        self.constant[lead] = answers[0] >= self.min_docs
        leaf = mix(self.count.astype(U) + U(0x9FB21C651E98DF25))
        head = np.flatnonzero(self.head)
        np.add.at(leaf, self.line[head], np.where(self.constant[head], mix(self.key[head]), mix(self.pos[head].astype(U) + U(0x3C79AC492BA7B653))))
        leaf = mix(leaf)
        rest = np.flatnonzero(~self.head & ~self.digit)
        self.key[rest] = mix(self.token[rest] + mix(leaf[self.line[rest]] + self.pos[rest].astype(U)))
        if len(answers) == 1:
            return np.concatenate((self.key[rest], mix(leaf + U(0x1C69B3F74AC4AE35)))), self.short[np.concatenate((self.line[rest], np.arange(len(leaf))))]
        docs, whole = answers[1][: len(rest)], answers[1][len(rest) :]
        keys, lines = [self.passages.ravel()], [np.repeat(self.long, 1 + BLOCKS)]
        for common in (docs >= self.min_docs, (docs >= self.min_docs) & (2 * docs >= whole[self.line[rest]])):
            constant = self.constant.copy()
            constant[rest] = common
            mask, total = np.zeros(len(leaf), dtype=U), np.zeros(len(leaf), dtype=U)
            np.add.at(mask, self.line[constant], U(1) << self.pos[constant].astype(U))
            np.add.at(total, self.line[constant], self.key[constant])
            fixed = np.bincount(self.line[constant], minlength=len(leaf))
            digits = np.bincount(self.line[self.digit], minlength=len(leaf))
            fit = (fixed + digits == self.count) | ((fixed >= AGREE_TOKENS) & (fixed >= AGREE * self.count))
            keys.append(mix(total + mix(mask + leaf))[fit])
            lines.append(self.short[fit])
        return np.concatenate(keys), np.concatenate(lines)

    def dropped(self, answers: list[np.ndarray]) -> pd.DataFrame:
        """(__a, __b, dropped): the texts that lose lines, and the numbers of these."""
        _, lines = self.asked(answers[:2])
        gone = np.zeros(len(self.size), dtype=bool)
        gone[lines[answers[2] >= np.where(self.size[lines] >= LONG_TOKENS, self.long_docs, self.min_docs)]] = True
        at = np.flatnonzero(gone)
        docs, first = np.unique(self.owner[at], return_index=True)
        parts = np.split(self.number[at].astype(np.int32), first[1:]) if len(docs) else []
        return pd.DataFrame({"__a": self.texts[docs, 0], "__b": self.texts[docs, 1], "dropped": pd.Series(parts, dtype=object)})


def _round(held: DataFrame, answers: list[DataFrame], of: Callable[[int, Lines, list[np.ndarray]], pd.DataFrame], schema: str, limits: tuple[int, int]) -> DataFrame:
    """Each batch with the answers of the rounds before: the counts in the order in which the batch asked for them."""
    rounds, rows = len(answers), held.drop("n_tokens").withColumn("round", F.lit(-1))
    for k, a in enumerate(answers):
        rows = rows.unionByName(a.withColumn("round", F.lit(k)), allowMissingColumns=True)

    def each(f: pd.DataFrame) -> pd.DataFrame:
        own = f[f["round"] == -1].iloc[0]
        lines, got = Lines(own, *limits), []
        for k in range(rounds):
            counts = np.concatenate([unpack(b) for b in f[f["round"] == k].sort_values("range")["n"]] or [np.zeros(0, dtype=U)]).astype(np.int64)
            got.append(counts[np.unique(lines.asked(got)[0], return_inverse=True)[1]])
        return of(int(own["batch"]), lines, got)

    if not answers:
        return rows.mapInPandas(lambda frames: (of(int(r["batch"]), Lines(r, *limits), []) for f in frames for _, r in f.iterrows()), schema)
    return rows.groupBy("batch").applyInPandas(each, schema)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(__a, __b, dropped): by hash of the text, the line numbers (from 0) whose template recurs in `docs(__a, __b, text)`."""
    importable(docs.sparkSession)
    held = batches(docs)
    parts = int(held.agg(F.sum("n_tokens")).first()[0] or 0) // RANGE_TOKENS + 1

    def asks(batch: int, lines: Lines, got: list[np.ndarray]) -> pd.DataFrame:
        keys, line = lines.asked(got)
        whole, at = np.unique(keys, return_inverse=True)
        # A document counts once for a key.
        docs_of = np.unique(at * (len(lines.texts) + 1) + lines.owner[line]) // (len(lines.texts) + 1)
        return gives(batch, whole, np.bincount(docs_of, minlength=len(whole)), parts)

    answers: list[DataFrame] = []
    for k in range(3):
        answers.append(summed(_round(held, answers, asks, GIVEN, (min_docs, long_docs)), f"line-counts-{k}"))
    last = _round(held, answers, lambda batch, lines, got: lines.dropped(got), "__a long, __b long, dropped array<int>", (min_docs, long_docs))
    return last.groupBy("__a", "__b").agg(F.first("dropped").alias("dropped"))


def _marks() -> dict[str, Column]:
    text = F.col("text").cast("string")
    return {"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)}


def _without(text: Column, dropped: Column) -> Column:
    """The text without the lines of these numbers."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, d in zip(texts, numbers, strict=True):
            gone = set() if d is None else set(d.tolist())
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t)
        return pd.Series(out, dtype=object)

    return of(text, dropped)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """All rows and columns of `docs(doc_id, text)`; text without its recurring lines, n_lines and dropped (line numbers) besides."""
    gone = recurring_lines(docs.select(F.col("text").cast("string").alias("text")).withColumns(_marks()), min_docs, long_docs)
    gone = stage(gone.withColumnsRenamed({"__a": "__x", "__b": "__y", "dropped": "__gone"}), "line-drops")
    marked = docs.withColumns(_marks())
    # Merged at every size, so that costs do not jump where the table of drops stops being small.
    both = marked.join(gone.hint("merge"), (marked["__a"] == gone["__x"]) & (marked["__b"] == gone["__y"]), "left")
    text = F.col("text").cast("string")
    return both.select(
        *[docs[c] for c in docs.columns if c not in ("text", "n_lines", "dropped")],
        F.when(F.col("__gone").isNull(), text).otherwise(_without(F.when(F.col("__gone").isNotNull(), text), F.col("__gone"))).alias("text"),
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).alias("n_lines"),
        F.coalesce("__gone", F.array().cast("array<int>")).alias("dropped"),
    )
