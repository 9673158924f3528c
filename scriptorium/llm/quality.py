"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned embeddings; learned filters of 16 bytes run over the whole text in steps of 8; their
responses are max-pooled over overlapping chunks of 512 bytes (steps of 256) that cover every byte; each
chunk gives one logit, and the mean over a text's chunks, through a logistic function, is its probability
of good quality. Training (Adam, back-propagation through the chunk maxima) runs on the driver over a
bounded sample of labelled rows: about `sample_rows` of each label by hash of the id, whole texts, none of
more than `sample_bytes`. Every text is scored whole, in slices of bounded memory.

For scoring the trained weights are rounded to whole numbers of 8 bits, so that all sums of a window and of a
chunk are exact and a text's score is a function of its bytes alone, to the bit, whatever stands beside it.

Null and empty texts are one chunk of zero bytes. Rows that repeat are scored each, equal texts alike. Null ids are held in neither fold and never learnt from.
Labels that repeat for an id count each; null labels are left out. Without labels of both kinds every
score is 0.5. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import importable

EMBED, WIDTH, STRIDE, FILTERS, BLOCK = 8, 16, 8, 32, 256
PER_BLOCK = BLOCK // STRIDE
SLICE = 1 << 19


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, the number of blocks of each, and the windows that belong to a text.

    Each text is filled with zeros to whole blocks and then by what its last window needs beyond them, so that no
    window reaches into another text; the windows that start in this rest belong to none."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    rest = WIDTH - STRIDE
    out = b"".join(t + b"\0" * (n * BLOCK + rest - len(t)) for t, n in zip(texts, blocks, strict=True))
    per = blocks * PER_BLOCK
    own = np.arange(per.sum()) + np.repeat(np.arange(len(texts)) * (rest // STRIDE), per)
    return np.frombuffer(out, dtype=np.uint8), blocks, own


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)
        self.trained = False

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def windows(self, raw: np.ndarray) -> np.ndarray:
        e = self.embed[raw]
        n = (len(raw) - (WIDTH - STRIDE)) // STRIDE
        return np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))

    def pooled(self, raw: np.ndarray, blocks: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per block: the largest response of each filter, and the window it came from; the text of each block."""
        resp = (self.windows(raw) @ self.filters)[own].reshape(-1, PER_BLOCK, FILTERS)
        at = resp.argmax(axis=1)
        top = np.take_along_axis(resp, at[:, None, :], axis=1)[:, 0, :] + self.bias
        at = own[at + (np.arange(len(top)) * PER_BLOCK)[:, None]]
        return top, at, np.repeat(np.arange(len(blocks)), blocks)

    def chunks(self, top: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A chunk is two neighbouring blocks of a text; a text of one block is one chunk."""
        pair = np.flatnonzero(text[1:] == text[:-1])
        lone = np.flatnonzero(np.bincount(text)[text] == 1)
        first = np.concatenate((pair, lone))
        second = np.concatenate((pair + 1, lone))
        swap = top[second] > top[first]
        return np.where(swap, top[second], top[first]), np.where(swap, at[second], at[first]), text[first]

    def freeze(self) -> None:
        """Round the weights to whole numbers: products and sums of a window stay below 2^24, those of a chunk below 2^53."""
        unit = np.abs(self.embed).max() / 127
        cuts = np.abs(self.filters).max(axis=0) / 127
        last = self.out * cuts * unit
        scale = max(float(np.abs(last).max()), 1e-30) / (1 << 14)
        frozen = Network()
        frozen.embed, frozen.filters = np.rint(self.embed / unit).astype(np.float32), np.rint(self.filters / cuts).astype(np.float32)
        frozen.bias = np.rint(np.clip(self.bias / (cuts * unit), -(2.0**22), 2.0**22)).astype(np.float32)
        frozen.out, frozen.shift = np.rint(last / scale).astype(np.float64), np.rint(self.shift / scale).astype(np.float64)
        self.frozen, self.scale, self.trained = frozen, scale, True

    def logits(self, texts: list[bytes]) -> np.ndarray:
        raw, blocks, own = padded(texts)
        net = self.frozen
        top, _, text = net.chunks(*net.pooled(raw, blocks, own))
        chunk = np.maximum(top, 0).astype(np.float64) @ net.out + net.shift[0]
        n = np.bincount(text, minlength=len(texts))
        return np.bincount(text, weights=chunk, minlength=len(texts)) * self.scale / n

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        raw, blocks, own = padded(texts)
        top, at, text = self.chunks(*self.pooled(raw, blocks, own))
        act = np.maximum(top, 0)
        n = np.bincount(text, minlength=len(texts))
        z = np.bincount(text, weights=act @ self.out + self.shift[0], minlength=len(texts)) / n
        d_z = weight * (1 / (1 + np.exp(-z)) - y) / len(texts)
        d_chunk = (d_z / n)[text].astype(np.float32)
        g_out, g_shift = act.T @ d_chunk, np.array([d_chunk.sum()], dtype=np.float32)
        d_top = (d_chunk[:, None] * self.out) * (top > 0)
        g_bias = d_top.sum(axis=0)
        x = self.windows(raw)
        g_filters, g_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for f in range(FILTERS):
            own = np.flatnonzero(d_top[:, f])
            w, d = at[own, f], d_top[own, f]
            g_filters[:, f] = d @ x[w]
            spread = (d[:, None] * self.filters[:, f]).reshape(-1, EMBED)
            byte = raw[(w[:, None] * STRIDE + np.arange(WIDTH)).ravel()]
            for k in range(EMBED):
                g_embed[:, k] += np.bincount(byte, weights=spread[:, k], minlength=256)
        return [g_embed, g_filters, g_bias, g_out, g_shift]

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> None:
        r = np.random.default_rng(11)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        m, v = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        step = 0
        for epoch in range(epochs):
            for part in np.array_split(r.permutation(len(texts)), max(1, len(texts) // batch)):
                step += 1
                now = rate * (1 - epoch / epochs)
                for p, g, a, b in zip(self.params(), self.gradients([texts[i] for i in part], y[part], weight[part]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.freeze()

    def scores(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not self.trained:
            return out
        run: list[bytes] = []
        first = size = 0
        for i, t in enumerate([*texts, None]):
            b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
            if run and (size + len(b) > SLICE or i == len(texts)):
                out[first : first + len(run)] = 1 / (1 + np.exp(-np.clip(self.logits(run), -40, 40)))
                run, size, first = [], 0, i
            run.append(b)
            size += len(b)
        return out


def sample(docs: DataFrame, labels: DataFrame, rows: int, text_bytes: int) -> list[tuple[str, int]]:
    """Whole texts of up to `text_bytes` and their labels, some `rows` of each label by hash of the id."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30))
    known = labels.where("quality is not null and doc_id is not null").where(fold).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    size = {r["y"]: r["n"] for r in known.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return []
    cut = {y: min(1 << 30, int((1 << 30) * rows / n) + 1) for y, n in size.items()}
    known = known.where(F.col("y").isin(0, 1) & (at < F.when(F.col("y") == 1, cut[1]).otherwise(cut[0])))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.where(at < max(cut.values())).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.octet_length("text") <= text_bytes)
    return [(r["text"], r["y"]) for r in texts.join(known, "doc_id").orderBy("doc_id", "y", "text").collect()]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_bytes: int = 1 << 18) -> Network:
    net = Network()
    got = sample(docs, labels, sample_rows, sample_bytes)
    y = np.array([y for _, y in got], dtype=np.float64)
    if len(set(y.tolist())) == 2:
        net.fit([t.encode("utf-8", "surrogatepass") for t, _ in got], y)
    return net


def score(net: Network, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(net.scores(t.tolist()))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs(doc_id, text)`."""
    importable(docs.sparkSession)
    net = train(docs, labels, sample_rows, sample_bytes)
    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), score(net, F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
