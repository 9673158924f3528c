"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams (letters lower-cased, every run of other characters one
space) with absolute discounting and continuation counts below the highest order. All models live in
sorted arrays of 64-bit n-gram hashes: an n-gram seen in any language holds the interpolated log
probability of every language, a context the back-off weight of every language. A text gets the language
of the lowest cross-entropy per character. A text is rejected where that cross-entropy lies far above
what calibration texts of the same language show at this length, by a fixed margin besides.

Learning takes a bounded sample: about `sample_docs` texts a language by hash of the id, whole texts, and
as many again for calibration; counts are summed on the executors. Every text is scored whole.

A text's score is a function of the text alone: what stands beside it in a batch changes no bit.

Null, empty or letterless texts: `und`, score 0, rejected. Null ids are never learnt from. No labelled
rows: every text is `und`. Languages of equal cross-entropy: the first by name. Extra columns are ignored;
rows that repeat are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import U, importable, mix

ORDER = 4
SLICE_CHARS = 1 << 20
#: Bits per character that a text must lie above the calibrated bound of its length to be rejected: texts of
#: two learned languages, of code or of tables stay, texts of no learned language lie four bits and more above.
MARGIN_BITS = 1.5
_CLASS: list[np.ndarray] = []


def char_class() -> np.ndarray:
    """Code point -> code point of its lower-case letter; 32 for all that is not a letter."""
    if not _CLASS:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _CLASS.append(t)
    return _CLASS[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts and each one's offsets; a text ends with a space and starts with none."""
    joined = " ".join(texts) + " "
    cp = char_class()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    keep = np.ones(len(cp), dtype=bool)
    keep[0], keep[1:] = cp[0] != 32, (cp[1:] != 32) | (cp[:-1] != 32)
    keep[ends - 1] = True  # each text's closing space
    count = np.concatenate(([0], np.cumsum(keep)))
    offs = np.concatenate(([0], count[ends]))
    return cp[keep], offs


def grams(cp: np.ndarray, first: np.ndarray, here: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position `here`; before `first`, the start of its text, stand spaces."""
    h = np.full(len(here), n, dtype=U)
    for back in range(n - 1, -1, -1):
        at = here - back
        c = np.where(at >= first, cp[np.maximum(at, 0)], 32).astype(U)
        h = h * U(0x100000001B3) + c
    return mix(h)


def _runs(texts: list) -> Iterator[tuple[int, list[str]]]:
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if run and size + len(t) > SLICE_CHARS:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


class Model:
    """Log2 probabilities of all languages by n-gram hash, per order; back-off weights by context hash."""

    def __init__(self, langs: list[str]):
        self.langs, self.keys, self.logp, self.bow_keys, self.bow = langs, {}, {}, {}, {}
        self.mean, self.spread = np.zeros(len(langs)), np.full(len(langs), np.inf)

    def loss(self, cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, languages): summed -log2 probability; no text may be without a character."""
        todo, first = np.arange(len(cp)), np.repeat(offs[:-1], np.diff(offs))
        total = np.zeros((len(cp), len(self.langs)), dtype=np.float32)
        for n in range(ORDER, 0, -1):
            at, hit = _found(self.keys[n], grams(cp, first, todo, n))
            total[todo[hit]] += self.logp[n][at[hit]]
            todo, first = todo[~hit], first[~hit]
            if not len(todo):
                break
            if n == 1:
                total[todo] += self.floor
                break
            # The context of a missing n-gram: the n-1 characters before, spaces before the text's start.
            at, known = _found(self.bow_keys[n - 1], grams(cp, first, todo - 1, n - 1))
            total[todo[known]] += self.bow[n - 1][at[known]]
        # Summed within each text, so that no rounding comes from the texts before it.
        return -np.add.reduceat(total, offs[:-1], axis=0, dtype=np.float64)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the asked hashes stand among sorted keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return at, keys[at] == asked


def gram_counts(cp: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct ORDER-character strings and how often each occurs."""
    first = np.repeat(offs[:-1], np.diff(offs))
    _, at, n = np.unique(grams(cp, first, np.arange(len(cp)), ORDER), return_index=True, return_counts=True)
    first = first[at]
    cols = [np.where(at - back >= first, cp[np.maximum(at - back, 0)], 32).astype(np.uint32) for back in range(ORDER - 1, -1, -1)]
    flat = np.stack(cols, axis=1).tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)], n


def _string_hash(rows: list[str]) -> np.ndarray:
    """The hashes of equally long strings, as grams() makes them."""
    n = len(rows[0])
    cp = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n)
    h = np.full(len(rows), n, dtype=U)
    for k in range(n):
        h = h * U(0x100000001B3) + cp[:, k].astype(U)
    return mix(h)


def kneser_ney(counts: dict[str, dict[str, int]]) -> Model:
    """Models from each language's counts of ORDER-character strings."""
    langs = sorted(counts)
    model = Model(langs)
    alphabet = {g[-1] for c in counts.values() for g in c}
    uniform = 1.0 / (len(alphabet) + 1)
    prob: list[dict[int, dict[str, float]]] = []
    back: list[dict[int, dict[str, float]]] = []
    for lang in langs:
        level: dict[int, dict[str, int]] = {ORDER: counts[lang]}
        for n in range(ORDER - 1, 0, -1):
            lower: dict[str, int] = {}
            for g in level[n + 1]:  # a continuation count: the distinct characters that stand before
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            level[n] = lower
        p: dict[int, dict[str, float]] = {}
        b: dict[int, dict[str, float]] = {}
        for n in range(1, ORDER + 1):
            c = level[n]
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, v in c.items():
                total[g[:-1]] = total.get(g[:-1], 0) + v
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            b[n - 1] = {h: d * kinds[h] / total[h] for h in total}
            p[n] = {g: max(v - d, 0) / total[g[:-1]] + b[n - 1][g[:-1]] * (uniform if n == 1 else p[n - 1][g[1:]]) for g, v in c.items()}
        prob.append(p)
        back.append(b)

    def full(k: int, g: str) -> float:
        n = len(g)
        if not n:
            return uniform
        got = prob[k][n].get(g)
        return got if got is not None else back[k][n - 1].get(g[:-1], 1.0) * full(k, g[1:])

    for n in range(1, ORDER + 1):
        rows = sorted({g for p in prob for g in p[n]})
        h = _string_hash(rows)
        at = np.argsort(h)
        table = np.log2(np.array([[full(k, g) for k in range(len(langs))] for g in rows]))
        model.keys[n], model.logp[n] = h[at], table[at].astype(np.float32)
        if n < ORDER:
            rows = sorted({g for b in back for g in b[n]})
            h = _string_hash(rows)
            at = np.argsort(h)
            table = np.log2(np.array([[b[n].get(g, 1.0) for b in back] for g in rows]))
            model.bow_keys[n], model.bow[n] = h[at], table[at].astype(np.float32)
    model.floor = np.log2(np.array([b[0].get("", 1.0) * uniform for b in back])).astype(np.float32)
    return model


def train(docs: DataFrame, sample_docs: int = 300) -> Model:
    """Learn from `docs(doc_id, text, lang)`; at about `sample_docs` whole texts a language, and as many to calibrate."""
    importable(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("text", "lang", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)).alias("at"))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model([])
    cut = {k: min(1 << 29, int((1 << 30) * sample_docs / n) + 1) for k, n in size.items()}
    pick = F.create_map(*[x for k, v in sorted(cut.items()) for x in (F.lit(k), F.lit(v))])[F.col("lang")]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, part in f.groupby("lang"):
                for _, run in _runs(part["text"].tolist()):
                    cp, offs = letters(run)
                    if len(cp):
                        g, n = gram_counts(cp, offs)
                        yield pd.DataFrame({"lang": lang, "gram": g, "n": n})

    learn = rows.where(F.col("at") < pick).select("lang", "text")
    counts: dict[str, dict[str, int]] = {}
    for r in learn.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    if not counts:
        return Model([])
    model = kneser_ney(counts)

    def losses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = f["lang"].map({k: i for i, k in enumerate(model.langs)})
            f, own = f[own.notna()], own[own.notna()].astype(int).to_numpy()
            if len(f):
                ce, n = cross_entropy(model, f["text"].tolist())
                yield pd.DataFrame({"lang": own, "ce": ce[np.arange(len(f)), own], "n": n})

    held = rows.where((F.col("at") >= pick) & (F.col("at") < 2 * pick)).select("lang", "text")
    seen = held.mapInPandas(losses, "lang int, ce double, n long").where("n > 1").toPandas()
    for k in range(len(model.langs)):
        own = seen[seen["lang"] == k]
        if len(own) >= 20:
            model.mean[k] = own["ce"].median()
            model.spread[k] = 1.5 * ((own["ce"] - model.mean[k]) * np.sqrt(own["n"])).max() + 1e-6
    return model


def cross_entropy(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) bits per character, and each text's number of characters that count (1: no letter)."""
    ce, size = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), dtype=np.int64)
    for first, run in _runs(texts):
        cp, offs = letters(run)
        n = np.diff(offs)
        inked = np.concatenate(([0], np.cumsum(cp != 32)))
        some = (inked[offs[1:]] - inked[offs[:-1]]) > 0
        ce[first : first + len(run)] = model.loss(cp, offs) / np.maximum(n, 1)[:, None]
        size[first : first + len(run)] = np.where(some, n, 0)
    return ce, size


def predict(model: Model, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not model.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "rejected": True})
        ce, n = cross_entropy(model, texts.tolist())
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(ce)), best]
        # Posterior over languages; the evidence of a long text counts as that of 64 characters at most.
        odds = np.exp2(-(ce - low[:, None]) * np.minimum(n, 64)[:, None])
        score = 1 / odds.sum(axis=1)
        far = low > model.mean[best] + MARGIN_BITS + model.spread[best] / np.sqrt(np.maximum(n, 1))
        und = n == 0
        names = np.array(model.langs, dtype=object)[best]
        return pd.DataFrame({"lang_pred": np.where(und, "und", names), "score": np.where(und, 0.0, score), "rejected": und | far})

    return of(text)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from: crc32 of the id as text, mod 4, is not 2."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def identify(docs: DataFrame, sample_docs: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of `docs(doc_id, text, lang)`."""
    model = train(learnable(docs), sample_docs)
    got = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), predict(model, F.col("text").cast("string")).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame, sample_docs: int = 300) -> DataFrame:
    """The documents that are not rejected; columns as they come."""
    model = train(learnable(docs), sample_docs)
    return docs.withColumn("__lang", predict(model, F.col("text").cast("string"))).where("not __lang.rejected").drop("__lang")
