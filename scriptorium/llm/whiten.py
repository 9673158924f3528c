"""Embedding whitening: streaming covariance, symmetric QR eigen-solve, projection on unit variance.

Vectors become whole numbers, x = floor(256 c). The fit list is each distinct x once. In every task an iterator
updates count, mean and centred products by one vector at a time (Welford's rank-one update), and exact sums
beside them; the states of all tasks, one matrix each, are merged by the parallel update formula in rounds of
`FAN` states a task, so that what reaches the driver is one state. Its covariance is brought to tridiagonal
form by Householder reflections and solved by QR steps with Wilkinson's shift. A second pass of the same kind over the
whitened fit list measures how far its covariance is from the identity.

Null vectors, empty ones and those with null or non-finite entries take no part; neither do vectors of another
length than most have (of lengths equally frequent the greatest). Entries beyond 2^62 after scaling count as that. Components of
no variance (to rounding) are left out, so that a table of fewer distinct vectors than components has fewer rows a
vector; with one distinct vector there are none. A deviation beyond a long is null. Rows with null or repeated ids
each have their own result; equal vectors have equal ones. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import dropped, importable, stage

SCALE = 256.0
#: States that one task merges.
FAN = 16
STATE = "part int, n long, sums array<decimal(38,0)>, mean binary, products binary"
_FAR = float(1 << 62)


@dataclass
class Moments:
    """Count, exact sums, mean and centred products of vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def none(d: int) -> Moments:
        return Moments(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def merged(self, o: Moments) -> Moments:
        """The parallel update: both means weighted, and a rank-one term for the distance between them."""
        n = self.n + o.n
        if not n:
            return self
        gap = o.mean - self.mean
        products = self.products + o.products + np.outer(gap, gap) * (self.n * (o.n / n))
        return Moments(n, [a + b for a, b in zip(self.sums, o.sums, strict=True)], self.mean + gap * (o.n / n), products)

    def frame(self, part: int) -> pd.DataFrame:
        row = (part, self.n, [Decimal(x) for x in self.sums], self.mean.tobytes(), self.products.tobytes())
        return pd.DataFrame([row], columns=["part", "n", "sums", "mean", "products"])

    @staticmethod
    def of(row) -> Moments:
        mean = np.frombuffer(row.mean, dtype=np.float64).copy()
        return Moments(int(row.n), [int(x) for x in row.sums], mean, np.frombuffer(row.products, dtype=np.float64).reshape(len(mean), len(mean)).copy())


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all: equal vectors have equal bytes."""
    most = int(np.abs(x).max(initial=0))
    kind = next(k for k, top in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top)
    return kind[-1].encode() + x.astype(kind).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<i{b[:1].decode()}", offset=1).astype(np.int64)


def whole_numbers(vectors: list) -> list[np.ndarray | None]:
    """floor(256 c) of each vector; none where it takes no part."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        a = None if v is None or not len(v) else np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", object) == object else v, dtype=np.float64)
        fit = a is not None and bool(np.isfinite(a).all())
        out.append(np.clip(np.floor(SCALE * a), -_FAR, _FAR).astype(np.int64) if fit else None)
    return out


def quantised(rows: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """(keep..., x binary, d int) of the rows that take part."""
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = whole_numbers(f["__v"].tolist())
            fit = np.array([x is not None for x in got], dtype=bool)
            out = f.loc[fit, keep]
            yield out.assign(x=[packed(x) for x in got if x is not None], d=[len(x) for x in got if x is not None])

    return rows.select(*keep, F.col(vector).alias("__v")).mapInPandas(of, ", ".join(x for x in (kept, "x binary, d int") if x))


def moments(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], exact: bool, name: str) -> Moments:
    """Moments of of(x) over a table's vectors x: rank-one updates in each task, then merges by FAN."""

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, mean, products = 0, np.zeros(d), np.zeros((d, d))
        high, low, sums = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64), [0] * d
        step = np.empty((d, d))
        for f in frames:
            for b in f["x"]:
                x = unpacked(b)
                y = of(x)
                n += 1
                delta = y - mean
                mean += delta / n
                np.multiply(delta[:, None], (y - mean)[None, :], out=step)
                products += step
                if exact:
                    high += x >> 32
                    low += x & 0xFFFFFFFF
            if exact:  # halves can't overflow within a batch
                sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
                high[:], low[:] = 0, 0
        if n:
            yield Moments(n, sums, mean, (products + products.T) / 2).frame(TaskContext.get().partitionId())

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = Moments.none(d)
        for r in f.sort_values("part").itertuples():
            total = total.merged(Moments.of(r))
        return total.frame(int(f["part"].iloc[0]) // FAN)

    states = stage(fit.select("x").mapInPandas(streamed, STATE), name)
    while states.select("part").count() > 1:
        before, states = states, stage(states.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, STATE), name)
        dropped(before)
    rows = list(states.toLocalIterator())
    return Moments.of(rows[0]) if rows else Moments.none(d)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and transposed basis of a symmetric matrix's tridiagonal form, by Householder reflections."""
    a, n = a.copy(), len(a)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = math.copysign(float(np.linalg.norm(v)), v[0])
        if length == 0:
            continue
        v[0] += length
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - v * (v @ p)
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -length
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        basis[k + 1 :] -= 2 * np.outer(v, v @ basis[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix: QR steps on its tridiagonal form."""
    d, e, basis = tridiagonal(a)
    eps, high = np.finfo(float).eps, len(d) - 1
    for _ in range(60 * len(d) + 60):
        small = np.abs(e) <= eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[small] = 0
        while high > 0 and e[high - 1] == 0:
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        # The shift is the eigenvalue of the last two rows that lies nearer to the last.
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, q, o = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * q, s * s * p - 2 * c * s * o + c * c * q
            e[k] = c * s * (q - p) + (c * c - s * s) * o
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = c * basis[k] + s * basis[k + 1]
            basis[k + 1] = c * basis[k + 1] - s * basis[k]
            basis[k] = upper
    else:
        raise ArithmeticError("QR steps did not converge")
    order = np.argsort(-d, kind="stable")
    return d[order], basis[order]


@dataclass
class Whitening:
    """What the fit list gives: its size, exact sums, and the leading components with their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """x less the mean, from exact n x - S, and the sum of squares of n x - S."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(x) * reach * reach < 1 << 63:
            apart = self.n * x - np.array(self.sums, dtype=np.int64)
            return apart / self.n, int((apart * apart).sum())
        exact = [self.n * int(c) - s for c, s in zip(x, self.sums, strict=True)]
        return np.array([c / self.n for c in exact], dtype=np.float64), sum(c * c for c in exact)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (self.vectors @ centred) / np.sqrt(self.values)


def fitted(rows: DataFrame, components: int = 4, vector: str = "embedding") -> tuple[int, Whitening | None]:
    """The vectors' length and the whitening of their distinct x; none without vectors that take part."""
    importable(rows.sparkSession)
    distinct = stage(quantised(rows, [], vector).groupBy("x", "d").count(), "whiten-distinct")
    top = distinct.groupBy("d").agg(F.sum("count").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1)
    top = list(top.toLocalIterator())
    if not top:
        return 0, None
    d = int(top[0]["d"])
    fit = distinct.where(F.col("d") == d).select("x")
    m = moments(fit, d, lambda x: x.astype(np.float64), True, "whiten-moments")
    cov = m.products / m.n
    trace = float(np.trace(cov))
    values, vectors = eigen(cov)
    shown = min(components, int((values > len(values) * np.finfo(float).eps * max(trace, 0.0)).sum()))
    values, vectors = values[:shown], vectors[:shown]
    w = Whitening(m.n, m.sums, values, vectors, values / trace if shown else values)
    if shown:
        got = moments(fit, shown, lambda x: w.whitened(w.centred(x)[0]), False, "whiten-again")
        w.identity_error = float(np.abs(got.products / got.n - np.eye(shown)).max())
    dropped(distinct)
    return d, w


def whitened(rows: DataFrame, components: int = 4, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that takes part and component: ident, component, n, deviation, whitened, explained, identity_error."""
    d, w = fitted(rows, components, vector)
    kind = rows.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], schema)
    k = len(w.values)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [w.centred(unpacked(b)) for b in f["x"]]
            far = [s if s < 1 << 63 else None for _, s in got]
            out = pd.DataFrame({ident: f[ident].repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(f)), "n": w.n})
            out["deviation"] = pd.array(far, dtype="Int64").repeat(k)
            out["whitened"] = np.concatenate([w.whitened(c) for c, _ in got]) if got else np.zeros(0)
            yield out.assign(explained=np.tile(w.explained, len(f)), identity_error=w.identity_error)

    return quantised(rows, [ident], vector).where(F.col("d") == d).drop("d").mapInPandas(of, schema)
