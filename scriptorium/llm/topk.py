"""Exact top-k search by inner product over an impact-ordered index, a score at a time.

Components become floor(256 * x). A block of vectors is indexed by postings: for each dimension the rows with a
component there, cut into segments of equal quantised impact (the two leading bits of the component's size).
All segments of a higher impact are processed before those of a lower one, for a block of queries at once. What
a row has not yet given is known by its norm, so every partial score has proven bounds. A candidate leaves only
on proof: its upper bound lies below the k-th best lower bound, of its own block or of the blocks of the same
task before, whose k-th best scores are carried on. Processing stops once few candidates are left; these are
rescored exactly, in integers, from the whole vectors; ties go to the smaller id.

Vectors with a component of 2^20 or more after scaling stand in blocks of their own, as they came. Their scores are
first bounded in floating point, scaled and with the rounding error added, and whoever may be among the k best
is rescored in integers of any length.

The queries are a stated set, held against all rows in blocks: the work is the product of both. Vectors that are
null, empty or hold null or non-finite components take no part; nor do rows without an id. Shorter vectors count
as filled with zeros. Rows that repeat an id are each a candidate, except for a query of that id. A score beyond
the range of long is given as that range's end. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import importable

BLOCK = 1024
#: Components from here on make a vector wide.
WIDE = 1 << 20
#: Candidates for each query that are few enough to rescore.
FEW = 32
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x, as doubles, of each vector that takes part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    return rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` vectors, wide ones apart: g (a number to deal them by), ids, dim, wide, and components: whole numbers of 32 bits, of wide ones x itself."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, list[tuple[int, np.ndarray]]] = {False: [], True: []}

        def block(wide: bool) -> pd.DataFrame:
            dim = max(len(q) for _, q in held[wide])
            values = np.zeros((len(held[wide]), dim), dtype=np.float64 if wide else np.int32)
            for i, (_, q) in enumerate(held[wide]):
                values[i, : len(q)] = q
            ids = np.array([i for i, _ in held[wide]], dtype=np.int64)
            held[wide] = []
            return pd.DataFrame({"g": [int(ids[0])], "ids": [ids.tobytes()], "dim": [dim], "wide": [wide], "vals": [values.tobytes()]})

        for f in frames:
            for i, x in zip(f["vec_id"], f["x"], strict=True):
                x = np.asarray(x, dtype=np.float64)
                wide = bool(np.abs(x).max() >= WIDE / 256)
                held[wide].append((int(i), x if wide else np.floor(x * 256)))
                if len(held[wide]) == size:
                    yield block(wide)
        for wide in held:
            if held[wide]:
                yield block(wide)

    return rows.mapInPandas(of, "g long, ids binary, dim int, wide boolean, vals binary")


def postings(values: np.ndarray) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The segments (dimension, rows, components) of each quantised impact, highest impact first."""
    rows, dims = np.nonzero(values)
    held = values[rows, dims].astype(np.int64)
    size = np.abs(held)
    top = np.frexp(size.astype(np.float64))[1] - 1
    impact = 2 * top + ((size >> np.maximum(top - 1, 0)) & 1)
    order = np.lexsort((dims, -impact))
    rows, dims, held, impact = rows[order], dims[order], held[order], impact[order]
    cuts = np.flatnonzero((np.diff(impact, prepend=-1) != 0) | (np.diff(dims, prepend=-1) != 0))
    level: list[tuple[int, np.ndarray, np.ndarray]] = []
    for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
        if level and impact[a] != impact[a - 1]:
            yield level
            level = []
        level.append((int(dims[a]), rows[a:b], held[a:b]))
    if level:
        yield level


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column; -inf where there are fewer rows."""
    if len(scores) < k:
        return np.full(scores.shape[1], -np.inf)
    return np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]


def best(row: np.ndarray, query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs (row, query) are among their query's k best; ties to the smaller id."""
    order = np.lexsort((ids[row], -score, query))
    asked = query[order]
    first = np.flatnonzero(np.diff(asked, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def search(queries: np.ndarray, query_ids: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best of a block that reach `bar`, its k-th best score so far; `bar` rises."""
    w = np.ascontiguousarray(queries.T, dtype=np.int64)
    weight = np.sqrt((w.astype(np.float64) ** 2).sum(axis=0))
    acc = np.zeros((len(ids), len(query_ids)), dtype=np.int64)
    other = ids[:, None] != query_ids[None, :]
    rest = (values.astype(np.int64) ** 2).sum(axis=1)
    whole, alive = int(rest.sum()), other
    for level in postings(values):
        for dim, rows, held in level:
            acc[rows] += held[:, None] * w[dim]
            rest[rows] -= held * held
        if 2 * int(rest.sum()) > whole:
            continue  # more than half is to come: no bound would hold anything back
        # Cauchy and Schwarz bound what is left; rounding is added.
        left = np.sqrt(rest.astype(np.float64))[:, None] * (weight * (1 + 1e-9)) + 0.5 * (rest > 0)[:, None]
        least = np.maximum(bar, kth(np.where(other, acc - left, -np.inf), k))
        alive = other & (acc + left >= least)
        if alive.sum() <= FEW * len(query_ids):
            break
    row, query = np.nonzero(alive)
    score = np.concatenate([(values[row[a : a + 65536]].astype(np.int64) * queries[query[a : a + 65536]]).sum(axis=1) for a in range(0, len(row), 65536)] or [np.zeros(0, dtype=np.int64)])
    at = best(row, query, score, ids, k)
    at = at[score[at] >= bar[query[at]]]
    _raise(bar, query[at], score[at], k)
    return query[at], ids[row[at]], score[at]


def _raise(bar: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """Lift the bars of queries that have k of these scores (sorted by query, then falling) to the least of them."""
    n = np.bincount(query, minlength=len(bar))
    last = np.cumsum(n) - 1
    full = np.flatnonzero(n >= k)
    bar[full] = np.maximum(bar[full], score[last[full]].astype(np.float64))


def integers(x: np.ndarray, wide: bool) -> list[int]:
    """floor(256 * x) of a wide vector, a narrow one as it is, in integers of any length."""
    if not wide:
        return [int(v) for v in x]
    return [math.floor(v * 256) if abs(v) < 1e300 else int(v) * 256 for v in x.tolist()]


def scaled(x: np.ndarray, wide: bool) -> np.ndarray:
    """The same as floats, divided by a power of two that leaves the largest below one."""
    high = int(np.frexp(np.abs(x).max(initial=0.0))[1]) + 8 * wide
    with np.errstate(over="ignore"):
        q = np.floor(np.ldexp(x, 8)) if wide else x.astype(np.float64)
    return np.where(np.isfinite(q), np.ldexp(np.where(np.isfinite(q), q, 0.0), -high), np.ldexp(x.astype(np.float64), 8 - high))


def search_wide(q: np.ndarray, q_wide: bool, query_ids: np.ndarray, values: np.ndarray, wide: bool, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search(), where a side is wide."""
    a, b = scaled(values, wide), scaled(q, q_wide)
    other = ids[:, None] != query_ids[None, :]
    guess, slack = a @ b.T, (a.shape[1] + 4) * 2.0**-51 * (np.abs(a) @ np.abs(b).T) + 1e-290
    alive = other & (guess + slack >= kth(np.where(other, guess - slack, -np.inf), k))
    row, query = np.nonzero(alive)
    v, w = {r: integers(values[r], wide) for r in np.unique(row)}, {i: integers(q[i], q_wide) for i in np.unique(query)}
    exact = [sum(map(int.__mul__, v[r], w[i])) for r, i in zip(row.tolist(), query.tolist(), strict=True)]
    order = sorted(range(len(exact)), key=lambda j: (query[j], -exact[j], ids[row[j]]))
    rank, out = 0, []
    for n, j in enumerate(order):
        rank = rank + 1 if n and query[j] == query[order[n - 1]] else 0
        if rank < k:
            out.append(j)
    ends = np.iinfo(np.int64)
    return query[out], ids[row[out]], np.array([min(max(exact[j], ends.min), ends.max) for j in out], dtype=np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of `vectors(vec_id, embedding)`, its own id left out."""
    spark = vectors.sparkSession
    importable(spark)
    deal = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = packed(usable(vectors), BLOCK).withColumn("g", F.pmod(F.xxhash64("g"), F.lit(deal)))
    asked = packed(usable(queries), BLOCK).selectExpr("ids as q_ids", "dim as q_dim", "wide as q_wide", "vals as q_vals")
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bar = b"", np.zeros(0)
        for f in frames:
            for r in f.itertuples():
                ids, q_ids = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.q_ids, dtype=np.int64)
                values = np.frombuffer(r.vals, dtype=np.float64 if r.wide else np.int32).reshape(-1, r.dim)
                q = np.frombuffer(r.q_vals, dtype=np.float64 if r.q_wide else np.int32).reshape(-1, r.q_dim)
                dim = max(r.dim, r.q_dim)
                values, q = np.pad(values, ((0, 0), (0, dim - r.dim))), np.pad(q, ((0, 0), (0, dim - r.q_dim)))
                if now != r.q_ids:  # blocks of the same queries follow each other
                    now, bar = r.q_ids, np.full(len(q_ids), -np.inf)
                if r.wide or r.q_wide:
                    i, other, score = search_wide(q, r.q_wide, q_ids, values, r.wide, ids, k)
                else:
                    i, other, score = search(q, q_ids, values, ids, k, bar)
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": other, "score": score})

    near = asked.join(index.hint("merge"), "g").select("q_ids", "q_dim", "q_wide", "q_vals", "ids", "dim", "wide", "vals").mapInPandas(of, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
