"""Shared pieces of the operators: vectorised word hashing, shared-storage stages, components.

Words are maximal runs of bytes outside space and 0x09-0x0D of the UTF-8 text, A-Z lower-cased.
Everything here works on slices of a batch, bounded but for one longer text: memory follows the longest text, not the batch.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
SLICE_BYTES = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """Bounded runs of UTF-8 texts (null: empty) with the position of the first of each run."""
    run: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and size + len(b) > SLICE_BYTES:
            yield first, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, the word offsets of each text, and each word's first byte in the joined run."""
    joined = b" ".join(run) + b" " * 9
    raw = np.frombuffer(joined, dtype=np.uint8)
    low = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    lens = ends - starts
    eight = np.ndarray(shape=(len(low) - 7,), dtype="<u8", buffer=low.tobytes(), strides=(1,))
    h = lens.astype(U) * U(0x9E3779B97F4A7C15)
    at, left, idx = starts, lens, np.arange(len(starts))
    while len(idx):
        keep = np.where(left >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1))
        h[idx] = mix((h[idx] ^ (eight[at] & keep)) + U(0x9E3779B97F4A7C15))
        more = left > 8
        at, left, idx = at[more] + 8, left[more] - 8, idx[more]
    bounds = np.zeros(len(run) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in run], out=bounds[1:])
    return h, np.searchsorted(starts, bounds), starts


def shingles(h: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and each text's offsets; a shorter text is one shingle, an empty one none."""
    words = np.diff(offs)
    if len(h) >= n:
        acc = np.zeros(len(h) - n + 1, dtype=U)
        for k in range(n):
            acc = mix(acc + h[k : len(h) - n + 1 + k] + U(k + 1))
    else:
        acc = np.zeros(0, dtype=U)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    out = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(count, out=out[1:])
    got = np.empty(out[-1], dtype=U)
    full = words >= n
    inner = np.repeat(full, count)
    src = np.arange(out[-1]) - np.repeat(out[:-1], count) + np.repeat(offs[:-1], count)
    got[inner] = acc[src[inner]]
    for d in np.flatnonzero((words > 0) & ~full):
        part = np.array([U(words[d])], dtype=U)
        for k in range(offs[d], offs[d + 1]):
            part = mix(part + h[k : k + 1] + U(0x5851F42D4C957F2D))
        got[out[d]] = part[0]
    return got, out


def pack(a: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: small ones take little room."""
    return zlib.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def by_frequency(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, the most frequent first, and the place of each: frequent ones have small numbers, which pack well."""
    words, at, n = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    return words[order], rank[at]


#: What a batch gives to a range of hashes: its sorted distinct keys there and a count of each; what it gets back: their sums.
GIVEN = "batch long, range int, keys binary, n binary"
SUMMED = "batch long, range int, n binary"


def spans(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys in each of `parts` equal ranges of hashes that holds any."""
    cuts = [*np.searchsorted(keys, np.array([(k << 64) // parts for k in range(parts)], dtype=U)).tolist(), len(keys)]
    return [(k, x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


def gives(batch: int, keys: np.ndarray, n: np.ndarray, parts: int) -> pd.DataFrame:
    """A batch's keys and counts, dealt by ranges."""
    return pd.DataFrame([(batch, k, pack(np.diff(keys[x:y], prepend=U(0))), pack(n[x:y])) for k, x, y in spans(keys, parts)], columns=["batch", "range", "keys", "n"])


def summed(given: DataFrame, name: str) -> DataFrame:
    """For each batch and range the sums over all batches of its keys' counts, in the order of its keys."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(b), dtype=U) for b in f["keys"]]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([unpack(b) for b in f["n"]]).astype(np.float64)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        rows = [(int(b), int(f["range"].iloc[0]), pack(n[at[e - len(k) : e]])) for b, k, e in zip(f["batch"], keys, ends, strict=True)]
        return pd.DataFrame(rows, columns=["batch", "range", "n"])

    return stage(given.groupBy("range").applyInPandas(of, SUMMED), name)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the session's own path does not hold it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a session inside one process may do without the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='stages-')}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of what is now written are of no more use; a collection on the driver lets Spark drop them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As stage(), in buckets by a key: joins and groups by the key read them as they lie, without a shuffle.

    Buckets need a name in the session's catalog; the files lie in the shared folder."""
    spark = df.sparkSession
    mark = f"{name}-{uuid.uuid4().hex}"
    table = mark.replace("-", "_")
    path = f"{shared_dir(spark).rstrip('/')}/{mark}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    spark.sparkContext._jvm.System.gc()
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for nodes of `edges(a, b)`; min-label rounds with pointer jumping, until nothing changes."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "label")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near, label.node == near.a, "left").select("node", "comp", F.least("comp", "near").alias("low"))
        hop = label.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        after = step.join(hop, step.low == hop.via, "left").select("node", "comp", F.least("low", "far").alias("next"))
        after = stage(after, "label")
        dropped(label)
        label = after.select("node", F.col("next").alias("comp"))
        if after.where("next <> comp").isEmpty():
            dropped(both)
            return label
