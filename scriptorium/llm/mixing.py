"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in an order by hash of their id, form blocks of `block_rows`. The i-th block
(from 1) of a source of weight w has release time floor((i-1)/w) and deadline ceil(i/w); one block is
scheduled in each slot, the released block of the earliest deadline first. Every prefix of the schedule
then holds less than one block more or less of each source than its weight says. Weights are whole parts
of a total B, so the schedule repeats after B slots: one period is a table of B rows, made from the
weights alone, and a block's slot follows from its number. A source that runs out leaves its slots empty;
the others keep their proportions, and no row is left out.

The schedule of one period is made on the driver, from the weights of the sources found: one row per part. It is
broadcast where it has at most `BROADCAST_SLOTS` rows, and joined by shuffles beyond.

Numbers within a source come from counts of hash buckets and ranks inside a bucket, so that no task gets
a whole source. A null source is a source of its own. Rows that repeat are rows of their own in `place`; rows of the
same id and source stand in any order. `mixed` keeps extra columns. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The fixed target weights, in parts; a source that is not listed has DEFAULT_PARTS.
TARGET_PARTS = {"src0": 6, "src1": 5, "src2": 4, "src3": 3, "src4": 2}
DEFAULT_PARTS = 2
BLOCK_ROWS = 32
MAX_BUCKET_BITS = 14
BROADCAST_SLOTS = 10_000


def period(parts: dict[str, int]) -> list[tuple[int, str, int]]:
    """One period of the schedule: (slot, source, number of the block within the period, from 0)."""
    total = sum(parts.values())
    later = [(0, -(-total // p), name, 0) for name, p in parts.items() if p > 0]
    heapq.heapify(later)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, deadline, name, i = heapq.heappop(later)
            heapq.heappush(ready, (deadline, name, i))
        deadline, name, i = heapq.heappop(ready)
        out.append((slot, name, i))
        if i + 1 < parts[name]:
            heapq.heappush(later, ((i + 1) * total // parts[name], -(-(i + 2) * total // parts[name]), name, i + 1))
    return out


def place(docs: DataFrame, parts: dict[str, int] | None = None, default: int = DEFAULT_PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, block (number within the source), slot (place of the block in the mixture), ordinal (place within the source) of each row."""
    parts = TARGET_PARTS if parts is None else parts
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.concat(F.lit("s"), F.col("source").cast("string")).alias("k"))
    rows = rows.withColumn("k", F.coalesce("k", F.lit("n"))).withColumn("h", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"))
    found = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    weights = {k: parts.get(k[1:], default) if k[0] == "s" else default for k in found}
    total = sum(weights.values())
    small = F.broadcast if total <= BROADCAST_SLOTS else (lambda d: d)
    once = spark.createDataFrame([(s, k, i) for s, k, i in period(weights)], "at long, k string, nth long")
    shares = spark.createDataFrame(sorted(weights.items()), "k string, share long")
    # As many hash buckets as keep a bucket at some ten thousand rows, within a bound on their number.
    bits = min(MAX_BUCKET_BITS, max(8, (sum(found.values()) // 10_000).bit_length()))
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - bits))
    size = rows.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = size.select("k", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("h", "doc_id"))
    ranked = rows.withColumn("rank", rank).join(before, ["k", "bucket"]).withColumn("ordinal", F.col("before") + F.col("rank") - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("ordinal") / block_rows).cast("long"))
    ranked = ranked.join(small(shares), "k").withColumn("nth", F.col("block") % F.col("share"))
    timed = ranked.join(small(once), ["k", "nth"])
    return timed.select("doc_id", "source", "block", (F.floor(F.col("block") / F.col("share")) * total + F.col("at")).cast("long").alias("slot"), F.col("ordinal").cast("long").alias("ordinal"))


def mixed(docs: DataFrame, parts: dict[str, int] | None = None, default: int = DEFAULT_PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents in the order of the mixture (sorted across the output files); columns as they come, none left out."""
    at = place(docs, parts, default, block_rows).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "slot", "ordinal")
    at = at.groupBy("__id", "__source").agg(F.min(F.struct("slot", "ordinal")).alias("__at"))
    both = docs.join(at, docs["doc_id"].eqNullSafe(at["__id"]) & docs["source"].eqNullSafe(at["__source"]), "left")
    return both.repartitionByRange("__at").sortWithinPartitions("__at").select(*[docs[c] for c in docs.columns])
