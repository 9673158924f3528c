"""Sharding by extendible hashing.

A document's key is the first 60 bits of the MD5 of its id. The directory starts with one bucket; a bucket
over the byte limit splits on its next bit, and only such buckets do, until each fits. Sizes come from one
aggregate over a prefix of the key some bits longer than the limit asks for; where buckets of that length
are still too large, only those are counted again by a longer prefix. The directory is a table of one row
per shard and is joined by prefix, never collected.

`assign` can take a column of keys instead: by the key of a row's place in the table (`placed`) a shard is a run of
rows that follow each other, so that the shards of a mixture hold its sources in its proportions. Rows of the same id may
then lie in different shards.

A null text has 0 bytes; a null id has the key of the empty string. Rows of the same id have the same key
and stay together; a bucket that one key fills over the limit cannot split and is marked `oversized`.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import stage

KEY_BITS = 60
BYTE_LIMIT = 8 << 20


def key(column: str):
    """The 60-bit key of an id column, as long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, byte_limit: int) -> DataFrame:
    """(depth, prefix, bytes, rows, oversized): the shards of `sizes(k, bytes)`; prefix holds the first `depth` bits."""
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    depth = min(KEY_BITS, max(4, (total // byte_limit).bit_length() + 5))
    found, open_rows, floor = [], sizes, 0
    while True:
        leaf = open_rows.groupBy(F.shiftright("k", KEY_BITS - depth).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        leaf = stage(leaf, "shard-leaves")
        # Every leaf's ancestors from `floor` on; a bucket is a shard where it fits and its parent does not.
        up = leaf.select(F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("depth"), "leaf", "bytes", "rows", "lo", "hi")
        tree = up.groupBy("depth", F.expr(f"shiftright(leaf, {depth} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        tree = tree.withColumn("full", (F.col("bytes") > byte_limit) & (F.col("lo") < F.col("hi")))
        parent = tree.where("full").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = tree.where("not full").withColumn("parent", F.shiftright("prefix", 1)).join(parent, ["depth", "parent"])
        root = tree.where(f"not full and depth = {floor}")
        found.append(fits.unionByName(root.withColumn("parent", F.lit(None).cast("long"))).select("depth", "prefix", "bytes", "rows", (F.col("bytes") > byte_limit).alias("oversized")))
        more = leaf.where((F.col("bytes") > byte_limit) & (F.col("lo") < F.col("hi"))).select(F.col("leaf").alias("up"))
        if depth >= KEY_BITS or more.isEmpty():
            break
        open_rows = open_rows.join(more, F.shiftright("k", KEY_BITS - depth) == F.col("up"), "left_semi")
        floor, depth = depth + 1, min(KEY_BITS, depth + 8)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return stage(out.where("rows > 0"), "shard-directory")


def placed(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a column `name`: the key of their place, by files in the order of their names and rows in a file, else by partitions.

    A file's first place comes from the counts of the files before it: one row per file."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        rows = docs.select("*", F.format_string("%09d", F.spark_partition_id()).alias("__file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"))
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = stage(files.select("__file", "n", before.alias("before")), "shard-files")
    total = files.agg(F.sum("n").alias("n")).first()["n"] or 1
    at = F.expr(f"shiftleft(before + __row, {KEY_BITS - total.bit_length()})")
    return rows.join(F.broadcast(files.drop("n")), "__file").select(*[rows[c] for c in docs.columns], at.alias(name))


def assign(docs: DataFrame, byte_limit: int = BYTE_LIMIT, place: str | None = None) -> DataFrame:
    """doc_id, shard (the bits of its prefix, `r` before them), depth, shard_bytes, shard_rows, oversized of each row of `docs(doc_id, text)`; by the keys of column `place`, if given, else by those of the ids."""
    own = key("doc_id") if place is None else F.col(place)
    sizes = docs.select(own.alias("k"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"))
    shards = directory(sizes, byte_limit)
    spans = shards.withColumn("shard", F.concat(F.lit("r"), F.expr("case when depth = 0 then '' else lpad(conv(prefix, 10, 2), depth, '0') end")))
    keyed = docs.select("doc_id", own.alias("k"))
    # Shards are disjoint ranges of keys: both sides are cut into cells of a common length, at most a few to a shard.
    bits = min(KEY_BITS, max(8, shards.count().bit_length() + 2))
    lo = F.expr(f"shiftleft(prefix, {KEY_BITS} - depth)")
    spans = spans.withColumns({"lo": lo, "hi": lo + F.expr(f"shiftleft(1L, {KEY_BITS} - depth)")})
    cells = spans.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", KEY_BITS - bits), F.shiftright(F.col("hi") - 1, KEY_BITS - bits))))
    got = keyed.withColumn("cell", F.shiftright("k", KEY_BITS - bits)).join(cells, "cell").where("k >= lo and k < hi")
    return got.select("doc_id", "shard", F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "oversized")
