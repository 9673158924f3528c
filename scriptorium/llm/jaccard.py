"""N-gram Jaccard join by universe partition and pigeonhole.

A text's set holds the 64-bit hashes of its distinct word shingles. Sets fall into size bands; in a band
all pairs that reach the threshold differ in at most H elements. `allocate` splits the universe of
hashes into segments: exact ones cover one difference each, one-deletion ones two. Light segments, of few
elements, and frequent ones, of elements that many texts share, meet in ever larger buckets; a set leaves
them out as long as it has no more of them than there are spare segments (two sets that agree in a segment
find it equally light and frequent, and a qualifying pair agrees in more segments than there are spare
ones). Every qualifying pair then shares a signature.
Candidates are verified on whole sets.

Equal sets are one class by fingerprint, so copies never meet in pairs. In each bucket all members are
held against one pivot; members still apart afterwards are held against all others of the bucket, so
that no link which joins two components is lost.

The texts meet the ids of the sets that are to be verified once, by the same plan at every size.

Nulls, empty texts and texts without words have an empty set and link with nothing. Repeated rows of an
id are one text each. Rows without an id link as others do and have the class of their text; a class that only
they hold has none. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import U, components, dropped, importable, mix, shingles, slices, stage, word_hashes


#: What meeting by a signature of no element costs, in signatures.
PRICE = 256.0
#: Keys of more rows than this are frequent.
FREQUENT = 16
#: Buckets of up to so many sets are joined pair by pair, larger ones in blocks of so many sets.
SMALL, BLOCK = 32, 512
#: Blocks of a bucket that stand in one task.
GROUP = 8


@lru_cache(maxsize=4096)
def bands(percent: int, upto: int) -> tuple[tuple[int, int], ...]:
    """Size ranges (low, high), each wider than the sizes that one set can link with."""
    out, low = [], 1
    while low <= upto:
        high = max(low, int(low * (100 / percent) ** 1.5))
        out.append((low, high))
        low = high + 1
    return tuple(out)


def differences(percent: int, high: int) -> int:
    """The most elements in which two linked sets of at most `high` elements differ."""
    return (100 - percent) * 2 * high // (100 + percent)


def _sizes(n: int, parts: int, upto: int) -> list[float]:
    """The probabilities that a segment of `parts` holds 0, 1, ... of a set's n elements."""
    if parts == 1:
        return [float(k == n) for k in range(upto)]
    out = [math.exp(n * math.log1p(-1 / parts))]
    for k in range(1, upto):
        out.append(out[-1] * (n - k + 1) / k / (parts - 1) if k <= n else 0.0)
    return out


def _poisson(mean: float, k: int) -> float:
    return math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean > 0 else float(k == 0)


@lru_cache(maxsize=65536)
def allocate(percent: int, low: int, high: int) -> tuple[int, int, int, int]:
    """(exact segments, one-deletion segments, spare ones, light size) of least expected cost.

    A segment of fewer than `light` elements is light; a set of at most `spare` light segments leaves their
    signatures out. Cost: the signatures that a set emits, and for each a price for the unrelated sets it
    meets, ten times less with each element more, since few elements may all stem from a common passage."""
    need, best = differences(percent, high) + 1, None

    def price(size: float) -> float:
        return PRICE * 0.1**size

    # One-deletion segments suit small sets: with them no segment is spare.
    for ones in range(1, (need + 1) // 2 + 1 if need <= 5 else 1):
        exact = max(0, need - 2 * ones)
        m, sizes = low / (exact + ones), _sizes(low, exact + ones, 8)
        tiny = sum(p * price(k) for k, p in enumerate(sizes))
        deleted = sum(p * max(k, 1) * price(max(k - 1, 0)) for k, p in enumerate(sizes))
        cost = exact * (1 + tiny) + ones * (1 + m + tiny + deleted)
        if best is None or cost < best[0]:
            best = (cost, exact, ones, 0, 0)
    for light in range(1, 5):
        for spare in sorted({*range(2, 9), *(need * k // 8 for k in range(1, 13))}):
            parts = need + spare
            sizes = _sizes(low, parts, 8)
            share = sum(sizes[:light])
            mean = parts * share
            over = max(0.0, 1 - sum(_poisson(mean, k) for k in range(spare + 1)))
            cost = parts * (1 - share) + parts * sum(sizes[k] * price(k) for k in range(light, 8))
            # Sets of too many light segments send these as well; what is spare beside them holds off frequent keys.
            cost += over * parts * sum(sizes[k] * price(k) for k in range(light)) + 2.0 * need / (1 + max(0.0, spare - mean))
            if best is None or cost < best[0]:
                best = (cost, parts, 0, spare, light)
    exact, ones, spare, light = best[1:]
    return exact, ones, spare, light


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of a set (sorted distinct hashes) in its own band and the next, where smaller partners of that band's sets lie.

    With each key comes its band and, in the last twelve bits, one more than the number of further segments
    that the set may leave out there; zero: none."""
    n = len(s)
    ranges = bands(percent, 1 << (8 * n + 64).bit_length())
    own = next(i for i, (a, b) in enumerate(ranges) if a <= n <= b)
    keys, tags = [], []
    for k in (own, own + 1):
        low, high = ranges[k]
        if k > own and 100 * n < percent * low:
            continue
        least = max(1, -(-percent * low // 100))
        exact, ones, spare, light = allocate(percent, least, high)
        if differences(percent, high) == 0:
            continue  # only equal sets link, and those are one class already
        parts = exact + ones
        m = mix(s + U(0xD1342543DE82EF95))
        seg = ((m >> U(33)) % U(parts)).astype(np.int64)
        total = np.zeros(parts, dtype=U)
        np.add.at(total, seg, m)
        size = np.bincount(seg, minlength=parts)
        tag = mix(np.arange(parts, dtype=U) + U((k + 1) << 32))
        n_light, left = int((size < light).sum()), 0
        got = mix(total + tag)
        if light and n_light <= spare:
            got, left = got[size >= light], min(spare - n_light, 4000) + 1
        if ones:
            cut = seg >= exact
            got = np.concatenate((got, mix(total[seg[cut]] - m[cut] + tag[seg[cut]])))
        keys.append(got)
        tags.append(np.full(len(got), (k << 12) + left, dtype=np.int32))
    if not keys:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int32)
    keys, at = np.unique(np.concatenate(keys), return_index=True)
    return keys, np.concatenate(tags)[at]


def text_sets(texts: list, words: int) -> Iterator[np.ndarray]:
    for _, run in slices(texts):
        h, offs, _ = word_hashes(run)
        sh, at = shingles(h, offs, words)
        for d in range(len(run)):
            yield np.unique(sh[at[d] : at[d + 1]])


def fingerprint(s: np.ndarray) -> int:
    return int(mix(np.array([(mix(s + U(0xA0761D6478BD642F))).sum(dtype=U) + U(len(s))], dtype=U)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parities of hash buckets, two to four bits for each element: two sets differ in at least as many elements as their sketches in bits."""
    bits = 1 << max(6, (2 * len(s)).bit_length())
    at = (mix(s + U(0x2545F4914F6CDD1D)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of `size` bytes; halves of longer ones are added up."""
    out = np.empty((len(sketches), size), dtype=np.uint8)
    for i, x in enumerate(sketches):
        a = np.frombuffer(x, dtype=np.uint8)
        while len(a) > size:
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        out[i] = a
    return out


def apart_at_least(x: bytes, y: bytes) -> int:
    """How many elements two sketched sets differ in at the least; a longer sketch folds onto a shorter one."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, fp, sketch): size, fingerprint and sketch of each text's set."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(len(s), fingerprint(s) if len(s) else 0, sketch(s) if len(s) else None) for s in text_sets(f["text"].tolist(), words)]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n": [x[0] for x in got], "fp": [x[1] for x in got], "sketch": [x[2] for x in got]})

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, n long, fp long, sketch binary")


def postings(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, fp, tag): the bucket keys of every set; a set met before in the same task brings none again."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for f in frames:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for s in text_sets(f["text"].tolist(), words):
                if len(s) and (fp := fingerprint(s)) not in seen:
                    seen.add(fp)
                    keys, tags = signatures(s, percent)
                    held.append((keys.view(np.int64), np.full(len(keys), fp, dtype=np.int64), tags))
                    size += len(keys)
                    if size > 200_000:
                        yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("sig", "fp", "tag"), zip(*held, strict=True), strict=True)})
                        held, size = [], 0
            if held:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("sig", "fp", "tag"), zip(*held, strict=True), strict=True)})

    return docs.select("text").mapInPandas(of, "sig long, fp long, tag int")


def _verify(percent: int):
    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), dtype=np.int32)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            out[i] = int((x[at] == y).sum())
        return pd.Series(out)

    return common


def hopeful(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of fingerprints that sizes and sketches do not rule out."""

    @F.pandas_udf("int")
    def least(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([apart_at_least(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    left = reps.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    right = reps.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    both = pairs.join(left, "b").join(right, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.withColumn("d", least("s_a", "s_b")).where(F.col("d") * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket, of different components, that sizes and sketches do not rule out.

    members(sig, fp, comp, main, n, sketch, size): those outside the main component are held against all, in blocks
    of some BLOCK sets, so that no task holds a whole bucket."""
    salt = F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / BLOCK))
    parts = ("fp", "comp", "n", "sketch")

    def blocks(rows: DataFrame, mark: str) -> DataFrame:
        got = rows.groupBy("sig", "size", salt.alias("salt")).agg(F.collect_list(F.struct(*parts)).alias("l"))
        return got.select("sig", "size", "salt", *[F.col(f"l.{c}").alias(f"{mark}_{c}") for c in parts])

    # A bucket's blocks are dealt by groups of GROUP, and each block of the others goes to every group: no task has all pairs of a bucket.
    groups = F.sequence(F.lit(0).cast("long"), F.floor((F.ceil(F.col("size") / BLOCK) - 1) / GROUP))
    asked = blocks(members.where("comp <> main"), "x").withColumn("group", F.explode(groups)).drop("size", "salt")
    held = blocks(members, "y").withColumn("group", F.floor(F.col("salt") / GROUP)).drop("size", "salt")
    both = asked.join(held, ["sig", "group"]).drop("sig", "group")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            left, right = [], []
            for r in f.itertuples():
                x_fp, y_fp = np.asarray(r.x_fp), np.asarray(r.y_fp)
                x_n, y_n, y_comp = np.asarray(r.x_n), np.asarray(r.y_n), np.asarray(r.y_comp)
                short = min(min(map(len, r.x_sketch)), min(map(len, r.y_sketch)))
                x_s, y_s = folded(r.x_sketch, short), folded(r.y_sketch, short)
                for i in range(len(x_fp)):
                    at = np.flatnonzero((y_comp != r.x_comp[i]) & (100 * np.minimum(y_n, x_n[i]) >= percent * np.maximum(y_n, x_n[i])))
                    if len(at):
                        d = np.bitwise_count(y_s[at] ^ x_s[i]).sum(axis=1, dtype=np.int64)
                        at = at[d * (100 + percent) <= (100 - percent) * (y_n[at] + x_n[i])]
                        left.append(np.minimum(y_fp[at], x_fp[i]))
                        right.append(np.maximum(y_fp[at], x_fp[i]))
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()

    return both.mapInPandas(of, "a long, b long")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of fingerprints whose whole sets reach the threshold, with the number of elements they differ in."""
    left = sets.select(F.col("fp").alias("b"), F.col("items").alias("items_b"), F.col("n").alias("n_b"))
    right = sets.select(F.col("fp").alias("a"), F.col("items").alias("items_a"), F.col("n").alias("n_a"))
    both = pairs.join(left, "b").join(right, "a").withColumn("both", _verify(percent)("items_a", "items_b"))
    both = both.select("a", "b", (F.col("n_a") + F.col("n_b") - 2 * F.col("both")).alias("d"), (100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("linked"))
    return both


def buckets(met: DataFrame) -> DataFrame:
    """(sig, fp, pivot): the buckets of two sets and more that are to be looked at, and the set that the others are held against first.

    A frequent key is one of more than FREQUENT rows. Of its frequent keys in a band a set leaves out the most
    frequent ones, as many as spare segments are left beside its light ones. Two qualifying sets agree in more
    segments than there are spare ones; if all of these are light or frequent, the least frequent of them is
    left out by neither. The pivot is the set whose keys most others share: near copies of one text stand
    closest to it."""
    seldom = met.where(F.col("m") <= FREQUENT).select("sig", "fp")
    often = met.where(F.col("m") > FREQUENT).withColumns({"band": F.shiftright("tag", 12), "left": F.col("tag").bitwiseAND(4095) - 1})
    by_count = Window.partitionBy("fp", "band").orderBy(F.desc("m"), "sig")
    kept = seldom.unionByName(often.withColumn("r", F.row_number().over(by_count)).where("r > left").select("sig", "fp"))
    centre = met.groupBy("fp").agg(F.sum("m").alias("w"))
    best = kept.join(centre, "fp").groupBy("sig").agg(F.max(F.struct("w", "fp")).alias("p"), F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("sig", F.col("p.fp").alias("pivot"))
    return kept.join(best, "sig").select("sig", "fp", "pivot")


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard >= percent/100)."""
    return classes(docs, words, percent).drop("fp")


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """As jaccard_classes(), with the fingerprint of each row's set besides."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prof = stage(profiles(docs, words), "jaccard-profiles")
    bucket = Window.partitionBy("sig")
    pivot = postings(docs, words, percent).withColumns({"pivot": F.min("fp").over(bucket), "far": F.max("fp").over(bucket), "m": F.count("*").over(bucket)})
    met = stage(pivot.where("pivot <> far").groupBy("sig", "fp").agg(F.first("pivot").alias("pivot"), F.first("m").alias("m"), F.min("tag").alias("tag")), "jaccard-met")
    # Keys that many sets share are left out by sets that still may leave out as many segments; see `buckets`.
    every, met = met, stage(buckets(met), "jaccard-buckets")
    dropped(every)
    rep = prof.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    base = prof.select("doc_id", F.col("n").alias("n_shingles"), "fp")
    if met.isEmpty():
        comp = rep.select("fp", F.col("rep").alias("component_id"))
    else:
        reps = stage(rep, "jaccard-reps")
        asked = reps.join(met.select("fp").distinct(), "fp")
        drawn = prof.join(asked.where("rep is not null").select(F.col("rep").alias("doc_id"), F.col("fp").alias("of")), "doc_id").where("fp = of")
        # Sets that only rows without an id hold are known by their fingerprint.
        nameless = asked.where("rep is null").select("fp")
        drawn = drawn.select("fp", "doc_id", "n", "sketch").unionByName(prof.where("doc_id is null").join(nameless.hint("merge"), "fp", "left_semi").select("fp", "doc_id", "n", "sketch"))
        known = stage(drawn.dropDuplicates(["fp"]), "jaccard-sketches")

        def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for t in f["text"]:  # a row at a time: what is held follows the longest text, not the batch
                    s = next(text_sets([t], words))
                    yield pd.DataFrame({"fp": [fingerprint(s)], "n": [len(s)], "items": [s.tobytes()]})

        # Merged at every size: small tables of ids would else be broadcast, and costs jump where they stop being small.
        drawn = docs.join(known.select("doc_id").where("doc_id is not null").distinct().hint("merge"), "doc_id", "left_semi")
        sets = drawn.mapInPandas(of, "fp long, n long, items binary")
        if not nameless.isEmpty():
            more = docs.where("doc_id is null and length(text) > 0").mapInPandas(of, "fp long, n long, items binary").where("n > 0")
            sets = sets.unionByName(more.join(nameless.hint("merge"), "fp", "left_semi").dropDuplicates(["fp"]))
        sets = stage(sets, "jaccard-sets")
        # First each set against its buckets' pivots: that joins most of what belongs together.
        first = met.where("fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct()
        first = stage(hopeful(first, known, percent), "jaccard-first")
        seen = stage(links(first, sets, percent), "jaccard-links")
        edges = seen.where("linked").select("a", "b")
        label = components(edges)
        # Then, in buckets that still hold members of several components, those outside the most frequent
        # component against all others; pairs that their sketches rule out are left out.
        placed = met.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        tops = placed.groupBy("sig", "comp").count().groupBy("sig").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("k")).where("k > 1")
        apart = stage(placed.join(tops, "sig").select("sig", "fp", "comp", "main", "size"), "jaccard-apart")
        x, y = apart.where(F.col("size") <= SMALL).where("comp <> main").alias("x"), apart.where(F.col("size") <= SMALL).alias("y")
        few = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") != F.col("y.comp")))
        few = hopeful(few.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct(), known, percent)
        many = across(apart.where(F.col("size") > SMALL).join(known.select("fp", "n", "sketch"), "fp"), percent)
        both_ways = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = few.unionByName(many).distinct().join(both_ways, ["a", "b"], "left_anti")
        more = stage(more, "jaccard-more")
        if not more.isEmpty():
            edges = stage(edges.unionByName(links(more, sets, percent).where("linked").select("a", "b")), "jaccard-edges")
            label = components(edges)
        named = reps.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        lowest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        comp = named.select("fp", "comp").join(lowest, "comp").select("fp", "component_id")
    out = base.join(stage(comp, "jaccard-classes"), "fp", "left")
    # A text without words has no class; it stands alone.
    return out.select("doc_id", "fp", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, of its smallest id; columns as they come.

    Rows whose set is empty and rows without an id stay. Where an id stands on several rows, each row is judged by
    its own text: of a class's rows of the smallest id, the one of the smallest fingerprint stays, and of rows of
    equal sets any one."""
    cls = stage(classes(docs, words, percent).where("doc_id is not null"), "jaccard-verdicts")
    verdict = cls.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("component_id") < F.col("doc_id")).alias("gone"))
    verdict = verdict.where("rows > 1 or gone").select(F.col("doc_id").alias("__id"), (F.col("rows") > 1).alias("__several"))
    judged = docs.join(verdict, docs["doc_id"].cast("long") == verdict["__id"], "left")
    kept = judged.where("__id is null").drop("__id", "__several")
    if verdict.where("__several").isEmpty():
        return kept

    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(s) if len(s) else 0 for s in text_sets(texts.tolist(), words)], dtype="int64")

    chosen = cls.where("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").agg(F.min("fp").alias("__fp"))
    chosen = chosen.unionByName(cls.where("n_shingles = 0").select("doc_id", F.lit(0).cast("long").alias("__fp")).distinct()).withColumnRenamed("doc_id", "__own")
    several = judged.where("__several").withColumn("__mark", mark(F.col("text").cast("string")))
    several = several.join(chosen, (several["__id"] == chosen["__own"]) & (several["__mark"] == chosen["__fp"]))
    first = F.row_number().over(Window.partitionBy("__id", "__mark").orderBy(F.lit(0)))
    several = several.withColumn("__first", first).where("__mark = 0 or __first = 1")
    return kept.unionByName(several.drop("__id", "__several", "__mark", "__own", "__fp", "__first"))
