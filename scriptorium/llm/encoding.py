"""Time-ordered target encoding: rates of returned lines by item, vendor and client, from earlier lines of other folds.

All seven levels (everything, kind, nation, segment, item, vendor, client) are unpivoted into one long table of
level, key, time and fold, dealt by key and sorted by time: its rows hold what happened and what is asked at once.
One pass reads a task's rows in chunks; probes of one key, time and fold are one there and are answered by
`pandas.merge_asof` on running counts, strictly before their time, once for all folds and once for their own, which is
taken off. The counts are pivoted back by row; rates follow from them.

Hot keys hold more than one in `SHARE` of a table's rows: fewer than SHARE of them, whatever its size. Only they and
up to SHARE points of time are ever broadcast. A hot key's rows are dealt by SHARE spans of time, each of which opens
with the counts of those before it (sums by span, not rows). Rows of a hot point of time are added up before they
are dealt, and their answers meet them again by an equi-join, salted where a probe is hot. Joins on hot ids are salted.
No group is collected anywhere.

Lines without a sale, and sales without an id or a time, are left out; a null item or client is the ordinary id
-1, a null vendor an id of its own. Equal lines count each. Of rows that repeat a sale's id the earliest counts, then the one of
the smallest client; of rows that repeat an item's, vendor's or client's id the greatest value. A null flag is not
`returned`. Ties in time see nothing of each other. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import dropped, importable, stage

FOLDS = 5
#: A key of more than one in SHARE rows is hot and dealt over SALTS tasks, or SHARE spans of time.
SHARE, SALTS = 1024, 64
#: Rows of a task that are answered in one go.
CHUNK_ROWS = 1 << 17
PRIOR, WEIGHT = 500_000, 50
#: The levels, and that whose rate is a level's prior.
LEVELS = {"all": None, "kind": "all", "nation": "all", "segment": "all", "item": "kind", "vendor": "nation", "client": "segment"}
#: Levels that a sale fixes are asked once for it, the others for each of its items and vendors.
OF_SALE = ("all", "segment", "client")
#: Each level's column; the codes of a null value and of others are told apart by NULL.
COLUMN = {"kind": "kind", "nation": "nation_id", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
NULL = 16
#: A key's rows in one span (`part` holds level and span), and its probes; `tf` holds time and fold.
KEY, PROBE = ["key", "part"], ["key", "level", "tf"]
#: m: how many rows ask (deduplicated probes), ASKS for a row's own probe, OPENS for counts that are no probe.
ASKS, OPENS = -1, 0
ANSWER = "level byte, key long, tf long, n long, s long, row long, m long"


def fold_of(sale_id: Column, folds: int = FOLDS) -> Column:
    return (F.crc32(sale_id.cast("string")) % folds).cast("int")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time as it is written, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return day * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + second


def hot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold more than one in SHARE of the rows: fewer than SHARE rows, whatever the table's size."""
    return above(rows.groupBy(*keys).agg(F.count("*").alias("count")), keys, "count")


def above(counted: DataFrame, keys: list[str], count: str) -> DataFrame:
    """As hot(), of keys whose rows are counted already."""
    total = counted.agg(F.sum(count).alias("__total"))
    return counted.join(F.broadcast(total), F.col(count) * SHARE > F.col("__total")).select(*keys)


def met(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], many: DataFrame, how: str = "left") -> DataFrame:
    """An equi-join whose hot keys on the left, `many`, are dealt by `spread` over SALTS tasks; the right has one row a key."""
    many = F.broadcast(many.withColumn("__hot", F.lit(True)))
    # No side but the hot keys is ever broadcast; the right's keys are unique, so that its parts are even and no side need be sorted.
    apart = F.coalesce("__hot", F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys]))
    left = left.join(many, keys, "left").withColumn("__salt", F.when(apart, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(many, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right.hint("shuffle_hash"), [*keys, "__salt"], how).drop("__salt")


def of_id(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value), one row an id."""
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.max(value).alias(value))


def coded(table: DataFrame, value: str) -> DataFrame:
    """The table with a 64-bit code in the place of a value: of the first seed under which no two values share one."""
    for seed in range(64):
        code = F.xxhash64(F.lit(seed), F.col(value).cast("string"))
        shared = table.where(F.col(value).isNotNull()).groupBy(code.alias("code")).agg(F.min(F.col(value).cast("string")).alias("a"), F.max(F.col(value).cast("string")).alias("z")).where("a <> z")
        if shared.isEmpty():
            return table.withColumn(value, F.when(F.col(value).isNotNull(), code))
    raise ArithmeticError(f"no seed tells the values of {value} apart")


def place(level: str, value: str | None) -> Column:
    """struct(level, key) of a value at a level; null values have a level of their own."""
    k = list(LEVELS).index(level)
    if value is None:
        return F.struct(F.lit(k).cast("byte").alias("level"), F.lit(0).cast("long").alias("key"))
    v = F.col(value)
    return F.struct(F.when(v.isNull(), k + NULL).otherwise(k).cast("byte").alias("level"), F.coalesce(v.cast("long"), F.lit(0)).alias("key"))


def spans_of(ts: Column, bounds: list[int]) -> Column:
    """The span of time that a point lies in."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(), side="right"), dtype="int32")

    return of(ts)


def lines_of(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hot, hot_sales): one row per sale, item and vendor with its lines, time, fold and the keys of all levels; the hot (level, key)."""
    returned = F.coalesce(F.col("flag") == "returned", F.lit(False)).cast("long")
    item, vendor = F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id")
    own = lines.where("sale_id is not null").groupBy(F.col("sale_id").cast("long").alias("sale_id"), item, vendor)
    own = stage(own.agg(F.count("*").alias("n_lines"), F.sum(returned).alias("n_returned")), "encoding-own")
    when = sales.where("sale_id is not null and sold_at is not null").select(F.col("sale_id").cast("long").alias("sale_id"), micros(F.col("sold_at")).alias("ts"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id"))
    when = stage(when.groupBy("sale_id").agg(F.min(F.struct("ts", "client_id")).alias("x")).select("sale_id", "x.ts", "x.client_id"), "encoding-sales")
    tables = {"item": of_id(coded(items, "kind"), "item_id", "kind"), "vendor": of_id(coded(vendors, "nation_id"), "vendor_id", "nation_id"), "client": of_id(coded(clients, "segment"), "client_id", "segment")}
    hot_ids, levels_hot = {}, [when.sparkSession.range(1).select(place("all", None).alias("p")).select("p.*")]
    for level, rows in (("item", own), ("vendor", own), ("client", when)):
        c, up = COLUMN[level], LEVELS[level]
        count = stage(rows.groupBy(c).agg(F.count("*").alias("count")), "encoding-counts")
        hot_ids[level] = stage(above(count, [c], "count"), "encoding-hot")
        levels_hot.append(hot_ids[level].select(place(level, c).alias("p")).select("p.*"))
        over = count.join(tables[level].hint("merge"), c, "left").groupBy(COLUMN[up]).agg(F.sum("count").alias("count"))
        levels_hot.append(above(over, [COLUMN[up]], "count").select(place(up, COLUMN[up]).alias("p")).select("p.*"))
    hot_sales = stage(hot(own, ["sale_id"]), "encoding-hot")
    edges = when.agg(F.percentile_approx("ts", [k / SHARE for k in range(1, SHARE)], 100 * SHARE)).first()[0]
    when = when.withColumn("span", spans_of(F.col("ts"), sorted(set(edges or ()))))
    when = met(when, tables["client"], ["client_id"], ["sale_id"], hot_ids["client"])
    rows = met(own, tables["item"], ["item_id"], ["sale_id", "vendor_id"], hot_ids["item"])
    rows = met(rows, tables["vendor"], ["vendor_id"], ["sale_id", "item_id"], hot_ids["vendor"])
    rows = met(rows, when, ["sale_id"], ["item_id", "vendor_id"], hot_sales, "inner")
    out = stage(rows.withColumns({"fold": fold_of(F.col("sale_id")), "row": F.monotonically_increasing_id()}), "encoding-rows")
    every = stage(reduce(DataFrame.unionByName, levels_hot), "encoding-hot")
    dropped(own)
    return out, every, hot_sales


def unpivoted(rows: DataFrame, hot_keys: DataFrame) -> DataFrame:
    """(level, key, part, tf, n, s, row): a row per line and level, or per sale and level; `row` is the line's number or the sale's id."""
    columns = ["tf", "span", "n", "s", "row"]

    def over(table: DataFrame, names: list[str]) -> DataFrame:
        table = table.withColumn("tf", timed(F.col("ts"), F.col("fold")))
        return table.select(F.explode(F.array(*[place(x, COLUMN.get(x)) for x in names])).alias("p"), *columns).select("p.*", *columns)

    of_line = rows.withColumns({"n": F.col("n_lines"), "s": F.col("n_returned")})
    of_sale = rows.groupBy("sale_id", "client_id", "segment", "ts", "fold", "span").agg(F.sum("n_lines").alias("n"), F.sum("n_returned").alias("s")).withColumn("row", F.col("sale_id"))
    long = over(of_line, [x for x in LEVELS if x not in OF_SALE]).unionByName(over(of_sale, list(OF_SALE)))
    long = long.join(F.broadcast(hot_keys.withColumn("hot", F.lit(True))), ["level", "key"], "left")
    return long.withColumn("part", parted(F.col("level"), F.when(F.col("hot"), F.col("span")).otherwise(-1))).drop("hot", "span")


def timed(ts: Column, fold: Column) -> Column:
    return (ts * 8 + fold).cast("long")


def parted(level: Column, span: Column) -> Column:
    return ((span + 1) * (2 * NULL) + level).cast("int")


def openings(rows: DataFrame, hot_keys: DataFrame, folds: int) -> DataFrame:
    """Counts by fold with which each span of a hot key opens: at most SHARE spans a key. Each level is one narrow scan: rows of other keys go first."""
    hot_keys, parts = F.broadcast(hot_keys), []
    for x in LEVELS:
        own = rows.select(place(x, COLUMN.get(x)).alias("p"), "span", "fold", "n_lines", "n_returned")
        parts.append(own.select("p.*", "span", "fold", "n_lines", "n_returned").join(hot_keys, ["level", "key"], "left_semi"))
    cells = reduce(DataFrame.unionByName, parts).groupBy("level", "key", "span", "fold").agg(F.sum("n_lines").alias("n"), F.sum("n_returned").alias("s"))
    cells = stage(cells, "encoding-cells")
    each = cells.select("level", "key", "span").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    cells = each.join(cells.hint("merge"), ["level", "key", "span", "fold"], "left")
    before = Window.partitionBy("level", "key", "fold").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    got = cells.select("level", "key", "span", "fold", F.sum("n").over(before).alias("n"), F.sum("s").over(before).alias("s")).where("n > 0")
    return got.withColumns({"part": parted(F.col("level"), F.col("span")), "tf": timed(F.lit(FIRST), F.col("fold")), "row": F.lit(0).cast("long"), "m": F.lit(OPENS).cast("long")})


#: Before any time.
FIRST = -(1 << 59)


def before(run: np.ndarray, ts: np.ndarray, fold: np.ndarray, n: np.ndarray, s: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of other folds strictly before each row of distinct (run, ts, fold), in this order."""
    code = np.concatenate((run * (folds + 1) + fold, run * (folds + 1) + folds))
    events = pd.DataFrame({"ts": np.tile(ts, 2), "code": code, "n": np.tile(n, 2), "s": np.tile(s, 2)})
    # Rows of all folds at one time follow one another: the last of them holds the running count.
    events[["n", "s"]] = events.groupby("code", sort=False)[["n", "s"]].cumsum()
    order = np.argsort(events["ts"].to_numpy(), kind="stable")
    laid = events.iloc[order]
    got = pd.merge_asof(laid[["ts", "code"]], laid, on="ts", by="code", allow_exact_matches=False)
    known = np.zeros((len(events), 2), dtype=np.int64)
    known[order] = got[["n", "s"]].fillna(0).to_numpy(dtype=np.int64)
    other = known[len(run) :] - known[: len(run)]
    return other[:, 0], other[:, 1]


def answered(table: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The pass over the table, dealt by key and span and sorted by time: ANSWER rows for all that ask."""
    columns = [*KEY, "tf", "n", "s", "row", "m"]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = iter(frames)
        last: pd.DataFrame | None = None
        while True:
            held, size = [], 0
            while size < CHUNK_ROWS and (nxt := next(frames, None)) is not None:
                held.append(nxt)
                size += len(nxt)
            if not size:
                return
            # What the last key has counted so far stands in front: before its last time, and at it.
            f = pd.concat(held if last is None else [last, *held], ignore_index=True)
            key, part, tf, m = (f[c].to_numpy() for c in (*KEY, "tf", "m"))
            new = np.ones(len(f), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            run = np.cumsum(new) - 1
            # Probes of one time and fold are one.
            new[1:] |= tf[1:] != tf[:-1]
            at = np.flatnonzero(new)
            n, s = np.add.reduceat(f["n"].to_numpy(), at), np.add.reduceat(f["s"].to_numpy(), at)
            got_n, got_s = before(run[at], tf[at] >> 3, tf[at] & 7, n, s, folds)
            back = np.cumsum(new) - 1
            asks, alone = m != OPENS, m == ASKS
            out = {"level": (part % (2 * NULL)).astype(np.int8), "key": np.where(alone, 0, key), "tf": np.where(alone, 0, tf), "n": got_n[back], "s": got_s[back], "row": f["row"].to_numpy(), "m": m}
            yield pd.DataFrame({c: v[asks] for c, v in out.items()})
            end = run == run[-1]
            past = (tf[end] >> 3) < (tf[-1] >> 3)
            last = f[end].assign(tf=np.where(past, FIRST * 8 + (tf[end] & 7), tf[end]), row=0, m=OPENS).groupby([*KEY, "tf"], as_index=False)[["n", "s", "row", "m"]].sum()[columns]
            last = last.astype(f.dtypes.to_dict())

    laid = table.select(*columns).repartition(*KEY).sortWithinPartitions(*KEY, "tf")
    return stage(laid.mapInPandas(of, ANSWER), "encoding-answers")


def rate(n: Column, s: Column, prior: Column) -> Column:
    """Returned lines in a million, drawn towards the prior as by WEIGHT lines, in whole numbers."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", 1_000_000 * s + WEIGHT * prior, n + WEIGHT))


def histories(rows: DataFrame, hot_keys: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(row, level, n, s): the lines and returned lines of each probe's history."""
    # Points of time that hold many rows: their probes are one before they are dealt.
    times = F.broadcast(stage(hot(rows, ["ts"]), "encoding-times"))
    alone = unpivoted(rows.join(times, "ts", "left_anti"), hot_keys).withColumn("m", F.lit(ASKS).cast("long"))
    many = unpivoted(rows.join(times, "ts", "left_semi"), hot_keys)
    one = many.groupBy(*PROBE, "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("m")).withColumn("row", F.lit(0).cast("long"))
    opens = openings(rows, hot_keys, folds)
    columns = [*KEY, "tf", "n", "s", "row", "m"]
    answers = answered(alone.select(*columns).unionByName(one.select(*columns)).unionByName(opens.select(*columns)), folds)
    known = answers.where(F.col("m") > 0).select(*PROBE, "n", "s", "m")
    found = met(many.select(*PROBE, "row"), known.drop("m"), PROBE, ["row"], above(known.select(*PROBE, "m"), PROBE, "m"))
    columns = ["row", F.col("level").bitwiseAND(NULL - 1).alias("level"), "n", "s"]
    return answers.where(F.col("m") == ASKS).select(*columns).unionByName(found.select(*columns))


def pivoted(found: DataFrame, names: list[str]) -> DataFrame:
    """One row per `row` with n and s of each of the levels."""
    number = {x: k for k, x in enumerate(LEVELS)}
    # Laid by row before it is grouped: partial groups would be wider than what they stand for.
    got = found.where(F.col("level").isin([number[x] for x in names])).repartition("row").groupBy("row")
    return got.agg(*[F.max(F.when(F.col("level") == number[x], F.col(c))).alias(f"{x}_{c}") for x in names for c in ("n", "s")])


def encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """One row per sale_id, item_id and vendor_id: n_lines, n_returned, client_id, fold, and n, s and rate of each level's history."""
    importable(lines.sparkSession)
    rows, hot_keys, hot_sales = lines_of(lines, sales, items, vendors, clients)
    found = histories(rows, hot_keys)
    of_sale = pivoted(found, list(OF_SALE)).withColumnRenamed("row", "sale_id")
    out = rows.drop("kind", "nation_id", "segment", "ts", "span").join(pivoted(found, [x for x in LEVELS if x not in OF_SALE]).hint("shuffle_hash"), "row")
    out = met(out, of_sale, ["sale_id"], ["row"], hot_sales)
    for x, prior in LEVELS.items():
        p = F.lit(PRIOR).cast("long") if prior is None else F.col(f"{prior}_rate")
        out = out.withColumn(f"{x}_rate", rate(F.col(f"{x}_n"), F.col(f"{x}_s"), p))
    return out.drop("row")
