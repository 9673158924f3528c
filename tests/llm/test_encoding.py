"""Target encoding against a plain reading of its definition."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import encoding

T0 = dt.datetime(2024, 1, 1)
LINES = "sale_id long, item_id long, vendor_id long, flag string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz"


def brute(lines, sales, kinds, nations, segments):
    own = {}
    for sale, client, at in sales:
        if sale is not None and at is not None:
            key = (at, -1 if client is None else client)
            own[sale] = min(own.get(sale, key), key)
    rows = []
    for sale, item, vendor, flag in lines:
        if sale in own:
            at, client = own[sale]
            item = -1 if item is None else item
            keys = {"all": 0, "kind": kinds.get(item), "nation": nations.get(vendor), "segment": segments.get(client), "item": item, "vendor": vendor, "client": client}
            rows.append((sale, item, vendor, at, zlib.crc32(str(sale).encode()) % 5, int(flag == "returned"), keys))
    out = {}
    for sale, item, vendor, at, fold, r, keys in rows:
        if (sale, item, vendor) in out:
            out[sale, item, vendor][:2] = [out[sale, item, vendor][0] + 1, out[sale, item, vendor][1] + r]
            continue
        rates, row = {}, [1, r]
        for x, prior in encoding.LEVELS.items():
            past = [y[5] for y in rows if y[4] != fold and y[3] < at and y[6][x] == keys[x]]
            p = rates.get(prior, 500_000)
            rates[x] = (1_000_000 * sum(past) + 50 * p) // (len(past) + 50) if past else p
            if x in ("item", "vendor", "client"):
                row += [len(past), rates[x]]
        out[sale, item, vendor] = row
    return {(*k, *v) for k, v in out.items()}


def tables(spark, lines, sales, kinds, nations, segments):
    pairs = lambda d, a, b, t: spark.createDataFrame(list(d.items()), f"{a} long, {b} {t}")
    return (
        spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(sales, SALES), pairs(kinds, "item_id", "kind", "string"),
        pairs(nations, "vendor_id", "nation_id", "int"), pairs(segments, "client_id", "segment", "string"),
    )


def shown(df):
    columns = ["sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate"]
    return {tuple(r) for r in df.select(*columns).collect()}


def data(seed):
    r = random.Random(seed)
    sales = [(k if k else None, r.choice([None, 1, 1, 2, 3, 99]), None if r.random() < 0.05 else T0 + dt.timedelta(seconds=r.choice([0, 0, 1, 5, r.randint(0, 60)]), microseconds=r.choice([0, 0, 1, 999_999]))) for k in range(60)]
    sales += sales[5:8] + [(9, 1, T0)]
    lines = [(r.choice([7, r.randint(1, 65), None]), r.choice([None, 1, 1, 2, 3, 50]), r.choice([None, 1, 1, 2, 40]), r.choice(["returned", "kept", None])) for _ in range(500)]
    lines += lines[:20]
    return lines, sales, {1: "a", 2: None, 3: "n", -1: "x"}, {1: 4, 2: None, 3: 0}, {1: "retail", 2: "v", 3: None}


@pytest.mark.parametrize(("seed", "chunk", "share"), [(1, 1 << 17, 1024), (2, 7, 10), (3, 16, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, share):
    monkeypatch.setattr(encoding, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(encoding, "SHARE", share)
    d = data(seed)
    assert shown(encoding.encoded(*tables(spark, *d))) == brute(*d)


def test_counts_carry_over_many_tasks(spark, monkeypatch):
    """One key over more tasks than a byte of their number has bits."""
    monkeypatch.setattr(encoding, "CHUNK_ROWS", 8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "21")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = [(k, 1, 1, "returned" if k % 3 else "kept") for k in range(1, 400)]
        sales = [(k, 1, T0 + dt.timedelta(seconds=k // 2)) for k in range(1, 400)]
        d = (lines, sales, {1: "a"}, {1: 1}, {1: "s"})
        assert shown(encoding.encoded(*tables(spark, *d))) == brute(*d)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    lines, sales, kinds, nations, segments = tables(spark, [(1, None, None, None)], [(1, None, T0), (2, 1, None)], {}, {}, {})
    clash = {c: F.lit("clash") for c in ("ts", "fold", "key", "level", "row", "n", "kind_n")}
    got = encoding.encoded(*(t.withColumns(clash) for t in (lines, sales, kinds, nations, segments)))
    assert shown(got) == {(1, -1, None, 1, 0, 0, 500_000, 0, 500_000, 0, 500_000)}
    assert encoding.encoded(lines.limit(0), sales, kinds, nations, segments).count() == 0
    assert encoding.encoded(lines, sales.limit(0), kinds, nations, segments).count() == 0
    one = spark.range(1)
    at = one.select(encoding.micros(F.expr("timestamp_ntz'1969-12-31 23:59:59.999999'")).alias("a"), encoding.micros(F.expr("timestamp_ntz'2024-03-31 02:30:00.000001'")).alias("b")).first()
    assert (at.a, at.b) == (-1, 1_711_852_200_000_001)
