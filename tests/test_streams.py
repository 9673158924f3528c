"""Streams against their batch forms: states of items, playback."""

import datetime as dt

from pyspark.sql import functions as F

from scriptorium.operators import timeline as M
from scriptorium.streaming import feed, status

T0 = dt.datetime(2024, 1, 1)


def in_batches(spark, path, batches, schema):
    """A stream of one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{k:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(str(path))


def drained(stream, name, checkpoint, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_states_of_items(spark, tmp_path):
    day = [
        [("1", "new", None, at(0)), ("2", "new", None, at(1)), ("9", "shown", "s1", at(1)), ("3", "new", None, at(2))],
        [("1", "shown", "s1", at(24)), ("2", "shown", "s1", at(24)), ("1", "new", None, at(25)), ("1", "shown", "s1", at(24))],
        [("1", "picked", None, at(48)), ("2", "new", None, at(47)), ("1", "shown", "s2", at(49)), ("2", "shown", "s2", at(48))],
        [("1", "done", None, at(72)), ("1", "lost", None, at(73)), ("2", "picked", None, at(73))],
        [("4", "new", None, at(24 * 40))],
        [("5", "new", None, at(24 * 45))],
    ]
    schema = "pmid string, status string, snapshot string, ts timestamp"
    stream = status.machine(in_batches(spark, tmp_path / "in", day, schema), lateness="1 day", patience_days=30)
    got = drained(stream, "states", tmp_path / "check")
    rows = got.where("asked <> 'timeout'")
    table = spark.createDataFrame([r for b in day for r in b], schema)
    key = lambda r: (r.pmid, r.ts, r.asked, r.status, r.accepted, r.reason, r.shown_in)
    assert sorted(map(key, rows.collect())) == sorted(map(key, status.replayed(table).collect()))
    refused = {(r.pmid, r.asked, r.reason) for r in rows.where("not accepted").collect()}
    assert refused == {("9", "shown", "unknown item"), ("1", "new", "shown to new"), ("2", "new", "shown to new"), ("1", "shown", "picked to shown"), ("1", "lost", "done to lost")}
    assert {(r.pmid, r.status, r.shown_in) for r in status.standing(rows).collect()} == {("1", "done", "s1"), ("2", "picked", "s1|s2"), ("3", "new", ""), ("4", "new", ""), ("5", "new", "")}
    # Item 3 was never shown in 30 days.
    assert [(r.pmid, r.reason) for r in got.where("asked = 'timeout'").collect()] == [("3", "never shown")]


def test_playback_of_two_streams(spark, tmp_path):
    s = lambda sec: T0 + dt.timedelta(seconds=sec)
    spans = [[("a", 1, s(0), s(10)), ("b", 1, s(0), s(5)), ("a", 1, s(0), s(10))], [("a", 2, s(11), s(20))], [("a", 3, s(21), s(30)), ("b", 2, s(6), s(9))], [("z", 1, s(4000), s(4001))], [("z", 2, s(9000), s(9001))]]
    moments = [[("a", s(3)), ("a", s(3)), ("b", s(5.5))], [("a", s(10.5)), ("a", s(12)), ("b", s(7))], [("a", s(20)), ("a", s(25))], [("z", s(4000))], [("z", s(9000))]]
    left = in_batches(spark, tmp_path / "m", moments, "k string, at timestamp")
    right = in_batches(spark, tmp_path / "s", spans, "k string, ord int, starts timestamp, ends timestamp")
    got = drained(feed.playback(left, right, "k", "30 seconds", "1 minute"), "playing_now", tmp_path / "check")
    sec = lambda c: (F.col(c).cast("double") - F.lit(T0.replace(tzinfo=dt.timezone.utc).timestamp())).alias(c)
    rows = {(r.k, r["at"], r.ord) for r in got.select("k", sec("at"), "ord").collect() if r.k != "z"}
    assert rows == {("a", 3.0, 1), ("b", 5.5, None), ("a", 10.5, None), ("a", 12.0, 2), ("b", 7.0, 2), ("a", 20.0, 2), ("a", 25.0, 3)}
    # The batch form finds the same.
    flat = spark.createDataFrame([(k, o, (a - T0).total_seconds(), (z - T0).total_seconds()) for b in spans for k, o, a, z in b], "k string, ord int, start_sec double, end_sec double")
    times = spark.createDataFrame([(k, (t - T0).total_seconds()) for b in moments for k, t in b], "k string, t double").distinct()
    assert {(r.k, r.t, r.ord) for r in M.active_at(times, flat, "k").collect() if r.k != "z"} == {x for x in rows if x[2] is not None}
