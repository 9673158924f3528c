"""Streams: incremental merge, late rows, sentence boundaries, playback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators import feed
from scriptorium.sinks import render


def unseen(stream: DataFrame, key: str, event_time: str, lateness: str = "30 days") -> DataFrame:
    """First sights of a key within the lateness: a look-back window far wider than the polling interval recovers missed runs, duplicates vanish."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def merge_into(stream: DataFrame, root: str, emit: Callable[[DataFrame, int], None], checkpoint: str, today: str) -> StreamingQuery:
    """Each micro-batch is merged into the keyed store at `root` as the version of its number; then its new rows are emitted.

    What is emitted is read from the versions on disk: rows that this one has and the one before has not. A batch that runs
    again after a crash replaces its own version and emits the same rows under the same number."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = render.load_store(spark, root, feed.ITEM, below=number)
        render.write_store(feed.upsert(before, rows, today)[0], root, "pmid", number)
        written = render.load_store(spark, root, feed.ITEM, below=number + 1)
        emit(written.join(before.select("pmid"), "pmid", "left_anti"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sentences(boundaries: DataFrame) -> DataFrame:
    """(sid, n, speech_sec, text): sentence boundaries (ticks of 100 ns) per segment; a streaming aggregation, or a batch one."""
    rows = boundaries.where("type = 'SentenceBoundary'")
    return rows.groupBy("sid").agg(F.count("*").alias("n"), F.max((F.col("offset") + F.col("duration")) / 1e7).alias("speech_sec"), F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("parts"))


def playing(moments: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Moments of a stream with the spans that hold them: a stream-static range join by key and second."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor("start_sec").cast("long"), F.floor("end_sec").cast("long"))))
    return moments.withColumn("cell", F.floor("t").cast("long")).join(cells, [key, "cell"]).where("t >= start_sec and t <= end_sec").drop("cell")


def playback(moments: DataFrame, spans: DataFrame, key: str, lateness: str = "30 seconds", longest: str = "1 hour") -> DataFrame:
    """Moments of one stream with the spans of another that hold them: an interval join of two streams.

    moments(key, at) and spans(key, ord, starts, ends) are timestamps, late by `lateness` at most; no span is longer than `longest`, so that
    the state of both is bounded. Repeated moments and spans count once. A moment that no span holds gives one row without a span."""
    m = moments.withWatermark("at", lateness).dropDuplicatesWithinWatermark([key, "at"]).alias("m")
    s = spans.withWatermark("starts", lateness).dropDuplicatesWithinWatermark([key, "ord", "starts"]).alias("s")
    test = (F.col(f"m.{key}") == F.col(f"s.{key}")) & (F.col("m.at") >= F.col("s.starts")) & (F.col("m.at") <= F.col("s.ends"))
    test = test & (F.col("m.at") <= F.col("s.starts") + F.expr(f"interval {longest}"))
    return m.join(s, test, "left_outer").select(f"m.{key}", "m.at", "s.ord", "s.starts", "s.ends")
