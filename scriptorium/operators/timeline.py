"""Timelines: prefix sums, proportional sentences, word alignment, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def timeline(segments: DataFrame, silence: float = 0.288, scope: str = "doc_id", order: str = "seg_pos") -> DataFrame:
    """start_sec and end_sec of each segment: durations and silences before it; none after the last."""
    run = Window.partitionBy(scope).orderBy(order)
    start = F.coalesce(F.sum(F.col("duration_sec") + F.lit(silence)).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = segments.withColumn("start", start)
    return rows.withColumns({"start_sec": F.round("start", 3), "end_sec": F.round(F.col("start") + F.col("duration_sec"), 3)}).drop("start")


def web_timeline(segments: DataFrame, scope: str = "doc_id", order: str = "seg_pos", fallback: float | None = None) -> DataFrame:
    """The browser's timeline: a failed or blank segment takes no time, no silences; without audio, a fixed length each."""
    length = F.lit(fallback) if fallback is not None else F.coalesce("duration_sec", F.lit(0.0))
    run = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("__d", length)
    start = F.coalesce(F.sum("__d").over(run), F.lit(0.0))
    return rows.withColumn("start_sec", F.round(start, 3)).withColumn("end_sec", F.round(start + F.col("__d"), 3)).drop("__d")


def proportional(rows: DataFrame, key: str, text: str, total: str) -> DataFrame:
    """(key, ord, sentence, start, end, duration): sentences share the time by length; the last takes what is left."""
    parts = T.zh_sentences(F.col(text))
    whole = F.when(F.size(parts) > 0, parts).when(F.length(F.trim(text)) > 0, F.array(F.col(text))).otherwise(F.array().cast("array<string>"))
    out = rows.select(key, F.col(total).alias("__t"), F.posexplode(whole).alias("ord", "sentence")).withColumn("__n", F.length("sentence"))
    per, run = Window.partitionBy(key), Window.partitionBy(key).orderBy("ord")
    out = out.withColumns({"__all": F.greatest(F.sum("__n").over(per), F.lit(1)), "__last": F.lead("ord").over(run).isNull()})
    out = out.withColumn("__d", F.greatest(F.lit(0.05), F.col("__t") * F.col("__n") / F.col("__all")))
    out = out.withColumn("__s", F.coalesce(F.sum("__d").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("__d", F.when(F.col("__last"), F.greatest(F.lit(0.05), F.col("__t") - F.col("__s"))).otherwise(F.col("__d")))
    return out.select(key, "ord", "sentence", F.round("__s", 3).alias("start"), F.round(F.col("__s") + F.col("__d"), 3).alias("end"), F.round("__d", 3).alias("duration"))


def char_offsets(rows: DataFrame, key: str, order: str = "ord", text: str = "sentence") -> DataFrame:
    """Character offsets of sentences within their script."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(run), F.lit(0))
    return rows.withColumn("char_start", start.cast("int")).withColumn("char_end", (start + F.length(text)).cast("int"))


def align_sentences(raw_text: Column, spoken: Column) -> Column:
    """The raw sentences with the speech's times where there are as many, else the speech's own. `spoken`: array<struct<text, start, end>>."""
    raw = T.zh_sentences(raw_text)
    zipped = F.transform(spoken, lambda s, i: F.struct(F.get(raw, i).alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when((F.size(raw) == F.size(spoken)) & (F.length(raw_text) > 0), zipped).otherwise(spoken)


def sentence_times(zh: DataFrame, script: DataFrame, segments: DataFrame) -> DataFrame:
    """Times of translated sentences: those of the script's sentence of the same number, else a share of the segment by length.

    zh(sid, ord, sentence), script(sid, ord, start_sec, end_sec), segments(sid, start_sec, duration_sec)."""
    run = Window.partitionBy("sid").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = zh.withColumns({"__b": F.coalesce(F.sum(F.length("sentence")).over(run), F.lit(0)), "__all": F.greatest(F.sum(F.length("sentence")).over(Window.partitionBy("sid")), F.lit(1))})
    rows = rows.join(script.select("sid", "ord", F.col("start_sec").alias("__s"), F.col("end_sec").alias("__e")), ["sid", "ord"], "left")
    rows = rows.join(segments.select("sid", F.col("start_sec").alias("__seg"), F.coalesce("duration_sec", F.lit(6.0)).alias("__dur")), "sid")
    share = F.col("__seg") + F.col("__dur") * F.col("__b") / F.col("__all")
    start = F.coalesce("__s", share)
    end = F.when(F.col("__s").isNotNull(), F.coalesce("__e", F.col("__s") + 3)).otherwise(share + F.col("__dur") * F.length("sentence") / F.col("__all"))
    return rows.select("sid", "ord", "sentence", F.round(start, 2).alias("start_sec"), F.round(end, 2).alias("end_sec"))


def corresponding(e: Column, n_en: Column, n_zh: Column) -> Column:
    """The number of the translated sentence for an English one: the same, or in proportion."""
    return F.when(n_zh <= 0, e).when(n_en == n_zh, e).otherwise(F.least(F.floor(e * n_zh / n_en).cast("int"), (n_zh - 1).cast("int")))


def locate_words(words: Column, text: Column) -> Column:
    """array<struct<word, s, e>>: each word's place, searched from the end of the one before; words not found are left out."""
    empty = F.array().cast("array<struct<word:string,s:int,e:int>>")

    def step(acc: Column, w: Column) -> Column:
        at = F.call_function("locate", w, text, acc["at"] + 1) - 1
        found = at >= 0
        return F.struct(F.when(found, at + F.length(w)).otherwise(acc["at"]).alias("at"), F.when(found, F.concat(acc["out"], F.array(F.struct(w.alias("word"), at.alias("s"), (at + F.length(w)).alias("e"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(words, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def words_to_sentences(words: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """Sentence times from word times by overlap of character intervals; a sentence without words follows the one before.

    words(key, s, e, start, end), sentences(key, ord, char_start, char_end)."""
    w, s = words.alias("w"), sentences.alias("s")
    overlap = ((F.col("w.s") >= F.col("s.char_start")) & (F.col("w.s") < F.col("s.char_end"))) | ((F.col("w.e") > F.col("s.char_start")) & (F.col("w.e") <= F.col("s.char_end")))
    got = s.join(w, (F.col(f"s.{key}") == F.col(f"w.{key}")) & overlap, "left").groupBy(F.col(f"s.{key}").alias(key), F.col("s.ord").alias("ord")).agg(F.min("w.start").alias("start"), F.max("w.end").alias("end"))
    run = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("end", ignorenulls=True).over(run), F.lit(0.0))
    return got.withColumns({"start": F.coalesce("start", before), "end": F.coalesce("end", before)})


def smoothed(spans: Column, total: Column) -> Column:
    """Contiguous spans: a gap extends the earlier one, an overlap moves the later one; the first starts at 0, the last ends at the total.

    `spans`: array<struct<start, end>> in order."""
    n = F.size(spans)

    def step(acc: Column, x: Column) -> Column:
        start = F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(F.element_at(acc, -1)["end"])
        return F.concat(acc, F.array(F.struct(start.cast("double").alias("start"), F.greatest(start, x["end"]).cast("double").alias("end"))))

    nexts = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.when(i == n - 1, total).otherwise(F.greatest(s["end"], F.get(spans, i + 1)["start"])).alias("end")))
    return F.aggregate(nexts, F.array().cast("array<struct<start:double,end:double>>"), step)


def active_at(times: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The first span that holds each moment: times(key, t) against spans(key, ord, start_sec, end_sec).

    Spans and moments meet by key and by second, so that the range is checked inside small groups."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor("start_sec").cast("long"), F.floor("end_sec").cast("long"))))
    t = times.withColumn("cell", F.floor("t").cast("long"))
    got = t.join(cells, [key, "cell"]).where("t >= start_sec and t <= end_sec")
    return got.groupBy(key, "t").agg(F.min("ord").alias("ord"))
