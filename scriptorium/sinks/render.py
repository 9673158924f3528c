"""Renderers and writers: Markdown, LRC, WebVTT, nested JSON, snapshots, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

ABSENT = "（未翻译）"


def joined(rows: DataFrame, line: Column, order: list[str], key: str = "doc_id", separator: str = "\n") -> DataFrame:
    """(key, content): a document's lines in order."""
    got = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(got, lambda x: x["__line"]), separator).alias("content"))


def with_heading(rows: DataFrame, body: Column) -> Column:
    """A heading before the body wherever the section changes, one # deeper than its level."""
    change = ~F.col("sec_path").eqNullSafe(F.lag("sec_path").over(Window.partitionBy("doc_id").orderBy("seg_pos")))
    return F.when(change, F.concat(F.repeat(F.lit("#"), F.col("sec_level") + 1), F.lit(" "), F.col("sec_heading"), F.lit("\n\n"), body)).otherwise(body)


def translation_markdown(segments: DataFrame, translations: DataFrame, column: str = "zh") -> DataFrame:
    """(doc_id, content): the translation by sections; untranslated segments are marked."""
    rows = segments.join(translations.select("sid", F.col(column).alias("__t")), "sid", "left")
    rows = rows.withColumn("__b", with_heading(rows, F.coalesce(F.nullif("__t", F.lit("")), F.lit(ABSENT))))
    return joined(rows, F.col("__b"), ["seg_pos"], separator="\n\n")


def interleaved(segments: DataFrame, translations: DataFrame, first: str = "zh") -> DataFrame:
    """(doc_id, content, missing): source (quoted) and translation by turns."""
    rows = segments.join(translations.select("sid", F.col("zh").alias("__t")), "sid", "left")
    zh = F.coalesce(F.nullif("__t", F.lit("")), F.lit(ABSENT))
    en = F.array_join(F.transform(F.split("src_text", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    both = F.concat_ws("\n\n", zh, en) if first == "zh" else F.concat_ws("\n\n", en, zh)
    rows = rows.withColumn("__b", with_heading(rows, both))
    lost = rows.groupBy("doc_id").agg(F.count_if(F.coalesce(F.length("__t"), F.lit(0)) == 0).alias("missing"))
    return joined(rows, F.col("__b"), ["seg_pos"], separator="\n\n").join(lost, "doc_id")


def lrc(timeline: DataFrame) -> DataFrame:
    return joined(timeline, F.concat(T.lrc_time(F.col("start_sec")), F.col("text")), ["start_sec", "ord"])


def vtt(timeline: DataFrame) -> DataFrame:
    """(doc_id, content): WebVTT cues numbered from 1."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_sec", "ord"))
    rows = timeline.withColumn("__n", n)
    cue = F.concat(F.col("__n").cast("string"), F.lit("\n"), T.vtt_time(F.col("start_sec")), F.lit(" --> "), T.vtt_time(F.col("end_sec")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return joined(rows, cue, ["__n"]).withColumn("content", F.concat(F.lit("WEBVTT\n\n"), "content"))


def nested(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """Documents with their sections and segments nested, as they rest on disk."""
    cols = [c for c in segments.columns if c not in ("doc_id", "seg_pos")]
    secs = segments.groupBy("doc_id", "sec_path", "sec_heading", "sec_level").agg(F.min("seg_pos").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", *cols))), lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias("segments"))
    docs = secs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("sec_heading").alias("heading"), F.col("sec_level").alias("level"), "segments"))), lambda s: F.struct(s["heading"].alias("heading"), s["level"].alias("level"), s["segments"].alias("segments"))).alias("sections"))
    return docs.join(titles.select("doc_id", "title"), "doc_id")


def reader_rows(segments: DataFrame, timeline: DataFrame, translations: DataFrame, scripts: DataFrame) -> DataFrame:
    """What a reader page shows per segment: times, translation, script, source; the first segment of each section opens a TOC entry."""
    rows = timeline.select("sid", "start_sec", "end_sec", "duration_sec").join(segments, "sid", "left").join(translations.select("sid", "zh"), "sid", "left").join(scripts.select("sid", "script"), "sid", "left")
    first = F.row_number().over(Window.partitionBy("doc_id", "sec_path").orderBy("seg_pos")) == 1
    label = F.coalesce(F.nullif("sec_heading", F.lit("")), F.lit("正文"))
    return rows.withColumns({"toc": F.when(first, label), "dom_id": T.safe_id(F.col("sid")), "zh": F.coalesce("zh", "script", F.lit("")), "script": F.coalesce("script", "zh", F.lit(""))})


def digest_markdown(snapshot: DataFrame, date: str) -> DataFrame:
    """(content): a digest as Markdown."""
    body = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), F.coalesce(F.nullif("title_zh", F.lit("")), F.col("title_en")), F.lit("\n\n"), F.coalesce("brief", F.lit("")), F.lit("\n\n- "), T.short_journal(F.col("journal"), None, True), F.lit(" · "), F.col("pub_date"), F.lit("\n- "), F.col("url_doi"), F.lit("\n"))
    rows = snapshot.withColumn("__k", F.lit(date))
    return joined(rows, body, ["n"], "__k").select(F.concat(F.lit(f"# {date}\n\n"), "content").alias("content"))


def glossary_json(terms: DataFrame) -> DataFrame:
    return terms.select(F.to_json(F.struct("term", "zh", "mode", "note", "aliases", "scope", "full_en")).alias("value"))


def glossary_yaml(terms: DataFrame, key: str = "scope") -> DataFrame:
    """(key, content): a glossary file of each scope, one term a line as a flow mapping, in order; readers.glossary_rows() reads it back.

    What a term leaves empty is left out. Line breaks in a note are escaped, so that a term stays on its line."""
    absent = lambda c: F.nullif(F.col(c), F.lit(""))
    own = F.struct("term", "zh", "mode", absent("note").alias("note"), F.when(F.size("aliases") > 0, F.col("aliases")).alias("aliases"), absent("pattern").alias("pattern"), F.when(~F.col("prefix_variants"), F.lit(False)).alias("prefix_variants"), "scope", "status", absent("full_en").alias("full_en"))
    rows = terms.select(key, "ord", "term", F.concat(F.lit("- "), F.to_json(own)).alias("line"))
    return joined(rows, F.col("line"), ["ord", "term"], key).withColumn("content", F.concat(F.lit("terms:\n"), "content", F.lit("\n")))


def write_glossaries(terms: DataFrame, root: str, key: str = "scope") -> None:
    """A folder of text for each scope; folders of scopes that are not in `terms` stay as they are."""
    rows = glossary_yaml(terms, key).select(key, F.regexp_replace("content", r"\n\z", "").alias("value"))
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(root)


def line_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.to_json(F.struct(*lines.columns)).alias("value"))


def baseline(stats: DataFrame) -> DataFrame:
    return stats.select("doc_id", "sections", F.col("sections").alias("sections_min"), "segments", "words")


def write_snapshot(items: DataFrame, root: str, stem: str) -> str:
    """A snapshot under its own name; one that exists is never overwritten."""
    path = f"{root}/snapshot={stem}"
    items.write.mode("errorifexists").json(path)
    return path


def _versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of a store's complete versions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def collect_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete a store's complete versions but for the newest `keep`; their numbers."""
    old = _versions(spark, root)[: -max(keep, 1)]
    for v in old:
        remove(spark, f"{root}/version={v:012d}")
    return old


def write_store(rows: DataFrame, root: str, key: str, version: int) -> str:
    """A keyed store as version `version`, sorted by key. The marker that a finished job leaves publishes it; to write a version again replaces it."""
    path = f"{root}/version={version:012d}"
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return path


def load_store(spark: SparkSession, root: str, schema: str, below: int | None = None) -> DataFrame:
    """The newest complete version of a store (of those below a number); empty where there is none. A file that can't be read is an error."""
    known = [v for v in _versions(spark, root) if below is None or v < below]
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/version={known[-1]:012d}")


def append_cache(entries: DataFrame, path: str) -> None:
    """Cache entries, by the first two digits of their key."""
    entries.withColumn("prefix", F.substring("key", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def push(messages: DataFrame, senders: dict, dry_run: bool = True) -> list[tuple[str, int, str]]:
    """(channel, sent, error): one channel's failure stops no other. Messages are a report of some dozen rows."""
    rows = messages.orderBy("channel", "msg_no").collect()
    out = []
    for channel in sorted({r["channel"] for r in rows}):
        own = [r["text"] for r in rows if r["channel"] == channel]
        try:
            for text in own:
                if not dry_run:
                    senders[channel](text)
            out.append((channel, 0 if dry_run else len(own), ""))
        except Exception as e:  # noqa: BLE001
            out.append((channel, 0, f"{type(e).__name__}: {e}"))
    return out
