"""Audits of translations: completeness, preservation, residue, numbers, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import glossary as G

# What a prompt leaves behind in an answer.
PROMPT_LEAK = ["【", "术语对照", "待翻译", "待改写", "所在章节"]
PRE_TAG = r"^(译文|翻译|输出|Answer|Translation)\s*[:：]"
PREFIX_RESIDUE = rf"(?<![A-Za-z])([{''.join(G.PREFIX_ZH)}])([A-Z][A-Za-z0-9]{{1,7}})(?![A-Za-z])"


def worst(rows: DataFrame, by, k: int, scope: str = "doc_id") -> DataFrame:
    """The k first rows of each document by the given order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(*by))).where(F.col("rank") <= k)


def completeness(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Translated characters for each source word: the lowest k per document. pairs(doc_id, sid, src, zh)."""
    rows = pairs.where("length(zh) > 0").withColumn("ratio", F.length("zh") / F.greatest(F.regexp_count("src", F.lit(T.LATIN_WORD)), F.lit(1)))
    return worst(rows, [F.col("ratio"), F.col("sid")], k)


def ratio_summary(rows: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """Lowest, upper median and highest."""
    return rows.groupBy(key).agg(F.min(column).alias("lowest"), T.upper_median(F.collect_list(column)).alias("middle"), F.max(column).alias("highest"), F.count(column).alias("n"))


def preservation(scripts: DataFrame, low: float = 0.80) -> DataFrame:
    return scripts.where("preserve_ratio is not null").groupBy("doc_id").agg(F.count_if(F.col("preserve_ratio") < low).alias("n_low"), F.min("preserve_ratio").alias("lowest"), F.count("*").alias("n"))


def residue(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Latin words for each CJK character of the translation: the highest k per document."""
    rows = pairs.where("length(zh) > 0").withColumns({"latin": F.regexp_count("zh", F.lit(T.LATIN_WORD)), "cjk": F.regexp_count("zh", F.lit(T.CJK))})
    rows = rows.withColumn("share", F.col("latin") / F.greatest("cjk", F.lit(1)))
    return worst(rows, [F.desc("share"), F.desc("latin"), F.desc("cjk"), F.desc("sid")], k)


def number_fidelity(pairs: DataFrame) -> DataFrame:
    """Numbers of two characters or more that the translation lacks, separators aside: sid, n_missing, missing (sorted)."""
    bare = lambda a: F.transform(a, lambda n: F.regexp_replace(n, "[.,]", ""))
    rows = pairs.where("length(zh) > 0").withColumns({"__s": F.array_distinct(F.filter(T.numbers(F.col("src")), lambda n: F.length(n) >= 2)), "__z": F.array_distinct(T.numbers(F.col("zh")))})
    rows = rows.withColumn("__n", bare(F.col("__z")))
    lost = F.filter(F.array_except("__s", "__z"), lambda n: ~F.array_contains(F.col("__n"), F.regexp_replace(n, "[.,]", "")))
    rows = rows.withColumn("missing", F.array_sort(lost)).where("size(missing) > 0")
    return rows.select("doc_id", "sid", F.size("missing").alias("n_missing"), F.array_join(F.slice("missing", 1, 6), ",").alias("missing"))


def leaks(pairs: DataFrame) -> DataFrame:
    """Translations that hold a piece of the prompt or open with a label."""
    test = F.col("zh").rlike(PRE_TAG)
    for p in PROMPT_LEAK:
        test = test | F.contains("zh", F.lit(p))
    return pairs.where(test).select("doc_id", "sid")


def prefix_residue(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Prefixed forms of known abbreviations that a translation still holds."""
    found = F.arrays_zip(F.regexp_extract_all("zh", F.lit(PREFIX_RESIDUE), F.lit(0)).alias("form"), F.regexp_extract_all("zh", F.lit(PREFIX_RESIDUE), F.lit(2)).alias("abbr"))
    rows = pairs.select("doc_id", "sid", F.explode(found).alias("f")).select("doc_id", "sid", F.col("f.form").alias("form"), F.col("f.abbr").alias("abbr"))
    return rows.join(terms.where(T.is_abbreviation(F.col("term"))).select(F.col("term").alias("abbr")).distinct(), "abbr", "left_semi").select("doc_id", "sid", "form").distinct()


def visual_density(pairs: DataFrame) -> DataFrame:
    """Lines a segment takes side by side: upper median, least, most, those beyond 30."""
    rows = pairs.withColumn("lines", F.length("zh") / 46.0 + F.length("src") / 88.0)
    return rows.groupBy("doc_id").agg(T.upper_median(F.collect_list("lines")).alias("middle"), F.min("lines").alias("lowest"), F.max("lines").alias("highest"), F.count_if(F.col("lines") > 30).alias("n_long"))


def absent(requested: DataFrame, available: DataFrame) -> DataFrame:
    return requested.join(available.select("doc_id").distinct(), "doc_id", "left_anti")


def char_totals(pairs: DataFrame) -> DataFrame:
    """Characters of source and translation per document."""
    return pairs.groupBy("doc_id").agg(F.sum(F.length("src")).cast("long").alias("src_chars"), F.sum(F.length("zh")).cast("long").alias("zh_chars"))


def audio_totals(audio: DataFrame) -> DataFrame:
    """Seconds of speech and failed segments of audio(doc_id, duration_sec, error) per document."""
    return audio.groupBy("doc_id").agg(F.round(F.sum("duration_sec"), 3).alias("total_sec"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
