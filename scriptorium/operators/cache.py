"""Content-addressed recomputation: keys, dirty segments, lookups, provider calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scriptorium.functions import text as T
from scriptorium.operators import glossary as G


def translation_key(model: str, version: str, src_hash: Column, signature: Column) -> Column:
    """Depends on the prompt's hint terms that the segment hits, and on nothing applied afterwards."""
    return T.content_key(F.lit("A"), F.lit(model), F.lit(version), src_hash, signature)


def script_key(model: str, version: str, style: str, translated: Column) -> Column:
    return T.content_key(F.lit("B"), F.lit(model), F.lit(version), F.lit(style), F.sha1(translated))


def digest_key(model: str, version: str, src_hash: Column) -> Column:
    return T.content_key(F.lit("D"), F.lit(model), F.lit(version), src_hash)


def audio_key(provider: str, model: str, voice: str, rate: str, pitch: str, spoken: Column) -> Column:
    """What a segment's speech depends on, the model included."""
    return T.content_key(*[F.lit(x) for x in ("T", provider, model, voice, rate, pitch)], spoken)


def keyed(segments: DataFrame, terms: DataFrame, model: str, version: str) -> DataFrame:
    """Segments with the cache key of their translation."""
    hits = G.hits(segments.select("sid", "src_text"), terms.where(F.col("mode") == G.HINT))
    sig = hits.groupBy("sid").agg(G.hits_signature(F.collect_list(G.signature())).alias("signature"))
    rows = segments.join(sig, "sid", "left").withColumn("signature", F.coalesce("signature", F.lit("")))
    return rows.withColumn("key", translation_key(model, version, F.sha1("src_text"), F.col("signature")))


def dirty(segments: DataFrame, terms: DataFrame, cache: DataFrame, model: str, version: str) -> DataFrame:
    """Segments whose translation must be made again."""
    return keyed(segments, terms, model, version).join(cache.select("key"), "key", "left_anti")


def lookup(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with their cached value, and whether there was one."""
    c = cache.select("key", F.col("value").alias("cached_value"))
    return rows.join(c, "key", "left").withColumn("hit", F.col("cached_value").isNotNull())


def cache_stats(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new entries; an entry of a known key is the same value by construction."""
    return cache.unionByName(fresh.select(*cache.columns).join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select(*cache.columns))


def mock_answer(user: Column, model: str = "mock", script: list[tuple[str, str]] | None = None) -> Column:
    """The mock provider: the answer of the first needle that the prompt holds, else its last line."""
    last = F.substring(F.element_at(F.split(F.substring(F.trim(user), 1, 400), "\n"), -1), 1, 400)
    out = F.concat(F.lit(f"[MOCK:{model}] "), last)
    for needle, answer in reversed(script or []):
        out = F.when(F.contains(user, F.lit(needle)), answer).otherwise(out)
    return out


# Answers that no retry mends, and those that one may.
FINAL_STATUS = (400, 401, 403)
RETRY_STATUS = (429, 500, 502, 503, 504)


class ProviderError(RuntimeError):
    """A provider's refusal, with its HTTP status."""

    def __init__(self, status: int, detail: str = ""):
        super().__init__(f"HTTP {status}: {detail}")
        self.status = status


def retried(call: Callable[[], str], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> str:
    """A call's answer: refusals of RETRY_STATUS and network errors are tried again after 1, 2, 4 ... seconds, other refusals are not."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or (isinstance(e, ProviderError) and e.status not in RETRY_STATUS):
                raise
            wait(2.0**n)
    raise ValueError("no attempt")


def complete(
    rows: DataFrame, prompt: str, call: Callable[[list[str]], list[str]], attempts: int = 3, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Rows with `value` and `error` of a provider, called once a batch; a failed batch is tried row by row and never stops the job."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values, errors = [], []
            try:
                values, errors = list(call(f[prompt].tolist())), [None] * len(f)
            except Exception:  # noqa: BLE001
                for p in f[prompt]:
                    try:
                        value, error = retried(lambda p=p: call([p])[0], attempts, wait), None
                    except Exception as e:  # noqa: BLE001
                        value, error = None, f"{type(e).__name__}: {e}"
                    values.append(value)
                    errors.append(error)
            yield f.assign(value=values, error=errors)

    schema = StructType([*rows.schema.fields, StructField("value", StringType()), StructField("error", StringType())])
    return rows.mapInPandas(of, schema)


# What a segment's prompt looks like.
TRANSLATE_USER = "【术语对照（必须遵守）】\n{term_block}\n\n【待翻译的原文段落】\n{src}\n"
SCRIPT_USER = "【段落位置】第 {seg_idx}/{total_segs} 段 ({stage})\n【所在章节】{section}\n【术语对照（保持译名一致）】\n{term_block}\n\n【待改写的译文】\n{translated}\n"


def prompted(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Segments with the prompt of their translation: the lines of the terms that they hold, and the source."""
    found = G.hits(segments.select("sid", "src_text"), terms)
    block = G.prompt_block(found, keys=("sid",))
    rows = segments.join(block, "sid", "left")
    return rows.withColumn("prompt", T.filled(TRANSLATE_USER, {"term_block": F.coalesce("block", F.lit("")), "src": F.col("src_text")})).drop("block")


def staged(segments: DataFrame, first: str, rest: str) -> DataFrame:
    """seg_idx, total_segs and stage: a document's first segment has another text in its prompt than those behind it."""
    own = Window.partitionBy("doc_id")
    rows = segments.withColumns({"seg_idx": F.row_number().over(own.orderBy("seg_pos")), "total_segs": F.count("*").over(own)})
    return rows.withColumn("stage", F.when(F.col("seg_idx") == 1, first).otherwise(rest))


def stage_stats(checkpoints: DataFrame) -> DataFrame:
    """Valid results of checkpoints(doc_id, stage, value) per document and stage."""
    valid = (F.length(F.trim("value")) > 0) & ~F.col("value").startswith("[翻译失败:") & ~F.col("value").startswith("[改写失败:")
    return checkpoints.groupBy("doc_id", "stage").agg(F.count_if(valid).alias("n_valid"), F.count("*").alias("n"))


def translate(
    segments: DataFrame, terms: DataFrame, cache: DataFrame, terms_list: list[dict], model: str = "mock", version: str = "v1",
    script: list[tuple[str, str]] | None = None, resolved: DataFrame | None = None,
) -> DataFrame:
    """Track A with the mock provider: key, cache, prompt with the terms that a segment holds, answer, hard terms and number format; the raw answer is kept.

    Hard terms are those of `resolved`, by document, or one list for all."""
    rows = lookup(keyed(prompted(segments, terms), terms, model, version), cache)
    rows = rows.withColumn("zh_raw", F.coalesce("cached_value", mock_answer(F.col("prompt"), model, script))).drop("cached_value", "prompt")
    if resolved is None:
        return rows.withColumn("zh", T.normalize_zh(G.hard_replace(F.col("zh_raw"), terms_list)))
    rows = G.replaced_by_document(rows.withColumn("zh", F.col("zh_raw")), resolved)
    return rows.withColumn("zh", T.normalize_zh(F.col("zh")))


def rewrite(segments: DataFrame, translated: DataFrame, style: str = "spoken", model: str = "mock", version: str = "v1") -> DataFrame:
    """Track B on raw translations; a segment without one gets an error; the preserve ratio compares lengths."""
    tr = translated.select("sid", F.coalesce("zh_raw", "zh").alias("__src"))
    rows = segments.join(tr, "sid", "left").withColumn("error", F.when(F.col("__src").isNull(), "no translation"))
    rows = rows.withColumn("key", script_key(model, version, style, F.coalesce("__src", F.lit(""))))
    rows = rows.withColumn("script", F.when(F.col("error").isNull(), mock_answer(F.col("__src"), model)))
    return rows.withColumn("preserve_ratio", T.preserve_ratio(F.col("script"), F.col("__src"))).drop("__src")


def run_stats(rows: DataFrame, low: float = 0.80) -> DataFrame:
    """Segments in all, from the cache, made, failed and of a low preserve ratio."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if("hit").alias("from_cache"), F.count_if(~F.col("hit")).alias("fresh"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("preserve_ratio") < low).alias("low_preserve")
    )


def resume(rows: DataFrame, done: DataFrame, text: str = "value") -> DataFrame:
    """What a stage still has to do: rows without a valid result."""
    valid = done.where((F.length(F.trim(text)) > 0) & ~F.col(text).startswith("[翻译失败:") & ~F.col(text).startswith("[改写失败:"))
    return rows.join(valid.select("sid"), "sid", "left_anti")
