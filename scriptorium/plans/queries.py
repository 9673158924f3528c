"""The queries of the reference-derived operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import abbrev as A
from scriptorium.operators import cache as C
from scriptorium.operators import feed as E
from scriptorium.operators import glossary as G
from scriptorium.operators import layout as L
from scriptorium.operators import qa as Q
from scriptorium.operators import segments as S
from scriptorium.operators import timeline as M
from scriptorium.plans import base as B
from scriptorium.sinks import puts as PU
from scriptorium.sinks import render as K
from scriptorium.sinks import stages as K2
from scriptorium.sources import literals as X
from scriptorium.sources import readers as R
from scriptorium.plans.base import segments, table
from scriptorium.streaming import status as ST

Frame = DataFrame


def html_flat_segments(spark: SparkSession, sf_dir: str) -> Frame:
    return S.flat_html(table(spark, sf_dir, "pages")).select("page_id", F.col("seg_pos").cast("int").alias("seg_pos"), "src_text", "n_words", "src_hash")


def html_title(spark: SparkSession, sf_dir: str) -> Frame:
    return table(spark, sf_dir, "pages").select("page_id", S.html_title(F.col("html"), F.col("page_id").cast("string")).alias("title"))


def html_segment_stats(spark: SparkSession, sf_dir: str) -> Frame:
    return S.document_stats(S.flat_html(table(spark, sf_dir, "pages")), "page_id", None).drop("sections")


def html_web_segments(spark: SparkSession, sf_dir: str) -> Frame:
    return S.web_flat(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(T.word_count(F.col("src_text"), "web")).cast("long").alias("words"))


def doc_segments(spark: SparkSession, sf_dir: str) -> Frame:
    return segments(spark, sf_dir).select("doc_id", "sid", F.col("seg_pos").cast("int").alias("seg_pos"), F.length("src_text").alias("n_chars"), "n_words")


def doc_stats_upper_median(spark: SparkSession, sf_dir: str) -> Frame:
    return S.document_stats(segments(spark, sf_dir))


def segment_fingerprint(spark: SparkSession, sf_dir: str) -> Frame:
    """Segments of the same content: how often, and in how many documents."""
    return segments(spark, sf_dir).groupBy("src_hash").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("sid").alias("first_sid")).where("n > 1")


def cache_key(spark: SparkSession, sf_dir: str) -> Frame:
    return segments(spark, sf_dir).select("sid", C.translation_key("mock:m1", "v1", F.col("src_hash"), F.lit("")).alias("key"), C.script_key("mock:m1", "v1", "spoken", F.col("src_text")).alias("script_key"))


def example_slug_ascii(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.TITLES, "id int, title string").select("id", T.slug(F.col("title")).alias("slug"))


def doc_slug(spark: SparkSession, sf_dir: str) -> Frame:
    """The slug of every document's text."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.slug(F.col("text")).alias("slug"))


def dup_sid_suffix(spark: SparkSession, sf_dir: str) -> Frame:
    """Segment ids by content prefix: the second of an id gets -dup2, the third -dup3."""
    rows = segments(spark, sf_dir).select("doc_id", "seg_pos", F.concat("doc_id", F.lit("#"), F.substring("src_text", 1, 3)).alias("sid"))
    return S.deduplicated(rows, "sid", ["seg_pos"]).select("doc_id", F.col("seg_pos").cast("int").alias("seg_pos"), "sid")


def section_fill_forward(spark: SparkSession, sf_dir: str) -> Frame:
    """Short lines as headings (level by length), filled forward over the segments behind them."""
    rows = segments(spark, sf_dir).withColumn("level", F.when(F.length("src_text") < 20, 1).when(F.length("src_text") < 60, 2).when(F.length("src_text") < 120, 3))
    rows = S.fill_forward(rows.withColumn("heading", F.col("src_text")), ["doc_id"], ["seg_pos"])
    return rows.select("sid", F.md5("h1").alias("h1"), F.md5("h2").alias("h2"), F.md5("h3").alias("h3"))


def first_in_section(spark: SparkSession, sf_dir: str) -> Frame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_pos"), F.col("role").alias("sec_path"))
    return S.first_in_section(rows).groupBy("doc_id").agg(F.count_if("head_change").alias("n_change"), F.count_if("head_first").alias("n_first"))


def prose_listagg(spark: SparkSession, sf_dir: str) -> Frame:
    return S.prose(segments(spark, sf_dir)).select("doc_id", F.md5("text").alias("md5"), F.length("text").alias("n"))


def word_count_variants(spark: SparkSession, sf_dir: str) -> Frame:
    return table(spark, sf_dir, "documents").select("doc_id", *[T.word_count(F.col("text"), d).alias(f"n_{d}") for d in ("pdf", "html", "web")])


def example_reading_len(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.BRIEFS, "id int, text string").select("id", T.reading_length(F.col("text")).alias("n"))


def example_normalize_numbers(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.BRIEFS, "id int, text string").select("id", T.normalize_zh(F.col("text")).alias("text"))


def example_sentence_split_zh(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.ZH_TEXTS, "id int, text string, total double").select("id", F.posexplode(T.zh_sentences(F.col("text"))).alias("ord", "sentence"))


def example_sentence_split_en(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.EN_TEXTS, "id int, text string").select("id", F.posexplode(T.en_sentences(F.col("text"))).alias("ord", "sentence"))


def doc_sentences(spark: SparkSession, sf_dir: str) -> Frame:
    """Sentences of every document: how many, and the longest."""
    got = T.en_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", got.alias("s")).select("doc_id", F.size("s").alias("n"), F.array_max(F.transform("s", F.length)).alias("longest"))


def _terms(spark: SparkSession) -> Frame:
    return G.terms_frame(spark, B.TERMS)


def term_hits_theta(spark: SparkSession, sf_dir: str) -> Frame:
    return G.hits(segments(spark, sf_dir), _terms(spark)).select("sid", "term", "zh", "mode")


def term_hits_web(spark: SparkSession, sf_dir: str) -> Frame:
    return G.web_hits(segments(spark, sf_dir), _terms(spark)).groupBy("term").agg(F.count("*").alias("n"))


def _translated(spark: SparkSession, sf_dir: str) -> Frame:
    """A stand-in translation: some words replaced."""
    return segments(spark, sf_dir).withColumn("zh", F.replace(F.replace("src_text", F.lit(" the "), F.lit(" 此 ")), F.lit(" de la "), F.lit(" 之 ")))


def term_landing(spark: SparkSession, sf_dir: str) -> Frame:
    return G.landing(_translated(spark, sf_dir), _terms(spark))


def term_density(spark: SparkSession, sf_dir: str) -> Frame:
    return G.density(_translated(spark, sf_dir), _terms(spark))


def hard_replace(spark: SparkSession, sf_dir: str) -> Frame:
    """All hard terms on every segment's text."""
    rows = segments(spark, sf_dir).withColumn("out", G.hard_replace(F.col("src_text"), B.TERMS))
    return rows.where("out <> src_text").select("sid", F.md5("out").alias("md5"), F.length("out").alias("n"))


def _scoped(spark: SparkSession) -> tuple[Frame, Frame]:
    t = spark.createDataFrame(B.SCOPED, "ord int, term string, zh string, mode string, scope string, status string")
    return t, spark.createDataFrame(B.READERS, "doc_id string, field string")


def example_glossary_resolve(spark: SparkSession, sf_dir: str) -> Frame:
    return G.resolve(*_scoped(spark)).select("doc_id", "term", "zh", "scope", "rank")


def example_glossary_conflicts(spark: SparkSession, sf_dir: str) -> Frame:
    return G.conflicts(*_scoped(spark)).select("doc_id", "key", "rank", F.size("entries").alias("n"), F.array_join(F.transform("entries", lambda e: e["zh"]), "/").alias("zh"))


def example_glossary_merged_anti_union(spark: SparkSession, sf_dir: str) -> Frame:
    t, _ = _scoped(spark)
    return G.merged(t.where("scope like 'doc:%'"), t.where("scope = 'global'")).select("ord", "term", "zh")


def glossary_upsert(spark: SparkSession, sf_dir: str) -> Frame:
    """Words of labelled good documents' sources overwrite a table of nations' names: new ones are appended."""
    old = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.col("n_nationkey").cast("string").alias("zh"))
    new = table(spark, sf_dir, "region").select(F.col("r_name").alias("term"), F.lit("r").alias("zh")).unionByName(old.where("cast(zh as int) % 3 = 0").select(F.lower("term").alias("term"), F.concat(F.lit("n"), "zh").alias("zh")))
    return G.upsert(old, new)


def example_abbr_defs(spark: SparkSession, sf_dir: str) -> Frame:
    return A.definitions(spark.createDataFrame(B.ABBREVIATION_TEXTS, "doc_id string, text string")).select("doc_id", "abbr", "full")


def _defs(spark: SparkSession) -> tuple[Frame, Frame, Frame]:
    d = spark.createDataFrame(B.DEFINITIONS, "doc_id string, abbr string, full string")
    t = spark.createDataFrame(B.ABBREVIATION_TEXTS, "doc_id string, text string")
    g = spark.createDataFrame(B.ABBREVIATION_GLOSSARY, "ord int, term string, zh string, full_en string")
    return d, t, g


def abbr_usage_min_count(spark: SparkSession, sf_dir: str) -> Frame:
    """How often capital words of the labelled documents occur in them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    names = docs.select("doc_id", F.explode(F.array(F.lit("THE"), F.lit("OF"), F.lit("Is"), F.lit("La"))).alias("abbr"))
    return A.usage(docs, names).where("n >= 2")


def example_abbr_audit_priority_join(spark: SparkSession, sf_dir: str) -> Frame:
    return A.audit(*_defs(spark)).drop("rank")


def example_abbr_undefined(spark: SparkSession, sf_dir: str) -> Frame:
    d, _, g = _defs(spark)
    return A.undefined(g, d).select("term", "zh")


def example_homonym_conflicts(spark: SparkSession, sf_dir: str) -> Frame:
    d, _, g = _defs(spark)
    return A.conflict_report(g, d)


def example_disambiguate(spark: SparkSession, sf_dir: str) -> Frame:
    d, t, g = _defs(spark)
    return A.disambiguate(d, g, t).select("doc_id", "abbr", "full", "n", "verdict", "reusable_zh")


def _pairs(spark: SparkSession, sf_dir: str) -> Frame:
    """Conversation turns against the turn before: source and stand-in translation."""
    c = table(spark, sf_dir, "conversations")
    per = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("src", F.lag("text").over(per)).where("src is not null and length(text) > 0")
    return rows.select(F.col("conv_id").alias("doc_id"), F.concat("conv_id", F.lit("#"), "turn").alias("sid"), "src", F.col("text").alias("zh"))


def qa_completeness_topk(spark: SparkSession, sf_dir: str) -> Frame:
    return Q.completeness(_pairs(spark, sf_dir)).select("doc_id", "sid", F.round("ratio", 4).alias("ratio"), "rank")


def qa_ratio_summary(spark: SparkSession, sf_dir: str) -> Frame:
    rows = _pairs(spark, sf_dir).withColumn("r", F.length("zh").cast("double"))
    return Q.ratio_summary(rows, "r")


def qa_residue(spark: SparkSession, sf_dir: str) -> Frame:
    return Q.residue(_pairs(spark, sf_dir)).select("doc_id", "sid", "latin", "cjk", F.col("rank"))


def qa_number_fidelity(spark: SparkSession, sf_dir: str) -> Frame:
    """Numbers of a document's segment that the segment behind it lacks."""
    rows = segments(spark, sf_dir)
    per = Window.partitionBy("doc_id").orderBy("seg_pos")
    rows = rows.withColumn("zh", F.lead("src_text").over(per)).where("zh is not null").withColumnRenamed("src_text", "src")
    return Q.number_fidelity(rows).select("sid", "n_missing", "missing")


def qa_leaks(spark: SparkSession, sf_dir: str) -> Frame:
    rows = segments(spark, sf_dir).select(F.col("doc_id"), "sid", F.when(F.length("src_text") % 7 == 0, F.concat(F.lit("译文："), "src_text")).otherwise(F.col("src_text")).alias("zh"))
    return Q.leaks(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


def qa_health_flags(spark: SparkSession, sf_dir: str) -> Frame:
    return S.health(segments(spark, sf_dir))


def qa_visual_density(spark: SparkSession, sf_dir: str) -> Frame:
    got = Q.visual_density(_pairs(spark, sf_dir))
    return got.select("doc_id", F.round("middle", 6).alias("middle"), F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"), "n_long")


def qa_invariants(spark: SparkSession, sf_dir: str) -> Frame:
    return S.invariants(segments(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


def timeline_prefix_sum(spark: SparkSession, sf_dir: str) -> Frame:
    return M.timeline(B.scripts(spark, sf_dir), scope="conv_id", order="turn").select("conv_id", "turn", F.round("start_sec", 2).alias("start_sec"), F.round("end_sec", 2).alias("end_sec"))


def web_timeline(spark: SparkSession, sf_dir: str) -> Frame:
    rows = B.scripts(spark, sf_dir).withColumn("duration_sec", F.when(F.col("turn") % 3 != 0, F.col("duration_sec")))
    return M.web_timeline(rows, "conv_id", "turn").select("conv_id", "turn", F.round("start_sec", 2).alias("start_sec"))


def example_proportional_sentences(spark: SparkSession, sf_dir: str) -> Frame:
    return M.proportional(spark.createDataFrame(B.ZH_TEXTS, "id int, text string, total double"), "id", "text", "total")


def turn_sentences(spark: SparkSession, sf_dir: str) -> Frame:
    """Lines of every turn share its mock duration by length."""
    rows = B.scripts(spark, sf_dir).select(F.concat("conv_id", F.lit("#"), "turn").alias("id"), "text", "duration_sec")
    got = M.proportional(rows, "id", "text", "duration_sec")
    return got.groupBy("id").agg(F.count("*").alias("n"), F.round(F.max("end"), 2).alias("last_end"))


def playback_interval_join(spark: SparkSession, sf_dir: str) -> Frame:
    """Which turn plays at every 30th second of a conversation."""
    spans = M.timeline(B.scripts(spark, sf_dir), scope="conv_id", order="turn").select("conv_id", F.col("turn").alias("ord"), "start_sec", "end_sec")
    times = spans.groupBy("conv_id").agg(F.max("end_sec").alias("e")).select("conv_id", F.explode(F.sequence(F.lit(0), F.floor("e").cast("int"), F.lit(30))).alias("t")).withColumn("t", F.col("t").cast("double"))
    return M.active_at(times, spans, "conv_id")


def word_sentence_overlap(spark: SparkSession, sf_dir: str) -> Frame:
    """Word times of every turn gathered by its lines: each word takes a second."""
    rows = B.scripts(spark, sf_dir).select(F.concat("conv_id", F.lit("#"), "turn").alias("id"), "text")
    words = F.filter(F.split("text", "[ \n]+"), lambda w: F.length(w) > 0)
    placed = rows.select("id", F.posexplode(M.locate_words(words, F.col("text"))).alias("k", "w"))
    placed = placed.select("id", F.col("w.s").alias("s"), F.col("w.e").alias("e"), F.col("k").cast("double").alias("start"), (F.col("k") + 1).cast("double").alias("end"))
    parts = rows.select("id", F.posexplode(T.zh_sentences(F.col("text"))).alias("ord", "sentence"))
    return M.words_to_sentences(placed, M.char_offsets(parts, "id"), "id")


def positional_alignment(spark: SparkSession, sf_dir: str) -> Frame:
    """The number of the translated sentence for each of a document's first sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "[.]")).alias("n_en"), F.size(F.split("text", "\n")).alias("n_zh"))
    rows = docs.select("doc_id", "n_en", "n_zh", F.explode(F.sequence(F.lit(0), F.col("n_en") - 1)).alias("e"))
    return rows.withColumn("z", M.corresponding(F.col("e"), F.col("n_en"), F.col("n_zh"))).groupBy("doc_id").agg(F.sum("z").cast("long").alias("sum_z"), F.max("z").alias("max_z"))


def _items(spark: SparkSession, sf_dir: str) -> Frame:
    """Events as feed items."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    text = lambda c: F.lit(c)
    return e.select(
        F.col("event_id").cast("string").alias("pmid"), F.concat(F.lit("10.1038/x"), F.col("event_id").cast("string")).alias("doi"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("doc_id"), F.concat(F.lit("Nature reviews. "), F.initcap("event_type")).alias("journal"), text("").alias("journal_abbr"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title_en"), F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.coalesce("props", F.lit(""))).alias("abstract"), F.when(F.col("event_id") % 11 == 0, "2026-09-00").otherwise(day).alias("pub_date"), F.when(F.col("event_id") % 13 == 0, "").otherwise(day).alias("entrez_date"), text("").alias("pmc"),
        F.col("event_type").alias("term_field"), F.array(F.lit("Review")).alias("ptypes"), F.when(F.col("event_id") % 4 == 0, "shown").when(F.col("event_id") % 9 == 0, "picked").otherwise("new").alias("status"), day.alias("first_seen"), F.array().cast("array<string>").alias("shown_in"), text("").alias("title_zh"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("brief"), text("").alias("detail"),
    )


def feed_filter_kept_dropped(spark: SparkSession, sf_dir: str) -> Frame:
    kept, dropped = E.split_kept(_items(spark, sf_dir))
    return kept.withColumn("side", F.lit("kept")).unionByName(dropped.withColumn("side", F.lit("dropped"))).groupBy("side", "term_field").agg(F.count("*").alias("n"))


def feed_upsert_merge(spark: SparkSession, sf_dir: str) -> Frame:
    """A store of every other item, merged with items that bring new titles."""
    items = _items(spark, sf_dir)
    store, inc = items.where("cast(pmid as long) % 2 = 0"), items.where("cast(pmid as long) % 3 = 0").withColumn("title_en", F.concat("title_en", F.lit("'")))
    after, _ = E.upsert(store, inc, "2026-09-21")
    return after.select("pmid", "title_en", "status", "first_seen", "brief")


def feed_inserted(spark: SparkSession, sf_dir: str) -> Frame:
    items = _items(spark, sf_dir)
    _, fresh = E.upsert(items.where("cast(pmid as long) % 2 = 0"), items.where("cast(pmid as long) % 3 = 0"), "2026-09-21")
    return fresh.select("pmid", "status", "first_seen")


def feed_write_back(spark: SparkSession, sf_dir: str) -> Frame:
    items = _items(spark, sf_dir)
    made = items.where("cast(pmid as long) % 5 = 0").select("pmid", F.lit("题").alias("title_zh"), F.concat(F.lit("B"), "pmid").alias("brief"), F.lit("细").alias("detail"))
    return E.write_back(items, made).groupBy("title_zh", "detail").agg(F.count("*").alias("n"), F.min("brief").alias("least"))


def feed_set_status(spark: SparkSession, sf_dir: str) -> Frame:
    items = _items(spark, sf_dir)
    return E.set_status(items, items.where("status = 'new' and term_field = 'click'"), "shown", "2026-09-21").groupBy("status", F.array_join("shown_in", ",").alias("shown_in")).agg(F.count("*").alias("n"))


def feed_pending_topk(spark: SparkSession, sf_dir: str) -> Frame:
    return E.pending(_items(spark, sf_dir), 50).select("pmid", "entrez_date")


def feed_status_rollup(spark: SparkSession, sf_dir: str) -> Frame:
    return E.stats(_items(spark, sf_dir))


def feed_gap(spark: SparkSession, sf_dir: str) -> Frame:
    return E.gap(_items(spark, sf_dir), "2026-09-21")


def feed_recent_keep_unparseable(spark: SparkSession, sf_dir: str) -> Frame:
    items = _items(spark, sf_dir)
    return E.recent(items, 400, "2025-01-15").groupBy("term_field").agg(F.count("*").alias("n"))


def feed_urls(spark: SparkSession, sf_dir: str) -> Frame:
    return E.with_urls(_items(spark, sf_dir)).select("pmid", "has_abstract", "url_pubmed", "url_doi", "run_command")


def feed_search(spark: SparkSession, sf_dir: str) -> Frame:
    return E.search(_items(spark, sf_dir), "CLICK").groupBy("status").agg(F.count("*").alias("n"))


def journal_fields(spark: SparkSession, sf_dir: str) -> Frame:
    rows = _items(spark, sf_dir).select("journal").distinct()
    return rows.select("journal", T.field_of_journal(F.col("journal")).alias("field"), T.short_journal(F.col("journal")).alias("short"), T.doc_id_of_doi(F.concat(F.lit("10.1038/"), "journal")).alias("doc_id"))


def example_feed_dates(spark: SparkSession, sf_dir: str) -> Frame:
    rows = [(1, "2026", "Sep", "18", ""), (2, "2026", "9", "", ""), (3, "2026", "", "", ""), (4, "", "", "", "2026 Sep-Oct"), (5, "", "", "", "2026"), (6, "", "", "", "Winter 2026"), (7, "2026", "dec", "5", "")]
    return spark.createDataFrame(rows, "id int, y string, m string, d string, f string").select("id", T.feed_date(F.col("y"), F.col("m"), F.col("d"), F.col("f")).alias("date"))


def digest_snapshot_numbers(spark: SparkSession, sf_dir: str) -> Frame:
    return E.snapshot_items(E.pending(_items(spark, sf_dir), 40)).select("n", "pmid", "url_doi")


def example_digest_payload_json(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.ANSWERS, "id int, text string").select("id", E.payload(F.col("text")).alias("p")).select("id", "p.*")


def event_props_json(spark: SparkSession, sf_dir: str) -> Frame:
    """The number that each event's payload holds."""
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def example_digest_brief_verdict(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.BRIEFS, "id int, text string").select("id", E.brief_verdict(F.col("text")).alias("v")).select("id", "v.mark", "v.why")


def message_packing(spark: SparkSession, sf_dir: str) -> Frame:
    """Messages of the newest 120 pending items for every channel."""
    snap = E.snapshot_items(E.pending(_items(spark, sf_dir), 120).withColumn("detail", F.repeat(F.lit("细"), 100)))
    return E.build_messages(snap, "2026-09-21").select("channel", "msg_no", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


def html_digest_budget(spark: SparkSession, sf_dir: str) -> Frame:
    snap = E.snapshot_items(E.pending(_items(spark, sf_dir), 120))
    return E.html_digest(snap, "2026-09-21").select("shown", "total", (F.length("html") <= E.HTML_LIMIT).alias("within"))


def dirty_segments_anti(spark: SparkSession, sf_dir: str) -> Frame:
    """What must be translated again after a hint term's note has changed."""
    segs = segments(spark, sf_dir).select("sid", "src_text")
    before = C.keyed(segs, _terms(spark), "mock:m1", "v1").select("key", F.lit("x").alias("value"))
    changed = G.terms_frame(spark, [t | {"note": "改"} if t["term"] == "and the" else t for t in B.TERMS])
    return C.dirty(segs, changed, before, "mock:m1", "v1").select("sid", "key")


def cache_hit_counts(spark: SparkSession, sf_dir: str) -> Frame:
    segs = segments(spark, sf_dir).select("sid", "src_text", "doc_id")
    keyed = C.keyed(segs, _terms(spark), "mock:m1", "v1")
    cache = keyed.where("doc_id % 2 = 0").select("key").distinct().withColumn("value", F.lit("x"))
    return C.cache_stats(C.lookup(keyed, cache))


def mock_translate(spark: SparkSession, sf_dir: str) -> Frame:
    user = F.concat(F.lit("【待翻译】\n"), "src_text")
    return segments(spark, sf_dir).select("sid", F.md5(C.mock_answer(user, "m1")).alias("md5"))


def rolling_right_edge(spark: SparkSession, sf_dir: str) -> Frame:
    """Order lines as layout lines: the rolling edge of each order's quantities."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_quantity").alias("x1"))
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey"))
    rows = li.select(F.col("l_suppkey").alias("doc_id"), pos.alias("pos"), "x1", F.floor(pos / 20).alias("page"), F.lit(0).alias("col"), F.lit("body").alias("kind"))
    return L.right_edge(rows).select("doc_id", F.col("pos").cast("int").alias("pos"), "edge")


def gap_clusters(spark: SparkSession, sf_dir: str) -> Frame:
    """Account balances of each nation's customers in clusters, by gaps of more than 40."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_acctbal").alias("v"))
    got = L.gap_clusters(rows, "doc_id", "v", 40.0)
    return got.select("doc_id", "cluster", F.floor("centre").alias("centre"), "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> Frame:
    """Sessions of each user's events: a gap of more than an hour opens a new one."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("v"))
    return L.gap_clusters(rows, "doc_id", "v", 3600).select("doc_id", "cluster", "n")


def column_histogram(spark: SparkSession, sf_dir: str) -> Frame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.abs(F.col("s_acctbal") / 100).alias("x0"))
    return L.histogram(rows)


def example_rect_containment_semi(spark: SparkSession, sf_dir: str) -> Frame:
    rects = spark.createDataFrame(B.RECTS, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame(B.BOX_LINES, "doc_id string, page int, y0 double, x0 double, x1 double, text string")
    return L.in_rects(lines, rects).select("doc_id", "page", "text", "in_rect")


def grep_context_window(spark: SparkSession, sf_dir: str) -> Frame:
    return S.grep_context(segments(spark, sf_dir), "erend", 2).select("sid", "hit")


def word_budget(spark: SparkSession, sf_dir: str) -> Frame:
    return S.word_budget(segments(spark, sf_dir), 200).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("words_before").cast("long").alias("before"))


def example_term_stats(spark: SparkSession, sf_dir: str) -> Frame:
    return G.stats(_terms(spark))


def example_term_search(spark: SparkSession, sf_dir: str) -> Frame:
    return G.search(_terms(spark), "THE").select("term", "mode")


def example_prompt_block(spark: SparkSession, sf_dir: str) -> Frame:
    return G.prompt_block(_terms(spark))


def example_signatures(spark: SparkSession, sf_dir: str) -> Frame:
    return _terms(spark).select("term", G.signature().alias("signature"))


def time_formats(spark: SparkSession, sf_dir: str) -> Frame:
    rows = M.timeline(B.scripts(spark, sf_dir), scope="conv_id", order="turn").select("conv_id", "turn", F.floor("start_sec").cast("double").alias("s"))
    return rows.select("conv_id", "turn", T.lrc_time(F.col("s")).alias("lrc"), T.vtt_time(F.col("s")).alias("vtt"), T.clock(F.col("s")).alias("clock"))


def spoken_length(spark: SparkSession, sf_dir: str) -> Frame:
    """Lengths before and after every turn is made speakable."""
    return B.scripts(spark, sf_dir).select("conv_id", "turn", F.md5(T.spoken(F.col("text"), [("the", "thee"), ("and", "annd")])).alias("md5"))


def stage_resume(spark: SparkSession, sf_dir: str) -> Frame:
    """What a stage still has to do where every third result is missing and every seventh failed."""
    segs = segments(spark, sf_dir).select("sid", "doc_id", "seg_pos")
    k = F.col("seg_pos") + F.col("doc_id")
    done = segs.where(k % 3 != 0).select("sid", F.when(k % 7 == 0, "[翻译失败: x]").otherwise("ok").alias("value"))
    return C.resume(segs, done).groupBy("doc_id").agg(F.count("*").alias("n"))


def example_html_sections(spark: SparkSession, sf_dir: str) -> Frame:
    """Segments of pages with nested sections, figures, lists and tables."""
    pages = spark.createDataFrame(B.NESTED_PAGES, "doc_id string, html string")
    return S.section_html(pages).select("doc_id", "sid", "sec_heading", "sec_level", "src_text", "is_figure")


def example_html_sections_web(spark: SparkSession, sf_dir: str) -> Frame:
    pages = spark.createDataFrame(B.NESTED_PAGES, "doc_id string, html string")
    return S.section_html(pages, "web").select("doc_id", "sid", F.col("index").cast("int").alias("index"))


def html_sections(spark: SparkSession, sf_dir: str) -> Frame:
    """Segments of all pages, set in sections with sub-headings, captions and tables."""
    got = S.section_html(B.sectioned_pages(spark, sf_dir))
    return got.select("doc_id", "sid", "sec_heading", "sec_level", F.col("index").cast("int").alias("index"), F.col("seg_pos").cast("int").alias("seg_pos"), F.md5("src_text").alias("md5"), "n_words", "is_figure", "fig_label")


def html_sections_web(spark: SparkSession, sf_dir: str) -> Frame:
    """Segments of all pages by the browser's rule: abstract, sections, captions, boxes with lists."""
    got = S.browser_html(B.browser_pages(spark, sf_dir))
    return got.select("doc_id", "sid", "sec_heading", "sec_level", F.col("index").cast("int").alias("index"), F.md5("src_text").alias("md5"), "n_words", "is_figure", "in_box", "fig_label")


def health_of_sections(spark: SparkSession, sf_dir: str) -> Frame:
    """Cleanliness and warnings of all pages by their sections."""
    return S.health(S.section_html(B.sectioned_pages(spark, sf_dir)))


def example_html_entities(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame([(i, t) for i, t, _ in B.ENTITIES], "id int, text string").select("id", T.unescape(F.col("text")).alias("text"))


def example_line_layout(spark: SparkSession, sf_dir: str) -> Frame:
    """Body size and font, columns and their left edges of laid-out lines."""
    lines, rects, width = B.laid_out(spark)
    got = L.layout(L.in_rects(lines, rects), width)
    return got.select("doc_id", "body_size", "body_font", "n_columns", "split_x", F.array_join(F.col("bases").cast("array<int>").cast("array<string>"), ",").alias("bases"))


def example_line_kinds(spark: SparkSession, sf_dir: str) -> Frame:
    lines, rects, width = B.laid_out(spark)
    return L.classify(L.in_rects(lines, rects), L.layout(lines, width)).select("page", "y0", "x0", "kind")


def example_line_segments(spark: SparkSession, sf_dir: str) -> Frame:
    """Segments of laid-out lines: columns, headings, run-in headings, captions, paragraphs."""
    got = L.segment_lines(*B.laid_out(spark))
    return got.select("sid", "sec_heading", "sec_level", F.col("page").cast("int").alias("page"), "src_text")


def example_line_title(spark: SparkSession, sf_dir: str) -> Frame:
    lines, rects, width = B.laid_out(spark)
    return L.title(L.reading_order(L.classify(L.in_rects(lines, rects), L.layout(lines, width))))


def line_layout(spark: SparkSession, sf_dir: str) -> Frame:
    """Body size and font, columns and their left edges of all documents, typeset."""
    spans, _, _, pages = B.typeset(spark, sf_dir, K2.written)
    got = L.span_layouts(spans, pages, K2.written)
    return got.select("doc_id", "body_size", "body_font", F.col("n_columns").cast("int").alias("n_columns"), F.round("split_x", 4).alias("split_x"), F.array_join(F.transform("bases", lambda b: F.round(b, 2).cast("string")), ",").alias("bases"))


def line_kinds(spark: SparkSession, sf_dir: str) -> Frame:
    """Kinds of all typeset lines: headings, run-in headings, captions and their continuations, boxed regions, junk."""
    got, _ = L.classified(*B.typeset(spark, sf_dir, K2.written), K2.written)
    return got.select("doc_id", "page", "y0", "x0", "kind", F.col("pos").cast("int").alias("pos"), F.coalesce("runin_head", F.lit("")).alias("runin_head"))


def line_segments(spark: SparkSession, sf_dir: str) -> Frame:
    """Segments of all typeset documents."""
    got = L.segment_spans(*B.typeset(spark, sf_dir, K2.written), K2.written)
    return got.select("doc_id", "sid", "sec_heading", "sec_level", F.col("page").cast("int").alias("page"), F.md5("src_text").alias("md5"), "n_words", "indented", F.col("col").cast("int").alias("col"))


def _said(spark: SparkSession, sf_dir: str) -> tuple[Frame, Frame, Frame]:
    texts, glossary = B.abbreviated(spark, sf_dir)
    return A.definitions(texts), texts, glossary


def abbr_defs(spark: SparkSession, sf_dir: str) -> Frame:
    """What all documents define."""
    return _said(spark, sf_dir)[0].select("doc_id", "abbr", "full")


def abbr_audit_priority_join(spark: SparkSession, sf_dir: str) -> Frame:
    """The abbreviations that each document defines and uses, and their glossary entries."""
    return A.audit(*_said(spark, sf_dir))


def abbr_undefined(spark: SparkSession, sf_dir: str) -> Frame:
    d, _, g = _said(spark, sf_dir)
    return A.undefined(g, d.where("cast(doc_id as long) % 2 = 1")).select("term", "zh")


def homonym_conflicts(spark: SparkSession, sf_dir: str) -> Frame:
    d, _, g = _said(spark, sf_dir)
    return A.conflict_report(g, d)


def disambiguate(spark: SparkSession, sf_dir: str) -> Frame:
    d, t, g = _said(spark, sf_dir)
    return A.disambiguate(d, g, t).select("doc_id", "abbr", "full", "n", "ord", "verdict", "reusable_zh")


def pending_terms(spark: SparkSession, sf_dir: str) -> Frame:
    return G.pending_terms(_said(spark, sf_dir)[0])


def glossary_resolve(spark: SparkSession, sf_dir: str) -> Frame:
    """The glossary of every document, of global, source and own entries."""
    return G.resolve(*B.scoped_terms(spark, sf_dir)).select("doc_id", "key", "zh", "scope", "rank")


def glossary_conflicts(spark: SparkSession, sf_dir: str) -> Frame:
    got = G.conflicts(*B.scoped_terms(spark, sf_dir))
    return got.select("doc_id", "key", "rank", F.size("entries").alias("n"), F.array_join(F.transform("entries", lambda e: e["zh"]), "/").alias("zh"))


def glossary_merged_anti_union(spark: SparkSession, sf_dir: str) -> Frame:
    """Entries of the sources, and the global ones that none of them overrides."""
    t, _ = B.scoped_terms(spark, sf_dir)
    return G.merged(t.where("scope like 'field:%'"), t.where("scope = 'global'")).select("ord", "term", "zh", "scope")


def prompt_block(spark: SparkSession, sf_dir: str) -> Frame:
    """The prompt block of every scope's entries."""
    t, _ = B.scoped_terms(spark, sf_dir)
    return G.prompt_block(t, keys=("scope",)).select("scope", F.md5("block").alias("md5"))


def term_stats(spark: SparkSession, sf_dir: str) -> Frame:
    return G.stats(B.scoped_terms(spark, sf_dir)[0])


def term_search(spark: SparkSession, sf_dir: str) -> Frame:
    t, _ = B.scoped_terms(spark, sf_dir)
    return G.search(t.withColumn("aliases", F.array(F.concat(F.lit("x"), "zh"))), "on_2", G.HARD).select("ord", "term", "scope")


def hard_replace_by_document(spark: SparkSession, sf_dir: str) -> Frame:
    """A sentence on two nations for each document, by the document's own glossary: prefixed, plain and in brackets."""
    docs = table(spark, sf_dir, "documents")
    n = table(spark, sf_dir, "nation")
    letters = lambda c: F.replace(F.translate(c, "0123456789", "ABCDEFGHIJ"), F.lit("_"), F.lit(""))
    name = lambda k: n.select(F.col("n_nationkey").cast("long").alias(f"k{k}"), letters(F.col("n_name")).alias(f"t{k}"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 25).alias("k0"), ((F.col("doc_id") + 1 + F.col("doc_id") % 7) % 25).alias("k1"))
    rows = rows.join(name(0), "k0").join(name(1), "k1").withColumn("zh", F.concat(F.lit("在 "), "t0", F.lit(" 与 a"), "t0", F.lit(" 及 x"), "t1", F.lit("y（"), "t1", F.lit("）")))
    terms, readers = B.scoped_terms(spark, sf_dir)
    own = G.resolve(terms, readers).withColumn("term", letters(F.upper(F.trim("term"))))
    return G.replaced_by_document(rows.select("doc_id", "zh"), own).select("doc_id", "zh")


def html_entities(spark: SparkSession, sf_dir: str) -> Frame:
    """Every document's text, escaped by names, decimal and hexadecimal numbers, and read back."""
    s = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;"))
    for c, e in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("é", "&#233;"), ("ü", "&#xFC;"), ("ó", "&#Xf3;"), ("$", "&#36;")):
        s = F.replace(s, F.lit(c), F.lit(e))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.unescape(s)).alias("md5"), F.length(s).alias("n_escaped"))


def digest_brief_verdict(spark: SparkSession, sf_dir: str) -> Frame:
    """The length as read, and the verdict on it, of every document's text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.reading_length(F.col("text")).alias("n"), E.brief_verdict(F.col("text")).alias("v"))
    return rows.select("doc_id", "n", "v.mark", "v.why")


def normalize_numbers(spark: SparkSession, sf_dir: str) -> Frame:
    """Sizes of documents in full-width digits with full-width separators, and words doubled across a blank, made normal."""
    k = F.col("n_chars") * 1009 + F.col("doc_id")
    digits = F.translate(k.cast("string"), "0123456789", "０１２３４５６７８９")
    grouped = F.concat(F.floor(k / 1_000_000).cast("string"), F.lit("，"), F.lpad((F.floor(k / 1000) % 1000).cast("string"), 3, "0"), F.lit("．"), F.lpad((k % 1000).cast("string"), 3, "0"))
    text = F.concat(F.lit("共 "), grouped, F.lit(" 例 任务任务 任务任务 里，第 "), digits, F.lit(" 组，分 1，2，3 组"))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_zh(text).alias("text"))


def feed_dates(spark: SparkSession, sf_dir: str) -> Frame:
    """Dates of events, given in parts or in words as feeds do, some of them broken."""
    d, k = F.col("ts"), F.col("event_id")
    year, month, day = F.date_format(d, "yyyy"), F.date_format(d, "MMM"), F.date_format(d, "d")
    free = F.when(k % 6 == 4, F.concat(year, F.lit(" "), month, F.lit("-Dec"))).when(k % 6 == 5, F.concat(F.lit("Winter "), year)).otherwise("")
    got = T.feed_date(F.when(k % 6 < 4, year).otherwise(""), F.when(k % 6 == 1, F.date_format(d, "M")).when(k % 6 == 2, "").otherwise(month), F.when(k % 6 == 3, "").otherwise(day), free)
    return table(spark, sf_dir, "events").select("event_id", got.alias("date"))


def digest_payload_json(spark: SparkSession, sf_dir: str) -> Frame:
    """Answers of a provider on events: fenced, wrapped in prose, partial and broken JSON, read and judged."""
    k = F.col("event_id")
    body = F.concat(F.lit('{"title_zh": " 题'), k.cast("string"), F.lit('", "brief": "'), F.repeat(F.lit("句"), (k % 40).cast("int")), F.repeat(F.lit("，"), (k % 3).cast("int")), F.lit('"'), F.when(k % 2 == 0, ', "detail": "细"').otherwise(""), F.lit("}"))
    text = F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" thanks"))).when(k % 5 == 2, F.lit("garbage { here")).otherwise(body)
    rows = table(spark, sf_dir, "events").select("event_id", F.inline(F.array(E.payload(text))))
    return rows.select("event_id", "title_zh", F.length("brief").alias("n"), "detail", F.inline(F.array(E.brief_verdict(F.col("brief")))))


def sentences_zh(spark: SparkSession, sf_dir: str) -> Frame:
    """The sentences of every turn, full stops set as in Chinese."""
    rows = B.scripts(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.zh_sentences(F.replace("text", F.lit(". "), F.lit("。")))).alias("ord", "sentence"))
    return rows.select("conv_id", "turn", "ord", F.md5("sentence").alias("md5"))


def boxed_lines(spark: SparkSession, sf_dir: str) -> Frame:
    """Which typeset lines lie in a rectangle of their page."""
    spans, drawings, images, _ = B.typeset(spark, sf_dir, K2.written)
    return L.in_rects(L.gather(spans), L.region_rects(drawings, images)).groupBy("doc_id", "page").agg(F.count_if("in_rect").alias("n_in"), F.count("*").alias("n"))


def typeset_titles(spark: SparkSession, sf_dir: str) -> Frame:
    """Titles of typeset documents: their first heading, else their number."""
    return L.span_titles(*B.typeset(spark, sf_dir, K2.written), K2.written)


def typeset_kinds_top(spark: SparkSession, sf_dir: str) -> Frame:
    """The kinds of typeset lines, the most frequent first, of even pages and of lines that hold a capital."""
    got, _ = L.classified(*B.typeset(spark, sf_dir, K2.written), K2.written)
    return L.kinds(L.inspect(got.where("page % 2 = 0"), grep="[A-Z]", kinds=["h1", "h2", "body", "figure", "region", "other"]))


def scope_signatures(spark: SparkSession, sf_dir: str) -> Frame:
    t, _ = B.scoped_terms(spark, sf_dir)
    return t.withColumn("aliases", F.array(F.lit("b"), "zh", F.lit("a"))).select("ord", "scope", "zh", F.md5(G.signature()).alias("md5"))


def web_abbreviations(spark: SparkSession, sf_dir: str) -> Frame:
    """The browser's test of each document's first names against abbreviations of initials, of inner letters, and of others."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), 1, 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where("size(w) = 3").withColumn("name", F.array_join("w", " "))
    third = F.col("doc_id") % 3
    letter = lambda k, at: F.upper(F.substring(F.get("w", F.lit(k)), at, 1))
    abbr = F.when(third == 0, F.concat(letter(0, 1), letter(1, 1), letter(2, 1))).when(third == 1, F.concat(letter(0, 2), letter(2, 3))).otherwise(F.concat(letter(2, 1), F.lit("Q9")))
    return rows.select("doc_id", A.web_initials_fit(abbr, F.col("name")).alias("fits"))


def citation_marks(spark: SparkSession, sf_dir: str) -> Frame:
    """Marks of citations set high in every turn's text, and how many there are."""
    text = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("–"), (F.col("turn") + 2).cast("string"), F.lit("] [ref. 3] [a b]"))
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.superscript_citations(text).alias("t"))
    return rows.select("conv_id", "turn", F.regexp_count("t", F.lit("cite-sup")).alias("n"), F.length("t").alias("n_chars"))


def short_ids(spark: SparkSession, sf_dir: str) -> Frame:
    """Ids of segments and pages as they are shown, as anchors, and cleaned of folders and endings."""
    rows = B.sectioned_pages(spark, sf_dir)
    segs = S.section_html(rows).select("doc_id", "sid")
    kind = F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".html")
    return segs.select("sid", T.short_sid(F.col("sid")).alias("short"), T.safe_id(F.col("sid")).alias("anchor"), T.safe_id(F.col("sid"), "web").alias("web_anchor"), T.clean_id(F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"), kind)).alias("doc"))


def chosen_segments(spark: SparkSession, sf_dir: str) -> Frame:
    """Segments of pages under chosen headings and paths, and those whose ids hold a part."""
    segs = S.section_html(B.sectioned_pages(spark, sf_dir))
    own = S.chosen(segs, ["Deep", "part-1"]).withColumn("how", F.lit("heading"))
    audio = S.chosen_audio(segs, ["#part-2/sub-1#", "fig0"]).withColumn("how", F.lit("id"))
    return own.unionByName(audio).groupBy("how", "doc_id").agg(F.count("*").alias("n"), F.min("sid").alias("first_sid"))


def baseline_check(spark: SparkSession, sf_dir: str) -> Frame:
    """Statistics of documents against a baseline of which every seventh has lost a twentieth of its words."""
    stats = S.document_stats(segments(spark, sf_dir))
    base = K.baseline(stats).withColumn("words", F.when(F.col("doc_id") % 7 == 0, F.floor(F.col("words") * 1.05 + 1)).otherwise(F.col("words")).cast("long"))
    return S.against_baseline(stats, base).select("doc_id", "words", "b_words", "ok")


def library_flags(spark: SparkSession, sf_dir: str) -> Frame:
    """Feed items that have a reader in the library."""
    items = _items(spark, sf_dir)
    library = table(spark, sf_dir, "documents").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("doc_id"))
    return E.in_library(items, library).groupBy("has_reader", "status").agg(F.count("*").alias("n"))


def reader_table(spark: SparkSession, sf_dir: str) -> Frame:
    """What a reader shows of every turn: times, translation, script and source, an entry of contents at each role's first."""
    turns = B.scripts(spark, sf_dir).withColumns({"sid": F.concat("conv_id", F.lit("#"), "turn"), "doc_id": F.col("conv_id"), "seg_pos": F.col("turn")})
    line = M.timeline(turns)
    segs = turns.select("doc_id", "sid", "seg_pos", F.col("role").alias("sec_path"), F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("sec_heading"), F.col("text").alias("src_text"))
    zh = turns.where("turn % 3 <> 0").select("sid", F.concat(F.lit("译"), F.length("text").cast("string")).alias("zh"))
    said = turns.where("turn % 4 <> 0").select("sid", F.concat(F.lit("稿"), F.length("text").cast("string")).alias("script"))
    got = K.reader_rows(segs, line, zh, said)
    return got.select("sid", F.round("start_sec", 2).alias("start_sec"), "toc", "dom_id", "zh", "script")


def translated_sentence_times(spark: SparkSession, sf_dir: str) -> Frame:
    """Times of every turn's lines: the script's where a line of that number is timed, else a share of the turn by length."""
    turns = B.scripts(spark, sf_dir).withColumn("sid", F.concat("conv_id", F.lit("#"), "turn"))
    line = M.timeline(turns, scope="conv_id", order="turn").select("sid", "start_sec", "duration_sec")
    parts = turns.select("sid", F.posexplode(T.zh_sentences(F.col("text"))).alias("ord", "sentence"))
    timed = parts.where("ord % 3 = 1").select("sid", "ord", (F.col("ord") * 2.5).alias("start_sec"), F.when(F.col("ord") % 2 == 0, F.col("ord") * 2.5 + 2).alias("end_sec"))
    return M.sentence_times(parts, timed, line).select("sid", "ord", "start_sec", "end_sec")


def smoothed_spans(spark: SparkSession, sf_dir: str) -> Frame:
    """Spans of every conversation's turns with gaps and overlaps, made contiguous."""
    t = F.col("turn").cast("double")
    span = F.struct(F.col("turn"), (t * 5 + F.col("turn") % 3).alias("start"), (t * 5 + 4 + F.length("text") % 4).cast("double").alias("end"))
    rows = B.scripts(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), (F.max(t) * 5 + 9).alias("total"))
    return rows.select("conv_id", F.posexplode(M.smoothed(F.col("spans"), F.col("total"))).alias("k", "s")).select("conv_id", "k", "s.start", "s.end")


def versioned_segments(spark: SparkSession, sf_dir: str) -> Frame:
    """Documents segmented in two runs: the second reads only those that are new or have another time, and those that had no text once more are not."""
    docs = table(spark, sf_dir, "documents").withColumn("mtime", F.lit(1).cast("long"))
    root = K2.scratch(spark, "segmented")

    def run(mark: str):
        return lambda d: S.text_segments(d).select("doc_id", "sid", "src_hash", F.lit(mark).alias("run"))

    K2.segmented(docs.where("doc_id % 2 = 0"), run("first"), root, "v1")
    later = docs.withColumn("mtime", F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1).cast("long"))
    got, _ = K2.segmented(later, run("second"), root, "v1")
    return got.groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.min("sid").alias("first_sid"))


def staged_run(spark: SparkSession, sf_dir: str) -> Frame:
    """Three stages over all segments, run twice: the second run finds the manifests of the first; then their numbers of rows."""
    root = K2.scratch(spark, "run")
    steps = [("segments", lambda d: S.text_segments(d)), ("long", lambda d: d.where("n_words > 5")), ("sizes", lambda d: d.groupBy("doc_id").agg(F.sum("n_words").alias("words")))]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    K2.run_stages(docs, root, steps)
    _, ran = K2.run_stages(docs, root, steps)
    rows = [K2.manifest(spark, root, name) for name, _ in steps]
    return spark.createDataFrame([(r["stage"], r["rows_in"], r["rows_out"], r["stage"] in ran) for r in rows], "stage string, rows_in long, rows_out long, again boolean")


def status_replay(spark: SparkSession, sf_dir: str) -> Frame:
    """Events of users as states of items: what is accepted, what is refused and why."""
    asked = F.when(F.col("event_id") % 5 == 0, "new").when(F.col("event_id") % 5 < 3, "shown").when(F.col("event_id") % 5 == 3, "picked").otherwise("done")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pmid"), asked.alias("status"), F.when(asked == "shown", F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))).alias("snapshot"), F.col("ts"), "event_id")
    rows = rows.withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)"))
    return ST.replayed(rows).groupBy("asked", "status", "accepted", "reason").agg(F.count("*").alias("n"))


def library_newest(spark: SparkSession, sf_dir: str) -> Frame:
    """The library by date, the newest first, each source's first five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("n_chars").alias("added"))
    return E.by_date(docs, "added", "doc_id", 5, ["source"]).select("source", "doc_id", "added", "rank")


def text_samples(spark: SparkSession, sf_dir: str) -> Frame:
    """What a model is shown of each document to find its terms: segments from the start, of some 200 words."""
    return S.sample(segments(spark, sf_dir), 200).select("doc_id", "n_segments", "n_words", F.md5("text").alias("md5"))


def answers_paid_once(spark: SparkSession, sf_dir: str) -> Frame:
    """Answers to all segments from a store that is filled in three runs, of which the second breaks before its commit; a mark says which run paid."""
    rows = segments(spark, sf_dir).select("doc_id", "sid", F.sha1("src_text").alias("key"), F.col("src_text").alias("prompt"))
    root = K2.scratch(spark, "answers")

    def run(mark: str):
        return lambda prompts, keys: [f"{mark}{len(p)}:{p[:20]}" for p in prompts]

    PU.put_once(rows.where("doc_id % 2 = 0"), "prompt", run("a"), root)
    odd = rows.where("doc_id % 3 = 0").groupBy("key").agg(F.min("prompt").alias("prompt"))
    PU.ask(odd.join(PU.store(spark, root).select("key"), "key", "left_anti"), "prompt", run("b"), root)
    got = PU.put_once(rows, "prompt", run("c"), root)
    return got.groupBy("doc_id", F.substring("value", 1, 1).alias("paid_by"), "cached").agg(F.count("*").alias("n"), F.md5(F.min("value")).alias("md5"))


def browser_feed(spark: SparkSession, sf_dir: str) -> Frame:
    """Documents as records of a search, and what a browser's feed shows of them."""
    d = table(spark, sf_dir, "documents")
    word = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Pathophysiology of "), word)).when(F.col("doc_id") % 3 == 1, F.concat(word, F.lit(" atlas")))
    id_ = F.col("doc_id").cast("string")
    records = d.select(
        id_.alias("pmid"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1038/s"), id_)).alias("doi"), F.col("source").alias("journal"), F.when(F.col("doc_id") % 5 == 0, "Nat Rev").alias("journal_abbr"),
        title.alias("title"), F.col("text").alias("abstract"), F.when(F.col("doc_id") % 7 > 0, "2024").alias("year"), F.when(F.col("doc_id") % 4 == 0, "Mar").alias("month"),
    )
    got = E.browser_items(records, X.rewritten_title)
    return got.select("doi", "doc_id", "title_en", "title_zh", "journal", "pub_date", "brief", F.length("abstract").alias("n_abstract"))


def run_state(spark: SparkSession, sf_dir: str) -> Frame:
    """Fields and checkpoints of three runs over all segments, as the third leaves them."""
    segs = segments(spark, sf_dir).select("doc_id", "sid")
    root = K2.scratch(spark, "state")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    marks = lambda rows, kind, value: rows.select("doc_id", F.lit(kind).alias("kind"), "sid", F.lit(value).alias("value"))
    K2.save_state(spark, root, docs.select("doc_id", F.col("source").alias("field")), marks(segs, "translations", "one"))
    K2.save_state(spark, root, docs.where("doc_id % 2 = 0").select("doc_id", F.lit(None).cast("string").alias("field")), marks(segs.where("doc_id % 2 = 0"), "scripts", "two"))
    last = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("field"))
    now, kept = K2.save_state(spark, root, last, marks(segs.where("doc_id % 3 = 0 and sid like '%1'"), "translations", "three"))
    n = lambda value: F.count_if(F.col("value") == value).alias(f"n_{value}")
    return kept.groupBy("doc_id").agg(n("one"), n("two"), n("three")).join(now, "doc_id", "full")


def glossary_files(spark: SparkSession, sf_dir: str) -> Frame:
    """Sources as glossaries of the documents' first words, written as files of each scope: their number of lines and digest."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.regexp_extract("text", r"([A-Za-z]+)", 1).alias("term")).where("term <> ''")
    first = d.groupBy("source", "term").agg(F.min("doc_id").alias("ord"))
    note = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("of "), F.col("ord").cast("string"))).otherwise("")
    aliases = F.when(F.col("ord") % 3 == 0, F.array(F.lower("term"))).otherwise(F.array().cast("array<string>"))
    terms = first.select(
        "ord", "term", F.concat(F.lit("译"), F.col("term")).alias("zh"), F.lit(G.HINT).alias("mode"), note.alias("note"), aliases.alias("aliases"), F.lit(None).cast("string").alias("pattern"),
        F.lit(True).alias("prefix_variants"), F.lit("approved").alias("status"), F.concat(F.lit("field:"), "source").alias("scope"), F.lit("").alias("full_en"),
    )
    return K.glossary_yaml(terms).select("scope", (F.size(F.split("content", "\n")) - 2).alias("n"), F.md5("content").alias("md5"))


def example_chat_models(spark: SparkSession, sf_dir: str) -> Frame:
    return R.models(spark.createDataFrame([(m,) for m in B.MODELS], "name string"))


def example_hard_replace_by_document(spark: SparkSession, sf_dir: str) -> Frame:
    """Each translation by its own document's resolved glossary."""
    rows = spark.createDataFrame([r[:3] for r in B.TRANSLATED], "doc_id string, id int, zh string")
    return G.replaced_by_document(rows, G.resolve(*_scoped(spark))).select("doc_id", "id", "zh")


def example_mined_terms(spark: SparkSession, sf_dir: str) -> Frame:
    got = G.mined(spark.createDataFrame(B.MINED, "doc_id string, text string"))
    return got.select("doc_id", "term", "zh", "mode", "note", F.array_join("aliases", ",").alias("aliases"), "scope", "status")


def example_pending_terms(spark: SparkSession, sf_dir: str) -> Frame:
    return G.pending_terms(_defs(spark)[0])


def abbr_unused(spark: SparkSession, sf_dir: str) -> Frame:
    """Names of nations as abbreviations that a document defines and never uses."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    names = docs.select("doc_id", F.explode(F.array(F.lit("The"), F.lit("Und"), F.lit("Que"))).alias("abbr"))
    return A.unused(names, docs.where("text is not null"))


def library_documents(spark: SparkSession, sf_dir: str) -> Frame:
    """Nations' glossaries by region, and the library's documents that have none."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = n.where("n_nationkey < 9").groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.lit("").alias("title"), F.collect_list("n_name").alias("terms"))
    return G.documents_with_glossaries(own, r.select(F.col("r_regionkey").cast("string").alias("doc_id"), F.col("r_name").alias("title")))


def qa_char_totals(spark: SparkSession, sf_dir: str) -> Frame:
    return Q.char_totals(_pairs(spark, sf_dir))


def audio_totals(spark: SparkSession, sf_dir: str) -> Frame:
    rows = B.scripts(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "duration_sec", F.when(F.col("turn") % 5 == 0, "failed").alias("error"))
    return Q.audio_totals(rows).select("doc_id", F.round("total_sec", 2).alias("total_sec"), "n_failed")


def feed_dropped_report(spark: SparkSession, sf_dir: str) -> Frame:
    return E.dropped_report(E.split_kept(_items(spark, sf_dir))[1])


def stage_stats(spark: SparkSession, sf_dir: str) -> Frame:
    k = F.col("seg_pos") + F.col("doc_id")
    rows = segments(spark, sf_dir).select("doc_id", F.when(k % 2 == 0, "a").otherwise("b").alias("stage"), F.when(k % 7 == 0, "[翻译失败: x]").when(k % 5 == 0, " ").otherwise("ok").alias("value"))
    return C.stage_stats(rows)


def script_positions(spark: SparkSession, sf_dir: str) -> Frame:
    """Where a turn stands in its conversation, for its prompt."""
    rows = B.scripts(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_pos"))
    return C.staged(rows, "first", "rest").select("doc_id", "seg_pos", F.col("seg_idx").cast("int").alias("seg_idx"), "total_segs", "stage")


def example_title_heuristics(spark: SparkSession, sf_dir: str) -> Frame:
    return spark.createDataFrame(B.PAPER_TITLES, "id int, title string").select("id", X.rewritten_title(F.col("title")).alias("title"))


def example_default_terms(spark: SparkSession, sf_dir: str) -> Frame:
    return G.stats(X.default_terms(spark))


def example_landing_examples(spark: SparkSession, sf_dir: str) -> Frame:
    rows = spark.createDataFrame(B.LANDED, "doc_id string, sid string, seg_pos int, src_text string, zh string")
    return G.landing_examples(rows, G.terms_frame(spark, B.LANDED_TERMS))


def example_health_of_sections(spark: SparkSession, sf_dir: str) -> Frame:
    pages = spark.createDataFrame(B.NESTED_PAGES, "doc_id string, html string")
    return S.health(S.section_html(pages)).select("doc_id", "warnings")


def page_widths(spark: SparkSession, sf_dir: str) -> Frame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").alias("width"))
    return L.page_widths(rows)


def queries() -> dict:
    return {k: f for k, f in _own().items() if not k.startswith("example_")}


def examples() -> dict:
    """The same operators on small rows of which the result is known: they read no table and are run by the tests alone."""
    return {k.removeprefix("example_"): f for k, f in _own().items() if k.startswith("example_")}


def _own() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "examples")}
