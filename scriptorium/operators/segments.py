"""Documents as ordered, fingerprinted segments: HTML and plain text, sections, ids, statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import markup
from scriptorium.functions import text as T

# Sections that are no body text, per dialect.
SKIP_SECTIONS = ["inline recommendations", "references", "author information", "ethics declarations", "peer review", "additional information", "rights and permissions", "about this article"]
WEB_SKIP_SECTIONS = [*SKIP_SECTIONS, "acknowledgements", "supplementary information", "related links", "change history", "data availability"]


#: What opens or closes a paragraph.
PARAGRAPH = r"<p\b[^>]*>|</p>"


def article(html: Column) -> Column:
    """A page's article, else its body, else all of it."""
    inner = F.regexp_extract(html, r"(?s)<article\b[^>]*>(.*)</article>", 1)
    body = F.regexp_extract(html, r"(?s)<body\b[^>]*>(.*)</body>", 1)
    return F.when(F.length(inner) > 0, inner).when(F.length(body) > 0, body).otherwise(html)


def numbered(pieces: Column) -> Column:
    """(seg_pos, src_text) of the pieces that stay, numbered from 1 in the row: no shuffle, no sort."""
    return F.transform(pieces, lambda t, i: F.struct((i + 1).alias("seg_pos"), t.alias("src_text")))


def flat_html(pages: DataFrame) -> DataFrame:
    """(page_id, seg_pos, src_text, n_words, src_hash): paragraphs of pages without sections.

    A paragraph runs from a paragraph tag to the next one or the article's end; short ones go."""
    parts = F.split(article(F.col("html")), PARAGRAPH, -1)
    tidy = lambda p: F.trim(F.regexp_replace(T.unescape(F.regexp_replace(p, "<[^>]+>", "")), "[ \\t\\n\\r]+", " "))
    texts = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), tidy)
    kept = F.filter(texts, lambda t: F.size(F.split(t, " ")) >= 3)
    rows = pages.select("page_id", F.inline(numbered(kept)))
    return rows.select("page_id", "seg_pos", "src_text", F.size(F.split("src_text", " ")).alias("n_words"), F.sha1("src_text").alias("src_hash"))


def html_title(html: Column, fallback: Column) -> Column:
    """The article's heading, else the page title before a bar, else the fallback."""
    h1 = F.regexp_extract(html, r'(?s)<h1[^>]*class="[^"]*c-article-title[^"]*"[^>]*>(.*?)</h1>', 1)
    title = F.get(F.split(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), r"\|"), F.lit(0))
    tidy = lambda c: F.trim(T.unescape(F.regexp_replace(c, "<[^>]+>", "")))
    return F.when(F.length(tidy(h1)) > 0, tidy(h1)).when(F.length(F.trim(title)) > 0, F.trim(T.unescape(title))).otherwise(fallback)


def _blocks(read: Callable[[str | None, frozenset[str]], list[tuple]], skip: list[str]) -> Callable[[Column], Column]:
    """A page's blocks as an array, one pass over each page.

    Rows are pickled, by hundreds: an Arrow batch holds thousands of pages and all their blocks in a worker at once."""
    leave = frozenset(skip)

    @F.udf(f"array<struct<{markup.BLOCK.replace(' ', ':').replace(',:', ',')}>>", useArrow=False)
    def of(html: str | None) -> list[tuple]:
        return read(html, leave)

    return of


def _sections(rows: DataFrame) -> DataFrame:
    """With `s`: struct(at, n, place) of each run of the blocks `b` under one heading: its first block, how many there are, its own number.

    Step by step, for what a lambda names is worked out again for each element."""
    every = F.when(F.size("b") > 0, F.sequence(F.lit(0), F.size("b") - 1)).otherwise(F.array().cast("array<int>"))
    new = lambda i: (i == 0) | (F.get("b", i)["sec"] != F.get("b", F.greatest(i - 1, F.lit(0)))["sec"])
    rows = rows.withColumn("starts", F.filter(every, new))
    return rows.withColumn("s", F.transform("starts", lambda at, j: F.struct(at.alias("at"), (F.coalesce(F.get("starts", j + 1), F.size("b")) - at).alias("n"), j.alias("place"))))


def _page_segments(pages: DataFrame, blocks: Column, dialect: str, labelled: str, first: Callable[[Column], Column], then: Callable[[Column], Column] | None = None) -> DataFrame:
    """Segments of pages whose blocks are known. All is done in a page's own row: no text is shuffled, nothing sorted.

    `first` says which texts make a section, `then` which of these are its segments."""
    html = dialect == "html"

    def read(b: Column) -> Column:
        items = F.size(b["items"]) > 0
        if html or labelled == "Fig 说明":
            raw = F.when(items, T.list_paragraph(b["raw"], b["items"])).otherwise(b["raw"])
        else:
            raw = F.when(items, F.concat_ws(" ", b["raw"], F.array_join(b["items"], "; "))).otherwise(b["raw"])
        label = F.when(b["is_figure"], F.coalesce(F.nullif(T.clean_paragraph(b["label"]), F.lit("")), F.lit(labelled))).otherwise("")
        return F.struct(b["main"].alias("main"), b["heading"].alias("heading"), b["level"].alias("level"), b["sec"].alias("sec"), b["is_figure"].alias("is_figure"), b["in_box"].alias("in_box"), label.alias("fig_label"), T.clean_paragraph(raw, dialect).alias("text"))

    rows = pages.select("doc_id", F.filter(F.transform(blocks, read), lambda b: first(b["text"])).alias("b"))
    rows = _sections(rows)

    def path(s: Column) -> Column:
        b = F.get("b", s["at"])
        if not html:
            return F.format_string("s%03d-%s", s["place"], T.web_slug(b["heading"]))
        return F.when(b["level"] == 1, T.slug(b["main"])).otherwise(F.concat(T.slug(b["main"]), F.lit("/"), T.slug(b["heading"])))

    rows = rows.withColumn("p", F.transform("s", path))
    if html:  # headings that repeat get paths of their own, so ids stay unique
        same = lambda x, j: F.size(F.filter(F.slice("p", 1, j + 1), lambda y: y == x))
        rows = rows.withColumn("p", F.transform("p", lambda x, j: F.when(same(x, j) > 1, F.concat(x, F.lit("-"), same(x, j).cast("string"))).otherwise(x)))

    def segments(s: Column) -> Column:
        own = F.slice("b", s["at"] + 1, s["n"])
        own = own if then is None else F.filter(own, lambda b: then(b["text"]))
        return F.transform(own, lambda b, i: F.struct(F.get("p", s["place"]).alias("sec_path"), (i + 1).alias("at"), b.alias("b")))

    flat = F.flatten(F.transform("s", segments))
    rows = rows.select("doc_id", F.posexplode(flat).alias("pos", "x")).select("doc_id", "pos", "x.sec_path", "x.at", "x.b.*")
    doc = F.col("doc_id").cast("string")
    if html:
        sid = F.when(F.col("is_figure"), F.format_string("%s#%s#fig%02d", doc, "sec_path", F.col("at"))).otherwise(T.segment_id(F.col("doc_id"), F.col("sec_path"), F.col("at")))
    else:
        sid = F.format_string("%s:%s:p%02d", doc, "sec_path", F.col("at"))
    return rows.select(
        "doc_id", sid.alias("sid"), "sec_path", F.col("heading").alias("sec_heading"), F.col("level").alias("sec_level"), (F.col("at") if html else F.col("pos")).alias("index"), (F.col("pos") + 1).alias("seg_pos"),
        F.col("text").alias("src_text"), T.word_count(F.col("text"), dialect).alias("n_words"), "in_box", "is_figure", "fig_label", F.sha1("text").alias("src_hash"),
    )


def section_html(pages: DataFrame, dialect: str = "html") -> DataFrame:
    """Segments of `pages(doc_id, html)` with titled sections: figures first, then headings and paragraphs in reading order.

    Repeated sub-headings of a section get paths of their own, so ids stay unique. `dialect` web: the browser's ids, texts and skipped sections."""
    skip = SKIP_SECTIONS if dialect == "html" else WEB_SKIP_SECTIONS
    blocks = _blocks(markup.section_blocks, skip)(F.col("html"))
    return _page_segments(pages, blocks, dialect, "Fig 说明", lambda t: T.word_count(t) >= 3)


def browser_html(pages: DataFrame) -> DataFrame:
    """Segments of `pages(doc_id, html)` as the browser makes them: the abstract, then sections of the article's container; boxes are marked.

    Texts of under 15 characters without a full stop go, but count where their section is numbered."""
    blocks = _blocks(markup.browser_blocks, WEB_SKIP_SECTIONS)(F.col("html"))
    return _page_segments(pages, blocks, "web", "Fig", lambda t: F.length(t) > 0, lambda t: (F.length(t) >= 15) | t.endswith("."))


def unique_paths(rows: DataFrame, scope: list[str], path: str, order: list[str]) -> DataFrame:
    """sec_path: the path, with -2, -3 ... for later sections of the same path."""
    n = F.dense_rank().over(Window.partitionBy(*scope, path).orderBy(*order))
    return rows.withColumn("__n", n).withColumn("sec_path", F.when(F.col("__n") > 1, F.concat(F.col(path), F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col(path))).drop("__n")


def with_ids(rows: DataFrame, order: list[str], dialect: str = "html") -> DataFrame:
    """index (in its section), seg_pos (in its document) and sid; a repeated sid gets -dupN."""
    index = F.row_number().over(Window.partitionBy("doc_id", "sec_path").orderBy(*order))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    rows = rows.withColumns({"index": index, "seg_pos": pos})
    if dialect == "web":
        sid = F.format_string("%s:%s:p%02d", F.col("doc_id").cast("string"), "sec_path", F.col("index"))
        rows = rows.withColumn("sid", sid).withColumn("index", F.col("seg_pos") - 1)
        sid = F.col("sid")
    elif "is_figure" in rows.columns:
        sid = F.when(F.col("is_figure"), F.format_string("%s#%s#fig%02d", F.col("doc_id").cast("string"), "sec_path", F.col("index"))).otherwise(T.segment_id(F.col("doc_id"), F.col("sec_path"), F.col("index")))
    else:
        sid = T.segment_id(F.col("doc_id"), F.col("sec_path"), F.col("index"))
    # A path holds no `#`: such an id repeats in its own document alone, and rows stay where that is.
    return deduplicated(rows.withColumn("sid", sid), "sid", ["seg_pos"], [] if dialect == "web" else ["doc_id"])


def deduplicated(rows: DataFrame, sid: str, order: list[str], scope: Sequence[str] = ()) -> DataFrame:
    """An id that repeats (in its scope, if one is given) gets -dupN."""
    n = F.row_number().over(Window.partitionBy(*scope, sid).orderBy(*order))
    return rows.withColumn("__n", n).withColumn(sid, F.when(F.col("__n") > 1, F.concat(F.col(sid), F.lit("-dup"), F.col("__n").cast("string"))).otherwise(F.col(sid))).drop("__n")


def text_lines(text: Column) -> Column:
    """The non-blank lines of a text, trimmed."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda t: F.trim(t)), lambda t: F.length(t) > 0)


def text_segments(docs: DataFrame) -> DataFrame:
    """Segments of `docs(doc_id, text, ...)`: its non-blank lines, as one section `body`; numbered in the row, without a shuffle."""
    rows = docs.select("doc_id", F.inline(numbered(text_lines(F.col("text"))))).withColumn("sec_path", F.lit("body"))
    sid = T.segment_id(F.col("doc_id"), F.col("sec_path"), F.col("seg_pos"))
    n_words = T.word_count(F.col("src_text"), "pdf")
    return rows.select(
        "doc_id", sid.alias("sid"), "sec_path", F.col("seg_pos").alias("index"), "seg_pos", "src_text", n_words.alias("n_words"), F.sha1("src_text").alias("src_hash")
    )


def web_flat(pages: DataFrame) -> DataFrame:
    """The browser's fallback for pages without sections: one section `Introduction`, short pieces without a full stop go."""
    flat = flat_html(pages.withColumnRenamed("doc_id", "page_id") if "doc_id" in pages.columns else pages)
    keep = flat.where(~((F.length("src_text") < 15) & ~F.col("src_text").endswith(".")))
    return keep.withColumns({"sec_heading": F.lit("Introduction"), "sec_path": F.lit("s001-introduction")})


def abstract_document(doc_id: Column, title: Column, abstract: Column) -> list[Column]:
    """A document of one segment, made from an abstract alone."""
    return [doc_id.alias("doc_id"), title.alias("title"), T.segment_id(doc_id, F.lit("abstract"), F.lit(1)).alias("sid"), F.lit("abstract").alias("sec_path"), F.lit("Abstract").alias("sec_heading"), F.lit(1).alias("index"), abstract.alias("src_text")]


def document_stats(segments: DataFrame, key: str = "doc_id", section: str | None = "sec_path") -> DataFrame:
    """Sections, segments, words, the upper median and the largest segment."""
    sections = F.count_distinct(section) if section else F.lit(1)
    return segments.groupBy(key).agg(
        sections.cast("long").alias("sections"), F.count("*").alias("segments"), F.sum("n_words").cast("long").alias("words"), T.upper_median(F.collect_list("n_words")).cast("int").alias("median_words"), F.max("n_words").alias("max_words")
    )


def fill_forward(rows: DataFrame, scope: list[str], order: list[str], heading: str = "heading", level: str = "level", levels: int = 3) -> DataFrame:
    """The heading of each level that is current at a row; a heading ends those of deeper levels."""
    run = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(*order)
    # All levels in one step: their windows share a pass over the rows.
    found = {}
    for n in range(1, levels + 1):
        own = F.last(F.when(F.col(level) == n, F.struct(key.alias("at"), F.col(heading).alias("h"))), ignorenulls=True).over(run)
        above = F.last(F.when(F.col(level) < n, key), ignorenulls=True).over(run)
        found[f"h{n}"] = F.when(above.isNull() | (own["at"] > above), own["h"])
    return rows.withColumns(found)


def first_in_section(segments: DataFrame) -> DataFrame:
    """head_change: the section differs from the row before; head_first: its first row of all."""
    order = Window.partitionBy("doc_id").orderBy("seg_pos")
    first = F.row_number().over(Window.partitionBy("doc_id", "sec_path").orderBy("seg_pos"))
    return segments.withColumns({"head_change": ~F.col("sec_path").eqNullSafe(F.lag("sec_path").over(order)), "head_first": first == 1})


def prose(segments: DataFrame, separator: str = "\n\n") -> DataFrame:
    """A document's text in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_pos", "src_text")))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["src_text"]), separator).alias("text"))


def chosen(segments: DataFrame, want: list[str], limit: int | None = None) -> DataFrame:
    """Segments whose id, path or heading is wanted (all, if nothing is), the first `limit` of them."""
    rows = segments if not want else segments.where(F.col("sid").isin(want) | F.col("sec_path").isin(want) | F.col("sec_heading").isin(want))
    return rows if limit is None else rows.orderBy("doc_id", "seg_pos").limit(limit)


def chosen_audio(segments: DataFrame, parts: list[str], limit: int | None = None) -> DataFrame:
    rows = segments if not parts else segments.where(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains("sid", p)))
    return rows if limit is None else rows.orderBy("doc_id", "seg_pos").limit(limit)


def word_budget(segments: DataFrame, words: int = 5000) -> DataFrame:
    """Segments as long as those before them hold no more than the budget."""
    before = F.coalesce(F.sum("n_words").over(Window.partitionBy("doc_id").orderBy("seg_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("words_before", before).where(F.col("words_before") <= words)


def sample(segments: DataFrame, words: int = 5000) -> DataFrame:
    """(doc_id, text, n_words, n_segments): a document's segments from the start, as long as those before them hold no more than the budget."""
    own = word_budget(segments, words)
    ordered = F.array_sort(F.collect_list(F.struct("seg_pos", "src_text")))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["src_text"]), "\n\n").alias("text"), F.sum("n_words").cast("long").alias("n_words"), F.count("*").alias("n_segments"))


def grep_context(rows: DataFrame, pattern: str, around: int, scope: str = "doc_id", order: str = "seg_pos", text: str = "src_text") -> DataFrame:
    """Rows that match, and those within `around` rows of one."""
    hit = F.col(text).rlike(f"(?i){pattern}").cast("int")
    near = F.max(hit).over(Window.partitionBy(scope).orderBy(order).rowsBetween(-around, around))
    return rows.withColumns({"hit": hit, "near": near}).where("near = 1").drop("near")


def health(segments: DataFrame) -> DataFrame:
    """Cleanliness: the share of segments that neither start in lower case nor lack a closing mark; warnings by thresholds.

    Segments with headings are also judged by these: fewer than three of the first level, or one that is very short or a caption's."""
    text = F.col("src_text")
    low, open_end = F.count_if(text.rlike(r"^\p{Ll}")), F.count_if(~F.regexp_replace(text, "[\"’”)]+$", "").rlike("[.?!:]$"))
    titled = "sec_heading" in segments.columns and "sec_level" in segments.columns
    heads = F.collect_set(F.when(F.col("sec_level") == 1, F.col("sec_heading"))) if titled else F.lit(None).cast("array<string>")
    got = segments.groupBy("doc_id").agg(
        F.count("*").alias("segments"), low.alias("lower_starts"), open_end.alias("open_ends"), F.max("n_words").alias("max_words"), heads.alias("__heads")
    )
    got = got.withColumn("cleanliness", F.round(1 - (F.col("lower_starts") + F.col("open_ends")) / (2 * F.col("segments")), 4))
    odd = F.exists("__heads", lambda h: (F.length(h) < 4) | F.lower(h).startswith("fig") | F.lower(h).startswith("table"))
    warnings = [
        F.when(F.col("segments") < 20, "few_segments"), F.when(F.col("max_words") > 600, "long_segment"),
        F.when(F.size("__heads") < 3, "few_headings") if titled else F.lit(None), F.when(odd, "odd_heading") if titled else F.lit(None),
    ]
    return got.withColumn("warnings", F.array_join(F.array_compact(F.array(*warnings)), ",")).drop("__heads")


def invariants(segments: DataFrame) -> DataFrame:
    """Breaches: repeated ids, headings that share a path, segments too short or too long, table residue."""
    dup = segments.groupBy("sid").count().where("count > 1").select(F.lit("duplicate_sid").alias("rule"), F.col("sid").alias("what"))
    size = segments.where("n_words < 3 or n_words > 420").select(F.lit("size").alias("rule"), F.col("sid").alias("what"))
    table = segments.where(F.col("src_text").rlike(r"<t[dr]\b|\t.*\t")).select(F.lit("table").alias("rule"), F.col("sid").alias("what"))
    out = dup.unionByName(size).unionByName(table)
    if "sec_heading" in segments.columns:
        path = segments.groupBy("doc_id", "sec_path").agg(F.count_distinct("sec_heading").alias("n")).where("n > 1").select(F.lit("shared_path").alias("rule"), F.col("sec_path").alias("what"))
        lower = segments.where(F.col("sec_heading").rlike("^[a-z]")).select(F.lit("lower_heading").alias("rule"), F.col("sec_heading").alias("what")).distinct()
        out = out.unionByName(path).unionByName(lower)
    return out


def against_baseline(stats: DataFrame, baseline: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Word counts within a tolerance of a baseline, and at least its number of sections."""
    b = baseline.select("doc_id", F.col("sections_min").alias("b_sections"), F.col("words").alias("b_words"))
    ok = F.col("words").between(F.col("b_words") * (1 - tolerance), F.col("b_words") * (1 + tolerance)) & (F.col("sections") >= F.col("b_sections"))
    return stats.join(b, "doc_id").withColumn("ok", ok)
