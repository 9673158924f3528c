"""Segmentation of laid-out text lines: layout inference, classification, reading order, paragraphs.

Lines are a table (doc_id, page, y0, x0, x1, text, raw, sizes array<double>, font_chars map<string,int>,
bold, all_bold, head_text, rest_text); rectangles are (doc_id, page, x0, y0, x1, y1). Decoding page files
is outside: these tables come from any extractor. All windows run inside one document.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import segments as S

# Thresholds in points and shares.
BODY_MIN_SHARE, BODY_TOLERANCE, HEADING_FACTOR = 0.15, 0.7, 1.25
INDENT_MIN, RIGHT_TOLERANCE, WINDOW, MIN_WINDOW = 8.0, 12.0, 5, 5
REGION_MIN_W, REGION_MIN_H, REGION_MAX_AREA = 110.0, 70.0, 0.95
PROSE_MIN_LENGTH, PROSE_TOLERANCE = 50, 0.35
SKIP_STRINGS = ["nature reviews neuroscience", "review article"]
LABEL_STRINGS = ["glossary", "key points", "outstanding questions", "sections", "supplementary information", "author information"]
TITLE_SKIP = r"(?i)^(nature reviews|nature\b|reviews?\b|primer|perspective|comment|news|review article|article|editorial|correspondence|check for updates)"
CAPTION = r"(?i)^(Fig\.|Figure|Table|Box|Extended Data)\s*[0-9]"
PANEL_LABEL = r"^[a-h]\s{2,}\S"
THREE_LETTERS = r"[A-Za-z][^A-Za-z]*+[A-Za-z][^A-Za-z]*+[A-Za-z]"
THREE_WORDS = r"(?U)\S++\s++\S++\s++\S"


def region_rects(drawings: DataFrame, images: DataFrame) -> DataFrame:
    """Rectangles large enough to be boxes; drawings of nearly a whole page are background. Both have page_w and page_h."""
    big = (F.col("x1") - F.col("x0") >= REGION_MIN_W) & (F.col("y1") - F.col("y0") >= REGION_MIN_H)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= REGION_MAX_AREA * F.col("page_w") * F.col("page_h")
    cols = ["doc_id", "page", "x0", "y0", "x1", "y1"]
    return drawings.where(big & area).select(*cols).unionByName(images.where(big).select(*cols))


def gather(spans: DataFrame) -> DataFrame:
    """Lines from spans(doc_id, page, line, seq, dir_x, dir_y, size, flags, font, text, x0, y0, x1): horizontal ones, without blanks and small superscripts."""
    rows = spans.where("dir_x = 1 and dir_y = 0 and length(trim(text)) > 0").where(~((F.col("flags").bitwiseAND(1) != 0) & (F.col("size") < 7.0)))
    rows = rows.withColumns({"bold": T.is_bold(F.col("font"), F.col("flags")), "family": T.font_family(F.col("font"))})
    # Spans go to their page once and are sorted there; a line is a run of its page's spans.
    items = F.sort_array(F.collect_list(F.struct("line", "seq", "text", "size", "bold", "family", "x0", "y0", "x1")))
    pages = rows.repartition("doc_id", "page").groupBy("doc_id", "page").agg(items.alias("s"))
    of = lambda k: F.get("s", k)["line"]
    pages = pages.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: (k == 0) | ~of(k).eqNullSafe(of(F.greatest(k - 1, F.lit(0))))))
    runs = F.transform("at", lambda a, j: F.slice("s", a + 1, F.coalesce(F.get("at", j + 1), F.size("s")) - a))
    lines = pages.select("doc_id", "page", F.explode(runs).alias("i"))
    lines = lines.withColumns({"x0": F.array_min("i.x0"), "y0": F.array_min("i.y0"), "x1": F.array_max("i.x1")})
    lead = F.aggregate(F.col("i"), F.struct(F.lit("").alias("t"), F.lit(True).alias("on")), lambda a, s: F.struct(F.when(a["on"] & s["bold"], F.concat(a["t"], s["text"])).otherwise(a["t"]).alias("t"), (a["on"] & s["bold"]).alias("on")))["t"]
    fonts = F.aggregate(F.col("i"), F.create_map().cast("map<string,int>"), lambda a, s: F.map_concat(F.map_filter(a, lambda k, v: k != s["family"]), F.create_map(s["family"], F.coalesce(F.try_element_at(a, s["family"]), F.lit(0)) + F.length(s["text"]))))
    # Most lines are one span, of which nothing need be put together.
    one, first = F.size("i") == 1, F.get("i", F.lit(0))
    made = [
        F.when(one, first["text"]).otherwise(F.array_join(F.transform("i", lambda s: s["text"]), "")).alias("raw"), F.col("i.size").alias("sizes"), F.when(one, F.create_map(first["family"], F.length(first["text"]))).otherwise(fonts).alias("font_chars"),
        first["bold"].alias("bold"), F.when(one, first["bold"]).otherwise(F.forall("i", lambda s: s["bold"])).alias("all_bold"), F.when(one, F.when(first["bold"], first["text"]).otherwise("")).otherwise(lead).alias("lead"),
    ]
    lines = lines.select("doc_id", "page", "y0", "x0", "x1", *made)
    # What is read more than once below is a generator's value: a line's text is put together and cleaned once.
    lines = lines.withColumn("text", F.explode(F.array(T.clean(F.col("raw")))))
    parts = {"head_text": F.trim("lead"), "rest_text": F.trim(F.substring("raw", F.length("lead") + 1, F.length("raw")))}
    lines = lines.withColumns(parts).select("doc_id", "page", "y0", "x0", "x1", "text", "raw", "sizes", "font_chars", "bold", "all_bold", "head_text", "rest_text")
    # Small letters are as many as the great ones or more: what is longer than all known strings is none of them.
    brief, low = F.length("text") <= max(map(len, [*LABEL_STRINGS, *SKIP_STRINGS])), F.lower(F.trim("text"))
    skip = brief & low.isin(SKIP_STRINGS)
    header = (F.col("y0") < 55) & brief & low.isin(*LABEL_STRINGS, *SKIP_STRINGS)
    footer = (F.col("y0") > 750) & F.col("text").rlike(r"(?i)nature reviews|doi\.org|^[0-9]+$")
    return lines.where(~(skip | header | footer))


def dominant_font(chars: Column) -> Column:
    """The font of most characters; of equal ones the first by name."""
    best = F.array_min(F.transform(F.map_entries(chars), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("f"))))
    return F.when(F.size(chars) == 1, F.get(F.map_keys(chars), F.lit(0))).otherwise(F.coalesce(best["f"], F.lit("")))


def in_rects(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """Lines with in_rect: their middle lies in a rectangle of their page, two points aside."""
    x, y = (F.col("x0") + F.col("x1")) / 2, F.col("y0")
    # The rectangles of a page come as one row to its lines: no line is joined with its own copy, and none is sorted for it.
    r = rects.where("doc_id is not null and page is not null").groupBy("doc_id", "page").agg(F.collect_set(F.struct("x0", "y0", "x1", "y1")).alias("__rects"))
    inside = F.exists("__rects", lambda b: x.between(b["x0"] - 2, b["x1"] + 2) & y.between(b["y0"] - 2, b["y1"] + 2))
    return lines.join(r.hint("shuffle_hash"), ["doc_id", "page"], "left").withColumn("in_rect", F.coalesce(inside, F.lit(False))).select(*lines.columns, "in_rect")


def measures(lines: DataFrame) -> DataFrame:
    """(doc_id, what, size, font, x0, n): what a layout is inferred from, counted in one pass over the lines.

    `size`: characters by size; `font`: characters by a line's largest size and font; `edge`: lines of prose length by largest
    size, dominant font and left edge; `line`: one row for each document."""
    # Lines alike are counted first: a document has few sizes, fonts and left edges. A line of one font has its characters
    # added up, one of several keeps them with their fonts.
    one, n = F.size("font_chars") == 1, F.length("text").cast("long")
    counts = F.transform(F.array_sort(F.map_entries("font_chars")), lambda e: F.struct(e["key"].alias("font"), e["value"].cast("long").alias("n")))
    fonts = F.when(one, F.array(F.struct(F.get(F.map_keys("font_chars"), F.lit(0)).alias("font"), F.lit(None).cast("long").alias("n")))).otherwise(counts)
    prose = F.length("text") >= PROSE_MIN_LENGTH
    alike = lines.select(
        "doc_id", "sizes", fonts.alias("fonts"), F.coalesce(prose, F.lit(False)).alias("prose"), F.when(prose, dominant_font(F.col("font_chars"))).alias("font"), F.when(prose, F.col("x0")).alias("x0"),
        n.alias("n"), F.when(one, F.get(F.map_values("font_chars"), F.lit(0)).cast("long")).alias("own"),
    )
    alike = alike.groupBy("doc_id", "sizes", "fonts", "prose", "font", "x0").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.count("*").alias("times")).withColumn("top", F.array_max("sizes"))

    def row(what, n, size=F.lit(None), font=F.lit(None), x0=F.lit(None)):
        return F.struct(F.lit(what).alias("what"), size.cast("double").alias("size"), font.cast("string").alias("font"), x0.cast("double").alias("x0"), n.cast("long").alias("n"))

    none = F.array().cast("array<struct<what:string,size:double,font:string,x0:double,n:bigint>>")
    by_size = F.transform(F.filter("sizes", lambda s: s.between(5.0, 16.0)), lambda s: row("size", F.col("n"), F.round(s, 1)))
    by_font = F.transform("fonts", lambda e: row("font", F.coalesce(e["n"] * F.col("times"), F.col("own")), F.col("top"), e["font"]))
    edge = F.when(F.col("prose"), F.array(row("edge", F.col("times"), F.col("top"), F.col("font"), F.col("x0")))).otherwise(none)
    rows = alike.select("doc_id", F.inline(F.concat(F.array(row("line", F.lit(0))), F.coalesce(by_size, none), F.coalesce(by_font, none), edge)))
    return rows.groupBy("doc_id", "what", "size", "font", "x0").agg(F.sum("n").alias("n"))


def body_size(counts: DataFrame) -> DataFrame:
    """(doc_id, body_size) from measures(): the largest of the sizes that hold a good share of the characters, else the commonest, else 9."""
    hist = counts.where("what = 'size'").withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    got = hist.groupBy("doc_id").agg(F.max(F.when((F.col("n") >= F.col("total") * BODY_MIN_SHARE) & (F.col("size") <= 13.0), F.col("size"))).alias("best"), F.max_by("size", F.struct("n", "size")).alias("mode"))
    return counts.where("what = 'line'").select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce("best", "mode", F.lit(9.0)).alias("body_size"))


def body_font(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, body_size, body_font): the font of most characters among lines of about the body size."""
    near = counts.where("what = 'font'").join(sizes, "doc_id").where(F.abs(F.col("size") - F.col("body_size")) <= BODY_TOLERANCE)
    fonts = near.groupBy("doc_id", "font").agg(F.sum("n").alias("n"))
    got = fonts.groupBy("doc_id").agg(F.min_by("font", F.struct(-F.col("n"), "font")).alias("body_font"))
    return sizes.join(got, "doc_id", "left").withColumn("body_font", F.coalesce("body_font", F.lit("")))


def histogram(prose: DataFrame, width: int = 5, weight: str | None = None) -> DataFrame:
    """Left edges in buckets, those that hold enough lines; `weight` counts the lines of a row."""
    rows = prose.groupBy("doc_id", (F.floor(F.floor("x0") / width) * width).cast("int").alias("bucket")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    return rows.where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * 0.08)).select("doc_id", "bucket", "n")


def gap_clusters(rows: DataFrame, scope: str, value: str, gap: float, weight: str | None = None) -> DataFrame:
    """(scope, cluster, centre, n): values in order, a new cluster after a gap; centres weighted."""
    order = Window.partitionBy(scope).orderBy(value)
    rows = rows.withColumn("__new", F.when(F.col(value) - F.lag(value).over(order) > gap, 1).otherwise(0))
    rows = rows.withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    w = F.col(weight) if weight else F.lit(1)
    return rows.groupBy(scope, "cluster").agg((F.sum(F.col(value) * w) / F.sum(w)).alias("centre"), F.sum(w).cast("long").alias("n"))


def layout(lines: DataFrame, page_width: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """One row per document: body_size, body_font, split_x, n_columns, bases (left edge of each column).

    Lines are read once, for their measures; all else is made of these counts, which `keep` may write."""
    counts = keep(measures(lines))
    sizes = keep(body_font(counts, body_size(counts)))
    prose = counts.where("what = 'edge'").join(sizes, "doc_id").where(F.abs(F.col("size") - F.col("body_size")) <= PROSE_TOLERANCE)
    prose = prose.where((F.col("body_font") == "") | (F.col("font") == F.col("body_font")))
    centres = gap_clusters(histogram(prose, weight="n"), "doc_id", "bucket", 20, "n").groupBy("doc_id").agg(F.array_sort(F.collect_list("centre")).alias("centres"))
    got = sizes.join(page_width, "doc_id").join(centres, "doc_id", "left").withColumn("centres", F.coalesce("centres", F.array().cast("array<double>")))
    two = (F.size("centres") >= 2) & (F.try_element_at("centres", F.lit(-1)) - F.get("centres", F.lit(0)) > F.col("page_width") * 0.25)
    got = got.withColumn("n_columns", F.when(two, F.size("centres")).otherwise(1))
    got = got.withColumn("split_x", F.when(F.col("n_columns") > 1, (F.get("centres", F.lit(0)) + F.try_element_at("centres", F.lit(-1))) / 2).otherwise(F.col("page_width")))
    edges = prose.select("doc_id", "x0", "n").join(got.select("doc_id", "n_columns", "split_x"), "doc_id").withColumn("col", column_of(F.col("x0")))
    # The order statistic of counted values: the first of which more lines than its number stand at or before it.
    per = Window.partitionBy("doc_id", "col")
    upto, total = F.sum("n").over(per.orderBy("x0").rangeBetween(Window.unboundedPreceding, 0)), F.sum("n").over(per)
    edges = edges.withColumn("reached", upto > F.floor(total * 0.05)).where("reached").groupBy("doc_id", "col").agg(F.min("x0").alias("base"))
    bases = edges.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "base"))).alias("by_col"))
    got = got.join(bases, "doc_id", "left")
    base = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda c: F.coalesce(F.try_element_at(F.col("by_col"), c.cast("int")), F.get(F.col("centres"), c), F.lit(40.0)))
    return got.withColumn("bases", base).drop("by_col", "centres", "page_width")


def page_widths(pages: DataFrame) -> DataFrame:
    """(doc_id, page_width): the widest of a document's pages(doc_id, width)."""
    return pages.groupBy("doc_id").agg(F.max("width").cast("double").alias("page_width"))


def column_of(x: Column) -> Column:
    return F.when((F.col("n_columns") < 2) | (x < F.col("split_x")), 0).otherwise(1)


def marks(lines: DataFrame) -> DataFrame:
    """Lines with what their texts, sizes and fonts say for their kind, asked once, before any shuffle.

    `carry` is a bold line that a run-in heading may begin on; `lead` and `rest` are those of a line that may hold one."""
    t = F.col("text")
    label = (F.length(F.trim(t)) <= max(map(len, LABEL_STRINGS))) | F.contains(t, F.lit(":"))
    may = F.col("bold") & ~F.col("all_bold") & (F.length("head_text") >= 8) & (F.length("rest_text") > 0)
    said = {
        "sz": F.array_max("sizes"), "font": dominant_font(F.col("font_chars")), "is_label": label & F.regexp_replace(F.lower(F.trim(t)), "^:+|:+$", "").isin(LABEL_STRINGS),
        "skips": (F.col("page") == 0) & F.trim(t).rlike(TITLE_SKIP), "few": ~t.rlike(THREE_LETTERS), "captions": t.rlike(CAPTION), "panel": t.rlike(PANEL_LABEL),
        "short": F.length(t) < 4, "may_run": may, "carry": F.when(F.col("bold") & ~F.rtrim("raw").rlike(r"[.!?:]$"), F.trim("raw")), "lead": F.when(may, F.trim("head_text")), "rest": F.when(may, F.trim("rest_text")),
    }
    return lines.withColumns({f"__{k}": v for k, v in said.items()})


def classify(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Lines with col, kind and, for run-in headings, runin_head; `text` of a run-in line is what follows its heading.

    Caption continuations chain: after a caption, lines of the same size and font belong to it. The state
    runs over one page column at a time. Lines go to their document once: all windows, and reading_order(), share its order."""
    asked = lines if "__carry" in lines.columns else marks(lines)
    rows = asked.repartition("doc_id").join(layouts.hint("shuffle_hash"), "doc_id").withColumns({"sz": F.col("__sz"), "font": F.col("__font"), "col": column_of(F.col("x0"))})
    base = F.coalesce(F.get("bases", F.least("col", F.size("bases") - 1)), F.lit(40.0))
    rows = rows.withColumns({"aligned": F.abs(F.col("x0") - base) <= 3.0, "same_font": (F.col("body_font") == "") | (F.col("font") == F.col("body_font"))})
    bs, sz, bold = F.col("body_size"), F.col("sz"), F.col("bold")
    region = F.col("in_rect") & ~F.col("same_font") & (F.col("page") > 0)
    # Everything but the chained captions, which stand between the caption rule and the panel rule.
    early = (
        F.when(region, "region")
        .when(F.col("__is_label"), "label")
        .when((F.col("page") == 0) & (sz >= bs + 4.5) & ~F.col("__skips"), "title")
        .when((F.col("page") == 0) & ~bold & (sz >= bs + 0.7), "abstract")
        .when(F.col("page") == 0, "other")
        .when(F.col("__few"), "junk")
        .when(F.col("__captions"), "figure")
    )
    late = (
        F.when(F.col("__panel") & (sz > bs), "figure")
        .when(F.col("__may_run") & sz.between(bs - 0.2, bs + 1.5), "runin")
        .when(bold & (sz > bs * HEADING_FACTOR) & F.col("aligned"), "h1")
        .when(bold & (sz > bs) & (sz <= bs * HEADING_FACTOR) & F.col("aligned") & ~F.col("__short"), "h2")
        .when((F.abs(sz - bs) <= BODY_TOLERANCE) & ~bold & F.col("same_font"), "body")
        .when(sz < bs - BODY_TOLERANCE, "figure")
        .otherwise("other")
    )
    rows = rows.withColumns({"early": early, "late": late})
    # A run of lines in one column that can only continue the caption before it: all of its size and font, none
    # with an early kind of its own. A line is a caption where one of its run stands before it.
    per = Window.partitionBy("doc_id", "page", "col").orderBy("y0", "x0")
    upto = per.rowsBetween(Window.unboundedPreceding, 0)
    p_sz, p_font = F.lag("sz").over(per), F.lag("font").over(per)
    bound = F.col("early").isNull() & (F.abs(sz - p_sz) <= 0.2) & (F.col("font") == p_font)
    rows = rows.withColumns({"bound": F.coalesce(bound, F.lit(False)), "nth": F.row_number().over(per)})
    alone = F.coalesce("early", "late")
    opened = F.max(F.when(~F.col("bound"), F.col("nth"))).over(upto)
    caption = F.max(F.when(alone == "figure", F.col("nth"))).over(per.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("chained", F.coalesce(caption >= opened, F.lit(False)))
    rows = rows.withColumn("kind", F.when(F.col("early").isNull() & F.col("chained"), "figure").otherwise(alone))
    # Run-in headings that began on up to three whole bold lines before: as far up as these follow each other.
    up = F.when(F.col("kind") == "other", F.col("__carry"))
    rows = rows.withColumns({f"up{n}": F.lag(up, n).over(per) for n in (1, 2, 3)})
    reached = [F.when(F.concat(*[F.col(f"up{k}") for k in range(1, n)], F.lit("")).isNotNull(), F.col(f"up{n}")) for n in (3, 2, 1)]
    head = F.array_append(F.array_compact(F.array(*reached)), F.col("__lead"))
    rows = rows.withColumn("runin_head", F.when(F.col("kind") == "runin", T.join_lines(head)))
    rows = rows.withColumn("text", F.when(F.col("kind") == "runin", F.col("__rest")).otherwise(F.col("text")))
    return rows.drop("up1", "up2", "up3", "early", "late", "bound", "nth", "chained", *[c for c in asked.columns if c.startswith("__")])


def reading_order(lines: DataFrame) -> DataFrame:
    """pos: the place of each line by page, column and height."""
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "col", "y0", "x0")))


def right_edge(lines: DataFrame) -> DataFrame:
    """Body lines with `edge`: the 85 % order statistic of the right ends of up to eleven neighbours in their column; null below five."""
    return with_edges(lines.where(is_body()))


def is_body() -> Column:
    return F.coalesce(F.col("kind").isin("body", "runin"), F.lit(False))


def with_edges(lines: DataFrame) -> DataFrame:
    """All lines, body lines with the `edge` of right_edge(): they stay where their document is."""
    # Reading order keeps a column together: what is near a line is its column's body lines before and after it.
    column = Window.partitionBy("doc_id", "page", "col", is_body()).orderBy("pos").rowsBetween(-WINDOW, WINDOW)
    rows = lines.withColumn("__near", F.collect_list(F.struct("x1")).over(column))
    known = is_body() & F.col("page").isNotNull() & F.col("col").isNotNull() & (F.size("__near") >= MIN_WINDOW)
    return rows.withColumn("edge", F.when(known, T.order_statistic(F.col("__near.x1"), 0.85))).drop("__near")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Segments of classified lines in reading order: sections from headings, paragraphs by full lines, indents and unfinished sentences.

    Lines are read once and, dealt by document, go to no other place: every window and group is one document's."""
    base = F.coalesce(F.get("bases", F.least("col", F.size("bases") - 1)), F.lit(40.0))
    rows = lines.where(~F.col("kind").isin("title", "other", "figure", "region", "junk", "label"))
    rows = with_edges(rows.select("doc_id", "pos", "page", "col", "x1", "kind", "text", "runin_head", ((F.col("x0") - base) >= INDENT_MIN).alias("indented")))
    order = Window.partitionBy("doc_id").orderBy("pos")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    is_head, is_abstract = F.col("kind").isin("h1", "h2", "runin"), F.col("kind") == "abstract"
    before = {f"p_{c}": F.lag(c).over(order) for c in ("kind", "edge", "x1", "text")}
    rows = rows.withColumns(before | {"headed": F.max(is_head.cast("int")).over(above), "abstracts": F.sum(is_abstract.cast("int")).over(above)})
    # The first abstract line opens the section Abstract, a body line before any heading the front matter.
    first_abstract = is_abstract & (F.coalesce("abstracts", F.lit(0)) == 0)
    first_body = (F.col("kind") == "body") & (F.coalesce("headed", F.lit(0)) == 0) & F.col("p_kind").isNull()
    rows = rows.withColumn("opens", is_head | first_abstract | first_body)
    rows = rows.withColumn("level", F.when(F.col("opens"), F.when(F.col("kind") == "h2", 2).when(F.col("kind") == "runin", 3).otherwise(1)))
    heading = F.when(is_abstract, "Abstract").when(F.col("kind") == "body", "(前置)").when(F.col("kind") == "runin", F.col("runin_head")).otherwise(F.col("text"))
    rows = rows.withColumn("heading", F.when(F.col("opens"), T.strip_panel_letter(heading)))
    # A heading's name in paths is made on its own line alone; the lines below carry it on.
    rows = rows.withColumn("slug", F.when(F.col("opens") & F.col("heading").isNotNull(), T.slug(F.col("heading"))))
    # A section's text begins on the line that opens it or, where that is a heading by itself, on the next.
    first = F.col("opens") | F.coalesce(F.col("p_kind").isin("h1", "h2"), F.lit(True))
    p_full = F.coalesce((F.col("p_edge") - F.col("p_x1")) <= RIGHT_TOLERANCE, F.lit(False))
    carries = F.coalesce(F.col("text").rlike("^[a-z]") & ~T.ends_sentence(F.col("p_text")), F.lit(False))
    rows = rows.withColumn("starts", F.when(first, True).when(is_abstract, False).otherwise((~p_full | F.col("indented")) & ~carries))
    rows = rows.drop(*before, "edge", "x1", "headed", "abstracts", "runin_head")
    rows = S.fill_forward(rows, ["doc_id"], ["pos"], heading="slug")
    # Every section starts a paragraph, so paragraphs can be numbered through the document.
    counted = {"sec_no": F.sum(F.col("opens").cast("int")).over(run), "para": F.sum(F.col("starts").cast("int")).over(run)}
    rows = rows.withColumns(counted | {"sec": F.last(F.when(F.col("opens"), F.struct("level", "heading")), ignorenulls=True).over(run)})
    rows = rows.where(~F.col("kind").isin("h1", "h2"))
    texts = F.sort_array(F.collect_list(F.struct("pos", "text")))["text"]
    opening = F.min_by(F.struct("sec", "h1", "h2", "h3", "indented", "col", (F.col("page") + 1).alias("page")), "pos")
    segs = rows.groupBy("doc_id", "sec_no", "para").agg(T.join_lines(texts).alias("src_text"), opening.alias("o"))
    segs = segs.where(F.col("src_text").rlike(THREE_WORDS)).select("doc_id", "sec_no", "para", "src_text", "o.*")
    path = F.array_join(F.array_compact(F.array(*[F.when(F.col("sec.level") >= n, F.col(f"h{n}")) for n in (1, 2, 3)])), "/")
    segs = segs.withColumn("base_path", path).drop("h1", "h2", "h3")
    segs = S.unique_paths(segs, ["doc_id"], "base_path", ["sec_no"])
    segs = S.with_ids(segs, ["sec_no", "para"])
    return segs.select("doc_id", "sid", "sec_path", F.col("sec.heading").alias("sec_heading"), F.col("sec.level").alias("sec_level"), "index", "seg_pos", "page", "src_text", T.word_count(F.col("src_text"), "pdf").alias("n_words"), "indented", "col", F.sha1("src_text").alias("src_hash"))


def title(lines: DataFrame, fallback: str = "doc_id") -> DataFrame:
    """(doc_id, title): the title lines, else the first heading, else the id."""
    ordered = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "text"))))
    got = lines.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(ordered("title"), lambda x: x["text"]), " "), 1, 200).alias("t"), F.min_by("text", F.when(F.col("kind").isin("h1", "h2"), F.col("pos"))).alias("h"))
    return got.select("doc_id", F.coalesce(F.nullif(F.trim("t"), F.lit("")), F.col("h"), F.col(fallback).cast("string")).alias("title"))


def segment_lines(lines: DataFrame, rects: DataFrame, page_width: DataFrame) -> DataFrame:
    """The whole way from laid-out lines to segments."""
    marked = in_rects(lines, rects)
    return paragraphs(reading_order(classify(marked, layout(marked, page_width))))


def laid(spans: DataFrame, drawings: DataFrame, images: DataFrame, pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame]:
    """(lines with their marks, layouts) of an extractor's spans, drawings, images and pages(doc_id, page, width): what classify() takes.

    Lines are read twice, for their measures and for their kinds: `keep` may write what is made once (sinks.stages.written)."""
    lines = marks(in_rects(gather(spans), region_rects(drawings, images)))
    lines = keep(lines.drop("raw", "head_text", "rest_text", "all_bold"))
    how = keep(layout(lines, page_widths(pages), keep))
    return lines.drop("sizes", "font_chars"), how


def classified(spans: DataFrame, drawings: DataFrame, images: DataFrame, pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame]:
    """(lines with kind and pos, layouts) of an extractor's spans, drawings, images and pages(doc_id, page, width)."""
    lines, how = laid(spans, drawings, images, pages, keep)
    return reading_order(classify(lines, how)), how


def span_layouts(spans: DataFrame, pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Layouts alone: no line is classified, none meets a rectangle."""
    return layout(gather(spans), page_widths(pages), keep)


def span_titles(spans: DataFrame, drawings: DataFrame, images: DataFrame, pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """title() of an extractor's spans: the text of a line that can be neither title nor heading is not carried along."""
    lines, how = laid(spans, drawings, images, pages, keep)
    lines = lines.withColumn("text", F.when(F.col("bold") | (F.col("page") == 0), F.col("text")))
    return title(reading_order(classify(lines, how)))


def segment_spans(spans: DataFrame, drawings: DataFrame, images: DataFrame, pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The whole way from an extractor's spans to segments."""
    return paragraphs(classified(spans, drawings, images, pages, keep)[0])


def inspect(lines: DataFrame, page: int | None = None, kinds: list[str] | None = None, col: int | None = None, grep: str | None = None) -> DataFrame:
    """Classified lines by page, kind, column and pattern."""
    out = lines
    if page is not None:
        out = out.where(F.col("page") == page)
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if col is not None:
        out = out.where(F.col("col") == col)
    return out.where(F.col("text").rlike(f"(?i){grep}")) if grep else out


def kinds(lines: DataFrame, top: int = 9) -> DataFrame:
    return lines.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(top)


def web_paragraphs(items: DataFrame) -> DataFrame:
    """The browser's rule over ordered items(doc_id, pos, text, size): a large or known short line is a heading; a paragraph closes at a full stop beyond 300 characters; more than 20 left over make a last one."""
    known = r"(?i)^(abstract|introduction|background|methods?|results?|discussion|conclusions?|references)\b"

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        import re

        heading, buffer, out = "Introduction", "", []
        for text, size in frame.sort_values("pos")[["text", "size"]].itertuples(index=False):
            t = (text or "").strip()
            if not t:
                continue
            if (size > 13 or re.match(known, t)) and len(t) < 80:
                if len(buffer) > 20:
                    out.append((heading, buffer))
                heading, buffer = t, ""
                continue
            buffer = f"{buffer} {t}".strip()
            if len(buffer) > 300 and buffer.endswith("."):
                out.append((heading, buffer))
                buffer = ""
        if len(buffer) > 20:
            out.append((heading, buffer))
        return pd.DataFrame({"doc_id": key[0], "seg_pos": range(1, len(out) + 1), "sec_heading": [h for h, _ in out], "src_text": [b for _, b in out]})

    return items.groupBy("doc_id").applyInPandas(of, f"doc_id {items.schema['doc_id'].dataType.simpleString()}, seg_pos int, sec_heading string, src_text string")
