"""An incremental literature feed: keyed merge, states, digests, message packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import cache as C
from scriptorium.operators import glossary as G

FACTS = ["doi", "doc_id", "journal", "journal_abbr", "title_en", "abstract", "pub_date", "entrez_date", "pmc", "term_field", "ptypes"]
GENERATED = ["title_zh", "brief", "detail"]
ITEM = (
    "pmid string, doi string, doc_id string, journal string, journal_abbr string, title_en string, abstract string, pub_date string, entrez_date string, "
    "pmc string, term_field string, ptypes array<string>, status string, first_seen string, shown_in array<string>, title_zh string, brief string, detail string"
)
# Characters a message may have and messages a push may have, per channel; texts of messages and commands.
POLICY = {"wechat": (3500, 1), "telegram": (3800, 6), "discord": (1900, 10)}
NOTE_RESERVE = 180
HTML_LIMIT = 19_000
RUN_COMMAND = "python tools/run_pipeline.py "
TAIL = "挑好后在电脑上运行：python tools/build_digest.py --pick 1 5 9"


def split_kept(items: DataFrame, keep_no_abstract: bool = False, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Items with an abstract, and those dropped for want of one."""
    has = F.coalesce(F.length(F.trim("abstract")) >= least, F.lit(False)) | F.lit(keep_no_abstract)
    return items.where(has), items.where(~has)


def dropped_report(dropped: DataFrame, limit: int = 15) -> DataFrame:
    """The first of the dropped items, and how many more there are."""
    rows = newest(dropped, limit).select(F.coalesce(F.nullif("pub_date", F.lit("")), "entrez_date").alias("date"), "journal", "title_en")
    return rows.crossJoin(dropped.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("n_more")))


def newest(items: DataFrame, limit: int | None = None) -> DataFrame:
    out = items.orderBy(F.desc("entrez_date"), F.desc("pmid"))
    return out if limit is None else out.limit(limit)


def recent(items: DataFrame, days: int, today: str) -> DataFrame:
    """Items of the last `days` days; those whose date can't be read are kept."""
    if days <= 0:
        return items
    date = F.coalesce(F.when(F.length("entrez_date") > 0, F.col("entrez_date")), F.col("pub_date"), F.lit(""))
    return items.where(F.coalesce(F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd") >= F.date_sub(F.to_date(F.lit(today)), days), F.lit(True)))


def pending(items: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(items.where("status = 'new'"), limit)


def search(items: DataFrame, query: str, columns: tuple[str, ...] = ("title_en", "title_zh", "brief", "journal", "abstract")) -> DataFrame:
    q = F.lit(query.lower())
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    return items.where(test)


def upsert(store: DataFrame, incoming: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(store after, inserted): new ids come in as `new`; known ids get new facts and keep their state and generated text.

    Of several incoming rows of an id that of the latest entry counts, then the greatest facts. Both sides meet in one full join."""
    rest = [c for c in incoming.columns if c not in ("pmid", "entrez_date")]
    inc = incoming.groupBy("pmid").agg(F.max(F.struct("entrez_date", *[c for c in FACTS if c in rest], *[c for c in rest if c not in FACTS])).alias("r"))
    i = inc.select(F.col("pmid").alias("__pmid"), "r")
    both = store.join(i, store["pmid"] == i["__pmid"], "full")
    known, there = F.col("pmid").isNotNull(), F.col("__pmid").isNotNull()
    first = {"pmid": F.col("__pmid"), "status": F.lit("new"), "first_seen": F.lit(today), "shown_in": F.array().cast("array<string>")}

    def column(c: str) -> Column:
        own = F.when(there, F.col(f"r.{c}")).otherwise(F.col(c)) if c in FACTS else F.col(c)
        return F.when(known, own).otherwise(first.get(c, F.col(f"r.{c}"))).alias(c)

    after = both.select(*[column(c) for c in store.columns], (~known).alias("__fresh"))
    return after.drop("__fresh"), after.where("__fresh").drop("__fresh")


def write_back(store: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated text by id; ids that the store lacks change nothing."""
    g = generated.select("pmid", *[F.col(c).alias(f"__{c}") for c in GENERATED])
    return store.join(g, "pmid", "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in GENERATED else F.col(c) for c in store.columns])


def set_status(store: DataFrame, ids: DataFrame, status: str, snapshot: str = "") -> DataFrame:
    """The state of the listed ids; the snapshot joins those they were shown in."""
    mark = ids.select(F.col("pmid").alias("__p")).distinct()
    hit = F.col("__p").isNotNull()
    out = store.join(mark, store["pmid"] == mark["__p"], "left").withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    if snapshot:
        out = out.withColumn("shown_in", F.when(hit, F.array_union(F.coalesce("shown_in", F.array().cast("array<string>")), F.array(F.lit(snapshot)))).otherwise(F.col("shown_in")))
    return out.select(*store.columns)


def stats(store: DataFrame) -> DataFrame:
    """Items per state, and in all."""
    return store.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def gap(store: DataFrame, today: str) -> DataFrame:
    """The last run and the days since; null where there was none."""
    last = store.agg(F.max(F.when(F.length("first_seen") > 0, F.col("first_seen"))).alias("last_run"))
    return last.withColumn("gap_days", F.datediff(F.to_date(F.lit(today)), F.try_to_date(F.substring("last_run", 1, 10), "yyyy-MM-dd")))


def with_urls(items: DataFrame) -> DataFrame:
    some = F.length("doi") > 0
    return items.withColumns({
        "has_abstract": F.coalesce(F.length(F.trim("abstract")) > 0, F.lit(False)),
        "url_pubmed": F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")),
        "url_doi": F.when(some, F.concat(F.lit("https://doi.org/"), "doi")).otherwise(""),
        "run_command": F.concat(F.lit(RUN_COMMAND), "doc_id", F.lit(" --field "), "term_field"),
    })


def snapshot_items(items: DataFrame) -> DataFrame:
    """Items numbered from 1, newest first, with their derived columns."""
    n = F.row_number().over(Window.orderBy(F.desc("entrez_date"), F.desc("pmid")))
    return with_urls(items).withColumn("n", n)


def pick(snapshot: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(picked items, numbers that the snapshot lacks)."""
    want = numbers.select(F.col("n").cast("int").alias("n")).distinct()
    return snapshot.join(want, "n"), want.join(snapshot.select("n"), "n", "left_anti")


def latest(snapshots: DataFrame) -> DataFrame:
    """The snapshot made last; of one moment, that of the greater name."""
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), F.struct("generated_at", "name")).alias("s")).where("s is not null").select("s.*")


def unique_stem(taken: DataFrame, date: str, hhmm: str) -> str:
    """A snapshot name that nothing has: the date, with the time, then with -2, -3 ..."""
    names = {r["name"] for r in taken.where(F.col("name").startswith(date)).select("name").collect()}
    for stem in [date, f"{date}-{hhmm}"]:
        if stem not in names:
            return stem
    n = 2
    while f"{date}-{hhmm}-{n}" in names:
        n += 1
    return f"{date}-{hhmm}-{n}"


PAYLOAD = "struct<title_zh:string,brief:string,detail:string>"


def payload(text: Column) -> Column:
    """struct(title_zh, brief, detail) of an answer: fenced, wrapped in prose or broken; lacking parts are empty."""
    shape, bad = "struct<title_zh:string,brief:string,detail:string,_bad:string>", {"columnNameOfCorruptRecord": "_bad"}
    good = lambda s, c: F.when(s["_bad"].isNull(), s[c])
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    # An answer is bared once and parsed once in either way, for all of its parts.
    both = lambda b: F.struct(F.from_json(F.when(b.startswith("{"), b), shape, bad).alias("whole"), F.from_json(F.nullif(F.regexp_extract(b, r"(?s)\{.*\}", 0), F.lit("")), shape, bad).alias("inner"))
    parts = lambda x: F.struct(*[F.trim(F.coalesce(good(x["whole"], c), good(x["inner"], c), F.lit(""))).alias(c) for c in ("title_zh", "brief", "detail")])
    return T.let(bare, lambda b: T.let(both(b), parts))


def brief_verdict(brief: Column) -> Column:
    """struct(mark, why): empty, too long, rather long, more than one comma, or fine."""

    def of(x: Column) -> Column:
        n, commas, empty = x["n"], x["commas"], x["empty"]
        issues = F.array_compact(F.array(F.when(n > 32, F.concat(n.cast("string"), F.lit("字超标"))).when(n > 25, F.concat(n.cast("string"), F.lit("字偏长"))), F.when(commas > 1, F.concat(commas.cast("string"), F.lit("个逗号")))))
        return F.struct(
            F.when(empty, "❌").when(F.size(issues) > 0, "⚠️").otherwise("✅").alias("mark"),
            F.when(empty, "空").when(F.size(issues) > 0, F.array_join(issues, " ")).otherwise(F.concat(n.cast("string"), F.lit("字"))).alias("why"),
        )

    return T.let(F.struct(T.reading_length(brief).alias("n"), F.regexp_count(brief, F.lit("[，,]")).alias("commas"), F.coalesce(F.length(F.trim(brief)) == 0, F.lit(True)).alias("empty")), of)


# What an item's prompt looks like.
DIGEST_USER = "【期刊】{journal}\n【原标题】{title}\n【摘要】\n{abstract}\n"


def digest_prompt(journal: Column, title: Column, abstract: Column) -> Column:
    return T.filled(DIGEST_USER, {"journal": journal, "title": title, "abstract": abstract})


def triage(items: DataFrame, cache: DataFrame, resolved: DataFrame, answer: Callable[[DataFrame], DataFrame], model: str, version: str) -> DataFrame:
    """Items with title_zh, brief and detail from a provider's answers, cached by the abstract's hash; hit, error, mark and why besides.

    `answer` gives rows with `prompt` a `value` and an `error`; it is asked once for each key that the cache lacks. An item
    without an answer keeps what it had. Hard terms of resolved(doc_id, ...) and the number format are applied afterwards,
    so that changed terms take effect on cached answers."""
    keyed = items.withColumn("key", C.digest_key(model, version, F.sha1("abstract")))
    asked = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct("pmid", "journal", "title_en", "abstract")).alias("i"))
    prompt = digest_prompt(F.col("i.journal"), F.col("i.title_en"), F.col("i.abstract"))
    fresh = answer(asked.select("key", prompt.alias("prompt"))).select("key", F.col("value").alias("__new"), F.col("error").alias("error"))
    rows = C.lookup(keyed, cache).join(fresh, "key", "left").withColumn("__p", payload(F.coalesce("cached_value", "__new")))
    made = F.col("hit") | F.col("__new").isNotNull()
    for c in GENERATED:
        rows = rows.withColumn(f"__{c}", F.col(f"__p.{c}"))
        rows = G.replaced_by_document(rows, resolved, f"__{c}").withColumn(f"__{c}", T.normalize_zh(F.col(f"__{c}")))
        rows = rows.withColumn(c, F.when(made, F.col(f"__{c}")).otherwise(F.col(c)))
    verdict = brief_verdict(F.col("brief"))
    return rows.select(*items.columns, "key", "hit", "error", verdict["mark"].alias("mark"), verdict["why"].alias("why"))


# What a browser's feed shows where a record says nothing, and the shortest abstract it takes.
NO_JOURNAL, NO_DATE, LEAST_ABSTRACT = "Nature Reviews", "近期", 50


def browser_items(records: DataFrame, retitled: Callable[[Column], Column]) -> DataFrame:
    """A browser's feed from fetched records: those with a title and a real abstract, with a title and a line made by rules (`retitled`).

    Abstracts are counted in characters once trimmed; records are those of readers.articles(separator=" ")."""
    filled = lambda c: F.nullif(T.squash_ends(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = records.select(
        F.coalesce(filled("pmid"), F.lit("")).alias("pmid"), F.coalesce(filled("doi"), F.lit("")).alias("doi"), filled("title").alias("title_en"), filled("abstract").alias("abstract"),
        F.coalesce(filled("journal_abbr"), filled("journal"), F.lit(NO_JOURNAL)).alias("journal"),
        F.coalesce(F.concat(filled("year"), F.coalesce(F.concat(F.lit("-"), filled("month")), F.lit(""))), F.lit(NO_DATE)).alias("pub_date"),
    ).where((F.length("title_en") > 0) & (F.length("abstract") >= LEAST_ABSTRACT))
    rows = rows.withColumn("__zh", retitled(F.col("title_en"))).withColumn("__new", F.col("__zh") != F.col("title_en"))
    own = F.when(F.col("doi") != "", F.regexp_replace("doi", r"^10\.[0-9]+/", "")).otherwise(F.concat(F.lit("pmid-"), "pmid"))
    brief = F.when(F.col("__new"), F.concat(F.lit("前沿探讨："), "__zh")).otherwise(F.concat(F.lit("前沿综述："), "journal", F.lit(" 深入探讨机制与治疗演进。")))
    return rows.select("doi", own.alias("doc_id"), "title_en", F.when(F.col("__new"), F.col("__zh")).otherwise("").alias("title_zh"), "journal", "pub_date", brief.alias("brief"), F.col("abstract").alias("detail"), "abstract", F.lit(False).alias("has_reader"))


def build_item(raw: DataFrame) -> DataFrame:
    """Feed items from fetched records (pmid, doi, journal, journal_abbr, title, abstract, year, month, day, medline, entrez_date, pmc, ptypes)."""
    return raw.select(
        "pmid", F.coalesce("doi", F.lit("")).alias("doi"), T.doc_id_of_doi(F.col("doi"), F.col("pmid")).alias("doc_id"), "journal", "journal_abbr", T.squash(F.col("title")).alias("title_en"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        T.feed_date(F.coalesce("year", F.lit("")), F.coalesce("month", F.lit("")), F.coalesce("day", F.lit("")), F.coalesce("medline", F.lit(""))).alias("pub_date"), F.coalesce("entrez_date", F.lit("")).alias("entrez_date"), "pmc",
        T.field_of_journal(F.col("journal")).alias("term_field"), "ptypes", F.lit("new").alias("status"), F.lit("").alias("first_seen"), F.array().cast("array<string>").alias("shown_in"), F.lit("").alias("title_zh"), F.lit("").alias("brief"), F.lit("").alias("detail"),
    )


def item_line(style: str = "full") -> Column:
    body = F.coalesce(F.nullif("brief", F.lit("")), F.nullif("title_zh", F.lit("")), F.col("title_en"))
    line = F.concat(F.col("n").cast("string"), F.lit(". "), body, F.lit(" · "), T.short_journal(F.col("journal")))
    return F.concat(line, F.when(F.length("detail") > 0, F.concat(F.lit("\n    "), "detail")).otherwise("")) if style == "full" else line


#: An item's line has its number, a point and a separator; its piece of a page the tags around them.
LEAST_LINE, LEAST_PIECE = len("1.  · "), len("<p><b>1.</b> <b></b></p>")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) where the value is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def within(items: DataFrame, size: int, least: int) -> DataFrame:
    """The first items by `n`, as many as could begin in `size` characters, and two more: what is shown and whether anything is left out is the same as of all."""
    return items.orderBy("n").limit(size // least + 2)


def packed(head: Column, blocks: Column, tail: str, chunk: Column, most: Column, total: Column | None = None) -> Column:
    """array<string>: blocks packed greedily into messages at their bounds; `total` is the number of items where `blocks` holds the first of them.

    The head opens the first message, the tail closes the last. A block longer than the budget is cut and
    marked; messages beyond the channel's number are left out, and the last one says how many items that are."""
    budget = F.greatest(F.lit(200), chunk - len(tail) - NOTE_RESERVE)
    pack = "struct<t:string,n:int>"

    def cut(acc: Column) -> Column:
        # A block longer than the budget, cut into pieces at once.
        over = F.length(acc["cur"]) > budget
        pieces = F.ceil(F.length(acc["cur"]) / budget).cast("int")
        full = F.transform(F.sequence(F.lit(0), F.greatest(pieces - 2, F.lit(0))), lambda i: F.struct(F.concat(F.substring(acc["cur"], i * budget + 1, budget), F.lit("…（本条截断）")).alias("t"), F.when(i == 0, acc["n"]).otherwise(0).cast("int").alias("n")))
        return F.struct(
            F.when(over, F.concat(acc["packs"], full)).otherwise(acc["packs"]).alias("packs"),
            F.when(over, F.substring(acc["cur"], (pieces - 1) * budget + 1, budget)).otherwise(acc["cur"]).alias("cur"),
            F.when(over, 0).otherwise(acc["n"]).cast("int").alias("n"),
        )

    def step(acc: Column, b: Column) -> Column:
        close = (acc["n"] > 0) & (F.length(acc["cur"]) + F.length(b) + 1 > budget)
        base = F.when(close, "").otherwise(acc["cur"])
        nxt = F.struct(
            F.when(close, F.concat(acc["packs"], F.array(F.struct(acc["cur"].alias("t"), acc["n"].alias("n"))))).otherwise(acc["packs"]).alias("packs"),
            F.when(F.length(base) > 0, F.concat(base, F.lit("\n"), b)).otherwise(b).alias("cur"),
            (F.when(close, 0).otherwise(acc["n"]) + 1).cast("int").alias("n"),
        )
        return once(nxt, cut)

    start = F.struct(F.array().cast(f"array<{pack}>").alias("packs"), head.alias("cur"), F.lit(0).alias("n"))

    def finish(acc: Column) -> Column:
        return F.when((F.length(acc["cur"]) > 0), F.concat(acc["packs"], F.array(F.struct(acc["cur"].alias("t"), acc["n"].alias("n"))))).otherwise(acc["packs"])

    total = F.size(blocks) if total is None else total

    def closed(packs: Column) -> Column:
        size = F.size(packs)
        return F.slice(F.transform(packs, lambda p, i: F.struct(F.when(i == size - 1, F.concat(p["t"], F.lit("\n\n" + tail))).otherwise(p["t"]).alias("t"), p["n"].alias("n"), size.alias("of"))), F.lit(1), most)

    def noted(kept: Column) -> Column:
        sent = F.aggregate(kept, F.lit(0), lambda a, p: a + p["n"])
        note = F.concat(F.lit("\n\n⚠️ 还有 "), F.greatest(F.lit(0), total - sent).cast("string"), F.lit(" 条没发完（共 "), total.cast("string"), F.lit(" 条）。为避免刷屏只发前 "), most.cast("string"), F.lit(" 条消息，完整内容见 data/feed/digest/ 里的 HTML。"))
        return F.transform(kept, lambda p, i: F.when((p["of"] > most) & (i == most - 1), F.concat(p["t"], note)).otherwise(p["t"]))

    return once(once(F.aggregate(blocks, start, step, finish), closed), noted)


def build_messages(snapshot: DataFrame, date: str, style: str = "full") -> DataFrame:
    """(channel, msg_no, text) of a snapshot's items for every channel. A channel takes so many messages of so many characters: only the
    items that could begin in them are packed, whatever the snapshot's length, and the rest is counted."""
    items = snapshot.withColumn("line", item_line(style))
    room = max(m * max(200, c - len(TAIL) - NOTE_RESERVE) for c, m in POLICY.values())
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    one = within(items, room, LEAST_LINE).agg(blocks.alias("blocks")).crossJoin(items.agg(F.count("*").alias("total")))
    rules = F.array(*[F.struct(F.lit(k).alias("channel"), F.lit(c).alias("chunk"), F.lit(m).alias("most")) for k, (c, m) in POLICY.items()])
    rows = one.select("blocks", "total", F.explode(rules).alias("r"))
    head = F.concat(F.lit(f"Nature Reviews 速览 · {date}（"), F.col("total").cast("string"), F.lit(" 条）"))
    return rows.select(F.col("r.channel").alias("channel"), F.posexplode(packed(head, F.col("blocks"), TAIL, F.col("r.chunk"), F.col("r.most"), F.col("total"))).alias("msg_no", "text"))


def html_digest(snapshot: DataFrame, date: str, style: str = "brief", limit: int = HTML_LIMIT) -> DataFrame:
    """One page of items within a size limit; what is left out is counted. Every inserted text is escaped."""
    esc = lambda c: T.escape_html(F.coalesce(c, F.lit("")))
    title = F.coalesce(F.nullif("title_zh", F.lit("")), F.col("title_en"))
    meta = F.concat_ws(" · ", F.nullif(esc(T.short_journal(F.col("journal"), F.col("journal_abbr"))), F.lit("")), F.nullif(esc(F.coalesce(F.nullif("pub_date", F.lit("")), F.col("entrez_date"))), F.lit("")), F.when(F.length("doi") > 0, F.concat(F.lit('<a href="https://doi.org/'), esc(F.col("doi")), F.lit('">'), esc(F.col("doi")), F.lit("</a>"))))
    lines = F.concat_ws("<br>", F.concat(F.lit("<b>"), F.col("n").cast("string"), F.lit(".</b> <b>"), esc(title), F.lit("</b>")), F.when(F.length("brief") > 0, F.concat(F.lit("<span>"), esc(F.col("brief")), F.lit("</span>"))), F.when(F.length(meta) > 0, F.concat(F.lit("<span>"), meta, F.lit("</span>"))))
    piece = F.concat(F.lit("<p>"), lines, F.lit("</p>"))
    if style == "full":
        piece = F.concat(piece, F.when(F.length("detail") > 0, F.concat(F.lit("<p>"), esc(F.col("detail")), F.lit("</p>"))).otherwise(""))
    rows = snapshot.withColumn("piece", piece)
    total = rows.agg(F.count("*").alias("total"))
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    budget = limit - 600
    rows = within(rows, max(budget, 0), LEAST_PIECE).withColumn("fits", F.sum(F.length("piece")).over(run) <= budget)
    rows = rows.withColumn("fits", F.min("fits").over(run))
    shown = rows.where("fits").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("body"), F.count("*").alias("shown"))
    cut = F.when(F.col("total") > F.col("shown"), F.concat(F.lit("<p>⚠️ 已到微信单条上限，后面还有 "), (F.col("total") - F.col("shown")).cast("string"), F.lit(" 条没显示。</p>"))).otherwise("")
    head = F.concat(F.lit(f"<div><p>{date} · 共 "), F.col("total").cast("string"), F.lit(" 条</p>"))
    return shown.crossJoin(total).select(F.concat(head, "body", cut, F.lit(f"<p>{TAIL}</p></div>")).alias("html"), "shown", "total")


def channels(requested: Column, configured: Column, registry: list[str] | None = None) -> list[Column]:
    """Requested channels in the registry's order, unknown ones, those ready and those that lack keys."""
    reg = F.array(*[F.lit(c) for c in (registry or list(POLICY))])
    known = F.array_intersect(reg, requested)
    return [known.alias("known"), F.array_except(requested, reg).alias("unknown"), F.array_intersect(known, configured).alias("ready"), F.array_except(known, configured).alias("skipped")]


def cached_digests(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with cached digests by DOI, else by document; empty ones override nothing."""
    filled = [F.nullif(c, F.lit("")) for c in GENERATED]
    by = lambda k: cache.where(F.length(k) > 0).dropDuplicates([k]).select(F.col(k), *[f.alias(f"__{k}_{c}") for f, c in zip(filled, GENERATED, strict=True)])
    rows = items.join(by("doi"), "doi", "left").join(by("doc_id"), "doc_id", "left")
    return rows.select(*[F.coalesce(f"__doi_{c}", f"__doc_id_{c}", c).alias(c) if c in GENERATED else F.col(c) for c in items.columns])


def in_library(items: DataFrame, library: DataFrame) -> DataFrame:
    own = library.select(F.col("doc_id").alias("__l")).distinct()
    return items.join(own, items["doc_id"] == own["__l"], "left").withColumn("has_reader", F.col("__l").isNotNull()).drop("__l")


def by_date(rows: DataFrame, date: str, key: str, limit: int | None = None, per: list[str] | None = None) -> DataFrame:
    """Rows by date, the newest first, those of no date last; equal dates by key. `rank` counts from 1, within `per` if given; the first `limit`."""
    order = [F.desc_nulls_last(date), key]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(per or [])).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
