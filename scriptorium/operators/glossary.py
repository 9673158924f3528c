"""Glossaries: scoped resolution, hits in text, context-protected rewriting, upserts and audits.

Terms are a table of (ord, term, zh, mode, note, aliases, pattern, prefix_variants, status, scope, full_en).
A resolved glossary is small by nature (terms that a person has approved); it is broadcast only where a count
shows at most `BROADCAST_TERMS` rows, and joined as the optimizer decides beyond. Terms meet texts by the letter runs of
a term's first word, substrings by runs of a few characters: equi-joins; only terms without any letter, or with a
pattern of their own, are tried on all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

# Fixed values.
PREFIX_ZH = {"a": "前部", "p": "后部", "r": "右侧", "l": "左侧", "d": "背侧", "v": "腹侧", "m": "内侧", "c": "尾侧", "s": "上"}
HARD, HINT = "hard_replace", "prompt_hint"
# The alternatives of the words that introduce an abbreviation, without inner captures, for a look-behind.
ABBR_INTRO = "(?:(?:英文)?(?:缩写|简写|简称)(?:为|是|成)?|代号|代称为|命名为|称作|称为|写作|标记为|即|或称)"
BROADCAST_TERMS = 20_000

SCHEMA = "ord int, term string, zh string, mode string, note string, aliases array<string>, pattern string, prefix_variants boolean, status string, scope string, full_en string"


def terms_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Terms with their defaults filled in."""
    full = [
        (i, r["term"], r["zh"], r.get("mode", HINT), r.get("note", ""), r.get("aliases", []), r.get("pattern"), r.get("prefix_variants", True), r.get("status", "suggested"), r.get("scope", "global"), r.get("full_en", ""))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def sized(spark_frame: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Broadcast a table only where a count proves it small; larger ones join as the optimizer decides."""
    return F.broadcast(spark_frame) if spark_frame.limit(limit + 1).count() <= limit else spark_frame


def active(terms: DataFrame) -> DataFrame:
    return terms.where("status <> 'rejected'")


def ranked(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """The active terms that apply to each (doc_id, field), those of the highest rank per lower-cased term; n_zh counts their translations.

    A document asks for three scopes, the global one, its field's and its own: one equi-join."""
    s = F.coalesce("scope", F.lit(""))
    known = (s == "") | (s == "global") | s.startswith("field:") | s.startswith("doc:")
    at = F.when((s == "") | (s == "global"), "").when(known, s).otherwise(F.raise_error(F.concat(F.lit("unknown scope "), s)).cast("string"))
    asked = F.array(
        F.struct(F.lit("").alias("__scope"), F.lit(0).alias("rank")),
        F.struct(F.concat(F.lit("field:"), F.coalesce("field", F.lit(""))).alias("__scope"), F.lit(1).alias("rank")),
        F.struct(F.concat(F.lit("doc:"), "doc_id").alias("__scope"), F.lit(2).alias("rank")),
    )
    wants = docs.select("doc_id", "field").distinct().select("doc_id", "field", F.inline(asked))
    rows = wants.join(sized(active(terms).withColumn("__scope", at)), "__scope").drop("__scope")
    rows = rows.withColumn("key", F.lower(F.trim("term")))
    per = Window.partitionBy("doc_id", "field", "key")
    rows = rows.withColumn("top", F.max("rank").over(per)).where("rank = top")
    return rows.withColumn("n_zh", F.size(F.collect_set("zh").over(per))).withColumn("at", F.row_number().over(per.orderBy("ord")))


def resolve(terms: DataFrame, docs: DataFrame, strict: bool = False) -> DataFrame:
    """One term per document and key: the nearest scope wins, the first entry within it. Strict: a conflict is an error."""
    got = ranked(terms, docs).where("at = 1")
    if strict:
        got = got.withColumn("zh", F.when(F.col("n_zh") > 1, F.raise_error(F.concat(F.lit("conflicting translations of "), F.col("term"))).cast("string")).otherwise(F.col("zh")))
    return got.drop("at", "top")


def conflicts(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """The keys of a document that entries of one rank translate differently, with all entries."""
    got = ranked(terms, docs).where("n_zh > 1")
    return got.groupBy("doc_id", "field", "key", "rank").agg(F.array_sort(F.collect_list(F.struct("ord", "term", "zh", "scope"))).alias("entries"))


def merged(doc_terms: DataFrame, global_terms: DataFrame) -> DataFrame:
    """The document's terms and those global ones that it does not override."""
    key = lambda d: d.withColumn("key", F.lower(F.trim("term")))
    return key(doc_terms).unionByName(key(global_terms).join(key(doc_terms).select("key"), "key", "left_anti")).drop("key")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New entries overwrite those of their key, others are appended; columns as in `existing`."""
    key = lambda d: d.withColumn("key", F.lower(F.trim("term")))
    return key(existing).join(key(incoming).select("key").distinct(), "key", "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def add_missing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Only those of the incoming entries that have no entry yet (proposals, mined definitions)."""
    key = lambda d: d.withColumn("key", F.lower(F.trim("term")))
    return key(incoming).join(key(existing).select("key").distinct(), "key", "left_anti").drop("key")


def promote(doc_terms: DataFrame, global_terms: DataFrame, term: str) -> DataFrame:
    """A document's term as a global, approved one; an error where the global table already has it. delete() takes it out of the document's."""
    own = doc_terms.where(F.lower(F.trim("term")) == term.strip().lower()).withColumn("scope", F.lit("global"))
    if "status" in own.columns:
        own = own.withColumn("status", F.lit("approved"))
    clash = global_terms.where(F.lower(F.trim("term")) == term.strip().lower())
    if not clash.isEmpty():
        raise ValueError(f"the global glossary already has {term!r}")
    return global_terms.unionByName(own.select(*global_terms.columns))


def delete(terms: DataFrame, names: DataFrame) -> DataFrame:
    gone = names.select(F.lower(F.trim("term")).alias("__k")).distinct()
    return terms.join(gone, F.lower(F.trim(terms["term"])) == gone["__k"], "left_anti")


def quoted(s: Column) -> Column:
    return F.regexp_replace(s, r"([^A-Za-z0-9一-鿿\s])", r"\\$1")


def term_regex(term: Column, pattern: Column, prefix_variants: Column) -> Column:
    """What finds a term: its own pattern, an abbreviation (case matters, one lower-case letter may stand before) or a phrase."""
    words = F.filter(F.split(term, r"[\s\-/]+"), lambda w: F.length(w) > 0)
    core = F.array_join(F.transform(words, quoted), r"[\s\-/]+")
    abbr = F.concat(F.lit("(?<![A-Za-z])"), F.when(prefix_variants, "[a-z]?").otherwise(""), core, F.lit("s?(?![A-Za-z])"))
    phrase = F.concat(F.lit("(?i)(?<![A-Za-z])"), core, F.lit("(?:e?s)?(?![A-Za-z])"))
    return F.when(F.coalesce(F.length(pattern), F.lit(0)) > 0, F.concat(F.lit("(?i)"), pattern)).when(T.is_abbreviation(term), abbr).otherwise(phrase)


def lead_runs(term: Column, pattern: Column, prefix_variants: Column) -> Column:
    """The lower-case letter runs of which a text must hold one for term_regex() to match: the term's first run of letters, with
    what may stand before it (one letter, for abbreviations) or behind it (an ending). Empty where the term has none, or its own pattern."""
    run = F.lower(F.regexp_extract(term, "[A-Za-z]+", 0))
    begins, ends = term.rlike(r"^\s*[A-Za-z]"), term.rlike(r"^[^A-Za-z]*[A-Za-z]+\s*$")
    letters = F.array(F.lit(""), *[F.lit(x) for x in "abcdefghijklmnopqrstuvwxyz"])
    before = F.when(begins & T.is_abbreviation(term) & prefix_variants, letters).otherwise(F.array(F.lit("")))
    behind = F.when(ends, F.array(F.lit(""), F.lit("s"), F.lit("es"))).otherwise(F.array(F.lit("")))
    runs = F.flatten(F.transform(before, lambda b: F.transform(behind, lambda e: F.concat(b, run, e))))
    return F.when((F.length(run) > 0) & (F.coalesce(F.length(pattern), F.lit(0)) == 0), runs).otherwise(F.array().cast("array<string>"))


#: So many letter runs of terms are looked up in a text before its rows are made.
KNOWN_RUNS = 5_000


def hits(segments: DataFrame, terms: DataFrame, text: str = "src_text", key: str = "sid") -> DataFrame:
    """Segments and the active terms that their text holds, by the term's pattern.

    Terms meet segments by equality of letter runs, once for each pair; then the pattern decides. Terms too many to
    be broadcast meet narrow rows of `key`, which identifies a segment, and runs; texts come back for what was met."""
    rx = active(terms).withColumns({
        "__rx": term_regex(F.col("term"), F.col("pattern"), F.col("prefix_variants")),
        "__runs": lead_runs(F.col("term"), F.col("pattern"), F.col("prefix_variants")),
    })
    shared = [c for c in terms.columns if c in segments.columns]
    own = [c for c in terms.columns if c not in shared]
    test = F.regexp_like(F.col(f"s.{text}"), F.col("t.__rx"))
    for c in shared:
        test = test & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    size = rx.agg(F.count("*").alias("n"), F.count_if(F.size("__runs") == 0).alias("loose")).first()
    columns = [*[F.col(f"s.{c}") for c in segments.columns], *[F.col(f"t.{c}") for c in own]]
    runs = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    if size["n"] <= BROADCAST_TERMS:
        known = [r[0] for r in rx.select(F.explode("__runs")).distinct().limit(KNOWN_RUNS + 1).collect()]
        # Only runs that some term begins with make rows, as far as they are few enough to be named.
        met = F.array_intersect(runs, F.lit(known)) if 0 < len(known) <= KNOWN_RUNS else runs
        asked = segments.withColumn("__all", met).withColumn("__run", F.explode("__all")).alias("s")
        given = F.broadcast(rx.withColumn("__key", F.explode("__runs"))).alias("t")
        # A pair that several runs join counts by the first of them.
        first = F.get(F.array_intersect("s.__all", "t.__runs"), F.lit(0)) == F.col("s.__run")
        found = asked.join(given, (F.col("s.__run") == F.col("t.__key")) & first & test).select(*columns)
    else:
        asked = segments.select(F.col(key).alias("__id"), F.explode(runs).alias("__key"))
        given = rx.withColumn("__ord", F.xxhash64(F.to_json(F.struct(*terms.columns)))).select("__ord", F.explode("__runs").alias("__key"))
        pairs = asked.join(given, "__key").select("__id", "__ord").distinct()
        rx = rx.withColumn("__ord", F.xxhash64(F.to_json(F.struct(*terms.columns))))
        met = segments.alias("s").join(pairs.alias("p"), F.col(f"s.{key}") == F.col("p.__id"))
        found = met.join(rx.alias("t"), (F.col("p.__ord") == F.col("t.__ord")) & test).select(*columns)
    if not size["loose"]:
        return found
    tried = segments.alias("s").join(sized(rx.where("size(__runs) = 0").drop("__ord")).alias("t"), test)
    return found.unionByName(tried.select(*columns))


def grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


#: A needle is met by as many of its characters, or by all of a shorter one.
GRAM = 3
#: So many needles are looked for in a text one by one, without its runs of characters.
FEW_NEEDLES = 64


def holding(rows: DataFrame, needles: DataFrame, text: str, needle: str, key: str = "sid", fold: bool = False) -> DataFrame:
    """Rows and the needles(…, needle) that their text holds as a substring, lower-cased if `fold`: an equi-join, no loop over pairs.

    Each needle is met by one of its runs of GRAM characters, that which fewest needles hold; then the text decides.
    Of at most FEW_NEEDLES the text itself says which it holds, and only those make rows.
    Few needles are broadcast; many meet narrow rows of `key`, which identifies a row, and texts come back for what was met.
    Empty needles and null texts meet nothing."""
    low = F.lower if fold else (lambda c: c)
    own_columns = [c for c in needles.columns if c not in rows.columns]
    given = needles.withColumn("__n", low(F.col(needle))).where("length(__n) > 0").withColumn("__size", F.least(F.length("__n"), F.lit(GRAM)))
    small = needles.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    few = [r[0] for r in given.select("__n").distinct().limit(FEW_NEEDLES + 1).collect()] if small else []
    if 0 < len(few) <= FEW_NEEDLES:
        # The text is lower-cased in a step of its own, once for all needles.
        asked = rows.withColumn("__t", low(F.col(text))).withColumn("__n", F.explode(F.array_compact(F.array(*[F.when(F.contains("__t", F.lit(n)), F.lit(n)) for n in sorted(few)]))))
        return asked.join(F.broadcast(given.select("__n", *own_columns)), "__n").select(*rows.columns, *own_columns)
    own = reduce(lambda acc, k: F.when(F.col("__size") == k, grams(F.col("__n"), k)).otherwise(acc), range(1, GRAM), grams(F.col("__n"), GRAM))
    each = given.select("__n", "__size", own.alias("__own")).distinct().select("__n", "__size", F.explode("__own").alias("__g"))
    often = each.groupBy("__g").agg(F.count("*").alias("__often"))
    anchors = each.join(often, "__g").groupBy("__n").agg(F.min_by("__g", F.struct("__often", F.xxhash64("__g"))).alias("__g"))
    sizes = [r[0] for r in given.select("__size").distinct().orderBy("__size").collect()]
    if not sizes:
        return rows.join(needles.select(*own_columns), F.lit(False))
    t = low(F.col(text))
    met = F.explode(reduce(F.array_union, [grams(t, k) for k in sizes]))
    if small:
        given = F.broadcast(given.join(F.broadcast(anchors), "__n"))
        found = rows.withColumn("__g", met).join(given.select("__g", "__n", *own_columns), "__g").where(F.contains(t, F.col("__n")))
    else:
        pairs = rows.select(F.col(key).alias("__id"), met.alias("__g")).join(anchors, "__g").select("__id", "__n").distinct()
        found = rows.join(pairs, rows[key] == pairs["__id"]).where(F.contains(t, F.col("__n"))).join(given.select("__n", *own_columns), "__n")
    return found.select(*rows.columns, *own_columns)


def web_hits(segments: DataFrame, terms: DataFrame, text: str = "src_text", key: str = "sid") -> DataFrame:
    """The browser's rule: a case-insensitive substring."""
    return holding(segments, active(terms), text, "term", key, fold=True)


def signature(prefix: str = "") -> Column:
    """term|zh|mode|note|sorted aliases: what a prompt depends on."""
    c = lambda n: F.coalesce(F.col(prefix + n), F.lit(""))
    return F.concat_ws("|", c("term"), c("zh"), c("mode"), c("note"), F.array_join(F.array_sort(F.coalesce(F.col(prefix + "aliases"), F.array().cast("array<string>"))), ","))


def hits_signature(signatures: Column) -> Column:
    return F.array_join(F.array_sort(signatures), " ;; ")


def prompt_block(terms: DataFrame, include_hard: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """The terms as lines for a prompt, one block per `keys`."""
    hint = F.concat(F.lit("- "), "term", F.lit(" -> 「"), "zh", F.lit("」"), F.when(F.length("note") > 0, F.concat(F.lit("（"), "note", F.lit("）"))).otherwise(""))
    hard = F.concat(F.lit("- "), "term", F.lit(" -> 「"), "zh", F.lit("」（统一用此译名）"))
    rows = active(terms).where((F.col("mode") == HINT) | F.lit(include_hard)).withColumn("line", F.when(F.col("mode") == HINT, hint).otherwise(hard))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("block"))


#: A pattern that never matches.
NEVER = "(?!)"


def protected(text: Column, term: Column, zh: Column, variants: Column, aliases: Column) -> Column:
    """One hard term on a translation: brackets, prefixed forms, the term itself, then its aliases (long first).

    A bracketed term stays where its translation stands within 40 characters before it, and is named in full
    where it does not; a term that a text introduces as an abbreviation stays. Guards stand behind what they guard,
    so that the engine looks back only from a hit. Of literal terms all patterns are folded at plan time."""
    t, z = quoted(term), quoted(zh)
    put = lambda *c: F.regexp_replace(F.concat(*c), r"([\\$])", r"\\$1")
    rx = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    near = rx(".{0,", F.greatest(40 - F.length(zh), F.lit(0)).cast("string"), "}")
    far = rx(".{0,", F.greatest(49 - F.length(zh), F.lit(0)).cast("string"), "}")
    some, prefixed = F.length(zh) > 0, variants & term.rlike("^[A-Z][A-Za-z0-9]{0,7}$") & T.has_cjk(zh)
    steps = [
        (some, rx("(?s)[（(](?<!", z, near, r"[（(])\s*[a-z]?", t, r"\s*[）)]"), put(F.lit("（"), zh, F.lit("）"))),
        (some, rx("(?s)[（(](?<=", z, near, r"[（(])\s*[a-z]?", t, r"\s*[）)]"), put(F.lit("（"), term, F.lit("）"))),
        *[(prefixed, rx(f"(?<![A-Za-z]){letter}", t, "(?![A-Za-z])"), put(F.lit(word), zh)) for letter, word in PREFIX_ZH.items()],
        (prefixed, rx("(?<![A-Za-z])([a-z])", t, "(?![A-Za-z])"), F.concat(F.lit("$1"), put(zh))),
    ]
    # An introduced abbreviation stays; so does a closed bracket behind its translation.
    noted = F.when(some, rx("(?!(?<=", z, far, "[（(]", t, ")[）)])")).otherwise("")
    steps.append((F.lit(True), rx("(?s)(?<![A-Za-z])", t, rf"(?![A-Za-z])(?<!{ABBR_INTRO}\s{{0,8}}", t, ")", noted), put(zh)))
    ordered = F.transform(F.array_sort(F.transform(aliases, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("a")))), lambda x: x["a"])
    usable = F.filter(ordered, lambda x: (F.length(x) > 0) & (x != zh) & (x != term))

    def replaced(v: Column) -> Column:
        # Each step names its input once: a chain of terms stays linear in their number.
        out = reduce(lambda c, x: F.regexp_replace(c, F.when(x[0], x[1]).otherwise(NEVER), x[2]), steps, v)
        return F.aggregate(usable, F.when(F.contains(v, term), out).otherwise(v), lambda acc, x: F.replace(acc, x, zh))

    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def hard_replace(text: Column, terms: list[dict]) -> Column:
    """All hard terms of one resolved glossary on a translation, the longest term first: one expression, folded at plan time."""
    own = [t for t in terms if t.get("mode", HINT) == HARD and t.get("status", "suggested") != "rejected"]

    def one(c: Column, t: dict) -> Column:
        aliases = F.array(*[F.lit(a) for a in t.get("aliases") or ()]).cast("array<string>")
        return protected(c, F.lit(t["term"]), F.lit(t["zh"]), F.lit(bool(t.get("prefix_variants", True))), aliases)

    return reduce(one, sorted(own, key=lambda t: -len(t["term"])), text)


def replaced_by_document(rows: DataFrame, resolved: DataFrame, text: str = "zh") -> DataFrame:
    """Rows(doc_id, ...) with the hard terms of their own document's glossary applied to a text column, the longest term first.

    resolved(doc_id, term, zh, mode, ...) comes from resolve(). A document's terms travel with it as one array, of
    the terms that were approved for it."""
    cols = resolved.columns
    variants = F.col("prefix_variants") if "prefix_variants" in cols else F.lit(True)
    aliases = F.coalesce(F.col("aliases") if "aliases" in cols else F.lit(None), F.array()).cast("array<string>")
    entry = F.struct((-F.length("term")).alias("n"), *(["ord"] if "ord" in cols else []), "term", "zh", variants.alias("variants"), aliases.alias("aliases"))
    own = resolved.where(F.col("mode") == HARD).groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(entry)).alias("__terms"))
    both = rows.join(own, rows["doc_id"] == own["__doc"], "left")
    out = F.aggregate("__terms", F.col(text), lambda acc, t: protected(acc, t["term"], t["zh"], t["variants"], t["aliases"]))
    return both.withColumn(text, F.when(F.col("__terms").isNull(), F.col(text)).otherwise(out)).drop("__doc", "__terms")


MINED = "array<struct<term:string,zh:string,mode:string,note:string,aliases:array<string>,full_en:string>>"


def mined(answers: DataFrame) -> DataFrame:
    """Terms from a provider's answers(doc_id, text): the JSON array in each, whatever stands around it, as suggested terms of the document.

    Entries without term or translation go; an unknown mode is a hard one; an alias equal to the translation goes.
    An answer that holds no array gives no row."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("text"), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", "")
    rows = answers.select("doc_id", F.posexplode(F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), MINED)).alias("ord", "t"))
    tidy = lambda c: F.trim(F.coalesce(F.col(f"t.{c}"), F.lit("")))
    aliases = F.filter(F.coalesce("t.aliases", F.array().cast("array<string>")), lambda a: (F.length(F.trim(a)) > 0) & (F.trim(a) != F.col("t.zh")))
    rows = rows.where((F.length(tidy("term")) > 0) & (F.length(tidy("zh")) > 0))
    return rows.select(
        "doc_id", "ord", tidy("term").alias("term"), tidy("zh").alias("zh"), F.when(F.col("t.mode").isin(HARD, HINT), F.col("t.mode")).otherwise(HARD).alias("mode"),
        F.nullif(tidy("note"), F.lit("")).alias("note"), F.transform(aliases, lambda a: F.trim(a)).alias("aliases"), F.concat(F.lit("doc:"), "doc_id").alias("scope"), F.lit("suggested").alias("status"),
    )


def pending_terms(definitions: DataFrame) -> DataFrame:
    """What stands for mined terms where no answer came: each definition(doc_id, abbr, full), its translation still to be approved."""
    one = definitions.groupBy("doc_id", F.col("abbr").alias("term")).agg(F.min("full").alias("full_en"))
    return one.select("doc_id", "term", "full_en", F.concat(F.lit("【待审核: "), "full_en", F.lit("】")).alias("zh"))


def documents_with_glossaries(glossaries: DataFrame, library: DataFrame) -> DataFrame:
    """(doc_id, title, n_terms): documents that have a glossary(doc_id, title, terms), and the library's(doc_id, title) others, with none."""
    own = glossaries.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), "doc_id").alias("title"), F.coalesce(F.size("terms"), F.lit(0)).alias("n_terms"))
    return own.unionByName(library.join(own, "doc_id", "left_anti").select("doc_id", "title", F.lit(0).alias("n_terms")))


def landing(segments: DataFrame, terms: DataFrame, accept_aliases: bool = False) -> DataFrame:
    """Per hard term: segments that hold it, those whose translation lacks it, and the first of these.

    `segments` has sid, seg_pos, src_text and zh; segments without a translation are left out."""
    own = hits(segments.where("length(zh) > 0"), terms.where(F.col("mode") == HARD).withColumnRenamed("zh", "term_zh"))
    there = F.contains("zh", "term_zh")
    if accept_aliases:
        there = there | F.exists("aliases", lambda a: F.contains("zh", a))
    return own.groupBy("term", "term_zh").agg(
        F.count("*").alias("n_hit"), F.count_if(~there).alias("n_missing"), F.min_by("sid", F.when(~there, F.struct("seg_pos", "sid"))).alias("first_missing")
    )


# Fixed value: what may stand in a translation instead of a term.
PROBE = "[A-Z]{2,8}|背外侧|腹外侧|额叶|停止信号|反应时|前额叶"


def landing_examples(segments: DataFrame, terms: DataFrame, limit: int = 2, width: int = 150) -> DataFrame:
    """(term, term_zh, n_missing, examples): hard terms that translations lack, aliases accepted, the most missed first; of the first segments
    of each, the ordinal and what may stand for the term."""
    own = hits(segments.where("length(zh) > 0"), terms.where(F.col("mode") == HARD).withColumnRenamed("zh", "term_zh"))
    lost = own.where(~F.contains("zh", "term_zh") & ~F.exists("aliases", lambda a: (F.length(a) > 0) & F.contains("zh", a)))
    seen = F.substring(F.array_join(F.array_distinct(F.regexp_extract_all("zh", F.lit(PROBE), F.lit(0))), " / "), 1, width)
    line = F.concat(F.element_at(F.split("sid", "#"), -1), F.lit(": "), seen)
    rank = F.row_number().over(Window.partitionBy("term", "term_zh").orderBy("doc_id", "seg_pos"))
    rows = lost.select("term", "term_zh", rank.alias("r"), line.alias("line")).groupBy("term", "term_zh")
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= limit, F.struct("r", "line"))))
    return rows.agg(F.count("*").alias("n_missing"), F.array_join(F.transform(first, lambda x: x["line"]), " | ").alias("examples")).orderBy(F.desc("n_missing"), "term")


def density(segments: DataFrame, terms: DataFrame, top: int = 8, key: str = "sid") -> DataFrame:
    """The translations that occur most in the translated text, and whether they read badly."""
    n = F.sum(T.occurrences(F.col("zh"), F.col("term_zh"))).cast("long")
    rows = segments.select((F.col(key) if key in segments.columns else F.xxhash64("zh")).alias("__row"), "zh")
    met = holding(rows, terms.select("term", F.col("zh").alias("term_zh")), "zh", "term_zh", "__row")
    got = met.groupBy("term", "term_zh").agg(n.alias("n"))
    return got.withColumn("flag", T.suspicious_term(F.col("term_zh"))).orderBy(F.desc("n"), "term").limit(top)


def search(terms: DataFrame, query: str, mode: str | None = None) -> DataFrame:
    """Terms of a mode whose term, translation, note or any alias holds the query."""
    q = F.lit(query.lower())
    found = reduce(lambda a, c: a | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q), ("term", "zh", "note"), F.exists("aliases", lambda a: F.contains(F.lower(a), q)))
    return terms.where(found if mode is None else found & (F.col("mode") == mode))


def stats(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count("*").alias("total"), F.count_if(F.col("mode") == HARD).alias("hard"), F.count_if(F.col("mode") == HINT).alias("hint"), F.count_if(F.col("scope").startswith("doc:")).alias("doc_terms"))
