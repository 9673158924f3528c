"""Abbreviations: definitions in text, usage, audits against a glossary, homonym conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

# The shapes of an abbreviation and of its definition.
ABBR = "[A-Z][A-Za-z0-9]{1,7}"
FULL_FIRST = rf"\b((?:[A-Za-z][A-Za-z\-']*\s+){{1,6}}[A-Za-z][A-Za-z\-']*)\s*\(\s*({ABBR})\s*\)"
ABBR_FIRST = rf"\b({ABBR})\s*\(\s*([a-z][A-Za-z\-']*(?:\s+[A-Za-z\-']+){{0,6}})\s*\)"


def shortest_suffix(abbr: Column, phrase: Column) -> Column:
    """The shortest end of the phrase whose words' initials spell the abbreviation, function words aside; null if none.

    Read from the right: each word must give the next letter; hyphenated parts are words."""
    words = F.regexp_extract_all(phrase, F.lit("[A-Za-z]+"), F.lit(0))
    gaps = F.split(phrase, "[A-Za-z]+", -1)
    letters = F.reverse(F.filter(F.split(F.upper(abbr), ""), lambda c: F.length(c) > 0))

    def spans(v: Column) -> Column:
        """Words with the position of their first and last character."""

        def step(acc: Column, i: Column) -> Column:
            w = F.get(v["words"], i)
            s = acc["at"] + F.length(F.get(v["gaps"], i))
            return F.struct((s + F.length(w)).alias("at"), F.concat(acc["out"], F.array(F.struct(w.alias("w"), s.alias("s"), (s + F.length(w)).alias("e")))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<w:string,s:int,e:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(v["words"]) - 1), start, step)["out"]

    def walked(v: Column) -> Column:
        need = v["need"]

        def take(acc: Column, x: Column) -> Column:
            done = acc["k"] >= F.size(need)
            skip = F.lower(x["w"]).isin(T.STOP_WORDS)
            fits = F.upper(F.substring(x["w"], 1, 1)) == F.get(need, acc["k"])
            on = acc["ok"] & ~done & ~skip
            return F.struct(
                F.when(on & fits, acc["k"] + 1).otherwise(acc["k"]).alias("k"),
                F.when(on & ~fits, F.lit(False)).otherwise(acc["ok"]).alias("ok"),
                F.when(on & fits, x["s"]).otherwise(acc["s"]).alias("s"),
                F.when(on & fits & (acc["k"] == 0), x["e"]).otherwise(acc["e"]).alias("e"),
            )

        got = F.aggregate(F.reverse(spans(v)), F.struct(F.lit(0).alias("k"), F.lit(True).alias("ok"), F.lit(0).alias("s"), F.lit(0).alias("e")), take)
        return T.let(got, lambda g: F.when((F.size(v["words"]) > 0) & g["ok"] & (g["k"] == F.size(need)), F.trim(F.substring(phrase, g["s"] + 1, g["e"] - g["s"]))))

    return T.let(F.struct(words.alias("words"), gaps.alias("gaps"), letters.alias("need")), walked)


def definitions(texts: DataFrame) -> DataFrame:
    """(doc_id, abbr, full, pos): what `texts(doc_id, text)` define; per abbreviation and normalised name its first form."""
    def found(k: int, pattern: str, a: int, f: int) -> Column:
        zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(a)).alias("abbr"), F.regexp_extract_all("text", F.lit(pattern), F.lit(f)).alias("phrase"))
        return F.transform(zipped, lambda d, i: F.struct(d["abbr"].alias("abbr"), F.trim(d["phrase"]).alias("phrase"), (F.lit(k * 1_000_000) + i).alias("pos")))

    every = F.concat(found(0, FULL_FIRST, 2, 1), found(1, ABBR_FIRST, 1, 2))
    rows = texts.where(F.col("text").rlike(r"\(")).select("doc_id", F.inline(every))
    # Filters on what a generator gives stay behind it, so that the walk over a phrase's words is made once.
    both = rows.select("doc_id", "abbr", "pos", F.explode(F.array(shortest_suffix(F.col("abbr"), F.col("phrase")))).alias("full")).where("full is not null")
    both = both.where(T.initials_fit(F.col("abbr"), F.col("full"))).withColumn("full", T.squash(F.col("full")))
    return both.groupBy("doc_id", "abbr", T.normal(F.col("full")).alias("norm")).agg(F.min_by("full", "pos").alias("full"), F.min("pos").alias("pos"))


def web_initials_fit(abbr: Column, full: Column) -> Column:
    """The browser's rule: a subsequence of the initials or of the whole upper-cased name."""
    a = F.upper(abbr)
    return (F.length(a) >= 2) & (T.is_subsequence(a, T.initials(full)) | T.is_subsequence(a, F.upper(full)))


def usage(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, abbr, n): how often each document's prose uses each of its abbreviations, letters and digits not touching."""
    return counted(names.select("doc_id", "abbr").distinct(), texts)


def counted(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows(doc_id, abbr, ...) of different documents and abbreviations with `n`, their usage(); what the texts lack goes."""
    rx = F.concat(F.lit("(?<![A-Za-z0-9])"), F.col("abbr"), F.lit("(?![A-Za-z0-9])"))
    return texts.select("doc_id", "text").join(names, "doc_id").groupBy(*names.columns).agg(F.sum(F.regexp_count("text", rx)).cast("long").alias("n"))


def audit(defs: DataFrame, prose: DataFrame, glossary: DataFrame, min_count: int = 2, top: int = 40) -> DataFrame:
    """Defined abbreviations that the prose uses, most used first; their glossary entry by abbreviation, else by a full name; several names are ambiguous."""
    one = defs.groupBy("doc_id", "abbr").agg(F.array_sort(F.collect_set("full")).alias("fulls"))
    used = counted(one, prose).where(F.col("n") >= min_count)
    keys = glossary.groupBy(F.lower(F.trim("term")).alias("key")).agg(F.max_by("zh", "ord").alias("zh"))
    # The abbreviation is looked up as name 0, the full names as 1 and on: the used ones are made and joined once.
    asked = used.select("*", F.posexplode(F.concat(F.array("abbr"), "fulls")).alias("i", "name")).withColumn("key", F.lower("name"))
    found = asked.join(keys.withColumn("known", F.lit(True)), "key", "left")
    by_full = F.min_by("zh", F.when(F.col("known") & (F.col("i") > 0), F.col("i")))
    got = found.groupBy("doc_id", "abbr", "fulls", "n").agg(F.coalesce(F.max(F.when(F.col("i") == 0, F.col("zh"))), by_full).alias("glossary_zh"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "abbr"))
    return got.select("doc_id", "abbr", "n", F.array_join("fulls", " / ").alias("full_names"), F.col("glossary_zh").isNotNull().alias("in_glossary"), "glossary_zh", (F.size("fulls") > 1).alias("ambiguous"), rank.alias("rank")).where(F.col("rank") <= top)


def unused(defs: DataFrame, prose: DataFrame) -> DataFrame:
    """(doc_id, abbr): defined abbreviations that the document's prose(doc_id, text) never uses between letters."""
    names = defs.select("doc_id", "abbr").distinct()
    rx = F.concat(F.lit("(?<![A-Za-z])"), F.col("abbr"), F.lit("(?![A-Za-z])"))
    used = prose.join(names, "doc_id").where(F.regexp_like("text", rx)).select("doc_id", "abbr")
    return names.join(used, ["doc_id", "abbr"], "left_anti")


def undefined(glossary: DataFrame, defs: DataFrame) -> DataFrame:
    """Glossary entries that look like abbreviations and that no document defines."""
    return glossary.where(F.trim("term").rlike(f"^{ABBR}$")).join(defs.select(F.col("abbr").alias("__a")).distinct(), F.trim("term") == F.col("__a"), "left_anti")


def conflict_report(glossary: DataFrame, defs: DataFrame) -> DataFrame:
    """Per document and glossary abbreviation that it defines: `conflict` where the declared full name is none of the document's, `todo` where none is declared, else `ok`."""
    one = defs.groupBy("doc_id", "abbr").agg(F.array_sort(F.collect_set("full")).alias("fulls"))
    # An abbreviation of many documents and entries makes a row of each pair: all that needs one side alone is made before they meet.
    one = one.select("doc_id", "abbr", F.array_join("fulls", " / ").alias("fulls"), F.explode(F.array(F.transform("fulls", lambda f: T.normal(f)))).alias("norms"))
    own = glossary.where(F.trim("term").rlike(f"^{ABBR}$")).select(F.trim("term").alias("abbr"), "zh", F.explode(F.array(F.struct((F.length(F.trim("full_en")) == 0).alias("todo"), T.normal(F.col("full_en")).alias("norm")))).alias("e"))
    got = own.join(one, "abbr")
    return got.select("doc_id", "abbr", "zh", "fulls", F.when(F.col("e.todo"), "todo").when(F.array_contains("norms", F.col("e.norm")), "ok").otherwise("conflict").alias("verdict"))


def disambiguate(defs: DataFrame, glossary: DataFrame, prose: DataFrame, min_count: int = 2) -> DataFrame:
    """Resolved, conflict or unknown per used definition; the longest definition stands; a translation of the same full name under another entry can be reused.

    There is a row for each document that uses an abbreviation and each entry of it. These pairs are made last and go to no shuffle:
    of the entries of a full name only the first two can be reused, the second by the first one's own rows."""
    longest = defs.groupBy("doc_id", "abbr").agg(F.max_by("full", F.struct(F.length("full"), "full")).alias("full"))
    used = counted(longest, prose).where(F.col("n") >= min_count).withColumn("norm", T.normal(F.col("full"), True))
    other = glossary.where("length(full_en) > 0 and ord is not null").groupBy(T.normal(F.col("full_en"), True).alias("norm"), "ord").agg(F.min("zh").alias("zh"))
    other = other.withColumn("at", F.row_number().over(Window.partitionBy("norm").orderBy("ord"))).where("at <= 2")
    nth = lambda k, c: F.max(F.when(F.col("at") == k, F.col(c)))
    other = other.groupBy("norm").agg(nth(1, "ord").alias("o_ord"), nth(1, "zh").alias("o_zh"), nth(2, "zh").alias("o_next"))
    g = glossary.select(F.trim("term").alias("abbr"), "ord", "zh", "full_en").distinct()
    # As values of a generator the names of an entry are made normal once, not for each pair.
    g = g.select("abbr", "ord", "zh", "full_en", F.explode(F.array(T.normal(F.col("full_en"), True))).alias("g_norm"))
    got = used.join(other, "norm", "left").join(g, "abbr", "left")
    reusable = F.when(F.col("ord").eqNullSafe(F.col("o_ord")), F.col("o_next")).otherwise(F.col("o_zh"))
    verdict = F.when(F.col("zh").isNull(), "unknown").when(F.length("full_en") == 0, "unknown").when(F.col("norm") == F.col("g_norm"), "resolved").otherwise("conflict")
    return got.select("doc_id", "abbr", "full", "n", "ord", "zh", "full_en", reusable.alias("reusable_zh"), verdict.alias("verdict"))


def judged(answer: Column) -> Column:
    """A judge's answer: null where it says the names are the same, else its first line, cut."""
    head = F.upper(F.substring(F.trim(answer), 1, 6))
    return F.when(F.contains(head, F.lit("SAME")) | F.contains(head, F.lit("一致")), F.lit(None).cast("string")).otherwise(F.substring(F.trim(F.get(F.split(F.trim(answer), "\n"), F.lit(0))), 1, 24))
