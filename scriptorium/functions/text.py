"""Text functions. All are Column -> Column and stay inside the JVM.

Patterns go through F.lit, since a SQL string literal would eat their backslashes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = ["of", "the", "in", "and", "for", "to", "a", "an", "on", "with", "by", "as", "at", "from", "or", "its", "their", "that", "which"]
CJK = "[一-鿿]"
NUMBER = r"(?<![A-Za-z0-9.])([0-9]+(?:[.,][0-9]+)?)(?![A-Za-z0-9])"
LATIN_WORD = r"[A-Za-z][A-Za-z'\-]{1,}"
ZH_SENTENCE = "[^。！？；\n]+[。！？；\n]*"
LATIN_RUN = r"[A-Za-z0-9][A-Za-z0-9\-.]*"
JOURNAL_PREFIXES = ["Nature reviews. ", "Nature reviews ", "Nature Reviews. ", "Nature Reviews "]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ENGLISH_DOTTED = ["Fig", "Figure", "Ref", "et al", "vs", "dr", "mr", "mrs", "prof"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&shy;": "­", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&deg;": "°", "&micro;": "µ", "&alpha;": "α", "&beta;": "β", "&gamma;": "γ", "&times;": "×", "&plusmn;": "±"}


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fingerprint(text: Column) -> Column:
    """SHA-1 of the UTF-8 text, hex: detects changed content."""
    return F.sha1(text)


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by a unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\x1f"))]), 256)


def slug(title: Column, limit: int = 40) -> Column:
    """A path-safe name: ASCII letters and digits stay, other ASCII becomes a dash, others `u` and their code.

    Cut on whole atoms at `limit`; a cut name ends at its last dash."""
    base = F.regexp_replace(F.lower(squash_ends(title)), "[‘’“”]", "")
    # A character makes an atom of at least one: those behind the limit tell no more than that the name is cut.
    base = F.substring(base, 1, limit + 1)

    def code(c: Column) -> Column:
        h = F.lower(F.hex(F.ascii(c).cast("long")))
        return F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h)

    atoms = F.transform(
        F.filter(F.split(base, ""), lambda c: F.length(c) > 0),
        lambda c: F.when(c.rlike("^[a-z0-9]$"), c).when(F.ascii(c) < 128, F.lit("-")).otherwise(F.concat(F.lit("u"), code(c))),
    )

    def take(acc: Column, a: Column) -> Column:
        fits = ~acc["cut"] & (F.length(acc["s"]) + F.length(a) <= limit)
        return F.struct(F.when(fits, F.concat(acc["s"], a)).otherwise(acc["s"]).alias("s"), (~fits).alias("cut"))

    got = F.aggregate(atoms, F.struct(F.lit("").alias("s"), F.lit(False).alias("cut")), take)
    flat = let(got, lambda g: F.struct(F.regexp_replace(F.regexp_replace(g["s"], "-+", "-"), "^-|-$", "").alias("s"), g["cut"].alias("cut")))
    back = let(flat, lambda g: F.when(g["cut"] & F.contains(g["s"], F.lit("-")), F.regexp_replace(g["s"], "-+[^-]*$", "")).otherwise(g["s"]))
    return let(back, lambda b: F.when(F.length(b) > 0, b).otherwise(F.lit("sec")))


def segment_id(doc_id: Column, path: Column, index: Column) -> Column:
    return F.format_string("%s#%s#%02d", doc_id.cast("string"), path, index.cast("int"))


def clean(text: Column) -> Column:
    """No-break spaces to spaces, soft hyphens dropped, trimmed."""
    return F.trim(F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("­"), F.lit("")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f reads it, also inside of lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squash(text: Column) -> Column:
    """Runs of any Unicode space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_bold(font: Column, flags: Column) -> Column:
    return font.rlike("Bold|Semibold|Medium") | (flags.bitwiseAND(16) != 0)


def font_family(font: Column) -> Column:
    """The part before a dash, underscore or comma, without closing digits."""
    return F.regexp_replace(F.regexp_extract(font, r"^([^\-_,]*)", 1), "[0-9]+$", "")


def join_lines(lines: Column) -> Column:
    """Join layout lines; a word broken by one hyphen at a line's end is put together."""
    text = F.array_join(F.transform(lines, lambda t: F.trim(t)), "\n")
    # Most lines end on whole words and hold single spaces: patterns are left for the others.
    whole = let(text, lambda t: F.replace(F.when(F.contains(t, F.lit("-\n")), F.regexp_replace(t, r"(?<!-)-\n", "")).otherwise(t), F.lit("\n"), F.lit(" ")))
    uneven = lambda t: F.contains(t, F.lit("  ")) | F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" ")) | t.rlike(r"(?U)[^\S ]")
    return let(whole, lambda t: F.when(uneven(t), squash(t)).otherwise(t))


def ends_sentence(text: Column) -> Column:
    """A text's last character, closing quotes and brackets aside, is one that ends a sentence or opens a list."""
    last = lambda t, *c: F.right(t, F.lit(1)).isin(*c)
    bare, ends = F.rtrim(text, F.lit("\"”’)")), ("\n", "\r", "\x85", "\u2028", "\u2029")
    # Before a line's end that closes the text `$` stands as well.
    odd = last(text, *ends) | last(bare, *ends)
    return F.when(odd, F.regexp_replace(text, "[\"”’)]+$", "").rlike(r"[.?!:]$")).otherwise(last(bare, ".", "?", "!", ":"))


def strip_panel_letter(title: Column) -> Column:
    """Drop a figure-panel letter that sticks to a heading's end."""
    cut = F.trim(F.regexp_replace(F.rtrim(title), r"[.\-–]\s*[a-h]$", ""))
    return F.when(F.length(cut) > 0, cut).otherwise(title)


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)


def word_count(text: Column, dialect: str = "html") -> Column:
    """pdf: runs of letters; html: tokens between spaces; web: runs of letters and digits."""
    if dialect == "html":
        return F.size(space_tokens(text))
    if dialect == "pdf":  # every letter is in a run, so that one letter for each run is all the letters there are
        short = F.regexp_replace(text, r"[A-Za-z][A-Za-z'\-]*", "a")
        return F.length(short) - F.length(F.replace(short, F.lit("a"), F.lit("")))
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9\-']+"))


ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});"


def unescape(text: Column) -> Column:
    """HTML entities in one pass: the named ones of ENTITIES, `&amp;`, decimal and hexadecimal ones; others stay."""
    named = F.create_map(*[F.lit(x) for kv in {**ENTITIES, "&amp;": "&"}.items() for x in kv])

    def one(e: Column) -> Column:
        digits = F.regexp_extract(e, r"^&#[xX]?([0-9A-Fa-f]+);$", 1)
        code = F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(e.rlike("^&#"), F.when(known, char).otherwise("�")).otherwise(F.coalesce(F.try_element_at(named, e), e))

    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), one)
    # Zipped, not looked up: what a lambda names is worked out again for each element.
    pieces = F.zip_with(F.split(text, ENTITY, -1), found, lambda g, e: F.concat(g, F.coalesce(e, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def unescape_all(text: Column) -> Column:
    """Every HTML entity (Arrow batches; for text that holds entities beyond the common ones)."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda t: html.unescape(t) if isinstance(t, str) else t)

    return of(text)


CITATION_MARK = r"\[[0-9]+(?:[,\s\-–—0-9]*)\]"


def clean_paragraph(raw: Column, dialect: str = "html") -> Column:
    """A paragraph's HTML as text, citations as [N], without tables, figures, tags and reprint notes."""
    digits = r"([0-9]+(?:[,\s\-–—0-9]*))"
    s = raw
    if dialect == "html":
        for attr in ('data-test="citation-ref"', 'data-track-action="reference anchor"'):
            s = F.regexp_replace(s, rf"<a\b[^>]*{attr}[^>]*>{digits}</a>", " [$1]")
        s = F.regexp_replace(s, r"<sup\b[^>]*>([0-9,\s\-–—]+)</sup>", " [$1]")
        for attr in ('data-test="citation-ref"', 'data-track-action="reference anchor"'):
            s = F.regexp_replace(s, rf"(?s)<a\b[^>]*{attr}[^>]*>.*?</a>", "")
    else:
        s = F.regexp_replace(s, r"(?s)<sup\b[^>]*>\s*(?:<a\b[^>]*>)?\s*([0-9][0-9,\s\-–—]*)(?:</a>)?\s*</sup>", " [$1]")
        s = F.regexp_replace(s, r"(?s)<sup\b[^>]*>(.*?)</sup>", "^$1")
        s = F.regexp_replace(s, r'(?s)<div\b[^>]*class="[^"]*equation[^"]*"[^>]*>.*?</div>', "")
    s = F.regexp_replace(s, r"(?s)<(figure|table|tbody|thead|tr)\b[^>]*>.*?</\1>", "")
    s = unescape(F.regexp_replace(s, r"<[^>]+>", ""))
    s = squash(F.replace(F.replace(s, F.lit(" "), F.lit(" ")), F.lit("­"), F.lit("")))
    s = F.regexp_replace(s, rf"\s+({CITATION_MARK})", "$1")
    return F.trim(F.regexp_replace(s, r"(?i)(?:Reprinted|Adapted)\s+with\s+permission\s+from\s+.*$", ""))


def list_paragraph(intro: Column, items: Column) -> Column:
    """An introduction that ends with a colon and its list as one paragraph: `intro 1. a; 2. b`."""
    cleaned = F.filter(F.transform(items, lambda x, i: F.struct(clean_paragraph(x).alias("t"), (i + 1).alias("n"))), lambda s: F.length(s["t"]) > 0)
    numbered = F.transform(cleaned, lambda s: F.when(s["t"].rlike(r"^[0-9]+\."), s["t"]).otherwise(F.concat(s["n"].cast("string"), F.lit(". "), s["t"])))
    return F.when(F.size(numbered) > 0, F.concat_ws(" ", intro, F.array_join(numbered, "; "))).otherwise(intro)


def initials(full: Column) -> Column:
    """Upper-case initials of the words that are no function words."""
    words = F.filter(F.regexp_extract_all(full, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~F.lower(w).isin(STOP_WORDS))
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the needle's characters occur in the hay in order."""
    parts = F.transform(F.filter(F.split(needle, ""), lambda c: F.length(c) > 0), lambda c: F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1"))
    return F.regexp_like(hay, F.array_join(parts, ".*"))


def initials_fit(abbr: Column, full: Column) -> Column:
    """The abbreviation is a subsequence of the full name's initials, which are at most three more."""
    a = F.upper(abbr)
    return let(initials(full), lambda s: (F.length(a) >= 2) & (F.length(s) > 0) & is_subsequence(a, s) & (F.length(s) <= F.length(a) + 3))


def normal(text: Column, fold_dash: bool = False) -> Column:
    """Lower case, spaces squashed; a dash counts as a space if asked."""
    return F.lower(squash(F.replace(text, F.lit("-"), F.lit(" ")) if fold_dash else text))


def is_abbreviation(term: Column) -> Column:
    return F.trim(term).rlike("^[A-Z][A-Za-z0-9]{0,7}$")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def normalize_zh(text: Column) -> Column:
    """Fold words doubled across blanks, full-width digits to half, separators of exactly three digits to commas. Idempotent."""
    s = F.regexp_replace(text, rf"({CJK}{{2,6}})[ \t]+\1", "$1")
    s = F.translate(s, "０１２３４５６７８９", "0123456789")
    return F.regexp_replace(s, r"(?<=[0-9])[，､．](?=[0-9]{3}(?![0-9]))", ",")


def reading_length(text: Column) -> Column:
    """Length as read: a run of Latin letters and digits counts 1, spaces 0."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, LATIN_RUN, "X"), r"(?U)\s+", "")), F.lit(0))


def polyphones(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, longest word first, each on the result of those before."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), ordered, text)


def spell_capitals(text: Column, joiner: str = "-") -> Column:
    """Runs of two to six capitals that stand alone are spelt out: RAI -> R-A-I.

    Each run is found with what surrounds it by splitting, so longer runs stay whole."""
    pattern = r"(?<![A-Za-z0-9\-])[A-Z]{2,6}(?![A-Za-z0-9\-])"
    runs, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    spelt = F.transform(runs, lambda r: F.array_join(F.filter(F.split(r, ""), lambda c: F.length(c) > 0), joiner))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(spelt, i), F.lit("")))), "")


def spoken(text: Column, rules: Sequence[tuple[str, str]] = (), joiner: str = "-") -> Column:
    """A script as the speech engine should read it."""
    s = polyphones(spell_capitals(text, joiner), rules)
    s = F.regexp_replace(s, r"[ \t]+", " ")
    return F.coalesce(squash_ends(F.replace(F.replace(s, F.lit("——"), F.lit("，")), F.lit("……"), F.lit("。"))), F.lit(""))


def squash_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def zh_sentences(text: Column, trimmed: bool = False) -> Column:
    """Sentences with their closing marks; blank ones dropped."""
    got = F.regexp_extract_all(text, F.lit(ZH_SENTENCE), F.lit(0))
    if trimmed:
        got = F.transform(got, squash_ends)
    return F.filter(got, lambda s: F.length(squash_ends(s)) > 0)


def en_sentences(text: Column) -> Column:
    """English sentences; dots of some abbreviations and of decimals do not end one. A text without a sentence is one."""
    mark = "__DOT__"
    s = F.regexp_replace(text, r"(?i)\b(e|i)\.(g|e)\.", f"$1{mark}$2{mark}")
    s = F.regexp_replace(s, rf"(?i)\b({'|'.join(ENGLISH_DOTTED)})\.", f"$1{mark}")
    s = F.regexp_replace(s, r"([0-9]+)\.([0-9]+)", f"$1{mark}$2")
    parts = F.regexp_extract_all(s, F.lit(r"[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$"), F.lit(0))
    got = F.filter(F.transform(parts, lambda p: squash_ends(F.replace(p, F.lit(mark), F.lit(".")))), lambda p: F.length(p) > 0)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(text)).otherwise(got)


def feed_date(year: Column, month: Column, day: Column, medline: Column) -> Column:
    """Year-Month-Day with 00 where a part is missing; a bare year without month; `YYYY-MM` of a free-form date, else that."""
    names = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    number = lambda c: F.coalesce(F.when(c.rlike("^[0-9]+$"), c.cast("int")), F.lit(0))
    m = F.coalesce(F.try_element_at(names, F.lower(month)), number(month))
    free = F.when(
        medline.rlike(r"^[0-9]{4}"),
        F.concat(F.substring(medline, 1, 4), F.lit("-"), F.lpad(F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract(medline, r"^[0-9]{4}\s*([A-Za-z]{3})", 1))), F.lit(0)).cast("string"), 2, "0")),
    ).otherwise(F.coalesce(medline, F.lit("")))
    full = F.concat(year, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(number(day).cast("string"), 2, "0"))
    return F.when(F.coalesce(F.length(year), F.lit(0)) == 0, free).when(m > 0, full).otherwise(year)


def doc_id_of_doi(doi: Column, fallback: Column | None = None, dialect: str = "html") -> Column:
    """What follows the DOI's first slash; a DOI without one is kept; an empty one gives the fallback."""
    d = F.trim(F.coalesce(doi, F.lit("")))
    if dialect == "web":
        got = F.regexp_replace(d, r"^10\.[0-9]+/", "")
        return F.when(F.length(got) > 0, got).otherwise(F.concat(F.lit("pmid-"), lit("" if fallback is None else fallback)))
    got = F.when(F.instr(d, "/") > 0, F.trim(F.regexp_replace(d, r"^[^/]*/", ""))).otherwise(d)
    return got if fallback is None else F.when(F.length(got) > 0, got).otherwise(fallback)


def without_prefix(journal: Column) -> Column:
    """A journal's name without the first of JOURNAL_PREFIXES that it starts with."""
    return reduce(lambda c, p: F.when(journal.startswith(p), F.substr(journal, F.lit(len(p) + 1))).otherwise(c), reversed(JOURNAL_PREFIXES), journal)


def field_of_journal(journal: Column) -> Column:
    """A glossary field from a journal's name."""
    bare = without_prefix(F.trim(F.coalesce(journal, F.lit(""))))
    s = F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit("unknown"))


def short_journal(journal: Column, abbr: Column | None = None, prefixed: bool = False) -> Column:
    name = F.coalesce(journal, F.lit(""))
    bare = without_prefix(name)
    had = bare != name
    if prefixed:
        return F.when(had, F.concat(F.lit("Nature Reviews "), bare)).otherwise(F.coalesce(journal, F.lit("")))
    return bare if abbr is None else F.when(F.coalesce(F.length(abbr), F.lit(0)) > 0, abbr).otherwise(bare)


def preserve_ratio(script: Column, source: Column) -> Column:
    return F.round(F.length(script) / F.greatest(F.length(source), F.lit(1)), 3)


def lrc_time(seconds: Column) -> Column:
    return F.format_string("[%02d:%05.2f]", F.floor(seconds / 60).cast("int"), seconds % 60)


def vtt_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%06.3f", F.floor(seconds / 3600).cast("int"), F.floor((seconds % 3600) / 60).cast("int"), seconds % 60)


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def minutes_zh(seconds: Column) -> Column:
    return F.format_string("%d 分 %d 秒", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def rate_to_speed(rate: Column) -> Column:
    """`+20%` -> 1.2, within 0.5 and 2; anything else 1."""
    r = F.regexp_replace(F.trim(rate), "%$", "").try_cast("double")
    return F.when(r.isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(2.0), 1 + r / 100)))


def mp3_seconds(size: Column) -> Column:
    """24 kHz, 48 kbit/s: 144 bytes are 24 ms."""
    return F.round(size / 144.0 * 0.024, 4)


def silence_seconds(ms: Column) -> Column:
    """Whole frames of silence; a tie goes to the even number of frames."""
    return F.round(F.greatest(F.lit(1), F.bround(ms / 24.0, 0)) * 0.024, 4)


def superscript_citations(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\[((?:ref\.\s*)?[0-9]+(?:[,\s\-–—0-9]*)|\w+)\]", '<sup class="cite-sup">[$1]</sup>'), F.lit(""))


def escape_html(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], text)


def safe_id(sid: Column, dialect: str = "html") -> Column:
    return F.translate(sid, "#/", "__") if dialect == "html" else F.regexp_replace(sid, "[^A-Za-z0-9_-]", "_")


def short_sid(sid: Column) -> Column:
    p = F.split(sid, "#")
    return F.when(F.size(p) >= 3, F.concat(F.substring(F.get(p, F.lit(1)), 1, 34), F.lit("…/"), F.element_at(p, -1))).otherwise(sid)


def numbers(text: Column) -> Column:
    """Numbers that do not touch Latin letters or digits."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def suspicious_term(zh: Column) -> Column:
    """A translation that would read badly if it stood everywhere."""
    return F.when(zh.rlike("[（(]"), "bracket").when(F.length(zh) >= 10, "long").otherwise("")


def web_slug(title: Column, limit: int = 30) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^a-z0-9一-鿿]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, limit)
    return F.when(F.length(s) > 0, s).otherwise(F.lit("section"))


def clean_id(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(html|pdf)$", "")


def rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """An ordered list of case-insensitive pattern replacements."""
    return reduce(lambda c, r: F.regexp_replace(c, f"(?i){r[0]}", r[1]), rules, text)


def filled(template: str, slots: dict[str, Column]) -> Column:
    """A template with named slots in braces, each filled once; what a slot brings in is not read again."""
    parts = re.split(r"\{([a-z_]+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else F.coalesce(slots[x].cast("string"), F.lit("")) for i, x in enumerate(parts)])


def occurrences(text: Column, needle: Column) -> Column:
    """How often a literal occurs without overlaps."""
    n = F.length(needle)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / n).cast("int")).otherwise(F.lit(0))


def upper_median(values: Column) -> Column:
    """The element at position n/2 of the sorted values (0 where there are none)."""
    s = F.array_sort(values)
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(0))


def order_statistic(values: Column, share: float) -> Column:
    """The element at int(n * share) of the sorted values, nulls last."""
    # sort_array() needs no comparator, but has nulls first.
    nulls = F.size(values) - F.size(F.array_compact(values))
    return F.get(F.sort_array(values), F.floor(F.size(values) * share).cast("int") + nulls)
