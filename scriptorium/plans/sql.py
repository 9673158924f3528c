"""The queries of plans.queries as SQL for DuckDB.

RE2 has no look-around: a guard is a consumed neighbour, after every possible guard character is doubled.
"""

from __future__ import annotations

from scriptorium.functions import text as T
from scriptorium.operators import feed as E
from scriptorium.plans import base as B

SEG, FLAT = B.SEGMENTS, B.PAGES
TERMS = B.values([(i, t["term"], t["zh"], t["mode"], t.get("note", ""), ",".join(t.get("aliases", [])), t.get("status", "suggested")) for i, t in enumerate(B.TERMS)], "ord, term, zh, mode, note, aliases, status")
#: The terms' patterns, guards consumed.
RX = """CASE WHEN regexp_full_match(term, '[A-Z][A-Za-z0-9]{0,7}') THEN '(^|[^A-Za-z])[a-z]?' || term || 's?([^A-Za-z]|$)'
         ELSE '(?i)(^|[^A-Za-z])' || regexp_replace(term, '[\\s\\-/]+', '[\\s\\-/]+', 'g') || '(e?s)?([^A-Za-z]|$)' END"""
RX = RX.replace("\\\\", "\\").replace("'[\\s\\-/]+', 'g'", "'[\\\\s\\\\-/]+', 'g'")
HITS = f"hits AS (SELECT seg.*, t.* FROM seg JOIN (SELECT *, {RX} AS rx FROM {TERMS} WHERE status <> 'rejected') t ON regexp_matches(seg.src_text, t.rx))"
SCOPED = B.values(B.SCOPED, "ord, term, zh, mode, scope, status")
READERS = B.values(B.READERS, "doc_id, field")
RANKED = f"""ranked AS (SELECT * FROM (SELECT *, max(rank) OVER (PARTITION BY doc_id, key) AS top FROM (
    SELECT d.doc_id, t.ord, t.term, t.zh, t.scope, lower(trim(t.term)) AS key,
           CAST(CASE WHEN scope IN ('', 'global') THEN 0 WHEN scope = 'field:' || field THEN 1 WHEN scope = 'doc:' || doc_id THEN 2 ELSE -1 END AS INTEGER) AS rank
    FROM {SCOPED} t, {READERS} d WHERE status <> 'rejected') WHERE rank >= 0) WHERE rank = top)"""
DEFS = B.values(B.DEFINITIONS, "doc_id, abbr, fname")
ABBR_TEXTS = B.values(B.ABBREVIATION_TEXTS, "doc_id, text")
ABBR_GLOSS = B.values(B.ABBREVIATION_GLOSSARY, "ord, term, zh, full_en")
BRIEFS = B.values(B.BRIEFS, "id, text")
USED = f"""used AS (SELECT d.doc_id, d.abbr, any_value(len(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(^|[^A-Za-z0-9])' || abbr || '([^A-Za-z0-9]|$)'))) AS n,
    list_sort(list_distinct(list(fname))) AS fulls FROM {DEFS} d JOIN {ABBR_TEXTS} t USING (doc_id) GROUP BY 1, 2)"""
CONV = "conv AS (SELECT conv_id, turn, role, text, length(text) * 0.28::DOUBLE AS dur FROM conversations WHERE length(text) > 0)"
LINE = """line AS (SELECT conv_id, turn, dur, coalesce(sum(dur + 0.288::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM conv)"""
PAIRS = """pairs AS (SELECT * FROM (SELECT conv_id AS doc_id, conv_id || '#' || turn AS sid, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src, text AS zh FROM conversations) WHERE src IS NOT NULL AND length(zh) > 0)"""
LATIN = "len(regexp_extract_all({}, '[A-Za-z][A-Za-z''\\-]{{1,}}'))"
ITEMS = """items AS (SELECT CAST(event_id AS VARCHAR) AS pmid, event_id AS id, '10.1038/x' || event_id AS doi, 'x' || event_id AS doc_id, 'Nature reviews. ' || upper(event_type[1]) || lower(event_type[2:]) AS journal, 'T' || event_id AS title_en,
    CASE WHEN user_id % 5 = 0 THEN ' ' ELSE coalesce(props, '') END AS abstract, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 11 = 0 THEN '2026-09-00' ELSE strftime(ts, '%Y-%m-%d') END AS pub_date,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS entrez_date, event_type AS term_field, CASE WHEN event_id % 4 = 0 THEN 'shown' WHEN event_id % 9 = 0 THEN 'picked' ELSE 'new' END AS status, 'b' || event_id AS brief FROM events)"""
MEDIAN = "list_sort(list({0}))[count(*) // 2 + 1]"


def clusters(rows: str, gap: str) -> str:
    return f"""c AS (SELECT doc_id, v, sum(fresh) OVER (PARTITION BY doc_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (
        SELECT doc_id, v, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id ORDER BY v) > {gap} THEN 1 ELSE 0 END AS fresh FROM ({rows})))"""


def sid3() -> str:
    return "doc_id || '#' || substr(src_text, 1, 3)"


#: The segments of base.sectioned_pages().
SECTIONED = f"""{FLAT}, r AS (SELECT page_id AS doc_id, seg_pos - 1 AS i, src_text, (seg_pos - 1) // 6 AS k, CASE (seg_pos - 1) % 6 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS sub,
        (seg_pos - 1) % 6 = 3 AS fig, n_words FROM flat WHERE (seg_pos - 1) % 6 <> 5),
    h AS (SELECT *, CASE sub WHEN 1 THEN 'Sub ' || length(src_text) % 2 WHEN 2 THEN 'Deep' ELSE 'Part ' || k % 3 END AS heading,
        'part-' || k % 3 || CASE sub WHEN 1 THEN '/sub-' || length(src_text) % 2 WHEN 2 THEN '/deep' ELSE '' END AS base FROM r),
    x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY k, sub) AS n FROM (SELECT DISTINCT doc_id, k, sub, base FROM h)),
    z AS (SELECT h.*, CASE WHEN x.n > 1 THEN base || '-' || x.n ELSE base END AS path, CAST(row_number() OVER (PARTITION BY doc_id, k, sub ORDER BY NOT fig, i) AS INTEGER) AS idx,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, sub, NOT fig, i) AS INTEGER) AS seg_pos FROM h JOIN x USING (doc_id, k, sub, base))"""


#: The lines of base.typeset() as an extractor's reader keeps them, their layout, kinds and places.
TYPESET = rf"""{SEG}, ty AS (SELECT doc_id, seg_pos AS n, list_filter(string_split(src_text, ' '), lambda x: length(x) > 0) AS w FROM seg),
    tk AS (SELECT doc_id, n, w, CASE WHEN len(w) <= 3 THEN 'head' WHEN n % 6 = 3 THEN 'caption' WHEN n % 5 = 0 THEN 'lead' ELSE 'text' END AS set_as FROM ty WHERE len(w) > 0),
    tl AS (SELECT doc_id, n, set_as, k, CASE WHEN set_as = 'head' THEN 'Part ' || n % 4 ELSE array_to_string(w[k * {B.LINE_WORDS} + 1 : k * {B.LINE_WORDS} + {B.LINE_WORDS}], ' ') END AS t
           FROM (SELECT *, unnest(range(0, CASE WHEN set_as = 'head' THEN 1 ELSE (len(w) - 1) // {B.LINE_WORDS} + 1 END)) AS k FROM tk)),
    ta AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS ln, k = 0 AND set_as = 'lead' AS leads, CASE WHEN n % 10 = 0 THEN 'Note ' ELSE 'Note ' || n % 3 || ' of ' END AS lead FROM tl),
    tx AS (SELECT doc_id, n, ln, leads, set_as, CAST(ln // {2 * B.COLUMN_LINES} + 1 AS INTEGER) AS page, 60.0 + 10.0 * (ln % {B.COLUMN_LINES}) AS y0,
                  CASE WHEN (ln // {B.COLUMN_LINES}) % 2 = 1 THEN 320.0 ELSE 40.0 END + CASE WHEN k = 0 AND set_as <> 'head' THEN 10.0 ELSE 0.0 END AS x0,
                  CASE WHEN k = 0 AND set_as = 'caption' THEN 'Fig. ' || n || ' | ' || t ELSE t END AS rest, CASE WHEN leads THEN lead ELSE '' END AS lead,
                  CASE WHEN set_as = 'head' THEN 12.0 ELSE 9.0 END AS sz, CASE WHEN set_as = 'caption' THEN 'Sans' ELSE 'Serif' END AS font, set_as = 'head' OR leads AS bold FROM ta),
    li AS (SELECT *, CAST(x0 + 4.0 * (length(rest) + length(lead)) AS DOUBLE) AS x1, lead || rest AS txt FROM tx),
    bs AS (SELECT doc_id, CASE WHEN coalesce(sum(length(txt)) FILTER (WHERE sz = 12), 0) >= 0.15 * sum(length(txt) * CASE WHEN leads THEN 2 ELSE 1 END) THEN 12.0 ELSE 9.0 END AS bs FROM li GROUP BY 1),
    bf AS (SELECT doc_id, min_by(font, struct_pack(a := -c, b := font)) AS body_font FROM (SELECT doc_id, font, sum(length(txt)) AS c FROM li JOIN bs USING (doc_id) WHERE abs(sz - bs) <= 0.7 GROUP BY ALL) GROUP BY 1),
    pr AS (SELECT li.doc_id, x0 FROM li JOIN bs USING (doc_id) JOIN bf USING (doc_id) WHERE length(txt) >= 50 AND abs(sz - bs) <= 0.35 AND font = body_font),
    hi AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, floor(floor(x0) / 5) * 5 AS b, count(*) AS c FROM pr GROUP BY ALL)),
    ce AS (SELECT doc_id, list(centre ORDER BY centre) AS centres FROM (SELECT doc_id, b > 200 AS side, sum(b * c) / sum(c) AS centre FROM hi WHERE c >= greatest(2.0, total * 0.08) GROUP BY ALL) GROUP BY 1),
    lc AS (SELECT bs.doc_id, bs.bs, body_font, centres, CASE WHEN len(centres) = 2 THEN 2 ELSE 1 END AS n_columns, CASE WHEN len(centres) = 2 THEN (centres[1] + centres[2]) / 2 ELSE {B.PAGE_WIDTH} END AS split_x
           FROM bs JOIN bf USING (doc_id) LEFT JOIN ce USING (doc_id)),
    ba AS (SELECT doc_id, c, s[CAST(floor(len(s) * 0.05) AS INTEGER) + 1] AS base FROM (SELECT doc_id, CASE WHEN n_columns < 2 OR x0 < split_x THEN 0 ELSE 1 END AS c, list_sort(list(x0)) AS s FROM pr JOIN lc USING (doc_id) GROUP BY ALL)),
    lay AS (SELECT lc.*, coalesce(b0.base, centres[1], 40.0) AS base0, coalesce(b1.base, centres[2], 40.0) AS base1 FROM lc LEFT JOIN ba b0 ON b0.doc_id = lc.doc_id AND b0.c = 0 LEFT JOIN ba b1 ON b1.doc_id = lc.doc_id AND b1.c = 1),
    cl AS (SELECT li.*, lay.* EXCLUDE (doc_id), CASE WHEN n_columns < 2 OR x0 < split_x THEN 0 ELSE 1 END AS col FROM li JOIN lay USING (doc_id)),
    cx AS (SELECT *, CASE WHEN col = 1 AND n_columns = 2 THEN base1 ELSE base0 END AS base, font = body_font AS same_font,
                  page % 2 = 0 AND (((x0 + x1) / 2 BETWEEN 308 AND 612 AND y0 BETWEEN 48 AND 152) OR ((x0 + x1) / 2 BETWEEN 28 AND 332 AND y0 BETWEEN 198 AND 302)) AS in_rect FROM cl),
    ce2 AS (SELECT *, CASE WHEN in_rect AND NOT same_font THEN 'region' WHEN len(regexp_extract_all(txt, '[A-Za-z]')) <= 2 THEN 'junk'
                   WHEN regexp_matches(txt, '(?i)^(Fig\.|Figure|Table|Box|Extended Data)\s*[0-9]') THEN 'figure' END AS early,
                   CASE WHEN leads AND sz BETWEEN bs - 0.2 AND bs + 1.5 AND length(trim(lead)) >= 8 THEN 'runin' WHEN bold AND sz > bs * 1.25 AND abs(x0 - base) <= 3 THEN 'h1'
                   WHEN bold AND sz > bs AND sz <= bs * 1.25 AND abs(x0 - base) <= 3 AND length(txt) >= 4 THEN 'h2' WHEN abs(sz - bs) <= 0.7 AND NOT bold AND same_font THEN 'body' WHEN sz < bs - 0.7 THEN 'figure' ELSE 'other' END AS late FROM cx),
    rn AS (SELECT *, sum(breaks) OVER (PARTITION BY doc_id, page, col ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) AS run FROM (
           SELECT *, CASE WHEN early IS NULL AND abs(sz - lag(sz) OVER p) <= 0.2 AND font = lag(font) OVER p THEN 0 ELSE 1 END AS breaks FROM ce2 WINDOW p AS (PARTITION BY doc_id, page, col ORDER BY y0, x0))),
    kd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, col, y0, x0) AS pos, CASE WHEN early IS NULL AND coalesce(max(CASE WHEN coalesce(early, late) = 'figure' THEN 1 END)
           OVER (PARTITION BY doc_id, page, col, run ORDER BY y0, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'figure' ELSE coalesce(early, late) END AS kind FROM rn),
    lb AS (SELECT doc_id, pos, leads, lead, lag(b) OVER v AS b1, lag(b, 2) OVER v AS b2, lag(b, 3) OVER v AS b3 FROM (SELECT *, CASE WHEN bold AND kind = 'other' AND NOT regexp_matches(rtrim(txt), '[.!?:]$') THEN trim(txt) END AS b FROM kd)
           WINDOW v AS (PARTITION BY doc_id, page, col ORDER BY y0, x0)),
    rh AS (SELECT doc_id, pos, trim(regexp_replace(replace(regexp_replace(concat_ws(chr(10), CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN b3 END, CASE WHEN b1 IS NOT NULL THEN b2 END, b1, trim(lead)), '([^-])-\n', '\1', 'g'), chr(10), ' '), '\s+', ' ', 'g')) AS runin
           FROM lb WHERE leads)"""


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
#: The definitions and uses of base.abbreviated(), and its glossary.
SAID = f"""aw AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: x NOT IN ({STOP})) AS w FROM documents),
    an AS (SELECT id, {", ".join(f"array_to_string(w[{3 * k + 1}:{3 * k + 3}], ' ') AS n{k}, upper(w[{3 * k + 1}][1] || w[{3 * k + 2}][1] || w[{3 * k + 3}][1]) AS a{k}" for k in range(2))} FROM aw WHERE len(w) >= {B.NAME_WORDS}),
    defs AS (SELECT CAST(id AS VARCHAR) AS doc_id, a0 AS abbr, n0 AS fname FROM an UNION SELECT CAST(id AS VARCHAR), a1, n1 FROM an),
    used AS (SELECT doc_id, abbr, list(fname ORDER BY fname) AS fulls, any_value(CASE WHEN a0 = a1 THEN 5 WHEN abbr = a0 THEN 3 ELSE 2 END) AS n FROM defs JOIN an ON doc_id = CAST(id AS VARCHAR) GROUP BY 1, 2),
    gl AS (SELECT id AS ord, CASE (id // 37) % 3 WHEN 0 THEN a0 WHEN 1 THEN n1 ELSE a1 END AS term, '译' || id AS zh, CASE (id // 37) % 3 WHEN 0 THEN n0 ELSE '' END AS full_en FROM an WHERE id % 37 = 0)"""
#: The entries of base.scoped_terms(), and those of each document.
ENTRIES = """nk AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS term, CASE WHEN n_nationkey % 4 = 3 THEN 'prompt_hint' ELSE 'hard_replace' END AS mode FROM nation),
    dd AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS field FROM documents),
    en AS (SELECT CAST(k AS INTEGER) AS ord, term, '国' || k || '界' AS zh, mode, CASE WHEN k % 2 = 0 THEN '注' ELSE '' END AS note, 'global' AS scope, CASE WHEN k % 10 = 9 THEN 'rejected' ELSE 'approved' END AS status FROM nk
           UNION ALL SELECT CAST(k + 100 AS INTEGER), lower(term), '域' || k || field, mode, '', 'field:' || field, 'approved' FROM nk JOIN (SELECT DISTINCT field FROM dd WHERE field <> '') f ON length(field) % 2 = k % 2 WHERE k % 3 = 0
           UNION ALL SELECT CAST(1000 + 2 * k + again AS INTEGER), ' ' || term, '自' || doc_id || '之' || CASE WHEN doc_id % 4 = 0 THEN 0 ELSE again END, mode, '', 'doc:' || doc_id, 'approved'
           FROM (SELECT DISTINCT doc_id, quality, toxic, unnest(range(0, CAST(quality AS BIGINT) + 1)) AS again FROM labels WHERE quality IS NOT NULL) l JOIN nk ON l.doc_id % 25 = k),
    rk AS (SELECT * FROM (SELECT *, max(rank) OVER (PARTITION BY doc_id, key) AS top FROM (
           SELECT d.doc_id, e.ord, e.zh, e.scope, e.mode, lower(trim(e.term)) AS key, 0 AS rank FROM en e, dd d WHERE e.scope = 'global' AND status <> 'rejected'
           UNION ALL SELECT d.doc_id, e.ord, e.zh, e.scope, e.mode, lower(trim(e.term)), 1 FROM en e JOIN dd d ON e.scope = 'field:' || d.field
           UNION ALL SELECT d.doc_id, e.ord, e.zh, e.scope, e.mode, lower(trim(e.term)), 2 FROM en e JOIN dd d ON e.scope = 'doc:' || d.doc_id)) WHERE rank = top),
    rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS nth FROM rk) WHERE nth = 1)"""
LETTERS = "replace(translate({0}, '0123456789', 'ABCDEFGHIJ'), '_', '')"
VERDICT = """CASE WHEN length(trim({0})) = 0 THEN '❌' WHEN {1} > 25 OR {2} > 1 THEN '⚠️' ELSE '✅' END AS mark,
    CASE WHEN length(trim({0})) = 0 THEN '空' WHEN {1} > 25 OR {2} > 1 THEN concat_ws(' ', CASE WHEN {1} > 32 THEN {1} || '字超标' WHEN {1} > 25 THEN {1} || '字偏长' END, CASE WHEN {2} > 1 THEN {2} || '个逗号' END) ELSE {1} || '字' END AS why"""


PDF_WORDS = r"len(regexp_extract_all(src_text, '[A-Za-z][A-Za-z''\-]*'))"
TURNS = "turns AS (SELECT *, conv_id || '#' || turn AS sid, length(text) * 0.28 AS d FROM conversations WHERE length(text) > 0), line AS (SELECT *, coalesce(sum(d + 0.288) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM turns)"


SNAPSHOT = f"""{ITEMS}, p AS (SELECT *, row_number() OVER (ORDER BY entrez_date DESC, pmid DESC) AS n, regexp_replace(journal, '^Nature reviews\\. ', '') AS short FROM items WHERE status = 'new' QUALIFY n <= 120)"""


SQL = {
    "message_packing": f"""WITH RECURSIVE {SNAPSHOT}, b AS (SELECT n, n || '. ' || brief || ' · ' || short || chr(10) || '    ' || repeat('细', 100) AS b FROM p), t AS (SELECT count(*) AS total FROM p),
        c AS (SELECT channel, greatest(200, chunk - {len(E.TAIL)} - {E.NOTE_RESERVE}) AS budget, most FROM {B.values([(k, c, m) for k, (c, m) in E.POLICY.items()], 'channel, chunk, most')}),
        r AS (SELECT channel, budget, most, CAST(0 AS BIGINT) AS i, 'Nature Reviews 速览 · 2026-09-21（' || total || ' 条）' AS cur, 0 AS cnt, 0 AS msg FROM c, t UNION ALL
              SELECT channel, budget, most, i + 1, CASE WHEN shut THEN b ELSE cur || chr(10) || b END, CASE WHEN shut THEN 1 ELSE cnt + 1 END, CASE WHEN shut THEN msg + 1 ELSE msg END
              FROM (SELECT r.*, b.b, cnt > 0 AND length(cur) + length(b.b) + 1 > budget AS shut FROM r JOIN b ON b.n = r.i + 1)),
        m AS (SELECT channel, any_value(most) AS most, msg, arg_max(cur, i) AS t, arg_max(cnt, i) AS cnt FROM r GROUP BY channel, msg),
        x AS (SELECT *, max(msg) OVER (PARTITION BY channel) + 1 AS size, sum(CASE WHEN msg < most THEN cnt END) OVER (PARTITION BY channel) AS sent FROM m),
        o AS (SELECT channel, msg, t || CASE WHEN msg = size - 1 THEN chr(10) || chr(10) || '{E.TAIL}' ELSE '' END || CASE WHEN size > most AND msg = most - 1
              THEN chr(10) || chr(10) || '⚠️ 还有 ' || (total - sent) || ' 条没发完（共 ' || total || ' 条）。为避免刷屏只发前 ' || most || ' 条消息，完整内容见 data/feed/digest/ 里的 HTML。' ELSE '' END AS t FROM x, t WHERE msg < most)
        SELECT channel, CAST(msg AS INTEGER) AS msg_no, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS md5 FROM o""",
    "html_digest_budget": f"""WITH {SNAPSHOT}, q AS (SELECT n, '<p><b>' || n || '.</b> <b>' || title_en || '</b><br><span>' || brief || '</span><br><span>' || short || ' · ' || CASE WHEN pub_date <> '' THEN pub_date ELSE entrez_date END
            || ' · <a href="https://doi.org/' || doi || '">' || doi || '</a></span></p>' AS piece FROM p), f AS (SELECT *, sum(length(piece)) OVER (ORDER BY n) <= {E.HTML_LIMIT - 600} AS fits FROM q)
        SELECT count(*) FILTER (WHERE fits) AS shown, count(*) AS total, sum(length(piece)) FILTER (WHERE fits) + 400 <= {E.HTML_LIMIT} AS "within" FROM f""",
    "word_sentence_overlap": """WITH t AS (SELECT conv_id || '#' || turn AS id, text, string_split_regex(text, '[ \\n]+') AS w, regexp_extract_all(text, '[ \\n]+') AS g, regexp_extract_all(text, '[^。！？；\\n]+[。！？；\\n]*') AS s FROM conversations WHERE length(text) > 0),
        u AS (SELECT id, unnest(w) AS x, unnest(list_concat(g, [''])) AS gap, generate_subscripts(w, 1) AS i FROM t),
        v AS (SELECT *, coalesce(sum(length(x) + length(gap)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u),
        z AS (SELECT id, a, a + length(x) AS e, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k FROM v WHERE length(x) > 0),
        p AS (SELECT id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS ord FROM t),
        o AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM p),
        j AS (SELECT o.id, o.ord, min(z.k) AS st, max(z.k + 1) AS en FROM o LEFT JOIN z ON z.id = o.id AND ((z.a >= o.c AND z.a < o.c + length(o.x)) OR (z.e > o.c AND z.e <= o.c + length(o.x))) GROUP BY 1, 2),
        l AS (SELECT *, coalesce(last_value(en IGNORE NULLS) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM j)
        SELECT id, CAST(ord AS INTEGER) AS ord, CAST(coalesce(st, prior) AS DOUBLE) AS start, CAST(coalesce(en, prior) AS DOUBLE) AS "end" FROM l""",
    "sentences_zh": """WITH s AS (SELECT conv_id, turn, regexp_extract_all(replace(text, '. ', '。'), '[^。！？；\\n]+[。！？；\\n]*') AS s FROM conversations WHERE length(text) > 0)
        SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS ord, md5(x) AS md5 FROM (SELECT conv_id, turn, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s)""",
    "boxed_lines": f"WITH {TYPESET} SELECT doc_id, page, count(*) FILTER (WHERE in_rect) AS n_in, count(*) AS n FROM cx GROUP BY 1, 2",
    "typeset_titles": f"WITH {TYPESET} SELECT doc_id, coalesce(arg_min(txt, pos) FILTER (WHERE kind IN ('h1', 'h2')), CAST(doc_id AS VARCHAR)) AS title FROM kd GROUP BY 1",
    "typeset_kinds_top": f"""WITH {TYPESET} SELECT kind, count(*) AS n FROM kd WHERE page % 2 = 0 AND kind IN ('h1', 'h2', 'body', 'figure', 'region', 'other')
        AND regexp_matches(txt, '(?i)[A-Z]') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9""",
    "scope_signatures": f"""WITH {ENTRIES} SELECT ord, scope, zh, md5(term || '|' || zh || '|' || mode || '|' || note || '|a,b,' || zh) AS md5 FROM en""",
    "web_abbreviations": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}')[1:3] AS w FROM documents), a AS (SELECT doc_id, array_to_string(w, ' ') AS name,
        upper(CASE doc_id % 3 WHEN 0 THEN w[1][1] || w[2][1] || w[3][1] WHEN 1 THEN w[1][2] || w[3][3] ELSE w[3][1] || 'q9' END) AS a FROM w WHERE len(w) = 3)
        SELECT doc_id, regexp_matches(upper(name), array_to_string(string_split(a, ''), '.*')) AS fits FROM a""",
    "citation_marks": """SELECT conv_id, turn, CAST(len(regexp_extract_all(t, 'cite-sup')) AS INTEGER) AS n, CAST(length(t) AS INTEGER) AS n_chars FROM (
        SELECT conv_id, turn, regexp_replace(text || ' [' || turn || '–' || (turn + 2) || '] [ref. 3] [a b]', '\\[((?:ref\\.\\s*)?[0-9]+(?:[,\\s\\-–—0-9]*)|\\w+)\\]', '<sup class="cite-sup">[\\1]</sup>', 'g') AS t FROM conversations WHERE text IS NOT NULL)""",
    "short_ids": f"""WITH {SECTIONED}, s AS (SELECT doc_id, path, CASE WHEN fig THEN 'fig' ELSE '' END || printf('%02d', idx) AS tail FROM z)
        SELECT doc_id || '#' || path || '#' || tail AS sid, substr(path, 1, 34) || '…/' || tail AS short, doc_id || '_' || replace(path, '/', '_') || '_' || tail AS anchor,
               doc_id || '_' || replace(path, '/', '_') || '_' || tail AS web_anchor, CAST(doc_id AS VARCHAR) AS doc FROM s""",
    "chosen_segments": f"""WITH {SECTIONED}, s AS (SELECT *, doc_id || '#' || path || '#' || CASE WHEN fig THEN 'fig' ELSE '' END || printf('%02d', idx) AS sid FROM z)
        SELECT how, doc_id, count(*) AS n, min(sid) AS first_sid FROM (SELECT 'heading' AS how, * FROM s WHERE heading = 'Deep' OR path = 'part-1' UNION ALL SELECT 'id', * FROM s WHERE contains(sid, '#part-2/sub-1#') OR contains(sid, 'fig0')) GROUP BY 1, 2""",
    "baseline_check": f"""WITH {SEG}, w AS (SELECT doc_id, CAST(sum({PDF_WORDS}) AS BIGINT) AS words FROM seg GROUP BY 1), b AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN CAST(floor(words * 1.05::DOUBLE + 1) AS BIGINT) ELSE words END AS b_words FROM w)
        SELECT doc_id, words, b_words, words BETWEEN b_words * 0.97::DOUBLE AND b_words * 1.03::DOUBLE AS ok FROM b""",
    "library_flags": """SELECT event_id IN (SELECT doc_id FROM documents) AS has_reader, CASE WHEN event_id % 4 = 0 THEN 'shown' WHEN event_id % 9 = 0 THEN 'picked' ELSE 'new' END AS status, count(*) AS n FROM events GROUP BY 1, 2""",
    "reader_table": f"""WITH {TURNS}, f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, CASE WHEN turn % 3 <> 0 THEN '译' || length(text) END AS z, CASE WHEN turn % 4 <> 0 THEN '稿' || length(text) END AS s FROM line)
        SELECT sid, CAST(round(start, 2) AS DOUBLE) AS start_sec, CASE WHEN k = 1 THEN CASE WHEN role = 'user' THEN '正文' ELSE role END END AS toc, replace(sid, '#', '_') AS dom_id, coalesce(z, s, '') AS zh, coalesce(s, z, '') AS script FROM f""",
    "translated_sentence_times": f"""WITH {TURNS}, p AS (SELECT sid, round(start, 3) AS seg, d, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS ord FROM (SELECT *, regexp_extract_all(text, '[^。！？；\\n]+[。！？；\\n]*') AS s FROM line)),
        o AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY sid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, greatest(sum(length(x)) OVER (PARTITION BY sid), 1) AS a FROM p)
        SELECT sid, CAST(ord AS INTEGER) AS ord, round(CASE WHEN ord % 3 = 1 THEN ord * 2.5 ELSE seg + d * b / a END, 2) AS start_sec,
               round(CASE WHEN ord % 3 = 1 THEN CASE WHEN ord % 2 = 0 THEN ord * 2.5 + 2 ELSE ord * 2.5 + 3 END ELSE seg + d * b / a + d * length(x) / a END, 2) AS end_sec FROM o""",
    "smoothed_spans": """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER w AS k, turn * 5.0 + turn % 3 AS st, turn * 5.0 + 4 + length(text) % 4 AS en, lead(turn * 5.0 + turn % 3) OVER w AS nx, max(turn) OVER (PARTITION BY conv_id) * 5.0 + 9 AS total
            FROM conversations WHERE length(text) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), e AS (SELECT conv_id, k, CASE WHEN nx IS NULL THEN total ELSE greatest(en, nx) END AS en FROM s),
        r AS (SELECT conv_id, k, CAST(0 AS DOUBLE) AS start, greatest(0, CAST(en AS DOUBLE)) AS fin FROM e WHERE k = 1 UNION ALL SELECT e.conv_id, e.k, r.fin, greatest(r.fin, CAST(e.en AS DOUBLE)) FROM r JOIN e ON e.conv_id = r.conv_id AND e.k = r.k + 1)
        SELECT conv_id, CAST(k - 1 AS INTEGER) AS k, start, fin AS "end" FROM r""",
    "versioned_segments": f"WITH {SEG} SELECT doc_id, CASE WHEN doc_id % 2 = 1 OR doc_id % 10 = 0 THEN 'second' ELSE 'first' END AS run, count(*) AS n, min(sid) AS first_sid FROM seg GROUP BY 1, 2",
    "staged_run": f"""WITH {SEG}, w AS (SELECT doc_id, {PDF_WORDS} AS n FROM seg) SELECT 'segments' AS stage, (SELECT count(*) FROM documents) AS rows_in, (SELECT count(*) FROM w) AS rows_out, false AS again
        UNION ALL SELECT 'long', (SELECT count(*) FROM w), (SELECT count(*) FROM w WHERE n > 5), false UNION ALL SELECT 'sizes', (SELECT count(*) FROM w WHERE n > 5), (SELECT count(DISTINCT doc_id) FROM w WHERE n > 5), false""",
    "status_replay": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'new' WHEN event_id % 5 < 3 THEN 'shown' WHEN event_id % 5 = 3 THEN 'picked' ELSE 'done' END AS asked FROM events),
        b AS (SELECT *, min(event_id) FILTER (WHERE asked = 'new') OVER (PARTITION BY user_id) AS born FROM e),
        k AS (SELECT *, CASE asked WHEN 'new' THEN 1 WHEN 'shown' THEN 2 WHEN 'picked' THEN 3 ELSE 4 END AS lv FROM b),
        p AS (SELECT *, coalesce(max(CASE WHEN event_id >= born THEN lv END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM k),
        r AS (SELECT asked, CASE WHEN born IS NULL OR event_id < born THEN 'unknown item' WHEN lv < was THEN ['new', 'shown', 'picked', 'done'][was] || ' to ' || asked ELSE '' END AS reason,
              CASE WHEN born IS NULL OR event_id < born THEN '' ELSE ['new', 'shown', 'picked', 'done'][greatest(lv, was)] END AS status FROM p)
        SELECT asked, status, reason = '' AS accepted, reason, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""",
    "library_newest": """SELECT * FROM (SELECT coalesce(source, '') AS source, doc_id, n_chars AS added, CAST(row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars DESC NULLS LAST, doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 5""",
    "text_samples": f"""WITH {SEG}, w AS (SELECT *, {PDF_WORDS} AS n FROM seg), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
        SELECT doc_id, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_words, md5(string_agg(src_text, chr(10) || chr(10) ORDER BY seg_pos)) AS md5 FROM b WHERE before <= 200 GROUP BY 1""",
    "abbr_defs": f"WITH {SAID} SELECT doc_id, abbr, fname AS \"full\" FROM defs",
    "abbr_audit_priority_join": f"""WITH {SAID}, g AS (SELECT lower(trim(term)) AS key, arg_max(zh, ord) AS zh FROM gl GROUP BY 1),
        f AS (SELECT doc_id, abbr, arg_min(g.zh, i) AS zh FROM (SELECT doc_id, abbr, unnest(fulls) AS fname, generate_subscripts(fulls, 1) AS i FROM used) JOIN g ON g.key = lower(fname) GROUP BY 1, 2)
        SELECT doc_id, abbr, n, array_to_string(fulls, ' / ') AS full_names, coalesce(g.zh, f.zh) IS NOT NULL AS in_glossary, coalesce(g.zh, f.zh) AS glossary_zh, len(fulls) > 1 AS ambiguous,
               CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, abbr) AS INTEGER) AS rank FROM used LEFT JOIN g ON g.key = lower(abbr) LEFT JOIN f USING (doc_id, abbr)""",
    "abbr_undefined": f"WITH {SAID} SELECT term, zh FROM gl WHERE regexp_full_match(term, '[A-Z][A-Za-z0-9]{{1,7}}') AND term NOT IN (SELECT abbr FROM defs WHERE CAST(doc_id AS BIGINT) % 2 = 1)",
    "homonym_conflicts": f"""WITH {SAID} SELECT doc_id, abbr, zh, array_to_string(fulls, ' / ') AS fulls, CASE WHEN full_en = '' THEN 'todo' WHEN list_contains(fulls, full_en) THEN 'ok' ELSE 'conflict' END AS verdict
        FROM gl JOIN used ON abbr = term""",
    "disambiguate": f"""WITH {SAID}, l AS (SELECT doc_id, abbr, n, list_sort([struct_pack(k := length(f), f := f) FOR f IN fulls], 'DESC')[1].f AS fname FROM used WHERE n >= 2)
        SELECT doc_id, abbr, fname AS "full", CAST(n AS BIGINT) AS n, CAST(g.ord AS INTEGER) AS ord, CASE WHEN g.zh IS NULL OR g.full_en = '' THEN 'unknown' WHEN g.full_en = fname THEN 'resolved' ELSE 'conflict' END AS verdict,
               (SELECT arg_min(o.zh, o.ord) FROM gl o WHERE o.full_en = fname AND o.full_en <> '' AND o.ord IS DISTINCT FROM g.ord) AS reusable_zh FROM l LEFT JOIN gl g ON g.term = abbr""",
    "pending_terms": f"WITH {SAID} SELECT doc_id, abbr AS term, min(fname) AS full_en, '【待审核: ' || min(fname) || '】' AS zh FROM defs GROUP BY 1, 2",
    "glossary_resolve": f"WITH {ENTRIES} SELECT doc_id, key, zh, scope, CAST(rank AS INTEGER) AS rank FROM rs",
    "glossary_conflicts": f"WITH {ENTRIES} SELECT doc_id, key, CAST(rank AS INTEGER) AS rank, CAST(count(*) AS INTEGER) AS n, string_agg(zh, '/' ORDER BY ord) AS zh FROM rk GROUP BY 1, 2, 3 HAVING count(DISTINCT zh) > 1",
    "glossary_merged_anti_union": f"WITH {ENTRIES} SELECT ord, term, zh, scope FROM en WHERE scope LIKE 'field:%' OR (scope = 'global' AND lower(trim(term)) NOT IN (SELECT lower(trim(term)) FROM en WHERE scope LIKE 'field:%'))",
    "prompt_block": f"""WITH {ENTRIES} SELECT scope, md5(string_agg(CASE WHEN mode = 'prompt_hint' THEN '- ' || term || ' -> 「' || zh || '」' || CASE WHEN note <> '' THEN '（' || note || '）' ELSE '' END
        ELSE '- ' || term || ' -> 「' || zh || '」（统一用此译名）' END, chr(10) ORDER BY ord)) AS md5 FROM en WHERE status <> 'rejected' GROUP BY 1""",
    "term_stats": f"WITH {ENTRIES} SELECT count(*) AS total, count(*) FILTER (WHERE mode = 'hard_replace') AS hard, count(*) FILTER (WHERE mode = 'prompt_hint') AS hint, count(*) FILTER (WHERE scope LIKE 'doc:%') AS doc_terms FROM en",
    "term_search": f"WITH {ENTRIES} SELECT ord, term, scope FROM en WHERE mode = 'hard_replace' AND (contains(lower(term), 'on_2') OR contains(lower(zh), 'on_2'))",
    "hard_replace_by_document": f"""WITH {ENTRIES}, p AS (SELECT d.doc_id, a.term AS u0, b.term AS u1, {LETTERS.format('a.term')} AS t0, {LETTERS.format('b.term')} AS t1 FROM dd d JOIN nk a ON a.k = d.id % 25 JOIN nk b ON b.k = (d.id + 1 + d.id % 7) % 25),
        z AS (SELECT p.*, x.zh AS z0, y.zh AS z1 FROM p LEFT JOIN rs x ON x.doc_id = p.doc_id AND x.key = lower(u0) AND x.mode = 'hard_replace' LEFT JOIN rs y ON y.doc_id = p.doc_id AND y.key = lower(u1) AND y.mode = 'hard_replace')
        SELECT doc_id, '在 ' || coalesce(z0, t0) || ' 与 ' || CASE WHEN z0 IS NOT NULL AND regexp_full_match(t0, '[A-Z][A-Za-z0-9]{{0,7}}') THEN '前部' || z0 ELSE 'a' || t0 END || ' 及 x' || t1 || 'y（' || coalesce(z1, t1) || '）' AS zh FROM z""",
    "html_entities": """SELECT doc_id, md5(text) AS md5, CAST(length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(translate(text, '<>', '')))
        + 5 * (length(text) - length(translate(text, '"éüó', ''))) + 4 * (length(text) - length(replace(text, '$', ''))) AS INTEGER) AS n_escaped FROM documents""",
    "digest_brief_verdict": rf"""WITH r AS (SELECT doc_id, text, coalesce(CAST(length(regexp_replace(regexp_replace(text, '[A-Za-z0-9][A-Za-z0-9\-.]*', 'X', 'g'), '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g')) AS INTEGER), 0) AS n,
        length(text) - length(translate(text, '，,', '')) AS c FROM documents) SELECT doc_id, n, {VERDICT.format("coalesce(text, '')", 'n', 'c')} FROM r""",
    "normalize_numbers": """WITH k AS (SELECT doc_id, n_chars * 1009 + doc_id AS k FROM documents)
        SELECT doc_id, '共 ' || (k // 1000000) || ',' || lpad(CAST(k // 1000 % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ' 例 任务任务 里，第 ' || k || ' 组，分 1，2，3 组' AS text FROM k""",
    "feed_dates": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y') WHEN 3 THEN strftime(ts, '%Y-%m') || '-00'
        WHEN 4 THEN strftime(ts, '%Y-%m') ELSE 'Winter ' || strftime(ts, '%Y') END AS date FROM events""",
    "digest_payload_json": f"""WITH p AS (SELECT event_id, event_id % 5 <> 2 AS good, repeat('句', CAST(event_id % 40 AS INTEGER)) || repeat('，', CAST(event_id % 3 AS INTEGER)) AS b FROM events),
        q AS (SELECT event_id, CASE WHEN good THEN '题' || event_id ELSE '' END AS title_zh, CASE WHEN good THEN b ELSE '' END AS b, CASE WHEN good AND event_id % 2 = 0 THEN '细' ELSE '' END AS detail,
              CASE WHEN good THEN CAST(length(b) AS INTEGER) ELSE 0 END AS n, CASE WHEN good THEN event_id % 3 ELSE 0 END AS c FROM p)
        SELECT event_id, title_zh, n, detail, {VERDICT.format('b', 'n', 'c')} FROM q""",
    "line_layout": f"""WITH {TYPESET} SELECT doc_id, CAST(bs AS DOUBLE) AS body_size, body_font, n_columns, CAST(round(split_x, 4) AS DOUBLE) AS split_x,
        CAST(round(CAST(base0 AS DOUBLE), 2) AS VARCHAR) || CASE WHEN n_columns = 2 THEN ',' || CAST(round(CAST(base1 AS DOUBLE), 2) AS VARCHAR) ELSE '' END AS bases FROM lay""",
    "line_kinds": f"""WITH {TYPESET} SELECT doc_id, page, CAST(y0 AS DOUBLE) AS y0, CAST(x0 AS DOUBLE) AS x0, kind, CAST(pos AS INTEGER) AS pos, CASE WHEN kind = 'runin' THEN runin ELSE '' END AS runin_head FROM kd LEFT JOIN rh USING (doc_id, pos)""",
    "line_segments": rf"""WITH {TYPESET}, ed AS (SELECT doc_id, pos, s[CAST(floor(len(s) * 0.85) AS INTEGER) + 1] AS edge FROM (SELECT doc_id, pos, list_sort([o.x1 FOR o IN near IF o.page = p2 AND o.col = c2]) AS s FROM (
            SELECT doc_id, pos, page AS p2, col AS c2, list(struct_pack(page := page, col := col, x1 := x1)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM kd WHERE kind IN ('body', 'runin')))
            WHERE len(s) >= 5),
        rw AS (SELECT kd.*, edge, CASE WHEN kind = 'runin' THEN trim(rest) ELSE txt END AS body, runin FROM kd LEFT JOIN ed USING (doc_id, pos) LEFT JOIN rh USING (doc_id, pos) WHERE kind IN ('h1', 'h2', 'runin', 'body')),
        op AS (SELECT *, kind <> 'body' OR row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS opens, CASE kind WHEN 'h2' THEN 2 WHEN 'runin' THEN 3 ELSE 1 END AS lv,
               CASE kind WHEN 'body' THEN '(前置)' WHEN 'runin' THEN runin ELSE txt END AS h0 FROM rw),
        oq AS (SELECT *, coalesce(nullif(trim(regexp_replace(rtrim(h0), '[.\-–]\s*[a-h]$', '')), ''), h0) AS hd FROM op),
        la AS (SELECT hd, [CASE WHEN regexp_matches(x, '[a-z0-9]') THEN x WHEN unicode(x) < 128 THEN '-' WHEN unicode(x) < 65536 THEN 'u' || lpad(printf('%x', unicode(x)), 4, '0') ELSE 'u' || printf('%x', unicode(x)) END
               FOR x IN string_split(regexp_replace(lower(trim(hd)), '[‘’“”]', '', 'g')[1:41], '') IF length(x) > 0] AS a FROM (SELECT DISTINCT hd FROM oq WHERE opens)),
        lk AS (SELECT hd, a, len([i FOR i IN range(1, len(a) + 1) IF length(array_to_string(a[1:i], '')) <= 40]) AS k FROM la),
        lf AS (SELECT hd, len(a) > k AS cut, regexp_replace(regexp_replace(array_to_string(a[1:k], ''), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM lk),
        sl AS (SELECT hd, coalesce(nullif(CASE WHEN cut AND contains(s, '-') THEN regexp_replace(s, '-+[^-]*$', '') ELSE s END, ''), 'sec') AS slug FROM lf),
        sc AS (SELECT oq.*, slug, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec_no FROM oq LEFT JOIN sl ON oq.opens AND sl.hd = oq.hd),
        hs AS (SELECT doc_id, sec_no, lv, hd, slug, last_value(CASE WHEN lv = 1 THEN slug END IGNORE NULLS) OVER w AS s1, CASE WHEN lv > 1 THEN last_value(CASE WHEN lv <= 2 THEN CASE WHEN lv = 2 THEN slug ELSE '' END END IGNORE NULLS) OVER w END AS s2
               FROM sc WHERE opens WINDOW w AS (PARTITION BY doc_id ORDER BY sec_no ROWS UNBOUNDED PRECEDING)),
        pa AS (SELECT *, concat_ws('/', s1, nullif(s2, ''), CASE WHEN lv = 3 THEN slug END) AS base_path FROM hs),
        fl AS (SELECT doc_id, sec_no, pos, page, col, body, x0 - base >= 8 AS indented, CASE WHEN lag(pos) OVER w IS NULL THEN true ELSE (NOT coalesce(lag(edge) OVER w - lag(x1) OVER w <= 12, false) OR x0 - base >= 8)
               AND NOT (regexp_matches(body, '^[a-z]') AND NOT regexp_matches(regexp_replace(lag(body) OVER w, '["”’)]+$', ''), '[.?!:]$')) END AS starts FROM sc WHERE kind NOT IN ('h1', 'h2') WINDOW w AS (PARTITION BY doc_id, sec_no ORDER BY pos)),
        pg AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id, sec_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS para FROM fl),
        sg AS (SELECT doc_id, sec_no, para, trim(regexp_replace(replace(regexp_replace(string_agg(trim(body), chr(10) ORDER BY pos), '([^-])-
', '', 'g'), chr(10), ' '), '\s+', ' ', 'g')) AS t, min_by(indented, pos) AS indented, min_by(col, pos) AS col, min_by(page, pos) + 1 AS page
               FROM pg GROUP BY 1, 2, 3),
        ok AS (SELECT sg.*, lv, hd, base_path FROM sg JOIN pa USING (doc_id, sec_no) WHERE len(regexp_extract_all(t, '\S+')) >= 3),
        un AS (SELECT *, CASE WHEN k > 1 THEN base_path || '-' || k ELSE base_path END AS path FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, base_path ORDER BY sec_no) AS k FROM ok))
        SELECT doc_id, doc_id || '#' || path || '#' || printf('%02d', row_number() OVER (PARTITION BY doc_id, path ORDER BY sec_no, para)) AS sid, hd AS sec_heading, lv AS sec_level, page, md5(t) AS md5,
               CAST(len(regexp_extract_all(t, '[A-Za-z][A-Za-z''\-]*')) AS INTEGER) AS n_words, indented, col FROM un""",
    "html_sections": f"""WITH {SECTIONED} SELECT doc_id, doc_id || '#' || path || '#' || CASE WHEN fig THEN 'fig' ELSE '' END || printf('%02d', idx) AS sid, heading AS sec_heading, sub + 1 AS sec_level, idx AS index, seg_pos,
        md5(src_text) AS md5, CAST(n_words AS INTEGER) AS n_words, fig AS is_figure, CASE WHEN fig THEN 'Fig. ' || i ELSE '' END AS fig_label FROM z""",
    "html_sections_web": f"""WITH {FLAT}, r AS (SELECT page_id AS doc_id, seg_pos - 1 AS i, src_text AS t, (seg_pos - 1) // 5 AS k, (seg_pos - 1) % 5 AS m,
            lead(src_text) OVER w AS t1, lead(src_text, 2) OVER w AS t2 FROM flat WINDOW w AS (PARTITION BY page_id ORDER BY seg_pos)),
        q AS (SELECT doc_id, i, k, m, CASE WHEN m = 2 AND k = 0 THEN 'Criteria 2:' WHEN m = 2 THEN 'Criteria ' || i || ': 1. ' || t || coalesce('; 2. ' || t1, '') || coalesce('; x). ' || t2, '') ELSE t END AS t FROM r
              WHERE m <= 2 OR (m = 3 AND k = 0)),
        z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM q WHERE length(t) >= 15 OR suffix(t, '.'))
        SELECT doc_id, doc_id || ':s' || printf('%03d', k) || CASE WHEN k = 0 THEN '-abstract' ELSE '-part-' || k END || ':p' || printf('%02d', p) AS sid, CASE WHEN k = 0 THEN 'Abstract' ELSE 'Part ' || k END AS sec_heading,
               CASE WHEN k % 2 = 1 THEN 2 ELSE 1 END AS sec_level, CAST(pos AS INTEGER) AS index, md5(t) AS md5, CAST(len(regexp_extract_all(t, '[A-Za-z0-9\\-'']+')) AS INTEGER) AS n_words,
               k > 0 AND m = 1 AS is_figure, k > 0 AND m = 2 AS in_box, CASE WHEN k > 0 AND m = 1 THEN 'Fig ' || k ELSE '' END AS fig_label FROM z""",
    "health_of_sections": f"""WITH {SECTIONED}, g AS (SELECT doc_id, count(*) AS segments, count(*) FILTER (WHERE regexp_matches(src_text, '^\\p{{Ll}}')) AS lower_starts,
            count(*) FILTER (WHERE NOT regexp_matches(regexp_replace(src_text, '["’”)]+$', ''), '[.?!:]$')) AS open_ends, CAST(max(n_words) AS INTEGER) AS max_words,
            count(DISTINCT heading) FILTER (WHERE sub = 0) AS heads FROM z GROUP BY 1)
        SELECT doc_id, segments, lower_starts, open_ends, max_words, round(1 - (lower_starts + open_ends) / (2.0 * segments), 4) AS cleanliness,
               concat_ws(',', CASE WHEN segments < 20 THEN 'few_segments' END, CASE WHEN max_words > 600 THEN 'long_segment' END, CASE WHEN heads < 3 THEN 'few_headings' END) AS warnings FROM g""",
    "html_flat_segments": f"WITH {FLAT} SELECT page_id, CAST(seg_pos AS INTEGER) AS seg_pos, src_text, CAST(n_words AS INTEGER) AS n_words, sha1(src_text) AS src_hash FROM flat",
    "html_title": """SELECT page_id, CASE WHEN length(trim(t)) > 0 THEN trim(replace(replace(t, '&quot;', '"'), '&amp;', '&')) ELSE CAST(page_id AS VARCHAR) END AS title
        FROM (SELECT page_id, string_split(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '|')[1] AS t FROM pages)""",
    "html_segment_stats": f"WITH {FLAT} SELECT page_id, count(*) AS segments, CAST(sum(n_words) AS BIGINT) AS words, CAST({MEDIAN.format('n_words')} AS INTEGER) AS median_words, CAST(max(n_words) AS INTEGER) AS max_words FROM flat GROUP BY 1",
    "html_web_segments": f"WITH {FLAT} SELECT page_id, count(*) AS n, CAST(sum(len(regexp_extract_all(src_text, '[A-Za-z0-9\\-'']+'))) AS BIGINT) AS words FROM flat WHERE NOT (length(src_text) < 15 AND NOT suffix(src_text, '.')) GROUP BY 1",
    "doc_segments": f"WITH {SEG} SELECT doc_id, sid, CAST(seg_pos AS INTEGER) AS seg_pos, CAST(length(src_text) AS INTEGER) AS n_chars, CAST(len(regexp_extract_all(src_text, '[A-Za-z][A-Za-z''\\-]*')) AS INTEGER) AS n_words FROM seg",
    "doc_stats_upper_median": f"""WITH {SEG}, w AS (SELECT doc_id, CAST(len(regexp_extract_all(src_text, '[A-Za-z][A-Za-z''\\-]*')) AS INTEGER) AS n FROM seg)
        SELECT doc_id, CAST(1 AS BIGINT) AS sections, count(*) AS segments, CAST(sum(n) AS BIGINT) AS words, CAST({MEDIAN.format('n')} AS INTEGER) AS median_words, max(n) AS max_words FROM w GROUP BY 1""",
    "segment_fingerprint": f"WITH {SEG} SELECT sha1(src_text) AS src_hash, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(sid) AS first_sid FROM seg GROUP BY 1 HAVING count(*) > 1",
    "cache_key": f"""WITH {SEG} SELECT sid, sha256('A' || chr(31) || 'mock:m1' || chr(31) || 'v1' || chr(31) || sha1(src_text) || chr(31) || '' || chr(31)) AS key,
        sha256('B' || chr(31) || 'mock:m1' || chr(31) || 'v1' || chr(31) || 'spoken' || chr(31) || sha1(src_text) || chr(31)) AS script_key FROM seg""",
    "doc_slug": r"""WITH h AS (SELECT doc_id, substr(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[‘’“”]', '', 'g'), 1, 41) AS t FROM documents WHERE text IS NOT NULL),
        a AS (SELECT doc_id, [CASE WHEN regexp_matches(x, '[a-z0-9]') THEN x WHEN unicode(x) < 128 THEN '-' WHEN unicode(x) < 65536 THEN 'u' || lpad(printf('%x', unicode(x)), 4, '0')
              ELSE 'u' || printf('%x', unicode(x)) END FOR x IN string_split(t, '') IF length(x) > 0] AS a FROM h),
        k AS (SELECT doc_id, a, len([i FOR i IN range(1, len(a) + 1) IF length(array_to_string(a[1:i], '')) <= 40]) AS k FROM a),
        f AS (SELECT doc_id, len(a) > k AS cut, regexp_replace(regexp_replace(array_to_string(a[1:k], ''), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM k),
        b AS (SELECT doc_id, CASE WHEN cut AND contains(s, '-') THEN regexp_replace(s, '-+[^-]*$', '') ELSE s END AS s FROM f)
        SELECT doc_id, CASE WHEN length(s) > 0 THEN s ELSE 'sec' END AS slug FROM b""",
    "dup_sid_suffix": f"""WITH {SEG}, n AS (SELECT doc_id, seg_pos, {sid3()} AS s, row_number() OVER (PARTITION BY {sid3()} ORDER BY seg_pos) AS n FROM seg)
        SELECT doc_id, CAST(seg_pos AS INTEGER) AS seg_pos, CASE WHEN n > 1 THEN s || '-dup' || n ELSE s END AS sid FROM n""",
    "section_fill_forward": f"""WITH {SEG}, l AS (SELECT *, CASE WHEN length(src_text) < 20 THEN 1 WHEN length(src_text) < 60 THEN 2 WHEN length(src_text) < 120 THEN 3 END AS lv FROM seg),
        p AS (SELECT *, {', '.join(f'max(CASE WHEN lv = {n} THEN seg_pos END) OVER w AS p{n}' for n in (1, 2, 3))} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seg_pos))
        SELECT p.sid, md5(a.src_text) AS h1, md5(b.src_text) AS h2, md5(c.src_text) AS h3 FROM p
        LEFT JOIN seg a ON a.doc_id = p.doc_id AND a.seg_pos = p.p1
        LEFT JOIN seg b ON b.doc_id = p.doc_id AND b.seg_pos = p.p2 AND p.p2 > coalesce(p.p1, 0)
        LEFT JOIN seg c ON c.doc_id = p.doc_id AND c.seg_pos = p.p3 AND p.p3 > coalesce(p.p1, 0) AND p.p3 > coalesce(p.p2, 0)""",
    "first_in_section": """SELECT conv_id AS doc_id, count(*) FILTER (WHERE role IS DISTINCT FROM was) AS n_change, count(*) FILTER (WHERE k = 1) AS n_first FROM (
        SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) GROUP BY 1""",
    "prose_listagg": f"WITH {SEG}, t AS (SELECT doc_id, string_agg(src_text, chr(10) || chr(10) ORDER BY seg_pos) AS t FROM seg GROUP BY 1) SELECT doc_id, md5(t) AS md5, CAST(length(t) AS INTEGER) AS n FROM t",
    "word_count_variants": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*')) AS INTEGER) AS n_pdf,
        CAST(len(regexp_extract_all(text, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS INTEGER) AS n_html,
        CAST(len(regexp_extract_all(text, '[A-Za-z0-9\-'']+')) AS INTEGER) AS n_web FROM documents""",
    "example_reading_len": f"SELECT id, CAST(length(regexp_replace(regexp_replace(text, '[A-Za-z0-9][A-Za-z0-9\\-.]*', 'X', 'g'), '\\s+', '', 'g')) AS INTEGER) AS n FROM {BRIEFS}",
    "example_normalize_numbers": f"""SELECT id, regexp_replace(translate(text, '０１２３４５６７８９', '0123456789'), '([0-9])[，､．]([0-9]{{3}})([^0-9]|$)', '\\1,\\2\\3', 'g') AS text FROM (SELECT id, CASE WHEN id = 4 THEN '另一项任务 里' ELSE text END AS text FROM {BRIEFS})""",
    "example_sentence_split_zh": f"""SELECT id, CAST(ord - 1 AS INTEGER) AS ord, sentence FROM (SELECT id, unnest(s) AS sentence, generate_subscripts(s, 1) AS ord FROM (
        SELECT id, regexp_extract_all(text, '[^。！？；\\n]+[。！？；\\n]*') AS s FROM {B.values(B.ZH_TEXTS, 'id, text, total')}))""",
    "term_hits_theta": f"WITH {SEG}, {HITS} SELECT sid, term, zh, mode FROM hits",
    "term_hits_web": f"WITH {SEG} SELECT term, count(*) AS n FROM seg JOIN {TERMS} t ON contains(lower(src_text), lower(term)) WHERE status <> 'rejected' GROUP BY 1",
    "term_landing": f"""WITH {SEG}, {HITS}, z AS (SELECT *, contains(replace(replace(src_text, ' the ', ' 此 '), ' de la ', ' 之 '), zh) AS there FROM hits WHERE mode = 'hard_replace')
        SELECT term, zh AS term_zh, count(*) AS n_hit, count(*) FILTER (WHERE NOT there) AS n_missing, (min(struct_pack(p := seg_pos, s := sid)) FILTER (WHERE NOT there)).s AS first_missing FROM z GROUP BY 1, 2""",
    "term_density": f"""WITH {SEG}, z AS (SELECT replace(replace(src_text, ' the ', ' 此 '), ' de la ', ' 之 ') AS z FROM seg)
        SELECT term, zh AS term_zh, CAST(sum((length(z) - length(replace(z, zh, ''))) // length(zh)) AS BIGINT) AS n, '' AS flag FROM z JOIN {TERMS} t ON contains(z, zh) GROUP BY 1, 2""",
    "example_glossary_resolve": f"WITH {RANKED} SELECT doc_id, term, zh, scope, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS k FROM ranked) WHERE k = 1",
    "example_glossary_conflicts": f"WITH {RANKED} SELECT doc_id, key, rank, CAST(count(*) AS INTEGER) AS n, string_agg(zh, '/' ORDER BY ord) AS zh FROM ranked GROUP BY 1, 2, 3 HAVING count(DISTINCT zh) > 1",
    "example_glossary_merged_anti_union": f"""SELECT ord, term, zh FROM {SCOPED} WHERE scope LIKE 'doc:%' OR (scope = 'global' AND lower(trim(term)) NOT IN (SELECT lower(trim(term)) FROM {SCOPED} WHERE scope LIKE 'doc:%'))""",
    "glossary_upsert": """SELECT r_name AS term, 'r' AS zh FROM region UNION ALL SELECT lower(n_name), 'n' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0
        UNION ALL SELECT n_name, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 3 <> 0 AND lower(n_name) NOT IN (SELECT lower(r_name) FROM region)""",
    "example_abbr_defs": f"""SELECT DISTINCT doc_id, abbr, fname AS "full" FROM {DEFS}""",
    "abbr_usage_min_count": """SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, abbr, CAST(len(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(^|[^A-Za-z0-9])' || abbr || '([^A-Za-z0-9]|$)')) AS BIGINT) AS n
        FROM documents, (VALUES ('THE'), ('OF'), ('Is'), ('La')) AS a(abbr)) WHERE n >= 2""",
    "example_abbr_audit_priority_join": f"""WITH {USED}, g AS (SELECT lower(trim(term)) AS key, arg_max(zh, ord) AS zh FROM {ABBR_GLOSS} GROUP BY 1),
        z AS (SELECT u.*, coalesce((SELECT zh FROM g WHERE key = lower(u.abbr)), (SELECT arg_min(g.zh, f) FROM g, (SELECT unnest(u.fulls) AS f) WHERE g.key = lower(f))) AS zh FROM used u WHERE n >= 2)
        SELECT doc_id, abbr, n, array_to_string(fulls, ' / ') AS full_names, zh IS NOT NULL AS in_glossary, zh AS glossary_zh, len(fulls) > 1 AS ambiguous FROM z""",
    "example_abbr_undefined": f"SELECT term, zh FROM {ABBR_GLOSS} WHERE regexp_full_match(trim(term), '[A-Z][A-Za-z0-9]{{1,7}}') AND trim(term) NOT IN (SELECT abbr FROM {DEFS})",
    "example_homonym_conflicts": f"""WITH {USED} SELECT doc_id, abbr, zh, array_to_string(fulls, ' / ') AS fulls, CASE WHEN trim(full_en) = '' THEN 'todo' WHEN list_contains([lower(f) FOR f IN fulls], lower(full_en)) THEN 'ok' ELSE 'conflict' END AS verdict
        FROM used JOIN {ABBR_GLOSS} g ON trim(g.term) = used.abbr""",
    "example_disambiguate": f"""WITH {USED}, l AS (SELECT doc_id, abbr, n, list_sort([struct_pack(k := length(f), f := f) FOR f IN fulls], 'DESC')[1].f AS fname FROM used WHERE n >= 2),
        o AS (SELECT ord, zh, lower(replace(full_en, '-', ' ')) AS norm FROM {ABBR_GLOSS} WHERE length(full_en) > 0),
        j AS (SELECT l.*, g.ord, g.zh, g.full_en FROM l LEFT JOIN {ABBR_GLOSS} g ON trim(g.term) = l.abbr)
        SELECT doc_id, abbr, fname AS "full", n, CASE WHEN zh IS NULL OR full_en = '' THEN 'unknown' WHEN lower(replace(fname, '-', ' ')) = lower(replace(full_en, '-', ' ')) THEN 'resolved' ELSE 'conflict' END AS verdict,
               (SELECT arg_min(o.zh, o.ord) FROM o WHERE o.norm = lower(replace(fname, '-', ' ')) AND o.ord IS DISTINCT FROM j.ord) AS reusable_zh FROM j""",
    "qa_completeness_topk": f"""WITH {PAIRS}, r AS (SELECT doc_id, sid, length(zh) / greatest({LATIN.format('src')}, 1) AS ratio FROM pairs), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ratio, sid) AS rank FROM r)
        SELECT doc_id, sid, round(ratio, 4) AS ratio, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""",
    "qa_ratio_summary": f"WITH {PAIRS}, r AS (SELECT doc_id, CAST(length(zh) AS DOUBLE) AS r FROM pairs) SELECT doc_id, min(r) AS lowest, {MEDIAN.format('r')} AS middle, max(r) AS highest, count(r) AS n FROM r GROUP BY 1",
    "qa_residue": f"""WITH {PAIRS}, r AS (SELECT doc_id, sid, CAST({LATIN.format('zh')} AS INTEGER) AS latin, CAST(len(regexp_extract_all(zh, '[一-鿿]')) AS INTEGER) AS cjk FROM pairs),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY latin / greatest(cjk, 1) DESC, latin DESC, cjk DESC, sid DESC) AS rank FROM r) SELECT doc_id, sid, latin, cjk, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""",
    "qa_number_fidelity": f"""WITH {SEG}, p AS (SELECT * FROM (SELECT sid, src_text AS src, lead(src_text) OVER (PARTITION BY doc_id ORDER BY seg_pos) AS zh FROM seg) WHERE length(zh) > 0),
        d AS (SELECT sid, regexp_replace(src, '([^A-Za-z0-9])', '\\1\\1', 'g') AS s, regexp_replace(zh, '([^A-Za-z0-9])', '\\1\\1', 'g') AS z FROM p),
        x AS (SELECT sid, list_distinct([regexp_replace(v, '([.,])[.,]', '\\1') FOR v IN regexp_extract_all(s, '(?:^|[^A-Za-z0-9.])([0-9]+(?:[.,]{{2}}[0-9]+)?)(?:[^A-Za-z0-9]|$)', 1)]) AS s,
                     list_distinct([regexp_replace(v, '([.,])[.,]', '\\1') FOR v IN regexp_extract_all(z, '(?:^|[^A-Za-z0-9.])([0-9]+(?:[.,]{{2}}[0-9]+)?)(?:[^A-Za-z0-9]|$)', 1)]) AS z FROM d),
        n AS (SELECT sid, s, [regexp_replace(v, '[.,]', '', 'g') FOR v IN z] AS n FROM x),
        m AS (SELECT sid, list_sort([v FOR v IN s IF length(v) >= 2 AND NOT list_contains(n, regexp_replace(v, '[.,]', '', 'g'))]) AS m FROM n)
        SELECT sid, CAST(len(m) AS INTEGER) AS n_missing, array_to_string(m[1:6], ',') AS missing FROM m WHERE len(m) > 0""",
    "qa_leaks": f"WITH {SEG} SELECT doc_id, count(*) AS n FROM seg WHERE length(src_text) % 7 = 0 OR regexp_matches(src_text, '^(译文|翻译|输出|Answer|Translation)\\s*[:：]') OR contains(src_text, '【') GROUP BY 1",
    "qa_health_flags": f"""WITH {SEG}, f AS (SELECT doc_id, regexp_matches(src_text, '^\\p{{Ll}}') AS low, NOT regexp_matches(regexp_replace(src_text, '["’”)]+$', ''), '[.?!:]$') AS opn, CAST(len(regexp_extract_all(src_text, '[A-Za-z][A-Za-z''\\-]*')) AS INTEGER) AS w FROM seg),
        g AS (SELECT doc_id, count(*) AS segments, count(*) FILTER (WHERE low) AS lower_starts, count(*) FILTER (WHERE opn) AS open_ends, max(w) AS max_words FROM f GROUP BY 1)
        SELECT *, round(1 - (lower_starts + open_ends) / (2 * segments), 4) AS cleanliness, concat_ws(',', CASE WHEN segments < 20 THEN 'few_segments' END, CASE WHEN max_words > 600 THEN 'long_segment' END) AS warnings FROM g""",
    "qa_visual_density": f"""WITH {PAIRS}, r AS (SELECT doc_id, length(zh) / 46.0::DOUBLE + length(src) / 88.0::DOUBLE AS r FROM pairs)
        SELECT doc_id, round({MEDIAN.format('r')}, 6) AS middle, round(min(r), 6) AS lowest, round(max(r), 6) AS highest, count(*) FILTER (WHERE r > 30) AS n_long FROM r GROUP BY 1""",
    "qa_invariants": f"""WITH {SEG}, w AS (SELECT sid, src_text, len(regexp_extract_all(src_text, '[A-Za-z][A-Za-z''\\-]*')) AS n FROM seg)
        SELECT rule, n FROM (SELECT 'size' AS rule, count(*) AS n FROM w WHERE n < 3 OR n > 420 UNION ALL SELECT 'table', count(*) FROM w WHERE regexp_matches(src_text, '<t[dr]\\b|\\t.*\\t')
        UNION ALL SELECT 'duplicate_sid', count(*) FROM (SELECT sid FROM seg GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""",
    "timeline_prefix_sum": f"WITH {CONV}, {LINE} SELECT conv_id, turn, round(round(start, 3), 2) AS start_sec, round(round(start + dur, 3), 2) AS end_sec FROM line",
    "web_timeline": f"""WITH {CONV} SELECT conv_id, turn, round(round(coalesce(sum(CASE WHEN turn % 3 <> 0 THEN dur ELSE 0.0::DOUBLE END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3), 2) AS start_sec FROM conv""",
    "turn_sentences": f"""WITH {CONV} SELECT conv_id || '#' || turn AS id, CAST(len([s FOR s IN regexp_extract_all(text, '[^。！？；\\n]+[。！？；\\n]*') IF length(trim(s, chr(10) || ' ')) > 0]) AS BIGINT) AS n, round(dur, 2) AS last_end FROM conv""",
    "playback_interval_join": f"""WITH {CONV}, {LINE}, s AS (SELECT conv_id, turn, round(start, 3) AS a, round(start + dur, 3) AS b FROM line),
        t AS (SELECT conv_id, CAST(unnest(range(0, CAST(floor(max(b)) AS BIGINT) + 1, 30)) AS DOUBLE) AS t FROM s GROUP BY 1)
        SELECT t.conv_id, t.t, min(s.turn) AS ord FROM t JOIN s ON s.conv_id = t.conv_id AND t.t BETWEEN s.a AND s.b GROUP BY 1, 2""",
    "positional_alignment": """WITH d AS (SELECT doc_id, len(string_split(text, '.')) AS en, len(string_split(text, chr(10))) AS zh FROM documents), e AS (SELECT doc_id, en, zh, unnest(range(0, en)) AS e FROM d),
        z AS (SELECT doc_id, CASE WHEN en = zh THEN e ELSE least((e * zh) // en, zh - 1) END AS z FROM e) SELECT doc_id, CAST(sum(z) AS BIGINT) AS sum_z, CAST(max(z) AS INTEGER) AS max_z FROM z GROUP BY 1""",
    "feed_filter_kept_dropped": f"WITH {ITEMS} SELECT CASE WHEN length(trim(abstract)) > 0 THEN 'kept' ELSE 'dropped' END AS side, term_field, count(*) AS n FROM items GROUP BY 1, 2",
    "feed_upsert_merge": f"""WITH {ITEMS} SELECT pmid, title_en || CASE WHEN id % 3 = 0 THEN '''' ELSE '' END AS title_en, CASE WHEN id % 2 = 0 THEN status ELSE 'new' END AS status,
        CASE WHEN id % 2 = 0 THEN day ELSE '2026-09-21' END AS first_seen, brief FROM items WHERE id % 2 = 0 OR id % 3 = 0""",
    "feed_inserted": f"WITH {ITEMS} SELECT pmid, 'new' AS status, '2026-09-21' AS first_seen FROM items WHERE id % 3 = 0 AND id % 2 <> 0",
    "feed_write_back": f"""WITH {ITEMS} SELECT CASE WHEN id % 5 = 0 THEN '题' ELSE '' END AS title_zh, CASE WHEN id % 5 = 0 THEN '细' ELSE '' END AS detail, count(*) AS n, min(CASE WHEN id % 5 = 0 THEN 'B' || pmid ELSE brief END) AS least FROM items GROUP BY 1, 2""",
    "feed_set_status": f"""WITH {ITEMS}, x AS (SELECT status, status = 'new' AND term_field = 'click' AS hit FROM items) SELECT CASE WHEN hit THEN 'shown' ELSE status END AS status, CASE WHEN hit THEN '2026-09-21' ELSE '' END AS shown_in, count(*) AS n FROM x GROUP BY 1, 2""",
    "feed_pending_topk": f"WITH {ITEMS} SELECT pmid, entrez_date FROM items WHERE status = 'new' ORDER BY entrez_date DESC, pmid DESC LIMIT 50",
    "feed_status_rollup": f"WITH {ITEMS} SELECT coalesce(status, 'total') AS status, count(*) AS n FROM items GROUP BY ROLLUP (status)",
    "feed_gap": f"WITH {ITEMS} SELECT max(day) AS last_run, CAST(date_diff('day', CAST(max(day) AS DATE), DATE '2026-09-21') AS INTEGER) AS gap_days FROM items",
    "feed_recent_keep_unparseable": f"""WITH {ITEMS}, d AS (SELECT term_field, CASE WHEN length(entrez_date) > 0 THEN entrez_date ELSE pub_date END AS d FROM items)
        SELECT term_field, count(*) AS n FROM d WHERE coalesce(TRY_CAST(d AS DATE) >= DATE '2025-01-15' - INTERVAL 400 DAY, true) GROUP BY 1""",
    "feed_urls": f"""WITH {ITEMS} SELECT pmid, length(trim(abstract)) > 0 AS has_abstract, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS url_pubmed, 'https://doi.org/' || doi AS url_doi, 'python tools/run_pipeline.py ' || doc_id || ' --field ' || term_field AS run_command FROM items""",
    "feed_search": f"WITH {ITEMS} SELECT status, count(*) AS n FROM items WHERE contains(lower(title_en), 'click') OR contains(lower(brief), 'click') OR contains(lower(journal), 'click') OR contains(lower(abstract), 'click') GROUP BY 1",
    "journal_fields": f"""WITH {ITEMS} SELECT DISTINCT journal, trim(regexp_replace(lower(journal[17:]), '[^a-z0-9]+', '-', 'g'), '-') AS field, journal[17:] AS short, journal AS doc_id FROM items""",
    "digest_snapshot_numbers": f"""WITH {ITEMS}, p AS (SELECT *, row_number() OVER (ORDER BY entrez_date DESC, pmid DESC) AS n FROM items WHERE status = 'new') SELECT CAST(n AS INTEGER) AS n, pmid, 'https://doi.org/' || doi AS url_doi FROM p WHERE n <= 40""",
    "event_props_json": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "dirty_segments_anti": f"""WITH {SEG}, {HITS}, k AS (SELECT seg.sid, sha256('A' || chr(31) || 'mock:m1' || chr(31) || 'v1' || chr(31) || sha1(any_value(seg.src_text)) || chr(31) ||
            coalesce(string_agg(s, ' ;; ' ORDER BY s), '') || chr(31)) AS key, count(*) FILTER (WHERE h.term = 'and the') AS hit, any_value(seg.src_text) AS t,
            coalesce(string_agg(o, ' ;; ' ORDER BY o), '') AS old
        FROM seg LEFT JOIN (SELECT sid, term, term || '|' || zh || '|' || mode || '|' || CASE WHEN term = 'and the' THEN '改' ELSE note END || '|' || aliases AS s, term || '|' || zh || '|' || mode || '|' || note || '|' || aliases AS o FROM hits WHERE mode = 'prompt_hint') h USING (sid) GROUP BY 1)
        SELECT sid, key FROM k WHERE hit > 0""",
    "cache_hit_counts": f"""WITH {SEG}, {HITS}, k AS (SELECT seg.sid, any_value(seg.doc_id) AS doc_id, sha1(any_value(seg.src_text)) || coalesce(string_agg(h.term, ',' ORDER BY h.term), '') AS key FROM seg LEFT JOIN (SELECT sid, term FROM hits WHERE mode = 'prompt_hint') h USING (sid) GROUP BY 1)
        SELECT count(*) FILTER (WHERE key IN (SELECT key FROM k WHERE doc_id % 2 = 0)) AS hits, count(*) FILTER (WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 2 = 0)) AS misses FROM k""",
    "mock_translate": f"WITH {SEG} SELECT sid, md5('[MOCK:m1] ' || substr('【待翻译】' || chr(10) || src_text, 1, 400)[7:]) AS md5 FROM seg",
    "rolling_right_edge": """WITH g AS (SELECT l_suppkey AS doc_id, l_orderkey, max(l_quantity) AS x1 FROM lineitem GROUP BY 1, 2), p AS (SELECT doc_id, x1, row_number() OVER (PARTITION BY doc_id ORDER BY l_orderkey) AS pos FROM g),
        r AS (SELECT a.doc_id, a.pos, list_sort(list(b.x1)) AS near FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND a.pos // 20 = b.pos // 20 GROUP BY 1, 2)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN len(near) >= 5 THEN near[CAST(floor(len(near) * 0.85) AS INTEGER) + 1] END AS edge FROM r""",
    "gap_clusters": f"WITH {clusters('SELECT c_nationkey AS doc_id, c_acctbal AS v FROM customer', '40.0')} SELECT doc_id, CAST(cluster AS INTEGER) AS cluster, CAST(floor(sum(v) / count(*)) AS BIGINT) AS centre, count(*) AS n FROM c GROUP BY 1, 2",
    "event_sessions": f"""WITH {clusters("SELECT user_id AS doc_id, CAST(floor(epoch(ts)) AS BIGINT) AS v FROM events", '3600')} SELECT doc_id, CAST(cluster AS INTEGER) AS cluster, count(*) AS n FROM c GROUP BY 1, 2""",
    "column_histogram": """WITH h AS (SELECT s_nationkey AS doc_id, CAST(floor(floor(abs(s_acctbal / 100)) / 5) * 5 AS INTEGER) AS bucket, count(*) AS n FROM supplier GROUP BY 1, 2)
        SELECT doc_id, bucket, n FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM h) WHERE n >= greatest(2, total * 0.08)""",
    "example_rect_containment_semi": f"""SELECT doc_id, page, text, EXISTS (SELECT 1 FROM {B.values(B.RECTS, 'd, p, a, b, c, e')} WHERE d = doc_id AND p = page AND (x0 + x1) / 2 BETWEEN a - 2 AND c + 2 AND y0 BETWEEN b - 2 AND e + 2) AS in_rect
        FROM {B.values(B.BOX_LINES, 'doc_id, page, y0, x0, x1, text')}""",
    "grep_context_window": f"""WITH {SEG}, h AS (SELECT *, CAST(regexp_matches(src_text, '(?i)erend') AS INTEGER) AS hit FROM seg)
        SELECT sid, hit FROM (SELECT sid, hit, max(hit) OVER (PARTITION BY doc_id ORDER BY seg_pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h) WHERE near = 1""",
    "word_budget": f"""WITH {SEG}, w AS (SELECT doc_id, seg_pos, len(regexp_extract_all(src_text, '[A-Za-z][A-Za-z''\\-]*')) AS n FROM seg), b AS (SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
        SELECT doc_id, count(*) AS n, CAST(max(before) AS BIGINT) AS before FROM b WHERE before <= 200 GROUP BY 1""",
    "example_term_stats": f"SELECT count(*) AS total, count(*) FILTER (WHERE mode = 'hard_replace') AS hard, count(*) FILTER (WHERE mode = 'prompt_hint') AS hint, CAST(0 AS BIGINT) AS doc_terms FROM {TERMS}",
    "example_term_search": f"SELECT term, mode FROM {TERMS} WHERE contains(lower(term), 'the') OR contains(lower(zh), 'the') OR contains(lower(note), 'the') OR contains(lower(aliases), 'the')",
    "example_prompt_block": f"""SELECT string_agg(CASE WHEN mode = 'prompt_hint' THEN '- ' || term || ' -> 「' || zh || '」' || CASE WHEN note <> '' THEN '（' || note || '）' ELSE '' END ELSE '- ' || term || ' -> 「' || zh || '」（统一用此译名）' END, chr(10) ORDER BY ord) AS block FROM {TERMS} WHERE status <> 'rejected'""",
    "example_signatures": f"SELECT term, term || '|' || zh || '|' || mode || '|' || note || '|' || aliases AS signature FROM {TERMS}",
    "time_formats": f"""WITH {CONV}, {LINE}, s AS (SELECT conv_id, turn, CAST(floor(round(start, 3)) AS BIGINT) AS s FROM line)
        SELECT conv_id, turn, printf('[%02d:%05.2f]', s // 60, CAST(s % 60 AS DOUBLE)) AS lrc, printf('%02d:%02d:%06.3f', s // 3600, (s % 3600) // 60, CAST(s % 60 AS DOUBLE)) AS vtt, printf('%02d:%02d', s // 60, s % 60) AS clock FROM s""",
    "stage_resume": f"WITH {SEG} SELECT doc_id, count(*) AS n FROM seg WHERE (seg_pos + doc_id) % 3 = 0 OR (seg_pos + doc_id) % 7 = 0 GROUP BY 1",
    "example_proportional_sentences": f"""WITH s AS (SELECT id, total, [x FOR x IN regexp_extract_all(text, '[^。！？；\\n]+[。！？；\\n]*') IF length(trim(x)) > 0] AS l FROM {B.values(B.ZH_TEXTS, 'id, text, total')}),
        u AS (SELECT id, CAST(total AS DOUBLE) AS t, unnest(l) AS sentence, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord, len(l) AS k FROM s),
        d AS (SELECT *, greatest(0.05, t * length(sentence) / sum(length(sentence)) OVER (PARTITION BY id)) AS d FROM u),
        b AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b FROM d),
        e AS (SELECT *, CASE WHEN ord = k - 1 THEN greatest(0.05, t - b) ELSE d END AS dd FROM b)
        SELECT id, ord, sentence, round(b, 3) AS start, round(b + dd, 3) AS "end", round(dd, 3) AS duration FROM e""",
    # Expected rows by hand.
    "example_html_sections": f"SELECT * FROM {B.values(B.NESTED_ROWS, 'doc_id, sid, sec_heading, sec_level, src_text, is_figure')}",
    "example_html_sections_web": f"SELECT * FROM {B.values(B.WEB_ROWS, 'doc_id, sid, index')}",
    "example_html_entities": f"SELECT id, text FROM {B.values([(i, t) for i, _, t in B.ENTITIES], 'id, text')}",
    "example_line_layout": "SELECT 'p' AS doc_id, 9.0::DOUBLE AS body_size, 'Serif' AS body_font, 2 AS n_columns, 180.0::DOUBLE AS split_x, '40,320' AS bases",
    "example_line_kinds": f"SELECT page, CAST(y0 AS DOUBLE) AS y0, CAST(x0 AS DOUBLE) AS x0, kind FROM {B.values(B.LINE_KINDS, 'page, y0, x0, kind')}",
    "example_line_segments": f"SELECT * FROM {B.values(B.LINE_SEGMENTS, 'sid, sec_heading, sec_level, page, src_text')}",
    "example_line_title": "SELECT 'p' AS doc_id, 'A Title of the Paper' AS title",
    "example_chat_models": "SELECT unnest(['chatgpt-4o-latest', 'gpt-4o', 'o1-mini', 'o3']) AS name",
    "example_hard_replace_by_document": f"SELECT doc_id, id, zh FROM {B.values([(d, i, z) for d, i, _, z in B.TRANSLATED], 'doc_id, id, zh')}",
    "example_mined_terms": "SELECT * FROM (VALUES ('d1', 'MSN', '内侧隔核', 'prompt_hint', 'n', '隔核', 'doc:d1', 'suggested'), ('d2', 'SIF', '抑制性遗忘', 'hard_replace', NULL, '', 'doc:d2', 'suggested')) AS t(doc_id, term, zh, mode, note, aliases, scope, status)",
    "example_slug_ascii": f"SELECT * FROM {B.values(B.SLUGS, 'id, slug')}",
    "example_sentence_split_en": f"SELECT * FROM {B.values(B.SPLIT, 'id, ord, sentence')}",
    "example_feed_dates": f"SELECT * FROM {B.values(B.DATES, 'id, date')}",
    "example_digest_payload_json": f"SELECT * FROM {B.values(B.PAYLOADS, 'id, title_zh, brief, detail')}",
    "example_digest_brief_verdict": f"SELECT * FROM {B.values(B.VERDICTS, 'id, mark, why')}",
    # The same by queries.
    "example_pending_terms": f"SELECT doc_id, abbr AS term, min(fname) AS full_en, '【待审核: ' || min(fname) || '】' AS zh FROM {DEFS} GROUP BY 1, 2",
    "abbr_unused": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, abbr FROM documents, (VALUES ('The'), ('Und'), ('Que')) AS a(abbr)
        WHERE NOT coalesce(regexp_matches(text, '(^|[^A-Za-z])' || abbr || '([^A-Za-z]|$)'), false)""",
    "answers_paid_once": f"""WITH {SEG}, k AS (SELECT src_text, bool_or(doc_id % 2 = 0) AS a, bool_or(doc_id % 3 = 0) AS b FROM seg GROUP BY 1),
        v AS (SELECT doc_id, CASE WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END AS paid_by, a OR b AS cached, src_text FROM seg JOIN k USING (src_text))
        SELECT doc_id, paid_by, cached, count(*) AS n, md5(min(paid_by || length(src_text) || ':' || substr(src_text, 1, 20))) AS md5 FROM v GROUP BY 1, 2, 3""",
    "browser_feed": r"""WITH d AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS id, source, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, regexp_extract(text, '([A-Za-z]+)', 1) AS w FROM documents),
        t AS (SELECT *, trim(CASE k % 3 WHEN 0 THEN 'Pathophysiology of ' || w WHEN 1 THEN w || ' atlas' END) AS title, CASE WHEN k % 5 = 0 THEN 'Nat Rev' WHEN trim(source) <> '' THEN trim(source) ELSE 'Nature Reviews' END AS journal FROM d),
        z AS (SELECT *, trim(replace(title, 'Pathophysiology of', '的病理生理学')) AS zh FROM t WHERE title <> '' AND length(text) >= 50)
        SELECT CASE WHEN k % 2 = 0 THEN '10.1038/s' || id ELSE '' END AS doi, CASE WHEN k % 2 = 0 THEN 's' || id ELSE 'pmid-' || id END AS doc_id, title AS title_en, CASE WHEN zh <> title THEN zh ELSE '' END AS title_zh, journal,
            CASE WHEN k % 7 = 0 THEN '近期' WHEN k % 4 = 0 THEN '2024-Mar' ELSE '2024' END AS pub_date, CASE WHEN zh <> title THEN '前沿探讨：' || zh ELSE '前沿综述：' || journal || ' 深入探讨机制与治疗演进。' END AS brief, CAST(length(text) AS INTEGER) AS n_abstract FROM z""",
    "run_state": f"""WITH {SEG}, m AS (SELECT DISTINCT doc_id FROM seg WHERE doc_id % 3 = 0 AND sid LIKE '%1'),
        k AS (SELECT doc_id, sum(CASE WHEN doc_id IN (FROM m) THEN 0 ELSE 1 END) AS n_one, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS n_two, sum(CASE WHEN doc_id % 3 = 0 AND sid LIKE '%1' THEN 1 ELSE 0 END) AS n_three FROM seg GROUP BY 1),
        f AS (SELECT doc_id, min(nullif(trim(source), '')) AS s, min(CASE WHEN doc_id % 4 = 0 THEN nullif(trim(lang), '') END) AS l FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
        SELECT doc_id, CAST(n_one AS BIGINT) AS n_one, CAST(n_two AS BIGINT) AS n_two, CAST(n_three AS BIGINT) AS n_three, coalesce(l, s) AS field, CASE WHEN f.doc_id IS NOT NULL THEN coalesce(l <> s, false) END AS differs FROM k FULL JOIN f USING (doc_id)""",
    "glossary_files": r"""WITH d AS (SELECT coalesce(source, 'none') AS source, doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS term FROM documents), t AS (SELECT source, term, min(doc_id) AS ord FROM d WHERE term <> '' GROUP BY 1, 2),
        l AS (SELECT 'field:' || source AS scope, ord, term, '- {"term":"' || term || '","zh":"译' || term || '","mode":"prompt_hint"' || CASE WHEN ord % 2 = 0 THEN ',"note":"of ' || ord || '"' ELSE '' END || CASE WHEN ord % 3 = 0 THEN ',"aliases":["' || lower(term) || '"]' ELSE '' END
            || ',"scope":"field:' || source || '","status":"approved"}' AS line FROM t)
        SELECT scope, CAST(count(*) AS INTEGER) AS n, md5('terms:' || chr(10) || string_agg(line, chr(10) ORDER BY ord, term) || chr(10)) AS md5 FROM l GROUP BY 1""",
    "library_documents": """WITH g AS (SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(count(*) AS INTEGER) AS n_terms FROM nation WHERE n_nationkey < 9 GROUP BY 1)
        SELECT doc_id, doc_id AS title, n_terms FROM g UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, 0 FROM region WHERE CAST(r_regionkey AS VARCHAR) NOT IN (SELECT doc_id FROM g)""",
    "qa_char_totals": f"WITH {PAIRS} SELECT doc_id, CAST(sum(length(src)) AS BIGINT) AS src_chars, CAST(sum(length(zh)) AS BIGINT) AS zh_chars FROM pairs GROUP BY 1",
    "audio_totals": f"WITH {CONV} SELECT conv_id AS doc_id, round(round(sum(dur), 3), 2) AS total_sec, count(*) FILTER (WHERE turn % 5 = 0) AS n_failed FROM conv GROUP BY 1",
    "feed_dropped_report": f"""WITH {ITEMS}, d AS (SELECT * FROM items WHERE length(trim(abstract)) = 0)
        SELECT pub_date AS date, journal, title_en, greatest((SELECT count(*) FROM d) - 15, 0) AS n_more FROM (SELECT * FROM d ORDER BY entrez_date DESC, pmid DESC LIMIT 15)""",
    "stage_stats": f"""WITH {SEG}, k AS (SELECT doc_id, seg_pos + doc_id AS k FROM seg)
        SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS stage, count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 <> 0) AS n_valid, count(*) AS n FROM k GROUP BY 1, 2""",
    "script_positions": f"""WITH {CONV} SELECT conv_id AS doc_id, turn AS seg_pos, CAST(row_number() OVER w AS INTEGER) AS seg_idx, count(*) OVER (PARTITION BY conv_id) AS total_segs,
        CASE WHEN row_number() OVER w = 1 THEN 'first' ELSE 'rest' END AS stage FROM conv WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "page_widths": "SELECT l_suppkey AS doc_id, CAST(max(l_quantity) AS DOUBLE) AS page_width FROM lineitem GROUP BY 1",
    "doc_sentences": r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(e|i)\.(g|e)\.', '\1__DOT__\2__DOT__', 'g'),
            '(?i)\b(Fig|Figure|Ref|et al|vs|dr|mr|mrs|prof)\.', '\1__DOT__', 'g'), '([0-9]+)\.([0-9]+)', '\1__DOT__\2', 'g') AS t FROM documents WHERE length(text) > 0),
        s AS (SELECT m.doc_id, [trim(replace(x, '__DOT__', '.'), ' ' || chr(9) || chr(10) || chr(13)) FOR x IN regexp_extract_all(t, '[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$')] AS a, text FROM m JOIN documents d ON d.doc_id = m.doc_id),
        f AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [text] ELSE [x FOR x IN a IF length(x) > 0] END AS a FROM s)
        SELECT doc_id, CAST(len(a) AS INTEGER) AS n, CAST(list_max([length(x) FOR x IN a]) AS INTEGER) AS longest FROM f""",
    # Runs of letters stand alone: no look-around is needed.
    "hard_replace": f"""WITH {SEG}, d AS (SELECT sid, src_text, regexp_replace(regexp_replace(src_text, '(^|[^A-Za-z])de la([^A-Za-z]|$)', '\\1之\\2', 'g'), '(^|[^A-Za-z])de la([^A-Za-z]|$)', '\\1之\\2', 'g') AS t FROM seg),
        r AS (SELECT sid, src_text, array_to_string([CASE WHEN x = 'the' THEN '此' WHEN x = 'IN' THEN '内' WHEN regexp_full_match(x, '[a-z]IN') THEN coalesce(map {{'a': '前部', 'p': '后部', 'r': '右侧', 'l': '左侧', 'd': '背侧', 'v': '腹侧', 'm': '内侧', 'c': '尾侧', 's': '上'}}[x[1]], '') || '内' ELSE x END
            FOR x IN regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]+')], '') AS o FROM d)
        SELECT sid, md5(replace(o, '彼', '此')) AS md5, CAST(length(o) AS INTEGER) AS n FROM r WHERE o <> src_text""",
    "spoken_length": f"""WITH {CONV}, s AS (SELECT conv_id, turn, array_to_string([CASE WHEN regexp_full_match(x, '[A-Z]{{2,6}}') THEN array_to_string(string_split(x, ''), '-') ELSE x END
            FOR x IN regexp_extract_all(text, '[A-Za-z0-9\\-]+|[^A-Za-z0-9\\-]+')], '') AS t FROM conv),
        p AS (SELECT conv_id, turn, regexp_replace(replace(replace(t, 'the', 'thee'), 'and', 'annd'), '[ \\t]+', ' ', 'g') AS t FROM s)
        SELECT conv_id, turn, md5(regexp_replace(replace(replace(t, '——', '，'), '……', '。'), '^\\s+|\\s+$', '', 'g')) AS md5 FROM p""",
    "example_title_heuristics": "SELECT * FROM (VALUES (1, 'Cancer 的生物学机制 ageing'), (2, '的生物学机制 细胞衰老 在癌症中的作用'), (3, '肠易激综合征：疾病机制与临床管理'), (4, 'Gut flora：从基础生物学到临床实践')) AS t(id, title)",
    "example_default_terms": "SELECT CAST(18 AS BIGINT) AS total, CAST(14 AS BIGINT) AS hard, CAST(4 AS BIGINT) AS hint, CAST(0 AS BIGINT) AS doc_terms",
    "example_landing_examples": f"SELECT * FROM {B.values(B.LANDING_EXAMPLES, 'term, term_zh, n_missing, examples')}",
    "example_health_of_sections": "SELECT * FROM (VALUES ('d', 'few_segments,few_headings'), ('n', 'few_segments,few_headings')) AS t(doc_id, warnings)",
}

#: Of the examples, whose rows the tests know.
EXAMPLES = {k.removeprefix("example_"): SQL.pop(k) for k in [*SQL] if k.startswith("example_")}
