"""The operators' queries over their whole tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decon, encoding, jaccard, langid, linededup, lmscore, mixing, pii, quality, shard, tokens, topk, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard.assign(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("all").alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture of sources."""
    return mixing.place(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines, as counts and a digest of the text that is left."""
    got = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by links of 3-word shingle similarity 0.9 or more."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-entropy difference of every document."""
    return lmscore.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that contaminates it."""
    return decon.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


#: Tokens of a model's window.
WINDOW = 2048


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    got = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > WINDOW).alias("over_limit"))


def op13_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of returned lines by item, vendor and client before each line, from other folds."""
    got = encoding.encoded(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))
    return got.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", *[f"{x}_{c}" for x in ("item", "vendor", "client") for c in ("n", "rate")])


#: A limit at which small tables split, for the query beside op1_sharding.
SMALL_LIMIT = 1 << 17


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document where a shard holds an eighth of a megabyte."""
    return shard.assign(table(spark, sf_dir, "documents"), SMALL_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"sharding_small_limit": sharding_small_limit}


def sharding_sql(limit: int) -> str:
    """A document's shard is its shortest prefix that fits the limit, or that one key fills alone."""
    return f"""
        WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k, coalesce(strlen(text), 0) AS b FROM documents),
        t AS (SELECT depth, k >> (60 - depth) AS prefix, sum(b) AS bytes, count(*) AS n, min(k) = max(k) AS one FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 61)) GROUP BY 1, 2),
        c AS (SELECT d.doc_id, t.*, row_number() OVER (PARTITION BY d.doc_id ORDER BY t.depth) AS r
              FROM d JOIN t ON t.prefix = d.k >> (60 - t.depth) WHERE t.bytes <= {limit} OR t.one)
        SELECT doc_id, 'r' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
               CAST(bytes AS BIGINT) AS shard_bytes, n AS shard_rows, bytes > {limit} AS oversized FROM c WHERE r = 1"""


def encoding_sql() -> str:
    """Counts by window frames that end before a line's time, of all folds less its own; crc32 bit by bit."""
    keys = {"all": "0", "kind": "kind", "nation": "nation_id", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}

    def count(x: str, what: str) -> str:
        frame = "ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
        return "coalesce(sum({0}) OVER (PARTITION BY {1} {2}), 0) - coalesce(sum({0}) OVER (PARTITION BY {1}, fold {2}), 0)".format(what, keys[x], frame)

    counts = ", ".join(f"{count(x, what)} AS {x}_{c}" for x in keys for c, what in (("n", "1"), ("s", "r")))
    rates = ["all_rate AS (SELECT *, CASE WHEN all_n < 1 THEN 500000 ELSE (1000000 * all_s + 50 * 500000) // (all_n + 50) END AS all_rate FROM h)"]
    last = "all_rate"
    for x, p in encoding.LEVELS.items():
        if p:
            rates.append(f"{x}_rate AS (SELECT *, CASE WHEN {x}_n < 1 THEN {p}_rate ELSE (1000000 * {x}_s + 50 * {p}_rate) // ({x}_n + 50) END AS {x}_rate FROM {last})")
            last = f"{x}_rate"
    shown = ", ".join(f"CAST(any_value({x}_{c}) AS BIGINT) AS {x}_{c}" for x in ("item", "vendor", "client") for c in ("n", "rate"))
    return f"""
        WITH ids AS (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL),
        f AS (SELECT sale_id, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                     lambda a, c: list_reduce(list_prepend(xor(a, c), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 5 AS INTEGER) AS fold FROM ids),
        l AS (SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, s.sold_at, f.fold, CASE WHEN l.flag = 'returned' THEN 1 ELSE 0 END AS r
              FROM sale_lines l JOIN sales s ON s.sale_id = l.sale_id JOIN f ON f.sale_id = s.sale_id WHERE s.sold_at IS NOT NULL),
        a AS (SELECT l.*, i.kind, v.nation_id, c.segment FROM l LEFT JOIN items i ON i.item_id = l.item_id LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN clients c ON c.client_id = l.client_id),
        h AS (SELECT *, {counts} FROM a), {", ".join(rates)}
        SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, CAST(sum(r) AS BIGINT) AS n_returned, {shown} FROM {last} GROUP BY 1, 2, 3"""


SQL: dict[str, str] = {
    "op13_target_encoding": encoding_sql(),
    "op1_sharding": sharding_sql(shard.BYTE_LIMIT),
    "sharding_small_limit": sharding_sql(SMALL_LIMIT),
    "op3_mixing": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
        p AS (SELECT k, CAST(CASE k {" ".join(f"WHEN 's{k}' THEN {v}" for k, v in mixing.TARGET_PARTS.items())} ELSE {mixing.DEFAULT_PARTS} END AS BIGINT) AS parts FROM (SELECT DISTINCT k FROM d)),
        w AS (SELECT k, parts, CAST(sum(parts) OVER () AS BIGINT) AS total FROM p),
        s AS (SELECT CAST(0 AS BIGINT) AS slot, k, parts, total, CAST(0 AS BIGINT) AS done, row_number() OVER (ORDER BY (total + parts - 1) // parts, k) = 1 AS pick FROM w
              UNION ALL
              SELECT slot + 1, k, parts, total, done2, row_number() OVER (ORDER BY CASE WHEN done2 * total // parts <= slot + 1 THEN 0 ELSE 1 END, ((done2 + 1) * total + parts - 1) // parts, k) = 1
              FROM (SELECT *, done + CASE WHEN pick THEN 1 ELSE 0 END AS done2 FROM s) WHERE slot + 1 < total),
        o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1 AS ordinal FROM d),
        b AS (SELECT *, ordinal // {mixing.BLOCK_ROWS} AS block FROM o)
        SELECT b.doc_id, b.source, b.block, (b.block // s.parts) * s.total + s.slot AS slot, b.ordinal FROM b JOIN s ON s.k = b.k AND s.pick AND s.done = b.block % s.parts""",
    "op4_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
        w AS (SELECT *, len(w) AS n FROM (SELECT *, [CASE WHEN regexp_matches(x, '[0-9]') THEN '' ELSE x END FOR x IN
              regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')] AS w FROM l) WHERE len(w) > 0),
        t AS (SELECT doc_id, no, n, unnest(w) AS tok, generate_subscripts(w, 1) AS p FROM w WHERE n < {linededup.LONG_TOKENS}),
        lead AS (SELECT n, p, tok FROM t WHERE p <= {linededup.LEADING} AND tok <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}),
        f AS (SELECT t.*, lead.tok IS NOT NULL AS fixed FROM t LEFT JOIN lead USING (n, p, tok)),
        g AS (SELECT *, string_agg(CASE WHEN fixed THEN tok ELSE '' END, ' ' ORDER BY p) FILTER (WHERE p <= {linededup.LEADING}) OVER (PARTITION BY doc_id, no) AS leaf FROM f),
        whole AS (SELECT n, leaf, count(DISTINCT doc_id) AS docs FROM g GROUP BY ALL),
        rest AS (SELECT n, leaf, p, tok, count(DISTINCT doc_id) AS c FROM g WHERE p > {linededup.LEADING} AND tok <> '' GROUP BY ALL),
        m AS (SELECT g.*, whole.docs, coalesce(rest.c, 0) AS c FROM g JOIN whole USING (n, leaf) LEFT JOIN rest USING (n, leaf, p, tok)),
        r AS (SELECT doc_id, no, n, tok, p, v, fixed OR (c >= {linededup.MIN_DOCS} AND (v = 0 OR 2 * c >= docs)) AS keep FROM m, (VALUES (0), (1)) x(v)),
        k AS (SELECT doc_id, no, {linededup.MIN_DOCS} AS least, n || '|' || string_agg(CASE WHEN keep THEN tok ELSE '' END, ' ' ORDER BY p) AS key FROM r GROUP BY doc_id, no, n, v
              HAVING count_if(keep OR tok = '') = n OR (count_if(keep) >= {linededup.AGREE_TOKENS} AND count_if(keep) >= {linededup.AGREE} * n)
              UNION ALL
              SELECT doc_id, no, {linededup.LONG_DOCS}, n || '|' || v || '|' || array_to_string(list_transform(w, lambda x, i: CASE WHEN v > 0 AND i > {linededup.LEADING}
                     AND (i - 1 - {linededup.LEADING}) * {linededup.BLOCKS} // (n - {linededup.LEADING}) = v - 1 THEN '' ELSE x END), ' ')
              FROM w, range(0, {linededup.BLOCKS + 1}) y(v) WHERE n >= {linededup.LONG_TOKENS}),
        o AS (SELECT key FROM k GROUP BY key, least HAVING count(DISTINCT doc_id) >= least),
        d AS (SELECT DISTINCT doc_id, no FROM k WHERE key IN (SELECT key FROM o)),
        c AS (SELECT l.doc_id, count(*) AS n_lines, count(d.no) AS n_dropped, coalesce(string_agg(CAST(d.no AS VARCHAR), ',' ORDER BY l.no) FILTER (WHERE d.no IS NOT NULL), '') AS dropped,
                     coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE d.no IS NULL), '') AS kept FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.no = l.no GROUP BY 1)
        SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped, length(kept) AS kept_chars, md5(kept) AS kept_md5
        FROM documents x LEFT JOIN c USING (doc_id)""",
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
              AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
              GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
        l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY 1, 2""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
        p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
