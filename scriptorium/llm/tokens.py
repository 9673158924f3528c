"""Token counts by a public tokenizer, with huge documents encoded in overlapping chunks.

A text of more than `chunk` characters is cut into pieces that overlap by `overlap` characters on both sides of
each cut, and pieces are encoded in tasks of their own, wherever they lie. For every two tokens in a row within an
overlap a piece gives its cut: where the one ends, where the other starts, their ids and whether they belong to
one word. A cut that both neighbours give is where they are spliced: the counts left of it come from the one
piece and those right of it from the other. Documents with neighbours that have no cut in common are encoded again with
wider overlaps and longer pieces, at last whole.

Such a cut is a boundary of the whole text's encoding:
* Words are found from left to right by a pattern that looks at nothing before its start, so two readings that
  start a word at one place agree from there on; the left piece's words up to there end before its edge.
* Within one word, a row of tokens is what the merges give if and only if each two in a row are what the merges
  give for them alone. All pairs of the spliced row stand in one of the two encodings.
* Cuts closer than `MARGIN` to a piece's edge, where a contraction or a special string may be cut in two, and
  cuts before characters that normalisation may join to what stands before them, are left out.
Tokenizers for which this does not hold (no byte-pair merges, dropout, patterns that look around) are refused.

A text's count is that of the library without added special tokens, truncation or padding; special strings in a
text are special tokens, as is its default. Null and empty texts have no tokens. Rows are kept as they are, in
any number, with their columns: ids may be null or repeat; the two columns that are added take the place of
columns of their names. An empty table gives an empty result. What a task holds follows its longest text, not
its partition.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import importable, stage

#: Texts of more characters are huge; pieces are as long. Characters of overlap on each side of a cut.
CHUNK, OVERLAP = 1 << 15, 256
#: Each further round takes wider overlaps and longer pieces, by these factors.
WIDER, LONGER = 8, 2
#: No cut is trusted so close to a piece's edge: longer than any special string or contraction.
MARGIN = 48
#: Characters that are encoded in one call, but for a longer word.
CALL = 1 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    parts = [spec.get("pre_tokenizer") or {}]
    parts += parts[0].get("pretokenizers", [])
    patterns = [p["pattern"].get("Regex", "") for p in parts if "pattern" in p]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or not patterns or any("(?" in p or "\\b" in p for p in patterns):
        raise ValueError(f"{path}: chunks of this tokenizer have no provable boundaries")
    if any(len(t["content"]) >= MARGIN or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", [])):
        raise ValueError(f"{path}: added tokens reach beyond their own characters")
    got = Tokenizer.from_file(path)
    got.no_truncation()
    got.no_padding()
    return got


#: Counts of so many words are kept at a time, and as many from before that have not been met again.
WORDS = 1 << 19
_counts: dict[str, list[dict[str, int]]] = {}


def lengths(texts: list[str], path: str) -> list[int]:
    """The token counts of whole texts. No token, pattern or normalisation reaches over a space: a text has the tokens of its words,
    and a word is encoded once while its count is kept. Tabs and line ends are spaces to the tokenizer."""
    tok, out = tokenizer(path), []
    kept, older = _counts.get(path, ({}, {}))
    for t in texts:
        words = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            out.append(sum(map(kept.__getitem__, words)))
            continue
        except KeyError:
            pass
        run, size = [], 0
        for w in set(words):
            if w in kept:
                continue
            if w in older:
                kept[w] = older[w]
                continue
            run.append(w)
            size += len(w)
            if size > CALL:
                kept.update(_encoded(tok, run))
                run, size = [], 0
        kept.update(_encoded(tok, run))
        out.append(sum(map(kept.__getitem__, words)))
        if len(kept) > WORDS:  # frequent words come back from the older half, rare ones go
            kept, older = {}, kept
    _counts[path] = [kept, older]
    return out


def _encoded(tok, words: list[str]) -> dict[str, int]:
    got = tok.encode_batch_fast(words, add_special_tokens=False) if words else []
    return {w: len(e.ids) for w, e in zip(words, got, strict=True)}


def joins_nothing(c: str) -> bool:
    """Whether normalisation never joins a character to what stands before it: neither a mark nor a vowel or final letter of a syllable block."""
    import unicodedata

    n = ord(c)
    return n < 0x300 or not (unicodedata.category(c)[0] == "M" or 0x1160 <= n <= 0x11FF or 0x16D40 <= n <= 0x16D7F)


def cuts(piece: str, start: int, spans: list[tuple[int, int]], path: str) -> tuple[int, list[dict[str, int]]]:
    """The number of a piece's tokens and, for each span of text positions, its cuts there and how many tokens precede each."""
    e = tokenizer(path).encode(piece, add_special_tokens=False)
    ids, offs, words = e.ids, e.offsets, e.word_ids
    found: list[dict[str, int]] = [{} for _ in spans]
    for (low, high), out in zip(spans, found, strict=True):
        first = max(1, bisect.bisect_left(offs, (low - start, 0)))
        for k in range(first, len(ids)):
            a, b = offs[k - 1][1], offs[k][0]
            if b + start > high:
                break
            if a > b or b == offs[k - 1][0]:
                continue  # two tokens of one character
            if low <= a + start and joins_nothing(piece[b]):
                same = words[k - 1] is not None and words[k - 1] == words[k]
                out[f"{a + start}:{b + start}:{ids[k - 1]}:{ids[k]}:{int(same)}"] = k
    return len(ids), found


def pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(digest, seq, n_pieces, start, piece) of each text: overlapping pieces of a huge one."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for digest, t in zip(f["digest"], f["text"], strict=True):
                n = max(1, -(-len(t) // chunk))
                for lot in range(0, n, 64):
                    rows = []
                    for k in range(lot, min(n, lot + 64)):
                        low, high = max(0, k * chunk - overlap), min(len(t), (k + 1) * chunk + overlap)
                        rows.append((digest, k, n, low, t[low:high]))
                    yield pd.DataFrame(rows, columns=["digest", "seq", "n_pieces", "start", "piece"])

    return docs.mapInPandas(of, "digest string, seq int, n_pieces int, start long, piece string")


def spliced(huge: DataFrame, path: str, chunk: int, overlap: int, name: str) -> DataFrame:
    """(digest, n_tokens) of texts(digest, text); n_tokens is null where neighbours have no cut in common."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()
        for f in frames:
            rows = []
            for r in f.itertuples():
                if (r.digest, r.seq) in seen:  # a copy of a text
                    continue
                seen.add((r.digest, r.seq))
                at = [r.seq * chunk, (r.seq + 1) * chunk]
                n, (head, tail) = cuts(r.piece, r.start, [(c - overlap + MARGIN, c + overlap - MARGIN) for c in at], path)
                rows.append((r.digest, r.seq, r.n_pieces, n, head if r.seq else {}, tail if r.seq + 1 < r.n_pieces else {}))
            yield pd.DataFrame(rows, columns=["digest", "seq", "n_pieces", "n", "head", "tail"])

    dealt = pieces(huge, chunk, overlap).repartition("digest", "seq")
    got = stage(dealt.mapInPandas(of, "digest string, seq int, n_pieces int, n long, head map<string,long>, tail map<string,long>"), name)
    right = got.select("digest", (F.col("seq") - 1).alias("seq"), F.col("head").alias("next"))
    pair = got.join(right.hint("merge"), ["digest", "seq"], "left")
    common = F.array_intersect(F.map_keys("tail"), F.map_keys(F.coalesce("next", F.create_map().cast("map<string,long>"))))
    cut = F.element_at(common, F.greatest(F.lit(1), (F.size(common) / 2).cast("int")))
    pair = pair.withColumn("cut", F.when(F.size(common) > 0, cut))
    more = F.when(F.col("seq") + 1 == F.col("n_pieces"), F.col("n")).otherwise(F.element_at("tail", F.col("cut")) - F.element_at("next", F.col("cut")))
    whole = pair.groupBy("digest").agg(F.sum(more).alias("n_tokens"), F.count(more).alias("known"), F.first("n_pieces").alias("of"))
    return whole.select("digest", F.when(F.col("known") == F.col("of"), F.col("n_tokens")).alias("n_tokens"))


def huge_counts(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of texts(digest, text), in rounds of ever wider overlaps."""
    done, left, turn = [], huge, 0
    while True:
        got = stage(spliced(left, path, chunk, overlap, "tokens-pieces"), f"tokens-{turn}")
        done.append(got.where("n_tokens is not null"))
        failed = got.where("n_tokens is null").select("digest")
        if failed.isEmpty():
            break
        # A piece holds its overlaps many times over, till it is a whole text.
        overlap *= WIDER
        chunk, turn = max(chunk * LONGER, 8 * overlap), turn + 1
        left = huge.join(failed.hint("merge"), "digest", "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows of `docs(text, ...)` with n_bytes (UTF-8) and n_tokens by the tokenizer file at `path`, which every worker can read."""
    if overlap <= MARGIN or chunk < 2 * overlap:
        raise ValueError("an overlap is longer than MARGIN and twice as long as a chunk at most")
    importable(docs.sparkSession)

    @F.pandas_udf("long")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series(lengths(texts.tolist(), path), dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("n_bytes", "n_tokens").withColumn("n_bytes", F.octet_length(text).cast("long"))
    # A huge text is known by its digest: copies are encoded once, rows need no id.
    size = F.char_length(text)
    short = docs.where(size <= chunk).withColumn("n_tokens", whole(text))
    long = docs.where(size > chunk).withColumn("__digest", F.sha2(text, 256))
    known = huge_counts(docs.where(size > chunk).select(F.sha2(text, 256).alias("digest"), text.alias("text")), path, chunk, overlap)
    found = long.join(known.withColumnRenamed("digest", "__digest").hint("merge"), "__digest", "left").drop("__digest")
    return short.unionByName(found)
