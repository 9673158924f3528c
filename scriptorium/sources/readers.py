"""Readers: each gives a DataFrame of declared columns."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptorium.operators import glossary as G
from scriptorium.sources import schemas


def json_table(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Whole-file JSON by a declared schema; strict: broken files are an error, else they are null rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path, multiLine=True)


def segments_of(documents: DataFrame) -> DataFrame:
    """The flat segments of nested documents, in reading order, with defaults for absent fields."""
    secs = documents.select("doc_id", F.posexplode("sections").alias("sec_no", "sec"))
    segs = secs.select("doc_id", "sec_no", F.col("sec.heading").alias("sec_heading"), F.posexplode("sec.segments").alias("at", "s"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_no", "at"))
    fill = {"indented": False, "col": 0, "in_box": False, "is_figure": False, "fig_label": ""}
    cols = [F.coalesce(F.col(f"s.{c}"), F.lit(v)).alias(c) for c, v in fill.items()]
    return segs.select("doc_id", F.col("s.sid").alias("sid"), F.col("s.sec_path").alias("sec_path"), "sec_heading", F.col("s.sec_level").alias("sec_level"), F.col("s.index").alias("index"), F.col("s.page").alias("page"), F.col("s.src_text").alias("src_text"), F.col("s.n_words").alias("n_words"), *cols, pos.alias("seg_pos"))


def records_of(artefacts: DataFrame) -> DataFrame:
    """(doc_id, sid, record columns) of a translation or script artefact."""
    return artefacts.select("doc_id", F.explode(F.map_entries("segments")).alias("e")).select("doc_id", F.col("e.key").alias("sid"), "e.value.*")


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html) of whole HTML files; the id is the file's stem."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1).alias("doc_id"), F.col("value").alias("html"))


def discovered(spark: SparkSession, folder: str, pattern: str = "*.{pdf,html}") -> DataFrame:
    """(doc_id, kind, path) of a folder's own files; ids of either kind are one set."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("kind"), "path").where("doc_id not like '\\_sample\\_%'")


def artefact_ids(spark: SparkSession, root: str, stage: str) -> DataFrame:
    if stage not in schemas.ARTIFACTS:
        raise ValueError(f"unknown stage {stage!r}; known: {', '.join(schemas.ARTIFACTS)}")
    folder, name = schemas.ARTIFACTS[stage].split("/")
    return discovered(spark, f"{root}/{folder}", name.format("*")).select("doc_id").distinct()


def doc_field(docs: DataFrame, meta: DataFrame) -> DataFrame:
    return docs.join(meta.select("doc_id", "field"), "doc_id", "left")


def resolve_doc(candidates: DataFrame, given: str | None = None) -> str:
    """The given id, else the only candidate; none or several are an error that lists them."""
    if given:
        return given
    ids = [r["doc_id"] for r in candidates.select("doc_id").distinct().orderBy("doc_id").limit(21).collect()]
    if len(ids) != 1:
        raise ValueError(f"name one of the documents: {', '.join(ids[:20]) or 'none found'}")
    return ids[0]


def first_available(*sources: DataFrame) -> DataFrame:
    """(doc_id, text) from the first source that has the document."""
    ranked = reduce(DataFrame.unionByName, [s.select("doc_id", "text", F.lit(i).alias("rank")) for i, s in enumerate(sources)])
    return ranked.where("text is not null").groupBy("doc_id").agg(F.min_by("text", "rank").alias("text"))


def unsegmented(files: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """Files that have no segmentation of their id, time and version yet. files(doc_id, mtime), cached(doc_id, mtime, version)."""
    return files.join(cached.where(F.col("version") == version).select("doc_id", "mtime"), ["doc_id", "mtime"], "left_anti")


def yaml_rows(text: str, key: str) -> list[dict]:
    """The rows of a YAML list, or of a mapping that holds it under `key`."""
    import yaml

    data = yaml.safe_load(text) or []
    return list(data.get(key) or []) if isinstance(data, dict) else list(data)


def glossary_rows(text: str) -> list[dict]:
    """Terms from YAML or, where it is none, from lines of `term | zh | mode | note`; a bad mode is an error."""
    try:
        rows = [r for r in yaml_rows(text, "terms") if isinstance(r, dict)]
    except Exception:  # noqa: BLE001
        rows = []
    if not rows:
        for line in text.splitlines():
            parts = [p.strip() for p in line.split("|")]
            if len(parts) >= 2 and not line.lstrip().startswith("#"):
                rows.append(dict(zip(("term", "zh", "mode", "note"), parts, strict=False)))
    out = []
    for r in rows:
        if not str(r.get("term") or "").strip() or not str(r.get("zh") or "").strip():
            continue
        mode = r.get("mode") or G.HINT
        if mode not in (G.HARD, G.HINT):
            raise ValueError(f"unknown mode {mode!r} of {r['term']!r}")
        out.append(r | {"term": str(r["term"]).strip(), "zh": str(r["zh"]).strip(), "mode": mode, "aliases": list(r.get("aliases") or [])})
    return out


def glossary(spark: SparkSession, *texts: str) -> DataFrame:
    """The terms of the main glossary and its overrides, in order."""
    return G.terms_frame(spark, [r for t in texts for r in glossary_rows(t)])


def polyphone_rules(*texts: str) -> list[tuple[str, str]]:
    """(word, tts) rules; a later text overwrites an earlier one by word; the longest word first."""
    rules: dict[str, str] = {}
    for t in texts:
        rules |= {str(r["word"]): str(r["tts"]) for r in yaml_rows(t, "rules") if r.get("word") and r.get("tts") is not None}
    return sorted(rules.items(), key=lambda r: -len(r[0]))


def load_env(text: str, override: bool = False) -> dict[str, str]:
    """KEY=value lines, quotes stripped; what the environment has already wins unless told otherwise."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().partition("=")
        if eq and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return {k: v if override else os.environ.get(k, v) for k, v in out.items()}


def search_term(term: str, days: int = 0) -> str:
    """The search with its date window folded in."""
    return f'({term}) AND "last {days} days"[edat]' if days > 0 else term


def articles(raw: DataFrame, column: str = "xml", separator: str = "\n") -> DataFrame:
    """Feed records from one <PubmedArticle> document a row; only direct children count, so cited articles do not leak in."""
    x = F.from_xml(F.col(column), schemas.ARTICLE, {"rowTag": "PubmedArticle", "attributePrefix": "_", "valueTag": "_VALUE"})
    a, d = "x.MedlineCitation.Article", "x.PubmedData"
    parts = F.transform(f"{a}.Abstract.AbstractText", lambda p: F.when(F.length(p["_Label"]) > 0, F.concat(p["_Label"], F.lit(": "), F.trim(p["_VALUE"]))).otherwise(F.trim(p["_VALUE"])))
    by_type = lambda t: F.get(F.filter(f"{d}.ArticleIdList.ArticleId", lambda i: i["_IdType"] == t), F.lit(0))["_VALUE"]
    entrez = F.get(F.filter(f"{d}.History.PubMedPubDate", lambda h: F.lower(h["_PubStatus"]) == "entrez"), F.lit(0))
    date = F.concat_ws("-", entrez["Year"], F.lpad(entrez["Month"], 2, "0"), F.lpad(entrez["Day"], 2, "0"))
    pub = f"{a}.Journal.JournalIssue.PubDate"
    return raw.select(x.alias("x")).select(
        F.col("x.MedlineCitation.PMID").alias("pmid"), by_type("doi").alias("doi"), by_type("pmc").alias("pmc"), F.col(f"{a}.Journal.Title").alias("journal"), F.col(f"{a}.Journal.ISOAbbreviation").alias("journal_abbr"), F.col(f"{a}.ArticleTitle").alias("title"),
        F.array_join(parts, separator).alias("abstract"), F.col(f"{pub}.Year").alias("year"), F.col(f"{pub}.Month").alias("month"), F.col(f"{pub}.Day").alias("day"), F.col(f"{pub}.MedlineDate").alias("medline"), F.when(entrez.isNotNull(), date).alias("entrez_date"), F.col(f"{a}.PublicationTypeList.PublicationType").alias("ptypes"),
    )


def http_get(url: str, tries: int = 3, timeout: int = 90) -> str:
    """GET with a linear back-off."""
    for i in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.read().decode("utf-8")
        except Exception:
            if i + 1 == tries:
                raise
            time.sleep(1.5 * (i + 1))
    raise RuntimeError("unreachable")


# Results of a search by its days, and the window that takes the place of an empty one.
RESULTS = [(7, 20), (14, 50)]
MOST_RESULTS, WIDE_DAYS, WIDE_RESULTS = 100, 30, 50


def results_of(days: int) -> int:
    return next((n for most, n in RESULTS if days <= most), MOST_RESULTS)


class Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class FeedReader(DataSourceReader):
    """Search on the driver, fetch in batches of 150 on the executors.

    With the option `widening` the number of results follows the days, and a window of under WIDE_DAYS that holds nothing is widened to them."""

    def __init__(self, options: dict[str, str], get: Callable[[str], str]):
        self.options, self.get = options, get

    def found(self, days: int, retmax: str) -> list[str]:
        query = {"db": "pubmed", "retmode": "json", "retmax": retmax, "term": search_term(self.options["term"], days)}
        return json.loads(self.get(f"{self.options['base']}/esearch.fcgi?{urllib.parse.urlencode(query)}"))["esearchresult"]["idlist"]

    def partitions(self) -> list[Ids]:
        o = self.options
        widening = o.get("widening", "false").lower() == "true"
        days = int(o.get("days", "7" if widening else "30"))
        ids = self.found(days, o.get("retmax", str(results_of(days)) if widening else "500"))
        if widening and not ids and days < WIDE_DAYS:
            ids = self.found(WIDE_DAYS, str(WIDE_RESULTS))
        return [Ids(ids[i : i + 150]) for i in range(0, len(ids), 150)] or [Ids([])]

    def read(self, partition: Ids) -> Iterator[tuple[str]]:
        import xml.etree.ElementTree as ET

        if partition.ids:
            query = {"db": "pubmed", "retmode": "xml", "id": ",".join(partition.ids)}
            time.sleep(float(self.options.get("pause", "0.4")))
            for e in ET.fromstring(self.get(f"{self.options['base']}/efetch.fcgi?{urllib.parse.urlencode(query)}")).findall("PubmedArticle"):  # noqa: S314
                yield (ET.tostring(e, encoding="unicode"),)


class FeedSource(DataSource):
    """spark.read.format("literature_feed").option("base", url).option("term", ...).load(): one article's XML a row."""

    getter: Callable[[str], str] = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "literature_feed"

    def schema(self) -> str:
        return "xml string"

    def reader(self, schema) -> FeedReader:  # noqa: ANN001
        return FeedReader(dict(self.options), type(self).getter)


def or_preset(fetched: DataFrame, preset: DataFrame) -> DataFrame:
    """What was fetched, or the preset rows where that is nothing."""
    none = fetched.limit(1).agg(F.count("*").alias("__n")).where("__n = 0")
    return fetched.unionByName(preset.join(F.broadcast(none.select(F.lit(True).alias("__none"))), F.lit(True)).drop("__none"))


def prefixed(table: DataFrame, column: str, prefix: str) -> DataFrame:
    """The records of a key-value table whose key begins so."""
    return table.where(F.col(column).startswith(prefix))


# What a chat model's name begins with, and what it must not hold.
CHAT_PREFIXES = ["gpt-", "o1", "o3", "chatgpt-"]
NO_CHAT = ["realtime", "audio", "transcription"]


def models(catalogue: DataFrame) -> DataFrame:
    """Chat models of a catalogue(name), by name."""
    begins = reduce(lambda a, p: a | F.startswith("name", F.lit(p)), CHAT_PREFIXES, F.lit(False))
    other = reduce(lambda a, p: a | F.contains("name", F.lit(p)), NO_CHAT, F.lit(False))
    return catalogue.where(begins & ~other).orderBy("name")


def ordered_text(segments: DataFrame) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "src_text"))), lambda x: x["src_text"]), "\n\n")
