"""Page files: what an extractor found on each page, one page a line of JSON, as spans, rectangles and sizes.

A file is split by Spark between lines, so that the pages of one long document are read by many tasks. The lines
hold what PDF libraries give of a page: its number, size, blocks of lines of spans, drawings and images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<size:double,flags:int,font:string,text:string>"
LINE = f"struct<dir:array<double>,bbox:array<double>,spans:array<{SPAN}>>"
PAGE = f"doc_id string, page int, width double, height double, blocks array<struct<type:int,lines:array<{LINE}>>>, drawings array<struct<rect:array<double>>>, images array<struct<bbox:array<double>>>, _broken string"


def page_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Pages of the files at a path; a page without an id has its file's stem. Broken lines are left out, or an error if strict."""
    read = spark.read.schema(PAGE).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^/]*$", 1)
    rows = read.json(path).withColumn("doc_id", F.coalesce("doc_id", stem))
    return rows.where("_broken is null and page is not null").drop("_broken")


def spans(pages: DataFrame) -> DataFrame:
    """One row per span, with its line's number on the page, direction and edges, rounded to a tenth."""
    blocks = pages.select("doc_id", "page", F.posexplode("blocks").alias("b", "block")).where("coalesce(block.type, 0) = 0")
    lines = blocks.select("doc_id", "page", "b", F.posexplode("block.lines").alias("l", "x"))
    edge = lambda k: F.round(F.get("x.bbox", F.lit(k)), 1)
    return lines.select(
        "doc_id", "page", (F.col("b").cast("long") * 1_000_000 + F.col("l")).alias("line"), edge(0).alias("x0"), edge(1).alias("y0"), edge(2).alias("x1"),
        F.get("x.dir", F.lit(0)).alias("dir_x"), F.get("x.dir", F.lit(1)).alias("dir_y"), F.posexplode("x.spans").alias("seq", "s"),
    ).select("doc_id", "page", "line", "x0", "y0", "x1", "seq", F.col("s.text").alias("text"), F.round("s.size", 1).alias("size"), F.coalesce("s.flags", F.lit(0)).alias("flags"), "s.font", "dir_x", "dir_y")


def rectangles(pages: DataFrame, of: str = "drawings", box: str = "rect") -> DataFrame:
    """(doc_id, page, page_w, page_h, x0, y0, x1, y1) of a page's drawings, or of its images (`images`, `bbox`)."""
    rows = pages.select("doc_id", "page", F.col("width").alias("page_w"), F.col("height").alias("page_h"), F.explode(of).alias("r"))
    return rows.select("doc_id", "page", "page_w", "page_h", *[F.get(f"r.{box}", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


def extracted(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(spans, drawings, images, pages): what layout.segment_spans() takes."""
    return spans(pages), rectangles(pages), rectangles(pages, "images", "bbox"), pages.select("doc_id", "page", "width")


def dumped(spans: DataFrame, drawings: DataFrame, images: DataFrame, pages: DataFrame, height: float = 800.0) -> DataFrame:
    """The way back: rows of PAGE, one line a block, to be written as lines of JSON."""
    key = ["doc_id", "page"]
    line = spans.groupBy(*key, "line").agg(
        F.array_sort(F.collect_list(F.struct("seq", "size", "flags", "font", "text"))).alias("s"), F.first(F.array("dir_x", "dir_y")).alias("dir"), F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.min("y0") + 10.0).alias("bbox")
    )
    own = F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("size", "flags", "font", "text")]))
    block = F.struct(F.lit(0).alias("type"), F.array(F.struct("dir", "bbox", own.alias("spans"))).alias("lines"))
    blocks = line.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    boxes = lambda rows, name, of: rows.groupBy(*key).agg(F.collect_list(F.struct(F.array("x0", "y0", "x1", "y1").alias(of))).alias(name))
    out = pages.withColumn("height", F.lit(height)).join(blocks, key, "left")
    return out.join(boxes(drawings, "drawings", "rect"), key, "left").join(boxes(images, "images", "bbox"), key, "left")
