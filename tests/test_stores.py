"""Stores, stages and page files: what a second run leaves alone, what a broken one leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import layout as L
from scriptorium.operators import segments as S
from scriptorium.plans import base as B
from scriptorium.sinks import render, stages
from scriptorium.sources import pages as P


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, mtime long, text string")


def test_files_are_segmented_once_for_their_time_and_version(spark, tmp_path):
    root, seen = f"file://{tmp_path}/store", spark.sparkContext.accumulator(0)

    def read(table):
        @F.udf("string")
        def count(t):
            seen.add(1)
            return t

        return S.text_segments(table.withColumn("text", count("text"))).select("doc_id", "sid", "src_text")

    def run(rows, version="v1"):
        before = seen.value
        got, n = stages.segmented(files(spark, rows), read, root, version)
        return sorted((r.sid, r.src_text) for r in got.collect()), n, seen.value - before

    rows = [("a", 1, "one\ntwo"), ("b", 1, "three"), ("c", 1, " ")]
    all_of = [("a#body#01", "one"), ("a#body#02", "two"), ("b#body#01", "three")]
    assert run(rows)[:2] == (all_of, 3)
    assert run(rows) == (all_of, 0, 0) and len(render._versions(spark, root)) == 1
    # One file has changed, one is gone, one is new: only two are read.
    got, n, read_now = run([("a", 2, "one\nmore"), ("c", 1, " "), ("d", 5, "four")])
    assert got == [("a#body#01", "one"), ("a#body#02", "more"), ("d#body#01", "four")] and (n, read_now) == (2, 2)
    # A broken run leaves the store as it was: a version without its marker is none.
    rest = [("a", 2, "one\nmore"), ("c", 1, " "), ("d", 5, "four")]
    torn = f"{tmp_path}/store/version={2:012d}"
    os.makedirs(torn)
    with open(f"{torn}/part-0.parquet", "w") as f:
        f.write("torn")
    assert run(rest)[1:] == (0, 0)
    # A new version of the segmenter reads all; old versions of the store go.
    assert run(rest, "v2")[1:] == (3, 3)
    assert run(rest, "v2")[1:] == (0, 0) and len(render._versions(spark, root)) == 2
    assert run([], "v2")[:2] == ([], 0)


def test_stages_go_on_where_a_run_broke(spark, tmp_path):
    root, fails = f"file://{tmp_path}/run", {"on": True}
    source = spark.range(10).withColumn("x", F.col("id") * 2)

    def broken(d):
        if fails["on"]:
            raise RuntimeError("killed")
        return d.withColumn("y", F.col("x") + 1)

    steps = [("first", lambda d: d.where("x > 4")), ("second", broken), ("third", lambda d: d.agg(F.sum("y").alias("sum")))]
    with pytest.raises(RuntimeError):
        stages.run_stages(source, root, steps)
    assert stages.manifest(spark, root, "first")["rows_out"] == 7 and stages.manifest(spark, root, "second") is None
    fails["on"] = False
    got, ran = stages.run_stages(source, root, steps)
    assert ran == ["second", "third"] and got.first()[0] == sum(2 * i + 1 for i in range(3, 10))
    assert stages.run_stages(source, root, steps)[1] == []
    # A torn output is made again, and since it is the same, what follows stands.
    part = next(f for f in os.listdir(f"{tmp_path}/run/second") if f.endswith(".parquet"))
    os.remove(f"{tmp_path}/run/second/{part}")
    assert stages.run_stages(source, root, steps)[1] == ["second"]
    assert stages.run_stages(source.where("id < 9"), root, steps)[1] == ["first", "second", "third"]
    assert stages.run_stages(source.where("id < 9"), root, steps, redo="second")[1] == ["second", "third"]


def test_page_files_give_the_segments_of_their_lines(spark, tmp_path):
    """Files of pages, one of them broken, are read by lines and segmented as the lines they hold."""
    lines, rects, _ = B.laid_out(spark)
    whole = F.when(F.length("head_text") > 0, F.array(F.struct(F.concat("head_text", F.lit(" ")).alias("text"), F.lit(16).alias("flags")), F.struct(F.col("rest_text").alias("text"), F.lit(0).alias("flags")))).otherwise(F.array(F.struct("text", F.when(F.col("bold"), 16).otherwise(0).alias("flags"))))
    spans = lines.withColumn("line", F.row_number().over(L.Window.partitionBy("page").orderBy("y0", "x0"))).select("*", F.posexplode(whole).alias("seq", "w"))
    spans = spans.select("doc_id", "page", "line", "x0", "y0", "x1", "seq", "w.text", F.get("sizes", F.lit(0)).alias("size"), "w.flags", F.array_join(F.map_keys("font_chars"), "").alias("font"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))
    sizes = spans.select("doc_id", "page").distinct().withColumn("width", F.lit(600.0))
    none = rects.where("false")
    P.dumped(spans, rects, none, sizes).repartition(3).write.json(f"{tmp_path}/p")
    with open(f"{tmp_path}/p/broken.json", "w") as f:
        f.write('{"doc_id": "p", "page": \n')
    read = P.page_files(spark, f"file://{tmp_path}/p")
    assert read.count() == 3
    got = L.segment_spans(*P.extracted(read)).select("sid", "sec_heading", "sec_level", F.col("page").cast("int").alias("page"), "src_text")
    assert sorted(map(tuple, got.collect())) == sorted(B.LINE_SEGMENTS)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        P.page_files(spark, f"file://{tmp_path}/p", strict=True).collect()
    with open(f"{tmp_path}/named.v1.jsonl", "w") as f:
        f.write('{"page": 0, "width": 1.0, "height": 1.0}\n')
    assert P.page_files(spark, f"file://{tmp_path}/named.v1.jsonl").first().doc_id == "named"
