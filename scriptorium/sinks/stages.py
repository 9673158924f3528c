"""Tables that outlive a run: versioned segmentations, and stages with a manifest by which a broken run goes on.

All files lie under a root that every executor reaches. A table counts once its marker or manifest is there, which is
written last; what a broken run left without one is overwritten by the next.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scriptorium.sinks import render

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a session inside one process may do without the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    top = top or _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='stages-')}")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """A table written once and read back: what reads it many times does not make it again."""
    path = scratch(rows.sparkSession, "written")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def segmented(files: DataFrame, read: Callable[[DataFrame], DataFrame], root: str, version: str, keep: int = 2) -> tuple[DataFrame, int]:
    """(segments of all files, how many files were read): each file is segmented once for its time and the segmenter's version.

    files(doc_id, mtime, ...); read() gives the segments(doc_id, ...) of files. What the store at `root` holds of the same document, time
    and version is kept, the rest is read, and both are the store's next version; nothing is written where nothing has changed.
    Files without segments are remembered as well. Older store versions but for `keep` go."""
    spark = files.sparkSession
    shape = read(files.limit(0)).schema
    wide = StructType([*shape.fields, StructField("__mtime", files.schema["mtime"].dataType), StructField("__segmenter", StringType())])
    known = render.load_store(spark, root, wide)
    here = files.select("doc_id", F.col("mtime").alias("__mtime"))
    own = known.where(F.col("__segmenter") == version).join(here, ["doc_id", "__mtime"], "left_semi")
    have = own.select("doc_id", F.col("__mtime").alias("mtime")).distinct()
    todo = files.join(have, ["doc_id", "mtime"], "left_anti")
    n = todo.select("doc_id").count()
    stale = known.join(own.select("doc_id", "__mtime", "__segmenter").distinct(), ["doc_id", "__mtime", "__segmenter"], "left_anti")
    if n or not stale.isEmpty():
        fresh = todo.select("doc_id", F.col("mtime").alias("__mtime")).join(read(todo), "doc_id", "left").withColumn("__segmenter", F.lit(version))
        columns = [f.name for f in wide.fields]
        number = max(render._versions(spark, root), default=-1) + 1
        render.write_store(own.select(*columns).unionByName(fresh.select(*columns)), root, "doc_id", number)
        render.collect_versions(spark, root, keep)
        known = render.load_store(spark, root, wide)
    rest = [f.name for f in shape.fields if f.name != "doc_id"]
    return known.where(" or ".join(f"`{c}` is not null" for c in rest)).drop("__mtime", "__segmenter"), n


def remembered(known: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what holds now, what is to be kept) of a document's field: known(doc_id, field) of earlier runs and asked(doc_id, field) of this one.

    A field that is asked for wins and is kept, one that is not is the earlier one; `differs` marks a document whose two fields are not
    the same. A document in `asked` more than once has the smallest of its fields; null and empty fields are none."""
    field = F.nullif(F.trim("field"), F.lit(""))
    one = lambda d, name: d.groupBy("doc_id").agg(F.min(field).alias(name))
    both = one(asked, "asked").join(one(known, "known"), "doc_id", "full")
    now = both.withColumn("field", F.coalesce("asked", "known")).withColumn("differs", F.coalesce(F.col("asked") != F.col("known"), F.lit(False)))
    here = now.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    return here.select("doc_id", "field", "differs"), now.where("field is not null").select("doc_id", "field")


def checkpointed(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Checkpoints(doc_id, kind, sid, value) with those of a run: a document's results of a kind take the place of all its earlier ones of that kind; other kinds and documents stay."""
    made = fresh.select("doc_id", "kind").distinct()
    return known.join(made, ["doc_id", "kind"], "left_anti").select(*fresh.columns).unionByName(fresh)


def save_state(spark: SparkSession, root: str, asked: DataFrame, fresh: DataFrame, keep: int = 2) -> tuple[DataFrame, DataFrame]:
    """(fields of the documents asked for, all checkpoints) with both written as the next versions of their stores under `root`.

    Each store is published by its own marker: a run that breaks between the two has its fields and the checkpoints of before."""
    meta, marks = f"{root}/meta", f"{root}/checkpoints"
    now, keeps = remembered(render.load_store(spark, meta, asked.select("doc_id", "field").schema), asked)
    now = written(now)
    for top, rows in ((meta, keeps), (marks, checkpointed(render.load_store(spark, marks, fresh.schema), fresh))):
        number = max(render._versions(spark, top), default=-1) + 1
        render.write_store(rows, top, "doc_id", number)
        render.collect_versions(spark, top, keep)
    return now, render.load_store(spark, marks, fresh.schema)


MANIFEST = "stage string, rows_in long, digest_in string, rows_out long, digest_out string"


def digest(rows: DataFrame) -> tuple[int, str]:
    """(rows, a sum of row hashes): the same whatever the rows' order or files."""
    got = rows.select(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return got[0], str(got[1])


def manifest(spark: SparkSession, root: str, stage: str) -> dict | None:
    """What a finished stage has noted; none where there is no whole note."""
    path = f"{root}/{stage}.manifest"
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return None
    row = spark.read.schema(MANIFEST).json(path).first()
    return row.asDict() if row else None


def run_stages(source: DataFrame, root: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], redo: str | None = None) -> tuple[DataFrame, list[str]]:
    """(the last stage's rows, the stages that ran): each stage's rows rest at `root`, its manifest is written after them.

    A stage is left out where its manifest names the input as it is now and the output as it lies there: a broken run goes on
    behind its last whole stage, a torn or altered output is made again, and a changed input makes all that follows again.
    `redo` names a stage from which on all run."""
    spark, ran, force = source.sparkSession, [], False
    rows_in, digest_in = digest(source)
    for name, f in stages:
        force = force or name == redo
        path, known = f"{root}/{name}", manifest(spark, root, name)
        if known and not force and (known["rows_in"], known["digest_in"]) == (rows_in, digest_in) and _lies(spark, path, known):
            source, rows_in, digest_in = spark.read.parquet(path), known["rows_out"], known["digest_out"]
            continue
        render.remove(spark, f"{root}/{name}.manifest")
        f(source).write.mode("overwrite").parquet(path)
        source = spark.read.parquet(path)
        rows_out, digest_out = digest(source)
        spark.createDataFrame([(name, rows_in, digest_in, rows_out, digest_out)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/{name}.manifest")
        rows_in, digest_in = rows_out, digest_out
        ran.append(name)
    return source, ran


def _lies(spark: SparkSession, path: str, known: dict) -> bool:
    """Whether a stage's rows are those of its manifest."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return False
    return digest(spark.read.parquet(path)) == (known["rows_out"], known["digest_out"])
