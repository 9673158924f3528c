"""A provider cache that is filled once: answers are journalled by the tasks that get them and published by a commit.

A put has two phases. Each task writes what a call has answered to a file of its own below `attempts`, call by call,
under the lot of its keys; a task that is run again reads its lot's files first and asks only for the rest. The files
of a lot that is through become one, so that a commit reads as many files as there are lots, not calls. Then one
job takes one value a key from all files and writes the next `put`; its marker, written last, publishes it.

* A task lost between a call and its file asks again for that one batch: a provider that takes idempotency keys (`call`
  gets the cache keys) bills it once, any other twice. The store has one value in any case.
* A driver lost before the commit leaves files; the next run publishes them before it asks for anything.
* One lost after the commit leaves files whose keys are all known; they change nothing and go.

A store has one writer at a time, and speculative copies of a task would pay for the same rows: with
spark.speculation set a put is refused. Files are written by the tasks with pyarrow, so the root is a folder, or an
address that pyarrow knows (file, hdfs, s3, gs), which every executor reaches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import cache as C
from scriptorium.sinks import render, stages

ENTRY = "key string, value string"
#: Keys of a lot: what a task looks up in the journal at a time.
LOT_KEYS = 4096
#: Tasks of one run at most; each goes through its lots one by one.
TASKS = 1 << 15
#: Prompts of one call.
BATCH = 32
#: Puts that lie side by side before they are folded into one.
FOLD = 16

Call = Callable[[list[str], list[str]], list[str]]


def _at(address: str):
    """(filesystem, path) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def _uri(root: str) -> str:
    """Spark writes a local folder as file:/x, pyarrow as file:///x."""
    return "file:///" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root.rstrip("/")


class Lot:
    """The answers to a lot's keys, in files of a JSON object a line; `known` are those of its files, of several to a key the one that commits, the smallest."""

    def __init__(self, address: str) -> None:
        self.disk, self.path = _at(address)
        self.known: dict[str, str] = {}
        self.files: list[str] = []
        while not self._read():
            self.known, self.files = {}, []

    def _read(self) -> bool:
        """False where a file has gone: a lost task that still runs has put it into its one file, which is there by then."""
        from pyarrow import fs

        for f in self.disk.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
            if f.base_name.startswith("answers-"):
                try:
                    with self.disk.open_input_file(f.path) as g:
                        text = g.read().decode()
                except FileNotFoundError:
                    return False
                self.files.append(f.path)
                for line in text.split("\n")[:-1]:
                    k, v = (x := json.loads(line))["key"], x["value"]
                    self.known[k] = min(v, self.known.get(k, v))
        return True

    def _write(self, answers: dict[str, str]) -> str:
        """A new file has its name once it is whole."""
        if not self.files:
            self.disk.create_dir(self.path, recursive=True)
        name = uuid.uuid4().hex
        quoted = json.JSONEncoder(ensure_ascii=False).encode
        lines = "".join(f'{{"key": {quoted(k)}, "value": {quoted(v)}}}\n' for k, v in answers.items())
        with self.disk.open_output_stream(f"{self.path}/_{name}.tmp") as f:
            f.write(lines.encode())
        self.disk.move(f"{self.path}/_{name}.tmp", f"{self.path}/answers-{name}.json")
        return f"{self.path}/answers-{name}.json"

    def note(self, answers: dict[str, str]) -> None:
        """The answers of a call as a file."""
        self.files.append(self._write(answers))
        self.known |= answers

    def close(self) -> None:
        """One file of all answers stands for those that were read or written."""
        if len(self.files) > 1:
            one = self._write(self.known)
            for f in self.files:
                try:
                    self.disk.delete_file(f)
                except FileNotFoundError:
                    pass
            self.files = [one]


def note(lot: str, answers: dict[str, str]) -> None:
    """Answers as a file of the lot."""
    Lot(lot).note(answers)


def answered(call: Call, keys: list[str], prompts: list[str], attempts: int, wait: Callable[[float], None]) -> Iterator[tuple[dict[str, str], dict[str, str]]]:
    """(values, errors) by key, as they come: of the whole batch, or row by row where its call fails."""
    try:
        got = call(prompts, keys)
        if len(got) != len(keys) or any(v is None for v in got):
            raise C.ProviderError(500, "an answer is missing")
        yield dict(zip(keys, got, strict=True)), {}
        return
    except Exception:  # noqa: BLE001
        pass
    for k, p in zip(keys, prompts, strict=True):
        try:
            value = C.retried(lambda k=k, p=p: call([p], [k])[0], attempts, wait)
            if value is None:
                raise C.ProviderError(500, "an answer is missing")
            yield {k: value}, {}
        except Exception as e:  # noqa: BLE001
            yield {}, {k: f"{type(e).__name__}: {e}"}


def ask(todo: DataFrame, prompt: str, call: Call, root: str, batch: int = BATCH, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The first phase over rows of different keys: (key, error) of what got no answer; answers lie in files under `root`/attempts."""
    spark = todo.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("speculative tasks would pay twice: a put needs spark.speculation off")
    todo = stages.written(todo.select("key", F.col(prompt).alias("prompt")))
    lots = max(1, -(-todo.count() // LOT_KEYS))
    top = f"{_uri(root)}/attempts"

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot, own = None, None
        for frame in frames:
            failed: dict[str, str] = {}
            for number, rows in frame.groupby("lot", sort=True):
                if number != lot:
                    if own:
                        own.close()
                    lot, own = number, Lot(f"{top}/lot={number:08d}")
                rows = rows[~rows["key"].isin(list(own.known))]
                keys, prompts = rows["key"].tolist(), rows["prompt"].tolist()
                for k in range(0, len(keys), batch):
                    for values, errors in answered(call, keys[k : k + batch], prompts[k : k + batch], attempts, wait):
                        if values:
                            own.note(values)
                        failed |= errors
            yield pd.DataFrame({"key": list(failed), "error": list(failed.values())}, dtype="object")
        if own:
            own.close()

    dealt = todo.withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(lots)))
    dealt = dealt.repartition(min(lots, TASKS), "lot").sortWithinPartitions("lot", "key")
    return stages.written(dealt.mapInPandas(of, "key string, error string"))


def _whole(spark: SparkSession, root: str) -> list[str]:
    """The folders of published puts, in order: a fold stands for those before it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/put=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(f.getPath().getParent().getName() for f in found)
    folds = [k for k, n in enumerate(names) if n.endswith("-fold")]
    return [f"{root}/{n}" for n in names[folds[-1] if folds else 0 :]]


def _entries(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(*folders) if folders else spark.range(0).selectExpr("cast(id as string) as key", "cast(id as string) as value")


def store(spark: SparkSession, root: str) -> DataFrame:
    """(key, value) of all published puts; a key stands once."""
    return _entries(spark, _whole(spark, root))


def _number(folder: str) -> int:
    return int(folder.rsplit("put=", 1)[1][:12])


def commit(spark: SparkSession, root: str) -> None:
    """The second phase: files of attempts become the next put, one value a key, none of a known key; then they go."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/attempts/lot=*/answers-*")
    disk = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if disk.globStatus(top):
        before = _whole(spark, root)
        found = spark.read.schema(ENTRY).option("pathGlobFilter", "answers-*").json(f"{root}/attempts/lot=*", mode="FAILFAST")
        fresh = found.groupBy("key").agg(F.min("value").alias("value")).join(store(spark, root), "key", "left_anti")
        number = _number(before[-1]) + 1 if before else 0
        fresh.select("key", "value").write.mode("overwrite").parquet(f"{root}/put={number:012d}")
    render.remove(spark, f"{root}/attempts")


def fold(spark: SparkSession, root: str, most: int = FOLD) -> None:
    """More than `most` puts become one, under the last one's number; those that it stands for go once it is there."""
    known = _whole(spark, root)
    if len(known) > most:
        folded = f"{root}/put={_number(known[-1]):012d}-fold"
        store(spark, root).repartitionByRange("key").write.mode("overwrite").parquet(folded)
        for old in known:
            if old != folded:
                render.remove(spark, old)


def put_once(
    rows: DataFrame, prompt: str, call: Call, root: str, batch: int = BATCH, attempts: int = 3, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Rows(key, prompt, ...) with `value`, `error` and `cached`, whether the value was published before this run.

    Each key that the store at `root` lacks is asked for once, whatever the number of its rows, by the smallest of its prompts. A row
    without key or prompt gets an error of its own and is not asked for; a key that stays without an answer is asked for again by the next run."""
    spark = rows.sparkSession
    commit(spark, root)
    fold(spark, root)
    before = _whole(spark, root)
    whole = rows.where(F.col("key").isNotNull() & F.col(prompt).isNotNull())
    todo = whole.groupBy("key").agg(F.min(prompt).alias(prompt)).join(_entries(spark, before).select("key"), "key", "left_anti")
    errors = ask(todo, prompt, call, root, batch, attempts, wait)
    commit(spark, root)
    rows = rows.drop("value", "error", "cached")
    # A key stands in one put: those of this run tell what was cached, without another join.
    paid = [_entries(spark, [p for p in _whole(spark, root) if (p in before) == old]).withColumn("cached", F.lit(old)) for old in (True, False)]
    out = rows.join(paid[0].unionByName(paid[1]), "key", "left").join(errors, "key", "left")
    out = out.select(*[c for c in out.columns if c != "cached"], F.coalesce("cached", F.lit(False)).alias("cached"))
    lacking = F.when(F.col("key").isNull(), "no key").when(F.col(prompt).isNull() & F.col("value").isNull(), "no prompt")
    return out.withColumn("error", F.coalesce("error", lacking))
