"""Provider caches that are filled once: what retried tasks, broken runs and failing providers leave."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from scriptorium.sinks import puts

ROWS = "id long, key string, prompt string"


def asked(path):
    """The keys of all calls, in the order of the calls."""
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return [json.loads(x) for x in f]


def caller(path, fails=()):
    def call(prompts, keys):
        with open(path, "a") as f:
            f.write(json.dumps(keys) + "\n")
        if any(p in fails for p in prompts):
            raise ValueError("refused")
        return [f"<{p}>{os.urandom(4).hex()}" for p in prompts]

    return call


def test_a_key_is_asked_for_once(spark, tmp_path):
    root, log = f"file://{tmp_path}/cache", f"{tmp_path}/log"
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, None, "z"), (5, "c", None)], ROWS)
    got = {r.id: r for r in puts.put_once(rows, "prompt", caller(log), root).collect()}
    assert sorted(k for ks in asked(log) for k in ks) == ["a", "b"]
    assert got[1].value == got[2].value and got[1].value.startswith("<x>") and not got[1].cached
    assert (got[4].value, got[4].error, got[5].value, got[5].error) == (None, "no key", None, "no prompt")
    # The next run asks for what is new, and leaves known values as they are.
    more = rows.union(spark.createDataFrame([(6, "d", "w")], ROWS))
    again = {r.id: r for r in puts.put_once(more, "prompt", caller(log), root).collect()}
    assert asked(log)[-1] == ["d"] and again[1].value == got[1].value and again[1].cached and not again[6].cached
    assert not os.path.exists(f"{tmp_path}/cache/attempts")
    empty = puts.put_once(rows.limit(0), "prompt", caller(log), root)
    assert empty.count() == 0 and empty.columns == ["key", "id", "prompt", "value", "error", "cached"]


def test_a_failed_row_stops_no_other_and_is_asked_for_again(spark, tmp_path):
    root, log = f"file://{tmp_path}/cache", f"{tmp_path}/log"
    rows = spark.createDataFrame([(k, f"k{k}", f"p{k}") for k in range(40)], ROWS)
    none = lambda s: None
    got = {r.id: r for r in puts.put_once(rows, "prompt", caller(log, {"p7"}), root, wait=none).collect()}
    assert [k for k, r in got.items() if r.value is None] == [7] and got[7].error == "ValueError: refused"
    n = len(asked(log))
    again = {r.id: r for r in puts.put_once(rows, "prompt", caller(log), root, wait=none).collect()}
    assert asked(log)[n:] == [["k7"]] and again[7].value.startswith("<p7>") and again[7].error is None
    assert all(again[k].value == got[k].value for k in got if k != 7)


def test_a_run_that_broke_before_or_after_its_commit_pays_nothing_twice(spark, tmp_path):
    root, log = f"file://{tmp_path}/cache", f"{tmp_path}/log"
    rows = spark.createDataFrame([(k, f"k{k}", f"p{k}") for k in range(10)], ROWS)
    puts.ask(rows, "prompt", caller(log), root)  # and no commit
    n, paid = len(asked(log)), f"{tmp_path}/cache/attempts"
    assert n and puts.store(spark, root).count() == 0
    subprocess.run(["cp", "-r", paid, f"{tmp_path}/kept"], check=True)
    with open(f"{paid}/lot=00000000/_torn.tmp", "w") as f:
        f.write("torn")
    first = {r.key: r.value for r in puts.put_once(rows, "prompt", caller(log), root).collect()}
    assert len(asked(log)) == n and all(first.values())
    # The files of a put that is published, and a second value to a key among them.
    subprocess.run(["cp", "-r", f"{tmp_path}/kept", paid], check=True)
    puts.note(f"{root}/attempts/lot=00000000", {"k1": "another", "k99": "b"})
    puts.note(f"{root}/attempts/lot=00000000", {"k99": "a"})
    second = {r.key: r.value for r in puts.put_once(rows, "prompt", caller(log), root).collect()}
    assert second == first and len(asked(log)) == n
    assert puts.store(spark, root).where("key = 'k99'").collect()[0].value == "a"
    # A put without its marker is none.
    os.remove(f"{tmp_path}/cache/put={1:012d}/_SUCCESS")
    assert puts.store(spark, root).count() == 10


def test_puts_are_folded(spark, tmp_path):
    root, log = f"file://{tmp_path}/cache", f"{tmp_path}/log"
    for k in range(4):
        puts.put_once(spark.createDataFrame([(k, f"k{k}", "p")], ROWS), "prompt", caller(log), root)
    before = {r.key: r.value for r in puts.store(spark, root).collect()}
    puts.fold(spark, root, 2)
    puts.fold(spark, root, 2)
    assert puts._whole(spark, root) == [f"{root}/put={3:012d}-fold"]
    puts.put_once(spark.createDataFrame([(9, "k9", "p")], ROWS), "prompt", caller(log), root)
    after = {r.key: r.value for r in puts.store(spark, root).collect()}
    assert after.pop("k9") and after == before and len(before) == 4


def test_speculation_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x")], ROWS)
    held = spark.conf.get
    try:
        spark.conf.get = lambda name, *rest: "true" if name == "spark.speculation" else held(name, *rest)
        with pytest.raises(ValueError, match="speculat"):
            puts.ask(rows, "prompt", caller(f"{tmp_path}/log"), str(tmp_path))
    finally:
        del spark.conf.get


KILLED = """
    import json, os, sys
    sys.path.insert(0, {here!r})
    from pyspark.sql import SparkSession
    from scriptorium.sinks import puts

    def call(prompts, keys):
        with open({log!r}, "a") as f:
            f.write(json.dumps(keys) + "\\n")
        if len(open({log!r}).readlines()) == 3 and not os.path.exists({dead!r}):
            open({dead!r}, "w").close()
            os._exit(1)  # after the provider was paid, before the answer is noted
        return [p + os.urandom(4).hex() for p in prompts]

    spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
    rows = spark.createDataFrame([(k, "k%03d" % k, "p") for k in range(100)], "id long, key string, prompt string")
    got = puts.put_once(rows, "prompt", call, {root!r}, batch=10).collect()
    print("RESULT", len(got), len([r for r in got if r.value]), puts.store(spark, {root!r}).count())
    spark.stop()
"""


def test_a_task_killed_after_a_call_asks_again_for_that_batch_alone(tmp_path):
    log, here = f"{tmp_path}/log", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    text = textwrap.dedent(KILLED).format(here=here, log=log, dead=f"{tmp_path}/dead", shared=f"file://{tmp_path}/shared", root=f"file://{tmp_path}/cache")
    done = subprocess.run([sys.executable, "-c", text], capture_output=True, text=True, timeout=300, check=False)
    assert "RESULT 100 100 100" in done.stdout, done.stderr[-2000:]
    calls = asked(log)
    assert len(calls) == 11 and calls.count(calls[2]) == 2  # the batch in flight, under the same idempotency keys
    assert sorted({k for ks in calls for k in ks}) == [f"k{k:03d}" for k in range(100)]
    assert len(calls[2]) == 10 and sum(len(x) for x in calls) == 110
