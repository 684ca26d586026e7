"""Drained queues, nested endpoints with their own middleware, JSON elements, folds by marks, and the entry without its optional parts."""

import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.operators import delivery, stateful
from routeflow.plans import build, config, run
from routeflow.sources import topics

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _messages(spark, n, start=0):
    return spark.createDataFrame([(f"{i:032x}", f"p{i}".encode(), {"route_key": "AB"[i % 2]}) for i in range(start, start + n)], M.MESSAGE)


def _ids(df):
    return sorted(int(r["message_id"], 16) for r in df.collect())


def test_json_elements(spark):
    texts = ['{"a": 1}', "12", "12 x", "1],[2", '1},{"v":2', "1,2", "", "a\tb", "x\r", '"q"', "\x01", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.as_json_element(F.col("t"))).collect()]
    assert got[-1] is None and got[:2] == ['{"a":1}', "12"] and got[9] == '"q"'
    assert [json.loads(x) for x in got[2:9]] == texts[2:9] and json.loads(got[10]) == "\x01"


def test_marks_by_brute_force():
    rng = np.random.default_rng(1)
    for step, most in ((5, None), (4, 3), (1, 2), (50, 7)):
        sessions = np.sort(rng.integers(0, 40, 600))
        values = np.concatenate([np.sort(rng.integers(0, 60, (sessions == s).sum())) for s in np.unique(sessions)])
        want, last, since = [], None, 0
        for k, (s, v) in enumerate(zip(sessions, values, strict=True)):
            new = not k or s != sessions[k - 1] or v >= last + step or (most is not None and since >= most)
            last, since = (v, 1) if new else (last, since + 1)
            want.append(new)
        marks, cuts = stateful.Marks(step, most), [0, *sorted(rng.integers(0, 600, 9)), 600]
        got = np.concatenate([marks.of(sessions[a:b], values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        assert got.tolist() == want


def test_replies_give_the_first_answer(spark):
    asks = spark.createDataFrame([("a", 10, "q1"), ("a", 30, "q2"), ("b", 10, "q3"), (None, 10, "q4")], "k string, t long, q string")
    gives = spark.createDataFrame([("a", 5, "early"), ("a", 12, "first"), ("a", 13, "second"), ("a", 31, "third"), ("b", 99, "late"), (None, 11, "none")], "k string, at long, r string")
    out = delivery.replies(asks, gives, "k", "t", "at", 20).collect()
    assert {r["q"]: (r["r"], r["timed_out"]) for r in out} == {"q1": ("first", False), "q2": ("third", False), "q3": (None, True), "q4": (None, True)} and len(out) == 4


def test_queue_is_drained_and_rejected_messages_return(spark, tmp_path):
    root = f"file://{tmp_path}"
    topics.publish(_messages(spark, 4), root, "q")
    rows, done = topics.drained(spark, root, "q")
    topics.publish(_messages(spark, 2, 10), root, "q")  # meanwhile
    assert _ids(rows) == [0, 1, 2, 3]
    done(rows.where(F.col("message_id").endswith("3")))
    assert _ids(topics.queued(spark, root, "q")) == [3, 10, 11]
    assert topics.drained(spark, root, "none")[0].count() == 0


def test_children_have_their_own_middleware(spark, tmp_path):
    root = f"file://{tmp_path}/topics"
    topics.publish(_messages(spark, 6), root, "in")
    text = """
r:
  input: {memory: {topic: in}, middlewares: [metrics]}
  output:
    switch: {metadata_key: route_key, cases: {A: {memory: {topic: a}, middlewares: [metrics, {dlq: {endpoint: {memory: {topic: lost}}}}]}}, default: {memory: {topic: b}}}
    middlewares: [metrics]
"""
    r = config.load(text, {})["r"]
    a = r.output.options["cases"]["A"].with_handler(lambda d: d.withColumn("status", F.when(F.col("message_id").endswith("4"), M.RETRYABLE).otherwise(M.ACK)))
    r = config.Route(r.input, config.Endpoint("switch", {**r.output.options, "cases": {"A": a}}, r.output.middlewares))
    metrics = {}
    run.run(spark, "r", r, root, metrics)
    held = run.output_of(spark, r, "r", root)
    assert {k: _ids(v) for k, v in held.items()} == {"memory:a": [0, 2], "memory:lost": [4], "memory:b": [1, 3, 5]}
    assert topics.queued(spark, root, "in").count() == 0
    assert {k: o.get["processed"] for k, o in metrics.items()} == {"input memory:in": 6, "output memory:a": 2, "output switch": 5}
    with pytest.raises(Exception, match="retryable"):
        bare = config.Route(r.input, config.Endpoint("memory", {"topic": "x"}, (("retry", {"max_attempts": 2}),), lambda d: d.withColumn("status", F.lit(M.RETRYABLE))))
        build.plan(_messages(spark, 1).withColumn("arr_us", F.lit(0)), bare).collect()


def test_configuration_schema():
    s = config.schema()
    assert s["$defs"]["route"]["properties"].keys() == {"input", "output", "concurrency", "batch_size", "commit_concurrency_limit"}
    assert {"switch", "fanout", "kafka", "middlewares"} <= s["$defs"]["endpoint"]["properties"].keys() and json.dumps(s)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_optional_parts(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if not pipeline else [])))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'route_tree' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q) and e.oracle_sql().keys() <= q.keys()"
    assert not os.path.exists(tmp_path / "repo/routeflow/llm")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
