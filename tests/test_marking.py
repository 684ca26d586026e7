"""Marks of keys that spread over many partitions, against a fold row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeflow.operators import delivery, marking, stateful
from routeflow.operators.numbering import following


def _fold(rows, step, most):
    """rows: (key, clock, id) -> {id: (mark, grp)}"""
    out, state = {}, {}
    for key, clock, i in sorted(rows, key=lambda r: (r[1], r[2])):
        last, since, grp = state.get(key, (None, 0, -1))
        mark = last is None or clock >= last + step or (most is not None and since >= most)
        state[key] = (clock, 1, grp + 1) if mark else (last, since + 1, grp)
        out[i] = (mark, state[key][2])
    return out


def _rows(seed, n):
    rng = random.Random(seed)
    at = {k: 0 for k in ("hot", "warm", None, "", "z")}
    out = []
    for i in range(n):
        k = rng.choices(list(at), [12, 4, 2, 1, 1])[0]
        at[k] += rng.choices([0, 1, 2, 7, 40], [4, 6, 3, 1, 0.2])[0]
        out.append((k, at[k], i))
    return out


@pytest.mark.parametrize("step,most", [(5, None), (1, None), (60, None), (10_000, None), (9, 4), (10_000, 3), (10_000, 700), (3, 1), (200, 40)])
def test_marks_over_many_partitions(spark, step, most):
    rows = _rows(step, 1500)
    df = spark.createDataFrame([(k, c, i, f"payload {i}") for k, c, i in rows], "k string, c long, i long, __x string").repartition(3)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["i"]: (r["mark"], r["grp"]) for r in marking.marked(df, ["k"], ["c", "i"], F.col("c"), step, most).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _fold(rows, step, most)


def test_a_key_that_never_pauses_alone(spark):
    n = 4000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("c"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = marking.marked(df, ["k"], ["c", "i"], F.col("c"), 10).where("mark").orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["i"] for r in got] == list(range(0, n, 4)) and [r["grp"] for r in got] == list(range(n // 4))
    assert got[0].asDict().keys() == {"k", "c", "i", "mark", "grp"}
    assert marking.marked(df.where("false"), ["k"], ["c", "i"], F.col("c"), 10).count() == 0


def test_chains_of_a_run():
    rng = np.random.default_rng(4)
    for step, most in ((5, None), (3, 4), (1, 1)):
        clock = np.sort(rng.integers(0, 200, 150))
        last, marks = marking.chained(clock, clock + step, most)
        for i in range(150):
            k, n = i, 1
            while (k2 := next((j for j in range(k + 1, 150) if clock[j] >= clock[k] + step or (most and j - k >= most)), None)) is not None:
                k, n = k2, n + 1
            assert (last[i], marks[i]) == (k, n)


def test_messages_without_a_time(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", 5, 3), (None, None, 4)], "k string, us long, id long")
    assert {r["id"]: r["grp"] for r in stateful.weak_join_groups(df, "k", "us", "id", 5, 10).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert [r["id"] for r in stateful.dedup_ttl(df, ["k"], "us", "id", 10).collect()] == [3]


def test_exchanges_by_brute_force(spark):
    rng = random.Random(9)
    asks = [(rng.choice(["h", "h", "h", "b", None]), rng.randrange(300), i) for i in range(300)]
    gives = [(rng.choice(["h", "h", "b", "z", None]), rng.randrange(300), 1000 + i) for i in range(120)]
    want = {}
    for k in ("h", "b", None):
        busy, used = -1, set()
        for _, t, i in sorted((a for a in asks if a[0] == k), key=lambda a: (a[1], a[2])):
            if k is None:
                want[i] = ("timed_out", None)
                continue
            if t <= busy:
                want[i] = ("duplicate", None)
                continue
            answer = min((x for x in gives if x[0] == k and x[1] >= t), key=lambda x: x[1], default=None)
            fine = answer is not None and answer[1] <= t + 9
            busy = min(answer[1], t + 9) if answer else t + 9
            want[i] = ("answered", answer[1]) if fine else ("timed_out", None)
            assert not fine or (k, answer[1]) not in used
            used.add((k, busy))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = delivery.exchanged(spark.createDataFrame(asks, "k string, t long, i long"), spark.createDataFrame(gives, "k string, at long, r long"), "k", "t", "at", 9, "i").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["i"]: (r["outcome"], r["at"]) for r in out} == want and len(out) == 300
    assert {"answered", "timed_out", "duplicate"} == {r["outcome"] for r in out}


def test_what_follows_in_the_order_of_a_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", None, "b"]), i, rng.choice([None, None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    want = {i: next((w for q, j, w in rows if q == k and j >= i and w is not None), None) for k, i, _ in rows}
    assert {r["i"]: r["n"] for r in following(df, ["k"], ["i"], "v", "n").collect()} == want
