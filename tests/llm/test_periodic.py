"""Runs of words against brute force over all periods, and the query against its contract row by row."""

import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeflow.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def _brute_force(w, least=6, times=4):
    out, n = [], len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            start, length = i, j - i + p
            smallest = next(q for q in range(1, p + 1) if all(w[k] == w[k + q] for k in range(start, start + length - q)))
            if smallest == p and length >= max(least, times * p):
                out.append((start, length, p))
            i = j
    return sorted(out)


def _found(texts, **o):
    cuts = np.cumsum([0, *map(len, texts)])
    runs = periodic.find_runs(np.array([x for t in texts for x in t], np.int32), cuts, **o)
    text = np.searchsorted(cuts, runs[:, 0], "right") - 1
    return [[(int(s - cuts[k]), int(m), int(p)) for s, m, p in runs[text == k]] for k in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=40), st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=6)).map(lambda t: t[2] + t[0] * t[1] + t[0][:1] + t[2])), min_size=1, max_size=6), st.sampled_from([(6, 4), (2, 2), (3, 3)]))
def test_runs_match_brute_force(texts, how):
    assert _found(texts, least=how[0], times=how[1]) == [_brute_force(t, *how) for t in texts]


def test_long_and_nested_runs():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 500, 700).tolist()
    nested = ([1, 2] * 5 + [3]) * 5
    texts = [block * 6 + block[:11], [7] * 3000, [], nested, rng.integers(0, 2, 400).tolist(), rng.integers(0, 9, 2).tolist()]
    got = _found(texts)
    assert got[0] == [(0, 4211, 700)] and got[1] == [(0, 3000, 1)] and got[2] == [] and got[3] == _brute_force(nested) and (0, 55, 11) in got[3]
    assert got[4] == _brute_force(texts[4]) and got[5] == []


def test_parts_of_the_index():
    w, cuts = np.array([1, 0, 1, 0, 1, 2, 2, 0, 0, 0], np.int32), np.array([0, 5, 5, 10])
    levels = periodic.ranks(w, cuts)
    suffixes = [w[i : 5 if i < 5 else 10].tolist() for i in range(10)]
    order = sorted(range(10), key=lambda i: (i >= 5, suffixes[i]))
    assert np.argsort(levels[-1]).tolist() == order
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert periodic.lcp(levels, cuts).tolist() == [0] + [shared(suffixes[a], suffixes[b]) if (a < 5) == (b < 5) else 0 for a, b in zip(order, order[1:], strict=False)]
    values = np.random.default_rng(1).permutation(400)
    cuts = np.array([0, 3, 3, 150, 400])
    for v in (values, -values, np.arange(400), -np.arange(400)):
        want = [next((k for k in range(i + 1, e) if v[k] < v[i]), e) for i in range(400) for e in [cuts[np.searchsorted(cuts, i, "right")]]]
        assert periodic.next_smaller(v, cuts).tolist() == want


def test_words_are_split_at_ascii_white_space_only():
    texts = [None, "", " \t\n", "a\xa0b  c\x0b\x0cd\re\x1cf g\x85h\n", "\x00 é"]
    words, cuts = periodic.words_of(pa.array(texts, pa.string()))
    assert [words.to_pylist()[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def _collapsed(w, runs):
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_collapse_with_nulls_clashes_and_repeats(spark):
    texts = [None, "", "a a  a a\na a a", "x " * 5, "one two " * 4 + "one three", "one two " * 4 + "one three", "p q r s t u v " * 900]
    df = spark.createDataFrame([(t, "old", i % 3 if i else None, "c") for i, t in enumerate(texts)], "text string, runs string, c0 int, n string")
    out = periodic.collapse_runs(df)
    assert out.columns == ["text", "c0", "n", "n_words", "runs"]
    want = []
    for t in texts:
        w = (t or "").split()
        runs = _brute_force(w) if len(w) < 100 else [(0, 6300, 7)]
        want.append((_collapsed(w, runs), len(w), [tuple(r) for r in runs]))
    assert sorted((r["text"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in out.collect()) == sorted(want)
    assert periodic.collapse_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(df, times=1)


def _contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    numbers = {x: k for k, x in enumerate(dict.fromkeys(w))}
    v, runs = np.array([numbers[x] for x in w]), []
    for p in range(1, n // 4 + 1):
        same = np.concatenate([[0], (v[:-p] == v[p:]).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(same))
        for s, e in zip(turns[::2], turns[1::2], strict=True):
            if e - s + p >= max(6, 4 * p) and not any((v[s : e + p - q] == v[s + q : e + p]).all() for q in range(1, p)):
                runs.append((int(s), int(e - s + p), p))
    runs.sort()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(_collapsed(w, runs)))


def test_query_matches_brute_force_on_all_documents(spark):
    out = queries.op12_periodic_runs(spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {tuple(r) for r in out.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {_contract(*d) for d in docs} and len(got) == len(docs) and any(r[1] for r in got)


def test_query_of_awkward_rows(spark, tmp_path):
    rows = [(None, "a " * 9), (1, None), (2, ""), *((i, " ".join(f"w{k * k % 13}" for k in range(i % 70))) for i in range(3, 400))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()} == {_contract(*r) for r in rows}
