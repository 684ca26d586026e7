"""The Merkle manifest: traversal against whole trees, and the manifest against a tree built row by row."""

from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from routeflow.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _path(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        i //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 73, 300, 511, 512])
def test_traversal_of_a_block(n):
    leaves = [_h(str(i)) for i in range(n)]
    levels = _levels(leaves)
    height = merkle.height_of(0, n, 3)
    assert height == len(levels) - 1 and merkle.top(leaves, height) == levels[-1][0]
    assert list(merkle.paths(leaves, height)) == [_path(levels, i) for i in range(n)]


def test_traversal_holds_few_nodes():
    stack = merkle.Treehash(3)
    for i in range(8**4 - 1):
        stack.add(_h(str(i)), False)
        assert max(map(len, stack.open)) <= 8 and sum(map(len, stack.open)) <= 4 * 8
        if i % 512 == 511:
            assert len(stack.open[3]) == i // 512 + 1


def test_a_last_block_is_lifted_as_far_as_its_neighbours():
    assert [merkle.height_of(b, n, 2) for b, n in ((0, 1), (0, 2), (0, 9), (0, 64), (1, 1), (5, 9))] == [0, 1, 2, 2, 2, 2]


def _brute_force(rows):
    """rows: (group, order, carried, leaf) -> {carried: (leaf, path, subroot, root)}"""
    groups = {}
    for g, o, c, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[3])):
        groups.setdefault(g, []).append((c, leaf))
    trees = [_levels([leaf for _, leaf in x]) for x in groups.values()]
    upper = _levels([t[-1][0] for t in trees])
    return {c: (leaf, _path(tree, i) + _path(upper, k), tree[-1][0], upper[-1][0]) for k, (x, tree) in enumerate(zip(groups.values(), trees, strict=True)) for i, (c, leaf) in enumerate(x)}


@pytest.mark.parametrize("levels", [2, 4])
def test_manifest_matches_brute_force(spark, levels):
    rows = [("hot", i // 2 if i % 50 else None, i) for i in range(700)] + [(None, 1, 1000), (None, None, 1001), ("", 3, 1002)] + [(f"g{i}", i, 2000 + i) for i in range(12)] + [("é", 1, 3000)]
    df = spark.createDataFrame(rows, "path string, root int, c long").withColumn("leaf", F.sha2(F.col("c").cast("string"), 256)).repartition(5)
    want = _brute_force([(g, o, c, _h(str(c))) for g, o, c in rows])
    got = {r["c"]: (r["leaf"], [tuple(s) for s in r["path"]], r["subroot"], r["root"]) for r in merkle.manifest(df, "path", "root", "leaf", ["c"], levels).collect()}
    assert got == want
    out = merkle.manifest(df, "path", "root", "leaf", ["c"], levels)
    assert out.columns == ["c", "leaf", "path", "subroot", "root"]
    assert out.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    changed = F.sha2(F.concat("leaf", F.lit("x")), 256)
    assert out.where(merkle.folded(changed, F.col("path")) == F.col("root")).isEmpty()


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, "x")] * 20, "g string, o int, t string").withColumn("d", merkle.leaf(F.col("g"), F.lit(None), F.col("t")))
    out = merkle.manifest(df, "g", "o", "d")
    assert out.count() == 20 and out.first()["leaf"] == _h("1:a-1:x") and out.columns == ["leaf", "path", "subroot", "root"]
    assert out.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert merkle.manifest(df.where("false"), "g", "o", "d").count() == 0
    long = spark.createDataFrame([("é" * 300_000,), ("",), (None,)], "t string").select(merkle.leaf(F.col("t")).alias("d"))
    assert [r["d"] for r in long.collect()] == [_h(f"600000:{'é' * 300_000}"), _h("0:"), _h("-")]
    one = spark.createDataFrame([("a", 1, "ab" * 32)], "g string, o int, d string")
    assert [tuple(r) for r in merkle.manifest(one, "g", "o", "d").select("leaf", "subroot", "root", F.size("path")).collect()] == [("ab" * 32, "ab" * 32, "ab" * 32, 0)]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.OP13_SQL)
    columns = [d[0] for d in found.description]
    out = queries.op13_merkle_manifest(spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in out.select(*columns).collect()) == sorted(map(str, found.fetchall()))
    assert out.where("not verified").count() > 0
