"""The routing engine: queries against DuckDB, and semantics on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from routeflow import queries as Q
from routeflow.functions import messages as M
from routeflow.operators import delivery, routing, stateful
from routeflow.plans import build, config
from routeflow.sources import readers, writers
from routeflow.streaming import runtime
from routeflow.streaming import stateful as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "conversations", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_matches_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    found = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


def _messages(spark, rows):
    return spark.createDataFrame([(f"{i:032x}", p.encode(), meta, us) for i, p, meta, us in rows], "message_id string, payload binary, metadata map<string,string>, arr_us long")


def test_ids(spark):
    texts = ["100", "0xAB", "550e8400-e29b-41d4-a716-446655440000", "no", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.id_from_text(F.col("t"))).collect()]
    assert got == [f"{0x100:032x}", f"{0xAB:032x}", "550e8400e29b41d4a716446655440000", None, None]
    df = spark.createDataFrame([(b"\x01" * 16, "5", 1, 2), (b"x", "5", 1, 2), (None, None, 1, 2)], "k binary, h string, p int, o long")
    assert [r[0] for r in df.select(M.kafka_id(*map(F.col, "khpo"))).collect()] == ["01" * 16, f"{5:032x}", f"{1 << 64 | 2:032x}"]


def test_weak_join_and_dedup(spark):
    rows = [("A", 0, 1, '{"val": 1}'), ("A", 5, 2, "plain"), ("A", 100, 3, "3"), ("B", 0, 4, "4")]
    df = spark.createDataFrame(rows, "k string, us long, id long, p string")
    got = stateful.weak_join(df, "k", "us", "id", "p", 3, 50).orderBy("k", "grp").collect()
    assert [(r["k"], r["size"], r["payload"], r["complete"]) for r in got] == [("A", 2, '[{"val":1},"plain"]', False), ("A", 1, "[3]", False), ("B", 1, "[4]", False)]
    assert stateful.weak_join(df, "k", "us", "id", "p", 2, None, "drop").count() == 1
    times = spark.createDataFrame([("x", s * 1_000_000, i) for i, s in enumerate((0, 30, 59, 60, 119, 121))], "k string, us long, id long")
    assert sorted(r["id"] for r in stateful.dedup_ttl(times, ["k"], "us", "id", 60).collect()) == [0, 3, 5]
    assert stateful.dedup_ttl(times, ["k"], "us", "id", 0).count() == 6


def test_dispatch_of_many_cases(spark):
    cases = {str(i): f"r{i}" for i in range(80)}
    df = spark.createDataFrame([("3",), ("79",), ("x",), (None,)], "k string")
    assert [r["route"] for r in df.withColumn("route", routing.route_of(F.col("k"), cases, "d")).collect()] == ["r3", "r79", "d", "d"]


YAML = """
orders:
  input: {memory: {topic: in}, middlewares: [{deduplication: {ttl_seconds: 60}}]}
  output:
    switch: {metadata_key: route_key, cases: {A: {memory: {topic: a}}, B: {fanout: [{memory: {topic: b}}, {file: out.jsonl}]}}, default: {memory: {topic: rest}}}
    middlewares: [{retry: {max_attempts: 3}}, {dlq: {endpoint: {memory: {topic: dead}}}}]
"""


def test_config_and_plan(spark, tmp_path):
    r = config.load(YAML, {"MQB__ORDERS__INPUT__MEMORY__TOPIC": "other"})["orders"]
    assert r.input.options["topic"] == "other" and r.batch_size == 1 and config.validate(r) == []
    df = _messages(spark, [(1, "a", {"route_key": "A"}, 0), (1, "again", {"route_key": "A"}, 5), (2, "b", {"route_key": "B"}, 0), (3, "c", {}, 0), (7, "bad", {}, 0)])
    r = r.with_handler(lambda d: d.withColumn("status", F.when(F.col("message_id").endswith("7"), M.NONRETRYABLE).otherwise(M.ACK)))
    planned = build.plan(df, r)
    assert sorted((int(x["message_id"], 16), x["sink"]) for x in planned.collect()) == [(1, "memory:a"), (2, "file:out.jsonl"), (2, "memory:b"), (3, "memory:rest"), (7, "memory:dead")]
    build.write(planned, f"{tmp_path}/sinks")
    assert spark.read.parquet(f"{tmp_path}/sinks").where("sink = 'memory:b'").count() == 1
    assert config.endpoint(None).kind == "null" and config.endpoint({"mine": {"x": 1}}).options["name"] == "mine"
    assert config.endpoint({"file": "p", "middlewares": {"10": "metrics", "9": "retry"}}).middlewares[0][0] == "retry"
    for bad in ({"memory": {}, "kafka": {}}, {"file": "p", "middlewares": [{"random_panic": {"probability": 2}}]}):
        with pytest.raises(ValueError):
            config.endpoint(bad)
    with pytest.raises(ValueError):
        config.validate(config.Route(config.Endpoint("memory"), config.Endpoint("memory").add_middleware("weak_join")))
    with pytest.raises(ValueError):
        config.validate(config.Route(config.Endpoint("kafka")), {"nats"})


def test_lines_and_rows(spark, tmp_path):
    df = spark.createDataFrame([M.msg({"hello": "world"}, "k", a="b"), M.msg("raw")], M.MESSAGE)
    writers.to_lines(df, f"{tmp_path}/out")
    back = readers.lines(spark, f"{tmp_path}/out")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    rows = writers.to_kafka_rows(df).selectExpr("*", "0 as partition", "5L as offset")
    assert {r["message_id"] for r in readers.from_kafka(rows).collect()} == {r["message_id"] for r in df.collect()}
    assert readers.kafka_options({"url": "h:1", "topic": "t"})["startingOffsets"] == "latest"
    assert bytes(writers.static_reply(df, "x").first()["payload"]) == b'"x"'
    assert readers.static(spark, "p", 3).count() == 3
    frames = spark.createDataFrame([('["a","b"]',), ("plain",)], "value string")
    assert readers.decode_frame(frames).count() == 3


def test_streams_mean_what_batches_mean(spark, tmp_path):
    rows = [("x", (s + 1000) * 1_000_000, i, f"p{i}") for i, s in enumerate((0, 30, 59, 60, 119, 121, 300))]
    df = spark.createDataFrame(rows, "k string, us long, id long, p string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    seen = []
    q = runtime.deploy("dedup", streaming.dedup_ttl(stream, "k", "us", "id", 60), lambda b, _: seen.extend(r["id"] for r in b.collect()), f"{tmp_path}/c1", once=True)
    q.awaitTermination()
    assert sorted(seen) == sorted(r["id"] for r in stateful.dedup_ttl(df, ["k"], "us", "id", 60).collect())
    joined = []
    runtime.deploy("join", streaming.weak_join(stream, "k", "us", "id", "p", 3, 100_000_000), lambda b, _: joined.extend(b.collect()), f"{tmp_path}/c2", once=True).awaitTermination()
    assert [r["payloads"] for r in joined] == [["p0", "p1", "p2"], ["p3", "p4", "p5"]]
    assert runtime.routes(spark) == [] and not runtime.stop(spark, "join")


def test_tail_reads_appended_lines(spark, tmp_path):
    path, got = tmp_path / "log", []
    path.write_text("one\ntwo\npart")
    spark.dataSource.register(readers.TailSource)
    run = lambda: runtime.deploy("tail", spark.readStream.format("tail").option("path", str(path)).load(), lambda b, _: got.extend(r["value"] for r in b.collect()), f"{tmp_path}/c", once=True).awaitTermination()
    run()
    assert got == ["one", "two"]
    with path.open("a") as f:
        f.write("ial\n")
    run()
    assert got == ["one", "two", "partial"]


def test_retry_and_claims(spark):
    df = spark.createDataFrame([(0,), (2,), (9,)], "f int")
    got = df.select(*delivery.retried(F.col("f"), F.lit(True), 3)).collect()
    assert [tuple(r) for r in got] == [(1, "ack"), (3, "ack"), (3, "retryable")]
    assert df.select(delivery.retry_delays(F.col("f"), 8, 100, 1000, 3.0)).collect()[2][0] == [100, 300, 900, 1000, 1000, 1000, 1000]
