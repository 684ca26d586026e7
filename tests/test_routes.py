"""Numbering without hot tasks, sending with retries, topics, and configured routes from source to sinks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.operators import delivery, sending
from routeflow.operators.numbering import numbered, running_sum
from routeflow.plans import build, config, run
from routeflow.sources import topics


def test_numbering_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, ""]), rng.randrange(50), i, rng.choice([1, 2, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long").repartition(7)
    place, total, seen = {}, {}, defaultdict(lambda: [0, 0])
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k][0] += 1
        seen[k][1] += v or 0
        place[i], total[i] = seen[k]
    assert {r["i"]: r["pos"] for r in numbered(df, ["k"], ["t", "i"]).collect()} == place
    assert {r["i"]: r["s"] for r in running_sum(df, ["k"], ["t", "i"], "v", "s").collect()} == total
    assert sorted(r["pos"] for r in numbered(df, [], ["i"]).collect()) == list(range(1, 3001))
    assert numbered(df.where("false"), ["k"], ["i"]).count() == 0
    assert delivery.allocate(df.select((F.col("i") % 7).alias("batch")), "batch", 10).agg(F.max("last")).first()[0] == 3010


def _messages(spark, n):
    return spark.createDataFrame([(f"{i:032x}", f"p{i}".encode(), {"route_key": "AB"[i % 2]}) for i in range(n)], M.MESSAGE)


def test_send_with_retry(spark):
    tries, pauses = [], []

    def send(df):
        tries.append(sorted(int(r["message_id"], 16) for r in df.select("message_id").collect()))
        n = F.conv(F.substring("message_id", 17, 16), 16, 10).cast("int")
        status = F.when(n == 0, M.NONRETRYABLE).when((n == 1) & F.lit(len(tries) < 3), M.RETRYABLE).when(n == 2, M.RETRYABLE).otherwise(M.ACK)
        return df.select("message_id", status.alias("status"), F.lit(None).cast("string").alias("error"))

    messages = _messages(spark, 4)
    out = sending.send_with_retry(messages, send, 3, 100, 150, 2.0, pauses.append)
    assert tries == [[0, 1, 2, 3], [1, 2], [1, 2]] and pauses == [0.1, 0.15]
    assert {int(r["message_id"], 16): (r["status"], r["attempts"]) for r in out.collect()} == {0: (M.NONRETRYABLE, 1), 1: (M.ACK, 3), 2: (M.RETRYABLE, 3), 3: (M.ACK, 1)}
    assert {int(r["message_id"], 16) for r in sending.dead_letters(messages, out).collect()} == {0, 2}
    assert sending.paired_replies(messages, messages.limit(1)).where("reply is null").count() == 3
    seen, counts = sending.observed(messages, "r", F.col("message_id").endswith("1"))
    seen.count()
    assert counts.get == {"processed": 1, "failed": 3}


def test_topics(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert topics.queued(spark, root, "q").count() == 0
    topics.publish(_messages(spark, 3), root, "log", "log")
    topics.publish(_messages(spark, 2), root, "log")  # follows the topic's mode
    assert sorted(r["offset"] for r in topics.read_log(spark, root, "log").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["offset"] for r in topics.read_log(spark, root, "log", 1, 2).collect()) == [2, 3]
    with pytest.raises(ValueError):
        topics.queued(spark, root, "log")
    topics.publish(_messages(spark, 2), root, "q")
    with pytest.raises(ValueError):
        topics.publish(_messages(spark, 2), root, "q", "log")
    assert topics.queued(spark, root, "q").count() == 2


def test_route_from_source_to_sinks(spark, tmp_path):
    root = f"file://{tmp_path}/topics"
    topics.publish(_messages(spark, 6), root, "in")
    text = f"""
r:
  input: {{memory: {{topic: in}}, middlewares: [{{deduplication: {{ttl_seconds: 60}}}}]}}
  output:
    switch: {{metadata_key: route_key, cases: {{A: {{fanout: [{{memory: {{topic: a}}}}, {{file: "{tmp_path}/a"}}]}}}}, default: {{response: {{}}}}}}
    middlewares: [{{dlq: {{endpoint: {{memory: {{topic: dead}}}}}}}}]
"""
    r = config.load(text, {})["r"].with_handler(lambda d: d.withColumn("status", F.when(F.col("message_id").endswith("4"), M.NONRETRYABLE).otherwise(M.ACK)))
    answers = run.run(spark, "r", r, root)
    got = lambda df: sorted(int(x["message_id"], 16) for x in df.collect())
    assert got(answers["response"]) == [1, 3, 5]
    assert got(topics.queued(spark, root, "a")) == [0, 2] and got(topics.queued(spark, root, "dead")) == [4]
    assert spark.read.text(f"{tmp_path}/a").count() == 2
    config.SOURCES["mine"], config.SINKS["own"] = lambda s, _: _messages(s, 2), lambda d, _: d
    custom = config.load("c: {input: {mine: {}}, output: {own: {}}}", {})["c"]
    assert got(run.run(spark, "c", custom, root)["custom:own"]) == [0, 1]
    with pytest.raises(ValueError):
        run.read(spark, config.endpoint({"nats": {"subject": "s"}}), "r")
    static = config.load("s: {input: {static: hello}, output: {static: bye}}", {})["s"]
    assert bytes(run.run(spark, "s", static, root)["static:bye"].first()["payload"]) == b'"bye"'


def test_output_middleware_acts(spark):
    config.CUSTOM_MIDDLEWARE["stamp"] = lambda d, o: d.withColumn("payload", F.encode(F.lit(o["text"]), "UTF-8"))
    df = _messages(spark, 2).withColumn("arr_us", F.lit(5).cast("long"))
    r = config.load('o: {input: {static: x}, output: {response: {}, middlewares: [{delay: {delay_ms: 2}}, {stamp: {text: hi}}]}}', {})["o"]
    out = build.plan(df, r).collect()
    assert [(bytes(x["payload"]), x["arr_us"]) for x in out] == [(b"hi", 2005)] * 2
    r = config.load("o: {input: {static: x}, output: {response: {}, middlewares: [{random_panic: {probability: 1}}]}}", {})["o"]
    with pytest.raises(Exception, match="injected fault"):
        build.plan(df, r).collect()
    r = config.load("o: {input: {static: x}, output: {response: {}, middlewares: [{unheard_of: {}}]}}", {})["o"]
    with pytest.raises(ValueError):
        build.plan(df, r)
