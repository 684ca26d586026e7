"""Streams of topics and line files, routes deployed as streams, and state that means the same in a batch and after a restart."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.operators import stateful
from routeflow.plans import config, run
from routeflow.sources import streams, topics
from routeflow.streaming import routes, runtime
from routeflow.streaming import stateful as streaming


def _messages(spark, numbers, meta=lambda i: {}):
    return spark.createDataFrame([(f"{i:032x}", f"p{i}".encode(), meta(i), i) for i in numbers], "message_id string, payload binary, metadata map<string,string>, came long")


def _payloads(df, column="offset"):
    return [r["payload"].decode() for r in df.orderBy(column).collect()]


def _wait(condition, seconds=20):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "it didn't happen in time"
        time.sleep(0.1)


class _Run:
    """Runs a source once and gathers its batches; ``fails`` batches raise first."""

    def __init__(self, spark, kind, checkpoint, **options):
        streams.register(spark)
        self.spark, self.kind, self.checkpoint, self.options, self.batches, self.fails = spark, kind, checkpoint, options, [], 0

    def __call__(self):
        def batch(df, _):
            rows = df.collect()
            if self.fails:
                self.fails -= 1
                raise ValueError("handler failed")
            self.batches.append(rows)

        stream = self.spark.readStream.format(self.kind).options(**self.options).load()
        runtime.deploy("once", stream, batch, self.checkpoint, once=True).awaitTermination()
        return self.batches[-1] if self.batches else []


def test_acknowledged_lines_are_cut_off(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("one\ntwo\n\nfour, é\npart")
    go = _Run(spark, "lines", f"{tmp_path}/c", path=str(path), split=5)
    go.fails = 1
    with pytest.raises(Exception, match="handler failed"):
        go()
    assert path.read_text() == "one\ntwo\n\nfour, é\npart"  # a failed batch leaves its lines
    assert sorted(r["value"] for r in go()) == ["", "four, é", "one", "two"]
    with path.open("a") as f:
        f.write("ial\nlast\n")
    assert [(r["value"], r["position"]) for r in sorted(go(), key=lambda r: r["position"])] == [("partial", 18), ("last", 26)]
    assert path.read_text() == "partial\nlast\n"
    file = streams.LineFile(str(path))
    assert (file.cut(), file.size()) == (18, 31)
    file.cut_to(26)
    file.cut_to(20)  # nothing to do
    assert path.read_text() == "last\n"


@pytest.mark.parametrize("moved", [True, False])
def test_a_cut_that_was_broken_off(tmp_path, monkeypatch, moved):
    path = tmp_path / "f"
    path.write_text("aa\nbb\ncc\n")
    file, replace = streams.LineFile(str(path)), streams.os.replace

    def crash(a, b):
        if moved:
            replace(a, b)
        raise OSError("power is gone")

    with monkeypatch.context() as patch:
        patch.setattr(streams.os, "replace", crash)
        with pytest.raises(OSError, match="power"):
            file.cut_to(3)
    again = streams.LineFile(str(path))
    assert again.cut() == (3 if moved else 0) and list(again.lines(3, 9, 9)) == [(3, b"bb"), (6, b"cc")]
    again.cut_to(6)
    assert path.read_text() == "cc\n"


def test_lines_in_splits_of_any_size(tmp_path):
    rng, path = random.Random(2), tmp_path / "f"
    lines = [b"x" * rng.randrange(9) for _ in range(200)]
    path.write_bytes(b"".join(x + b"\n" for x in lines) + b"tail")
    end = path.stat().st_size - 4
    for split in (1, 2, 7, 64, 10_000):
        reader = streams.LineReader(str(path), None, split, True)
        assert reader.initialOffset() == {"position": 0} and reader.latestOffset() == {"position": end}
        got = [t for p in reader.partitions({"position": 0}, {"position": end}) for t in reader.read(p)]
        assert [v.encode() for v, _ in got] == lines
    other = tmp_path / "other"
    other.write_bytes(path.read_bytes())
    ends = [sum(len(x) + 1 for x in lines[:k]) for k in (3, 6)]
    for end in ends:  # each by a reader that starts anew
        limited = streams.LineReader(str(other), 3, 64, True)
        assert limited.latestOffset() == {"position": end}
        limited.partitions({"position": 0}, {"position": end})


def test_queue_as_a_stream(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    go = _Run(spark, "topic", f"{tmp_path}/c", root=root, topic="q")
    topics.publish(_messages(spark, range(5)), root, "q", order="came")
    topics.publish(_messages(spark, range(5, 8)), root, "q", order="came")
    assert [r["payload"].decode() for r in sorted(go(), key=lambda r: r["offset"])] == [f"p{i}" for i in range(8)]
    topics.publish(_messages(spark, [9]), root, "q", order="came")
    go.fails = 1
    with pytest.raises(Exception, match="handler failed"):
        go()
    assert topics.window(root, "q") == (9, 9)  # what was committed is gone, what failed is there
    assert [r["payload"].decode() for r in go()] == ["p9"]
    reader = streams.TopicReader(root, "q", None, 2, True)
    assert reader.initialOffset() == {"offset": 9} and reader.latestOffset() == {"offset": 10}


def test_log_as_a_stream_and_its_gaps(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    topics.publish(_messages(spark, range(6)), root, "log", "log", "came")
    go = _Run(spark, "topic", f"{tmp_path}/c", root=root, topic="log", subscriber="s")
    assert len(go()) == 6
    assert topics.manifest(root, "log").state()["subscribers"]["s"]["ack"] == 0
    topics.publish(_messages(spark, range(6, 9)), root, "log", "log", "came")
    assert sorted(r["offset"] for r in go()) == [7, 8, 9]
    assert topics.manifest(root, "log").state()["subscribers"]["s"]["ack"] == 6
    assert topics.collect_garbage(spark, root, "log") == 6
    slow = streams.TopicReader(root, "log", "s", None, True)
    with pytest.raises(topics.Gap):
        topics.manifest(root, "log").update(lambda s: s | {"subscribers": {"s": {"ack": 2, "seen": 0}}})
        slow.partitions({"offset": 3}, {"offset": 9})
    with pytest.raises(ValueError, match="is a log"):
        streams.TopicReader(root, "log", None, None, True).initialOffset()


def test_limits_bound_what_a_batch_reads(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    topics.publish(_messages(spark, range(10)), root, "in", order="came")
    r = config.load("r: {input: {memory: {topic: in}}, output: {memory: {topic: out}}, batch_size: 2, concurrency: 2}", {})["r"]
    query = routes.deploy(spark, "limited", r, root)
    try:
        _wait(lambda: topics.window(root, "out")[1] == 10 and topics.window(root, "in")[0] == 11, 60)
        assert [s["rows"] for s in topics.manifest(root, "out").state()["segments"]] == [4, 4, 2]
        assert routes.get("limited") == r and "limited" in routes.names() and "limited" in runtime.routes(spark)
        _wait(lambda: routes.metrics("limited")["processed"] == 10)
        m = routes.metrics("limited")
        assert m["batches"] >= 3 and 0 < m["duration_50"] <= m["duration_99"]
    finally:
        assert routes.stop(spark, "limited") and not routes.stop(spark, "limited")
    assert routes.get("limited") is None and not query.isActive


def test_a_deployed_route_that_fails_is_supervised(spark, tmp_path):
    root, failures = f"file://{tmp_path}/t", [2]
    topics.publish(_messages(spark, range(4), lambda i: {"k": str(i % 2)}), root, "in", order="came")

    def sink(rows, _):
        rows.count()
        if failures[0]:
            failures[0] -= 1
            raise ValueError("broker is down")

    config.SINKS["flaky"] = sink
    text = "r: {input: {memory: {topic: in}}, output: {fanout: [{memory: {topic: a}}, {switch: {metadata_key: k, cases: {'1': {flaky: {}}}}}]}}"
    r = config.load(text, {})["r"]
    pauses = []
    sleep, runtime.time.sleep = runtime.time.sleep, lambda s: pauses.append(s) if s == 0.25 else sleep(s)
    try:
        runtime.supervise(lambda: routes.deploy(spark, "r", r, root, once=True), pause_s=0.25)
    finally:
        runtime.time.sleep = sleep
    assert pauses == [0.25, 0.25] and _payloads(topics.queued(spark, root, "a")) == [f"p{i}" for i in range(4)]
    _wait(lambda: topics.queued(spark, root, "in").count() == 0)
    topics.publish(_messages(spark, [7]), root, "in", order="came")
    routes.deploy(spark, "r", r, root, once=True).awaitTermination()
    assert _payloads(topics.queued(spark, root, "a"))[4:] == ["p7"]
    with pytest.raises(Exception, match="broker is down"):
        failures[0] = 9
        topics.publish(_messages(spark, [9], lambda i: {"k": "1"}), root, "in", order="came")
        runtime.supervise(lambda: routes.deploy(spark, "r", r, root, once=True), tries=2, pause_s=0.01)


def test_a_batch_that_spark_runs_again_is_written_once(spark, tmp_path, monkeypatch):
    root, finish = f"file://{tmp_path}/t", run.Ledger.finish
    topics.publish(_messages(spark, range(3)), root, "in", order="came")
    r = config.load("r: {input: {memory: {topic: in}}, output: {memory: {topic: out}}}", {})["r"]
    calls = []

    def crash(self):
        finish(self)
        calls.append(1)
        if len(calls) == 3:  # deploy, before the batch, after its commit
            raise OSError("driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(run.Ledger, "finish", crash)
        with pytest.raises(Exception, match="driver is gone"):
            routes.deploy(spark, "r", r, root, once=True).awaitTermination()
    assert topics.queued(spark, root, "out").count() == 3
    routes.deploy(spark, "r", r, root, once=True).awaitTermination()
    assert topics.queued(spark, root, "out").count() == 3
    _wait(lambda: topics.queued(spark, root, "in").count() == 0)


def test_a_file_route_consumes_its_lines(spark, tmp_path):
    root, path = f"file://{tmp_path}/t", tmp_path / "in.jsonl"
    path.write_text("".join(f"line {i}\n" for i in range(5)))
    r = config.load(f"r: {{input: {{file: '{path}'}}, output: {{memory: {{topic: out, subscribe_mode: true}}}}}}", {})["r"]
    routes.deploy(spark, "r", r, root, once=True).awaitTermination()
    assert _payloads(topics.read_log(spark, root, "out")) == [f"line {i}" for i in range(5)]
    _wait(lambda: path.read_text() == "")



@pytest.mark.parametrize("kind", ["file", "topic"])
def test_a_run_that_ends_handles_all_that_is_there(spark, tmp_path, kind):
    root, path = f"file://{tmp_path}/t", tmp_path / "in.jsonl"
    path.write_text("".join(f"p{i}\n" for i in range(7)))
    topics.publish(_messages(spark, range(7)), root, "in", order="came")
    source = f"{{file: '{path}'}}" if kind == "file" else "{memory: {topic: in}}"
    r = config.load(f"r: {{input: {source}, output: {{memory: {{topic: out}}}}, batch_size: 2}}", {})["r"]
    routes.deploy(spark, "all", r, root, once=True).awaitTermination()
    assert _payloads(topics.queued(spark, root, "out")) == [f"p{i}" for i in range(7)]
    _wait(lambda: not path.read_text() if kind == "file" else topics.window(root, "in")[0] == 8)
    if kind == "file":
        path.write_text("p7\np8\np9\n")
    else:
        topics.publish(_messages(spark, range(7, 10)), root, "in", order="came")
    query = routes.deploy(spark, "all", r, root)  # goes on with bounded micro-batches
    try:
        _wait(lambda: topics.window(root, "out")[1] == 10, 60)
        assert [s["rows"] for s in topics.manifest(root, "out").state()["segments"]] == [7, 2, 1] and query.isActive
    finally:
        routes.stop(spark, "all")
    assert _payloads(topics.queued(spark, root, "out")) == [f"p{i}" for i in range(10)]


def test_batch_routes_consume_lines_too(spark, tmp_path):
    root, path = f"file://{tmp_path}/t", tmp_path / "in.txt"
    path.write_text("a\nb\nc\nhalf")
    text = f"r: {{input: {{file: '{path}'}}, output: {{fanout: [{{memory: {{topic: out}}}}, {{broken: {{}}}}]}}}}"
    r, down = config.load(text, {})["r"], [True]

    def sink(rows, _):
        if down[0]:
            raise ValueError("down")

    config.SINKS["broken"] = sink
    with pytest.raises(ValueError, match="down"):
        run.run(spark, "r", r, root)
    assert path.read_text() == "a\nb\nc\nhalf" and topics.queued(spark, root, "out").count() == 0
    down[0] = False
    run.run(spark, "r", r, root, limit=2)
    assert path.read_text() == "c\nhalf" and _payloads(topics.queued(spark, root, "out")) == ["a", "b"]
    with path.open("a") as f:
        f.write(" full\n")
    run.run(spark, "r", r, root)
    assert path.read_text() == "" and _payloads(topics.queued(spark, root, "out")) == ["a", "b", "c", "half full"]
    run.run(spark, "r", r, root)
    file = streams.LineFile(str(path))
    path.write_text("x\ny\n")
    file.take(file.cut(), file.cut() + 2, "mine")
    file.take(file.cut() - 2, file.cut(), "mine")  # once more
    with pytest.raises(topics.Taken):
        file.take(file.cut() - 2, file.cut(), "other")
    assert path.read_text() == "y\n"
    kept = config.load(f"r: {{input: {{file: {{path: '{path}', subscribe_mode: true}}}}, output: {{memory: {{topic: kept}}}}}}", {})["r"]
    run.run(spark, "k", kept, root)
    assert path.read_text() == "y\n" and _payloads(topics.queued(spark, root, "kept")) == ["y"]


def test_stream_and_batch_agree_after_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows, at = [], 1_000
    for i in range(240):
        at += rng.choice([0, 1, 1, 3, 30]) + (i % 80 == 0)  # what is no later than the watermark would be late
        rows.append((rng.choice("aab"), at * 1_000_000, i, f"p{i}"))
    df = spark.createDataFrame(rows, "k string, us long, id long, p string")
    folder, seen, joined = f"{tmp_path}/in", [], []
    for a in range(0, 240, 80):  # a run each, all from one checkpoint
        spark.createDataFrame(rows[a : a + 80], df.schema).coalesce(1).write.mode("append").parquet(folder)
        stream = lambda: spark.readStream.schema(df.schema).parquet(folder)
        runtime.deploy("d", streaming.dedup_ttl(stream(), "k", "us", "id", 20), lambda b, _: seen.extend(r["id"] for r in b.collect()), f"{tmp_path}/c1", once=True).awaitTermination()
        runtime.deploy("w", streaming.weak_join(stream(), "k", "us", "id", "p", 4, 25_000_000), lambda b, _: joined.extend((r["k"], r["payloads"]) for r in b.collect()), f"{tmp_path}/c2", once=True).awaitTermination()
    assert sorted(seen) == sorted(r["id"] for r in stateful.dedup_ttl(df, ["k"], "us", "id", 20).collect())
    groups = stateful.weak_join_groups(df, "k", "us", "id", 4, 25_000_000).groupBy("k", "grp").agg(F.sort_array(F.collect_list(F.struct("us", "id", "p"))).alias("x"))
    want = {(r["k"], tuple(x["p"] for x in r["x"])) for r in groups.collect()}
    got = {(k, tuple(p)) for k, p in joined}
    assert got <= want and len(got) == len(joined) and len(want - got) <= 2  # each key's last group is open still



def _state_of(spark, out, checkpoint):
    """A run that ends: the rows it emits, and what its first batch did to the state."""
    rows = []
    query = runtime.deploy("state", out, lambda b, _: rows.extend(b.collect()), checkpoint, once=True)
    query.awaitTermination()
    return rows, query.recentProgress[0]["stateOperators"][0]


def test_groups_within_a_batch_stay_out_of_the_state(spark, tmp_path):
    df = spark.createDataFrame([("ab"[i % 2], (1 + i) * 1_000_000, i, f"p{i}") for i in range(202)], "k string, us long, id long, p string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    rows, state = _state_of(spark, streaming.weak_join(stream, "k", "us", "id", "p", 2, 10**12), f"{tmp_path}/c")
    assert sorted((r["k"], tuple(r["payloads"])) for r in rows) == sorted(("ab"[k], (f"p{i}", f"p{i + 2}")) for k in (0, 1) for i in range(k, 200, 4))
    assert (state["numRowsUpdated"], state["numRowsRemoved"]) == (4, 0)  # the two groups that are open in the end: a message, and a beginning



class _Calls:
    """A state variable and a handle that count what they are asked."""

    def __init__(self, value=None):
        self.value, self.calls = value, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append(at)

    def getExpiryTimeInMs(self):
        return 50_000


def test_a_key_of_a_deduplication_costs_few_calls_and_one_row_a_second():
    rng, state = random.Random(8), _Calls()
    dedup, of = streaming._Dedup("us", "id", 10), streaming.Row("us", "id", "x")
    dedup.init(state)
    at, held = [rng.randrange(40_000_000) for _ in range(3000)], []

    class Key(int):  # what is alive of the rows' ties
        def __new__(cls, i):
            held.append(1)
            return int.__new__(cls, i)

        def __del__(self):
            most[0] = max(most[0], len(held))
            held.pop()

    most, last, want = [0], None, []
    for us, i in sorted((us, i) for i, us in enumerate(at)):
        if last is None or us // 1_000_000 >= last + 10:
            last = us // 1_000_000
            want.append(i)
    got = list(dedup.handleInputRows(("k",), (of(us, Key(i), None) for i, us in enumerate(at)), None))
    assert [int(r["id"]) for r in got] == want and most[0] < 50
    assert state.calls == ["get", "update", (last + 10) * 1000] and state.value == (last,)
    assert list(dedup.handleInputRows(("k",), iter([of((last + 9) * 1_000_000, 0, None)]), None)) == [] and state.calls[3:] == ["get"]
    assert list(dedup.handleExpiredTimer(("k",), None, state)) == [] and state.calls[4:] == ["get", "clear"] and state.value is None


def test_deduplication_keeps_long_numbers_beside_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", 1_000_000, 1, None), ("b", 2_000_000, 2, 2**60 + 1), (None, 3_000_000, 3, 2**60 + 3), (None, 3_000_001, 4, 5)], "k string, us long, id long, big long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    rows, _ = _state_of(spark, streaming.dedup_ttl(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "us", "id", 60), f"{tmp_path}/c")
    assert {(r["k"], r["id"], r["big"]) for r in rows} == {("a", 1, None), ("b", 2, 2**60 + 1), (None, 3, 2**60 + 3)}


def test_replies_on_streams(spark, tmp_path):
    asks = spark.createDataFrame([("a", 1_000_000, "q1"), ("b", 2_000_000, "q2"), ("c", 90_000_000, "late")], "k string, asked long, q string")
    gives = spark.createDataFrame([("a", 3_000_000, "r1"), ("b", 40_000_000, "too late"), ("z", 95_000_000, "clock")], "k string, answered long, r string")
    asks.coalesce(1).write.parquet(f"{tmp_path}/asks")
    gives.coalesce(1).write.parquet(f"{tmp_path}/gives")
    out, read = [], lambda df, n: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{n}")
    joined = streaming.replies(read(asks, "asks"), read(gives, "gives"), "k", "asked", "answered", 10_000_000)
    runtime.deploy("replies", joined, lambda b, _: out.extend((r["q"], r["r"], r["timed_out"]) for r in b.collect()), f"{tmp_path}/c", once=True).awaitTermination()
    assert sorted(out) == [("q1", "r1", False), ("q2", None, True)]


def test_weak_join_of_a_deployed_route(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    topics.publish(_messages(spark, range(5), lambda i: {"g": "xy"[i == 2], "n": str(i)}), root, "in", order="came")
    r = config.load("r: {input: {memory: {topic: in}, middlewares: [{weak_join: {group_by: g, expected_count: 2, timeout_ms: 60000}}]}, output: {memory: {topic: out}}}", {})["r"]
    routes.deploy(spark, "w", r, root, once=True).awaitTermination()
    got = topics.queued(spark, root, "out").orderBy("offset").collect()
    assert [(x["payload"].decode(), x["metadata"]) for x in got] == [('["p0","p1"]', {"g": "x", "n": "0"}), ('["p3","p4"]', {"g": "x", "n": "3"})]
    both = config.load("r: {input: {memory: {topic: in}, middlewares: [{weak_join: {group_by: g, expected_count: 2, timeout_ms: 1}}, {deduplication: {ttl_seconds: 5}}]}, output: {memory: {topic: out}}}", {})["r"]
    with pytest.raises(ValueError, match="one of"):
        routes.deploy(spark, "w2", both, root)


def test_dedup_of_a_deployed_route(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    r = config.load("r: {input: {memory: {topic: in}, middlewares: [{deduplication: {ttl_seconds: 3600}}]}, output: {memory: {topic: out}}}", {})["r"]
    for numbers in ([1, 2, 2], [2, 3], [1, 4]):
        topics.publish(_messages(spark, numbers), root, "in", order="came")
        routes.deploy(spark, "d", r, root, once=True).awaitTermination()
    assert sorted(_payloads(topics.queued(spark, root, "out"))) == ["p1", "p2", "p3", "p4"]


def test_publishing_while_a_route_runs(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    topics.publish(_messages(spark, [0]), root, "in", order="came")
    r = config.load("r: {input: {memory: {topic: in}}, output: {memory: {topic: out}}}", {})["r"]
    routes.deploy(spark, "busy", r, root)
    try:
        threads = [threading.Thread(target=lambda k=k: topics.publish(_messages(spark, range(10 * k, 10 * k + 5)), root, "in", order="came")) for k in range(1, 4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        _wait(lambda: topics.window(root, "out")[1] == 16, 60)
    finally:
        routes.stop(spark, "busy")
    assert sorted(_payloads(topics.queued(spark, root, "out"))) == sorted([f"p{i}" for i in (0, *range(10, 15), *range(20, 25), *range(30, 35))])
    assert isinstance(M.msg("x")[0], str)
