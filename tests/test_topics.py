"""Topics of segments, and routes that lose nothing: order, writers at one time, commits made again, sinks that are down."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.operators import delivery, event_log, stateful
from routeflow.plans import build, config, run
from routeflow.sources import manifest, topics


def _messages(spark, numbers, meta=lambda i: {}):
    """Ids fall while the numbers rise."""
    return spark.createDataFrame([(f"{9999 - i:032x}", f"p{i}".encode(), meta(i), i) for i in numbers], "message_id string, payload binary, metadata map<string,string>, came long")


def _read(df, column="offset"):
    return [(r[column], r["payload"].decode()) for r in df.orderBy(column).collect()]


def test_versions_are_made_once(tmp_path):
    m = manifest.Manifest(str(tmp_path / "a/b"))
    assert m.read() == (0, {}) and m.update(lambda s: None) == {}
    threads = [threading.Thread(target=lambda: [m.update(lambda s: {"n": s.get("n", 0) + 1}) for _ in range(25)]) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert m.read() == (150, {"n": 150}) and not [f for f in (tmp_path / "a/b").iterdir() if f.name.endswith(".tmp")]
    assert not manifest.put_once(m.store, m._file(150), b"{}")
    with pytest.raises(ZeroDivisionError):
        m.update(lambda s: 1 / 0)
    assert m.read()[0] == 150


def test_a_stale_writer_never_wins(tmp_path):
    m, kept = manifest.Manifest(str(tmp_path)), manifest.KEPT
    try:
        manifest.KEPT = 5
        for i in range(30):
            m.update(lambda s, i=i: {"i": i})
        assert m.versions()[-1] == 30 and len(m.versions()) <= 6 and m.state() == {"i": 29}
    finally:
        manifest.KEPT = kept


def test_publishers_at_one_time_share_no_offset(spark, tmp_path):
    root = f"file://{tmp_path}"
    threads = [threading.Thread(target=lambda k=k: topics.publish(_messages(spark, range(10 * k, 10 * k + 10)), root, "log", "log", "came")) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = _read(topics.read_log(spark, root, "log"))
    assert [o for o, _ in got] == list(range(1, 51))
    blocks = [[int(p[1:]) for _, p in got[a : a + 10]] for a in range(0, 50, 10)]
    assert sorted(b[0] for b in blocks) == [0, 10, 20, 30, 40] and all(b == list(range(b[0], b[0] + 10)) for b in blocks)


def test_queue_in_parts_with_rejected_messages(spark, tmp_path):
    root = f"file://{tmp_path}"
    topics.publish(_messages(spark, range(7)), root, "q", order="came")
    topics.publish(_messages(spark, range(7, 12)), root, "q", order="came")
    rows, done = topics.drained(spark, root, "q", 9)
    again, late = topics.drained(spark, root, "q", 2)
    topics.publish(_messages(spark, [50]), root, "q", order="came")
    assert [p for _, p in _read(rows)] == [f"p{i}" for i in range(9)]
    done(rows.where("offset in (8, 2, 5)"))
    assert _read(topics.queued(spark, root, "q")) == [(10, "p9"), (11, "p10"), (12, "p11"), (13, "p50"), (14, "p1"), (15, "p4"), (16, "p7")]
    with pytest.raises(topics.Taken):
        late()
    assert topics.queued(spark, root, "q").count() == 7 and len(list((tmp_path / "q/segments").iterdir())) == 3
    everything, done = topics.drained(spark, root, "q")
    assert everything.count() == 7
    done()
    assert topics.queued(spark, root, "q").count() == 0 and topics.window(root, "q") == (17, 16)
    topics.drained(spark, root, "q")[1]()  # nothing to take
    topics.publish(_messages(spark, []), root, "q")
    topics.publish(_messages(spark, [3]), root, "q")
    assert _read(topics.queued(spark, root, "q")) == [(17, "p3")]


def test_commits_can_be_made_again(spark, tmp_path):
    root = f"file://{tmp_path}"
    segment = topics.stage(_messages(spark, range(4)), root, "q", ["came"])
    assert topics.queued(spark, root, "q").count() == 0
    for _ in range(3):
        topics.attach(root, "q", segment)
    assert topics.queued(spark, root, "q").count() == 4
    for _ in range(3):
        topics.taken(root, "q", 1, 3, "mine")
    assert _read(topics.queued(spark, root, "q")) == [(4, "p3")]
    topics.attach(root, "q", segment)
    assert topics.window(root, "q") == (4, 4)
    with pytest.raises(ValueError, match="is a queue"):
        topics.publish(_messages(spark, [1]), root, "q", "log")


def test_log_retention(spark, tmp_path):
    root, told = f"file://{tmp_path}", []
    collect = lambda **o: topics.collect_garbage(spark, root, "log", on_drop=told.append, **o)
    assert collect() == 0
    for a in (0, 10, 20):
        topics.publish(_messages(spark, range(a, a + 10)), root, "log", "log", "came")
    assert collect() == 0  # nobody subscribes
    topics.register(root, "log", "a", 1000)
    topics.register(root, "log", "b", 1000)
    topics.acknowledge(root, "log", "a", 25, 1000)
    topics.acknowledge(root, "log", "stranger", 30, 1000)
    assert collect(now_s=1001) == 0  # b has acknowledged nothing
    topics.acknowledge(root, "log", "b", 13, 1000)
    topics.acknowledge(root, "log", "b", 4, 1000)
    assert collect(now_s=1001, archive=f"{tmp_path}/archive") == 13 and told[-1].count() == 13
    assert [p.name for p in (tmp_path / "archive").iterdir()] == [f"log-{1:020d}-{13:020d}"]
    assert len(list((tmp_path / "log/segments").iterdir())) == 2
    assert _read(topics.read_log(spark, root, "log"))[0] == (14, "p13")
    with pytest.raises(topics.Gap):
        topics.read_log(spark, root, "log", 7)
    assert collect(now_s=1400) == 0  # both are silent, nothing is old
    topics.acknowledge(root, "log", "a", 25, 1400)
    assert collect(now_s=1500) == 12 and [p for _, p in _read(told[-1])] == [f"p{i}" for i in range(13, 25)]  # b is silent still
    assert collect(keep=3) == 2 and collect(keep=3) == 0
    stored = topics.manifest(root, "log").state()["segments"][-1]["stored_ms"] / 1000
    assert collect(now_s=stored + 100) == 0 and collect(now_s=stored + event_log.AGE_S + 1) == 3
    assert topics.read_log(spark, root, "log").count() == 0 and topics.manifest(root, "log").state()["base"] == 31


def test_acknowledgements_of_a_route_let_the_log_go(spark, tmp_path):
    root = f"file://{tmp_path}"
    topics.publish(_messages(spark, range(4)), root, "log", "log", "came")
    r = config.load(json.dumps({"r": {"input": {"memory": {"topic": "log", "subscribe_mode": True, "retention": {"archive": f"{tmp_path}/archive"}}}, "output": {"memory": {"topic": "out"}}}}), {})["r"]
    topics.register(root, "log", "other")
    run.run(spark, "r", r, root)
    assert topics.read_log(spark, root, "log").count() == 4  # the other one has acknowledged nothing
    topics.acknowledge(root, "log", "other", 2)
    topics.publish(_messages(spark, [4]), root, "log", "log", "came")
    run.run(spark, "r", r, root)
    assert _read(topics.read_log(spark, root, "log")) == [(3, "p2"), (4, "p3"), (5, "p4")]
    assert spark.read.parquet(f"{tmp_path}/archive/*").count() == 2 and len(_read(topics.queued(spark, root, "out"))) == 5


def test_subscribers_go_on_where_they_were(spark, tmp_path):
    root = f"file://{tmp_path}"
    topics.publish(_messages(spark, range(5)), root, "log", "log", "came")
    rows, last, ack = topics.subscribed(spark, root, "log", "s", 3)
    assert (rows.count(), last) == (3, 3)
    assert topics.subscribed(spark, root, "log", "s", 3)[0].count() == 3  # not acknowledged yet
    ack()
    rows, last, ack = topics.subscribed(spark, root, "log", "s", 3)
    assert _read(rows) == [(4, "p3"), (5, "p4")] and last == 5
    assert topics.subscribed(spark, root, "log", "other")[0].count() == 5


class _Server:
    """Counts posts by path; a path in ``down`` gets a 500."""

    def __init__(self, down=()):
        self.posts, self.down = [], set(down)
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                outer.posts.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode()))
                self.send_response(500 if self.path in outer.down else 204)
                self.end_headers()

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def of(self, path):
        return sorted(body for p, body in self.posts if p == path)


def test_two_sinks_of_one_kind_and_one_that_is_down(spark, tmp_path):
    root, web = f"file://{tmp_path}", _Server(["/two"])
    topics.publish(_messages(spark, range(5)), root, "in", order="came")
    r = config.load(json.dumps({"r": {"input": {"memory": {"topic": "in"}}, "output": {"fanout": [{"memory": {"topic": "kept"}}, {"http": {"url": f"{web.url}/one"}}, {"http": {"url": f"{web.url}/two"}}]}}}), {})["r"]
    for _ in range(2):
        with pytest.raises(run.Failed, match="5 messages could not be sent"):
            run.run(spark, "r", r, root)
        assert topics.queued(spark, root, "in").count() == 5 and topics.queued(spark, root, "kept").count() == 0
    assert web.of("/one") == [f"p{i}" for i in range(5)]  # not again with the second try
    web.down.clear()
    topics.publish(_messages(spark, [7]), root, "in", order="came")
    run.run(spark, "r", r, root)
    assert web.of("/one") == ["p0", "p1", "p2", "p3", "p4", "p7"] and len(web.of("/two")) == 16
    assert topics.queued(spark, root, "in").count() == 0 and _read(topics.queued(spark, root, "kept")) == [(i + 1, f"p{k}") for i, k in enumerate([0, 1, 2, 3, 4, 7])]
    run.run(spark, "r", r, root)
    topics.publish(_messages(spark, [0]), root, "in", order="came")  # the same message anew
    run.run(spark, "r", r, root)
    assert web.of("/one").count("p0") == 2


def test_dead_letters_into_a_tree(spark, tmp_path):
    root, web = f"file://{tmp_path}", _Server(["/down"])
    topics.publish(_messages(spark, range(4), lambda i: {"side": "ab"[i % 2]}), root, "in", order="came")
    dead = {"switch": {"metadata_key": "side", "cases": {"a": {"fanout": [{"memory": {"topic": "x"}}, {"memory": {"topic": "y"}}]}}, "default": {"memory": {"topic": "rest"}}}}
    out = {"http": {"url": f"{web.url}/down"}, "middlewares": [{"retry": {"max_attempts": 2, "initial_interval_ms": 1}}, {"dlq": {"endpoint": dead}}]}
    answers = run.run(spark, "r", config.load(json.dumps({"r": {"input": {"memory": {"topic": "in"}}, "output": out}}), {})["r"], root)
    assert [sorted(p for _, p in _read(topics.queued(spark, root, t))) for t in ("x", "y", "rest", "in")] == [["p0", "p2"], ["p0", "p2"], ["p1", "p3"], []]
    assert len(web.posts) == 8 and {x["attempts"] for df in answers.values() for x in df.collect()} == {2}


def test_dead_letters_for_a_sink_that_sends(spark, tmp_path):
    """A second server takes the dead letters of the first; while a third is down, nobody forgets them."""
    root, web = f"file://{tmp_path}", _Server(["/down", "/third"])
    topics.publish(_messages(spark, range(3)), root, "in", order="came")
    first = {"http": {"url": f"{web.url}/down"}, "middlewares": [{"dlq": {"endpoint": {"fanout": [{"http": {"url": f"{web.url}/dead"}}, {"memory": {"topic": "dead"}}]}}}]}
    r = config.load(json.dumps({"r": {"input": {"memory": {"topic": "in"}}, "output": {"fanout": [first, {"http": {"url": f"{web.url}/third"}}]}}}), {})["r"]
    with pytest.raises(run.Failed, match="third"):
        run.run(spark, "r", r, root)
    assert topics.queued(spark, root, "dead").count() == 0 and topics.queued(spark, root, "in").count() == 3
    web.down.discard("/third")
    run.run(spark, "r", r, root)
    assert [p for _, p in _read(topics.queued(spark, root, "dead"))] == ["p0", "p1", "p2"] and topics.queued(spark, root, "in").count() == 0
    assert web.of("/dead") == ["p0", "p1", "p2"] and len(web.of("/third")) == 6


def test_a_subscriber_sees_what_it_acknowledges(spark, tmp_path):
    root = f"file://{tmp_path}"
    topics.publish(_messages(spark, range(3)), root, "log", "log", "came")
    rows, last, ack = topics.subscribed(spark, root, "log", "s")
    topics.publish(_messages(spark, range(3, 5)), root, "log", "log", "came")  # before the rows are read
    assert rows.count() == last == 3
    ack()
    assert [p for _, p in _read(topics.subscribed(spark, root, "log", "s")[0])] == ["p3", "p4"]
    topics.subscribed(spark, root, "log", "s")[2]()
    assert topics.subscribed(spark, root, "log", "s")[0].count() == 0


def test_retryable_handlers_stop_the_route(spark, tmp_path):
    root = f"file://{tmp_path}"
    topics.publish(_messages(spark, range(4)), root, "in", order="came")
    r = config.load("r: {input: {memory: {topic: in}}, output: {memory: {topic: out}}}", {})["r"]
    bad = r.with_handler(lambda d: d.withColumn("status", F.when(F.decode("payload", "UTF-8") == "p2", M.RETRYABLE).otherwise(M.ACK)))
    with pytest.raises(Exception, match="retryable messages are left"):
        run.run(spark, "r", bad, root)
    assert topics.queued(spark, root, "in").count() == 4 and topics.queued(spark, root, "out").count() == 0
    calls = spark.sparkContext.accumulator(0)

    def handler(d, n):
        return d.withColumns({"status": F.when((F.decode("payload", "UTF-8") == "p2") & F.lit(n < 3), M.RETRYABLE).when(F.decode("payload", "UTF-8") == "p1", M.NONRETRYABLE).otherwise(M.ACK), "payload": F.encode(F.concat(F.decode("payload", "UTF-8"), F.lit(f"/{n}")), "UTF-8")})

    out = r.output.add_middleware("retry", max_attempts=3)
    run.run(spark, "r", config.Route(r.input, out.with_handler(handler)), root)
    assert [p for _, p in _read(topics.queued(spark, root, "out"))] == ["p0/1", "p2/3", "p3/1"] and calls.value == 0


def test_a_crash_in_the_commit_is_finished_by_the_next_run(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    topics.publish(_messages(spark, range(6)), root, "in", order="came")
    text = f"r: {{input: {{memory: {{topic: in}}}}, output: {{fanout: [{{memory: {{topic: a}}}}, {{file: '{tmp_path}/lines'}}, {{parquet: {{path: '{tmp_path}/table'}}}}]}}}}"
    r = config.load(text, {})["r"]
    for broken in ("attach", "move_into"):
        topics.publish(_messages(spark, [100]), root, "in", order="came")
        with monkeypatch.context() as patch:
            patch.setattr(topics if broken == "attach" else run, broken, lambda *a: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError, match="gone"):
                run.run(spark, "r", r, root)
    run.run(spark, "r", r, root)
    assert topics.queued(spark, root, "in").count() == 0
    assert [p for _, p in _read(topics.queued(spark, root, "a"))] == [*[f"p{i}" for i in range(6)], "p100", "p100"]
    assert spark.read.text(f"{tmp_path}/lines").count() == spark.read.parquet(f"{tmp_path}/table").count() == 8
    assert not [p for p in (tmp_path / "lines").iterdir() if p.name.startswith("_route")]


def test_two_runs_on_one_batch(spark, tmp_path, monkeypatch):
    """While one run stages its parts, another consumer takes the messages: nothing of the first becomes seen."""
    root, stage = f"file://{tmp_path}", topics.stage
    topics.publish(_messages(spark, range(3)), root, "in", order="came")
    r = config.load("r: {input: {memory: {topic: in}}, output: {memory: {topic: out}}}", {})["r"]

    def slow(*a):
        out = stage(*a)
        topics.taken(root, "in", 1, 2, "other")
        return out

    with monkeypatch.context() as patch:
        patch.setattr(topics, "stage", slow)
        with pytest.raises(topics.Taken):
            run.run(spark, "r", r, root)
    assert topics.queued(spark, root, "out").count() == 0 and topics.queued(spark, root, "in").count() == 1
    run.run(spark, "r", r, root)
    assert [p for _, p in _read(topics.queued(spark, root, "out"))] == ["p2"]


def test_weak_join_in_a_route(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(f"{1:032x}", b'{"a": 1}', {"g": "x", "n": "0"}, 0), (f"{1:032x}", b"two", {"g": "x", "n": "1"}, 1), (f"{1:032x}", b"3", {"g": "x", "n": "2"}, 2), (f"{0:032x}", b"4", {"n": "3"}, 3)]
    topics.publish(spark.createDataFrame(rows, "message_id string, payload binary, metadata map<string,string>, came long"), root, "in", order="came")
    r = config.load("r: {input: {memory: {topic: in}, middlewares: [{weak_join: {group_by: g, expected_count: 2, timeout_ms: 60000}}]}, output: {memory: {topic: out}}}", {})["r"]
    run.run(spark, "r", r, root)
    got = topics.queued(spark, root, "out").orderBy("offset").collect()
    assert [(r["payload"].decode(), r["metadata"]) for r in got] == [('[{"a":1},"two"]', {"g": "x", "n": "0"}), ("[3]", {"g": "x", "n": "2"}), ("[4]", {"g": "default", "n": "3"})]
    assert len({r["message_id"] for r in got}) == 3


def test_null_payloads_stay_in_their_place(spark):
    df = spark.createDataFrame([("k", 1, '{"a":1}'), ("k", 2, None), ("k", 3, "5")], "k string, id long, p string").withColumn("us", F.col("id"))
    assert stateful.weak_join(df, "k", "us", "id", "p", 3).first()["payload"] == '[{"a":1},null,5]'


def test_insert_new_and_replies_with_null_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 5), (None, 6), ("b", 1)], "k string, v int")
    got = delivery.insert_new(df, spark.createDataFrame([("b",), (None,)], "k string"), "k", ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1), (None, 5), (None, 5), (None, 6)], key=str)


def test_names_of_sinks():
    e = config.named(config.endpoint({"fanout": [{"http": {"url": "u"}}, {"http": {"url": "u"}}, {"kafka": {"url": "h", "topic": "t"}}, None, {"memory": {"topic": "m"}, "middlewares": [{"dlq": {"endpoint": {"memory": {"topic": "m"}}}}]}]}))
    assert list(run.leaves(e)) == ["http:u", "http:u#2", "kafka:h:t", "memory:m", "memory:m#2"]
    assert build.named(e) == e


def test_ids_of_all_sizes(spark):
    n = [0, 7, 2**64 - 1, 2**64, 10**30, 2**128 - 1, 2**128, 10**38, 10**39]
    got = [r[0] for r in spark.createDataFrame([(str(x),) for x in n] + [("0007",), ("x",), ("",), (None,)], "t string").select(M.id_from_decimal(F.col("t"))).collect()]
    assert got == [f"{x:032x}" if x < 2**128 else None for x in n] + [f"{7:032x}", None, None, None]
    texts = ["1" * 32, "1" * 33, "9" * 39, str(2**128 - 1)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.id_from_text(F.col("t"))).collect()]
    assert got == ["1" * 32, f"{int('1' * 33):032x}", None, "f" * 32]
    values = [5, -1, -(2**63), 2**63, 2**64 - 1, 2**64, 1.5]
    got = [r[0] for r in spark.createDataFrame([(json.dumps({"id": v}),) for v in values], "p string").select(M.id_from_json(F.col("p"))).collect()]
    assert got == [f"{v % 2**128:032x}" if isinstance(v, int) and -(2**63) <= v < 2**64 else None for v in values]
