"""Registered queries that run configured routes over topics: what arrives where, in which order, and what stays after a failure.

All rows of ``events`` are published to a topic in the order of their arrival; each query works in a folder of its own.
"""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.broker_queries import _messages, number
from routeflow.functions import messages as M
from routeflow.functions.shared import folder, table
from routeflow.plans import build, config, run
from routeflow.queries import HOUR_US, SQL_ROUTE, SQL_WEAK, register
from routeflow.sources import streams, topics
from routeflow.streaming import routes, runtime, stateful

ARRIVAL = ["arr_us", "event_id"]
SQL_ORDER = "o AS (SELECT *, row_number() OVER (ORDER BY arr_us, event_id)::BIGINT AS n FROM m)"


def _root(spark) -> str:
    return f"{folder(spark)}/topics-{uuid.uuid4().hex}"


def _event(df: DataFrame):
    return F.conv("message_id", 16, 10).cast("long").alias("event_id")


def _placed(df: DataFrame, place: str, at="offset") -> DataFrame:
    return df.select(_event(df), F.lit(place).alias("place"), F.col(at).alias("n"))


WEAK = "r: {input: {memory: {topic: in}, middlewares: [{weak_join: {group_by: user, expected_count: 3, timeout_ms: %d}}]}, output: {memory: {topic: out}}}" % (6 * HOUR_US // 1000)


@register(SQL_WEAK + """
SELECT min(event_id) FILTER (WHERE k = 1)::BIGINT AS first_event, grp::VARCHAR AS "user", '[' || string_agg('{"k":' || (payload->>'$.k') || '}', ',' ORDER BY k) || ']' AS body, min(arr_us)::BIGINT AS at, 'memory:out' AS sink
FROM (SELECT f.grp, f.g, f.event_id, f.arr_us, m.payload, row_number() OVER (PARTITION BY f.grp, f.g ORDER BY f.arr_us, f.event_id) AS k FROM f JOIN m USING (event_id)) GROUP BY grp, g
""")
def route_weak_join(m, spark, sf_dir):
    """The weak join of a configured route, its messages in the order of time and place."""
    rows = m.select("message_id", F.encode("payload", "UTF-8").alias("payload"), F.create_map(F.lit("user"), F.col("grp").cast("string"), F.lit("event"), F.col("event_id").cast("string")).alias("metadata"), "arr_us", F.struct("event_id").alias("arr_at"))
    out = build.plan(rows, config.load(WEAK, {})["r"])
    meta = F.col("metadata")
    return out.select(meta["event"].cast("long").alias("first_event"), meta["user"].alias("user"), M.payload_text(F.col("payload")).alias("body"), F.col("arr_us").alias("at"), "sink")


FANOUT = """
r:
  input: {memory: {topic: in}}
  output:
    switch:
      metadata_key: kind
      cases: {purchase: {fanout: [{memory: {topic: a}}, {memory: {topic: b, subscribe_mode: true}}]}, error: {fanout: [{memory: {topic: a}}, {memory: {topic: a}}]}}
      default: {memory: {topic: rest}}
"""


@register(f"""
WITH {SQL_ORDER}, c AS (
  SELECT event_id, t.place, n FROM o CROSS JOIN (VALUES ('a'), ('b')) t(place) WHERE kind = 'purchase'
  UNION ALL SELECT event_id, 'a', n FROM o CROSS JOIN (VALUES (1), (2)) t(copy) WHERE kind = 'error'
  UNION ALL SELECT event_id, 'rest', n FROM o WHERE kind NOT IN ('purchase', 'error'))
SELECT event_id, place, count(*)::BIGINT AS copies, CASE WHEN place = 'a' THEN -1 ELSE row_number() OVER (PARTITION BY place ORDER BY n) END::BIGINT AS n FROM c GROUP BY event_id, place, c.n
""")
def route_sinks_of_one_kind(m, spark, sf_dir):
    """Every place in the tree is a sink, also where two lead to one topic; single writers keep the arrival order."""
    root = _root(spark)
    topics.publish(_messages(m), root, "in", order=ARRIVAL)
    run.run(spark, "r", config.load(FANOUT, {})["r"], root)
    out = _placed(topics.queued(spark, root, "a"), "a").withColumn("n", F.lit(-1).cast("long"))
    out = out.unionByName(_placed(topics.read_log(spark, root, "b"), "b")).unionByName(_placed(topics.queued(spark, root, "rest"), "rest"))
    out = out.unionByName(_placed(topics.queued(spark, root, "in"), "in"))
    return out.groupBy("event_id", "place", "n").agg(F.count("*").alias("copies"))


FAILING = "r: {input: {memory: {topic: in}}, output: {fanout: [{memory: {topic: a}}, {memory: {topic: b}}, {failing_sink: {}}]}}"


def _fails(rows: DataFrame, _) -> None:
    rows.select(F.raise_error(F.lit("this sink is down"))).write.format("noop").mode("overwrite").save()


@register(f"WITH {SQL_ORDER} SELECT event_id, 'in' AS place, n FROM o")
def route_failing_sink(m, spark, sf_dir):
    """A sink that is down: the others get nothing, the queue keeps all in its order."""
    root = _root(spark)
    topics.publish(_messages(m), root, "in", order=ARRIVAL)
    config.SINKS["failing_sink"] = _fails
    try:
        run.run(spark, "r", config.load(FAILING, {})["r"], root)
    except Exception as e:
        if "this sink is down" not in str(e):
            raise
    out = _placed(topics.queued(spark, root, "in"), "in")
    for t in ("a", "b"):
        out = out.unionByName(_placed(topics.queued(spark, root, t), t))
    return out


class _Crash(BaseException):
    """The driver is gone."""


RESTARTED = "r: {input: {memory: {topic: in}}, output: {fanout: [{memory: {topic: a}}, {memory: {topic: log, subscribe_mode: true}}]}}"


@register(f"WITH {SQL_ORDER} SELECT event_id, place, n FROM o CROSS JOIN (VALUES ('a'), ('log')) t(place)")
def route_restarted(m, spark, sf_dir):
    """A crash between the sinks of a commit, and a run after it: no message is lost, none is there twice."""
    root, whole = _root(spark), topics.attach
    topics.publish(_messages(m), root, "in", order=ARRIVAL)
    r, calls = config.load(RESTARTED, {})["r"], []

    def crash(*a):
        calls.append(a)
        if len(calls) == 2:
            raise _Crash
        return whole(*a)

    topics.attach = crash
    try:
        run.run(spark, "r", r, root)
    except _Crash:
        pass
    finally:
        topics.attach = whole
    run.run(spark, "r", r, root)
    out = _placed(topics.queued(spark, root, "a"), "a").unionByName(_placed(topics.read_log(spark, root, "log"), "log"))
    return out.unionByName(_placed(topics.queued(spark, root, "in"), "in"))


LOGGED = "r: {input: {memory: {topic: in}}, output: {memory: {topic: log, subscribe_mode: true}}}"


@register("SELECT event_id, 'log' AS place, row_number() OVER (ORDER BY md5(event_id::VARCHAR))::BIGINT AS n FROM m")
def route_log_order(m, spark, sf_dir):
    """A log that a route writes has the order in which messages came into its queue, not that of their ids."""
    root = _root(spark)
    topics.publish(_messages(m).withColumn("came", F.md5(F.col("event_id").cast("string"))), root, "in", order="came")
    run.run(spark, "r", config.load(LOGGED, {})["r"], root)
    return _placed(topics.read_log(spark, root, "log"), "log")


@register(f"""
WITH {SQL_ORDER}, t AS (SELECT count(*) AS k FROM m), d AS (SELECT o.* FROM o, t WHERE n <= 2 * (k // 3)), p AS (SELECT *, row_number() OVER (ORDER BY n) AS back FROM d WHERE event_id % 17 = 0)
SELECT event_id, n FROM o, t WHERE n > 2 * (k // 3) UNION ALL SELECT event_id, (k + back)::BIGINT FROM p, t
""")
def queue_drained_in_parts(m, spark, sf_dir):
    """Two thirds of a queue taken from its head in one batch; every 17th event is rejected and stands at the tail then."""
    root = _root(spark)
    topics.publish(_messages(m), root, "q", order=ARRIVAL)
    rows, done = topics.drained(spark, root, "q", 2 * (m.count() // 3))
    done(rows.where(_event(rows) % 17 == 0))
    return topics.queued(spark, root, "q").select(_event(rows), F.col("offset").alias("n"))


@register(f"""
WITH {SQL_ORDER}, k AS (SELECT count(*) AS k FROM m)
SELECT event_id, n, CASE WHEN n <= k // 2 THEN 'archive' ELSE 'log' END AS place, n <= k // 2 AS told FROM o, k
""")
def log_dropped_to_archive(m, spark, sf_dir):
    """A log of three segments with two subscribers: what both have acknowledged goes to the archive, and its owner is told."""
    root, told, k = _root(spark), [], m.count()
    rows = _messages(m)
    topics.publish(rows, root, "log", "log", ARRIVAL)
    for who, ack in (("fast", k), ("slow", k // 2)):
        topics.register(root, "log", who)
        topics.acknowledge(root, "log", who, ack)
    topics.collect_garbage(spark, root, "log", archive=f"{root}/archive", on_drop=told.append)
    left = topics.read_log(spark, root, "log").select(_event(rows), F.col("offset").alias("n"), F.lit("log").alias("place"), F.lit(False).alias("told"))
    gone = told[0].select("message_id", "offset") if told else left.where("false").select(F.lit("").alias("message_id"), F.col("n").alias("offset"))
    return left.unionByName(gone.select(_event(rows), F.col("offset").alias("n"), F.lit("archive").alias("place"), F.lit(True).alias("told")))


@register(f"WITH {SQL_ORDER}, k AS (SELECT count(*) AS k FROM m) SELECT event_id, n, CASE WHEN n <= k // 2 THEN 'first' ELSE 'second' END AS read FROM o, k")
def route_subscriber(m, spark, sf_dir):
    """A route that reads a log as a subscriber, twice: the second time it goes on where the first has acknowledged."""
    root, k = _root(spark), m.count()
    topics.publish(_messages(m), root, "events", "log", ARRIVAL)
    r = config.load("r: {input: {memory: {topic: events, subscribe_mode: true}}, output: {memory: {topic: out}}}", {})["r"]
    run.run(spark, "r", r, root, limit=k // 2)
    first = topics.window(root, "out")[1]
    run.run(spark, "r", r, root)
    rows = topics.queued(spark, root, "out")
    return rows.select(_event(rows), F.col("offset").alias("n"), F.when(F.col("offset") <= first, "first").otherwise("second").alias("read"))


@register("SELECT event_id, arr_us + 100000 AS emit_us FROM m")
def delay_shift(m, spark, sf_dir):
    r = config.load("r: {input: {memory: {topic: i}}, output: {memory: {topic: o}, middlewares: [{delay: {delay_ms: 100}}]}}", {})["r"]
    return build.plan(_messages(m), r).select("event_id", F.col("arr_us").alias("emit_us"))


RETRIED = "r: {input: {memory: {topic: i}}, output: {memory: {topic: primary}, middlewares: [{retry: {max_attempts: 3}}, {dlq: {endpoint: {memory: {topic: dlq}}}}]}}"


@register("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1 ELSE least(event_id % 5 + 1, 3) END AS attempts, CASE WHEN event_id % 5 = 0 THEN 'primary' WHEN event_id % 7 = 0 THEN 'dlq' WHEN event_id % 5 < 3 THEN 'primary' ELSE 'dlq' END AS destination FROM m")
def retry_then_dlq(m, spark, sf_dir):
    """A handler that fails as often as the event's number says, for good at every 7th."""
    fails = lambda df, n: df.withColumn("status", F.when(number() % 5 == 0, M.ACK).when(number() % 7 == 0, M.NONRETRYABLE).when(number() % 5 >= n, M.RETRYABLE).otherwise(M.ACK))
    out = build.plan(_messages(m), config.load(RETRIED, {})["r"].with_handler(fails))
    return out.select("event_id", F.col("attempts").cast("long").alias("attempts"), F.substring_index("sink", ":", -1).alias("destination"))


METERED = """
r:
  input: {memory: {topic: in}}
  output:
    switch:
      metadata_key: kind
      cases: {purchase: {memory: {topic: orders}, middlewares: [metrics]}, error: {memory: {topic: alerts}, middlewares: [metrics]}}
      default: {memory: {topic: rest}, middlewares: [metrics]}
    middlewares: [{dlq: {endpoint: {memory: {topic: dead}}}}]
"""


@register(f"SELECT {SQL_ROUTE} AS route, (count(*) FILTER (WHERE event_id % 17 <> 0))::BIGINT AS processed, (count(*) FILTER (WHERE event_id % 17 = 0))::BIGINT AS failed FROM m GROUP BY 1")
def metrics_counters(m, spark, sf_dir):
    """What the metrics middleware of three sinks has counted once the route has run; their handlers reject every 17th event."""
    root, metrics = _root(spark), {}
    topics.publish(_messages(m), root, "in", order=ARRIVAL)
    r = config.load(METERED, {})["r"]
    rejects = lambda df: df.withColumn("status", F.when(_event(df) % 17 == 0, M.NONRETRYABLE).otherwise(M.ACK))
    with_handler = lambda e: e.with_handler(rejects)
    o = r.output.options
    output = config.Endpoint("switch", {**o, "cases": {k: with_handler(e) for k, e in o["cases"].items()}, "default": with_handler(o["default"])}, r.output.middlewares)
    run.run(spark, "r", config.Route(r.input, output), root, metrics)
    rows = [(n.rpartition(":")[2], x.get["processed"], x.get["failed"]) for n, x in metrics.items()]
    return spark.createDataFrame([r for r in rows if r[1] + r[2]], "route string, processed long, failed long")


CUSTOM = "r: {input: {event_table: {}, middlewares: [{upper_case: {of: view}}]}, output: {switch: {metadata_key: kind, cases: {click: null}, default: {response: {}}}}}"


@register("SELECT event_id, CASE WHEN kind = 'view' THEN upper(payload) ELSE payload END AS body FROM m WHERE kind <> 'click'")
def route_custom_parts(m, spark, sf_dir):
    """A registered source and middleware, a sink that drops, and one that answers."""
    config.SOURCES["event_table"] = lambda s, _: _messages(m).drop("event_id")
    config.CUSTOM_MIDDLEWARE["upper_case"] = lambda df, o: df.withColumn("payload", F.when(F.col("metadata")[M.KIND] == o["of"], F.encode(F.upper(M.payload_text(F.col("payload"))), "UTF-8")).otherwise(F.col("payload")))
    answers = run.run(spark, "r", config.load(CUSTOM, {})["r"], _root(spark))
    return answers["response"].select(_event(m), M.payload_text(F.col("payload")).alias("body"))


@register(f"WITH {SQL_ORDER} SELECT event_id, 'log' AS place, n FROM o")
def stream_route(m, spark, sf_dir):
    """A route deployed as a stream, which ends when its queue is handled: all events in a log, in the queue's order."""
    root = _root(spark)
    topics.publish(_messages(m), root, "in", order=ARRIVAL)
    name = f"stream-route-{root[-8:]}"
    routes.deploy(spark, name, config.load(LOGGED.replace("r:", f"{name}:", 1), {})[name], root, once=True).awaitTermination()
    return _placed(topics.read_log(spark, root, "log"), "log")


def _streamed(rows: DataFrame, transform, name: str) -> DataFrame:
    """What a stream over a stored table emits until all of it is handled."""
    spark, root = rows.sparkSession, _root(rows.sparkSession)
    rows.write.parquet(f"{root}/in")
    out = transform(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    runtime.deploy(f"{name}-{root[-8:]}", out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@register("""
WITH --recursive
o AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY arr_us, event_id) AS rn, arr_us // 1000000 AS s FROM m),
f AS (SELECT grp, kind, rn, event_id, s AS last, true AS ok FROM o WHERE rn = 1
      UNION ALL SELECT o.grp, o.kind, o.rn, o.event_id, CASE WHEN o.s - f.last >= 3600 THEN o.s ELSE f.last END, o.s - f.last >= 3600
      FROM f JOIN o ON o.grp = f.grp AND o.kind = f.kind AND o.rn = f.rn + 1)
SELECT event_id FROM f WHERE ok
""")
def stream_dedup_ttl_1h(m, spark, sf_dir):
    rows = m.select("event_id", F.concat_ws("/", "grp", "kind").alias("key"), "arr_us")
    return _streamed(rows, lambda s: stateful.dedup_ttl(s, "key", "arr_us", "event_id", 3600), "dedup").select("event_id")


@register(SQL_WEAK + """
SELECT grp, '[' || string_agg(event_id, ',' ORDER BY arr_us, event_id) || ']' AS ids FROM f GROUP BY grp, g HAVING count(*) = 3
""")
def stream_weak_join(m, spark, sf_dir):
    """Full groups that a stream has emitted."""
    rows = m.select("event_id", "grp", "arr_us", F.col("event_id").cast("string").alias("p"))
    out = _streamed(rows, lambda s: stateful.weak_join(s, "grp", "arr_us", "event_id", "p", 3, 6 * HOUR_US), "weak-join")
    return out.where("size = 3").select("grp", M.merged_array(F.col("payloads")).alias("ids"))


@register("SELECT event_id, 1 AS run FROM m WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 2 FROM m WHERE event_id % 2 = 1")
def stream_lines_tailed(m, spark, sf_dir):
    """A file that two batches are appended to, tailed twice: each run sees what is new, and the file keeps its lines."""
    root = _root(spark)
    path, out = f"{root.removeprefix('file://')}/lines", []
    for side in (0, 1):
        M.to_envelope(_messages(m.where(number() % 2 == side))).coalesce(1).write.text(f"{path}-{side}")
    first, second = (next(f for f in spark.read.text(f"{path}-{side}").inputFiles()) for side in (0, 1))
    streams.register(spark)
    for run_, file in ((1, first), (2, second)):
        if run_ == 2:
            with open(first.removeprefix("file://"), "ab") as f, open(file.removeprefix("file://"), "rb") as more:
                shutil.copyfileobj(more, f)
        stream = spark.readStream.format("lines").options(path=first.removeprefix("file://"), consume="false").load()
        sink = lambda batch, n, run_=run_: M.from_lines(batch).write.mode("overwrite").parquet(f"{root}/out/run={run_}/batch={n}")
        runtime.deploy(f"tail-{root[-8:]}", stream, sink, f"{root}/checkpoint", once=True).awaitTermination()
        out.append(f"{root}/out/run={run_}")
    rows = spark.read.option("basePath", f"{root}/out").parquet(*out)
    return rows.select(_event(rows), F.col("run").cast("int").alias("run"))


@register("SELECT event_id FROM m")
def stream_lines_consumed(m, spark, sf_dir):
    """A file of envelopes as a route's input, read as a stream: one run that ends hands on every line once."""
    root = _root(spark)
    path = f"{root.removeprefix('file://')}/lines"
    M.to_envelope(_messages(m)).coalesce(1).write.text(path)
    name, file = f"lines-{root[-8:]}", next(f for f in spark.read.text(path).inputFiles())
    r = config.load(f"{name}: {{input: {{file: '{file.removeprefix('file://')}'}}, output: {{memory: {{topic: out}}}}, batch_size: 4000}}", {})[name]
    routes.deploy(spark, name, r, root, once=True).awaitTermination()
    return topics.queued(spark, root, "out").select(_event(m))


PANICS = "r: {input: {memory: {topic: in}}, output: {memory: {topic: out}, middlewares: [{random_panic: {probability: 0.05}}]}}"


@register(f"WITH {SQL_ORDER} SELECT event_id, 'in' AS place, n FROM o")
def route_random_panic(m, spark, sf_dir):
    """Faults strike some messages of a batch: the route stops, nothing is written, the queue keeps all."""
    root = _root(spark)
    topics.publish(_messages(m), root, "in", order=ARRIVAL)
    try:
        run.run(spark, "r", config.load(PANICS, {})["r"], root)
    except Exception as e:
        if "injected fault" not in str(e):
            raise
    return _placed(topics.queued(spark, root, "in"), "in").unionByName(_placed(topics.queued(spark, root, "out"), "out"))
