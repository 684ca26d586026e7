"""Registered queries of the routing engine, each over its whole tables, with the SQL they are held against.

Messages are the rows of ``events``: the id is the event's number, the payload its props, the kind its type, the group
its user, the arrival its time in microseconds. Faults are put in by rules on the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.operators import delivery, event_log, routing, stateful
from routeflow.sources import readers

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
CASES = {"purchase": "orders", "error": "alerts"}


def micros(ts):
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def events_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", M.hex_id(F.col("event_id")).alias("message_id"), F.col("props").alias("payload"), F.col("event_type").alias("kind"), F.col("user_id").alias("grp"), micros(F.col("ts")).alias("arr_us"))


def _k(payload="payload"):
    return F.get_json_object(payload, "$.k").cast("long")


SQL_M = "m AS (SELECT event_id, lpad(lower(to_hex(event_id)), 32, '0') AS message_id, props AS payload, event_type AS kind, user_id AS grp, epoch_us(ts)::BIGINT AS arr_us FROM events)"
SQL_ROUTE = "CASE kind WHEN 'purchase' THEN 'orders' WHEN 'error' THEN 'alerts' ELSE 'rest' END"
QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(events_as_messages(spark, sf_dir), spark, sf_dir)
        if sql:
            text = sql.strip()
            recursive = "RECURSIVE " if "--recursive" in text else ""
            ORACLES[name] = f"WITH {recursive}{SQL_M}" + (", " + text[5:] if text.startswith("WITH ") else " " + text)
        return f

    return add


@register("SELECT event_id, message_id, payload, kind FROM m")
def msg_canonical(m, spark, sf_dir):
    return m.select("event_id", "message_id", "payload", "kind")


@register("SELECT event_id, (payload->>'$.k')::BIGINT AS k FROM m")
def msg_parse_payload(m, spark, sf_dir):
    return m.select("event_id", _k().alias("k"))


@register("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN substr(h, 1, 32) WHEN 1 THEN h WHEN 2 THEN lpad(to_hex(event_id), 32, '0') WHEN 3 THEN lpad(event_id::VARCHAR, 32, '0') END AS parsed
FROM (SELECT event_id, lower(md5(event_id::VARCHAR)) AS h FROM m)
""".replace("to_hex(event_id)", "lower(to_hex(event_id))"))
def msg_id_ladder(m, spark, sf_dir):
    h, n = F.md5(F.col("event_id").cast("string")), F.col("event_id") % 5
    uuid = F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.when(n == 0, uuid).when(n == 1, F.upper(h)).when(n == 2, F.concat(F.lit("0x"), F.hex("event_id"))).when(n == 3, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("no id "), h))
    return m.select("event_id", M.id_from_text(text).alias("parsed"))


@register("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN lpad(lower(to_hex(event_id)), 32, '0') WHEN 1 THEN lpad(event_id::VARCHAR, 32, '0') WHEN 2 THEN NULL ELSE NULL END AS parsed FROM m
""")
def msg_id_from_json(m, spark, sf_dir):
    n, e = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = F.when(n == 0, F.concat(F.lit('{"id":'), e, F.lit("}"))).when(n == 1, F.concat(F.lit('{"message_id":"'), e, F.lit('","id":7}'))).when(n == 2, F.concat(F.lit('{"message_id":"no id","id":'), e, F.lit("}"))).otherwise(F.col("payload"))
    return m.select("event_id", M.id_from_json(text).alias("parsed"))


@register("""
SELECT CASE WHEN event_id % 2 = 0 THEN message_id ELSE md5(payload) END AS message_id, payload AS body, CASE WHEN event_id % 2 = 0 THEN kind END AS kind FROM m
""")
def envelope_roundtrip(m, spark, sf_dir):
    meta = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit(M.KIND), F.col("kind"))).otherwise(F.create_map(F.lit(M.FORMAT), F.lit(M.RAW)))
    lines = M.to_envelope(m.select("message_id", F.encode("payload", "UTF-8").alias("payload"), meta.alias("metadata")))
    return M.from_lines(lines).select("message_id", M.payload_text(F.col("payload")).alias("body"), F.element_at("metadata", M.KIND).alias("kind"))


@register(f"SELECT event_id, {SQL_ROUTE} AS route FROM m")
def switch_routes(m, spark, sf_dir):
    return routing.switch(m, F.col("kind"), CASES, "rest").select("event_id", "route")


@register("SELECT event_id, CASE kind WHEN 'purchase' THEN 'orders' ELSE 'alerts' END AS route FROM m WHERE kind IN ('purchase', 'error')")
def switch_no_default_drop(m, spark, sf_dir):
    return routing.switch(m, F.col("kind"), CASES).select("event_id", "route")


@register(f"SELECT {SQL_ROUTE} AS route, count(*)::BIGINT AS n, sum((payload->>'$.k')::BIGINT)::BIGINT AS sum_k, min(arr_us)::BIGINT AS first_us, max(arr_us)::BIGINT AS last_us FROM m GROUP BY 1")
def route_switch_counts(m, spark, sf_dir):
    routed = routing.switch(m, F.col("kind"), CASES, "rest")
    return routed.groupBy("route").agg(F.count("*").alias("n"), F.sum(_k()).alias("sum_k"), F.min("arr_us").alias("first_us"), F.max("arr_us").alias("last_us"))


@register(f"SELECT event_id, {SQL_ROUTE} || CASE WHEN {SQL_ROUTE} = 'orders' THEN CASE WHEN grp % 2 = 0 THEN '.even' ELSE '.odd' END ELSE '' END AS route FROM m")
def switch_nested(m, spark, sf_dir):
    inner = routing.route_of((F.col("grp") % 2).cast("string"), {"0": "orders.even"}, "orders.odd")
    routed = routing.switch(m, F.col("kind"), CASES, "rest")
    return routed.select("event_id", F.when(F.col("route") == "orders", inner).otherwise(F.col("route")).alias("route"))


@register("SELECT target, event_id, payload FROM m CROSS JOIN (VALUES ('archive'), ('live')) t(target)")
def fanout_copies(m, spark, sf_dir):
    return routing.fanout(m, ["archive", "live"]).select("target", "event_id", "payload")


@register("SELECT event_id, 'modified ' || payload AS payload FROM m")
def handler_publish(m, spark, sf_dir):
    return routing.handle(m, F.concat(F.lit("modified "), F.col("payload"))).select("event_id", "payload")


@register("SELECT event_id, payload FROM m WHERE kind <> 'view'")
def handler_ack_filter(m, spark, sf_dir):
    return routing.handle(m, F.col("payload"), F.col("kind") != "view").select("event_id", "payload")


SQL_BAD = "CASE WHEN event_id % 7 = 0 THEN 'invalid json' ELSE payload END"


def _handlers():
    body = F.when(F.col("event_id") % 7 == 0, "invalid json").otherwise(F.col("payload"))
    read = F.from_json(body, "k bigint")["k"]
    return {k: (read.isNotNull(), F.concat(F.lit(f"{k}:"), read.cast("string"))) for k in ("purchase", "view")}


@register("""
SELECT event_id, CASE WHEN kind NOT IN ('purchase', 'view') OR event_id % 7 = 0 THEN 'nonretryable' ELSE 'ack' END AS status,
       CASE WHEN kind IN ('purchase', 'view') AND event_id % 7 <> 0 THEN kind || ':' || (payload->>'$.k') END AS result,
       CASE WHEN kind NOT IN ('purchase', 'view') THEN 'No handler registered' WHEN event_id % 7 = 0 THEN 'Deserialization failed' END AS error FROM m
""")
def dispatch_typed(m, spark, sf_dir):
    return routing.dispatch(m, F.col("kind"), _handlers()).select("event_id", "status", "result", "error")


@register("""
SELECT event_id, CASE WHEN kind IN ('purchase', 'view') AND event_id % 7 = 0 THEN 'nonretryable' ELSE 'ack' END AS status,
       CASE WHEN kind NOT IN ('purchase', 'view') THEN 'fallback' WHEN event_id % 7 <> 0 THEN kind || ':' || (payload->>'$.k') END AS result FROM m
""")
def dispatch_fallback(m, spark, sf_dir):
    return routing.dispatch(m, F.col("kind"), _handlers(), F.lit("fallback")).select("event_id", "status", "result")


SQL_STATUS = "CASE WHEN event_id % 7 = 0 THEN 'nonretryable' WHEN event_id % 17 = 0 THEN 'retryable' ELSE 'ack' END"


def _status():
    return F.when(F.col("event_id") % 7 == 0, M.NONRETRYABLE).when(F.col("event_id") % 17 == 0, M.RETRYABLE).otherwise(M.ACK)


@register(f"SELECT event_id, CASE {SQL_STATUS} WHEN 'ack' THEN 'primary' ELSE 'dlq' END AS destination, {SQL_STATUS} AS reason FROM m")
def dlq_split(m, spark, sf_dir):
    done, dead = delivery.split_dead(m.withColumn("status", _status()))
    cols = ["event_id", F.col("status").alias("reason")]
    return done.select(F.lit("primary").alias("destination"), *cols).unionByName(dead.select(F.lit("dlq").alias("destination"), *cols))


@register("SELECT event_id, grp, kind FROM (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY arr_us, event_id) AS rn FROM m) WHERE rn = 1")
def dedup_first(m, spark, sf_dir):
    return stateful.first_of_key(m, ["grp", "kind"], ["arr_us", "event_id"]).select("event_id", "grp", "kind")


@register("""
WITH --recursive
o AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY arr_us, event_id) AS rn, arr_us // 1000000 AS s FROM m),
f AS (SELECT grp, kind, rn, event_id, s AS last, true AS ok FROM o WHERE rn = 1
      UNION ALL SELECT o.grp, o.kind, o.rn, o.event_id, CASE WHEN o.s - f.last >= 86400 THEN o.s ELSE f.last END, o.s - f.last >= 86400
      FROM f JOIN o ON o.grp = f.grp AND o.kind = f.kind AND o.rn = f.rn + 1)
SELECT event_id, grp, kind FROM f WHERE ok
""")
def dedup_ttl_1d(m, spark, sf_dir):
    return stateful.dedup_ttl(m.select("event_id", "grp", "kind", "arr_us"), ["grp", "kind"], "arr_us", "event_id", 86_400).select("event_id", "grp", "kind")


@register("SELECT message_id, min(arr_us)::BIGINT AS arr_us FROM (SELECT message_id, arr_us FROM m UNION ALL SELECT message_id, arr_us + 5000000 FROM m WHERE event_id % 10 = 0) GROUP BY 1")
def dedup_replayed(m, spark, sf_dir):
    rows = m.select("message_id", "arr_us")
    again = m.where(F.col("event_id") % 10 == 0).select("message_id", (F.col("arr_us") + 5_000_000).alias("arr_us"))
    return stateful.first_of_key(rows.unionByName(again), ["message_id"], ["arr_us"])


@register("""
WITH g AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY arr_us, event_id) - 1) // 3 AS g FROM m)
SELECT grp, g::BIGINT AS part, count(*)::BIGINT AS size, arg_min(event_id, (arr_us, event_id)) AS first, count(*) >= 3 AS complete FROM g GROUP BY 1, 2
""")
def weak_join_count(m, spark, sf_dir):
    out = stateful.weak_join(m.withColumnRenamed("grp", "user"), "user", "arr_us", "event_id", "payload", 3)
    return out.select(F.col("user").alias("grp"), F.col("grp").alias("part"), "size", "first", "complete")


SQL_WEAK = """
WITH --recursive
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY arr_us, event_id) AS rn FROM m),
f AS (SELECT grp, rn, event_id, arr_us, 0::BIGINT AS g, 1::BIGINT AS n, arr_us AS start FROM o WHERE rn = 1
      UNION ALL SELECT o.grp, o.rn, o.event_id, o.arr_us,
        CASE WHEN f.n >= 3 OR o.arr_us >= f.start + 21600000000 THEN f.g + 1 ELSE f.g END,
        CASE WHEN f.n >= 3 OR o.arr_us >= f.start + 21600000000 THEN 1 ELSE f.n + 1 END,
        CASE WHEN f.n >= 3 OR o.arr_us >= f.start + 21600000000 THEN o.arr_us ELSE f.start END
      FROM f JOIN o ON o.grp = f.grp AND o.rn = f.rn + 1)
"""


@register(SQL_WEAK + "SELECT grp, event_id, g AS part FROM f")
def weak_join_timeout(m, spark, sf_dir):
    rows = m.select("event_id", F.col("grp").alias("user"), "arr_us")
    return stateful.weak_join_groups(rows, "user", "arr_us", "event_id", 3, 6 * HOUR_US).select(F.col("user").alias("grp"), "event_id", F.col("grp").alias("part"))


@register("""
WITH g AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY arr_us, event_id) - 1) // 3 AS g FROM m)
SELECT grp, g::BIGINT AS part, '[' || string_agg('{"k":' || (payload->>'$.k') || '}', ',' ORDER BY arr_us, event_id) || ']' AS payload FROM g GROUP BY 1, 2
""")
def weak_join_payload(m, spark, sf_dir):
    out = stateful.weak_join(m.withColumnRenamed("grp", "user"), "user", "arr_us", "event_id", "payload", 3)
    return out.select(F.col("user").alias("grp"), F.col("grp").alias("part"), "payload")


SQL_LOG = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY arr_us, event_id)::BIGINT AS \"offset\" FROM m)"


def _log(m):
    return event_log.append(m, "kind", "arr_us", "event_id")


@register(SQL_LOG + ' SELECT kind, event_id, "offset" FROM l')
def log_append(m, spark, sf_dir):
    return _log(m).select("kind", "event_id", "offset")


@register(SQL_LOG + ' SELECT kind, event_id, "offset" FROM l WHERE "offset" > 100 AND "offset" <= 150')
def log_read_since(m, spark, sf_dir):
    return event_log.since(_log(m), "kind", 100, 50).select("kind", "event_id", "offset")


@register(SQL_LOG + """, r AS (SELECT * FROM (SELECT *, max("offset") OVER (PARTITION BY kind) AS top FROM l) WHERE "offset" > top - 500)
SELECT kind, requested::BIGINT AS requested, base, requested + 1 < base AS gap FROM (SELECT kind, min("offset") AS base FROM r GROUP BY 1) CROSS JOIN (VALUES (0), (100), (1000), (5000)) c(requested)""")
def log_gap(m, spark, sf_dir):
    return event_log.gaps(event_log.retained(_log(m), "kind", 500), "kind", [0, 100, 1000, 5000]).select("kind", "requested", "base", "gap")


@register(SQL_LOG + ' SELECT kind, event_id, "offset" FROM (SELECT *, max("offset") OVER (PARTITION BY kind) AS top FROM l) WHERE "offset" > top - 500')
def log_retention_count(m, spark, sf_dir):
    return event_log.retained(_log(m), "kind", 500).select("kind", "event_id", "offset")


@register(SQL_LOG + """, s AS (SELECT kind, grp, max("offset") AS last_ack, max(arr_us) // 1000000 AS seen FROM l GROUP BY 1, 2),
n AS (SELECT max(arr_us) // 1000000 AS now FROM m), a AS (SELECT kind, min(last_ack) AS low FROM s, n WHERE now - seen < 300 GROUP BY 1),
k AS (SELECT l.*, a.low IS NULL OR ("offset" > a.low AND now - arr_us // 1000000 <= 86400) AS stays FROM l CROSS JOIN n LEFT JOIN a USING (kind)),
b AS (SELECT kind, min("offset") AS first FROM k WHERE stays GROUP BY 1)
SELECT kind, event_id, "offset" FROM k JOIN b USING (kind) WHERE "offset" >= first""")
def log_gc_min_ack(m, spark, sf_dir):
    log = _log(m).withColumn("stored_s", F.floor(F.col("arr_us") / 1_000_000))
    subscribers = log.groupBy("kind", "grp").agg(F.max("offset").alias("last_ack"), F.max("stored_s").alias("seen_s"))
    now = log.agg(F.max("stored_s")).scalar()
    return event_log.collect_garbage(log, "kind", subscribers, now, "stored_s").select("kind", "event_id", "offset")


SQL_BATCH = "WITH b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY arr_us, event_id)::BIGINT AS pos FROM m), c AS (SELECT *, (pos - 1) // {n} AS batch FROM b)"


def _batches(m, n):
    return delivery.batched(m, n, ["arr_us", "event_id"], ["grp"])


@register("""
WITH a AS (SELECT grp, min(event_id) AS low, max(event_id) AS top, min(event_id) FILTER (WHERE event_id % 17 = 0) AS bad FROM m GROUP BY 1)
SELECT grp, CASE WHEN coalesce(bad - 1, top) >= low THEN coalesce(bad - 1, top) ELSE -1 END AS committed, coalesce(bad, -1) AS first_nack FROM a
""")
def commit_prefix(m, spark, sf_dir):
    out = delivery.contiguous_acks(m, F.col("event_id") % 17 == 0, "event_id", "grp")
    return out.select("grp", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("committed", "first_nack")])


@register("""
WITH b AS (SELECT event_id // 128 AS batch, event_id % 4 AS part, max(event_id) + 1 AS top, max(CASE WHEN event_id % 1700 = 0 THEN 1 ELSE 0 END) AS bad FROM m GROUP BY 1, 2)
SELECT batch, part, CASE WHEN max(bad) OVER (PARTITION BY batch) = 0 THEN top ELSE -1 END AS next_offset FROM b
""")
def commit_partition_offsets(m, spark, sf_dir):
    rows = m.select("event_id", F.floor(F.col("event_id") / 128).alias("batch"), (F.col("event_id") % 4).alias("part"))
    out = delivery.partition_commits(rows, F.col("event_id") % 1700 == 0, "batch", "part", "event_id")
    return out.withColumn("next_offset", F.coalesce("next_offset", F.lit(-1)).cast("long"))


@register("WITH b AS (SELECT event_id // 100 AS batch, count(*)::BIGINT AS size FROM m WHERE event_id % 3 <> 0 GROUP BY 1) SELECT batch, size, (sum(size) OVER (ORDER BY batch) - size + 1001)::BIGINT AS first, (sum(size) OVER (ORDER BY batch) + 1000)::BIGINT AS last FROM b")
def seq_alloc(m, spark, sf_dir):
    return delivery.allocate(m.where(F.col("event_id") % 3 != 0).select(F.floor(F.col("event_id") / 100).alias("batch")), "batch", 1000)


SQL_LOCK = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN arr_us - 1 ELSE 9000000000000000 END"


@register(f"SELECT event_id, message_id FROM m WHERE {SQL_LOCK} IS NULL OR {SQL_LOCK} < 8000000000000000 ORDER BY message_id LIMIT 100")
def claim_queue(m, spark, sf_dir):
    lock = F.when(F.col("event_id") % 3 == 1, F.col("arr_us") - 1).when(F.col("event_id") % 3 == 2, F.lit(9_000_000_000_000_000))
    return delivery.claim(m.withColumn("locked", lock), "locked", F.lit(8_000_000_000_000_000), "message_id", 100).select("event_id", "message_id")


@register("SELECT event_id, message_id FROM m WHERE event_id % 2 = 1")
def idempotent_insert(m, spark, sf_dir):
    rows = m.select("event_id", "message_id")
    return delivery.insert_new(rows, rows.where(F.col("event_id") % 2 == 0), "message_id")


@register("SELECT event_id, turn FROM (SELECT event_id, 0 AS turn FROM m UNION ALL SELECT event_id, 1 FROM m WHERE event_id % 17 = 0)")
def nack_requeue(m, spark, sf_dir):
    rows = m.select("event_id")
    return delivery.requeue(rows, F.col("event_id") % 17 == 0, rows, "event_id").select("event_id", "turn")


QUERIES["request_reply"] = lambda spark, sf_dir: request_reply(spark, sf_dir)
ORACLES["request_reply"] = """
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, u.text AS request, a.text AS reply, a.text IS NULL AS timed_out FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
"""


def request_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat_ws("/", F.col("conv_id"), F.col("turn") - F.when(F.col("role") == "assistant", 1).otherwise(0))
    asked = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("request"), key.alias("key"))
    answered = c.where(F.col("role") == "assistant").select(F.col("text").alias("reply"), key.alias("key"), F.col("turn").alias("at"))
    return delivery.replies(asked, answered, "key", "turn", "at", 1).select("conv_id", "turn", "request", "reply", "timed_out")


@register("""
WITH s AS (SELECT grp, event_id, arr_us FROM m WHERE kind = 'signup'), p AS (SELECT grp, arr_us FROM m WHERE kind = 'purchase')
SELECT s.event_id, coalesce(min(p.arr_us), -1)::BIGINT AS reply_us, min(p.arr_us) IS NULL AS timed_out FROM s LEFT JOIN p ON p.grp = s.grp AND p.arr_us >= s.arr_us AND p.arr_us <= s.arr_us + 3600000000 GROUP BY 1
""")
def request_reply_timeout(m, spark, sf_dir):
    asked = m.where(F.col("kind") == "signup").select("grp", "event_id", "arr_us")
    answered = m.where(F.col("kind") == "purchase").select("grp", F.col("arr_us").alias("reply_us"))
    out = delivery.replies(asked, answered, "grp", "arr_us", "reply_us", HOUR_US)
    return out.select("event_id", F.coalesce("reply_us", F.lit(-1)).cast("long").alias("reply_us"), "timed_out")


@register("SELECT event_id, (event_id % 6)::BIGINT AS failures, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '100' WHEN 2 THEN '100,200' WHEN 3 THEN '100,200,400' ELSE '100,200,400,800' END AS sleeps FROM m")
def retry_schedule(m, spark, sf_dir):
    n = (F.col("event_id") % 6).cast("int")
    return m.select("event_id", n.cast("long").alias("failures"), F.array_join(delivery.retry_delays(n).cast("array<string>"), ",").alias("sleeps"))


@register(f"""
WITH b AS (SELECT event_id, event_id // 10 AS batch, {SQL_STATUS} AS status FROM m)
SELECT event_id, CASE WHEN event_id > min(CASE WHEN status = 'retryable' THEN event_id END) OVER (PARTITION BY batch) THEN 'retryable' ELSE status END AS final FROM b
""")
def batch_partial_abort(m, spark, sf_dir):
    rows = m.select("event_id", F.floor(F.col("event_id") / 10).alias("batch"), _status().alias("status"))
    return delivery.abort_after_retryable(rows, "status", "batch", "event_id").select("event_id", "final")


@register(SQL_BATCH.format(n=128) + " SELECT grp, batch, count(*)::BIGINT AS size FROM c GROUP BY 1, 2")
def batching_sizes(m, spark, sf_dir):
    return _batches(m.select("grp", "arr_us", "event_id"), 128).groupBy("grp", "batch").agg(F.count("*").alias("size"))


@register("SELECT event_id FROM m WHERE event_id % 1000 < 100")
def fault_injection(m, spark, sf_dir):
    return m.where(delivery.faulty(F.col("event_id"), 100)).select("event_id")


@register(SQL_BATCH.format(n=10) + " SELECT event_id, batch AS chunk FROM c")
def sqs_chunks(m, spark, sf_dir):
    return _batches(m, 10).select("event_id", F.col("batch").alias("chunk"))


@register("SELECT event_id, message_id, payload AS body FROM m")
def frame_roundtrip(m, spark, sf_dir):
    rows = _batches(m.select("event_id", "message_id", "payload", "grp", "arr_us"), 10)
    frames = rows.groupBy("grp", "batch").agg(F.to_json(F.collect_list(F.to_json(F.struct("event_id", "message_id", "payload")))).alias("value"))
    body = F.from_json("value", "event_id bigint, message_id string, payload string")
    return readers.decode_frame(frames).select(body["event_id"].alias("event_id"), body["message_id"].alias("message_id"), body["payload"].alias("body"))


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,' || event_id ELSE 'a,b,' || event_id END AS header, 'client-' || event_id || '-x' AS client, 'topic-' || kind AS durable FROM m")
def header_and_names(m, spark, sf_dir):
    e = F.col("event_id").cast("string")
    header = F.array(F.lit("a"), F.when(F.col("event_id") % 3 == 0, "").otherwise("b"), e)
    return m.select("event_id", M.joined_header(header).alias("header"), M.client_id(F.concat(F.lit("client_"), e, F.lit("!x"))).alias("client"), M.durable_name(F.concat(F.lit("topic."), F.col("kind"))).alias("durable"))


QUERIES["orders_cqrs"] = lambda spark, sf_dir: orders_cqrs(spark, sf_dir)
ORACLES["orders_cqrs"] = "SELECT o_orderkey, o_orderstatus, count(l_orderkey)::BIGINT AS n_lines, coalesce(sum(l_quantity), 0)::BIGINT AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def orders_cqrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order commands with their line events, projected to a read model; lines combine before they meet the orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return orders.join(lines, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("q", F.lit(0)).cast("long").alias("quantity"))


def queries():
    from routeflow import broker_queries, route_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql():
    from routeflow import broker_queries, route_queries  # noqa: F401

    return dict(ORACLES)
