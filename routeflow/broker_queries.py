"""More registered queries of the routing engine: brokers' rows, queues with leases, subscribers of a log, trees of endpoints.

Messages are made of ``events`` as in ``routeflow.queries``, in whose registry these enter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routeflow.functions import brokers
from routeflow.functions import messages as M
from routeflow.operators import delivery, event_log, sending
from routeflow.operators.numbering import numbered
from routeflow.plans import build, config
from routeflow.queries import HOUR_US, SQL_LOG, SQL_STATUS, _log, _status, register
from routeflow.sources import readers, writers


def number():
    return F.col("event_id")


def _body():
    return F.encode("payload", "UTF-8")


def _messages(m):
    return m.select("event_id", "message_id", _body().alias("payload"), F.create_map(F.lit(M.KIND), F.col("kind")).alias("metadata"), "arr_us")


SQL_HEX = "lpad(lower(to_hex(event_id)), 32, '0')"


@register(f"""
SELECT CASE event_id % 4 WHEN 0 THEN {SQL_HEX} WHEN 1 THEN lpad(lower(to_hex(event_id + 7)), 32, '0') WHEN 2 THEN md5(event_id::VARCHAR) ELSE {SQL_HEX} END AS message_id,
       payload AS body, CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE 'a' END AS header FROM m
""")
def nats_rows(m, spark, sf_dir):
    h, n = F.md5(number().cast("string")), number() % 4
    uuid = F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    none, one = F.array().cast("array<string>"), lambda c: F.array(c)
    headers = F.map_from_entries(F.array(
        F.struct(F.lit(M.CARRIED_ID).alias("key"), F.when(n == 0, one(F.col("message_id"))).otherwise(none).alias("value")),
        F.struct(F.lit("Nats-Msg-Id").alias("key"), F.when(n == 2, one(uuid)).when(n == 3, one(number().cast("string"))).otherwise(none).alias("value")),
        F.struct(F.lit("tags").alias("key"), F.when(number() % 2 == 0, F.array(F.lit("a"), F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit(""), F.lit(""))).alias("value")),
    ))
    rows = m.select(F.concat(F.lit("s."), "kind").alias("subject"), headers.alias("headers"), F.when(n == 1, number() + 7).alias("sequence"), _body().alias("payload"))
    return brokers.from_nats(rows).select("message_id", M.payload_text(F.col("payload")).alias("body"), F.element_at("metadata", "tags").alias("header"))


@register("SELECT message_id, payload AS body, kind, 's.' || kind AS subject FROM m")
def nats_roundtrip(m, spark, sf_dir):
    sent = brokers.to_nats(_messages(m), F.concat(F.lit("s."), F.col("metadata")[M.KIND]))
    subject = F.concat(F.lit("s."), F.col("metadata")[M.KIND])
    return brokers.from_nats(sent.withColumn("sequence", F.lit(None).cast("long"))).select("message_id", M.payload_text(F.col("payload")).alias("body"), F.col("metadata")[M.KIND].alias("kind"), subject.alias("subject"))


@register("SELECT md5('receipt-' || event_id) AS message_id, payload AS body, kind FROM m WHERE event_id % 9 <> 0")
def sqs_roundtrip(m, spark, sf_dir):
    """Bodies that can be sent, received again under receipts of the queue; what is no UTF-8 isn't sent."""
    rows = _messages(m).withColumn("payload", F.when(number() % 9 == 0, F.unhex(F.lit("FF00"))).otherwise(F.col("payload")))
    sent = brokers.to_sqs(rows).where(F.col("status").isNull())
    receipt = F.concat(F.lit("receipt-"), F.conv("message_id", 16, 10))
    return brokers.from_sqs(sent.select(receipt.alias("receipt"), "body", "attributes")).select("message_id", M.payload_text(F.col("payload")).alias("body"), F.col("metadata")[M.KIND].alias("kind"))


@register(f"SELECT CASE event_id % 3 WHEN 0 THEN {SQL_HEX} ELSE lpad(lower(to_hex(event_id + 5)), 32, '0') END AS message_id, payload AS body, kind, 'c' || event_id AS correlation, CASE WHEN event_id % 2 = 0 THEN 'answers' END AS reply_to FROM m")
def amqp_rows(m, spark, sf_dir):
    native = F.when(number() % 3 == 0, number().cast("string")).when(number() % 3 == 1, "no number")
    rows = m.select(native.alias("message_id"), (number() + 5).alias("delivery_tag"), F.concat(F.lit("c"), number()).alias("correlation_id"), F.when(number() % 2 == 0, "answers").alias("reply_to"), F.create_map(F.lit(M.KIND), F.col("kind")).alias("headers"), _body().alias("payload"))
    sent = brokers.to_amqp(brokers.from_amqp(rows))
    return sent.select("message_id", M.payload_text(F.col("payload")).alias("body"), F.element_at("headers", M.KIND).alias("kind"), F.col("correlation_id").alias("correlation"), "reply_to")


@register("SELECT message_id, payload AS body, kind, version FROM m CROSS JOIN (VALUES (3), (5)) v(version)")
def mqtt_roundtrip(m, spark, sf_dir):
    out = None
    for version in (3, 5):
        rows = brokers.from_mqtt(brokers.to_mqtt(_messages(m), version).withColumn("topic", F.lit("t")))
        rows = rows.select("message_id", M.payload_text(F.col("payload")).alias("body"), F.element_at("metadata", M.KIND).alias("kind"), F.lit(version).alias("version"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(f"""
SELECT {SQL_HEX} AS message_id, kind AS path, payload AS body, CASE WHEN event_id % 7 = 0 THEN 500 WHEN event_id % 11 = 0 THEN 504 WHEN event_id % 2 = 0 THEN 200 ELSE 202 END AS code FROM m
""")
def http_requests(m, spark, sf_dir):
    headers = F.create_map(F.lit(brokers.HTTP_ID), F.concat(F.lit("0x"), F.hex("event_id")))
    rows = m.select(F.lit("POST").alias("method"), F.col("kind").alias("path"), F.lit(None).cast("string").alias("query"), F.lit("p").alias("peer"), headers.alias("headers"), _body().alias("body"))
    got = brokers.from_http(rows).withColumn("n", F.conv("message_id", 16, 10).cast("long"))
    status = F.when(F.col("n") % 7 == 0, M.NONRETRYABLE).when(F.col("n") % 11 == 0, None).otherwise(M.ACK)
    code = brokers.http_status(status, F.when(F.col("n") % 2 == 0, F.lit("reply")))
    return got.select("message_id", F.element_at("metadata", "http_path").alias("path"), M.payload_text(F.col("payload")).alias("body"), code.alias("code"))


@register("SELECT message_id, payload AS body, form, CASE WHEN form = 'raw' THEN 'raw' ELSE kind END AS mark FROM m CROSS JOIN (VALUES ('normal'), ('json'), ('raw')) f(form)")
def document_roundtrip(m, spark, sf_dir):
    out = None
    for form in ("normal", "json", "raw"):
        rows = brokers.from_documents(brokers.to_documents(_messages(m), form))
        mark = F.coalesce(F.try_element_at("metadata", F.lit(M.KIND)), F.try_element_at("metadata", F.lit(M.FORMAT)))
        rows = rows.select("message_id", M.payload_text(F.col("payload")).alias("body"), F.lit(form).alias("form"), mark.alias("mark"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("SELECT message_id, CASE WHEN event_id % 9 <> 0 THEN payload END AS body, CASE WHEN event_id % 9 = 0 THEN 'nonretryable' ELSE 'sent' END AS status FROM m")
def sqs_bodies(m, spark, sf_dir):
    rows = m.select("message_id", F.when(number() % 9 == 0, F.unhex(F.lit("FF00"))).otherwise(_body()).alias("payload"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    return brokers.to_sqs(rows).select("message_id", "body", F.coalesce("status", F.lit("sent")).alias("status"))


@register(f"WITH b AS (SELECT event_id // 20 AS batch, {SQL_STATUS} AS status FROM m WHERE event_id % 5 <> 0) SELECT batch, (count(*) FILTER (WHERE status <> 'ack')) = 0 AS committed FROM b GROUP BY 1")
def unit_of_work(m, spark, sf_dir):
    return brokers.unit_of_work(m.where(number() % 5 != 0).select(F.floor(number() / 20).alias("batch"), _status().alias("status")), "batch")


SQL_QUEUE = "q AS (SELECT event_id, message_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 500 ELSE 2000 END AS locked FROM m), c AS (SELECT message_id FROM q WHERE locked IS NULL OR locked < 1000 ORDER BY message_id LIMIT 200)"


def _queue(m):
    queue = m.select("event_id", "message_id", F.when(number() % 3 == 1, 500).when(number() % 3 == 2, 2000).cast("long").alias("locked"))
    return queue, delivery.claim(queue, "locked", F.lit(1000), "message_id", 200)


@register(f"WITH {SQL_QUEUE} SELECT event_id, coalesce(CASE WHEN message_id IN (SELECT message_id FROM c) THEN 61000 ELSE locked END, -1)::BIGINT AS locked FROM q")
def claim_lease(m, spark, sf_dir):
    queue, claimed = _queue(m)
    return delivery.leased(queue, claimed, "message_id", "locked", F.lit(1000)).select("event_id", F.coalesce("locked", F.lit(-1)).cast("long").alias("locked"))


@register(f"""
WITH {SQL_QUEUE} SELECT event_id, coalesce(CASE WHEN message_id IN (SELECT message_id FROM c) THEN NULL ELSE locked END, -1)::BIGINT AS locked FROM q
WHERE message_id NOT IN (SELECT message_id FROM c) OR event_id % 17 = 0
""")
def claim_settle(m, spark, sf_dir):
    queue, claimed = _queue(m)
    outcomes = claimed.select("message_id", F.when(number() % 17 == 0, M.RETRYABLE).otherwise(M.ACK).alias("status"))
    held = delivery.leased(queue, claimed, "message_id", "locked", F.lit(1000))
    return delivery.settled(held, outcomes, "message_id", "locked").select("event_id", F.coalesce("locked", F.lit(-1)).cast("long").alias("locked"))


@register("""
WITH b AS (SELECT event_id // 50 AS seq, max(arr_us % 100000)::BIGINT AS ready FROM m GROUP BY 1)
SELECT seq, ready, max(ready) OVER (ORDER BY seq)::BIGINT AS committed FROM b
""")
def commit_order(m, spark, sf_dir):
    batches = m.groupBy(F.floor(number() / 50).alias("seq")).agg(F.max(F.col("arr_us") % 100_000).alias("ready"))
    return delivery.commit_order(batches, "ready")


SQL_SUBS = SQL_LOG + """, s AS (SELECT kind, who, max(ack) AS last_ack, max(seen) AS seen_s FROM (
  SELECT kind, 's' || grp % 3 AS who, 0 AS ack, max(arr_us) // 1000000 AS seen FROM l GROUP BY 1, 2
  UNION ALL SELECT kind, 's' || grp % 3, "offset", arr_us // 1000000 FROM l WHERE event_id % 5 = 0) GROUP BY 1, 2)"""


def _subscribers(log):
    who = F.concat(F.lit("s"), F.col("grp") % 3)
    rows = log.select("kind", who.alias("who"), "offset", F.floor(F.col("arr_us") / 1_000_000).alias("seen_s"), "event_id")
    reads = rows.groupBy("kind", "who").agg(F.max("seen_s").alias("seen_s"))
    none = reads.where("false").withColumn("last_ack", F.lit(0).cast("long"))
    known = event_log.registered(none, reads, ["kind", "who"])
    return event_log.acknowledge(known, rows.where(number() % 5 == 0).select("kind", "who", "offset", "seen_s"), ["kind", "who"])


@register(SQL_SUBS + " SELECT kind, who, last_ack::BIGINT AS last_ack, seen_s::BIGINT AS seen_s FROM s")
def log_subscribers(m, spark, sf_dir):
    return _subscribers(_log(m)).select("kind", "who", F.col("last_ack").cast("long").alias("last_ack"), F.col("seen_s").cast("long").alias("seen_s"))


@register(SQL_SUBS + ' SELECT l.kind, who, event_id, "offset" FROM l JOIN (SELECT kind, who, last_ack // 2 AS low FROM s) c ON c.kind = l.kind WHERE "offset" > low AND "offset" <= low + 20')
def log_subscriber_reads(m, spark, sf_dir):
    log = _log(m)
    at = _subscribers(log).withColumn("last_ack", F.floor(F.col("last_ack") / 2))
    return event_log.since_each(log, "kind", at, "who", 20).select("kind", "who", "event_id", "offset")


@register(SQL_LOG + f""", b AS (SELECT kind, grp % 3 AS who, "offset" // 64 AS batch, "offset", {SQL_STATUS} AS status FROM l WHERE event_id % 17 <> 0 OR "offset" % 2 = 0)
SELECT kind, who, batch::BIGINT AS batch, max("offset")::BIGINT AS acked FROM b GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE status <> 'ack') = 0""")
def log_commit_batches(m, spark, sf_dir):
    rows = _log(m).where((number() % 17 != 0) | (F.col("offset") % 2 == 0)).select("kind", (F.col("grp") % 3).alias("who"), F.floor(F.col("offset") / 64).alias("batch"), "offset", _status().alias("status"))
    return event_log.committed(rows, ["kind", "who"], "batch").withColumnRenamed("offset", "acked")


@register(SQL_LOG + """, n AS (SELECT max(arr_us) // 1000000 AS now FROM m)
, f AS (SELECT kind, min("offset") AS first FROM l, n WHERE "offset" > 40 AND now - arr_us // 1000000 <= 86400 GROUP BY 1)
SELECT l.kind, event_id, "offset" FROM l LEFT JOIN f ON f.kind = l.kind WHERE first IS NULL OR "offset" < first""")
def log_dropped(m, spark, sf_dir):
    log = _log(m).withColumn("stored_s", F.floor(F.col("arr_us") / 1_000_000))
    now = log.agg(F.max("stored_s")).scalar()
    subscribers = log.select("kind").distinct().withColumns({"last_ack": F.lit(40), "seen_s": now})
    return event_log.marked_garbage(log, "kind", subscribers, now, "stored_s").where("removable").select("kind", "event_id", "offset")


@register("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN payload END AS reply FROM m")
def paired_replies(m, spark, sf_dir):
    rows = m.select("event_id", "message_id", "payload")
    return sending.paired_replies(rows.select("event_id", "message_id"), rows.where(number() % 3 != 0)).select("event_id", "reply")


@register("SELECT event_id, kind AS type, 'x' AS note, 'raw' AS form FROM m")
def metadata_set(m, spark, sf_dir):
    meta = M.with_metadata(M.with_kind(F.create_map(F.lit(M.KIND), F.lit("old"), F.lit("note"), F.lit("y")), "new"), note="x", **{M.FORMAT: M.RAW})
    meta = F.map_concat(F.map_filter(meta, lambda k, _: k != M.KIND), F.create_map(F.lit(M.KIND), F.col("kind")))
    return m.select("event_id", meta[M.KIND].alias("type"), meta["note"].alias("note"), meta[M.FORMAT].alias("form"))


@register("SELECT count(*)::BIGINT AS n, count(DISTINCT message_id)::BIGINT AS ids, 'hello' AS body FROM m")
def static_source(m, spark, sf_dir):
    rows = readers.static(spark, "hello", m.count())
    return rows.agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("ids"), F.max(M.payload_text(F.col("payload"))).alias("body"))


@register("SELECT event_id, '\"say \\\"hi\\\"\\n\"' AS reply FROM m".replace("\\n", "\\\\n").replace('\\"hi', '\\\\"hi').replace('hi\\"', 'hi\\\\"').replace("\\\\", "\\"))
def static_replies(m, spark, sf_dir):
    return writers.static_reply(_messages(m), 'say "hi"\n').select("event_id", M.payload_text(F.col("payload")).alias("reply"))


@register("""
WITH g AS (SELECT event_id, payload, row_number() OVER (ORDER BY event_id) - 1 AS n FROM m)
SELECT (n // 4)::BIGINT AS part, '[' || string_agg('"' || event_id || '\\t\\r\\n\\u0001\\"\\\\é"', ',' ORDER BY event_id) || ']' AS merged FROM g GROUP BY 1
""".replace("\\\\t", "\\t"))
def merged_control_characters(m, spark, sf_dir):
    text = F.concat(number().cast("string"), F.lit('\t\r\n\x01"\\é'))
    rows = numbered(m.select("event_id"), [], ["event_id"], "n").select(F.floor((F.col("n") - 1) / 4).alias("part"), "event_id", M.as_json_element(text).alias("e"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "e"))), lambda x: x["e"])
    return rows.groupBy("part").agg(M.merged_array(parts).alias("merged"))


YAML = """
r:
  input: {memory: {topic: in}}
  output:
    middlewares: [{dlq: {endpoint: {memory: {topic: dead}}}}]
    switch:
      metadata_key: kind
      cases:
        purchase: {memory: {topic: orders}, middlewares: [{retry: {max_attempts: 3}}, {delay: {delay_ms: 5}}]}
        error: {fanout: [{memory: {topic: alerts}, middlewares: [{delay: {delay_ms: 7}}]}, {memory: {topic: all}}]}
      default: {memory: {topic: rest}}
"""


def _tries(df, n):
    """Succeeds at the attempt that the event's number asks for; every 13th never does."""
    return df.withColumns({"status": F.when(number() % 13 == 0, M.NONRETRYABLE).when(number() % 5 >= n, M.RETRYABLE).otherwise(M.ACK), "payload": F.encode(F.concat(F.lit(f"{n}:"), M.payload_text(F.col("payload"))), "UTF-8")})


@register("""
SELECT event_id, 'memory:orders' AS sink, event_id % 5 + 1 AS attempts, (event_id % 5 + 1) || ':' || payload AS body, arr_us + 5000 AS at FROM m WHERE kind = 'purchase' AND event_id % 13 <> 0 AND event_id % 5 < 3
UNION ALL SELECT event_id, 'memory:dead', CASE WHEN event_id % 13 = 0 THEN 1 ELSE 3 END, CASE WHEN event_id % 13 = 0 THEN '1:' ELSE '3:' END || payload, arr_us + 5000 FROM m WHERE kind = 'purchase' AND (event_id % 13 = 0 OR event_id % 5 >= 3)
UNION ALL SELECT event_id, s.sink, 1, payload, arr_us + s.late FROM m CROSS JOIN (VALUES ('memory:alerts', 7000), ('memory:all', 0)) s(sink, late) WHERE kind = 'error'
UNION ALL SELECT event_id, 'memory:rest', 1, payload, arr_us FROM m WHERE kind NOT IN ('purchase', 'error')
""")
def route_tree(m, spark, sf_dir):
    r = config.load(YAML, {})["r"]
    cases = {k: (e.with_handler(_tries) if k == "purchase" else e) for k, e in r.output.options["cases"].items()}
    r = config.Route(r.input, config.Endpoint("switch", {**r.output.options, "cases": cases}, r.output.middlewares))
    out = build.plan(_messages(m), r)
    return out.select("event_id", "sink", F.col("attempts").cast("long").alias("attempts"), M.payload_text(F.col("payload")).alias("body"), F.col("arr_us").alias("at"))


@register("""
SELECT event_id, CASE WHEN kind = 'signup' THEN 'memory:o' WHEN kind = 'view' THEN 'memory:o' ELSE 'memory:d' END AS sink,
       CASE kind WHEN 'signup' THEN 'k=' || (payload->>'$.k') WHEN 'view' THEN 'fallback' ELSE payload END AS body
FROM m WHERE kind <> 'click' AND (kind IN ('signup', 'view') OR event_id % 2 = 0)
""")
def route_handlers(m, spark, sf_dir):
    raw = lambda df: df.where((number() % 2 == 0) | (F.col("metadata")[M.KIND] == "view")).withColumns({"payload": F.when(F.col("metadata")[M.KIND] == "view", F.encode(F.lit("fallback"), "UTF-8")).otherwise(F.col("payload")), "status": F.when(F.col("metadata")[M.KIND] == "view", M.ACK).otherwise(M.NONRETRYABLE)})
    r = config.load("r: {input: {memory: {topic: i}}, output: {memory: {topic: o}, middlewares: [{dlq: {endpoint: {memory: {topic: d}}}}]}}", {})["r"].with_handler(raw)
    r = r.add_handlers({"signup": ("k long", lambda p, _: F.concat(F.lit("k="), p["k"])), "click": ("k long", lambda p, _: None)})
    return build.plan(_messages(m), r).select("event_id", "sink", M.payload_text(F.col("payload")).alias("body"))


@register("SELECT message_id, payload AS body, frame FROM (SELECT message_id, payload, ((row_number() OVER (ORDER BY message_id) - 1) // 10)::BIGINT AS frame FROM m)")
def frames_of_envelopes(m, spark, sf_dir):
    frames = writers.to_frames(_messages(m), 10, ["message_id"])
    lines = readers.decode_frame(frames)
    body = F.from_json("value", "message_id string, payload string")
    return lines.select(body["message_id"].alias("message_id"), body["payload"].alias("body"), "frame")


@register("SELECT event_id, kind, turn, row_number() OVER (PARTITION BY kind ORDER BY turn, event_id)::BIGINT AS pos FROM (SELECT event_id, kind, 0 AS turn FROM m UNION ALL SELECT event_id, kind, 1 FROM m WHERE event_id % 17 = 0)")
def nack_requeue_order(m, spark, sf_dir):
    rows = m.select("event_id", "kind")
    queue = delivery.requeue(rows, number() % 17 == 0, rows, "event_id")
    return numbered(queue, ["kind"], ["turn", "place"], "pos").select("event_id", "kind", "turn", "pos")


@register("""
WITH --recursive
a AS (SELECT grp, arr_us FROM m WHERE kind = 'purchase'),
q AS (SELECT s.event_id, s.grp, s.arr_us, min(a.arr_us) AS answer FROM m s LEFT JOIN a ON a.grp = s.grp AND a.arr_us >= s.arr_us WHERE kind = 'view' GROUP BY ALL),
o AS (SELECT *, least(coalesce(answer, arr_us + 21600000000), arr_us + 21600000000) AS until, row_number() OVER (PARTITION BY grp ORDER BY arr_us, event_id) AS rn FROM q),
f AS (SELECT event_id, grp, rn, arr_us, answer, until AS busy, true AS waits FROM o WHERE rn = 1
      UNION ALL SELECT o.event_id, o.grp, o.rn, o.arr_us, o.answer, CASE WHEN o.arr_us > f.busy THEN o.until ELSE f.busy END, o.arr_us > f.busy FROM f JOIN o ON o.grp = f.grp AND o.rn = f.rn + 1)
SELECT event_id, CASE WHEN NOT waits THEN 'duplicate' WHEN answer <= arr_us + 21600000000 THEN 'answered' ELSE 'timed_out' END AS outcome,
       CASE WHEN waits AND answer <= arr_us + 21600000000 THEN answer ELSE -1 END::BIGINT AS answered FROM f
""")
def exchanges_one_to_one(m, spark, sf_dir):
    asks = m.where(F.col("kind") == "view").select("event_id", "grp", "arr_us")
    gives = m.where(F.col("kind") == "purchase").select("grp", F.col("arr_us").alias("answered"))
    out = delivery.exchanged(asks, gives, "grp", "arr_us", "answered", 6 * HOUR_US, "event_id")
    return out.select("event_id", "outcome", F.coalesce("answered", F.lit(-1)).cast("long").alias("answered"))


@register("""
WITH a AS (SELECT grp, arr_us, event_id FROM m WHERE kind = 'purchase'), q AS (SELECT grp, arr_us, event_id FROM m WHERE kind = 'signup'),
j AS (SELECT q.event_id, min(a.arr_us) AS t FROM q LEFT JOIN a ON a.grp = q.grp AND a.arr_us >= q.arr_us AND a.arr_us <= q.arr_us + 86400000000 GROUP BY 1)
SELECT event_id, coalesce(t, -1)::BIGINT AS answered, t IS NULL AS timed_out FROM j
""")
def first_reply_of_many(m, spark, sf_dir):
    asks = m.where(F.col("kind") == "signup").select("event_id", "grp", "arr_us")
    gives = m.where(F.col("kind") == "purchase").select("grp", F.col("arr_us").alias("answered"))
    out = delivery.replies(asks, gives, "grp", "arr_us", "answered", 24 * HOUR_US)
    return out.select("event_id", F.coalesce("answered", F.lit(-1)).cast("long").alias("answered"), "timed_out")
