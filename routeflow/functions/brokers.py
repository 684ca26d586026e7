"""What brokers carry besides the payload, as columns: their rows to messages, and messages to their rows.

A connector (or a test) brings the rows; the ladders by which an id is found, the headers that become metadata and the
limits of each broker are here. Where no rung of a ladder holds, the id is a digest of what tells the row from others, so
that a task that runs again gives the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeflow.functions import messages as M

#: Properties in which brokers carry a message's native id, and the formats of a stored document.
AMQP_ID, HTTP_ID, TYPE, JSON = "amqp_message_id", "message-id", "type", "json"


def _uuid(text: Column) -> Column:
    return F.when(text.rlike(M.UUID), F.lower(F.regexp_replace(text, "-", "")))


def _hex(text: Column) -> Column:
    return F.when(text.rlike("^[0-9a-fA-F]{1,32}$"), F.lpad(F.lower(text), 32, "0"))


def _made(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *parts))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def _without(headers: Column, *names: str) -> Column:
    return F.map_filter(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")), lambda k, _: ~k.isin(*names))


def from_nats(rows: DataFrame) -> DataFrame:
    """(subject, headers map of string to array, sequence, payload): the carried id, the stream's sequence, the client's id.
    A header's values are joined with commas, empty ones left out."""
    first = lambda name: F.try_element_at(F.try_element_at("headers", F.lit(name)), F.lit(1))
    native = first("Nats-Msg-Id")
    found = F.coalesce(_hex(first(M.CARRIED_ID)), M.hex_id(F.col("sequence")), _uuid(native), M.id_from_decimal(native), _made(F.col("subject"), F.hex("payload")))
    metadata = F.transform_values(F.coalesce("headers", F.expr("cast(map() as map<string,array<string>>)")), lambda _, v: M.joined_header(v))
    return rows.select(found.alias("message_id"), "payload", metadata.alias("metadata"))


def to_nats(messages: DataFrame, subject: Column) -> DataFrame:
    """(subject, headers, payload): the metadata and the id as headers of one value each."""
    headers = F.transform_values(_without(F.col("metadata"), M.CARRIED_ID), lambda _, v: F.array(v))
    carried = F.create_map(F.lit(M.CARRIED_ID), F.array("message_id"))
    return messages.select(subject.alias("subject"), F.map_concat(headers, carried).alias("headers"), "payload")


def from_amqp(rows: DataFrame) -> DataFrame:
    """(message_id, delivery_tag, correlation_id, reply_to, headers, payload): the property if it is a UUID or a number, else the tag."""
    native = F.col("message_id")
    carried = {AMQP_ID: native, M.CORRELATION: F.col("correlation_id"), M.REPLY_TO: F.col("reply_to")}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in carried.items()]), lambda e: e["value"].isNotNull())
    metadata = F.map_concat(_without(F.col("headers"), *carried), F.map_from_entries(pairs))
    return rows.select(F.coalesce(_uuid(native), M.id_from_decimal(native), M.hex_id(F.col("delivery_tag"))).alias("message_id"), "payload", metadata.alias("metadata"))


def to_amqp(messages: DataFrame) -> DataFrame:
    """Persistent messages: the id, correlation and reply address as properties, the rest of the metadata as headers."""
    meta = F.col("metadata")
    return messages.select(
        "message_id", F.lit(2).alias("delivery_mode"), _header(meta, M.CORRELATION).alias("correlation_id"), _header(meta, M.REPLY_TO).alias("reply_to"), _without(meta, M.CORRELATION, M.REPLY_TO, AMQP_ID).alias("headers"), "payload"
    )


def from_mqtt(rows: DataFrame) -> DataFrame:
    """(topic, properties or null, payload): the user property of version 5; without properties (version 3) the payload may
    be a whole envelope."""
    envelope = F.from_json(M.payload_text(F.col("payload")), "message_id string, payload string, metadata map<string,string>")
    old = F.col("properties").isNull() & envelope["message_id"].isNotNull() & envelope["payload"].isNotNull()
    found = F.when(old, M.id_from_text(envelope["message_id"])).otherwise(_hex(_header(F.col("properties"), M.CARRIED_ID)))
    payload = F.when(old, F.encode(envelope["payload"], "UTF-8")).otherwise(F.col("payload"))
    metadata = F.when(old, _without(envelope["metadata"])).otherwise(_without(F.col("properties"), M.CARRIED_ID))
    return rows.select(F.coalesce(found, _made(F.col("topic"), F.hex("payload"))).alias("message_id"), payload.alias("payload"), metadata.alias("metadata"))


def to_mqtt(messages: DataFrame, version: int = 5) -> DataFrame:
    """Version 5 carries the id and the metadata as user properties; version 3 the envelope, where there is metadata."""
    if version == 5:
        return messages.select(F.map_concat(_without(F.col("metadata"), M.CARRIED_ID), F.create_map(F.lit(M.CARRIED_ID), F.col("message_id"))).alias("properties"), "payload")
    whole = F.to_json(F.struct("message_id", M.payload_text(F.col("payload")).alias("payload"), "metadata"))
    return messages.select(F.lit(None).cast("map<string,string>").alias("properties"), F.when(F.size("metadata") > 0, F.encode(whole, "UTF-8")).otherwise(F.col("payload")).alias("payload"))


def from_http(rows: DataFrame, id_header: str = HTTP_ID) -> DataFrame:
    """(method, path, query, peer, headers, body): request facts and headers as metadata; the id from a header."""
    facts = {"http_method": "method", "http_path": "path", "http_query": "query", "http_peer_addr": "peer"}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in facts.items()]), lambda e: e["value"].isNotNull())
    metadata = F.map_concat(_without(F.col("headers"), *facts), F.map_from_entries(pairs))
    found = M.id_from_text(_header(F.col("headers"), id_header))
    return rows.select(F.coalesce(found, _made(F.col("method"), F.col("path"), F.col("query"), F.hex("body"))).alias("message_id"), F.col("body").alias("payload"), metadata.alias("metadata"))


def http_status(status: Column, reply: Column) -> Column:
    """What a caller gets: 200 with a reply, 202 without, 500 for a failure, 504 if nothing came in time (null)."""
    return F.when(status.isNull(), 504).when(status.isin(M.RETRYABLE, M.NONRETRYABLE), 500).when(reply.isNotNull(), 200).otherwise(202)


def from_documents(rows: DataFrame) -> DataFrame:
    """(_id, body, metadata) of a document store: a UUID is the id, any other ``_id`` gets one; without envelope the body is raw."""
    raw = F.col("metadata").isNull()
    metadata = F.when(raw, F.create_map(F.lit(M.FORMAT), F.lit(M.RAW))).otherwise(_without(F.col("metadata"), TYPE))
    return rows.select(F.coalesce(_uuid(F.col("_id")), _made(F.col("_id"))).alias("message_id"), F.encode("body", "UTF-8").alias("payload"), metadata.alias("metadata"))


def to_documents(messages: DataFrame, form: str = "normal") -> DataFrame:
    """(_id, body, metadata): ``normal`` keeps the envelope, ``json`` marks bodies that are JSON, ``raw`` keeps the body alone."""
    text = M.payload_text(F.col("payload"))
    at = lambda a, n: F.substring("message_id", a, n)
    uuid = F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12))
    meta = F.col("metadata")
    if form == "raw":
        meta = F.lit(None).cast("map<string,string>")
    elif form == "json":
        meta = F.when(F.try_parse_json(text).isNotNull(), F.map_concat(_without(meta, TYPE), F.create_map(F.lit(TYPE), F.lit(JSON)))).otherwise(meta)
    return messages.select(uuid.alias("_id"), text.alias("body"), meta.alias("metadata"))


def to_sqs(messages: DataFrame) -> DataFrame:
    """(message_id, body, attributes, status, error): bodies must be UTF-8; what isn't can't be sent, now or later."""
    text = F.try_validate_utf8(F.col("payload").cast("string"))
    return messages.select("message_id", text.alias("body"), F.col("metadata").alias("attributes"), F.when(text.isNull(), M.NONRETRYABLE).alias("status"), F.when(text.isNull(), "body is not UTF-8").alias("error"))


def from_sqs(rows: DataFrame) -> DataFrame:
    """(receipt, body, attributes): redelivery gives another receipt, and so another id."""
    return rows.select(_made(F.col("receipt")).alias("message_id"), F.encode("body", "UTF-8").alias("payload"), _without(F.col("attributes")).alias("metadata"))


def unit_of_work(outcomes: DataFrame, batch: str, status: str = "status") -> DataFrame:
    """(batch, committed): a batch under one syncpoint is committed whole, or backed out whole if a message failed."""
    return outcomes.groupBy(batch).agg((F.count_if(F.col(status).isin(M.RETRYABLE, M.NONRETRYABLE)) == 0).alias("committed"))
