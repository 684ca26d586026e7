"""The canonical message as columns: schemas, constructors, id derivation and the JSON envelope.

A message is (message_id: 32 lower-case hex digits, payload: binary, metadata: map of strings).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("message_id", T.StringType(), False), T.StructField("payload", T.BinaryType(), False), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), False)])
EVENT = T.StructType([*MESSAGE.fields, T.StructField("offset", T.LongType()), T.StructField("stored_at_ms", T.LongType()), T.StructField("topic", T.StringType())])
OUTCOME = T.StructType([*MESSAGE.fields, T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])

#: What keys begin with that go over the wire, reserved metadata keys, and the marker of payloads without an envelope.
WIRE = "mq_bridge"
KIND, FORMAT, RAW, CORRELATION, REPLY_TO, CARRIED_ID = "kind", f"{WIRE}.original_format", "raw", "correlation_id", "reply_to", f"{WIRE}.message_id"
#: Outcomes of handling a message.
ACK, RESPONSE, RETRYABLE, NONRETRYABLE = "ack", "response", "retryable", "nonretryable"

UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def hex_id(number: Column) -> Column:
    """A non-negative number as 32 hex digits."""
    return F.lpad(F.lower(F.hex(number)), 32, "0")


def id_from_decimal(text: Column) -> Column:
    """Digits of a number below 2**128 as 32 hex digits; null for all else. Four limbs of 32 bits take one digit after another."""
    limbs = range(4)
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"l{k}") for k in limbs], F.lit(0).cast("bigint").alias("over"))

    def step(acc: Column, digit: Column) -> Column:
        carry, out = digit.cast("bigint"), []
        for k in limbs:
            value = acc[f"l{k}"] * 10 + carry
            out.append(value.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"l{k}"))
            carry = F.shiftright(value, 32)
        return F.struct(*out, (acc["over"] + carry).alias("over"))

    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    whole = F.aggregate(F.split(digits, "(?<=.)(?=.)"), zero, step, lambda acc: F.when(acc["over"] == 0, F.concat(*[F.lpad(F.lower(F.hex(acc[f"l{k}"])), 8, "0") for k in reversed(limbs)])))
    return F.when(text.rlike("^[0-9]+$") & (F.length(digits) <= 39), whole)


def id_from_text(text: Column) -> Column:
    """UUID, then hex with an optional 0x, then decimal below 2**128; null if none reads it. Digits alone are hex up to 32 of them."""
    bare = F.regexp_replace(text, "^(0x)+", "")
    return (
        F.when(text.rlike(UUID), F.lower(F.regexp_replace(text, "-", "")))
        .when(bare.rlike("^[0-9a-fA-F]{1,32}$"), F.lpad(F.lower(bare), 32, "0"))
        .when(text.rlike("^[0-9]{33,39}$"), id_from_decimal(text))
    )


def id_from_json(payload: Column) -> Column:
    """The first present of the fields message_id, id, _id decides, even if it can't be read; null then. Numbers are read
    from -2**63 (in two's complement) to 2**64 - 1."""
    def read(name: str) -> Column:
        value = F.get_json_object(payload, f"$.{name}")
        number = value.rlike("^-?[0-9]+$") & ~F.coalesce(F.regexp_like(payload, F.lit(f'"{name}"\\s*:\\s*"')), F.lit(False))
        oid = F.get_json_object(payload, f"$.{name}.$oid")
        long = value.try_cast("long")
        unsigned = F.when(value.rlike("^[0-9]{19,20}$") & (F.lpad(value, 20, "0") <= F.lit(str(2**64 - 1))), id_from_decimal(value))
        read = F.when(long < 0, F.lpad(F.lower(F.hex(long)), 32, "f")).when(long.isNotNull(), hex_id(long)).otherwise(unsigned)
        return F.when(oid.isNotNull(), F.lpad(F.lower(oid), 32, "0")).when(number, read).otherwise(id_from_text(value))

    present = [F.get_json_object(payload, f"$.{n}").isNotNull() for n in ("message_id", "id", "_id")]
    return F.when(present[0], read("message_id")).when(present[1], read("id")).when(present[2], read("_id"))


def kafka_id(key: Column, header: Column, partition: Column, offset: Column) -> Column:
    """A 16-byte key, then a header, then partition and offset."""
    placed = F.lpad(F.concat(F.lpad(F.lower(F.hex(partition)), 16, "0"), F.lpad(F.lower(F.hex(offset)), 16, "0")), 32, "0")
    return F.coalesce(F.when(F.octet_length(key) == 16, F.lower(F.hex(key))), id_from_text(header), placed)


def with_metadata(metadata: Column, **pairs: str) -> Column:
    """Pairs set over those the map holds already."""
    names = F.array(*[F.lit(k) for k in pairs])
    rest = F.map_filter(metadata, lambda k, _: ~F.array_contains(names, k))
    return F.map_concat(rest, F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]))


def with_kind(metadata: Column, kind: str) -> Column:
    return with_metadata(metadata, **{KIND: kind})


def payload_text(payload: Column) -> Column:
    return F.decode(payload, "UTF-8")


def to_envelope(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One line a message, as ``value``: its JSON envelope, or the bare payload where it came without one; and columns to keep."""
    whole = F.to_json(F.struct("message_id", payload_text(F.col("payload")).alias("payload"), "metadata"))
    return messages.select(F.when(F.try_element_at("metadata", F.lit(FORMAT)) == RAW, payload_text(F.col("payload"))).otherwise(whole).alias("value"), *(keep or ()))


def from_lines(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines as messages, with columns to keep: envelopes are unwrapped; all else becomes a raw payload with an id of its own content."""
    parsed = F.from_json(value, "message_id string, payload string, metadata map<string,string>")
    rows = lines.select(F.col(value).alias("value"), parsed.alias("e"), *keep)
    ok = F.col("e.message_id").isNotNull() & F.col("e.payload").isNotNull()
    return rows.select(
        F.when(ok, F.coalesce(id_from_text(F.col("e.message_id")), F.md5("value"))).otherwise(F.md5("value")).alias("message_id"),
        F.encode(F.when(ok, F.col("e.payload")).otherwise(F.col("value")), "UTF-8").alias("payload"),
        F.when(ok, F.coalesce("e.metadata", F.expr("cast(map() as map<string,string>)"))).otherwise(F.create_map(F.lit(FORMAT), F.lit(RAW))).alias("metadata"),
        *keep,
    )


def as_json_element(text: Column) -> Column:
    """A payload as an element of a JSON array: compact JSON, or a JSON string if it isn't JSON."""
    # the parser takes a first value and ignores what follows; what closes one of the two wrappings early breaks the other
    whole, other = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = other.isNotNull() & (F.size(F.try_variant_get(whole, "$", "array<variant>")) == 1)
    array = F.to_json(whole)
    return F.coalesce(F.when(one, F.substring(array, F.lit(2), F.length(array) - 2)), as_json_string(text))


def as_json_string(text: Column) -> Column:
    """Text as a JSON string, with every character escaped that must be: Spark writes it as a field, whose name is cut off."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def merged_array(elements: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(elements, ",", "null"), F.lit("]"))


def joined_header(values: Column) -> Column:
    """Values of a repeated header, without empty ones."""
    return F.array_join(F.filter(values, lambda v: v != ""), ",")


def client_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{IsDigit}]", "-")


def durable_name(subject: Column) -> Column:
    return F.replace(subject, F.lit("."), F.lit("-"))


def msg(payload, kind: str | None = None, **metadata: str) -> tuple[str, bytes, dict[str, str]]:
    """A message as a row for ``createDataFrame(rows, MESSAGE)``; what isn't text or bytes becomes JSON."""
    data = payload if isinstance(payload, bytes) else payload.encode() if isinstance(payload, str) else json.dumps(payload, separators=(",", ":")).encode()
    return uuid.uuid4().hex, data, metadata | ({KIND: kind} if kind else {})
