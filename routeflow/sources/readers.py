"""Sources: static messages, line files, tables, brokers by option maps, and a tail of growing files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from routeflow.functions import messages as M


def static(spark: SparkSession, payload: str, n: int) -> DataFrame:
    """A constant payload ``n`` times (a stream has no end, a batch needs one)."""
    return spark.range(n).select(M.hex_id(F.col("id")).alias("message_id"), F.encode(F.lit(payload), "UTF-8").alias("payload"), F.expr("cast(map() as map<string,string>)").alias("metadata"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return M.from_lines(spark.read.text(path))


def stream_lines(spark: SparkSession, folder: str, consume: bool = False, archive: str | None = None) -> DataFrame:
    """New files of a folder; ``consume`` removes read files (whole files, not lines), or moves them to ``archive``."""
    reader = spark.readStream.format("text")
    if consume:
        reader = reader.option("cleanSource", "archive" if archive else "delete").options(**({"sourceArchiveDir": archive} if archive else {}))
    return M.from_lines(reader.load(folder))


def kafka_options(options: dict) -> dict[str, str]:
    """Options of Spark's Kafka source. With a group reading starts at the earliest offset, without one at the latest."""
    out = {"kafka.bootstrap.servers": options["url"], "subscribe": options["topic"], "includeHeaders": "true", "startingOffsets": "earliest" if options.get("group_id") else "latest"}
    if options.get("group_id"):
        out["kafka.group.id"] = options["group_id"]
    if options.get("batch_size"):
        out["maxOffsetsPerTrigger"] = str(options["batch_size"])
    if tls := options.get("tls"):
        out["kafka.security.protocol"] = "SASL_SSL" if options.get("username") else "SSL"
        out |= {f"kafka.ssl.{k}": v for k, v in (("truststore.location", tls.get("ca_file")), ("keystore.location", tls.get("cert_file"))) if v}
    if options.get("username"):
        out |= {"kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{options["username"]}" password="{options["password"]}";'}
    return out


def from_kafka(rows: DataFrame) -> DataFrame:
    """Rows of the Kafka source as messages."""
    carried = F.filter("headers", lambda h: h["key"].isin("message_id", M.CARRIED_ID))
    header = F.decode(F.try_element_at(carried, F.lit(1))["value"], "UTF-8")
    metadata = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], F.decode(h["value"], "UTF-8"))))
    return rows.select(M.kafka_id(F.col("key"), header, F.col("partition"), F.col("offset")).alias("message_id"), F.col("value").alias("payload"), metadata.alias("metadata"))


class TailReader(SimpleDataSourceStreamReader):
    """Lines appended to a file since the last offset, a byte position; a file that shrank is read from its start."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"pos": 0}

    def read(self, start: dict):
        pos, size = start["pos"], os.path.getsize(self.path) if os.path.exists(self.path) else 0
        pos = 0 if size < pos else pos
        rows = []
        if size > pos:
            with open(self.path, "rb") as f:
                f.seek(pos)
                for line in f:
                    if not line.endswith(b"\n") or len(rows) >= self.most:
                        break
                    rows.append((line[:-1].decode("utf-8", "replace"),))
                    pos += len(line)
        return iter(rows), {"pos": pos}

    def readBetweenOffsets(self, start: dict, end: dict):
        with open(self.path, "rb") as f:
            f.seek(start["pos"])
            data = f.read(max(0, end["pos"] - start["pos"]))
        return iter([(x.decode("utf-8", "replace"),) for x in data.split(b"\n")[:-1]])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", file)``, for files on a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema):
        return TailReader(self.options["path"], int(self.options.get("maxLines", "10000")))


def decode_frame(frames: DataFrame, value: str = "value") -> DataFrame:
    """Broker frames that hold a JSON array of envelopes, one envelope, or raw text, as lines."""
    many = F.from_json(value, "array<string>")
    array = F.col(value).startswith("[") & many.isNotNull()
    return frames.select(F.explode(F.when(array, many).otherwise(F.array(value))).alias("value"), *[c for c in frames.columns if c != value])


def envelope(message: tuple[str, bytes, dict]) -> str:
    return json.dumps({"message_id": message[0], "payload": message[1].decode(), "metadata": message[2]}, separators=(",", ":"))
