"""Streams of topics and of line files whose offsets are the source's own, and whose commits take what was handled from the source.

``spark.readStream.format("topic")`` reads a queue from its head or a log as a subscriber; ``format("lines")`` reads a growing
file and, as batches are committed, cuts their lines off its beginning. Both plan ranges of offsets as partitions, which tasks
read for themselves; a batch that fails is planned again from where the last committed one has ended, with the same bounds.

Spark tells a source of a committed batch when it plans the next one, so what the last batch took goes when the stream runs
again. A batch holds ``limit`` messages or lines at most; where a batch was planned to end is noted in the source's manifest, since
a reader that starts anew is asked for an end before it is told the beginning.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from routeflow.sources import topics
from routeflow.sources.manifest import Manifest, open_store

#: Bytes of a line file that a task reads.
SPLIT = 64 << 20


class _Range(InputPartition):
    """Offsets from ``low`` to before ``high``; of a topic those of one segment's partition, which begins at ``first``."""

    def __init__(self, low: int, high: int, segment: str = "", part: int = 0, first: int = 0, stored_ms: int = 0):
        super().__init__(low)
        self.low, self.high, self.segment, self.part, self.first, self.stored_ms = low, high, segment, part, first, stored_ms


class TopicReader(DataSourceStreamReader):
    """Offsets: the first message that isn't read yet."""

    def __init__(self, root: str, topic: str, subscriber: str | None, limit: int | None, commits: bool, consumer: str = ""):
        self.root, self.topic, self.subscriber, self.limit, self.commits, self.consumer = root, topic, subscriber, limit, commits, subscriber or consumer

    def _state(self) -> topics.State:
        topics.check_mode(self.root, self.topic, "queue" if self.subscriber is None else "log")
        return topics.manifest(self.root, self.topic).state()

    def initialOffset(self) -> dict:
        base = self._state().get("base", 1)
        if self.subscriber is not None:
            base = max(base, topics.register(self.root, self.topic, self.subscriber) + 1)
        return {"offset": base}

    def latestOffset(self) -> dict:
        state = self._state()
        if self.subscriber is not None:
            topics.register(self.root, self.topic, self.subscriber)
        end = state.get("next", 1)
        if self.limit is not None:
            begin = max(state.get("base", 1), state.get("planned", {}).get(self.consumer, 0))
            if self.subscriber is not None:
                begin = max(begin, state["subscribers"].get(self.subscriber, {"ack": 0})["ack"] + 1)
            end = max(begin, min(end, begin + self.limit))
        return {"offset": end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        state, (low, high) = self._state(), (start["offset"], end["offset"])
        if (self.limit is not None or self.consumer) and state.get("planned", {}).get(self.consumer) != high:
            topics.manifest(self.root, self.topic).update(lambda s: s | {"planned": s.get("planned", {}) | {self.consumer: high}} if s else None)
        base = state.get("base", 1)
        if self.subscriber is not None and low < base and state["subscribers"].get(self.subscriber, {"ack": 0})["ack"] + 1 < base:
            raise topics.Gap(f"gap in {self.topic}: {low} was asked for, {base} is the first left")
        low, out = max(low, base), []  # what is below has been handled: this batch is planned again after its commit
        for s in state.get("segments", ()):
            first = s["first"]
            for part, n in s["parts"]:
                if first < high and first + n > low:
                    out.append(_Range(max(low, first), min(high, first + n), s["id"], part, first, s["stored_ms"]))
                first += n
        return out or [_Range(low, low)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.high <= partition.low:
            return
        store, path = open_store(topics.segment_path(self.root, self.topic, partition.segment))
        files = pyarrow.dataset.dataset(path, format="parquet", filesystem=store)
        place = lambda offset: partition.part << 33 | (offset - partition.first)
        here = (pc.field("__part") == partition.part) & (pc.field("__at") >= place(partition.low)) & (pc.field("__at") < place(partition.high))
        for batch in files.to_batches(columns=["message_id", "payload", "metadata", "__at"], filter=here, batch_size=10_000):
            if batch.num_rows:
                offset = pc.add(pc.bit_wise_and(batch.column("__at"), pa.scalar(topics._PLACE, pa.int64())), pa.scalar(partition.first, pa.int64()))
                stored = pa.array([partition.stored_ms] * batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], offset, stored], names=["message_id", "payload", "metadata", "offset", "stored_ms"])

    def commit(self, end: dict) -> None:
        if not self.commits:
            return
        if self.subscriber is not None:
            topics.acknowledge(self.root, self.topic, self.subscriber, end["offset"] - 1)
        elif (first := self._state().get("base", 1)) < end["offset"]:
            topics.taken(self.root, self.topic, first, end["offset"] - 1, f"to {end['offset']}")


class TopicSource(DataSource):
    """Options ``root``, ``topic``, ``subscriber`` (of a log; without it the topic is a queue), ``limit``, a ``consumer``'s name for queues that
    several streams read with limits, and ``commit``: with ``false`` the sink takes the messages from the topic."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return "message_id string, payload binary, metadata map<string,string>, offset long, stored_ms long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return TopicReader(o["root"], o["topic"], o.get("subscriber"), int(o["limit"]) if o.get("limit") else None, str(o.get("commit", "true")).lower() != "false", o.get("consumer", ""))


class LineFile:
    """A growing file whose beginning is cut off. Positions count from its first byte ever; how many are gone stands in a manifest
    beside it. The rest is written to a new file that takes the old one's place, whose number tells whether that has happened."""

    def __init__(self, path: str):
        self.path, self.manifest = path, Manifest(f"{path}.cut")

    def cut(self) -> int:
        """Bytes that are gone. A cut that was broken off is finished or forgotten first."""
        state = self.manifest.state()
        if not (plan := state.get("plan")):
            return state.get("cut", 0)
        done = os.path.exists(self.path) and os.stat(self.path).st_ino == plan["file"]
        now = {"cut": plan["to"], "by": plan["by"], "plan": None} if done else {"plan": None}
        return self.manifest.update(lambda s: s | now if s.get("plan") == plan else None).get("cut", 0)

    def size(self) -> int:
        return self.cut() + (os.path.getsize(self.path) if os.path.exists(self.path) else 0)

    def end_of_lines(self, start: int, limit: int | None) -> int:
        """Where the last whole line ends, or the ``limit``-th after ``start``."""
        cut, size, lines, at = self.cut(), self.size(), 0, start
        if limit is None:
            back = size
            with open(self.path, "rb") as f:
                while back > start:
                    begin = max(start, back - (1 << 16))
                    f.seek(begin - cut)
                    found = f.read(back - begin).rfind(b"\n")
                    if found >= 0:
                        return begin + found + 1
                    back = begin
            return start
        with open(self.path, "rb") as f:
            f.seek(start - cut)
            while lines < limit and (line := f.readline()).endswith(b"\n"):
                at, lines = at + len(line), lines + 1
        return at

    def lines(self, low: int, high: int, end: int) -> Iterator[tuple[int, bytes]]:
        """The lines that begin from ``low`` to before ``high``, of those up to ``end``, and where they begin."""
        cut = self.cut()
        with open(self.path, "rb") as f:
            at = low
            if low > cut:  # a line that begins before belongs to the task before
                f.seek(low - cut - 1)
                at = low - 1 + len(f.readline())
            while at < min(high, end):
                line = f.readline()
                yield at, line[:-1]
                at += len(line)

    def take(self, first: int, last: int, commit: str) -> None:
        """Removes what lies between two positions from the file's beginning. A commit of the same name is made once; if someone else
        has taken the lines, it is an error."""
        cut, by = self.cut(), self.manifest.state().get("by")
        if last > first and not (cut == last and by == commit):
            if cut != first:
                raise topics.Taken(f"{self.path}: {first} to {last} were read, but {cut} is the first left")
            self.cut_to(last, commit)

    def cut_to(self, position: int, by: str = "") -> None:
        """Removes all before ``position``. What others append meanwhile is copied too, as long as it comes before the swap."""
        cut = self.cut()
        if position <= cut or not os.path.exists(self.path):
            return
        rest = f"{self.path}.rest-{position}-{os.getpid()}"
        with open(self.path, "rb") as old, open(rest, "wb") as new:
            old.seek(position - cut)
            while data := old.read(1 << 20):
                new.write(data)
            new.flush()
            os.fsync(new.fileno())
            self.manifest.update(lambda s: s | {"cut": cut, "plan": {"to": position, "by": by, "file": os.fstat(new.fileno()).st_ino}})
            while data := old.read(1 << 20):
                new.write(data)
            new.flush()
            os.replace(rest, self.path)
        self.cut()


class LineReader(DataSourceStreamReader):
    """Offsets: the first byte that isn't read yet, of all that the file ever had."""

    def __init__(self, path: str, limit: int | None, split: int, consume: bool):
        self.file, self.limit, self.split, self.consume = LineFile(path), limit, split, consume

    def initialOffset(self) -> dict:
        return {"position": self.file.cut()}

    def latestOffset(self) -> dict:
        start = max(self.file.cut(), self.file.manifest.state().get("planned", 0))
        if not os.path.exists(self.file.path):
            return {"position": start}
        if self.file.size() < start:
            raise ValueError(f"{self.file.path} was cut or replaced by someone else")
        return {"position": self.file.end_of_lines(start, self.limit)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = max(start["position"], self.file.cut()), end["position"]
        self.file.manifest.update(lambda s: s | {"planned": high} if s.get("planned") != high else None)
        return [_Range(a, min(a + self.split, high), first=high) for a in range(low, high, self.split)] or [_Range(low, low)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.high > partition.low:
            for at, line in self.file.lines(partition.low, partition.high, partition.first):
                yield line.decode("utf-8", "replace"), at

    def commit(self, end: dict) -> None:
        if self.consume:
            self.file.cut_to(end["position"])


class LineBatch(DataSourceReader):
    """The lines between two positions."""

    def __init__(self, path: str, split: int, start: str | None, end: str | None):
        self.file, self.split = LineFile(path), split
        self.start = self.file.cut() if start is None else int(start)
        self.end = self.file.end_of_lines(self.start, None) if end is None else int(end)

    def partitions(self) -> Sequence[InputPartition]:
        return [_Range(a, min(a + self.split, self.end), first=self.end) for a in range(self.start, self.end, self.split)] or [_Range(self.start, self.start)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.high > partition.low:
            for at, line in self.file.lines(partition.low, partition.high, partition.first):
                yield line.decode("utf-8", "replace"), at


class LineSource(DataSource):
    """Options ``path`` (a file that driver and executors share), ``limit``, ``split`` (bytes) and ``consume``: with ``false`` lines stay. A
    batch reads from ``start`` to ``end`` (positions), or all whole lines, and takes nothing away."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string, position long"

    def reader(self, schema) -> DataSourceReader:
        return LineBatch(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("start"), self.options.get("end"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return LineReader(o["path"], int(o["limit"]) if o.get("limit") else None, int(o.get("split", SPLIT)), str(o.get("consume", "true")).lower() != "false")


def register(spark: SparkSession) -> None:
    for source in (TopicSource, LineSource):
        spark.dataSource.register(source)

