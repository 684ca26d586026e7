"""Toxicity: class-conditional Kneser-Ney models of words' letters.

Words are runs of letters, lowered, between boundaries. A Latin-1 letter is one symbol, any other letter two to four of
their own, so that no letters share theirs; the model predicts each symbol and each word's end from up to ``ORDER - 1``
symbols before it in the word. The toxic and the ordinary class have counts of their own at the full order;
below it both back off to one shared Kneser-Ney distribution (how many different contexts a letter follows, pooled over
the classes), so that an expression that a class has hardly seen is judged by what all texts show.

The resulting log-likelihood ratios, one for each n-gram and context, stay whole, in tables on the shared folder. A task
gathers about ``CHUNK`` symbols of texts, reads through the tables once for the distinct n-grams among them, and scores
those texts: no n-gram is dropped or taken for another, and what a task holds has a fixed size besides its longest text.

A text's toxic and ordinary log-likelihoods are compared normalised by length, over its distinct words: a symbol's mean over all
of them, a symbol's mean in the best word, and how far words' best beginnings (sums of log-likelihood ratios from a word's first
symbol on, since an expression may go on with ordinary letters) exceed each of ``BARS``, over the root of the number of words;
and the means of the ``BEST`` best beginnings. None of these grows with the text. A logistic function makes
of these the score. It is fitted on a bounded sample of training
rows (``CALIBRATION`` in expectation, at most one in ``HELD_BACK``) with ratios from the counts of all others; the ratios
that texts are scored with then come from the counts of every training row, those of the sample too.

Defined cases: null texts and texts without letters score like the empty text; very long texts are scored whole, with their
n-grams in memory once; null labels and null ids teach nothing; an id that stands twice in the labels counts once, or once
for each of its labels where they differ; rows that share an id are drawn for calibration apart;
if the training rows don't hold both classes, every score is 0; repeated rows are scored alike; a carried column named
``score`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeflow.llm.langid import is_letter
from routeflow.llm.storage import fresh_path, in_arrow, open_fs, slices, stored

ORDER, DISCOUNT, CALIBRATION = 7, 0.75, 20_000
#: Symbols of the texts that a task scores together, and of those whose n-grams are sorted together.
CHUNK, PART = 1 << 24, 1 << 20
#: How far the log-likelihood ratio of a word's best beginning must go to add to a feature, and of how many of the best the mean counts.
BARS, BEST = (1.0, 2.0, 3.0), (1, 2, 4)
FEATURES = 2 + len(BARS) + len(BEST)
#: Every how manyth training row calibrates at most, left out of the counts until then.
HELD_BACK = 5

def _symbols() -> np.ndarray:
    """UTF-8 bytes of letters beyond Latin-1 -> symbols that no Latin-1 letter has."""
    free = [c for c in range(2, 256) if not chr(c).isalpha() or chr(c).isupper()]
    table = np.zeros(256, np.uint8)
    table[0x80:0xC0], table[0xC4:0xF5] = free[:64], free[64 : 64 + 0xF5 - 0xC4]
    return table


_SYMBOLS = _symbols()


def symbols(text: str) -> np.ndarray:
    """The text's symbols: 1 for what is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(is_letter()[points], points, 1).astype("<u4")
    if not len(points) or points.max() < 256:
        return points.astype(np.uint8)
    data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
    latin = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    out = np.where(data < 0x80, data, _SYMBOLS[data])
    out[latin] = (data[latin] & 3) << 6 | data[latin + 1] & 0x3F
    return np.delete(out, latin + 1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (one byte a symbol, the predicted one lowest), one for each symbol and word end, and words' starts among them."""
    empty = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not text:
        return empty
    c = np.concatenate([[1], symbols(text), [1]]).astype(np.uint64)
    c = c[np.r_[True, (c[1:] != 1) | (c[:-1] != 1)]]
    if len(c) < 2:
        return empty
    ends = np.flatnonzero(c == 1)
    keys = c[1:].copy()
    since = np.arange(1, len(c)) - np.repeat(ends[:-1], np.diff(ends))  # symbols since the word's opening boundary
    for k in range(1, ORDER):
        at = np.flatnonzero(since >= k)
        keys[at] |= c[at + 1 - k] << np.uint64(8 * k)
    return keys, ends[:-1]


class Ratios(NamedTuple):
    path: str  # Parquet files of (gram, ratio), each sorted by gram

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of distinct sorted keys, and which of them the table has."""
        found, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        store, path = open_fs(self.path)
        for file in store.get_file_info(fs.FileSelector(path)) if len(keys) else ():
            if not file.path.endswith(".parquet"):
                continue
            with store.open_input_file(file.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(1 << 18):
                    own = batch.column(0).to_numpy().astype(np.uint64)
                    if not len(own):
                        continue
                    lo, hi = np.searchsorted(keys, own[0]), np.searchsorted(keys, own[-1], "right")
                    at = np.searchsorted(own, keys[lo:hi])
                    here = np.flatnonzero(own[at] == keys[lo:hi])
                    found[lo + here], known[lo + here] = batch.column(1).to_numpy()[at[here]], True
        return found, known


class Model(NamedTuple):
    grams: Ratios  # log-likelihood ratio of seen n-grams
    contexts: Ratios  # of an unseen n-gram after a seen context
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, the constant last


def distinct(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same n-grams, each word once, in the order of its first occurrence. Words are told apart by 64 bits."""
    if not len(keys):
        return keys, starts
    mixed = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    _, first = np.unique(np.add.reduceat(mixed ^ mixed >> np.uint64(32), starts), return_index=True)
    first.sort()
    sizes = np.diff(np.append(starts, len(keys)))[first]
    begins = np.cumsum(sizes) - sizes
    return keys[np.repeat(starts[first] - begins, sizes) + np.arange(sizes.sum())], begins


def features(ratio: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the ratios of a text's distinct words say; see above."""
    if not len(ratio):
        return np.zeros(FEATURES)
    ratio = ratio.astype(np.float64)
    words, sizes, sums = np.add.reduceat(ratio, starts), np.diff(np.append(starts, len(ratio))), np.cumsum(ratio)
    each = words / (sizes + 1)  # one symbol more, lest the shortest words stand out
    begins = np.maximum.reduceat(sums - np.repeat(np.append(0, sums)[starts], sizes), starts)
    best = np.sort(begins)[::-1]
    return np.array([words.sum() / len(ratio), each.max(), *(np.maximum(begins - bar, 0).sum() / np.sqrt(len(words)) for bar in BARS), *(best[:n].mean() for n in BEST)])


class _Part(NamedTuple):
    keys: np.ndarray  # distinct n-grams of some texts
    places: np.ndarray  # each symbol's n-gram among them
    ends: np.ndarray  # where each text ends
    starts: list[np.ndarray]
    carried: pa.RecordBatch


def _part(found: list[tuple[np.ndarray, np.ndarray]], carried: pa.RecordBatch) -> _Part:
    keys, places = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return _Part(keys, places.astype(np.int32), np.cumsum([len(k) for k, _ in found]), [s for _, s in found], carried)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    """Rows with the text in the first column, as parts of at most ``PART`` symbols or one text."""
    for batch in slices(batches):
        found, size, at = [], 0, 0
        carried = batch.select(range(1, batch.num_columns))
        for i, text in enumerate(batch.column(0).to_pylist()):
            own = distinct(*grams(text))
            if found and size + len(own[0]) > PART:
                yield _part(found, carried.slice(at, i - at))
                found, size, at = [], 0, i
            found.append(own)
            size += len(own[0])
        if found:
            yield _part(found, carried.slice(at))


def _featured(batches: Iterator[pa.RecordBatch], seen: Ratios, contexts: Ratios) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Features of each row, and the row's other columns; the first column is the text."""

    def scored(parts: list[_Part]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        keys = np.unique(np.concatenate([p.keys for p in parts]))
        ratio, known = seen.of(keys)
        rest = np.flatnonzero(~known)
        outer, place = np.unique(keys[rest] >> np.uint64(8), return_inverse=True)
        ratio[rest] = contexts.of(outer)[0][place]
        for p in parts:
            own = ratio[np.searchsorted(keys, p.keys)][p.places]
            yield np.array([features(x, s) for x, s in zip(np.split(own, p.ends[:-1]), p.starts, strict=True)]), p.carried

    held: list[_Part] = []
    size = 0
    for part in _parts(batches):
        held.append(part)
        size += len(part.places)
        if size >= CHUNK:
            yield from scored(held)
            held, size = [], 0
    if held:
        yield from scored(held)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        by: list[list[np.ndarray]] = [[], []]
        for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            by[toxic].append(grams(text)[0])
        for toxic, found in enumerate(by):
            if found:
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(zero if toxic else n), pa.array(n if toxic else zero)], names=["gram", "n0", "n1"])


def gram_counts(train: DataFrame) -> DataFrame:
    """(gram, n0, n1) over all rows of (toxic, text)."""
    return train.select("toxic", "text").transform(in_arrow, _counts, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _suffix(column, symbols: int):
    return F.col(column).bitwiseAND(F.lit((1 << 8 * symbols) - 1))


def shared_backoff(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(gram, p): Kneser-Ney probabilities of the order below the full one, from both classes together."""
    levels = [counts.select("gram")]
    for k in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy(_suffix("gram", k).alias("gram")).agg(F.count("*").alias("n")))
    lower = None
    for k, level in enumerate(reversed(levels[1:]), 1):
        context = Window.partitionBy(F.shiftright("gram", 8))
        total, kinds = F.sum("n").over(context), F.count("*").over(context)
        level = level.select("gram", _suffix("gram", k - 1).alias("rest"), ((F.col("n") - discount) / total).alias("own"), (discount * kinds / total).alias("share"))
        if lower is None:
            lower = level.select("gram", (F.col("own") + F.col("share") / 256).alias("p"))
        else:
            lower = level.join(lower.select(F.col("gram").alias("rest"), "p"), "rest").select("gram", (F.col("own") + F.col("share") * F.col("p")).alias("p"))
    return lower


def log_ratios(counts: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) of seen n-grams and (gram, ratio) of contexts, for what was not seen after them."""
    context = Window.partitionBy(F.shiftright("gram", 8))
    facts = counts.select("*", *[f.over(context).alias(name) for c in (0, 1) for name, f in ((f"s{c}", F.sum(f"n{c}")), (f"t{c}", F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0))))])
    share = [F.when(F.col(f"s{c}") > 0, discount * F.col(f"t{c}") / F.col(f"s{c}")).otherwise(F.lit(1.0)) for c in (0, 1)]
    backoff = shared_backoff(counts, discount).select(F.col("gram").alias("rest"), "p")
    own = [F.when(F.col(f"s{c}") > 0, F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) / F.col(f"s{c}")).otherwise(F.lit(0.0)) for c in (0, 1)]
    p = [own[c] + share[c] * F.col("p") for c in (0, 1)]
    seen = facts.withColumn("rest", _suffix("gram", ORDER - 1)).join(backoff, "rest").select("gram", (F.log(p[1]) - F.log(p[0])).alias("ratio"))
    contexts = facts.groupBy(F.shiftright("gram", 8).alias("gram")).agg(F.max(F.log(share[1]) - F.log(share[0])).alias("ratio"))
    return seen, contexts


def kept(ratios: DataFrame, name: str) -> Ratios:
    """All rows, on the shared folder."""
    path = fresh_path(ratios.sparkSession, name)
    ratios.select("gram", F.col("ratio").cast("float")).sortWithinPartitions("gram").write.parquet(path)
    return Ratios(path)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sampled(seen: Ratios, contexts: Ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, rows in _featured(batches, seen, contexts):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["toxic", "f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration: int = CALIBRATION) -> Model | None:
    """Learn from all rows of ``docs`` that ``labels`` marks 0 or 1. None if a class is missing."""
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).distinct()
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id")
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id", "text", F.monotonically_increasing_id()), F.lit(1 << 30))
    train = stored(train.withColumn("draw", draw), "toxicity-train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    held = F.col("draw") < int(min(1 / HELD_BACK, calibration / sum(sizes.values())) * (1 << 30))
    counts = stored(gram_counts(train.where(~held)), "toxicity-grams")
    seen, contexts = (kept(x, "toxicity-ratios") for x in log_ratios(counts))
    rows = train.where(held).select("text", "toxic").transform(in_arrow, _sampled(seen, contexts), "toxic int, f array<double>").collect()
    both = counts.unionByName(gram_counts(train.where(held))).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    seen, contexts = (kept(x, "toxicity-ratios") for x in log_ratios(stored(both, "toxicity-grams")))
    x, y = np.array([r["f"] for r in rows]).reshape(-1, FEATURES), np.array([r["toxic"] for r in rows], float)
    if not 0 < y.sum() < len(y):  # too few rows to calibrate: a word twice as likely a letter when toxic is the border
        return Model(seen, contexts, np.zeros(FEATURES), np.ones(FEATURES), np.array([0, 4.0, *[0] * (FEATURES - 2), -4 * np.log(2)]))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    return Model(seen, contexts, mean, scale, _logistic((x - mean) / scale, y))


def _scored(m: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if m is None:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.zeros(batch.num_rows))], names=[str(i) for i in range(batch.num_columns)])
            return
        for x, batch in _featured(batches, m.grams, m.contexts):
            z = ((x - m.mean) / m.scale) @ m.weights[:-1] + m.weights[-1]
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[str(i) for i in range(batch.num_columns + 1)])

    return run


def score(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``carry`` and ``score`` for every row."""
    carry = [c for c in carry if c != "score"]
    rows = docs.select(F.col(text_col).alias("__text"), *carry)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[1:])) + ", s double"
    return rows.transform(in_arrow, _scored(model), schema).toDF(*carry, "score")
