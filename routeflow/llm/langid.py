"""Language ID: nearest centroid over TF-IDF vectors of character n-grams.

Texts are lowered and everything but letters becomes one space; n-grams of one to three characters are hashed into
``BUCKETS`` counts. Document frequencies of the buckets come from all training rows. Weights are sublinear counts times
IDF, of length 1. Each language gets up to ``CLUSTERS`` centroids by spherical k-means over a bounded sample of its
training rows (``SAMPLE`` rows a language in expectation, chosen by a hash of id, text and row, so that rows sharing an id
are drawn apart); clusters of less than 1 % of these are dropped. A text goes to the centroid of largest cosine. Distance-based rejection marks texts whose cosine to every
centroid is below that of nearly all training texts of the winning centroid, by a margin that shrinks smoothly with the
number of letters. N-grams of one bucket share its count and weight.

Defined cases: texts that are null or hold no letter get ``und``, score 0, rejected; without any training row so do all, and
nothing can be rejected: ``accepted`` then keeps every row; very long texts are counted whole, alone in their batch;
null languages are never learned; null ids are ids like others; repeated rows count as often as they occur; carried columns with a prediction's name
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, slices

BUCKETS, CLUSTERS, SAMPLE = 4096, 4, 600
#: Rejection: a text is foreign if its cosine is under this share of the least cosine that all but 1 % of the centroid's training texts have.
MARGIN = 0.4
#: A text of so many letters is rejected below half of that floor; shorter ones, which say less, below less, longer ones below more.
HALF = 30

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray | None, int]:
    """Counts of hashed n-grams and the number of letters; None without letters."""
    if not text:
        return None, 0
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[points]
    n = int(letter.sum())
    if not n:
        return None, 0
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of other characters the first stays, as a space
    c = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA77)
    return np.bincount(np.concatenate([one, two, three]) >> np.uint32(20), minlength=BUCKETS), n


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray  # one row each, of length 1
    langs: list[str]  # of each centroid
    floors: np.ndarray  # of each centroid, the cosine below which texts are rejected


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / max(np.sqrt(v @ v), 1e-12)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            counts, _ = gram_counts(text)
            if counts is not None:
                df += counts > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "n"])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(lang, got.astype("<u4").tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (got := gram_counts(text)[0]) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "counts"])


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; rows of ``vectors`` have length 1."""
    centre = vectors.mean(0)
    seeds = [int(np.argmax(vectors @ centre))]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centroids = vectors[seeds]
    for _ in range(rounds):
        of = np.argmax(vectors @ centroids.T, 1)
        sums = np.stack([vectors[of == j].sum(0) if (of == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount(np.argmax(vectors @ centroids.T, 1), minlength=len(centroids))
    kept = sizes >= max(1, 0.01 * len(vectors))  # a cluster of a few odd texts stands for no language
    return centroids[kept] if kept.any() else centroids


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model | None:
    """Learn from all rows of ``train`` with a language: frequencies from all, centroids from the bounded sample."""
    train = train.where(F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    stats = train.select(F.col(text_col).alias("text")).transform(in_arrow, _statistics, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS), 0
    for r in stats:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((n + 1) / (df + 1)) + 0.1
    pick: Column = F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col), F.monotonically_increasing_id()), F.lit(1 << 30))
    for lang, rows in sizes.items():
        pick = pick | ((F.col(lang_col) == lang) & (draw < int(min(1.0, sample / rows) * (1 << 30))))
    by: dict[str, list[np.ndarray]] = {}
    for r in train.where(pick).select(lang_col, text_col).transform(in_arrow, _samples, "lang string, counts binary").collect():
        by.setdefault(r["lang"], []).append(vector(np.frombuffer(r["counts"], "<u4").astype(np.float64), idf))
    if not by:
        return None
    centroids, langs, floors = [], [], []
    for lang in sorted(by):
        vectors = np.array(by[lang])
        own = cluster(vectors, clusters)
        near, of = (vectors @ own.T).max(1), (vectors @ own.T).argmax(1)
        for j, c in enumerate(own):
            centroids.append(c)
            langs.append(lang)
            floors.append(MARGIN * float(np.quantile(near[of == j], 0.01)) if (of == j).any() else 0.0)
    return Model(idf.astype(np.float32), np.array(centroids, np.float32), langs, np.array(floors))


def _predict(model, text_at: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in slices(batches):
            langs, scores, rejected = [], [], []
            for text in batch.column(text_at).to_pylist():
                counts, letters = gram_counts(text)
                if counts is None or m is None:
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                cosines = m.centroids @ vector(counts, m.idf)
                best = int(np.argmax(cosines))
                langs.append(m.langs[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
                rejected.append(bool(cosines[best] < m.floors[best] * letters / (letters + HALF)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[str(i) for i in range(carried + 3)])

    return run


def predict(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns in ``carry``, then language, score (cosine) and rejection under ``names``, for every row."""
    carry = [c for c in carry if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets times clusters times languages
    rows = docs.select(*carry, *([] if text_col in carry else [text_col]))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[: len(carry)])) + ", p string, s double, r boolean"
    return rows.transform(in_arrow, _predict(shared, rows.columns.index(text_col), len(carry)), schema).toDF(*carry, *names)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all rows where there is no model."""
    if model is None:
        return docs
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of our own can't clash
    found = predict(own, model, own.columns, f"c{docs.columns.index(text_col)}", ("lang_pred", "score", "rejected"))
    return found.where(~F.col("rejected")).select(*own.columns).toDF(*docs.columns)


def crc_fold(column: Column, folds: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % folds
