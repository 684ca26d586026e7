"""Toxicity scores computed one word at a time from the model's ratios, and what length and repeats do to them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeflow.llm import toxicity

TEXTS = [
    (0, "the cat sat on the mat", 0), (1, "you grobnik, you grobnikal thing", 1), (2, "a mat and a cat and the hat", 0), (3, "what grobniky talk", 1), (4, "the hat is on the cat", 0), (5, "grobnikes and murzok", 1),
    (6, None, None), (7, "", None), (8, "12 !!", None), (9, "the the the the the grobnikov", None), (10, "ça été жара", None),
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in TEXTS], "doc_id long, text string")
    marks = spark.createDataFrame([(i, x) for i, _, x in TEXTS if x is not None], "doc_id long, toxic int")
    return toxicity.fit(docs, marks)


def _score(model, text):
    words = dict.fromkeys(w for w in toxicity.symbols(f" {text or ''} ").tobytes().split(b"\1") if w)
    begins, means, every = [], [], []
    for w in words:
        run, ratios = b"\1" + w + b"\1", []
        for i in range(1, len(run)):
            gram = int.from_bytes(run[max(0, i - toxicity.ORDER + 1) : i + 1], "big")
            value, known = model.grams.of(np.array([gram], np.uint64))
            if not known[0]:
                value = model.contexts.of(np.array([gram >> 8], np.uint64))[0]
            ratios.append(float(value[0]))
        begins.append(max(sum(ratios[:k]) for k in range(1, len(ratios) + 1)))
        means.append(sum(ratios) / (len(ratios) + 1))
        every += ratios
    x = np.zeros(toxicity.FEATURES)
    if words:
        best = sorted(begins, reverse=True)
        x = np.array([sum(every) / len(every), max(means), *(sum(max(b - bar, 0) for b in begins) / len(begins) ** 0.5 for bar in toxicity.BARS), *(sum(best[:n]) / len(best[:n]) for n in toxicity.BEST)])
    z = float(((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1])
    return 1 / (1 + np.exp(-z))


def test_scores_by_hand(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t, _ in TEXTS], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for i, text, _ in TEXTS:
        assert abs(got[i] - _score(model, text)) < 1e-9
    assert got[6] == got[7] == got[8]


def test_repeats_of_a_text_change_nothing(spark, model):
    text = "what a grobnik thing the cat is"
    rows = [(1, text), (2, " ".join([text] * 500)), (3, text.replace(" ", "\n"))]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()]
    assert abs(got[0] - got[1]) < 1e-12 and got[0] == got[2]


def test_distinct_words():
    keys, starts = toxicity.grams("ab abc ab b abc ab " + "z" * 40)
    own, begins = toxicity.distinct(keys, starts)
    words = ["ab", "abc", "b", "z" * 40]
    want = np.concatenate([toxicity.grams(w)[0] for w in words])
    assert own.tolist() == want.tolist() and begins.tolist() == [0, 3, 7, 9]
    assert [len(x) for x in toxicity.distinct(*toxicity.grams(""))] == [0, 0]


def test_held_out_documents(spark):
    """More than three quarters of the labelled documents are found, with few false marks."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    marked = docs.join(labels, "doc_id").select("doc_id", "text", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").where(~held), labels.where(~held))
    out = toxicity.score(marked.where(held & F.col("toxic").isNotNull()), model, ["doc_id", "toxic"]).where("score >= 0.7").groupBy("toxic").count().collect()
    found = {r["toxic"]: r["count"] for r in out}
    assert found[1] > 0.8 * 144 and found.get(0, 0) <= 6
