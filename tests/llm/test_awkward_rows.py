"""Rows that share an id, null ids, absent models, images of any size, vectors too long for their scores."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routeflow.llm import gif, langid, mixing, topk, toxicity

WORDS = {"en": "the cat sat on the mat and looked at us", "de": "die Katze sitzt auf der Matte und schaut uns an"}


def _one_id(spark, n, doc_id):
    rows = [(doc_id, f"{WORDS[lang]} {'xy'[i % 2] * (i % 9)} {i}", lang, "s", 1) for i in range(n) for lang in WORDS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("doc_id", [8, None])
def test_languages_of_rows_that_share_an_id(spark, doc_id):
    docs = _one_id(spark, 500, doc_id)
    model = langid.fit(docs, sample=50)
    assert sorted(set(model.langs)) == ["de", "en"]
    assert langid.accepted(docs, model).count() == 1000
    out = langid.predict(docs, model, ["lang"])
    assert out.where("lang = lang_pred").count() == 1000


def test_no_model_rejects_nothing(spark):
    docs = _one_id(spark, 5, 1).withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(docs) is None
    assert langid.accepted(docs, None).count() == 10
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 10


@pytest.mark.parametrize("doc_id", [8, None])
def test_toxicity_of_rows_that_share_an_id(spark, doc_id):
    docs = _one_id(spark, 100, doc_id).unionByName(_one_id(spark, 100, 9))
    labels = spark.createDataFrame([(8, 1), (8, 1), (9, 0), (None, 1), (8, None), (9, 5)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, calibration=40)
    assert (model is None) == (doc_id is None)
    assert toxicity.score(docs, model, ["doc_id"]).where("score between 0 and 1").count() == 400
    if model is not None:
        counts = toxicity.gram_counts(docs.where("doc_id = 8").select(F.lit(1).alias("toxic"), "text"))
        assert counts.agg(F.sum("n1")).first()[0] == sum(len(toxicity.grams(r["text"])[0]) for r in docs.where("doc_id = 8").collect())


def test_images_of_any_legal_size(spark):
    small = gif.encode_samples(gif.padded(b"abc"))
    large = small[:6] + struct.pack("<HH", 300, 200) + small[10:]  # the same frame on a larger canvas
    df = spark.createDataFrame([(1, bytearray(small)), (2, bytearray(large))], "doc_id long, media binary")
    assert {r["doc_id"]: r["error"] for r in gif.gif_frames(df, pixels=1000).collect()} == {1: None, 2: "canvas too large"}
    assert {r["doc_id"]: (r["error"], r["width"]) for r in gif.gif_frames(df, pixels=65535**2).collect()} == {1: (None, 64), 2: (None, 64)}


def test_too_long_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [3.0e6, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too long for integer inner products"):
        topk.floored(df).collect()
    fine = df.where("vec_id = 2").unionByName(spark.createDataFrame([(3, [2.0e6, -2.0e5])], "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: np.frombuffer(r["v"], "<i8").tolist() for r in topk.floored(fine).collect()}
    assert got == {2: [1024, 2048], 3: [2048000000, -204800000]}


def test_mix_of_equal_ids_is_the_same_in_every_run(spark):
    rows = [(1, f"w{i % 7} x{i}", "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(r["text"] for r in mixing.sampled(df.repartition(n, "text"), share=0.5).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and 0 < len(runs[0]) < 60
