"""Language ID against vectors, centroids, cosines and floors computed one n-gram at a time."""

import math
from collections import Counter

from routeflow.llm import langid

M32 = (1 << 32) - 1
ROWS = [
    (0, "the cat, the mat", "en"), (1, "The dog and the cat!", "en"), (2, "a cat sat on a mat", "en"), (3, "und der Hund", "de"), (4, "Die Katze und die Maus", "de"), (5, "Ünd ß 12 der", "de"),
    (6, None, "de"), (7, "123 ...", "en"), (8, "le chat et la souris", None), (9, "the the the", "en"), (10, "", "fr"),
]


def _buckets(text):
    points, before = [32], False
    for c in text.lower():
        if c.isalpha():
            points.append(ord(c))
        elif before:
            points.append(32)
        before = c.isalpha()
    points.append(32)
    one = [p * 0x9E3779B1 & M32 for p in points]
    two = [(a ^ (b * 0x85EBCA77 + 0x165667B1 & M32)) * 0xC2B2AE3D & M32 for a, b in zip(one, points[1:], strict=False)]
    three = [(a ^ (c * 0x27D4EB2F + 0x9E3779B1 & M32)) * 0x85EBCA77 & M32 for a, c in zip(two, points[2:], strict=False)]
    return Counter(x >> 20 for x in one + two + three)


def _letters(text):
    return sum(c.isalpha() for c in (text or "").lower())


def _unit(v):
    n = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / n for k, x in v.items()}


def _dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def test_one_centroid_a_language(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    train = [(t, lang) for _, t, lang in ROWS if lang and _letters(t)]
    df = Counter(b for t, _ in train for b in _buckets(t))
    idf = lambda b: math.log((len(train) + 1) / (df[b] + 1)) + 0.1
    vector = lambda t: _unit({b: math.log1p(n) * idf(b) for b, n in _buckets(t).items()})
    centroids, floors = {}, {}
    for lang in ("de", "en"):
        own = [vector(t) for t, x in train if x == lang]
        total = Counter()
        for v in own:
            total.update(v)
        centroids[lang] = _unit(total)
        near = sorted(_dot(v, centroids[lang]) for v in own)
        place = 0.01 * (len(near) - 1)
        floors[lang] = langid.MARGIN * (near[0] + (near[1] - near[0]) * place)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs, clusters=1), ["doc_id"]).collect()}
    for i, text, _ in ROWS:
        n = _letters(text)
        if not n:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        cosine, lang = max((_dot(vector(text), c), lang) for lang, c in centroids.items())
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - cosine) < 1e-5
        assert got[i]["rejected"] == (cosine < floors[lang] * n / (n + langid.HALF))
