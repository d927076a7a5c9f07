import math
import random

import numpy as np
import pytest
import xxhash

from skein.llm import quality

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def text_of(r, good, n=150):
    words = [r.choice(WORDS) for _ in range(n)]
    if not good:
        at = r.randrange(n)
        words[at : at + 40] = [w.upper() + "!!" for w in words[at : at + 40]]
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    rows = [(i, text_of(r, i % 3 > 0), i, "clash") for i in range(400)]
    extra = [(1000, None, 0, "c"), (1001, "", 0, "c"), (None, "alpha beta", 0, "c"), (1002, "word " * 200_000, 0, "c"), (0, rows[0][1], 0, "c")]
    documents = spark.createDataFrame(rows + extra, "doc_id long, text string, score long, label string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(400)] + [(None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    return documents, labels


def test_held_out_accuracy(tables):
    documents, labels = tables
    model = quality.fit(documents, labels.where(quality.learning_row()), epochs=25)
    got = quality.score(documents, model)
    held = [r for r in got.where(~quality.learning_row()).collect() if r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.9
    rows = got.collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1000)["score"] == next(r for r in rows if r["doc_id"] == 1001)["score"]
    kept = quality.keep_good(documents, model)
    assert kept.columns == documents.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_gradients():
    r = np.random.default_rng(0)
    model = quality.AttentionModel.fresh(1)
    model.weights = {k: v.astype(np.float64) + 0.1 for k, v in model.weights.items()}
    bags = [quality._bag(r.integers(0, 5000, n).astype(np.int32)) for n in (0, 3, 200)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        out = 0.0
        for (x, d), y in zip(bags, labels, strict=True):
            h = np.tanh(x @ model.weights["E"] + d @ model.weights["D"] + model.weights["b"])
            p = quality._sigmoid(model.attention(h) @ h @ model.weights["c"] + model.weights["d"][0])
            out -= y * np.log(p) + (1 - y) * np.log(1 - p)
        return out / len(bags)

    grads = model._gradients(bags, labels)
    for name, at in (("V", (1, 2)), ("U", (0, 3)), ("w", (4,)), ("c", (2,)), ("b", (5,)), ("D", (1, 3)), ("d", (0,)), ("E", tuple(np.argwhere(np.abs(grads["E"]) > 1e-4)[0]))):
        was = model.weights[name][at]
        model.weights[name][at] = was + 1e-5
        up = loss()
        model.weights[name][at] = was - 1e-5
        slope = (up - loss()) / 2e-5
        model.weights[name][at] = was
        assert grads[name][at] == pytest.approx(slope, rel=1e-2, abs=1e-6)


def test_nothing_to_learn(tables):
    documents, labels = tables
    assert quality.fit(documents, labels.limit(0)) is None
    assert quality.fit(documents, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(documents, None).collect()} == {0.5}
    assert quality.score(documents.limit(0), None).count() == 0
    assert quality.keep_good(documents, None).count() == documents.count()


def test_encoding_in_slices(monkeypatch):
    model, codes = quality.AttentionModel.fresh(2), quality.word_codes(" ".join(WORDS * 100))
    whole = model.encode(codes)
    monkeypatch.setattr(quality, "SLICE", 2 * quality.PASSAGE)
    assert np.allclose(model.encode(codes), whole) and len(whole) == -(-len(codes) // quality.PASSAGE)


def plain_score(weights, text):
    """The model by its definition, word by word and passage by passage, in Python's own numbers."""
    def shape(word):
        out = ""
        for c in word:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not out.endswith(kind * 2):
                out += kind
        return out

    w = {k: v.astype(float).tolist() for k, v in weights.items()}
    words = (text or "").split()
    vectors = []
    for at in range(0, max(1, len(words)), quality.PASSAGE):
        part = words[at : at + quality.PASSAGE]
        codes = [(xxhash.xxh3_64_intdigest(x.lower().encode()) % quality.WORDS, quality.WORDS + xxhash.xxh3_64_intdigest(shape(x).encode()) % quality.SHAPES) for x in part]
        dense = [len(set(codes)) / len(part) if part else 0.0, 1 - len(part) / quality.PASSAGE]
        sums = []
        for k in range(quality.HIDDEN):
            mean = sum(w["E"][a][k] + w["E"][b][k] for a, b in codes) / len(part) if part else 0.0
            sums.append(math.tanh(mean + dense[0] * w["D"][0][k] + dense[1] * w["D"][1][k] + w["b"][k]))
        vectors.append(sums)
    logits = []
    for h in vectors:
        total = 0.0
        for g in range(quality.GATE):
            v, u = (sum(x * w[name][k][g] for k, x in enumerate(h)) for name in ("V", "U"))
            total += math.tanh(v) / (1 + math.exp(-u)) * w["w"][g]
        logits.append(total)
    shares = [math.exp(x - max(logits)) for x in logits]
    z = [sum(a * h[k] for a, h in zip(shares, vectors, strict=True)) / sum(shares) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, w["c"], strict=True)) - w["d"][0]))


def test_scores_follow_the_definition(spark, tables):
    documents, labels = tables
    model = quality.fit(documents, labels.where(quality.learning_row()), epochs=3)
    r = random.Random(4)
    texts = [None, "", "a", "Ab1! " * 5, "!!!!!" + "x" * 5000 + "7" * 90, *[text_of(r, i % 2, n) for i, n in enumerate((1, 63, 64, 65, 700))]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in quality.score(df, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([plain_score(model.weights, t) for t in texts], abs=2e-4)


def test_a_repeated_learning_id_is_gathered_once(spark):
    df = spark.createDataFrame([(1, f"good text {i % 3}") for i in range(500)] + [(2, "BAD!! text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(df, labels) is not None
    assert quality.fit(df, labels.where("quality = 1")) is None
