"""Language ID against plain loops: features, training coordinate by coordinate, probabilities."""

import math
import random

import numpy as np
import pytest

from hitpath.llm import langid

M32 = 0xFFFFFFFF


def plain_features(text):
    """Three features per letter: itself, with the letter before, with both neighbours; 0 stands for a word's end."""
    codes = [0] + [(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0 for c in text] + [0]
    found = []
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            one = b * 2654435761 & M32
            two = (((a + 0x9E37) & M32) * 2246822519 & M32) ^ one
            three = (((c + 0x85EB) & M32) * 3266489917 & M32) ^ ((two * 2654435761 + 1) & M32)
            shift = 32 - (langid.FEATURES.bit_length() - 1)
            found += [(x * 2654435761 & M32) >> shift for x in (one ^ 0xABCD, two, three)]
    return found


def random_texts(n=60):
    rng = random.Random(7)
    return ["", " ", "1", "a"] + ["".join(rng.choice("abcé ÄIß.,1\n中İ") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_features():
    texts = random_texts()
    ids, doc, letters = langid.grams(texts)
    for i, text in enumerate(texts):
        assert ids[doc == i].ravel().tolist() == plain_features(text)
        assert letters[i] == sum(c.isalpha() for c in text)


@pytest.mark.parametrize("bits", [1, 3, 10])
@pytest.mark.parametrize("most", [1, 20, 400])
def test_smallest_of_each_language(spark, monkeypatch, bits, most):
    monkeypatch.setattr(langid, "PARTS_BITS", bits)
    rng = random.Random(1)
    rows = [(i % 700, rng.choice("aaaaaaab") if i % 50 else "c", rng.randrange(-(2**63), 2**63)) for i in range(1500)]
    rows += [(5, "a", -(2**63)), (4, "a", 2**63 - 1), (9, "d", 7)]
    got = langid._smallest(spark.createDataFrame(rows, "doc_id long, lang string, h long").repartition(4), most)
    want = [r for lang in "abcd" for r in sorted((r for r in rows if r[1] == lang), key=lambda r: (r[2], r[0]))[:most]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_training(samples, classes):
    """Follow the regularised leader with elastic net, one number at a time; feature -1 is the bias."""
    z, n = {}, {}

    def weight(key):
        l1 = 0.0 if key[0] == -1 else langid.L1
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        sign = math.copysign(1.0, z[key])
        return -(z[key] - sign * l1) / ((langid.BETA + math.sqrt(n.get(key, 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for label, row in samples:
            scores = [sum(x * weight((f, k)) for f, x in row) for k in range(classes)]
            top = max(scores)
            exps = [math.exp(s - top) for s in scores]
            for k in range(classes):
                error = exps[k] / sum(exps) - (k == label)
                for f, x in row:
                    g, key = error * x, (f, k)
                    step = (math.sqrt(n.get(key, 0.0) + g * g) - math.sqrt(n.get(key, 0.0))) / langid.ALPHA
                    was = weight(key)
                    z[key] = z.get(key, 0.0) + g - step * was
                    n[key] = n.get(key, 0.0) + g * g
    return weight


def test_training():
    rng = random.Random(3)
    samples = []
    for i in range(40):
        row = [(f, rng.random()) for f in sorted(rng.sample(range(30), rng.randrange(1, 8)))] + [(-1, 1.0)]
        samples.append((i % 3 if i % 7 else rng.randrange(3), row))
    weight = plain_training(samples, 3)
    arrays = [
        (label, np.array([langid.FEATURES if f == -1 else f for f, _ in row]), np.array([x for _, x in row]))
        for label, row in samples
    ]
    weights, bias = langid._train(arrays, 3)
    for k in range(3):
        assert abs(bias[k] - weight((-1, k))) < 1e-9
        assert all(abs(weights[f, k] - weight((f, k))) < 1e-9 for f in range(30))
    assert not weights[30:].any()


def test_probabilities():
    rng = np.random.default_rng(5)
    model = langid.Model(["de", "en", "fr"], rng.normal(size=(langid.FEATURES, 3)) * 20, rng.normal(size=3), 1.7)
    texts = random_texts()
    names, scores = langid.predict(model, texts)
    for text, name, score in zip(texts, names, scores):
        features = plain_features(text)
        if not features:
            assert (name, score) == ("und", 0.0)
            continue
        logits = [(sum(model.table[f, k] for f in features) / len(features) + model.bias[k]) / model.temperature for k in range(3)]
        exps = [math.exp(x - max(logits)) for x in logits]
        best = max(range(3), key=exps.__getitem__)
        assert name == model.languages[best] and abs(score - exps[best] / sum(exps)) < 1e-6


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    logits, labels = rng.normal(size=(300, 4)) * 9, rng.integers(0, 4, 300)
    logits[np.arange(300), labels] += 12

    def loss(t):
        e = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return -np.log(e[np.arange(300), labels] / e.sum(axis=1)).mean()

    found = langid._temperature(logits, labels)
    assert all(loss(found) <= loss(found * f) + 1e-9 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2))
