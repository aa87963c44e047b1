"""Toxicity recomputed in plain Python: words, terms, the likelihood and the probabilities."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from tidewater.llm import toxicity


def words_of(text):
    """Runs of ASCII letters, digits and any other code points over 7F, ASCII-lower-cased."""
    return set(re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))


def corpus(grades):
    r = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(500):
        grade = int(r.integers(0, grades)) if k % 3 == 0 else 0
        w = [f"w{r.integers(40)}" for _ in range(int(r.integers(0, 30)))]
        w += [["", "Vile,", "vile awful!!"][grade if r.random() < 0.9 else 0]] + (["Ärger"] if r.random() < 0.1 + 0.3 * grade else [])
        docs.append((k, " ".join(r.permutation([x for x in w if x])) if k % 50 else None))
        if k < 350:
            labels.append((k, grade if k % 41 else None))
    return docs, labels


@pytest.mark.parametrize("grades", [2, 3])
def test_against_plain_python(spark, grades):
    docs, labels = corpus(grades)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text, given = dict(docs), {k: g for k, g in labels if g is not None}
    bad = [k for k, g in given.items() if g > 0]
    good = [k for k, g in given.items() if not g]
    counts = defaultdict(lambda: [0, 0])
    for k in given:
        for w in words_of(text[k]):
            counts[w][given[k] == 0] += 1
    z = {}
    for w, (a, b) in counts.items():
        p = (a + b) / len(given)
        z[w] = (a / len(bad) - b / len(good)) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / len(bad) + 1 / len(good)))
    chosen = sorted(w for w, v in z.items() if sum(counts[w]) >= 3 and abs(v) >= 4)
    assert chosen and "vile" in chosen and len(model.terms) == len(chosen) and len(model.thresholds) == grades - 1
    rows = df.collect()
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}

    # the fit is a minimum of the penalised likelihood in its own features: no step of 0.3 in a weight or threshold does better
    hashed = {w: int(toxicity.term_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0]) for w in chosen}
    weight = {w: float(model.weights[list(model.terms).index(h)]) for w, h in hashed.items()}

    def probabilities(k, weight, theta):
        eta = sum(v for w, v in weight.items() if w in words_of(text[k]))
        below = [1 / (1 + math.exp(-(t - eta))) for t in theta] + [1.0]
        return [b - a for a, b in zip([0.0, *below], below)]

    def loss(weight, theta):
        return -sum(math.log(probabilities(k, weight, theta)[g]) for k, g in given.items()) + 0.25 / 2 * sum(v * v for v in weight.values())

    best, theta = loss(weight, model.thresholds), list(model.thresholds)
    for w in chosen:
        for d in (-0.3, 0.3):
            assert loss({**weight, w: weight[w] + d}, theta) > best
    for j in range(len(theta)):
        for d in (-0.3, 0.3):
            assert loss(weight, [t + d * (i == j) for i, t in enumerate(theta)]) > best
    for r in rows:
        p = probabilities(r["doc_id"], weight, theta)
        got = scored[r["doc_id"]]
        assert got["severity"] == pytest.approx(sum(k * x for k, x in enumerate(p)), abs=1e-6)
        assert got["p_toxic"] == pytest.approx(1 - p[0], abs=1e-6) and got["toxic"] == (got["p_toxic"] >= 0.5)


def test_ties_at_the_limit():
    """A probability of exactly one half is toxic."""
    model = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([0.0]))
    assert model.grades(np.zeros(1)).tolist() == [[0.5, 0.5]]


def test_a_tie_is_toxic(spark):
    model = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([0.0]))
    rows = toxicity.score_toxicity(spark.createDataFrame([(1, "any text"), (2, None)], "doc_id long, text string"), model).collect()
    assert all(r["toxic"] and r["severity"] == 0.5 for r in rows)
